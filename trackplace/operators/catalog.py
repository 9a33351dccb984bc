"""Camera cards and imports: numbering, resuming, and state shared by devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.functions.names import (
    READABLE_EXTENSIONS, camera_key, clean_text, counter_modulus, extension, import_no, is_later,
    is_place_later, place_of, seq_no, seq_width,
)
from trackplace.operators.ordered import Keyed, Prev, row_count
from trackplace.session import checkpoint

CAMERA_SAMPLE = 10
# States of one camera that a task folds at a time.
FOLD_ROWS = 100_000


# --- order of a card ---------------------------------------------------------


def _ordered(files: DataFrame, by: list[str], file_id: str, limit: int | None) -> Keyed:
    numbered = files.withColumns({
        "_v": seq_no(F.col("name")), "_w": seq_width(F.col("name")), "_l": F.lower("name"),
    }).filter(F.col("_v").isNotNull())
    placed = Keyed(numbered, by, limit).running(
        ["_v", "_l", file_id], _at=row_count(), _before=Prev(F.col("_v"))
    )
    gap = F.col("_v") - F.col("_before")
    placed = placed.totals(
        # The first of the largest gaps, and the row after it.
        _gap=F.max(F.when(gap.isNotNull(), F.struct(gap.alias("size"), (-F.col("_at")).alias("at")))),
        _min=F.min("_v"), _max=F.max("_v"), _width=F.max("_w"), rank_of=F.count(F.lit(1)),
    )
    around = F.col("_min") + counter_modulus(F.col("_width")) - F.col("_max")
    first = F.lit(1).cast("long")
    start = F.when(
        (F.col("rank_of") < 2) | (around > F.col("_gap.size")), first
    ).otherwise(-F.col("_gap.at"))
    rank = F.pmod(F.col("_at") - start, F.col("rank_of")) + 1
    return placed.transform(
        lambda d: d.withColumn("rank", rank).drop(
            "_v", "_w", "_l", "_at", "_before", "_gap", "_min", "_max", "_width")
    )


def camera_order(
    files: DataFrame, by: list[str], file_id: str = "file_id", limit: int | None = None
) -> DataFrame:
    """Adds ``rank`` (of ``rank_of``): the place of each file in its card's
    numbering, which may have wrapped. Files without a number have no place and
    are left out."""
    return _ordered(files, by, file_id, limit).rows()


def unnumbered(files: DataFrame) -> DataFrame:
    """Files whose names hold no counter."""
    return files.filter(seq_no(F.col("name")).isNull())


def filter_new(
    files: DataFrame,
    resume: DataFrame,
    by: list[str],
    file_id: str = "file_id",
    limit: int | None = None,
) -> DataFrame:
    """Files to import after a resume point.

    ``resume`` has at most one row per card with ``after_name`` or ``after_us``.
    By name, everything follows the first file of that name. By time, the first
    file not older starts the import (and is left out when it is that moment).
    ``placed`` is false for unnumbered files, which only a time can place.
    """
    points = resume.select(*by, "after_name", "after_us")
    pointed = files.join(points, by, "left")
    by_name = F.col("after_name").isNotNull() & F.col("after_us").isNull()
    hits = F.when(by_name, F.lower("name") == F.lower("after_name")).otherwise(
        F.col("local_us") >= F.col("after_us")
    )
    ordered = _ordered(pointed, by, file_id, limit).totals(
        _hit=F.min(F.when(hits, F.struct("rank", "local_us")))
    )
    # The first hit stays unless it is the resume point itself.
    skip_hit = by_name | (F.col("_hit.local_us") == F.col("after_us"))
    open_ended = F.col("after_name").isNull() & F.col("after_us").isNull()
    later = F.when(skip_hit, F.col("rank") > F.col("_hit.rank")).otherwise(
        F.col("rank") >= F.col("_hit.rank")
    )
    numbered = ordered.rows().filter(open_ended | F.coalesce(later, F.lit(False))).withColumn(
        "placed", F.lit(True)
    ).drop("_hit", "rank_of", "after_name", "after_us")
    loose = unnumbered(pointed).filter(
        open_ended | (F.col("local_us") > F.col("after_us"))
    ).withColumns({"placed": F.lit(False), "rank": F.lit(None).cast("long")})
    return numbered.unionByName(loose.drop("after_name", "after_us"))


def with_cameras(files: DataFrame, cameras: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Adds make, model and serial of the camera each file names by ``camera_id``.

    Files that name none are dealt by their own id; a null key would bring them
    all into one task.
    """
    def named() -> Column:
        return F.concat(F.lit("camera "), F.col("camera_id").cast("string"))

    alone = F.concat(F.lit("file "), F.col(file_id).cast("string"))
    known = cameras.select(named().alias("_named"), "make", "model", "serial")
    return files.withColumn("_named", F.coalesce(named(), alone)).join(known, "_named", "left").drop(
        "_named", "camera_id")


def camera_of(
    photos: DataFrame, by: list[str], file_id: str = "file_id", limit: int | None = None,
    cameras: DataFrame | None = None,
) -> DataFrame:
    """The camera each card is from: of its newest ten files, readable types
    first, the newest that names one.

    With ``cameras(camera_id, make, model, serial)`` photos have a ``camera_id``
    in place of the texts, and only the newest ten are looked up.
    """
    newest = camera_order(photos, by, file_id, limit).filter(
        F.col("rank") > F.col("rank_of") - CAMERA_SAMPLE
    )
    if cameras is not None:
        newest = with_cameras(newest, cameras, file_id)
    key = camera_key(F.col("make"), F.col("model"), F.col("serial"))
    camera = F.struct(
        clean_text(F.col("make")).alias("make"), clean_text(F.col("model")).alias("model"),
        clean_text(F.col("serial")).alias("serial"), key.alias("camera_key"),
    )
    preference = F.struct(
        (~extension(F.col("name")).isin(READABLE_EXTENSIONS)).cast("int"), -F.col("rank")
    )
    return newest.groupBy(*by).agg(
        F.min_by(camera, F.when(key.isNotNull(), preference)).alias("c")
    ).select(*by, "c.*")


# --- state shared between devices --------------------------------------------


def merge_settings(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Each setting at its later change; of two at the same time the first side's."""
    both = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(0)))
    change = F.struct("svalue", "changed_us")
    return both.groupBy(*keys).agg(
        F.max_by(change, F.struct("changed_us", "_side")).alias("s")
    ).select(*keys, "s.svalue", "s.changed_us")


def set_value(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Settings after ``changes(keys, svalue, changed_us)``: a value that is
    already set keeps its time."""
    joined = current.withColumnsRenamed({"svalue": "_v", "changed_us": "_t"}).join(
        changes, keys, "full_outer"
    )
    same = F.col("svalue").isNull() | F.coalesce(F.col("_v") == F.col("svalue"), F.lit(False))
    return joined.select(
        *keys,
        F.when(same, F.col("_v")).otherwise(F.col("svalue")).alias("svalue"),
        F.when(same, F.col("_t")).otherwise(F.col("changed_us")).alias("changed_us"),
    )


def merge_import_state(a: DataFrame, b: DataFrame, key: str | list[str] = "camera_key") -> DataFrame:
    """Per camera the resume point further along, with the higher folder number.

    The camera key may be null (the camera nobody could identify). More columns
    as key merge the cameras of several state files at once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    state = F.struct("last_file", "import_no", "at_us", "device")
    left = a.select(F.struct(*keys).alias("_ka"), state.alias("a"))
    right = b.select(F.struct(*keys).alias("_kb"), state.alias("b"))
    joined = left.join(right, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer")
    same_file = F.lower("a.last_file") == F.lower("b.last_file")
    second = F.col("a").isNull() | F.coalesce(
        F.when(same_file, F.col("b.at_us") > F.col("a.at_us")).otherwise(
            is_later(F.col("b.last_file"), F.col("a.last_file"))
        ),
        F.lit(False),
    )
    later = F.when(second, F.col("b")).otherwise(F.col("a"))
    return joined.select(
        *[F.coalesce(f"_ka.{k}", f"_kb.{k}").alias(k) for k in keys],
        later["last_file"].alias("last_file"),
        F.greatest("a.import_no", "b.import_no").alias("import_no"),
        later["at_us"].alias("at_us"),
        later["device"].alias("device"),
    )


def fold_states(
    states: DataFrame, key: str | list[str] = "camera_key", order: str = "turn", fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Any number of devices' states merged in one go, along ``order`` (unique per
    camera): which file is later is not transitive round a counter, so each state
    meets what all before it have come to.

    A camera's states are brought together in one shuffle and folded in its
    task. Of a camera with more than ``fold_rows``, so many are folded at a time,
    and what they come to is the first state of the next fold.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = ["last_file", "import_no", "at_us", "device"]
    # The unknown camera's key is null, which no join meets: as text it is a key like others.
    rows = states.select(
        *keys, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"),
        F.struct(order).alias("_turn"), F.struct(*fields).alias("s"))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= fold_rows:
        return _folded(rows, keys, fields)
    placed = Keyed(rows, ["_key"], fold_rows).running(["_turn"], _at=row_count()).rows()
    placed = checkpoint(placed.withColumn("_fold", F.floor((F.col("_at") - 1) / fold_rows)).drop("_at"))
    merged = checkpoint(_folded(placed.filter("_fold = 0"), keys, fields))
    nothing = F.lit(None).cast(rows.schema["_turn"].dataType)
    for fold in range(1, -(-most // fold_rows)):
        now = placed.filter(F.col("_fold") == fold)
        # A state without a turn comes first.
        before = merged.select(*keys, nothing.alias("_turn"), F.struct(*fields).alias("s"))
        merged = checkpoint(_folded(now.select(*keys, "_turn", "s").unionByName(before), keys, fields))
    return merged


def _folded(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    # Names are taken apart once for each state, not at every meeting.
    placed = F.struct(*[F.col(f"s.{f}").alias(f) for f in fields], place_of(F.col("s.last_file")).alias("place"))
    queue = F.array_sort(F.collect_list(F.struct(
        F.col("_turn").isNotNull().alias("later"), F.col("_turn").alias("turn"), placed.alias("s"))))
    listed = rows.groupBy(*keys).agg(queue.alias("q"), F.max("s.import_no").alias("_most"))

    def meet(a: Column, item: Column) -> Column:
        b = item["s"]
        same_file = a["place"]["low"] == b["place"]["low"]
        wins = F.when(same_file, b["at_us"] > a["at_us"]).otherwise(is_place_later(b["place"], a["place"]))
        return F.when(F.coalesce(wins, F.lit(False)), b).otherwise(a)

    state = F.aggregate(F.slice("q", 2, F.size("q")), F.get("q", F.lit(0))["s"], meet)
    # The highest number does not depend on the order.
    return listed.select(*keys, state.alias("s"), "_most").select(
        *keys, *[F.col("_most" if f == "import_no" else f"s.{f}").alias(f) for f in fields])


def merge_all_states(states: list[DataFrame], key: str = "camera_key") -> DataFrame:
    """Several devices' states, merged in the order given, in one go."""
    every = None
    for turn, state in enumerate(states):
        state = state.withColumn("turn", F.lit(turn))
        every = state if every is None else every.unionByName(state)
    return fold_states(every, key)


def merge_all_settings(settings: DataFrame, keys: list[str], order: str = "turn") -> DataFrame:
    """Each setting at its latest change on any device; of several at the same
    time the one that is first along ``order``."""
    newest = F.max_by(F.struct("svalue", "changed_us"), F.struct("changed_us", -F.col(order)))
    return settings.groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.svalue", "s.changed_us")


def ordered_state(states: DataFrame, key: str = "camera_key") -> DataFrame:
    """The unknown camera first, then cameras by key: same state, same rows."""
    return states.orderBy(F.col(key).asc_nulls_first())


def _identity(prefix: str = "") -> list[Column]:
    """Make and model in the form two cameras are compared in."""
    return [
        F.coalesce(F.lower(clean_text(F.col(f"{prefix}{c}"))), F.lit("\x00")).alias(f"_{c}")
        for c in ("make", "model")
    ]


def state_for_camera(
    cards: DataFrame, states: DataFrame, card_id: str = "card_id", order: str = "state_order"
) -> DataFrame:
    """Where the last import from each card's camera stopped.

    The state of exactly that camera, else the first of the same make and model
    whose serial agrees or is missing on either side, else the unknown camera's
    when it is the only state there is. States are reduced to one row per
    identity before any join, so many bodies of one model never meet pairwise.
    """
    key = camera_key(F.col("make"), F.col("model"), F.col("serial"))
    serial = F.coalesce(F.lower(clean_text(F.col("serial"))), F.lit("\x00"))
    seen = states.withColumns({"_key": key, "_serial": serial}).select("*", *_identity())
    payload = F.struct(*states.columns)
    known = seen.filter(F.col("_key").isNotNull())
    # Of entries for the same key the last one counts, in the first one's place.
    # One row per camera, written once and read by all that follows.
    exact = checkpoint(known.groupBy("_key").agg(
        F.max_by(payload, order).alias("s"), F.min(order).alias("_o"),
        F.max_by("_make", order).alias("_make"), F.max_by("_model", order).alias("_model"),
        F.max_by("_serial", order).alias("_serial"),
    ))
    per_body = exact.groupBy("_make", "_model", "_serial").agg(
        F.min_by("s", "_o").alias("s"), F.min("_o").alias("_o")
    )
    nobody = F.col("_serial") == "\x00"
    per_model = per_body.groupBy("_make", "_model").agg(
        F.min_by("s", "_o").alias("s_model"), F.max_by("s", F.when(nobody, 1)).alias("s_blank"),
        F.max(F.when(nobody, F.col("_o"))).alias("o_blank"),
    )
    unknown = seen.filter(F.col("_key").isNull()).agg(F.max_by(payload, order).alias("s")).scalar()
    no_other = exact.limit(1).agg((F.count(F.lit(1)) == 0).alias("n")).scalar()
    mine = cards.withColumns({"_key": key, "_serial": serial}).select("*", *_identity())
    found = (
        mine.join(exact.select("_key", F.col("s").alias("s_exact")), "_key", "left")
        .join(per_body.select("_make", "_model", "_serial", F.col("s").alias("s_body"),
                              F.col("_o").alias("o_body")), ["_make", "_model", "_serial"], "left")
        .join(per_model, ["_make", "_model"], "left")
    )
    nameless = F.col("_serial") == "\x00"
    body_first = F.col("o_blank").isNull() | (F.col("o_body") < F.col("o_blank"))
    similar = F.when(nameless, F.col("s_model")).otherwise(
        F.when(F.col("o_body").isNotNull() & body_first, F.col("s_body")).otherwise(F.col("s_blank"))
    )
    state = F.when(F.col("_key").isNull(), unknown).otherwise(
        F.coalesce(F.col("s_exact"), similar, F.when(no_other, unknown))
    )
    return found.select(card_id, state.alias("s")).filter(F.col("s").isNotNull()).select(
        card_id, *[F.col(f"s.{c}").alias(f"state_{c}") for c in states.columns]
    )


# --- where to resume ---------------------------------------------------------


def shared_watermark(files: DataFrame, states: DataFrame, card_id: str = "card_id") -> DataFrame:
    """Shared resume points (``card_id, state_last_file, ..``) whose file is on the card."""
    names = files.select(card_id, F.lower("name").alias("_n"))
    return states.withColumn("_n", F.lower("state_last_file")).join(
        names, [card_id, "_n"], "left_semi"
    ).drop("_n")


def local_watermark(
    imported: DataFrame, cards: DataFrame, folders: DataFrame | None = None,
    card_id: str = "card_id", limit: int | None = None, cameras: DataFrame | None = None,
) -> DataFrame:
    """The last photo of the newest import folder that holds each card's camera.

    ``imported(card_id, import_no, name, file_id, make, model, serial)`` are the
    importable files below the folders of the place each card is imported to, with
    ``cameras`` as in ``camera_of``;
    ``cards(card_id, make, model, serial)`` says which camera a card is from. A
    folder whose photos do not say counts; an unknown camera takes the newest,
    which may be one of ``folders(card_id, import_no)`` without any file.
    """
    by = [card_id, "import_no"]
    ordered = camera_order(imported, by, "file_id", limit)
    last = ordered.groupBy(*by).agg(F.max_by("name", "rank").alias("last_file"))
    found = camera_of(imported, by, "file_id", limit, cameras).withColumnsRenamed(
        {c: f"f_{c}" for c in ("make", "model", "serial", "camera_key")}
    )
    there = imported.select(*by) if folders is None else folders.select(*by)
    there = there.distinct().join(last, by, "left").join(found, by, "left")
    mine = cards.withColumn("_key", camera_key(F.col("make"), F.col("model"), F.col("serial")))
    same = (
        F.lower(F.col("f_make")).eqNullSafe(F.lower(clean_text(F.col("make"))))
        & F.lower(F.col("f_model")).eqNullSafe(F.lower(clean_text(F.col("model"))))
        & F.coalesce(F.lower("f_serial") == F.lower(clean_text(F.col("serial"))), F.lit(True))
    )
    fits = F.col("_key").isNull() | (
        F.col("last_file").isNotNull() & (F.col("f_camera_key").isNull() | same)
    )
    return there.join(mine, card_id).filter(fits).groupBy(card_id).agg(
        F.max_by(F.struct("import_no", "last_file"), "import_no").alias("w")
    ).select(card_id, F.col("w.import_no").alias("local_no"), F.col("w.last_file").alias("local_file")
    ).filter(F.col("local_file").isNotNull())


def resume_point(
    cards: DataFrame, local: DataFrame, shared: DataFrame, explicit: DataFrame | None = None,
    card_id: str = "card_id",
) -> DataFrame:
    """Where each card's import starts: an explicit time, an explicit name, the
    shared point when it is later than the local one, the local one, or nowhere."""
    out = cards.select(card_id).join(local, card_id, "left").join(
        shared.select(card_id, "state_last_file"), card_id, "left"
    )
    if explicit is None:
        out = out.withColumns({
            "start_name": F.lit(None).cast("string"), "start_us": F.lit(None).cast("long"),
        })
    else:
        out = out.join(explicit, card_id, "left")
    ahead = F.col("state_last_file").isNotNull() & (
        F.col("local_file").isNull() | is_later(F.col("state_last_file"), F.col("local_file"))
    )
    name = F.when(F.col("start_us").isNotNull(), None).otherwise(
        F.coalesce("start_name", F.when(ahead, F.col("state_last_file")), F.col("local_file"))
    )
    source = (
        F.when(F.col("start_us").isNotNull(), "time").when(F.col("start_name").isNotNull(), "name")
        .when(ahead, "shared").when(F.col("local_file").isNotNull(), "local").otherwise("none")
    )
    return out.select(
        card_id, name.alias("after_name"), F.col("start_us").alias("after_us"), source.alias("source")
    )


# --- folders and copies ------------------------------------------------------


def next_import_no(folders: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """One above every local folder and every shared state."""
    local = folders.select(*by, import_no(F.col("folder")).cast("long").alias("n"))
    shared = states.select(*by, F.col("import_no").cast("long").alias("n"))
    top = F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(0))
    return local.unionByName(shared).groupBy(*by).agg((top + 1).cast("long").alias("next_no"))


def last_import_of(copies: DataFrame, by: list[str], file_id: str = "file_id", limit: int | None = None) -> DataFrame:
    """The watermark an import leaves: its last copied file in camera order."""
    ordered = camera_order(copies, by, file_id, limit)
    return ordered.groupBy(*by).agg(F.max_by("name", "rank").alias("last_file"))


def pair_copies(plan: DataFrame, by: list[str], entry_id: str = "entry_id") -> DataFrame:
    """Which planned entries can land in a flat folder: the first of each name."""
    named = Keyed(plan.filter("selected"), [*by, "name"]).totals(_first=F.min(entry_id))
    return named.rows().withColumn("copied", F.col(entry_id) == F.col("_first")).drop("_first")
