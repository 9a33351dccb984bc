"""Bringing two folders into step: what to do, worked out from their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.functions.names import is_syncable
from trackplace.operators.ordered import Keyed, Sum, row_count
from trackplace.session import checkpoint

KEEP_BOTH = "keep_both"
MERGE = "merge"


def merge_files(plan: DataFrame, local: DataFrame, remote: DataFrame, by: list[str], merge) -> DataFrame:
    """Contents of the files that ``plan`` merges. ``merge(local, remote, keys)``
    is the function of the kind of file (settings, import state) and gets the
    rows of those files on either side; ``keys`` name a file."""
    keys = [*by, "name"]
    names = plan.filter(F.col("action") == "merge").select(*keys).distinct()
    return merge(local.join(names, keys, "left_semi"), remote.join(names, keys, "left_semi"), keys)


# --- free names --------------------------------------------------------------


def _name_parts(name: Column, whole: bool) -> tuple[Column, Column]:
    """What a number goes between: stem and extension, or all of it and nothing."""
    if whole:
        return name, F.lit("")
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def free_names(
    requests: DataFrame, taken: DataFrame, by: list[str], order: list[str],
    whole: bool = False, limit: int | None = None,
) -> DataFrame:
    """Adds ``free_name``: ``name (n).ext`` with the smallest n from 2 that
    nobody has, requests for a name served along ``order``.

    ``taken(by.., name)`` are all names in use. The k-th request for a name gets
    the k-th number not taken, so both sides are counted along one order and no
    request waits for the one before it.
    """
    stem, ext = _name_parts(F.col("name"), whole)
    asked = requests.withColumns({"_stem": stem, "_ext": ext})
    t_stem, t_ext = _name_parts(F.col("name"), whole)
    number = F.regexp_extract(t_stem, r" \(([1-9]\d*)\)$", 1)
    used = (
        taken.select(
            *by,
            F.regexp_replace(t_stem, r" \([1-9]\d*\)$", "").alias("_stem"), t_ext.alias("_ext"),
            F.nullif(number, F.lit("")).try_cast("long").alias("_n"),
        )
        .filter(F.col("_n") >= 2)
        .join(asked.select(*by, "_stem", "_ext").distinct(), [*by, "_stem", "_ext"], "left_semi")
        .distinct()
    )
    keys = [*by, "_stem", "_ext"]
    both = asked.withColumn("_asks", F.lit(1)).unionByName(
        used.withColumn("_asks", F.lit(0)), allowMissingColumns=True
    )
    asks, holds = F.col("_asks") == 1, F.col("_asks") == 0
    counted = Keyed(both, keys, limit).running(
        ["_asks", "_n", *order],
        _k=Sum(asks.cast("long")), _j=Sum(holds.cast("long")),
    )
    # Free numbers below a taken one; a request passes those with fewer than its turn.
    at = F.when(asks, F.col("_k")).otherwise(F.col("_n") - 1 - F.col("_j"))
    passed = counted.transform(lambda d: d.withColumn("_at", at).withColumn("_late", holds.cast("int")))
    passed = passed.running(
        ["_at", "_late", "_asks", "_n", *order], _passed=Sum(holds.cast("long"))
    )
    name = F.concat(
        F.col("_stem"), F.lit(" ("), (F.col("_k") + 1 + F.col("_passed")).cast("string"),
        F.lit(")"), F.col("_ext"),
    )
    return passed.rows().filter(asks).withColumn("free_name", name).select(
        *requests.columns, "free_name"
    )


# --- remote files that share a name ------------------------------------------


def renamed_remote(
    remote: DataFrame, local: DataFrame, index: DataFrame, deleted: DataFrame, by: list[str],
    limit: int | None = None,
) -> DataFrame:
    """Remote files whose name an older one holds, with the name each gets.

    ``remote(by.., name, remote_id, digest, created)``; ``local(by.., name,
    digest)``; ``index(by.., name, remote_id, digest)``; ``deleted(by.., name)``.
    ``follows`` is the unchanged local file that was uploaded as the renamed one,
    and moves along with it.
    """
    syncable = remote.filter(is_syncable(F.col("name"))).select(*by, "name", "remote_id", "created")
    ranked = Keyed(syncable, [*by, "name"], limit).running(
        ["created", "remote_id"], _place=row_count()
    ).rows()
    taken = (
        local.filter(is_syncable(F.col("name"))).select(*by, "name")
        .unionByName(remote.select(*by, "name"))
        .unionByName(index.select(*by, "name"))
        .unionByName(deleted.select(*by, "name"))
    )
    # Read by several joins below, and few beside the files themselves.
    later = checkpoint(ranked.filter("_place > 1").drop("_place"))
    if later.isEmpty():
        none = F.lit(None).cast("string")
        return later.select(*by, "remote_id", "name", none.alias("goes_by"), none.alias("follows"))
    renamed = free_names(later, taken, by, ["created", "remote_id"], limit=limit)
    own = local.select(*by, F.col("name").alias("follows"), F.col("digest").alias("_now"))
    mine = index.select(
        *by, "remote_id", F.col("name").alias("follows"), F.col("digest").alias("_then")
    ).join(own, [*by, "follows"]).filter(F.col("_now") == F.col("_then"))
    mine = mine.groupBy(*by, "remote_id").agg(F.min("follows").alias("follows"))
    return checkpoint(
        renamed.join(mine, [*by, "remote_id"], "left").select(
            *by, "remote_id", "name", F.col("free_name").alias("goes_by"), "follows"
        )
    )


def dedupe_remote(
    remote: DataFrame, local: DataFrame, index: DataFrame, deleted: DataFrame, by: list[str],
    limit: int | None = None,
) -> DataFrame:
    """Remote files with the name each goes by: the oldest keeps it, later ones
    get one of their own (inputs as in ``renamed_remote``)."""
    return _named(remote, renamed_remote(remote, local, index, deleted, by, limit), by)


def _named(remote: DataFrame, renamed: DataFrame, by: list[str]) -> DataFrame:
    return remote.filter(is_syncable(F.col("name"))).join(
        renamed.select(*by, "remote_id", "goes_by", "follows"), [*by, "remote_id"], "left"
    ).withColumn("goes_by", F.coalesce("goes_by", "name"))


# --- the plan ----------------------------------------------------------------


def sync_plan(
    local: DataFrame, remote: DataFrame, index: DataFrame, deleted: DataFrame, by: list[str],
    policy: str = KEEP_BOTH, skip: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Actions that bring each folder into step, one row per action.

    Columns: ``by``, ``phase`` (0: names are sorted out, 1: files move), ``name``,
    ``action_no``, ``action``, ``target`` (new name), ``remote_id``, ``digest``.
    Inputs are those of ``renamed_remote``; ``skip(by.., name)`` are left alone.
    """
    moved = renamed_remote(remote, local, index, deleted, by, limit)
    any_moved = not moved.isEmpty()
    follow = moved.filter(F.col("follows").isNotNull()).select(
        *by, F.col("follows").alias("name"), F.col("goes_by").alias("_to")
    )

    def after_moves(side: DataFrame) -> DataFrame:
        if not any_moved:
            return side
        return side.join(follow, [*by, "name"], "left").withColumn(
            "name", F.coalesce("_to", "name")
        ).drop("_to")

    keys = [*by, "name"]
    here = after_moves(local.filter(is_syncable(F.col("name"))).select(*keys, "digest"))
    then = after_moves(index.select(*keys, "remote_id", "digest"))
    if any_moved:
        there = _named(remote, moved, by).select(*by, F.col("goes_by").alias("name"), "remote_id", "digest")
    else:
        there = remote.filter(is_syncable(F.col("name"))).select(*keys, "remote_id", "digest")

    # The four sides of a name meet in one aggregate: one shuffle, and no chain
    # of outer joins. After the renaming each side has a name once.
    def side(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*keys, *[v.alias(n) for n, v in values.items()])

    sides = (
        side(here, _l=F.col("digest"))
        .unionByName(side(there, _rid=F.col("remote_id"), _r=F.col("digest")), allowMissingColumns=True)
        .unionByName(side(then, _sid=F.col("remote_id"), _s=F.col("digest")), allowMissingColumns=True)
        .unionByName(side(deleted, _deleted=F.lit(True)), allowMissingColumns=True)
    )
    joined = sides.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("_l", "_rid", "_r", "_sid", "_s", "_deleted")]
    )
    if skip is not None:
        joined = joined.join(skip.select(*keys), keys, "left_anti")
    state = _decide(joined, policy)
    # Files set aside get names nobody has, after those given to remote files.
    asked = checkpoint(state.filter(F.col("case").isin("aside", "conflict")).select(*keys))
    taken = (
        local.filter(is_syncable(F.col("name"))).select(*keys).unionByName(remote.select(*keys))
        .unionByName(index.select(*keys)).unionByName(deleted.select(*keys))
        .unionByName(moved.select(*by, F.col("goes_by").alias("name")))
    )
    aside = free_names(asked, taken, by, [], limit=limit)
    actions = state.join(aside, keys, "left").select(
        *keys, F.lit(1).alias("phase"), F.posexplode(_actions(policy)).alias("action_no", "a")
    ).select(*by, "phase", "name", "action_no", "a.*")
    return _rename_steps(moved, by).unionByName(actions)


def _decide(joined: DataFrame, policy: str) -> DataFrame:
    """The case each name is, from what is here, there, and was at the last sync."""
    l, r = F.col("_l"), F.col("_r")
    has_l, has_r = l.isNotNull(), F.col("_rid").isNotNull()
    # A last sync with another remote file says nothing about this one.
    last = F.when(~has_r | (F.col("_sid") == F.col("_rid")), F.col("_s"))
    deleted = F.coalesce("_deleted", F.lit(False))
    same_as = lambda x: F.coalesce(x == last, F.lit(False))
    both = (
        F.when(l == r, F.when(same_as(l) & ~deleted, "none").otherwise("record"))
        .when(deleted, "aside")
        .when(same_as(l), "download")
        .when(same_as(r), "update")
        .otherwise("merge" if policy == MERGE else "conflict")
    )
    remote_only = (
        F.when(deleted, "none")
        .when(last.isNotNull() & F.lit(policy == KEEP_BOTH), "forget")
        .otherwise("download")
    )
    case = (
        F.when(has_l & has_r, both).when(has_l, "upload").when(has_r, remote_only).otherwise("prune")
    )
    return joined.withColumn("case", case).filter(F.col("case") != "none")


def _action(kind: str, target: Column | None = None, remote: bool = False, digest: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("action"),
        (target if target is not None else F.lit(None).cast("string")).alias("target"),
        (F.col("_rid") if remote else F.lit(None).cast("long")).alias("remote_id"),
        (digest if digest is not None else F.lit(None).cast("string")).alias("digest"),
    )


def _actions(policy: str) -> Column:
    case, to = F.col("case"), F.col("free_name")
    rename, upload = _action("rename_local", to), _action("upload", to)
    return (
        F.when(case == "record", F.array(_action("record", remote=True, digest=F.col("_l"))))
        .when(case == "aside", F.array(rename, upload))
        .when(case == "download", F.array(_action("download", remote=True)))
        .when(case == "update", F.array(_action("update", remote=True)))
        .when(case == "merge", F.array(_action("merge", remote=True)))
        .when(case == "conflict", F.array(rename, upload, _action("download", remote=True)))
        .when(case == "upload", F.array(_action("upload")))
        .when(case == "forget", F.array(_action("forget")))
        .otherwise(F.array(_action("prune")))
    )


def _rename_steps(moved: DataFrame, by: list[str]) -> DataFrame:
    nothing = F.lit(None).cast("string")

    def step(kind: str, on: Column, remote_id: Column) -> Column:
        return F.struct(
            on.alias("name"), F.lit(kind).alias("action"), F.col("goes_by").alias("target"),
            remote_id.alias("remote_id"), nothing.alias("digest"),
        )

    steps = F.array_compact(F.array(
        step("rename_remote", F.col("name"), F.col("remote_id")),
        F.when(
            F.col("follows").isNotNull(),
            step("rename_local", F.col("follows"), F.lit(None).cast("long")),
        ),
    ))
    return moved.select(
        *by, F.lit(0).alias("phase"), F.posexplode(steps).alias("action_no", "a")
    ).select(*by, "phase", "a.name", "action_no", "a.action", "a.target", "a.remote_id", "a.digest")


def sync_report(actions: DataFrame, by: list[str]) -> DataFrame:
    """What a run of the actions comes to."""
    kind = F.col("action")
    downloads = F.count_if(kind.isin("download", "merge"))
    renames = F.count_if(kind == "rename_local")
    return actions.groupBy(*by).agg(
        F.count_if(kind.isin("upload", "update", "merge")).alias("uploads"),
        downloads.alias("downloads"),
        renames.alias("renames"),
        ((downloads + renames) > 0).alias("changed_locally"),
    )
