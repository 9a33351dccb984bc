"""Places photos on tracks by the two fixes around their capture time.

A person may carry several recorders, so a photo can lie between fixes of many
segments at once, and the closest pair wins. Emitting every photo with every
pair around it grows with the number of overlapping recordings. Instead photos
are ranked by time per subject, each pair of neighbouring fixes becomes the
range of photo ranks it covers, and ranges are cut into aligned blocks of 1,
16, 256, ... ranks. A minimum per block (combined before it is shuffled) leaves
one pair per block, and each photo looks up the few blocks it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.functions.geo import between, between_known, distance_m, fraction
from trackplace.operators.ordered import Keyed, Last, Prev, Sum, row_count

# Ranks per block grow by this factor from level to level.
FANOUT_BITS = 4
TOP_LEVEL = 4


def locate(
    photos: DataFrame, fixes: DataFrame, tolerance_ms: int | Column = 1_800_000, limit: int | None = None
) -> DataFrame:
    """``photos(subject_id, photo_id, t_us, ...)`` with the position found for each.

    Adds ``placed`` (``interior``, ``end`` or null), ``lat``, ``lon``, ``ele``,
    ``gap_m`` (metres between the two fixes), ``fix_us``, ``track_id`` and
    ``segment_no``. A column as tolerance is one of ``photos``.
    """
    shots = photos.select("subject_id", "photo_id", "t_us")
    inside, fits = _inside(shots, fixes, limit)
    ends = _ends(shots, fixes, limit, fits)
    found = photos.join(inside, ["subject_id", "photo_id"], "left").join(
        ends, ["subject_id", "photo_id"], "left"
    )
    return _arbitrate(found, photos.columns, tolerance_ms)


def _arbitrate(found: DataFrame, kept: list[str], tolerance_ms: int | Column) -> DataFrame:
    """Between two fixes beats the end of a segment, which needs to be in reach."""
    t, a, b = F.col("t_us"), F.col("_pair.a"), F.col("_pair.b")
    f = fraction(a["t_us"], b["t_us"], t)
    reach = (tolerance_ms if isinstance(tolerance_ms, Column) else F.lit(tolerance_ms)) * 1000
    after, before = F.col("_start"), F.col("_end")
    after_us, before_us = after["fix"]["t_us"] - t, t - before["fix"]["t_us"]
    after_ok = F.coalesce(after_us <= reach, F.lit(False))
    before_ok = F.coalesce(before_us <= reach, F.lit(False))
    after_wins = (after_us < before_us) | ((after_us == before_us) & (after["at"] < before["at"]))
    end = (
        F.when(after_ok & (~before_ok | after_wins), after)
        .when(before_ok, before)
    )
    inside = F.col("_pair").isNotNull()
    values = {
        "placed": F.when(inside, "interior").when(F.col("_near").isNotNull(), "end"),
        "lat": F.when(inside, between(a["lat"], b["lat"], f)).otherwise(F.col("_near.fix.lat")),
        "lon": F.when(inside, between(a["lon"], b["lon"], f)).otherwise(F.col("_near.fix.lon")),
        "ele": F.when(inside, between_known(a["ele"], b["ele"], f)).otherwise(F.col("_near.fix.ele")),
        "gap_m": F.when(inside, distance_m(a["lat"], a["lon"], b["lat"], b["lon"])),
        "fix_us": F.when(inside & _takes_no_time(a, b), a["t_us"]).when(inside, t)
        .otherwise(F.col("_near.fix.t_us")),
        "track_id": F.coalesce("_pair.at.track_id", "_near.at.track_id"),
        "segment_no": F.coalesce("_pair.at.segment_no", "_near.at.segment_no"),
    }
    # Two fixes within the same millisecond: the earlier one stands as it is.
    values["ele"] = F.when(inside & _takes_no_time(a, b), a["ele"]).otherwise(values["ele"])
    return found.withColumn("_near", end).select(*kept, *[v.alias(n) for n, v in values.items()])


def _takes_no_time(a: Column, b: Column) -> Column:
    return b["t_us"] - a["t_us"] < 1000


def _inside(shots: DataFrame, fixes: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    """The shortest pair of neighbouring fixes around each photo that has one,
    and whether every subject's photos and fixes together fit a task."""
    none = F.lit(None)
    events = fixes.select(
        "subject_id", "track_id", "segment_no", "seq", "t_us", "lat", "lon", "ele",
        F.lit(1).alias("_kind"), none.cast("long").alias("photo_id"),
    ).unionByName(
        shots.select("subject_id", "t_us", "photo_id", F.lit(0).alias("_kind")),
        allowMissingColumns=True,
    )
    # Photos go before fixes of the same moment: a pair covers a < t <= b.
    order = ["t_us", "_kind", "track_id", "segment_no", "seq", "photo_id"]
    is_photo = F.when(F.col("_kind") == 0, 1).otherwise(0).cast("long")
    subjects = Keyed(events, ["subject_id"], limit)
    fits = subjects.long is None
    ranked = subjects.running(order, rank=Sum(is_photo))
    # Photos rank the same among themselves, without the fixes.
    photos = _keyed(shots, limit, fits).running(["t_us", "photo_id"], rank=row_count())
    photos = photos.totals(shots=F.count(F.lit(1))).rows()
    here = F.struct("t_us", "lat", "lon", "ele", "rank")
    pairs = (
        ranked.transform(lambda d: d.filter("_kind = 1"))
        .within(["track_id", "segment_no"])
        .running(["t_us", "seq"], a=Prev(here))
        .rows()
        # Most pairs have no photo between them and end here.
        .filter(F.col("rank") > F.col("a.rank"))
        .select(
            "subject_id",
            F.col("a.rank").alias("lo"), F.col("rank").alias("hi"),
            F.struct(
                (F.col("t_us") - F.col("a.t_us")).alias("span_us"),
                F.struct("track_id", "segment_no").alias("at"),
                F.col("a"), here.alias("b"),
            ).alias("pair"),
        )
    )
    blocks = (
        pairs.select("subject_id", "pair", F.explode(_blocks("lo", "hi")).alias("block"))
        .groupBy("subject_id", "block")
        .agg(F.min_by("pair", _closeness(F.col("pair"))).alias("pair"))
    )
    level = F.sequence(F.lit(0), F.least(F.lit(TOP_LEVEL), _level_of(F.col("shots"))))
    lookups = photos.select(
        "subject_id", "photo_id",
        F.explode(
            F.transform(
                level,
                lambda k: F.struct(
                    k.alias("level"),
                    F.floor((F.col("rank") - 1) / F.pow(F.lit(2.0), k * FANOUT_BITS))
                    .cast("long").alias("cell"),
                ),
            )
        ).alias("block"),
    )
    best = (
        lookups.join(blocks, ["subject_id", "block"])
        .groupBy("subject_id", "photo_id")
        .agg(F.min_by("pair", _closeness(F.col("pair"))).alias("_pair"))
    )
    return best, fits


def _keyed(df: DataFrame, limit: int | None, fits: bool) -> Keyed:
    """By subject; not counted again where larger groups were found to fit."""
    return Keyed.fitting(df, ["subject_id"]) if fits else Keyed(df, ["subject_id"], limit)


def _closeness(pair: Column) -> Column:
    return F.struct(pair["span_us"], pair["at"], pair["a"]["t_us"], pair["a"]["rank"])


def _level_of(count: Column) -> Column:
    """The highest level with a full block among that many ranks."""
    return F.floor((F.length(F.bin(F.greatest(count, F.lit(1)))) - 1) / FANOUT_BITS).cast("int")


def _blocks(lo: str, hi: str) -> Column:
    """Aligned blocks that make up the ranks from ``lo`` up to ``hi`` (0-based, open end)."""
    low, high = F.col(lo), F.col(hi)

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k * FANOUT_BITS).cast("long")
        up = F.pow(F.lit(2.0), (k + 1) * FANOUT_BITS).cast("long")
        first, last = F.ceil(low / size), F.floor(high / size)
        # Inside what the next level covers, nothing is left to this one.
        inner_first = F.ceil(low / up) * F.lit(1 << FANOUT_BITS)
        inner_last = F.floor(high / up) * F.lit(1 << FANOUT_BITS)
        covered = (k < TOP_LEVEL) & (inner_first < inner_last)
        cells = F.when(
            covered,
            F.concat(_range(first, inner_first), _range(inner_last, last)),
        ).otherwise(_range(first, last))
        return F.transform(cells, lambda c: F.struct(k.alias("level"), c.alias("cell")))

    levels = F.sequence(F.lit(0), F.least(F.lit(TOP_LEVEL), _level_of(high - low)))
    return F.flatten(F.transform(levels, at))


def _range(first: Column, end: Column) -> Column:
    """The whole numbers from ``first`` up to but without ``end``."""
    return F.when(first < end, F.sequence(first, end - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


def _ends(shots: DataFrame, fixes: DataFrame, limit: int | None, fits: bool) -> DataFrame:
    """The next segment start at or after each photo and the last segment end
    before it. No other end of a segment can be nearer."""
    fix = F.struct("t_us", "lat", "lon", "ele")
    place = F.struct("t_us", "seq")
    segments = fixes.groupBy("subject_id", "track_id", "segment_no").agg(
        F.min_by(fix, place).alias("s"), F.max_by(fix, place).alias("e")
    )
    at = F.struct("track_id", "segment_no")
    # Running backwards, a start of the same moment comes before the photo.
    both = segments.select("subject_id", at.alias("at"), F.explode(F.array(
        F.struct(F.lit(2).alias("_kind"), F.col("s").alias("fix")),
        F.struct(F.lit(3).alias("_kind"), F.col("e").alias("fix")))).alias("x"))
    # Of ends at the same moment the earlier segment counts.
    ends = both.groupBy("subject_id", F.col("x.fix.t_us").alias("t_us"), F.col("x._kind").alias("_kind")).agg(
        F.min_by(F.struct(F.col("x.fix").alias("fix"), "at"), "at").alias("end"))
    ends = ends.select("subject_id", "t_us", "_kind", *[
        F.when(F.col("_kind") == kind, F.col("end")).alias(name) for kind, name in ((2, "s"), (3, "e"))])
    events = shots.withColumn("_kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    order = ["t_us", "_kind", "photo_id"]
    return (
        _keyed(events, limit, fits)
        .running(order, descending=True, _start=Last(F.col("s")))
        .running(order, _end=Last(F.col("e")))
        .rows()
        .filter("_kind = 1")
        .select("subject_id", "photo_id", "_start", "_end")
    )
