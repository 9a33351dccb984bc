"""Segments, lengths, listings and bounds of recorded tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.functions.geo import distance_m
from trackplace.operators.ordered import Keyed, Prev, Sum, row_count

SEGMENT = ["track_id", "segment_no"]


def by_segment(fixes: DataFrame, limit: int | None = None) -> Keyed:
    """Fixes keyed by segment, counted by track: a track that fits a task has
    segments that do, and a count by track needs no segment numbers, so Catalyst
    leaves out of it what made them."""
    return Keyed(fixes, ["track_id"], limit).within(["segment_no"])


def assign_segments(
    feed: DataFrame,
    keys: list[str],
    order: list[str],
    break_after_us: int | None = None,
    starts: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Numbers the fixes of a feed and the segments they were recorded in.

    A segment starts where ``starts`` says so (a resumed recording, a reused
    name), or after a silence longer than ``break_after_us``.
    """
    keyed = Keyed(feed, keys, limit)
    breaks = starts.cast("long") if starts is not None else F.lit(0).cast("long")
    if break_after_us is not None:
        keyed = keyed.running(order, _before=Prev(F.col(order[0])))
        silent = F.col(order[0]) - F.col("_before") > break_after_us
        breaks = F.greatest(breaks, F.coalesce(silent, F.lit(False)).cast("long"))
    return keyed.running(order, segment_no=Sum(breaks), seq=row_count()).rows().drop("_before")


def numbered_segments(merged: DataFrame, into: list[str], limit: int | None = None) -> DataFrame:
    """``merge_tracks`` with ``segment_no`` counted from 0 over all segments of a
    key of ``into``, in order of part, track and segment."""
    keys = ["part", "track_id", "segment_no"]
    segments = merged.select(*into, *keys).distinct()
    ranked = Keyed(segments, into, limit).running(keys, _no=row_count()).rows()
    joined = merged.join(ranked, [*into, *keys])
    return joined.withColumn("segment_no", F.col("_no") - 1).drop("_no")


def merge_tracks(*tracks: DataFrame) -> DataFrame:
    """All segments of several tables; a table's number goes into its segment keys."""
    merged = None
    for part, fixes in enumerate(tracks):
        tagged = fixes.withColumn("part", F.lit(part))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def as_one_segment(fixes: DataFrame, limit: int | None = None) -> DataFrame:
    """Bridges the gaps of each track on purpose: one segment, numbered anew by time."""
    ordered = Keyed(fixes, ["track_id"], limit).running(["t_us", "segment_no", "seq"], _seq=row_count())
    return ordered.rows().withColumn("segment_no", F.lit(0).cast("long")).withColumn(
        "seq", F.col("_seq")
    ).drop("_seq")


def steps(fixes: DataFrame, limit: int | None = None) -> DataFrame:
    """Each fix with the one before it in its segment and the metres between them."""
    before = F.struct("t_us", "lat", "lon")
    out = by_segment(fixes, limit).running(["t_us", "seq"], before=Prev(before)).rows()
    return out.withColumn(
        "step_m",
        distance_m(F.col("before.lat"), F.col("before.lon"), F.col("lat"), F.col("lon")),
    )


def track_stats(fixes: DataFrame) -> DataFrame:
    """Fixes, segments and time span of each track."""
    # Segments are counted from their own partial aggregates, not by shipping
    # every fix of a track to the task that counts.
    segments = fixes.groupBy("track_id", "segment_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("b")
    )
    return segments.groupBy("track_id").agg(
        F.sum("n").alias("fixes"),
        F.count(F.lit(1)).alias("segments"),
        F.min("a").alias("start_us"),
        F.max("b").alias("end_us"),
        (F.max("b") - F.min("a")).alias("duration_us"),
    )


def tracks_newest_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc_nulls_last("end_us"), "track_id")


def track_listing(tracks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Every known track with its statistics, newest first; those without timed
    fixes say so."""
    listed = tracks.join(track_stats(fixes), "track_id", "left")
    return tracks_newest_first(
        listed.withColumn("fixes", F.coalesce("fixes", F.lit(0).cast("long")))
        .withColumn("timed", F.col("start_us").isNotNull())
    )


def track_distance(fixes: DataFrame, limit: int | None = None) -> DataFrame:
    """Metres run inside segments; nothing is added across their gaps."""
    return (
        steps(fixes, limit)
        .groupBy("track_id")
        .agg(F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("metres"))
    )


def bounds(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around the fixes of each key, and whether it is too small to zoom to."""
    box = fixes.groupBy(*keys).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
    )
    return box.withColumn(
        "degenerate",
        (F.col("north") - F.col("south") < 1e-6) & (F.col("east") - F.col("west") < 1e-6),
    )


def recorded_elapsed(runs: DataFrame) -> DataFrame:
    """Time recorded, without pauses.

    ``runs`` has one row per recording and event: ``recording_id``, ``event``
    (start, pause, resume, now) and ``at_us``. An open pause ends the count.
    """
    signed = (
        F.when(F.col("event").isin("start", "resume"), -F.col("at_us"))
        .when(F.col("event").isin("pause"), F.col("at_us"))
    )
    is_now = F.col("event") == "now"
    sums = runs.groupBy("recording_id").agg(
        F.sum(signed).alias("s"),
        F.count_if(F.col("event").isin("start", "resume")).alias("opened"),
        F.count_if(F.col("event") == "pause").alias("closed"),
        F.max(F.when(is_now, F.col("at_us"))).alias("now_us"),
    )
    running = F.when(F.col("opened") > F.col("closed"), F.col("now_us")).otherwise(F.lit(0))
    return sums.select("recording_id", (F.col("s") + running).alias("recorded_us"))
