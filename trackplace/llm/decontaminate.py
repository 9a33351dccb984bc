"""Benchmark decontamination by spaced seeds.

A seed is a mask over up to nine tokens of which five count. Test items and
documents meet where a mask sees the same tokens in both, so a substituted
token under a gap of the mask does no harm. Around each hit the two texts are
laid side by side, and tokens are compared one by one. Items too short for the
masks meet documents as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.session import checkpoint

# Positions each form looks at, wherever it fits. Of 11 to 15 tokens
# of which four in five are equal, one form at least sees equal ones only.
FORMS = [(0, 1, 3, 4, 5), (0, 1, 5, 7, 8)]
# Tokens of the shortest item that may differ from what a document has.
SPAN = 11
# The forms at all their places within so many tokens.
MASKS = [tuple(at + p for p in form) for form in FORMS for at in range(SPAN - form[-1])]
WINDOW = 15
SIMILARITY = 0.8
# Seeds of all test items, or candidates, that are sent to every task at most.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits; null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.xxhash64(t))


def _seeds(rows: DataFrame, keys: list[str], short: list[int], whole: bool = False) -> DataFrame:
    """``keys, gram, at``: what each form sees at each position of ``_h``, and
    what windows of each of the lengths ``short`` hold; with ``whole`` only the
    window that is all of ``_h``.

    The outer form of the generator keeps Catalyst from testing the arrays for
    length below the projection that makes them, which would make them anew for
    every element.
    """
    size = F.size("_h")
    none = F.array().cast("array<struct<at:int,gram:bigint>>")

    def seen(k: int, mask, fits: Column) -> Column:
        return F.when(fits, F.transform(F.sequence(F.lit(0), size - (mask[-1] + 1)), lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.lit(k), *[F.get("_h", i + p) for p in mask]).alias("gram")))).otherwise(none)

    grams = [seen(k, mask, size >= SPAN) for k, mask in enumerate(FORMS)]
    grams += [seen(-n, range(n), size == n if whole else size >= n) for n in short]
    rows = rows.select(*keys, F.inline_outer(F.concat(*grams)))
    return rows.filter(F.col("gram").isNotNull()).select(*keys, "gram", "at")


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Sent to every task if its counted rows allow it, else left to a shuffle."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def contaminated(
    tracks: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, least_tokens: int = 1,
) -> DataFrame:
    """Overlaps of track documents with test items.

    In: ``tracks`` (``track_id, document``) and ``benchmark`` (``item_id, text``).
    Out, one row per pair of ids: ``track_id, item_id, start`` (token of the
    document at which the texts overlap), ``overlap`` (tokens laid side by side)
    and ``same`` (equal ones), for the best alignment. A pair counts if a seed
    hits and, on its alignment, ``window`` tokens in a row (the whole item, if
    it is shorter) have ``similarity`` of them equal. With the given window and
    similarity no such pair is without a seed. Items of fewer than eleven tokens
    count only where all their tokens stand in a row, and items of fewer than
    ``least_tokens`` not at all (a word alone says little); null and empty
    texts match nothing; repeated rows count once, a null id is an id of its
    own; an empty table gives none. Every token of every document is looked at.
    """
    docs = tracks.select("track_id", "document", F.xxhash64("document").alias("digest"))
    items = checkpoint(benchmark.select(
        "item_id", F.xxhash64("text").alias("item_digest"), tokens(F.col("text")).alias("_h")).distinct().filter(
            F.size("_h") >= least_tokens))
    few = items.select(F.size("_h").alias("n")).filter(F.col("n").between(1, SPAN - 1)).distinct()
    short = sorted(r.n for r in few.collect())
    seeds = checkpoint(_seeds(items, ["item_id", "item_digest"], short, whole=True).withColumnRenamed("at", "item_at"))
    found = _seeds(docs.select("track_id", "digest", tokens(F.col("document")).alias("_h")), ["track_id", "digest"], short)
    hits = found.join(_small(seeds, seeds.count()), "gram").select(
        "track_id", "digest", "item_id", "item_digest", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = checkpoint(hits.distinct().groupBy("track_id", "digest", "item_id", "item_digest").agg(
        F.collect_set("shift").alias("shifts")))
    hits = hits.select(F.col("track_id").alias("_id"), F.col("digest").alias("_digest"), "item_id", "item_digest", "shifts")
    n = hits.count()
    pairs = docs.join(
        _small(hits, n), F.col("track_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    pairs = pairs.select("track_id", "item_id", "item_digest", "shifts", "document")
    item = items.select(F.col("item_id").alias("_item"), F.col("item_digest").alias("_item_digest"), F.col("_h").alias("_t"))
    pairs = pairs.join(item, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_digest") == F.col("_item_digest")))
    pairs = pairs.select("track_id", "item_id", "_t", "shifts", tokens(F.col("document")).alias("_h"))
    laid = pairs.select("track_id", "item_id", "_t", "_h", F.explode("shifts").alias("shift"))
    first = F.greatest("shift", F.lit(0))
    last = F.least(F.size("_h"), F.col("shift") + F.size("_t"))
    laid = laid.select(
        "track_id", "item_id", "shift", first.alias("start"),
        F.least(F.lit(window), F.size("_t")).alias("_least"),
        F.transform(F.sequence(first, last - 1), lambda i: F.when(
            F.get("_h", i) == F.get("_t", i - F.col("shift")), 1).otherwise(0)).alias("_same"))
    add = lambda a, x: a + x
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("_same") - F.col("_least") + 1),
        lambda s: F.aggregate(F.slice("_same", s, F.col("_least")), F.lit(0), add)))
    # Judged below the aggregate and chosen above it: a filter here would be
    # pushed into the expressions and work them out again for every window.
    fits = (F.size("_same") >= F.col("_least")) & (best >= F.ceil(similarity * F.col("_least") - 1e-9))
    top = F.max(F.struct(
        fits.alias("fits"), F.aggregate("_same", F.lit(0), add).alias("same"),
        (-F.col("start")).alias("before"), F.size("_same").alias("overlap")))
    return laid.groupBy("track_id", "item_id").agg(top.alias("t")).filter("t.fits").select(
        "track_id", "item_id", (-F.col("t.before")).cast("long").alias("start"),
        F.col("t.overlap").cast("long").alias("overlap"), F.col("t.same").cast("long").alias("same"))


def clean_tracks(tracks: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``tracks`` whose id overlaps with no test item, all columns kept."""
    bad = contaminated(tracks, benchmark, **options).select(F.col("track_id").alias("_bad")).distinct()
    return tracks.join(bad, F.col("track_id").eqNullSafe(F.col("_bad")), "left_anti")
