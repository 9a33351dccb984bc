"""Line dedup by spread over sites: HyperLogLog sketches first, exact counts where they are close.

Recorders put the same notices into the documents they write. A line whose
sketch says that clearly more sources than the threshold carry it is
boilerplate, one clearly below is not, and lines in between are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.llm.words import lines, trimmed, words
from trackplace.session import checkpoint

LEAST_SOURCES = 3
LEAST_WORDS = 1
LOG_REGISTERS = 10
# Lines sent to every task at most, and tasks that share a line beyond that.
BROADCAST_LINES = 200_000
SALTS = 32


def _line_key(line: Column) -> list[Column]:
    """96 bits of the line without spaces at its ends."""
    bare = trimmed(line)
    return [F.xxhash64(bare).alias("h1"), F.hash(bare).alias("h2")]


def occurrences(tracks: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``track_id, digest, source, at, h1, h2``: every line of ``least_words`` words or more."""
    rows = tracks.select(
        "track_id", F.xxhash64("document").alias("digest"), F.coalesce("source", F.lit("\x00")).alias("source"),
        F.posexplode_outer(lines(F.col("document"))).alias("at", "line"))
    return rows.filter(F.size(words(F.col("line"))) >= least_words).select(
        "track_id", "digest", "source", "at", *_line_key(F.col("line")))


def repeated(found: DataFrame, least_sources: int = LEAST_SOURCES) -> DataFrame:
    """The occurrences of lines that occur ``least_sources`` times or more. No
    other line can have that many sources, and most lines occur once, so only
    the rest is worth a sketch."""
    often = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_sources)
    return checkpoint(_carrying(found, checkpoint(often.select("h1", "h2"))))


def spread_lines(found: DataFrame, least_sources: int = LEAST_SOURCES, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """``h1, h2, first``: lines that ``least_sources`` sources or more carry, and
    the place that keeps them (least id, null last, then digest and line number)."""
    place = F.struct(
        F.col("track_id").isNull().alias("none"), F.col("track_id"), F.col("digest"), F.col("at"))
    sketched = checkpoint(found.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("source", F.lit(log_registers)).alias("sketch"), F.min(place).alias("first"),
    ).withColumn("sources", F.hll_sketch_estimate("sketch")).drop("sketch").filter(F.col("sources") >= 2))
    # Four standard errors of the sketch at the threshold, a source at least.
    margin = max(1.0, 4 * 1.04 / 2 ** (log_registers / 2) * least_sources)
    wide = sketched.filter(F.col("sources") > least_sources + margin)
    close = sketched.filter(F.col("sources").between(least_sources - margin, least_sources + margin))
    # A line that one source repeats without end is one row here.
    exact = found.select("h1", "h2", "source").distinct().join(close.select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = exact.groupBy("h1", "h2").agg(F.countDistinct("source").alias("n")).filter(F.col("n") >= least_sources)
    return wide.select("h1", "h2", "first").unionByName(
        close.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def _carrying(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Occurrences of the lines listed, with what is listed about them. The list
    goes to every task while it is counted to be short; else a line's occurrences
    are dealt to ``SALTS`` tasks."""
    if listed.count() <= BROADCAST_LINES:
        return found.join(F.broadcast(listed), ["h1", "h2"])
    salted = found.withColumn("salt", F.pmod(F.xxhash64("track_id", "at"), F.lit(SALTS)))
    copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["h1", "h2", "salt"]).drop("salt")


def _without(all_lines: Column, removed: Column) -> Column:
    """The lines at places not in ``removed`` (sorted): the stretches between them."""
    begin = F.concat(F.array(F.lit(-1)), removed)
    end = F.concat(removed, F.array(F.size(all_lines)))
    return F.flatten(F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda x: F.slice(
        all_lines, x["b"] + 2, x["e"] - x["b"] - 1)))


def dedup_lines(
    tracks: DataFrame, least_sources: int = LEAST_SOURCES, least_words: int = LEAST_WORDS,
    log_registers: int = LOG_REGISTERS,
) -> DataFrame:
    """Track documents without the boilerplate lines that others keep.

    In: ``track_id, document, source``; all other columns stay as they are. Out,
    one row for each row in, with ``document`` shortened and two columns more,
    ``n_lines`` and ``n_removed``. A line of ``least_words`` words or more that
    stands in documents of ``least_sources`` sources stays at one place, in the
    document of least id, and goes everywhere else; other lines stay, in order.
    Null is a source of its own. A null document stays null, an empty one empty;
    a document may lose all its lines and become empty; rows repeated with the
    same id and text are treated alike; an empty table gives none.
    """
    found = repeated(checkpoint(occurrences(tracks, least_words)), least_sources)
    spread = checkpoint(spread_lines(found, least_sources, log_registers))
    gone = _carrying(found, spread).filter(~(
        F.col("track_id").eqNullSafe(F.col("first.track_id")) & (F.col("digest") == F.col("first.digest"))
        & (F.col("at") == F.col("first.at"))))
    gone = gone.groupBy(F.col("track_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.array_sort(F.collect_set("at")).alias("_removed"))
    joined = tracks.withColumn("_d", F.xxhash64("document")).join(
        gone, F.col("track_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")), "left")
    all_lines = F.split("document", "\n")
    kept = F.when(F.col("_removed").isNull(), F.col("document")).otherwise(
        F.array_join(_without(all_lines, F.col("_removed")), "\n"))
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(all_lines), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("_removed"), F.lit(0)).cast("long"), "document": kept,
    }).drop("_id", "_digest", "_removed", "_d")
