"""Quality rules: one projection of counts and ratios against a table of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.llm.words import among, lines, settled, track_documents, trimmed, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent short words of four languages.
STOP_WORDS = (
    "the of and to in is that for with on be by this as are was it an or from"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als"
    " de la le et les des en un du une que est pour qui dans a par plus pas au"
    " el los y del se las por con para su al lo como o si sobre este"
).split()
# Ratio, least, most, and words from which it counts. A ratio outside its row's
# bounds rejects the document; a few words may do without a stop word.
THRESHOLDS = [
    ("mean_word_chars", 2.0, 16.0, 1),
    ("symbol_ratio", None, 0.1, 1),
    ("shout_ratio", None, 0.2, 1),
    ("upper_ratio", None, 0.6, 1),
    ("dup_line_ratio", None, 0.4, 1),
    ("stop_ratio", 0.02, None, 30),
]
Threshold = tuple[str, float | None, float | None, int]
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "shout_ratio": ("n_shouts", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_ratio": ("n_stop_words", "n_words"),
}


def measures(tracks: DataFrame) -> DataFrame:
    """``track_id`` and the counts rules are made of, per track document.

    Null and empty documents count zero everywhere. Windows of five words are
    compared by 64-bit hash within one document; a row is never exploded, so a
    very long document stays one row of arrays.
    """
    text = F.coalesce("document", F.lit(""))
    rows = track_documents(tracks).select("track_id", text.alias("_text"))
    rows = rows.withColumn("_w", words(F.col("_text")))
    full = F.filter(lines(F.col("_text")), lambda x: trimmed(x) != "")
    counted = rows.select(
        "track_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda x: among(x, STOP_WORDS))).cast("long").alias("n_stop_words"),
        full.alias("_full"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    at = lambda i: [F.get("_h", i + k) for k in range(WINDOW)]
    none = F.array().cast("array<bigint>")
    counted = counted.withColumn("_windows", F.when(
        F.size("_h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*at(i))),
    ).otherwise(none))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    places = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    counted = counted.withColumn("_p", F.when(repeats, places).otherwise(F.slice(places, 1, 0)))
    twin = lambda x, i: (
        F.coalesce(F.get("_p", i + 1)["x"] == x["x"], F.lit(False))
        | ((i > 0) & F.coalesce(F.get("_p", i - 1)["x"] == x["x"], F.lit(False)))
    )
    counted = counted.withColumn(
        "_starts", F.array_sort(F.transform(F.filter("_p", twin), lambda x: x["i"])))
    # A start covers its window or what is left of it up to the next start.
    covered = F.transform(
        "_starts", lambda s, i: F.least(F.coalesce(F.get("_starts", i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    counts = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_upper", "n_stop_words")
    return settled(
        counted, "track_id", **{c: F.col(c) for c in counts}, n_lines=F.size("_full").cast("long"),
        n_dup_lines=(F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        n_repeat_words=F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
    )


def verdict(thresholds: list[Threshold] = THRESHOLDS) -> Column:
    """The table as one condition. A ratio without a denominator breaks no rule."""
    fine = F.lit(True)
    for name, least, most, from_words in thresholds:
        top, bottom = RATIOS[name]
        short = F.col("n_words") < from_words
        ratio = F.col(top).cast("double") / F.nullif(F.col(bottom), F.lit(0)).cast("double")
        if least is not None:
            fine = fine & (short | F.coalesce(ratio >= least, F.lit(True)))
        if most is not None:
            fine = fine & (short | F.coalesce(ratio <= most, F.lit(True)))
    return fine


def judge_tracks(
    tracks: DataFrame, thresholds: list[Threshold] = THRESHOLDS, least_words: int = 10,
    repeated_percent: int = 20,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each track document.

    In: ``track_id, document``. ``base_failed``: fewer than ``least_words``
    words, or over ``repeated_percent`` per cent of them in repeated windows;
    ``kept`` also asks for every row of ``thresholds``. One row out for each row
    in, repeated or not; a null or empty document fails; an empty table gives none.
    """
    counted = measures(tracks)
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & verdict(thresholds))
