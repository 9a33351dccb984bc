"""What the operators share: words, line splits and the frames they take.

Track documents are the project's texts: ``track_id`` (long), ``document`` (the
GPX or KML text a recorder wrote, or any other text) and ``source`` (the
recorder). Operators read the columns they name and no others, so further
columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six characters that part words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def track_documents(tracks: DataFrame, *more: str) -> DataFrame:
    """``track_id, document`` and the named columns, nothing else."""
    return tracks.select("track_id", "document", *more)


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ``SPACES``; null has none."""
    bare = trimmed(text)
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    bare = trimmed(text)
    parts = F.regexp_count(bare, F.lit(SPACE_CLASS + "+"))
    return F.when(bare == "", F.lit(0)).otherwise(parts + 1).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and no other letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def settled(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Selects ``keep`` and ``columns`` in a way that filters stay above.

    Catalyst moves a filter below the projection that makes its column and puts
    the expression in its place, also inside functions over arrays, where it is
    worked out again for every element. What a generator makes cannot be moved.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return rows.select(*keep, F.inline_outer(made))


def among(word: Column, listed: list[str]) -> Column:
    """Whether the word, A-Z in lower case, is listed. ``lower`` is the quicker
    test and lets through what it takes for equal; ``ascii_lower`` decides."""
    return F.lower(word).isin(listed) & ascii_lower(word).isin(listed)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def most_frequent(counts: DataFrame, rows: int) -> DataFrame:
    """The rows of the highest ``n``, ``rows`` of them at most, without sorting.

    Counts fall into classes of one sixteenth of a doubling; the classes that fit
    are taken whole, so equal counts stay or go together, and neither a task nor
    the driver gets more than what is returned. ``counts`` is read twice.
    """
    size = F.floor(F.log2(F.col("n").cast("double")) * 16)
    classes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, held = None, 0
    for size_of, n in sorted(map(tuple, classes), reverse=True):
        if held + n > rows:
            break
        least, held = size_of, held + n
    return counts.filter(F.lit(False) if least is None else size >= least)


def is_training(key: Column) -> Column:
    """Rows a model may learn from: crc32 of the key as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(True))
