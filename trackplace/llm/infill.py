"""Fill-in-the-middle: a track document cut in three, written so that the middle comes last.

A text is cut after units, runs of the letters A-Z in either case or any other
single code point. Its UTF-8 bytes are dealt into fixed blocks; a Fenwick tree
holds how many units and how many code points start in each. A cut walks down
the tree by powers of two to its block and is then found within that block
alone, so the two cuts of a text cost one pass over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.llm.words import track_documents

# The three marks, and the shares of a hundred for the two forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHOLE_SHARE = 10
SUFFIX_FIRST_SHARE = 20
SEED = "1"
BLOCK_BYTES = 4096


class FenwickTree:
    """Running sums of several counts per block: ``sums[:, i]`` covers the
    ``i & -i`` blocks that end with block ``i`` (counted from 1)."""

    def __init__(self, counts: np.ndarray):
        n = counts.shape[1]
        self.sums = np.zeros((counts.shape[0], n + 1), np.int64)
        self.sums[:, 1:] = counts
        step = 1
        while step < n:
            # Every second multiple of ``step`` takes up the sum half a stride before it.
            upper = np.arange(2 * step, n + 1, 2 * step)
            self.sums[:, upper] += self.sums[:, upper - step]
            step *= 2
        self._top = 1 << (n.bit_length() - 1) if n else 0

    def descend(self, rank: int) -> tuple[int, np.ndarray]:
        """The block in which the first count reaches more than ``rank``, and all
        counts before that block."""
        at, before, step = 0, np.zeros(len(self.sums), np.int64), self._top
        while step:
            if at + step < self.sums.shape[1] and before[0] + self.sums[0, at + step] <= rank:
                at += step
                before = before + self.sums[:, at]
            step >>= 1
        return at, before


class UnitIndex:
    """Where the units of a text begin."""

    def __init__(self, text: bytes, block: int = BLOCK_BYTES):
        data = np.frombuffer(text, np.uint8)
        self._block = block
        self._points = (data & 0xC0) != 0x80
        letters = ((data | 0x20) - np.uint8(ord("a"))) < 26
        self._units = self._points.copy()
        self._units[1:] &= ~(letters[1:] & letters[:-1])
        edges = np.arange(0, len(data), block)
        counts = [np.add.reduceat(marks, edges, dtype=np.int64) if len(data) else np.zeros(0, np.int64)
                  for marks in (self._units, self._points)]
        self.n_units, self.n_points = (int(c.sum()) for c in counts)
        self._tree = FenwickTree(np.array(counts))

    def cut(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if units >= self.n_units:
            return self.n_points
        block, (before, points) = self._tree.descend(units)
        part = slice(block * self._block, (block + 1) * self._block)
        start = np.flatnonzero(self._units[part])[units - before]
        return int(points + np.count_nonzero(self._points[part][:start]))


def _draws(key: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    tracks: DataFrame, seed: str = SEED, whole_share: int = WHOLE_SHARE,
    suffix_first_share: int = SUFFIX_FIRST_SHARE, block: int = BLOCK_BYTES,
) -> DataFrame:
    """Track documents rearranged so that a model learns to fill their middle.

    In: ``track_id, document``. Out, one row for each row in: ``track_id,
    n_units, form, prefix_chars, middle_chars, output``. The digest of ``seed``
    and ``track_id`` draws the two cuts, each after 0 to ``n_units`` units, and
    the form: ``plain`` for ``whole_share`` in a hundred (``output`` is the
    text), else ``spm`` (suffix, prefix, middle) for ``suffix_first_share`` in a
    hundred, else ``psm`` (prefix, suffix, middle), each part after its mark.
    A text that is null, empty or contains a mark is ``plain``; a null
    ``document`` is an empty one, a null ``track_id`` an empty key. Lengths are
    code points, null for ``plain``. Equal rows give equal rows; an empty table
    gives none. ``restored`` undoes it.
    """

    @F.pandas_udf("n_units long, low long, high long")
    def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, first, second, strict=True):
            index = UnitIndex(text, block)
            low, high = sorted((a % (index.n_units + 1), b % (index.n_units + 1)))
            rows.append((index.n_units, index.cut(low), index.cut(high)))
        return pd.DataFrame(rows, columns=["n_units", "low", "high"])

    text = F.coalesce("document", F.lit(""))
    first, second, third, fourth = _draws(F.col("track_id"), seed)
    rows = track_documents(tracks).select("track_id", text.alias("document"))
    # Filters must not go below the Python step, nor run it twice.
    rows = rows.withColumn("cuts", cuts.asNondeterministic()(F.col("document").cast("binary"), first, second))
    marked = F.col("document").contains(PREFIX) | F.col("document").contains(SUFFIX) | F.col("document").contains(MIDDLE)
    plain = (F.col("document") == "") | marked | (third % 100 >= 100 - whole_share)
    form = F.when(plain, "plain").when(fourth % 100 < suffix_first_share, "spm").otherwise("psm")
    rows = rows.select("track_id", "document", "cuts.*", form.alias("form"))
    prefix, middle, suffix = (F.substr("document", a, b) for a, b in (
        (F.lit(1), F.col("low").cast("int")),
        (F.col("low").cast("int") + 1, (F.col("high") - F.col("low")).cast("int")),
        (F.col("high").cast("int") + 1, F.lit(2**31 - 1))))
    output = F.when(F.col("form") == "plain", F.col("document")).when(
        F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select(
        "track_id", "n_units", "form", F.when(cut, F.col("low")).alias("prefix_chars"),
        F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an ``output`` was made of. No mark can begin inside another one,
    so the first of each is the one that was written."""
    psm = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{SUFFIX}|{MIDDLE}", 3)
    spm = F.split(F.substr(output, F.lit(len(SUFFIX) + 1)), f"{PREFIX}|{MIDDLE}", 3)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(
        form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
