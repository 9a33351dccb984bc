"""Ranked lexical search: item vocabulary tiles times document impact tiles.

Only terms of the items can score, so they alone are numbered. A tile of
documents becomes a dense matrix of impacts, documents by terms, and is
multiplied with the weights of the items by BLAS. All numbers are whole; a tile
of the vocabulary takes only as many terms as keep every sum below 2^53, so
float64 is exact, and tiles are added up as 64-bit integers.

Items come in blocks of bounded size, each searched against all documents; a
task passes on the best documents of its own for each item, ties settled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackplace.llm.words import track_documents
from trackplace.session import checkpoint

TOP = 20
# The whole numbers of the score.
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TERM_SCALE, LENGTH_SCALE = 1000, 12
LENGTH_BASE, LENGTH_SHARE = 75, 25
# In lower-cased UTF-8: digits, letters and every byte of a character beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
# An impact is below this, a sum of products below 2^53.
IMPACT_LIMIT = IMPACT_SCALE // TERM_SCALE
EXACT = 2**53
# Bounds of a block of items: what is broadcast, and what a task keeps per item.
BLOCK_ITEMS = 2048
BLOCK_TERMS = 100_000
TILE_DOCUMENTS = 1024
TILE_TERMS = 1024
_PIECE = 1 << 20
# Groups that the best of all tasks are brought together in first.
GROUPS = 64


def text_terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends where no term does."""
    data, start = (text or "").encode("utf-8", "surrogatepass"), 0
    while start < len(data):
        gap = _NO_TERM.search(data, start + _PIECE)
        end = gap.start() if gap else len(data)
        yield TERM.findall(data[start:end].lower())
        start = end


def weight(documents: int, holding: int) -> int:
    """Of a term that ``holding`` of all ``documents`` hold."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(terms: int, documents: int, all_terms: int) -> int:
    return LENGTH_BASE + (LENGTH_SHARE * terms * documents) // max(all_terms, 1)


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * counts) // (TERM_SCALE * counts + LENGTH_SCALE * norms)


class ItemTiles:
    """Weights of a block of items, cut into tiles of terms.

    ``items``, ``terms`` and ``values`` list the nonzero entries. ``exact`` is
    what a sum of products has to stay below.
    """

    def __init__(self, items, terms, values, n_items: int, tile: int = TILE_TERMS, exact: int = EXACT):
        self.n_items, self.tiles = n_items, []
        most = (exact - 1) // IMPACT_LIMIT  # the weights of an item within a tile
        rest = [(int(t), int(i), int(v)) for t, i, v in zip(terms, items, values, strict=True) if v]
        while rest:
            # A weight too large for any tile is spread over several.
            now = sorted((t, i, min(v, most)) for t, i, v in rest)
            rest = [(t, i, v - most) for t, i, v in rest if v > most]
            column, held, start = [], Counter(), 0
            for at, (t, i, v) in enumerate(now):
                new = at == 0 or now[at - 1][0] != t
                if new and column and (len(column) == tile or self._full(now, at, held, most)):
                    self._close(now[start:at], column)
                    column, held, start = [], Counter(), at
                if new:
                    column.append(t)
                held[i] += v
            self._close(now[start:], column)

    @staticmethod
    def _full(entries, at, held, most) -> bool:
        """Whether the term that begins at ``at`` no longer fits."""
        term = entries[at][0]
        while at < len(entries) and entries[at][0] == term:
            if held[entries[at][1]] + entries[at][2] > most:
                return True
            at += 1
        return False

    def _close(self, entries, column) -> None:
        place = {t: k for k, t in enumerate(column)}
        rows, cols, vals = zip(*[(place[t], i, v) for t, i, v in entries], strict=True)
        self.tiles.append((np.array(column), np.array(rows), np.array(cols), np.array(vals, np.float64)))

    def scores(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_rows: int, n_terms: int) -> np.ndarray:
        """Scores of a tile of documents, documents by items."""
        total = np.zeros((n_rows, self.n_items), np.int64)
        place = np.full(n_terms, -1)
        for column, r, c, v in self.tiles:
            place[:] = -1
            place[column] = np.arange(len(column))
            at = place[terms]
            mine = at >= 0
            left = np.zeros((n_rows, len(column)))
            left[rows[mine], at[mine]] = values[mine]
            right = np.zeros((len(column), self.n_items))
            right[r, c] = v
            total += (left @ right).astype(np.int64)
        return total


class Best:
    """For each item the ``top`` highest scores above 0, equal ones by ascending
    id, a missing id last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(n_items)]

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        least = self.least
        if len(scores) > self.top:
            # The top-th of this tile bounds it from below; whatever equals it may still win by its id.
            least = np.maximum(least, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        found = scores >= least
        for item in np.flatnonzero(found.any(0)):
            at = np.flatnonzero(found[:, item])
            s, m, k = (np.concatenate(x) for x in zip(
                self.rows[item], (scores[at, item], missing[at], ids[at]), strict=True))
            order = np.lexsort((k, m, -s))[:self.top]
            self.rows[item] = (s[order], m[order], k[order])
            if len(order) == self.top:
                self.least[item] = s[order[-1]]


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, n``: each distinct item and its terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, item_id, text in zip(batch["item"], batch["item_id"].astype("Int64"), batch["text"], strict=True):
                counts = Counter(t for piece in text_terms(text) for t in piece)
                yield pd.DataFrame({
                    "item": item, "item_id": pd.array([item_id] * len(counts), "Int64"),
                    "term": list(counts), "n": list(counts.values())})

    distinct = items.select("item_id", "text").distinct()
    # Two hashes name an item: repeated rows are one, other texts under its id are others.
    item = F.concat_ws(":", F.xxhash64("item_id", "text"), F.hash("text", "item_id"))
    return distinct.select(item.alias("item"), "item_id", "text").mapInPandas(
        run, "item string, item_id long, term binary, n long")


def _blocks(terms: DataFrame, block_items: int, block_terms: int) -> tuple[DataFrame, int]:
    """``terms`` with ``block``, such that a block has no more items and terms
    than allowed (or one item alone), and the number of blocks."""
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        one = sizes.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("terms"))
        over = (F.col("items") > 1) & ((F.col("items") > block_items) | (F.col("terms") > block_terms))
        if one.filter(over).isEmpty():
            return terms.withColumn("block", block), blocks
        blocks *= 2


def _search(tracks: DataFrame, entries: list, top: int) -> DataFrame:
    """``item, item_id, track_id, score``: the best documents of every task."""
    context = tracks.sparkSession.sparkContext
    items = sorted({(r["item"], r["item_id"]) for r in entries}, key=lambda x: x[0])
    number = {item: k for k, (item, _) in enumerate(items)}
    listed = sorted({bytes(r["term"]) for r in entries})
    vocabulary = context.broadcast({t: k for k, t in enumerate(listed)})
    n_terms = len(listed)

    def numbered(text: str | None, known: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
        """Terms in the text; numbers and counts of those in the vocabulary."""
        n, numbers = 0, []
        for piece in text_terms(text):
            n += len(piece)
            ids = np.fromiter(map(known.get, piece, repeat(-1)), np.int64, len(piece))
            numbers.append(ids[ids >= 0])
        return n, *np.unique(np.concatenate([np.zeros(0, np.int64), *numbers]), return_counts=True)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding, documents, terms = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for text in batch["document"]:
                n, found, _ = numbered(text, vocabulary.value)
                holding[found] += 1
                documents, terms = documents + (n > 0), terms + n
        some = np.flatnonzero(holding)
        yield pd.DataFrame({"term": [-2, -1, *some], "n": [terms, documents, *holding[some]]}, dtype="int64")

    texts = track_documents(tracks)
    counts = texts.select("document").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = dict(map(tuple, counts.collect()))
    all_terms, documents = counts.pop(-2, 0), counts.pop(-1, 0)
    place = {t: k for k, t in enumerate(listed)}
    terms = [place[bytes(r["term"])] for r in entries]
    values = [r["n"] * weight(documents, counts.get(t, 0)) for r, t in zip(entries, terms, strict=True)]
    tiles = context.broadcast(ItemTiles([number[r["item"]] for r in entries], terms, values, len(items)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, of_items, best = vocabulary.value, tiles.value, Best(len(items), top)
        for batch in batches:
            ids = batch["track_id"].astype("Int64")
            missing, ids = ids.isna().to_numpy(), ids.fillna(0).to_numpy(np.int64)
            for at in range(0, len(batch), TILE_DOCUMENTS):
                part = slice(at, at + TILE_DOCUMENTS)
                found = [numbered(t, known) for t in batch["document"][part]]
                sizes = [len(f[1]) for f in found]
                rows = np.repeat(np.arange(len(found)), sizes)
                norms = np.array([length_norm(f[0], documents, all_terms) for f in found], np.int64)
                values = impacts(np.concatenate([f[2] for f in found]), norms[rows])
                scores = of_items.scores(rows, np.concatenate([f[1] for f in found]), values, len(found), n_terms)
                best.add(scores, ids[part], missing[part])
        for k, (scores, missing, ids) in enumerate(best.rows):
            if len(scores):
                yield pd.DataFrame({
                    "item": items[k][0], "item_id": pd.array([items[k][1]] * len(scores), "Int64"),
                    "track_id": pd.arrays.IntegerArray(ids, missing), "score": scores})

    return texts.mapInPandas(score, "item string, item_id long, track_id long, score long")


def search_tracks(
    tracks: DataFrame, items: DataFrame, top: int = TOP,
    block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``top`` track documents for each item, by the terms they share.

    In: ``track_id, document`` and ``item_id, text``. Out: ``item_id, rank,
    track_id, score``, ranks from 1, the highest score first, equal scores by
    ascending ``track_id`` (null last); only scores above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower
    case. Every row of ``tracks`` is a document of its own and is searched
    whole; null and empty documents have no terms and count nowhere. Items that
    repeat with id and text are one item; several texts under one id are ranked
    each by itself. An item without terms, or an empty table on either side,
    gives no rows.

    Items are dealt into blocks of at most ``block_items`` items and
    ``block_terms`` of their distinct terms (or one item), and each block reads
    the documents twice: once for counts, once for scores.
    """
    terms, blocks = _blocks(checkpoint(_item_terms(items)), block_items, block_terms)
    parts = []
    for block in range(blocks):
        entries = terms.filter(F.col("block") == block).collect()
        if entries:
            parts.append(_search(tracks, entries, top))
    if not parts:
        return tracks.sparkSession.createDataFrame([], "item_id long, rank int, track_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("track_id")]
    found = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for keys in (["item", "group"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
            F.col("rank") <= top)
    return found.select("item_id", "rank", "track_id", "score")
