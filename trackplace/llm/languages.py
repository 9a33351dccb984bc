"""Language identification by prediction by partial matching.

Each language has a byte context tree of order three: a symbol is coded in the
longest context that has seen it, after an escape from each longer context
(method C: the escape has the weight of the distinct symbols seen). Trees are
frozen after training, so the code length of a text is a sum over its bytes of
values that depend on four bytes each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackplace.llm.words import is_training, track_documents

UNKNOWN = "und"
ORDER = 3
# Symbols: the most frequent bytes of the training texts; all other bytes share
# the last one, at the cost of naming the byte.
SYMBOLS = 64
BITS = 6
DOCS_PER_LANGUAGE = 400
# Bytes coded and documents read at a time, and what stands before a text.
PIECE = 1 << 18
DOCS_AT_ONCE = 512
PAD = b" " * ORDER
_GAP = re.compile(r"[\W\d_]+")


def plain_bytes(text: str | None) -> bytes:
    """Lower case, one space for whatever is no letter, a space at either end."""
    return (" " + _GAP.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _escape_bits(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Cost of leaving a context; one that was never seen is left for nothing."""
    return np.log2(np.where(total > 0, total + kinds, 1) / np.where(total > 0, kinds, 1))


class Trees:
    """Code lengths in bits under the frozen trees, for all languages at once.

    ``seen`` holds the codes of order three that occur in training with a row
    of lengths; other codes cost the escape from their context plus the code of
    order two, which is a dense table.
    """

    def __init__(self, symbol_of: np.ndarray, languages: list[str], counts: list[dict[int, int]]):
        self.symbol_of, self.languages = symbol_of, languages
        n, rest = SYMBOLS, max(1, 256 - (SYMBOLS - 1))
        uniform = np.full(n, np.log2(n))
        uniform[n - 1] += np.log2(rest)
        lower = np.empty((n**3, len(languages)))
        escape = np.empty((n**3, len(languages)))
        known = np.unique(np.concatenate([np.fromiter(c, np.int64, len(c)) for c in counts] or [[]])).astype(np.int64)
        exact = np.empty((len(known), len(languages)))
        for at, table in enumerate(counts):
            full = np.zeros(len(known))
            keys = np.fromiter(table, np.int64, len(table))
            full[np.searchsorted(known, keys)] = np.fromiter(table.values(), float, len(table))
            cost = uniform
            for order in range(ORDER):
                sums = np.bincount(known & (n ** (order + 1) - 1), full, n ** (order + 1)).reshape(-1, n)
                total, kinds = sums.sum(1), (sums > 0).sum(1)
                out = _escape_bits(total, kinds)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = np.log2((total + kinds)[:, None] / sums)
                below = np.tile(cost, n).reshape(-1, n) if order else cost[None, :]
                cost = np.where(sums > 0, own, out[:, None] + below).ravel()
            lower[:, at] = cost
            contexts = known >> BITS
            total = np.bincount(contexts, full, n**3)
            kinds = np.bincount(contexts, full > 0, n**3)
            out = _escape_bits(total, kinds)
            escape[:, at] = out
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log2((total + kinds)[contexts] / full)
            exact[:, at] = np.where(full > 0, own, out[contexts] + cost[known & (n**3 - 1)])
        self._lower, self._escape = list(lower.T.copy()), list(escape.T.copy())
        # A last row for codes that row_of does not know.
        self._exact = [np.append(column, 0.0) for column in exact.T]
        self._row_of = np.full(n ** (ORDER + 1), -1, np.int32)
        self._row_of[known] = np.arange(len(known), dtype=np.int32)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        result = np.zeros((len(texts), len(self.languages)))
        owners, parts, held = [], [], 0
        for i, text in enumerate(texts):
            # Pieces with their context before them: a very long text takes no
            # more memory than many short ones.
            padded = PAD + text
            for start in range(ORDER, max(len(padded), ORDER + 1), PIECE):
                owners.append(i)
                parts.append(padded[start - ORDER:start + PIECE])
                held += len(parts[-1])
                if held >= PIECE:
                    self._add(result, owners, parts)
                    owners, parts, held = [], [], 0
        if parts:
            self._add(result, owners, parts)
        return result

    def _add(self, result: np.ndarray, owners: list[int], parts: list[bytes]) -> None:
        # Codes have 24 bits.
        s = self.symbol_of.astype(np.int32)[np.frombuffer(b"".join(parts), np.uint8)]
        code = np.zeros(len(s) - ORDER, np.int32)
        for k in range(ORDER + 1):
            code = (code << BITS) | s[k:len(s) - ORDER + k]
        sizes = np.array([len(p) for p in parts])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        own = np.ones(len(s), bool)
        for k in range(ORDER):
            own[np.minimum(first + k, len(s) - 1)] = False
        code = code[own[ORDER:]]
        count = np.maximum(sizes - ORDER, 0)
        row = self._row_of[code]
        new = np.flatnonzero(row < 0)
        spare = code[new]
        part_of = np.repeat(np.arange(len(parts)), count)
        for at in range(len(self.languages)):
            bits = self._exact[at][row]
            if len(new):
                bits[new] = self._escape[at][spare >> BITS] + self._lower[at][spare & (SYMBOLS**3 - 1)]
            np.add.at(result[:, at], owners, np.bincount(part_of, bits, len(parts)))


@cache
def _ready() -> dict:
    return {}


def trees_of(stamp: str, shared) -> Trees:
    """The trees of a broadcast model, built once per worker process. Workers
    outlive a model, so ``stamp`` is a name that no two models share."""
    kept = _ready()
    if kept.get("stamp") != stamp:
        kept.update(stamp=stamp, trees=Trees(*shared.value))
    return kept["trees"]


def training_counts(tracks: DataFrame, docs: int = DOCS_PER_LANGUAGE) -> tuple[np.ndarray, list[str], list[dict]]:
    """Alphabet, languages and counts of codes of order three, from at most
    ``docs`` whole documents per language (those of smallest id digest, among
    rows training may see: crc32 of the id modulo 3 is not 1)."""
    spark = tracks.sparkSession
    known = tracks.filter(F.col("lang").isNotNull() & is_training(F.col("track_id")) & F.col("document").isNotNull())
    # Only ids whose digest is small for the size of their language are ranked, so
    # that no task ranks a whole language; twice the number wanted is expected. The
    # sizes are a row per language, and the driver holds a tree of each anyway.
    sizes = known.groupBy(F.col("lang").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    unit = F.xxhash64("track_id").bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))
    early = known.select("track_id", "lang").join(F.broadcast(sizes), F.col("lang") == F.col("_of")).filter(
        unit * F.col("_size") <= 2 * docs + 100)
    order = Window.partitionBy("lang").orderBy(unit, "track_id")
    chosen = early.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= docs).select("track_id", F.col("lang").alias("_lang"))
    ids = sorted({(r[0], r[1]) for r in chosen.filter(F.col("track_id").isNotNull()).collect()})
    if not ids:
        return np.zeros(256, np.int64), [], []
    ids = F.broadcast(spark.createDataFrame(ids, "track_id long, _lang string"))
    sample = known.select("track_id", "document", "lang").join(ids, "track_id").filter(F.col("lang") == F.col("_lang"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for text in map(plain_bytes, part["document"]):
                    data = np.frombuffer(PAD + text, np.uint8).astype(np.int64)
                    if len(text) > 2:
                        code = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                        keys, n = np.unique(code, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "code": keys, "n": n})

    rows = sample.select("lang", "document").mapInPandas(grams, "lang string, code long, n long")
    rows = rows.groupBy("lang", "code").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(256)
    for _, code, n in rows:
        weight[code & 255] += n
    top = [b for b in np.argsort(-weight, kind="stable")[: SYMBOLS - 1] if weight[b] > 0 or b == 32]
    symbol_of = np.full(256, SYMBOLS - 1, np.int64)
    symbol_of[top] = np.arange(len(top))
    languages = sorted({r[0] for r in rows})
    counts: list[dict[int, int]] = [{} for _ in languages]
    for lang, code, n in rows:
        key = 0
        for shift in (24, 16, 8, 0):
            key = (key << BITS) | int(symbol_of[(code >> shift) & 255])
        table = counts[languages.index(lang)]
        table[key] = table.get(key, 0) + n
    return symbol_of, languages, counts


def identify_languages(
    tracks: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, training: DataFrame | None = None,
) -> DataFrame:
    """Language of each track document.

    In: ``track_id, document`` and, for training only, ``lang``; ``training``
    names another frame to learn from. Out, one row for each row in:
    ``track_id, held_out, lang_pred, score, bits_per_byte``. ``lang_pred`` is the
    language with the shortest code, the first in order of name on a tie;
    ``score`` is its posterior under equal priors, and ``bits_per_byte`` its code
    length per byte. A document that is null or has no letter, or any document
    when there is nothing to learn from, is ``und`` with score 0. Whole texts
    are coded. ``held_out`` marks ids no model learns from.
    """
    model = training_counts(training if training is not None else tracks, docs_per_language)
    stamp = uuid.uuid4().hex
    shared = tracks.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = trees_of(stamp, shared)
        slices = (b.iloc[i:i + DOCS_AT_ONCE] for b in batches for i in range(0, len(b), DOCS_AT_ONCE))
        for batch in slices:
            texts = [plain_bytes(t) for t in batch["document"]]
            sizes = np.array([len(t) for t in texts], float)
            known = np.array([has_letter(t) for t in batch["document"]], bool) & bool(trees.languages)
            if trees.languages:
                bits = trees.lengths(texts)
                best = bits.argmin(1)
                least = bits.min(1)
                score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
                names = np.array(trees.languages, object)[best]
                per_byte = least / np.maximum(sizes, 1)
            else:
                names, score, per_byte = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            yield pd.DataFrame({
                "track_id": batch["track_id"].astype("Int64").values, "lang_pred": np.where(known, names, UNKNOWN),
                "score": np.where(known, score, 0.0), "bits_per_byte": np.where(known, per_byte, np.nan),
            })

    found = track_documents(tracks).mapInPandas(
        predict, "track_id long, lang_pred string, score double, bits_per_byte double")
    return found.select(
        "track_id", (~is_training(F.col("track_id"))).alias("held_out"), "lang_pred", "score", "bits_per_byte")
