"""Quality classifier: conjunctive rules out of small trees, weighted by a lasso.

Trees grown on samples of the labelled documents give their paths as rules over
text statistics; a logistic regression with an L1 penalty keeps a few dozen of
them; the sum of their weights becomes one column expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.llm.quality_rules import STOP_WORDS, SYMBOLS
from trackplace.llm.words import among, is_training, lines, settled, track_documents, trimmed, words

FEATURES = (
    "n_words", "mean_word_chars", "distinct_ratio", "repeat_ratio", "symbol_ratio", "shout_ratio", "upper_ratio",
    "digit_ratio", "stop_ratio", "n_lines", "words_per_line", "dup_line_ratio", "letter_ratio",
)
LABELLED_ROWS = 20_000
TREES, DEPTH, BINS = 40, 3, 32
PENALTY = 1e-3
# A rule is a set of (feature, is above, threshold).
Rule = frozenset


def statistics(tracks: DataFrame, *keep: str) -> DataFrame:
    """``track_id``, the columns ``keep`` and one double per feature."""
    rows = tracks.select("track_id", *keep, F.coalesce("document", F.lit("")).alias("_text"))
    rows = rows.withColumn("_w", words(F.col("_text")))
    rows = rows.withColumn("_l", F.filter(lines(F.col("_text")), lambda x: trimmed(x) != ""))
    count = lambda kept: F.regexp_count("_text", F.lit(f"[{kept}]")).cast("double")
    rows = rows.withColumns({
        "_n": F.size("_w").cast("double"), "_c": F.length(F.array_join("_w", "")).cast("double"),
        "_d": F.size(F.array_distinct("_w")).cast("double"),
        "_r": F.size(F.filter("_w", lambda x, i: (i > 0) & (x == F.get("_w", i - 1)))).cast("double"),
        "_s": F.size(F.filter("_w", lambda x: among(x, STOP_WORDS))).cast("double"),
        "_m": F.size("_l").cast("double"), "_k": F.size(F.array_distinct("_l")).cast("double"),
        "_p": F.length(F.regexp_replace("_text", r"[\p{L}\s]+", "")).cast("double"),
    })
    per = lambda top, bottom: F.coalesce(top / F.nullif(F.col(bottom), F.lit(0.0)), F.lit(0.0))
    values = {
        "n_words": F.col("_n"), "mean_word_chars": per(F.col("_c"), "_n"), "distinct_ratio": per(F.col("_d"), "_n"),
        "repeat_ratio": per(F.col("_r"), "_n"), "symbol_ratio": per(count(SYMBOLS), "_n"),
        "shout_ratio": per(count("!"), "_n"), "upper_ratio": per(count("A-Z"), "_c"),
        "digit_ratio": per(count("0-9"), "_c"), "stop_ratio": per(F.col("_s"), "_n"), "n_lines": F.col("_m"),
        "words_per_line": per(F.col("_n"), "_m"), "dup_line_ratio": per(F.col("_m") - F.col("_k"), "_m"),
        "letter_ratio": per(F.col("_c") - F.col("_p"), "_c"),
    }
    return settled(rows, "track_id", *keep, **{f: values[f].cast("double") for f in FEATURES})


def _grow(binned, edges, y, rows, features, depth, path, found) -> None:
    """Adds the paths of a tree on ``rows`` to ``found`` (gini splits on bins)."""
    if depth == 0 or len(rows) < 20:
        return
    n, p = len(rows), y[rows].sum()
    best = (1e-9, None, None)
    for f in features:
        b = binned[rows, f]
        size = np.bincount(b, minlength=len(edges[f]) + 1).cumsum()[:-1]
        plus = np.bincount(b, y[rows], len(edges[f]) + 1).cumsum()[:-1]
        if not len(size):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = plus**2 / size + (p - plus) ** 2 / (n - size) - p**2 / n
        gain = np.where((size >= 5) & (n - size >= 5), gain, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], f, at)
    if best[1] is None:
        return
    _, f, at = best
    under = binned[rows, f] <= at
    for above, part in ((False, rows[under]), (True, rows[~under])):
        longer = path | {(f, above, float(edges[f][at]))}
        found.setdefault(Rule(longer), len(found))
        _grow(binned, edges, y, part, features, depth - 1, longer, found)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    result = np.ones(len(x), bool)
    for f, above, at in rule:
        result &= (x[:, f] > at) == above
    return result


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, seed: int = 7) -> list[Rule]:
    """Paths of trees grown on half of the rows and of the features each."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    found: dict[Rule, int] = {}
    for _ in range(trees):
        rows = np.sort(rng.choice(len(x), max(1, len(x) // 2), replace=False))
        features = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        _grow(binned, edges, y, rows, features, depth, frozenset(), found)
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the penalised logistic fit (accelerated proximal
    gradient; classes weigh alike, the intercept is free)."""
    n, m = r.shape
    case = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = v = np.zeros(m)
    b = c = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    probe = np.full(m, m**-0.5) if m else w
    for _ in range(20):
        probe = r.T @ (case * (r @ probe))
        probe = probe / max(np.linalg.norm(probe), 1e-12)
    step = 4.0 / ((np.linalg.norm(r.T @ (case * (r @ probe))) if m else 0.0) / n + case.max())
    t = 1.0
    for _ in range(rounds):
        e = case * (1 / (1 + np.exp(-(r @ v + c))) - y) / n
        new = v - step * (r.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b), w


def fit_rules(
    tracks: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = LABELLED_ROWS,
    trees: int = TREES, depth: int = DEPTH, bins: int = BINS, penalty: float = PENALTY,
) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from ``labels`` (``track_id`` and ``label``,
    0 or 1) that training may see, at most ``labelled_rows`` of them (those of
    smallest id digest). Ids and sources are no features."""
    usable = labels.select("track_id", F.col(label).cast("int").alias("_y")).filter(
        F.col("_y").isin(0, 1) & F.col("track_id").isNotNull() & is_training(F.col("track_id")))
    # Only digests that are small for the number of labels are sorted.
    unit = F.xxhash64("track_id").bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))
    early = usable.filter(unit * usable.count() <= 2 * labelled_rows + 100)
    sample = early.orderBy(unit, "track_id", "_y").limit(labelled_rows)
    joined = track_documents(tracks).join(F.broadcast(sample), "track_id")
    rows = statistics(joined, "_y").select("track_id", "_y", *FEATURES).collect()
    rows.sort()  # the fit does not depend on the order of arrival
    if not rows:
        return 0.0, []
    x, y = np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows], float)
    if y.min() == y.max():
        return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), []
    rules = tree_rules(x, y, trees, depth, bins)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    held = np.stack([_holds(rule, x) for rule in rules], 1).astype(np.float32)
    start, weights = lasso(held, y, penalty)
    return start, [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]


def compiled(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The rules as one expression over the statistics: a probability."""
    odds = F.lit(model[0])
    for rule, weight in model[1]:
        holds = F.lit(True)
        for f, above, at in sorted(rule):
            holds = holds & ((F.col(FEATURES[f]) > at) if above else (F.col(FEATURES[f]) <= at))
        odds = odds + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def score_quality(tracks: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Probability that each track document is of good quality.

    In: ``tracks`` (``track_id, document``) and ``labels`` (``track_id, quality``).
    Out, one row for each row in: ``track_id, held_out, score, predicted``.
    Null and empty documents have statistics of zero and are scored as such;
    labels that are null, neither 0 nor 1 or without a document teach nothing;
    without labels every score is 0.5; an empty table gives none. Repeated rows
    are each scored, contradicting labels both count.
    """
    model = fit_rules(tracks, labels, **options)
    scored = statistics(track_documents(tracks)).withColumn("score", compiled(model))
    return scored.select(
        "track_id", (~is_training(F.col("track_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
