"""Boosted trees and threshold calibration over counted feature vectors.

Rows are distinct vectors of small integers with the number of cases and of
positive ones, so what is fitted here is bounded by the values the features can
take, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# (feature, most, left, right) or the value of a leaf.
Tree = tuple | float


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> Tree:
    leaf = float(-g.sum() / (h.sum() + ridge))
    if depth == 0 or len(x) < 2:
        return leaf
    whole = g.sum() ** 2 / (h.sum() + ridge)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for most in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= most
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
            if gain > best[0]:
                best = (gain, f, int(most))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (
        best[1], best[2], _tree(x[left], g[left], h[left], depth - 1, ridge),
        _tree(x[~left], g[~left], h[~left], depth - 1, ridge))


def _values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _values(tree[2], x), _values(tree[3], x))


def fit(x: np.ndarray, cases: np.ndarray, positive: np.ndarray, trees: int, depth: int,
        rate: float = 0.3, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """Start value and trees of the log odds (second-order logistic boosting)."""
    start = float(np.log((positive.sum() + 0.5) / ((cases - positive).sum() + 0.5)))
    odds, grown = np.full(len(x), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        tree = _tree(x, cases * p - positive, cases * p * (1 - p), depth, ridge)
        grown.append(tree)
        odds = odds + rate * _values(tree, x)
    return start, [_scaled(t, rate) for t in grown]


def _scaled(tree: Tree, rate: float) -> Tree:
    if isinstance(tree, tuple):
        return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))
    return tree * rate


def probability(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    odds = model[0] + sum((_values(t, x) for t in model[1]), np.zeros(len(x)))
    return 1 / (1 + np.exp(-odds))


def compiled(model: tuple[float, list[Tree]], feature) -> Column:
    """The log odds as one column expression; ``feature(i)`` is feature i."""

    def column(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(feature(tree[0]) <= tree[1], column(tree[2])).otherwise(column(tree[3]))

    odds = F.lit(model[0])
    for tree in model[1]:
        odds = odds + column(tree)
    return odds


def threshold(scores: np.ndarray, cases: np.ndarray, positive: np.ndarray, precision: float) -> float:
    """Lowest score from which upward at least ``precision`` of the cases are
    positive; above 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    best, n, p = 2.0, 0.0, 0.0
    for at, i in enumerate(order):
        n, p = n + cases[i], p + positive[i]
        last = at + 1 == len(order) or scores[order[at + 1]] < scores[i]
        if last and p >= precision * n and p > 0:
            best = float(scores[i])
    return best
