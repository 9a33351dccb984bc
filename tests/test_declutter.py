"""Thinning: a kept point per neighbourhood, in the order given."""

import math
import random

import pytest

from trackplace.operators.declutter import declutter, declutter_grid

SCHEMA = "view long, ord long, x double, y double"


def one_by_one(points, spacing):
    kept = []
    for o, x, y in sorted(points):
        near = [(max(abs(k[1] - x), abs(k[2] - y)), math.floor(k[1] / spacing), math.floor(k[2] / spacing), k)
                for k in kept if max(abs(k[1] - x), abs(k[2] - y)) < spacing]
        if near:
            min(near, key=lambda n: n[:3])[3][3] += 1
        else:
            kept.append([o, x, y, 1])
    return {k[0]: k[3] for k in kept}


def views():
    rng = random.Random(8)
    walk, x, y = [], 0.0, 0.0
    for i in range(300):
        x, y = x + rng.uniform(-3, 14), y + rng.uniform(-6, 6)
        walk.append((i, x, y))
    crowd = [(i, rng.gauss(0, 40), rng.gauss(0, 40)) for i in rng.sample(range(1000), 300)]
    lattice = [(i, float(i % 20 * 8), float(i // 20 * 8)) for i in range(200)]
    return {1: walk, 2: crowd, 3: lattice, 4: [(0, 1.0, 1.0)]}


@pytest.mark.parametrize("candidates,tile", [(8, 8), (1, 3), (3, 16)])
def test_agrees_with_points_taken_one_by_one(spark, monkeypatch, candidates, tile):
    monkeypatch.setattr("trackplace.operators.declutter.TILE", tile)
    rows = [(v, *p) for v, points in views().items() for p in points]
    rows += [(1, 9999, None, 1.0), (5, 0, None, None)]
    out = declutter(spark.createDataFrame(rows, SCHEMA), 30.0, ["view"], candidates=candidates)
    got = {}
    for r in out.collect():
        got.setdefault(r.view, {})[r.ord] = r["count"]
    assert got == {v: one_by_one(points, 30.0) for v, points in views().items()}


def test_no_points_none_kept(spark):
    assert declutter(spark.createDataFrame([], SCHEMA), 30.0, ["view"]).count() == 0


def test_grid_stands_for_every_point(spark):
    rows = [(v, *p) for v, points in views().items() for p in points]
    out = declutter_grid(spark.createDataFrame(rows, SCHEMA), 30.0, ["view"])
    assert sum(r["count"] for r in out.collect()) == len(rows)
