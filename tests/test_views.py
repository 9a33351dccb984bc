"""Views by place: the rows of a plain filter, without reading the rest."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trackplace.functions.geo import in_box
from trackplace.operators import views

FIXES = "track_id long, seq long, lat double, lon double"


def interleaved(x, y):
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(views.BITS))


def step(value, low, width):
    return max(0, min(2**views.BITS - 1, int((value - low) / width * 2**views.BITS // 1)))


def world(seed=1, n=4000):
    rng = random.Random(seed)
    rows = [(k % 9, k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(n)]
    rows += [(9, n + k, lat, lon) for k, (lat, lon) in enumerate([(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (None, 1.0), (46.0, 7.0), (46.5, 7.5)])]
    return rows


BOXES = [(46.0, 7.0, 46.5, 7.5), (-10.0, 170.0, 10.0, -170.0), (-90.0, -180.0, 90.0, 180.0), (0.0, 0.0, 0.0, 0.0), (80.0, 5.0, 90.0, 1.0), (10.0, 20.0, 5.0, 30.0)]


def test_places_are_bits_in_turn(spark):
    rows = world()
    got = spark.createDataFrame(rows, FIXES).select("seq", views.place_on_curve(F.col("lat"), F.col("lon")).alias("p")).collect()
    want = {s: None if lat is None else interleaved(step(lon, -180, 360), step(lat, -90, 180)) for _, s, lat, lon in rows}
    assert {r.seq: r.p for r in got} == want


@pytest.mark.parametrize("stretches", [4, 48, 400])
def test_stretches_hold_every_place_of_the_box(stretches):
    rng = random.Random(stretches)
    for south, west, north, east in BOXES:
        parts = views.curve_stretches(south, west, north, east, stretches)
        assert len(parts) <= stretches + 4 and parts == sorted(parts)
        for _ in range(200 if south <= north else 0):
            lat = rng.uniform(south, north)
            lon = rng.uniform(west, east if west <= east else east + 360)
            p = interleaved(step((lon + 180) % 360 - 180, -180, 360), step(lat, -90, 180))
            assert any(low <= p <= high for low, high in parts)


def test_same_rows_and_far_fewer_row_groups(spark, tmp_path):
    path, fixes = str(tmp_path / "by_place"), spark.createDataFrame(world(), FIXES)
    views.write_by_place(fixes, path, files=64)
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in (tmp_path / "by_place").glob("*.parquet")
              for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    names = [groups[0].column(c).path_in_schema for c in range(groups[0].num_columns)]
    spans = [s for g in groups if (s := g.column(names.index("place")).statistics) is not None and s.has_min_max]
    for box in BOXES:
        seen = views.fixes_in_view(spark, path, *box)
        assert sorted(map(tuple, seen.collect())) == sorted(
            map(tuple, fixes.filter(in_box(F.col("lat"), F.col("lon"), *box)).collect()))
        parts = views.curve_stretches(*box)
        read = sum(any(s.min <= high and low <= s.max for low, high in parts) for s in spans)
        if box == BOXES[0]:
            assert read <= 3 and len(spans) >= 60
        if box == BOXES[1]:
            assert read <= len(spans) / 4
    plan = views.fixes_in_view(spark, path, *BOXES[0])._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "Or(" in pushed and "And(Greater" in pushed
