"""Placement: brackets, segment ends, ties, and agreement with a linear scan."""

import random

import pytest

from trackplace.operators.locate import locate

FIXES = "subject_id long, track_id long, segment_no long, seq long, t_us long, lat double, lon double, ele double"
MIN = 60_000_000


def fixes_of(spark, segments):
    rows = [
        (subject, track, no, seq, t, lat, lon, ele)
        for subject, track, no, points in segments
        for seq, (t, lat, lon, ele) in enumerate(points)
    ]
    return spark.createDataFrame(rows, FIXES)


def photos_of(spark, times, subject=1):
    return spark.createDataFrame(
        [(subject, i, t) for i, t in enumerate(times)], "subject_id long, photo_id long, t_us long"
    )


def place(spark, segments, times, tolerance_min=30, limit=None):
    out = locate(photos_of(spark, times), fixes_of(spark, segments), tolerance_min * 60_000, limit)
    return [r.asDict() for r in out.orderBy("photo_id").collect()]


def line(start, end, step, lat=46.0):
    return [(m * MIN, lat + m / 1000, 7.0, 500.0 + m) for m in range(start, end + 1, step)]


def test_segments_are_not_bridged(spark):
    segments = [(1, 1, 0, line(0, 60, 1)), (1, 1, 1, line(600, 660, 1))]
    got = place(spark, segments, [300 * MIN, 75 * MIN, 590 * MIN, 30 * MIN + 30_000_000, 95 * MIN])
    assert [g["placed"] for g in got] == [None, "end", "end", "interior", None]
    assert got[1]["fix_us"] == 60 * MIN and got[2]["fix_us"] == 600 * MIN
    assert got[1]["gap_m"] is None and got[3]["lat"] == pytest.approx(46.0305)
    assert got[3]["ele"] == pytest.approx(530.5)


def test_shortest_bracket_wins(spark):
    segments = [(1, 1, 0, line(0, 60, 60)), (1, 2, 0, line(29, 31, 2, lat=47.0))]
    got = place(spark, segments, [30 * MIN])
    assert (got[0]["track_id"], got[0]["placed"]) == (2, "interior")


def test_edges_of_a_bracket(spark):
    segments = [(1, 1, 0, line(0, 10, 5)), (1, 2, 0, [(100 * MIN, 46.0, 7.0, None)])]
    got = place(spark, segments, [0, 10 * MIN, 5 * MIN, 100 * MIN, 130 * MIN, 131 * MIN])
    assert [g["placed"] for g in got] == ["end", "interior", "interior", "end", "end", None]


def test_one_missing_altitude_and_fixes_within_a_millisecond(spark):
    segments = [(1, 1, 0, [(0, 46.0, 7.0, None), (10 * MIN, 46.1, 7.0, 500.0)]),
                (1, 2, 0, [(60 * MIN, 46.0, 7.0, None), (60 * MIN + 900, 46.1, 7.0, 500.0)])]
    got = place(spark, segments, [5 * MIN, 60 * MIN + 500])
    assert got[0]["ele"] == 500.0
    assert (got[1]["lat"], got[1]["ele"], got[1]["fix_us"]) == (46.0, None, 60 * MIN)


def test_seeded_outing(spark):
    segments = [(1, 1, 0, line(0, 30, 10))]
    got = place(spark, segments, [m * MIN for m in (2, 12, 25, 28, 33, 180)])
    assert [g["placed"] for g in got] == ["interior"] * 4 + ["end", None]


def scan(segments, t, tolerance_us):
    """One photo against every segment in turn."""
    best = end = None
    for _, track, no, points in segments:
        points = [p for _, p in sorted(enumerate(points), key=lambda e: (e[1][0], e[0]))]
        i = next((k for k, p in enumerate(points) if p[0] >= t), len(points))
        if i in (0, len(points)):
            p = points[0] if i == 0 else points[-1]
            away = abs(t - p[0])
            if away <= tolerance_us and (end is None or away < end[0]):
                end = (away, track, no, p[0])
        else:
            span = points[i][0] - points[i - 1][0]
            if best is None or span < best[0]:
                best = (span, track, no, t if span >= 1000 else points[i - 1][0])
    kind = "interior" if best else "end" if end else None
    return (kind, *(best or end or (None,) * 4)[1:])


@pytest.mark.parametrize("limit", [None, 60])
def test_agrees_with_linear_scan(spark, limit):
    rng = random.Random(3)
    segments = []
    for track in range(12):
        for no in range(3):
            t = rng.randrange(0, 4000)
            points = []
            for _ in range(rng.choice([1, 2, 15, 40])):
                points.append((t * 1_000_000, rng.uniform(46, 47), 7.0, None))
                t += rng.choice([0, 1, 5, 60, 700])
            segments.append((1, track, no, points))
    edges = [p[0] for s in segments for p in s[3]]
    times = [rng.randrange(0, 9_000) * 1_000_000 for _ in range(500)] + rng.sample(edges, 150)
    got = place(spark, segments, times, tolerance_min=5, limit=limit)
    want = [scan(segments, t, 300_000_000) for t in times]
    assert [(g["placed"], g["track_id"], g["segment_no"], g["fix_us"]) for g in got] == want


def test_one_dropout_over_thousands_of_photos(spark):
    long = (1, 1, 0, [(0, 46.0, 7.0, 1.0), (10**10, 47.0, 8.0, 2.0)])
    dense = (1, 2, 0, [(2 * 10**9 + i * 1_000_000, 46.5, 7.5, None) for i in range(50)])
    times = [1 + i * 10**6 for i in range(9000)]
    got = place(spark, [long, dense], times)
    want = [scan([long, dense], t, 30 * MIN) for t in times]
    assert [(g["placed"], g["track_id"], g["segment_no"], g["fix_us"]) for g in got] == want
