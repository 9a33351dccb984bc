"""Lengths and listings of tracks with known numbers."""

from trackplace.operators import stats

FIXES = "track_id long, segment_no long, seq long, t_us long, lat double, lon double"
ROWS = [(1, 0, 1, 0, 46.0, 7.0), (1, 0, 2, 1, 46.1, 7.0), (1, 1, 3, 2, 50.0, 7.0), (1, 1, 4, 3, 50.0, 7.0), (2, 0, 1, 9, 1.0, 1.0)]


def test_length_leaves_out_gaps_and_first_fixes(spark):
    df = spark.createDataFrame(ROWS, FIXES)
    for limit in (None, 1):
        got = {r.track_id: round(r.metres, 1) for r in stats.track_distance(df, limit).collect()}
        assert got == {1: 11119.5, 2: 0.0}
    first = [r.step_m for r in stats.steps(df).orderBy("track_id", "seq").collect()]
    assert [m is None for m in first] == [True, False, True, False, True]


def test_listing(spark):
    known = spark.createDataFrame([(1,), (2,), (3,)], "track_id long")
    rows = stats.track_listing(known, spark.createDataFrame(ROWS, FIXES)).collect()
    assert [(r.track_id, r.fixes, r.segments, r.timed) for r in rows] == [
        (2, 1, 1, True), (1, 4, 2, True), (3, 0, None, False)]


def test_elapsed_and_bounds(spark):
    runs = [(1, "start", 10), (1, "pause", 30), (1, "resume", 50), (1, "now", 55), (2, "start", 0), (2, "pause", 7), (2, "now", 99)]
    got = stats.recorded_elapsed(spark.createDataFrame(runs, "recording_id long, event string, at_us long"))
    assert {r.recording_id: r.recorded_us for r in got.collect()} == {1: 25, 2: 7}
    box = {r.track_id: r.degenerate for r in stats.bounds(spark.createDataFrame(ROWS, FIXES), ["track_id"]).collect()}
    assert box == {1: False, 2: True}


def test_segments_start_at_silence_and_on_request(spark):
    from pyspark.sql import functions as F

    feed = spark.createDataFrame([(1, 0, False), (1, 5, False), (1, 50, False), (1, 51, True)], "k long, t long, again boolean")
    for limit in (None, 2):
        out = stats.assign_segments(feed, ["k"], ["t"], 10, F.col("again"), limit).orderBy("t").collect()
        assert [(r.segment_no, r.seq) for r in out] == [(0, 1), (0, 2), (1, 3), (2, 4)]
