"""The fix filter: rules one delivery at a time, as a table and as a stream."""

import random

import numpy as np
import pandas as pd
import pytest

from trackplace.operators.stats import track_distance, track_stats
from trackplace.streaming import live, recorder

SCHEMA = ("device long, run long, delivery_id long, now_us long, provider string, accuracy double, age_ms long")


def run(writer, tmp_path):
    """Works off what has arrived, then ends."""
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done = query.awaitTermination(60)
    query.stop()
    assert done


def feed(seed=4, n=400):
    rng = random.Random(seed)
    rows, clocks = [], {}
    for i in range(n):
        key = (rng.randrange(3), rng.randrange(2))
        clocks[key] = clocks.get(key, 0) + rng.choice([0, 1, 20, 60, 95, 200, 400]) * 1_000_000
        rows.append((*key, i, clocks[key], rng.choice(["gps", "fused"]),
                     rng.choice([None, 5.0, 200.0, 201.0]), rng.choice([0, 59_000, 60_000, 61_000, 500_000])))
    return rows


def one_by_one(rows, interval=60_000):
    silence, max_age, grace = max(3 * interval, 90_000), max(interval, 60_000), max(interval + interval // 2, 90_000)
    memory, out = {}, {}
    for device, run, i, now, provider, accuracy, age in sorted(rows, key=lambda r: (r[3], r[2])):
        m = memory.setdefault((device, run), {})
        last = m.get(provider)
        quiet = last is None or (now - last) / 1000 > silence
        ok = accuracy is not None and accuracy <= 200 and not (quiet and age > max_age)
        m[provider] = now
        if provider == "fused" and "written" in m and (now - m["written"]) / 1000 < grace:
            out[i] = "ignored"
        elif not ok:
            out[i] = "dropped"
        else:
            out[i] = "written"
            if provider == "gps":
                m["written"] = now
    return out


@pytest.mark.parametrize("interval,limit", [(60_000, None), (5_000, None), (90_000, 20)])
def test_table(spark, interval, limit):
    rows = feed()
    out = recorder.admit_fixes(spark.createDataFrame(rows, SCHEMA), interval, limit).collect()
    assert {r.delivery_id: r.outcome for r in out} == one_by_one(rows, interval)


def test_stream_agrees_with_table(spark, tmp_path):
    rows = feed(9, 120)
    parts = [rows[:50], rows[50:80], rows[80:]]
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    admitted = recorder.admit_stream(stream, idle_ms=None)
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(admitted.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    got = {r.delivery_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == one_by_one(rows)
    # A delivery from before what its run has seen changes nothing.
    spark.createDataFrame([(0, 0, 999, -1, "gps", 5.0, 0)], SCHEMA).write.mode("append").parquet(source)
    run(admitted.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out")).filter("delivery_id = 999")
    assert [r.outcome for r in out.collect()] == ["late"]


def test_status_and_fixes(spark):
    rows = feed(2, 60)
    admitted = recorder.admit_fixes(spark.createDataFrame(rows, SCHEMA))
    want = one_by_one(rows)
    status = recorder.recording_status(admitted).collect()
    assert sum(r.written for r in status) == sum(o == "written" for o in want.values())
    assert sum(r.dropped for r in status) == sum(o == "dropped" for o in want.values())
    d = spark.createDataFrame(
        [(1, 1, 1, 0, 5, 1.0, 2.0, 500.0, 3.0, 4.0, None, "gps"), (1, 1, 2, 0, 5, 1.0, 2.0, None, 3.0, 4.0, None, "gps")],
        "device long, run long, delivery_id long, now_us long, time_us long, lat double, lon double, msl_altitude double,"
        " msl_accuracy double, accuracy double, speed double, provider string")
    got = recorder.to_fix(d).orderBy("delivery_id").collect()
    assert (got[0].ele, got[0].ele_accuracy, got[1].ele, got[1].ele_accuracy) == (500.0, 3.0, None, None)


FIXES = "track_id long, segment_no long, seq long, t_us long, lat double, lon double"


def growing(seed=3, n=400):
    """Fixes of three tracks in no order, some of them several times."""
    rng = random.Random(seed)
    rows = [(t, i // 70, i, i // 3 * 1_000_000, 46 + rng.random() / 100, 7 + rng.random() / 100)
            for t in (1, 2, 3) for i in range(n // t)]
    parts = [[] for _ in range(4)]
    for row in rows:
        for k in {rng.randrange(4) for _ in range(rng.choice([1, 1, 2]))}:
            parts[k].append(row)
    for part in parts:
        rng.shuffle(part)
    return rows, parts


def test_late_and_repeated_fixes_give_the_statistics_of_the_table(spark, tmp_path):
    rows, parts = growing()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = live.live_track_stats(spark.readStream.schema(FIXES).parquet(source), interval_fixes=8)
    for part in parts:
        spark.createDataFrame(part, FIXES).write.mode("append").parquet(source)
        run(stream.writeStream.format("parquet").option("path", out), tmp_path)
    got = live.latest_stats(spark.read.parquet(out)).collect()
    table = spark.createDataFrame(rows, FIXES)
    want = track_stats(table).join(track_distance(table), "track_id").collect()
    assert sorted((*r[:-1], round(r.metres, 3)) for r in got) == sorted((*r[:-1], round(r.metres, 3)) for r in want)
    assert spark.read.parquet(out).agg({"version": "max"}).first()[0] == 4


def test_a_fix_opens_one_interval_only():
    class Map(dict):
        opened = 0

        def getValue(self, key):
            self.opened += 1
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

    state = live._Growing(16)
    state.stored, intervals, next_ = Map(), [], 0
    whole = np.array([(i * 10, i, 46.0, 7 + i / 1000) for i in range(2000)], live._FIX)
    next_ = state._add(intervals, 0, whole, next_)
    assert len(intervals) == 125 and state.stored.opened == 0
    late = np.array([(4005, 9999, 46.5, 7.4)], live._FIX)
    at = max(k for k, (s, _) in enumerate(intervals) if s.first[:2] <= (4005, 9999))
    state._add(intervals, at, late, next_)
    assert state.stored.opened == 1
    merged = live.reduce(live.Interval.merge, (s for s, _ in intervals))
    alone = live.Interval.of(np.sort(np.concatenate([whole, late]), order=["t_us", "seq"]))
    assert (merged.first, merged.last, merged.fixes) == (alone.first, alone.last, alone.fixes)
    assert merged.metres == pytest.approx(alone.metres)


class Counted(dict):
    """A map state that counts what is asked of it."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


def test_short_segments_come_many_at_a_time_and_cost_one_read_and_one_write(monkeypatch):
    state = live._Growing(16)
    state.heads, state.stored = Counted(), Counted()
    rows = [(0, t, 2**60 + s, i, i * 10, 46.0, 7 + i / 1000) for t in range(40) for s in range(5) for i in range(3)]
    rows.append((3, 0, 0, 1, 10, 46.0, 7.0))
    piece = pd.DataFrame(rows, columns=live._ARRIVED.names[:3] + ("seq", "t_us", "lat", "lon"))
    (first,) = state.handleInputRows((1,), iter([piece]), None)
    assert (len(first), state.heads.calls, state.stored.calls) == (201, 402, 0)
    assert set(first["segment_no"]) == {2**60 + s for s in range(5)} | {None}
    assert first["track_id"].isna().sum() == 1 and set(first["fixes"]) == {1, 3}
    # The same again in many parts: nothing changes, and each counts the micro-batch once.
    monkeypatch.setattr(live, "_ROWS", 50)
    pieces = [piece.sample(frac=1, random_state=k)[n:n + 20] for k in (1, 2) for n in range(0, len(piece), 20)]
    (again,) = state.handleInputRows((1,), iter(pieces), None)
    assert len(again) == 201 and set(again["version"]) == {2}
    ids = ["track_id", "segment_no"]
    value = lambda d: {tuple(map(str, r[:2])): r[2:] for r in d[[*ids, "fixes", "start_us", "end_us", "metres"]].values.tolist()}
    assert value(again) == value(first)


def test_a_short_segment_becomes_one_of_intervals_beside_others():
    rng = random.Random(5)
    state = live._Growing(4)
    state.heads, state.stored = Counted(), Counted()
    rows = [(0, 1, s, i, i // 2 * 10, 46 + rng.random(), 7 + rng.random()) for s in (1, 2) for i in range((3, 60)[s - 1])]
    arrived = rows + rng.sample(rows, 30)
    rng.shuffle(arrived)
    columns = live._ARRIVED.names[:3] + ("seq", "t_us", "lat", "lon")
    for k in range(0, len(arrived), 7):
        for out in state.handleInputRows((1,), iter([pd.DataFrame(arrived[k:k + 7], columns=columns)]), None):
            for r in out.itertuples():
                seen = {x for x in arrived[:k + 7] if x[2] == r.segment_no}
                want = live.Interval.of(np.array(sorted((x[4], x[3], x[5], x[6]) for x in seen), live._FIX))
                assert (r.fixes, r.start_us, r.end_us) == (want.fixes, want.first[0], want.last[0])
                assert r.metres == pytest.approx(want.metres)
    assert {k[2] for k in state.stored} == {2} and len(state.stored) > 5
