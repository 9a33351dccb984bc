"""Statistics of growing tracks, kept as they grow.

A segment is held in state as intervals of its fixes in order of time: the fixes
of an interval in one value, and a summary of each interval, which merging adds
up together with the step from one interval to the next. A fix, however late,
opens the one interval it falls into, which is split when it gets long. Nothing
else of the segment is read again, and no fix is read from anywhere but state.
A segment of one interval is one value, read and written once per micro-batch.
Segments come to the workers many at a time, as most of them are short.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from trackplace.streaming.recorder import STATE_STORE

# Fixed value: metres.
EARTH_RADIUS_M = 6_371_000.0
# Fixes of an interval after a split; it is split at twice as many.
INTERVAL_FIXES = 512
SEGMENT = ["track_id", "segment_no"]
STATS = (
    "track_id long, segment_no long, version long, fixes long, start_us long, end_us long, metres double"
)
# Segments are dealt over so many keys of the state; changing it needs a new stream.
BUCKETS = 1024
# Arrived fixes that are put into state at a time.
_ROWS = 200_000
# Which of the ids are null (1 the track, 2 the segment), and the ids with 0 for null.
_KEY = "nulls long, track long, segment long"
_FIX = np.dtype([("t_us", np.int64), ("seq", np.int64), ("lat", np.float64), ("lon", np.float64)])
_ARRIVED = np.dtype([(name, np.int64) for name in ("nulls", "track", "segment")] + _FIX.descr)
_FOUND = ["version", "fixes", "start_us", "end_us", "metres"]


def metres_between(a, b):
    """Great-circle distance of places ``(lat, lon)`` in degrees, one or many."""
    lat_a, lon_a, lat_b, lon_b = (np.radians(x) for x in (*a, *b))
    h = np.sin((lat_b - lat_a) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin((lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


@dataclass(frozen=True)
class Interval:
    """What is known of a stretch of fixes without looking at them."""

    first: tuple
    last: tuple
    fixes: int
    metres: float

    @classmethod
    def of(cls, fixes: np.ndarray) -> Interval:
        steps = metres_between((fixes["lat"][:-1], fixes["lon"][:-1]), (fixes["lat"][1:], fixes["lon"][1:]))
        return cls(tuple(fixes[0].tolist()), tuple(fixes[-1].tolist()), len(fixes), float(steps.sum()))

    def merge(self, later: Interval) -> Interval:
        step = float(metres_between(self.last[2:], later.first[2:]))
        return Interval(self.first, later.last, self.fixes + later.fixes, self.metres + step + later.metres)


class _Growing(StatefulProcessor):
    """State of the segments of a bucket. ``heads`` holds of each segment the
    fixes while they are one interval; later the list of its intervals by their
    first fix, with the number under which ``stored`` has the fixes of each.

    A bucket is only the way to its segments: no value is kept or read for all of it.
    """

    def __init__(self, interval_fixes: int):
        self.size = interval_fixes
        self.segment = ()

    def init(self, handle) -> None:
        self.heads = handle.getMapState(
            "heads", _KEY, "fixes binary, intervals binary, next long, version long")
        self.stored = handle.getMapState("stored", f"{_KEY}, number long", "fixes binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched, part, held = {}, [], 0
        for piece in rows:
            new = np.empty(len(piece), _ARRIVED)
            for name in _ARRIVED.names:
                new[name] = piece[name]
            part.append(new)
            held += len(new)
            if held >= _ROWS:
                self._take(np.concatenate(part), touched)
                part, held = [], 0
        if part:
            self._take(np.concatenate(part), touched)
        # Objects, so that a null id leaves the others whole numbers.
        yield pd.DataFrame(
            [(None if nulls & 1 else track, None if nulls & 2 else segment, *found)
             for (nulls, track, segment), found in touched.items()], columns=[*SEGMENT, *_FOUND], dtype=object)

    def _take(self, new: np.ndarray, touched: dict) -> None:
        """Adds fixes of any segments to state; ``touched`` has the statistics of
        each segment that this micro-batch brought fixes of."""
        new = new[np.lexsort((new["segment"], new["track"], new["nulls"]))]
        names = new[["nulls", "track", "segment"]]
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        fixes = new[list(_FIX.names)].astype(_FIX)
        short = []
        for name, arrived in zip(names[starts].tolist(), np.split(fixes, starts[1:]), strict=True):
            head = self.heads.getValue(name)
            inside, intervals, next_, version = head or (b"", b"", 0, 0)
            # A segment counts a micro-batch once, however many parts it comes in.
            version += name not in touched
            if intervals:
                self._take_long(name, pickle.loads(bytes(intervals)), arrived, next_, version, touched)
            else:
                if inside:
                    arrived = np.concatenate([np.frombuffer(bytes(inside), _FIX), arrived])
                short.append((name, arrived, version))
        if short:
            self._take_short(short, touched)

    def _take_short(self, short: list, touched: dict) -> None:
        """Segments that were one interval at most, all in one go."""
        fixes = np.concatenate([f for _, f, _ in short])
        of = np.repeat(np.arange(len(short)), [len(f) for _, f, _ in short])
        # Stable: of equal fixes the one that was there first.
        by = np.lexsort((fixes["seq"], fixes["t_us"], of))
        fixes, of = fixes[by], of[by]
        again = np.append(False, (of[1:] == of[:-1]) & (fixes["t_us"][1:] == fixes["t_us"][:-1])
                          & (fixes["seq"][1:] == fixes["seq"][:-1]))
        fixes, of = fixes[~again], of[~again]
        steps = metres_between((fixes["lat"][:-1], fixes["lon"][:-1]), (fixes["lat"][1:], fixes["lon"][1:]))
        # A step belongs to the later fix; the first of a segment has none.
        steps = np.append(0.0, np.where(of[1:] == of[:-1], steps, 0.0))
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ends = np.append(starts[1:], len(of))
        metres = np.add.reduceat(steps, starts).tolist()
        first, last = fixes["t_us"][starts].tolist(), fixes["t_us"][ends - 1].tolist()
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            name, _, version = short[k]
            if b - a > 2 * self.size:
                self._take_long(name, [], fixes[a:b], 0, version, touched)
                continue
            self.heads.updateValue(name, (fixes[a:b].tobytes(), b"", 0, version))
            touched[name] = (version, b - a, first[k], last[k], metres[k])

    def _take_long(self, name, intervals: list, new: np.ndarray, next_: int, version: int, touched: dict) -> None:
        """A segment of intervals, or one that becomes so."""
        self.segment = name
        new = new[np.lexsort((new["seq"], new["t_us"]))]
        starts = [s.first[:2] for s, _ in intervals]
        # What comes before the first interval belongs to it as well.
        place = np.array([max(0, bisect_right(starts, k) - 1) for k in zip(
            new["t_us"].tolist(), new["seq"].tolist(), strict=True)], np.int64)
        for at in np.unique(place)[::-1]:
            next_ = self._add(intervals, int(at), new[place == at], next_)
        self.heads.updateValue(name, (b"", pickle.dumps(intervals), next_, version))
        whole = reduce(Interval.merge, (s for s, _ in intervals))
        touched[name] = (version, whole.fixes, whole.first[0], whole.last[0], whole.metres)

    def _add(self, intervals: list, at: int, new: np.ndarray, next_: int) -> int:
        """Puts fixes into the interval ``at``; one already there stays as it is."""
        number = None
        if intervals:
            number = intervals[at][1]
            new = np.concatenate([np.frombuffer(bytes(self.stored.getValue((*self.segment, number))[0]), _FIX), new])
        # Stable: of equal fixes the one that was there first.
        new = new[np.lexsort((new["seq"], new["t_us"]))]
        again = np.append(False, (new["t_us"][1:] == new["t_us"][:-1]) & (new["seq"][1:] == new["seq"][:-1]))
        new = new[~again]
        parts = [new] if len(new) <= 2 * self.size else np.array_split(new, -(-len(new) // self.size))
        placed = []
        for part in parts:
            if number is None:
                number, next_ = next_, next_ + 1
            self.stored.updateValue((*self.segment, number), (part.tobytes(),))
            placed.append((Interval.of(part), number))
            number = None
        intervals[at:at + 1] = placed
        return next_

    def close(self) -> None:
        pass


def live_track_stats(fixes: DataFrame, interval_fixes: int = INTERVAL_FIXES) -> DataFrame:
    """Statistics of growing segments: each micro-batch gives a row for each
    segment it touched, and ``version`` counts them.

    ``fixes(track_id, segment_no, seq, t_us, lat, lon)`` may come late, in any
    order and again: a fix is known by segment, time and ``seq``. What
    ``latest_stats`` makes of all rows are the statistics of the whole table.
    State is kept in RocksDB, which this sets for the session.
    """
    fixes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    track, segment = (F.col(c) for c in SEGMENT)
    none = F.lit(0).cast("long")
    return fixes.select(
        F.pmod(F.xxhash64(track, segment), F.lit(BUCKETS)).alias("bucket"),
        (F.when(track.isNull(), 1).otherwise(0) + F.when(segment.isNull(), 2).otherwise(0)).cast("long").alias("nulls"),
        F.coalesce(track, none).alias("track"), F.coalesce(segment, none).alias("segment"),
        "seq", "t_us", "lat", "lon",
    ).groupBy("bucket").transformWithStateInPandas(_Growing(interval_fixes), STATS, "append", "None")


def latest_stats(stats: DataFrame) -> DataFrame:
    """Statistics of each track out of the newest row of each of its segments."""
    newest = stats.groupBy(*SEGMENT).agg(
        F.max_by(F.struct("fixes", "start_us", "end_us", "metres"), "version").alias("s"))
    return newest.groupBy("track_id").agg(
        F.sum("s.fixes").alias("fixes"), F.count(F.lit(1)).alias("segments"), F.min("s.start_us").alias("start_us"),
        F.max("s.end_us").alias("end_us"), (F.max("s.end_us") - F.min("s.start_us")).alias("duration_us"),
        F.sum("s.metres").alias("metres"))
