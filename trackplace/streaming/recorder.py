"""Which deliveries of a live location feed become fixes.

``admit_fixes`` works on a table, ``admit_stream`` on a stream; both apply the
same rules to ``deliveries(device, run, delivery_id, now_us, provider, accuracy,
age_ms)``. A run ends at every pause, so what a device remembered does not
outlive it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from trackplace.operators.ordered import Keyed, Last

# Metres beyond which a fix is no fix; floors in milliseconds.
MAX_ACCURACY_M = 200.0
MIN_FALLBACK_MS = 90_000
MIN_SILENCE_MS = 90_000
MIN_MAX_AGE_MS = 60_000
DEFAULT_INTERVAL_MS = 60_000
MIN_INTERVAL_MS = 1_000

KEYS = ["device", "run"]
ADMITTED = (
    "device long, run long, delivery_id long, now_us long, provider string, accuracy double,"
    " age_ms long, outcome string"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = 20_000


def limits(interval_ms: int) -> tuple[int, int, int]:
    """Silence that means re-acquiring, oldest age then accepted, and how long a
    written gps fix makes fused ones redundant."""
    i = max(interval_ms, MIN_INTERVAL_MS)
    return (max(3 * i, MIN_SILENCE_MS), max(i, MIN_MAX_AGE_MS), max(i + i // 2, MIN_FALLBACK_MS))


def admit_fixes(
    deliveries: DataFrame, interval_ms: int = DEFAULT_INTERVAL_MS, limit: int | None = None
) -> DataFrame:
    """Adds ``outcome``: written, dropped (unusable) or ignored (fused beside gps)."""
    silence, max_age, grace = limits(interval_ms)
    now, order = F.col("now_us"), ["now_us", "delivery_id"]
    gps = F.col("provider") == "gps"
    heard = Keyed(deliveries, KEYS, limit).running(
        order,
        _gps=Last(F.when(gps, now), before=True),
        _fused=Last(F.when(~gps, now), before=True),
    )
    heard = heard.transform(lambda d: d.withColumn("_usable", _usable(gps, silence, max_age)))
    heard = heard.running(order, _written=Last(F.when(gps & F.col("_usable"), now), before=True))
    superseded = ~gps & F.coalesce(now - F.col("_written") < grace * 1000, F.lit(False))
    outcome = F.when(superseded, "ignored").when(F.col("_usable"), "written").otherwise("dropped")
    return heard.rows().withColumn("outcome", outcome).drop("_gps", "_fused", "_usable", "_written")


def _usable(gps: Column, silence: int, max_age: int) -> Column:
    """Accurate enough, and not a stored position handed over after a silence."""
    last = F.when(gps, F.col("_gps")).otherwise(F.col("_fused"))
    reacquiring = last.isNull() | (F.col("now_us") - last > silence * 1000)
    return F.coalesce(F.col("accuracy") <= MAX_ACCURACY_M, F.lit(False)) & ~(
        reacquiring & (F.col("age_ms") > max_age)
    )


class _Admission(StatefulProcessor):
    """What a run remembers: a value per clock. A timer forgets idle runs.

    The deliveries of a micro-batch come in pieces and in any order. Of each piece
    only five numbers a row are kept until all are in; they are put in order of
    time and judged together, and come out in pieces again.
    """

    def __init__(self, interval_ms: int, idle_ms: int | None):
        self.limits, self.idle_ms = limits(interval_ms), idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.clocks = {name: handle.getValueState(name, "at_us long") for name in ("gps", "fused", "written")}
        self.latest = handle.getValueState("latest", "at_us long, delivery_id long")

    def _last(self, name: str) -> float:
        clock = self.clocks[name]
        return float(clock.get()[0]) if clock.exists() else np.nan

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, names = [], {}
        for piece in rows:
            codes = np.array([names.setdefault(p, len(names)) for p in piece["provider"]], np.int32)
            accuracy = pd.to_numeric(piece["accuracy"]).to_numpy(float, na_value=np.nan)
            age = pd.to_numeric(piece["age_ms"]).to_numpy(float, na_value=np.nan)
            parts.append((piece["now_us"].to_numpy(np.int64), piece["delivery_id"].to_numpy(np.int64), codes, accuracy, age))
        now, ids, codes, accuracy, age = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, now))
        now, ids, codes, accuracy, age = (c[order] for c in (now, ids, codes, accuracy, age))
        live = np.append(True, (now[1:] != now[:-1]) | (ids[1:] != ids[:-1]))
        if self.latest.exists():
            at, last_id = self.latest.get()
            live &= (now > at) | ((now == at) & (ids > last_id))
        outcome = np.full(len(now), "late", object)
        outcome[live] = self._judge(now[live], (codes == names.get("gps", -1))[live], accuracy[live], age[live])
        if live.any():
            end = np.flatnonzero(live)[-1]
            self.latest.update((int(now[end]), int(ids[end])))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        said = np.array(list(names), object)
        for start in range(0, len(now), _ROWS):
            part = slice(start, start + _ROWS)
            yield pd.DataFrame({
                "device": key[0], "run": key[1], "delivery_id": ids[part], "now_us": now[part],
                "provider": said[codes[part]], "accuracy": accuracy[part],
                "age_ms": pd.array(age[part], "Float64").astype("Int64"), "outcome": outcome[part]})

    def _judge(self, now, gps, accuracy, age) -> np.ndarray:
        silence, max_age, grace = self.limits
        last = np.empty(len(now))
        for name, mine in (("gps", gps), ("fused", ~gps)):
            heard = now[mine]
            last[mine] = np.append(self._last(name), heard[:-1].astype(float))[:len(heard)]
            if len(heard):
                self.clocks[name].update((int(heard[-1]),))
        with np.errstate(invalid="ignore"):
            quiet = np.isnan(last) | (now - last > silence * 1000)
            usable = (accuracy <= MAX_ACCURACY_M) & ~(quiet & (age > max_age))
            # The latest gps fix written before each delivery.
            places = np.where(gps & usable, np.arange(len(now)), -1)
            before = np.append(-1, np.maximum.accumulate(places))[:len(now)]
            written = np.where(before >= 0, now[before].astype(float), self._last("written"))
            beside = ~gps & (now - written < grace * 1000)
        if len(now) and places.max() >= 0:
            self.clocks["written"].update((int(now[places.max()]),))
        return np.where(beside, "ignored", np.where(usable, "written", "dropped"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (*self.clocks.values(), self.latest):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_stream(
    deliveries: DataFrame, interval_ms: int = DEFAULT_INTERVAL_MS, idle_ms: int | None = 6 * 3_600_000
) -> DataFrame:
    """The same on a stream, with a value per clock for each run. A delivery older
    than what its run has already seen comes out as ``late`` and changes nothing; a
    run not heard from for ``idle_ms`` is forgotten. Watching for idle runs keeps
    batches coming, so a stream that is to end when its input does (an
    ``availableNow`` trigger) passes None. State is kept in RocksDB, which this
    sets for the session.
    """
    deliveries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return deliveries.groupBy(*KEYS).transformWithStateInPandas(
        _Admission(interval_ms, idle_ms), ADMITTED, "append", "None" if idle_ms is None else "ProcessingTime")


def recording_status(admitted: DataFrame) -> DataFrame:
    """Points written and dropped per run; on a stream, in update or complete mode."""
    return admitted.groupBy(*KEYS).agg(
        F.count_if(F.col("outcome") == "written").alias("written"),
        F.count_if(F.col("outcome") == "dropped").alias("dropped"),
    )


def to_fix(deliveries: DataFrame) -> DataFrame:
    """Deliveries as fixes: an altitude only when it is above mean sea level, and
    then with its own accuracy."""
    msl = F.col("msl_altitude")
    return deliveries.select(
        *KEYS, "delivery_id", "now_us", F.col("time_us").alias("t_us"), "lat", "lon",
        msl.cast("double").alias("ele"),
        F.col("accuracy").cast("double").alias("accuracy"),
        F.when(msl.isNotNull(), F.col("msl_accuracy").cast("double")).alias("ele_accuracy"),
        F.col("speed").cast("double").alias("speed"),
        F.col("provider").alias("source"),
    )
