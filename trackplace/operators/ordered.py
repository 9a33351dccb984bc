"""Ordered computation inside keys, whatever the size of a key.

A Spark window hands all rows of one partition key to one task. That is the
plan to have while every key fits a task, and the wrong one when one recording,
one card or one person holds a large share of all rows. ``Keyed`` counts rows
per key first (a partial aggregate over the key columns), leaves the keys that
fit to plain windows, and cuts only the long ones into range-partitioned chunks:
windows then run inside a chunk, and what a chunk needs from the ones before it
comes from one summary row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackplace.session import checkpoint, rows_per_task

CHUNK = "_chunk"
# Long keys are sent to every executor only while they are this few.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Sum:
    """Running sum, the current row included."""

    value: Column


@dataclass(frozen=True)
class Last:
    """Latest non-null value so far; ``before`` leaves the current row out."""

    value: Column
    before: bool = False


@dataclass(frozen=True)
class Prev:
    """Value of the row just before, null on the first."""

    value: Column


def row_count() -> Sum:
    """The number of rows so far: a dense position from 1."""
    return Sum(F.lit(1).cast("long"))


class Keyed:
    """Rows grouped by ``keys`` (non-null), split by whether a key fits one task."""

    def __init__(self, df: DataFrame, keys: list[str], limit: int | None = None):
        self.keys = list(keys)
        self.limit = limit or rows_per_task(df.sparkSession)
        self.plain: DataFrame = df
        self.long: DataFrame | None = None
        self._tasks = 0
        self._few = True
        self._split(df)

    @classmethod
    def fitting(cls, df: DataFrame, keys: list[str]) -> Keyed:
        """Rows whose keys are known to fit a task, taken without counting them."""
        known = object.__new__(cls)
        known.keys, known.limit, known._tasks, known._few = list(keys), 0, 0, True
        known.plain, known.long = df, None
        return known

    def _split(self, df: DataFrame) -> None:
        heavy = (
            df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > self.limit)
        )
        found = heavy.agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first()
        if not found["keys"]:
            return
        names = checkpoint(heavy.select(*self.keys))
        self._few = found["keys"] <= BROADCAST_KEYS
        names = self._small(names)
        self.plain = df.join(names, self.keys, "left_anti")
        self.long = df.join(names, self.keys, "left_semi")
        shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self._tasks = max(shuffle, math.ceil(2 * found["rows"] / self.limit))

    def _small(self, per_long_key: DataFrame) -> DataFrame:
        """One row per long key: sent to all tasks while their counted number
        allows it, else left to a shuffled join."""
        return F.broadcast(per_long_key) if self._few else per_long_key

    def _like(self, plain: DataFrame, long: DataFrame | None, keys: list[str] | None = None) -> Keyed:
        other = object.__new__(Keyed)
        other.keys, other.limit = keys or self.keys, self.limit
        other._tasks, other._few = self._tasks, self._few
        other.plain, other.long = plain, long
        return other

    def long_only(self) -> Keyed:
        """Just the keys that do not fit a task."""
        return self._like(self.plain.limit(0), self.long)

    def transform(self, change: Callable[[DataFrame], DataFrame]) -> Keyed:
        """The same row-wise change on both parts."""
        return self._like(change(self.plain), None if self.long is None else change(self.long))

    def within(self, more: list[str]) -> Keyed:
        """Narrower keys. What fits a task still does, so only the long part is counted again."""
        keys = [*self.keys, *more]
        if self.long is None:
            return self._like(self.plain, None, keys)
        inner = Keyed(self.long, keys, self.limit)
        inner.plain = self.plain.unionByName(inner.plain)
        return inner

    def running(
        self, order: list[str], descending: bool = False, **values: Sum | Last | Prev
    ) -> Keyed:
        """Adds running values along ``order``, which must leave no ties."""
        plain = self.plain.withColumns(_local(values, self.keys, _sorted_by(order, descending)))
        if self.long is None:
            return self._like(plain, None)
        return self._like(plain, self._running_long(order, descending, values))

    def _running_long(self, order, descending, values) -> DataFrame:
        # Chunk numbers come from sampled range bounds, so they are pinned in a
        # checkpoint before two branches read them.
        by = _sorted_by(order, descending)
        cut = checkpoint(
            self.long.repartitionByRange(self._tasks, *self.keys, *by)
            .withColumn(CHUNK, F.spark_partition_id())
        )
        keys = [*self.keys, CHUNK]
        local = cut.withColumns(
            _local(values, keys, by)
            | {"_first": F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) == 1}
        )
        position = F.struct(*order)
        latest = F.min_by if descending else F.max_by
        summary = cut.groupBy(*keys).agg(
            *[
                F.sum(F.coalesce(v.value, F.lit(0))).alias(f"_s_{name}")
                if isinstance(v, Sum)
                # Boxed, so that a null value of the last row stays a value.
                else latest(
                    F.struct(v.value.alias("v")),
                    position if isinstance(v, Prev) else F.when(v.value.isNotNull(), position),
                ).alias(f"_s_{name}")
                for name, v in values.items()
            ]
        )
        earlier = (
            Window.partitionBy(*self.keys).orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = summary.select(
            *keys,
            *[
                (F.sum(f"_s_{name}") if isinstance(v, Sum) else F.last(f"_s_{name}", True))
                .over(earlier).alias(f"_c_{name}")
                for name, v in values.items()
            ],
        )
        result = {}
        for name, v in values.items():
            carried = F.col(f"_c_{name}")
            if isinstance(v, Sum):
                result[name] = F.col(name) + F.coalesce(carried, F.lit(0))
            elif isinstance(v, Prev):
                # Only the first row of a chunk looks into the chunk before.
                result[name] = F.when(F.col("_first"), carried["v"]).otherwise(F.col(name))
            else:
                result[name] = F.coalesce(F.col(name), carried["v"])
        return (
            local.join(carry, keys, "left").withColumns(result)
            .drop(CHUNK, "_first", *[f"_c_{name}" for name in values])
        )

    def totals(self, **aggregates: Column) -> Keyed:
        """Adds aggregates over the whole key to every row of it."""
        whole = Window.partitionBy(*self.keys)
        plain = self.plain.withColumns({n: a.over(whole) for n, a in aggregates.items()})
        if self.long is None:
            return self._like(plain, None)
        sums = self.long.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggregates.items()])
        return self._like(plain, self.long.join(self._small(sums), self.keys, "left"))

    def rows(self) -> DataFrame:
        return self.plain if self.long is None else self.plain.unionByName(self.long)


def _sorted_by(order: list[str], descending: bool) -> list[Column]:
    return [F.desc(name) if descending else F.asc(name) for name in order]


def _local(values, keys, order) -> dict[str, Column]:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    columns = {}
    for name, v in values.items():
        if isinstance(v, Sum):
            columns[name] = F.sum(F.coalesce(v.value, F.lit(0))).over(upto)
        elif isinstance(v, Prev):
            columns[name] = F.lag(v.value).over(window)
        else:
            columns[name] = F.last(v.value, True).over(before if v.before else upto)
    return columns
