"""Views of a map over very many fixes: a layout by place, and scans that skip the rest.

Fixes are stored in order of a Z-curve: their longitude and latitude, cut into
2^16 steps each, with the bits in turn. A box is a number of stretches of that
curve, so a scan for a view asks for those and passes over every row group whose
least and greatest place lie between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.functions.geo import in_box

PLACE = "place"
BITS = 16
# Stretches a box is cut into at most; more follow its edge closer.
STRETCHES = 48
# Every second bit of 32, after each doubling of the distance.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _step(value: Column, low: float, width: float) -> Column:
    cut = F.floor((value - low) / width * 2**BITS).cast("long")
    # greatest() and least() pass over a null.
    return F.when(value.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.lit(2**BITS - 1).cast("long"), cut)))


def _spread(bits: Column) -> Column:
    for by, mask in _SPREAD:
        bits = bits.bitwiseOR(F.shiftleft(bits, by)).bitwiseAND(F.lit(mask))
    return bits


def place_on_curve(lat: Column, lon: Column) -> Column:
    """The place of a position on the curve; null without a position."""
    return _spread(_step(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 180.0)), 1))


def write_by_place(fixes: DataFrame, path: str, files: int | None = None) -> None:
    """Stores ``fixes`` in order of place, each file a stretch of the curve, with
    the column ``place``. A hot place is cut by track and number as well."""
    placed = fixes.withColumn(PLACE, place_on_curve(F.col("lat"), F.col("lon")))
    order = [PLACE, "track_id", "seq"]
    dealt = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _steps(low: float, high: float, least: float, width: float) -> tuple[int, int]:
    cut = lambda v: max(0, min(2**BITS - 1, int((v - least) / width * 2**BITS // 1)))
    return cut(low), cut(high)


def curve_stretches(
    south: float, west: float, north: float, east: float, stretches: int = STRETCHES,
) -> list[tuple[int, int]]:
    """Stretches of the curve (ends included) that hold every place of a box; two
    boxes where it crosses the antimeridian. Quarters of the world are cut into
    quarters, the largest first, while there is room; what lies outside is left out."""
    if west > east:
        parts = [(west, 180.0), (-180.0, east)]
        return _joined([s for w, e in parts for s in curve_stretches(south, w, north, e, stretches // 2)])
    (x0, x1), (y0, y1) = _steps(west, east, -180.0, 360.0), _steps(south, north, -90.0, 180.0)
    whole, edge = [], [(BITS, 0, 0, 0)]
    while edge and len(whole) + len(edge) < stretches:
        edge.sort()
        level, first, cx, cy = edge.pop()
        for quarter in range(4):
            half = 1 << (level - 1)
            x, y = cx + (quarter & 1) * half, cy + (quarter >> 1) * half
            if x > x1 or y > y1 or x + half <= x0 or y + half <= y0:
                continue
            at = first + quarter * half * half
            if level == 1 or x0 <= x and x + half - 1 <= x1 and y0 <= y and y + half - 1 <= y1:
                whole.append((at, at + half * half - 1))
            else:
                edge.append((level - 1, at, x, y))
    return _joined(whole + [(at, at + 4**level - 1) for level, at, _, _ in edge])


def _joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(parts):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def on_stretches(place: Column, stretches: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for low, high in stretches:
        found = found | place.between(low, high)
    return found


def fixes_in_view(
    spark: SparkSession, path: str, south: float, west: float, north: float, east: float,
) -> DataFrame:
    """The fixes of a table that ``write_by_place`` stored which lie in a box, all
    edges included; west > east means that it crosses the antimeridian."""
    stored = spark.read.parquet(path)
    near = stored.filter(on_stretches(F.col(PLACE), curve_stretches(south, west, north, east)))
    return near.filter(in_box(F.col("lat"), F.col("lon"), south, west, north, east)).drop(PLACE)
