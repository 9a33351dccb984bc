"""Distances and interpolation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lon) * F.sin(half_lon)
    # Not least(): that passes over the null of a missing neighbour.
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(h > 1.0, 1.0).otherwise(F.sqrt(h)))


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """``distance_m`` as SQL text, for plans built out of many expressions."""
    half_lat = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    half_lon = f"sin(radians({lon2} - {lon1}) / 2)"
    h = f"({half_lat} * {half_lat} + cos(radians({lat1})) * cos(radians({lat2})) * {half_lon} * {half_lon})"
    return f"{2 * EARTH_RADIUS_M}D * asin(case when {h} > 1 then 1.0D else sqrt({h}) end)"


def speed_sql(start_us: str, end_us: str, metres: str) -> str:
    """``step_speed`` as SQL text."""
    ms = f"(({end_us} - {start_us}) div 1000)"
    return f"case when {ms} > 0 then {metres} / ({ms} / 1000.0D) end"


def elapsed_ms(start_us: Column, end_us: Column) -> Column:
    """Whole milliseconds between two micro times, cut towards zero."""
    d = end_us - start_us
    return F.signum(d.cast("double")).cast("long") * F.floor(F.abs(d) / 1000).cast("long")


def floor_ms(t_us: Column) -> Column:
    """The millisecond an instant falls into."""
    return F.floor(t_us / 1000)


def step_speed(start_us: Column, end_us: Column, metres: Column) -> Column:
    """Metres per second over a step; null when time did not advance."""
    ms = elapsed_ms(start_us, end_us)
    return F.when(ms > 0, metres / (ms / F.lit(1000.0)))


def fraction(start_us: Column, end_us: Column, at_us: Column) -> Column:
    """How far along a step an instant is; 0 when the step takes no time."""
    span = elapsed_ms(start_us, end_us)
    return F.when(span == 0, F.lit(0.0)).otherwise(
        elapsed_ms(start_us, at_us).cast("double") / span
    )


def between(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def between_known(a: Column, b: Column, f: Column) -> Column:
    """Interpolated when both ends are known, else whichever is."""
    return F.when(a.isNotNull() & b.isNotNull(), between(a, b, f)).otherwise(F.coalesce(a, b))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a viewport; west > east means it crosses the antimeridian."""
    lon_inside = (
        (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    )
    return (lat >= south) & (lat <= north) & lon_inside
