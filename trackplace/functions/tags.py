"""Position tags: the numbers and texts written for a placed photo."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which writer takes which type.
BUILT_IN_TYPES = ["raf", "jpg", "jpeg", "mov", "mp4"]
EXIFTOOL_TYPES = [
    "cr2", "cr3", "nef", "nrw", "arw", "sr2", "srf", "dng", "orf", "rw2", "pef", "raw", "3fr",
    "iiq", "heic", "heif", "avif", "tif", "tiff", "png", "webp",
]

DEGREE_E4 = 36_000_000
MINUTE_E4 = 600_000


def _round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def seconds_e4(value: Column) -> Column:
    """Arc seconds in ten-thousandths, without the sign."""
    return _round_half_up(F.abs(value) * 3600.0 * 10000.0)


def dms(value: Column) -> Column:
    e4 = seconds_e4(value)
    return F.struct(
        F.floor(e4 / DEGREE_E4).alias("degrees"),
        F.floor(e4 % DEGREE_E4 / MINUTE_E4).alias("minutes"),
        (e4 % MINUTE_E4).alias("seconds_e4"),
    )


def dms_rational(value: Column) -> Column:
    parts = dms(value)
    return F.format_string(
        "%d/1,%d/1,%d/10000", parts["degrees"], parts["minutes"], parts["seconds_e4"]
    )


def lat_ref(lat: Column) -> Column:
    return F.when(lat >= 0, "N").otherwise("S")


def lon_ref(lon: Column) -> Column:
    return F.when(lon >= 0, "E").otherwise("W")


def alt_rational(ele: Column) -> Column:
    return F.when(
        ele.isNotNull(), F.concat(_round_half_up(F.abs(ele) * 1000).cast("string"), F.lit("/1000"))
    )


def alt_ref(ele: Column) -> Column:
    return F.when(ele < 0, "1").when(ele.isNotNull(), "0")


def gps_date(t_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(t_us), "yyyy:MM:dd")


def gps_time(t_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(t_us), "HH:mm:ss")


def _half_up(value: Column, digits: int) -> Column:
    """Rounded by its decimal digits, of which twelve count: 0.0004999999999999 is
    a half, and nothing is a negative zero."""
    return F.coalesce(F.round(value.try_cast("decimal(24,12)"), digits).cast("double"), value)


def iso6709(lat: Column, lon: Column, ele: Column) -> Column:
    altitude = F.when(ele.isNotNull(), F.format_string("%+08.3f", _half_up(ele, 3))).otherwise("")
    place = F.format_string("%+08.4f%+09.4f", _half_up(lat, 4), _half_up(lon, 4))
    return F.concat(place, altitude, F.lit("/"))


def xmp_coord(value: Column, positive: str, negative: str) -> Column:
    degrees = F.floor(F.abs(value))
    minutes = (F.abs(value) - degrees) * 60
    side = F.when(value >= 0, positive).otherwise(negative)
    return F.format_string("%d,%.6f%s", degrees, minutes, side)


def route_writer(ext: Column, built_in_only: bool = False) -> Column:
    """The first writer that takes a type; a sidecar takes every one."""
    routed = F.when(ext.isin(BUILT_IN_TYPES), "built-in").otherwise("sidecar")
    if built_in_only:
        return routed
    return F.when(ext.isin(EXIFTOOL_TYPES), "exiftool").otherwise(routed)
