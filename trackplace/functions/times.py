"""Capture and recording times as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(?:[zZ]|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"
_ISO = r"^[+-]?\d{4,}-\d{2}-\d{2}[tT]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"


def parse_track_time(text: Column, zone: str) -> Column:
    """A time stamp of a track file: with an offset as it is, without one in
    ``zone``, null when it is neither."""
    t = F.trim(text)
    aware = F.when(t.rlike(_ISO + _OFFSET), t.try_cast("timestamp"))
    local = F.when(
        t.rlike(_ISO + "$"), F.to_utc_timestamp(t.try_cast("timestamp_ntz").cast("timestamp"), zone)
    )
    return F.coalesce(aware, local)


def parse_exif_time(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def offset_seconds(text: Column) -> Column:
    """``+02:00``, ``-0530``, ``+2`` or ``Z`` as seconds; anything else is no offset."""
    t = F.trim(text)
    sign = F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
    hours = F.nullif(F.regexp_extract(t, r"^[+-](\d{1,2})", 1), F.lit("")).try_cast("int")
    minutes = F.coalesce(
        F.nullif(F.regexp_extract(t, r"^[+-]\d{2}:?(\d{2})", 1), F.lit("")).try_cast("int"), F.lit(0)
    )
    seconds = F.coalesce(
        F.nullif(F.regexp_extract(t, r"^[+-]\d{2}:?\d{2}:?(\d{2})$", 1), F.lit("")).try_cast("int"),
        F.lit(0),
    )
    total = hours * 3600 + minutes * 60 + seconds
    valid = (
        t.rlike(r"^[+-](\d|\d{2}(:\d{2}(:\d{2})?)?|\d{4}|\d{6})$")
        & (minutes < 60) & (seconds < 60) & (total <= 18 * 3600)
    )
    return F.when(t.isin("Z", "z"), F.lit(0)).when(valid, sign * total)


def clock_offset_ms(minutes: float) -> int:
    """Minutes of clock error as milliseconds, cut towards zero."""
    return int(minutes * 60_000)


def _local_us(local: Column) -> Column:
    """Micros of a zoneless reading as if it were UTC (the session runs in UTC)."""
    return F.unix_micros(local.cast("timestamp"))


def _file_us(created_us: Column, modified_us: Column) -> Column:
    """The earlier of two file times, at the millisecond files are stamped with."""
    return F.floor(F.least(created_us, modified_us) / 1000) * 1000


def capture_us(
    exif_local: Column,
    exif_offset_s: Column,
    created_us: Column,
    modified_us: Column,
    zone: str | Column = "UTC",
    offset_ms: int | Column = 0,
) -> Column:
    """The instant to look for in a track: the camera's own offset, else the
    assumed zone, else the file times; then corrected for clock error."""
    with_offset = _local_us(exif_local) - exif_offset_s.cast("long") * 1_000_000
    in_zone = F.unix_micros(F.to_utc_timestamp(exif_local.cast("timestamp"), zone))
    correction = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms)
    return (
        F.coalesce(with_offset, in_zone, _file_us(created_us, modified_us))
        + correction.cast("long") * 1000
    )


def capture_local_us(
    exif_local: Column, created_us: Column, modified_us: Column, zone: str = "UTC"
) -> Column:
    """The reading of the camera clock itself, or the file times shown in ``zone``."""
    shown = F.from_utc_timestamp(F.timestamp_micros(_file_us(created_us, modified_us)), zone)
    return F.coalesce(_local_us(exif_local), F.unix_micros(shown))
