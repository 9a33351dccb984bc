"""File names, camera identities and small text settings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types a card is searched for.
DEFAULT_EXTENSIONS = ["raf", "jpg", "jpeg", "mov", "mp4"]
MEDIA_EXTENSIONS = DEFAULT_EXTENSIONS + [
    "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "pef",
    "srw", "rwl", "3fr", "heic", "heif", "hif", "tif", "tiff", "mts", "m2ts", "avi", "mkv",
]
# Types whose capture data every reader can get at.
READABLE_EXTENSIONS = ["jpg", "jpeg"]
# Fixed value: folder names on a camera card.
CARD_FOLDER = r"^\d{3}[0-9A-Za-z_]{5}$"

MAX_INT = 2_147_483_647


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    """The name before its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _digits(name: Column) -> Column:
    return F.regexp_extract(stem(name), r"(\d+)(?!.*\d)", 1)


def seq_no(name: Column) -> Column:
    """The camera's counter: the last run of digits, null beyond 32 bits."""
    return F.nullif(_digits(name), F.lit("")).try_cast("int").cast("long")


def seq_width(name: Column) -> Column:
    return F.when(seq_no(name).isNotNull(), F.length(_digits(name)))


def counter_modulus(width: Column) -> Column:
    """Where a counter of that many digits starts over."""
    return F.least(F.pow(F.lit(10.0), width), F.lit(float(MAX_INT))).cast("long")


def is_later(name: Column, than: Column) -> Column:
    """Whether ``name`` follows ``than`` in the numbering of a camera.

    The shorter way round the counter decides; equal numbers go by name.
    """
    return is_place_later(place_of(name), place_of(than))


def place_of(name: Column) -> Column:
    """What ``is_later`` looks at of a name."""
    return F.struct(seq_no(name).alias("no"), seq_width(name).alias("width"), F.lower(name).alias("low"))


def is_place_later(place: Column, than: Column) -> Column:
    """``is_later`` of two names by what ``place_of`` made of them."""
    d = place["no"] - than["no"]
    size = counter_modulus(F.greatest(place["width"], than["width"]))
    ahead = (
        F.when(d == 0, place["low"] >= than["low"])
        .when(d > 0, d * 2 < size)
        .otherwise(d * 2 <= -size)
    )
    return F.coalesce(ahead, F.lit(False))


def clean_text(value: Column) -> Column:
    """NUL and runs of white space to one blank, trimmed; blank to null."""
    spaced = F.regexp_replace(F.regexp_replace(value, "\\x00", " "), r"\s+", " ")
    return F.nullif(F.trim(spaced), F.lit(""))


def _model_without_make(make: Column, model: Column) -> Column:
    rest = F.nullif(F.trim(F.substring(model, F.length(make) + 1, F.length(model))), F.lit(""))
    return F.when(F.startswith(F.lower(model), F.lower(make)), rest).otherwise(model)


def camera_key(make: Column, model: Column, serial: Column) -> Column:
    """Stable identity of a camera; null when nothing identifies it."""
    make, model, serial = clean_text(make), clean_text(model), clean_text(serial)
    parts = F.array(make, _model_without_make(make, model), serial)
    safe = F.transform(
        parts, lambda p: F.regexp_replace(F.regexp_replace(p, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    )
    return F.nullif(F.array_join(F.filter(safe, lambda p: F.length(p) > 0), "_"), F.lit(""))


def camera_label(make: Column, model: Column, serial: Column) -> Column:
    make, model, serial = clean_text(make), clean_text(model), clean_text(serial)
    head = F.concat_ws(" ", make, _model_without_make(make, model))
    return F.concat(head, F.coalesce(F.concat(F.lit(" ("), serial, F.lit(")")), F.lit("")))


def parse_types(text: Column) -> Column:
    """``"jpg, .MOV"`` to ``[jpg, mov]``."""
    trimmed = F.transform(
        F.split(text, ","), lambda t: F.lower(F.regexp_replace(F.trim(t), r"^\.", ""))
    )
    return F.array_distinct(F.filter(trimmed, lambda t: F.length(t) > 0))


def import_no(folder: Column) -> Column:
    """The number of an ``Import N`` folder, else null."""
    return F.nullif(F.regexp_extract(folder, r"^Import ([+-]?\d+)$", 1), F.lit("")).try_cast("int")


def import_name(number: Column) -> Column:
    return F.format_string("Import %02d", number.cast("int"))


def is_syncable(name: Column) -> Column:
    return (F.length(name) > 0) & ~name.rlike(r"[\t\n\r]")
