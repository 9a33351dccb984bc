"""Listings of camera cards and synced folders, and tables of state and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.functions.names import CARD_FOLDER, DEFAULT_EXTENSIONS, camera_key, extension
from trackplace.functions.times import offset_seconds, parse_exif_time
from trackplace.sources.listing import list_entries, with_digest


def list_card(
    spark: SparkSession, root: str, extensions: list[str] = tuple(DEFAULT_EXTENSIONS)
) -> DataFrame:
    """Importable files directly inside the numbered folders of a card, without
    reading their content. A missing card is an empty listing."""
    found = list_entries(spark, root, below=CARD_FOLDER)
    return found.filter(extension(F.col("name")).isin(list(extensions)))


def file_manifest(spark: SparkSession, folder: str, accepts: str | None = None) -> DataFrame:
    """Name and MD5 of each file of a synced folder; ``accepts`` is a pattern."""
    found = list_entries(spark, folder)
    if accepts is not None:
        found = found.filter(F.col("name").rlike(accepts))
    return with_digest(found.select("path", "name")).select("name", "digest")


def read_photos(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A photo manifest whose capture data was extracted before.

    In: ``photo_id, subject_id, folder, name, exif_date`` (text), ``exif_zone``
    (text), ``created``, ``modified``, ``make, model, serial``. Unreadable dates
    and offsets become null.
    """
    reader = spark.read.option("header", "true") if file_format == "csv" else spark.read
    raw = reader.format(file_format).load(path)
    return raw.select(
        "photo_id", "subject_id", "folder", "name",
        parse_exif_time(F.col("exif_date")).alias("exif_local"),
        offset_seconds(F.col("exif_zone")).alias("exif_offset_s"),
        F.unix_micros(F.col("created").cast("timestamp")).alias("created_us"),
        F.unix_micros(F.col("modified").cast("timestamp")).alias("modified_us"),
        "make", "model", "serial",
    )


def usable_import_state(raw: DataFrame) -> DataFrame:
    """Resume states with every field they need; others are left out, not guessed.

    In, all text: ``make, model, serial, last_file, import_no, imported_at, device``.
    """
    named = F.coalesce("make", "model", "serial").isNotNull()
    key = camera_key(F.col("make"), F.col("model"), F.col("serial"))
    return raw.select(
        key.alias("camera_key"), "make", "model", "serial",
        F.nullif(F.col("last_file"), F.lit("")).alias("last_file"),
        F.col("import_no").try_cast("int").cast("long").alias("import_no"),
        F.unix_micros(F.col("imported_at").try_cast("timestamp")).alias("at_us"),
        F.coalesce("device", F.lit("")).alias("device"),
    ).filter(
        F.col("last_file").isNotNull() & F.col("import_no").isNotNull() & F.col("at_us").isNotNull()
        & (~named | F.col("camera_key").isNotNull())
    )


def usable_settings(raw: DataFrame) -> DataFrame:
    """Settings with a readable time of change (``subject_id, skey, svalue, changed_at``)."""
    return raw.select(
        "subject_id", "skey", "svalue",
        F.unix_micros(F.col("changed_at").try_cast("timestamp")).alias("changed_us"),
    ).filter(F.col("changed_us").isNotNull())


def read_import_state(spark: SparkSession, path: str) -> DataFrame:
    return usable_import_state(spark.read.parquet(path))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return usable_settings(spark.read.parquet(path))
