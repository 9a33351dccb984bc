"""State and settings as text: the same state is the same bytes on every device.

A file is a line per entry. Entries are in order of their key, the camera nobody
could identify first; fields are parted by tabs, with backslash, tab and line
ends escaped and a null as ``\\N``; numbers are decimal, times are instants in UTC.
So the digest of a file changes only with what it says, and a device that has
merged a file finds nothing to do at the next sync.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.sinks.documents import iso_time


def _field(value: Column) -> Column:
    text = value.cast("string")
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(text, F.lit("\\N"))


def _documents(rows: DataFrame, by: list[str], key: Column, fields: list[Column]) -> DataFrame:
    line = F.concat(F.concat_ws("\t", *map(_field, fields)), F.lit("\n"))
    # Null sorts first; the line settles what one key has twice.
    entries = F.array_sort(F.collect_list(F.struct(key.isNotNull().alias("known"), key.alias("key"), line.alias("line"))))
    document = F.array_join(F.transform(entries, lambda e: e["line"]), "")
    return rows.groupBy(*by).agg(document.alias("document")).withColumn(
        "digest", F.md5(F.col("document").cast("binary")))


def state_documents(states: DataFrame, by: list[str], key: str = "camera_key") -> DataFrame:
    """``by, document, digest``: the import states of each file.

    ``states(by.., camera_key, last_file, import_no, at_us, device)``; a file has
    a line per camera and has to fit a task.
    """
    k = F.col(key).cast("string")
    return _documents(states, by, k, [k, F.col("last_file"), F.col("import_no"), iso_time(F.col("at_us")), F.col("device")])


def setting_documents(settings: DataFrame, by: list[str]) -> DataFrame:
    """``by, document, digest``: the settings of each file, of
    ``settings(by.., skey, svalue, changed_us)``."""
    return _documents(settings, by, F.col("skey"), [F.col("skey"), F.col("svalue"), iso_time(F.col("changed_us"))])
