"""Files of a folder, whatever their names, listed and read in tasks.

Spark's own file sources leave out every name that begins with ``_`` or ``.``.
Cameras in Adobe RGB write ``_DSC0001.NEF``, so listings are made here: a folder
is a row, a task lists it, and the files that are wanted are read by the tasks
they are dealt to. Paths are those of pyarrow's file systems (local, s3, gs,
hdfs); any other scheme fails instead of listing less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTED = "path string, name string, folder string, is_folder boolean, modified timestamp, size long"
_CHUNK = 1 << 20
# Characters of files that are handed on together.
_TOGETHER = 1 << 20


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for root in batch["path"]:
            system, inside = fs.FileSystem.from_uri(root)
            info = system.get_file_info(inside)
            if info.type == fs.FileType.NotFound:
                found = []
            elif info.type == fs.FileType.Directory:
                found = system.get_file_info(fs.FileSelector(inside))
            else:
                found, root = [info], root.rsplit("/", 1)[0]
            if not found:
                continue
            base = root.rstrip("/")
            yield pd.DataFrame({
                "path": [f"{base}/{f.base_name}" for f in found], "name": [f.base_name for f in found],
                "folder": [base.rsplit("/", 1)[-1]] * len(found),
                "is_folder": [f.type == fs.FileType.Directory for f in found],
                "modified": pd.Series([f.mtime for f in found], dtype="datetime64[ns, UTC]"),
                "size": pd.Series([f.size for f in found], dtype="Int64"),
            })


def list_entries(spark: SparkSession, root: str, below: str | None = None) -> DataFrame:
    """``path, name, folder, modified, size`` of the files in a folder, of one
    file, or of nothing if it does not exist.

    With ``below``, files of the subfolders whose names match that pattern are
    listed instead, each subfolder by a task. Dot files belong to a file system
    or to an editor and are left out; no other name is.
    """
    found = spark.createDataFrame([(root,)], "path string").mapInPandas(_list, _LISTED)
    if below is not None:
        folders = found.filter(F.col("is_folder") & F.col("name").rlike(below)).select("path")
        found = _dealt(folders).mapInPandas(_list, _LISTED)
    return found.filter(~F.col("is_folder") & ~F.startswith("name", F.lit("."))).drop("is_folder")


def _dealt(rows: DataFrame) -> DataFrame:
    """Few rows of much work, spread over the tasks of a shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_text(entries: DataFrame) -> DataFrame:
    """Adds ``text``. Small files go together, larger ones alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, length, begin = [], 0, 0
            for i, path in enumerate(batch["path"]):
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inside) as stream:
                    texts.append(stream.read().decode("utf-8", "replace"))
                length += len(texts[-1])
                if length >= _TOGETHER or i + 1 == len(batch):
                    yield batch.iloc[begin:i + 1].assign(text=texts)
                    texts, length, begin = [], 0, i + 1

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return _dealt(entries).mapInPandas(read, f"{schema}, text string")


def with_size(entries: DataFrame) -> DataFrame:
    """Adds ``size``, in bytes; a file that is not there fails."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for path in batch["path"]:
                system, inside = fs.FileSystem.from_uri(path)
                info = system.get_file_info(inside)
                if info.type != fs.FileType.File:
                    raise FileNotFoundError(path)
                sizes.append(info.size)
            yield batch.assign(size=pd.Series(sizes, dtype="int64").values)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return _dealt(entries).mapInPandas(look, f"{schema}, size long")


def with_digest(entries: DataFrame) -> DataFrame:
    """Adds ``digest``, the MD5 of the content, read in pieces."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for path in batch["path"]:
                system, inside = fs.FileSystem.from_uri(path)
                digest = hashlib.md5()
                with system.open_input_stream(inside) as stream:
                    while piece := stream.read(_CHUNK):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({c: batch[c].tolist() for c in batch.columns} | {"digest": digests})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return _dealt(entries).mapInPandas(read, f"{schema}, digest string")
