"""A folder of documents as a sink: one file per row, all of them or none.

Every task writes into a folder of its own below a hidden one; its commit
message names that folder. Only when all tasks are through are the files moved
to where they are read, so neither a repeated nor a failed attempt is ever seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "track_folder"
_PENDING = ".pending-"
_MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its files."""

    folder: str


class _FolderWriter(DataSourceWriter):
    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace = folder, replace
        self.pending = f"{_PENDING}{uuid.uuid4().hex}"

    def _target(self):
        system, inside = fs.FileSystem.from_uri(self.folder)
        return system, inside.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        system, inside = self._target()
        attempt = f"{self.pending}/{uuid.uuid4().hex}"
        system.create_dir(f"{inside}/{attempt}", recursive=True)
        for row in rows:
            if "/" in row.file or row.file.startswith("."):
                raise ValueError(f"not a name of a file in a folder: {row.file}")
            with system.open_output_stream(f"{inside}/{attempt}/{row.file}") as out:
                out.write((row.document or "").encode("utf-8"))
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        system, inside = self._target()
        system.create_dir(inside, recursive=True)
        attempts = [f"{inside}/{m.folder}" for m in messages if m is not None]
        files = (f for a in attempts for f in system.get_file_info(fs.FileSelector(a)))
        if not self.replace:
            there = {f.base_name for f in system.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File}
            files = list(files)
            both = sorted(there & {f.base_name for f in files})
            if both:
                raise FileExistsError(f"{self.folder}/{both[0]}")
        with ThreadPoolExecutor(_MOVERS) as movers:
            for _ in movers.map(lambda f: system.move(f.path, f"{inside}/{f.base_name}"), files):
                pass
        self._forget(system, inside)

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*self._target())

    def _forget(self, system, inside: str) -> None:
        if system.get_file_info(f"{inside}/{self.pending}").type != fs.FileType.NotFound:
            system.delete_dir(f"{inside}/{self.pending}")


class TrackFolder(DataSource):
    """``file, document`` rows as files of the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FolderWriter(self.options["path"], overwrite)


def write_files(documents: DataFrame, folder: str, replace: bool = True) -> None:
    """Writes ``file, document``. With ``replace``, files of the same names are
    replaced; without it they make the write fail. Others stay as they are."""
    documents.sparkSession.dataSource.register(TrackFolder)
    mode = "overwrite" if replace else "append"
    documents.select("file", "document").write.format(FORMAT).mode(mode).option("path", folder).save()
