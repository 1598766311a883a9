"""Named files out of rows: ``df.write.format("named_files")`` of filename and content, written by the tasks themselves.

A file is written aside and moved to its name once it is whole, so neither a reader nor a lost or repeated task ever
sees half of one; a task that runs again moves the same names. What is left aside goes when the job commits or aborts.
Folders may lie on any file system that pyarrow knows by its address, as seen by the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSystem
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.aside = folder.rstrip("/"), f"_aside-{uuid.uuid4().hex}"

    def _at(self):
        fs, folder = FileSystem.from_uri(self.folder)
        return fs, folder

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, folder = self._at()
        mine, n = f"{folder}/{self.aside}/{uuid.uuid4().hex}", 0
        fs.create_dir(mine, recursive=True)
        for r in iterator:
            with fs.open_output_stream(f"{mine}/file") as f:
                f.write(r["content"] if isinstance(r["content"], (bytes, bytearray)) else (r["content"] or "").encode())
            fs.move(f"{mine}/file", f"{folder}/{r['filename']}")
            n += 1
        return Written(n)

    def _cleared(self) -> None:
        fs, folder = self._at()
        fs.create_dir(f"{folder}/{self.aside}", recursive=True)
        fs.delete_dir(f"{folder}/{self.aside}")

    def commit(self, messages: list[Written | None]) -> None:
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
