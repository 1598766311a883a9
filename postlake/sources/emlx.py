"""Mail trees as a Spark data source: ``spark.read.format("emlx")``, and a stream of added, changed and deleted files.

Both give a row a file: path, mtime_us, size, change, and the parsed fields of ``mail.messages``. The reader lists a tree
and deals its files to tasks, which read and parse them. The stream's offset is the number of a listing that is kept in
the folder of the option ``listings`` (on a shared file system, one for each query): a micro-batch is the difference of
two of them, so rewritten and deleted files are reported, and a batch that runs again after a failure has the same files.

Trees may lie on any file system that pyarrow knows by its address.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from postlake.sources import mail

SCHEMA = "path string, mtime_us long, size long, change string, " + mail.DDL.removeprefix("path string, ")
_ARROW = pa.schema([("path", pa.string()), ("mtime_us", pa.int64()), ("size", pa.int64()), ("change", pa.string()), *list(mail.PARSED)[1:]])
#: Files of a task, and rows that leave it at once.
FILES, ROWS = 500, 200


def listed(root: str) -> dict[str, tuple[int, int]]:
    """mtime_us and size of each message file below a folder."""
    fs, at = FileSystem.from_uri(root)
    found = fs.get_file_info(FileSelector(at, recursive=True, allow_not_found=True))
    name = lambda f: f.base_name.removesuffix(".emlx").removesuffix(".partial")
    # Milliseconds, as Spark's own listing has them.
    return {f.path: (f.mtime_ns // 1_000_000 * 1000, f.size) for f in found if f.type == FileType.File and f.base_name.endswith(".emlx") and name(f).isdigit()}


@dataclass
class Files(InputPartition):
    """Some files of a tree: path, mtime_us, size, change."""

    root: str
    rows: tuple[tuple[str, int, int, str], ...]

    def read(self) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(self.root)
        for a in range(0, len(self.rows), ROWS):
            out = []
            for path, mtime, size, change in self.rows[a : a + ROWS]:
                row = {"path": path, "mtime_us": mtime, "size": size, "change": change}
                if change != "deleted":
                    try:
                        with fs.open_input_stream(path) as f:
                            row |= mail.parsed(f.read(), path.endswith(".partial.emlx"))
                    except Exception as e:  # a broken or vanished file must not end the job; it becomes a dead letter
                        row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _ARROW)


def _dealt(root: str, rows: list[tuple[str, int, int, str]], each: int) -> list[Files]:
    return [Files(root, tuple(rows[a : a + each])) for a in range(0, len(rows), each)] or [Files(root, ())]


def difference(old: dict, new: dict) -> list[tuple[str, int, int, str]]:
    """path, mtime_us, size, change of what is not the same in two listings, by path."""
    put = [(p, *at, "changed" if p in old else "added") for p, at in new.items() if old.get(p) != at]
    return sorted(put + [(p, *at, "deleted") for p, at in old.items() if p not in new])


class Emlx(DataSource):
    """Options: path; ``files``, of a task at most; for streams ``listings``, a folder."""

    @classmethod
    def name(cls) -> str:
        return "emlx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.each = options["path"], int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        return _dealt(self.root, difference({}, listed(self.root)), self.each)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return partition.read()


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.each = options["path"], int(options.get("files", FILES))
        self.fs, self.folder = FileSystem.from_uri(options["listings"])
        self.fs.create_dir(self.folder, recursive=True)

    def _kept(self) -> list[int]:
        return sorted(int(f.base_name) for f in self.fs.get_file_info(FileSelector(self.folder)) if f.base_name.isdigit())

    def _listing(self, n: int) -> dict[str, tuple[int, int]]:
        if not n:
            return {}
        with self.fs.open_input_stream(f"{self.folder}/{n}") as f:
            return {p: tuple(at) for p, at in json.loads(f.read()).items()}

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the newest listing; a new one where the tree has changed, named once it is whole."""
        last = max(self._kept(), default=0)
        now = listed(self.root)
        if now == self._listing(last):
            return {"listing": last}
        with self.fs.open_output_stream(f"{self.folder}/new") as f:
            f.write(json.dumps(now).encode())
        self.fs.move(f"{self.folder}/new", f"{self.folder}/{last + 1}")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt(self.root, difference(self._listing(start["listing"]), self._listing(end["listing"])), self.each)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return partition.read()

    def commit(self, end: dict) -> None:
        for n in self._kept():
            if n < end["listing"]:
                self.fs.delete_file(f"{self.folder}/{n}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Emlx)


def placed(rows: DataFrame) -> DataFrame:
    """Rows of the source with rowid, account, mailbox and partial, as ``mail.files`` has them."""
    from pyspark.sql import functions as F

    number = F.regexp_extract("path", r"/(\d+)(\.partial)?\.emlx$", 1)
    return rows.withColumns({"rowid": number.cast("long"), **mail.place(), "partial": F.col("path").endswith(".partial.emlx")})
