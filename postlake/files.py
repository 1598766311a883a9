"""Folders of a shared file system, by the Hadoop client that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    path, fs = _at(spark, folder)
    return [str(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    path, fs = _at(spark, folder)
    fs.delete(path, True)


def rename(spark: SparkSession, folder: str, to: str) -> None:
    """Moves a folder to a name that is free; OSError if it is not, so of two writers one is told."""
    path, fs = _at(spark, folder)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(path, target):
        raise OSError(f"{to} could not be named")


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` that all executors share; only a session of one machine may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/checkpoints"


class Scratch:
    """A folder of working tables. Without a name it lies in the shared folder, and what is left of it at the end goes."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.last = spark, folder or f"{shared(spark)}/postlake-work-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def written(self, df: DataFrame, name: str = "t", over: DataFrame | None = None) -> DataFrame:
        """The rows written and read again: lineage ends, and a lost executor costs nothing. ``over``: a table of this folder that is not needed any more."""
        self.last += 1
        path = f"{self.folder}/{name}-{self.last}"
        df.write.parquet(path)
        if over is not None:
            for folder in {f.rsplit("/", 1)[0] for f in over.inputFiles()}:
                remove(self.spark, folder)
        return self.spark.read.schema(df.schema).parquet(path)


def result(df: DataFrame) -> DataFrame:
    """A result that outlives its working tables, as a table in the shared folder."""
    path = f"{shared(df.sparkSession)}/postlake-result-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
