"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session of one machine may lack it; it gets one under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and rereads it: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/postlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that one operator writes and rereads; their folder goes at the end, so results are written elsewhere before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/postlake-scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.folder)


def forget(df: DataFrame) -> None:
    """Deletes the files behind a table made by ``written``; call it once nothing reads the table any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan's input; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, each: int = 4 << 20, least: int = 64) -> int:
    """A power of two that grows with the input, so that a hash bucket stays as small at any size."""
    size, n = plan_bytes(df), least
    if size >= 1 << 60:  # Catalyst does not know: some kilobytes a row
        size = df.count() << 12
    while n * each < size:
        n *= 2
    return n


def plain_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    repeated = F.sum((F.col("doc_id").isNull() | (F.col("count") > 1)).cast("long"))
    return not docs.groupBy("doc_id").count().agg(repeated).first()[0]


def numbered(docs: DataFrame) -> DataFrame:
    """row (all columns), at: a number of its own for each row, in the order of doc_id; written, so that numbers stay."""
    return written(docs.select(F.struct("*").alias("row")).orderBy("row.doc_id").withColumn("at", F.monotonically_increasing_id()), "rows")
