"""Where queries and their DuckDB twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.adapters import EMAILS_SQL, events_as_emails

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, emails: bool = True):
    """Registers a query over the events as messages (``emails``), or over (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = (lambda s, d: f(events_as_emails(read(s, d, "events")))) if emails else f
        if sql:
            ORACLES[name] = (f"WITH {EMAILS_SQL} " if emails else "") + sql
        return f

    return add
