"""Account names out of an accounts database: each account's own or, for want of one, its nearest ancestor's."""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ancestors looked at, the account itself included.
HOPS = 5
SCHEMA = "pk long, identifier string, description string, username string, parent long"
#: Where the database holds these.
_QUERY = "SELECT Z_PK, ZIDENTIFIER, ZACCOUNTDESCRIPTION, ZUSERNAME, ZPARENTACCOUNT FROM ZACCOUNT"


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The account rows of a database file, opened read-only; none if it is missing, unreadable or of another shape."""
    found: list = []
    if Path(path).is_file():
        try:
            con = sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro&immutable=1", uri=True)
            try:
                found = con.execute(_QUERY).fetchall()
            finally:
                con.close()
        except sqlite3.Error:
            found = []
    return spark.createDataFrame([tuple(r) for r in found], SCHEMA) if found else spark.range(0).select(*(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SCHEMA.split(", ")))


def names(accounts: DataFrame) -> DataFrame:
    """account_uuid, account_name: the first non-blank description or user name on the way up; a cycle ends the way.

    A fixed number of left joins on the parent; accounts are few.
    """
    own = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.nullif(F.trim("username"), F.lit("")))
    base = accounts.select("pk", "identifier", "parent", own.alias("name"))
    up = base.select(F.col("pk").alias("up_pk"), F.col("parent").alias("up_parent"), F.col("name").alias("up_name"))
    at = base.where("identifier is not null and identifier <> ''").select("pk", "identifier", "name", "parent", F.array("pk").alias("seen"))
    for _ in range(HOPS - 1):
        step = at.join(up, at["parent"] == up["up_pk"], "left")
        fresh = F.col("up_pk").isNotNull() & ~F.array_contains("seen", F.col("up_pk")) & F.col("name").isNull()
        at = step.select("pk", "identifier", F.coalesce("name", F.when(fresh, F.col("up_name"))).alias("name"), F.when(fresh, F.col("up_parent")).alias("parent"), F.when(fresh, F.concat("seen", F.array("up_pk"))).otherwise(F.col("seen")).alias("seen"))
    return at.where("name is not null").select(F.col("identifier").alias("account_uuid"), F.col("name").alias("account_name")).distinct()
