"""Keeping a keyed table current: inventory diff, policy merge, dead letters. All are equi joins on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_diff(disk: DataFrame, known: DataFrame) -> DataFrame:
    """path, change (added, deleted, changed, unchanged, moved), old_path. Both sides: path, rowid, account, mtime, size.

    An added row whose (account, rowid) is that of exactly one deleted row is that row moved.
    """
    old = known.select("path", *(F.col(c).alias(f"o_{c}") for c in ("rowid", "account", "mtime", "size")))
    both = disk.join(old, "path", "full")
    change = F.when(F.col("o_mtime").isNull() & F.col("o_size").isNull(), "added").when(F.col("mtime").isNull() & F.col("size").isNull(), "deleted").when((F.col("mtime") != F.col("o_mtime")) | (F.col("size") != F.col("o_size")), "changed").otherwise("unchanged")
    d = both.select("path", change.alias("change"), F.coalesce("rowid", "o_rowid").alias("rowid"), F.coalesce("account", "o_account").alias("account"))
    gone = d.where("change = 'deleted'").groupBy("account", "rowid").agg(F.max("path").alias("old_path"), F.count("*").alias("n")).where("n = 1").select("account", "rowid", "old_path")
    new = d.where("change = 'added'").join(gone, ["account", "rowid"], "left").select("path", F.when(F.col("old_path").isNull(), "added").otherwise("moved").alias("change"), "old_path")
    moved = new.where("change = 'moved'").select(F.col("old_path").alias("path"))
    rest = d.where("change <> 'added'").join(moved, "path", "left_anti").select("path", "change", F.lit(None).cast("string").alias("old_path"))
    return new.unionByName(rest)


def merge(existing: DataFrame, changes: DataFrame, key: str, kept: tuple[str, ...] = (), reset: dict | None = None) -> DataFrame:
    """Upsert: changed rows overwrite all columns but ``kept`` ones, and set ``reset`` ones."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"n_{c}") for c in changes.columns if c != key), F.lit(True).alias("_hit"))
    out = [F.col(key)]
    for c in existing.columns:
        if c == key:
            continue
        value = F.col(c)
        if c in (reset or {}):
            value = F.when(F.col("_hit"), F.lit(reset[c])).otherwise(F.col(c))
        elif c not in kept and c in changes.columns:
            value = F.when(F.col("_hit"), F.col(f"n_{c}")).otherwise(F.col(c))
        out.append(value.alias(c))
    return existing.join(new, key, "full").select(*out)


def dead_letters(known: DataFrame, failed: DataFrame, succeeded: DataFrame, now: int) -> DataFrame:
    """path, error, attempts, first_seen, last_seen after a run: failures counted up, successes cleared."""
    f = failed.groupBy("path").agg(F.max("error").alias("n_error"))
    k = known.join(f, "path", "full").join(succeeded.select("path").distinct(), "path", "left_anti")
    hit = F.col("n_error").isNotNull()
    return k.select("path", F.coalesce("n_error", "error").alias("error"), (F.coalesce("attempts", F.lit(0)) + hit.cast("int")).alias("attempts"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(hit, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"))
