"""The message store: versions of the message table in a folder, kept current from a mail tree by difference.

A build lists the tree, joins the listing with what is known, parses added and changed files only, moves and deletes by
key, counts broken files as dead letters and commits a new version by one rename; a crash leaves the old version.
Readers of a version keep it, as the last ``kept`` ones stay.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from postlake import files
from postlake.functions import text as fn
from postlake.operators import actions, analytics, embedding, ingest, threads
from postlake.operators.filters import included
from postlake.sources import mail

DAY = 86400
#: Paths that one listing may name; more files than that are found by a join.
NAMED = 10_000
INVENTORY = ("path", "rowid", "account", "mailbox", "mtime_us", "size")
#: What a change of the file does not touch, and what it resets.
KEPT, RESET = ("id", "flag_color", "attachment_text", "extract_state", "thread_id", "thread_position", "thread_depth", "account_name"), {"embed_state": 0}
DELTA = "id long, change string"
#: Change feeds that stay; who is further behind starts over.
FEEDS = 50
DEAD = "path string, error string, attempts int, first_seen long, last_seen long"


@dataclass
class Built:
    """Counts of one build, and the version it made."""

    added: int
    changed: int
    deleted: int
    moved: int
    failed: int
    version: int


class Store:
    """Versions of a message table, its dead letters, journal, vectors and state (a small map) in one folder, and what each version changed.

    ``lock`` is held by whoever reads a version to write the next one; two processes cannot both name one, so the later one fails.
    """

    def __init__(self, spark: SparkSession, path: str, kept: int = 2):
        self.spark, self.path, self.kept, self.lock = spark, path.rstrip("/"), kept, threading.RLock()

    def _numbered(self, folder: str) -> list[int]:
        return sorted(int(n[1:]) for n in files.names(self.spark, folder) if n.startswith("v") and n[1:].isdigit())

    def versions(self) -> list[int]:
        return self._numbered(self.path)

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A table of the newest version; an empty one of ``schema`` before the first, or in a version that has none."""
        found = self.versions()
        if found and name in files.names(self.spark, f"{self.path}/v{found[-1]}"):
            return self.spark.read.parquet(f"{self.path}/v{found[-1]}/{name}")
        return self.spark.createDataFrame([], schema) if schema else None

    def emails(self) -> DataFrame | None:
        return self._read("emails")

    def dead(self) -> DataFrame:
        return self._read("dead", DEAD)

    def journal(self) -> DataFrame:
        return self._read("journal", actions.JOURNAL)

    def vectors(self) -> DataFrame:
        return self._read("vectors", embedding.VECTORS)

    def state(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self._read("state", "key string, value string").collect()}

    def outbox(self) -> DataFrame:
        """Messages that were written here and are not sent from here."""
        return self._read("outbox", actions.OUTBOX)

    def rules(self) -> DataFrame:
        return self._read("rules", actions.RULES)

    def mailboxes(self) -> DataFrame:
        """Mailboxes that were created here and need not hold a message."""
        return self._read("mailboxes", actions.MAILBOXES)

    def places(self) -> threads.Places | None:
        """What the next build's threads start from; None where a version has none."""
        found = self.versions()
        if not found or "nodes" not in files.names(self.spark, f"{self.path}/v{found[-1]}"):
            return None
        placed = self.emails().where("thread_id is not null").select("id", "thread_id", F.col("thread_position").alias("position"), F.col("thread_depth").alias("depth"))
        return threads.Places(self._read("nodes"), self._read("refs"), placed)

    def delta(self, after: int, upto: int) -> DataFrame | None:
        """id, change (put, gone) of the versions behind ``after`` up to ``upto``; None if a feed of them is not kept."""
        wanted = range(after + 1, upto + 1)
        if not {*wanted} <= {*self._numbered(f"{self.path}/deltas")}:
            return None
        return reduce(DataFrame.unionByName, (self.spark.read.schema(DELTA).parquet(f"{self.path}/deltas/v{k}") for k in wanted), self.spark.createDataFrame([], DELTA))

    def commit(self, emails: DataFrame, dead: DataFrame | None = None, state: dict[str, str] | None = None, delta: DataFrame | None = None, journal: DataFrame | None = None, vectors: DataFrame | None = None, places: threads.Places | None = None, outbox: DataFrame | None = None, rules: DataFrame | None = None, mailboxes: DataFrame | None = None) -> int:
        """Writes a version aside and names it once it is whole; then versions before the last ``kept`` go. Tables that are not given stay as they are.

        ``delta``: id, change (put, gone) of the rows whose text is new or that are no more.
        """
        found = self.versions()
        number, aside = (found[-1] + 1 if found else 1), f"{self.path}/new-{uuid.uuid4().hex}"
        emails.write.parquet(f"{aside}/emails")
        for name, given, old in (("dead", dead, self.dead), ("journal", journal, self.journal), ("vectors", vectors, self.vectors), ("outbox", outbox, self.outbox), ("rules", rules, self.rules), ("mailboxes", mailboxes, self.mailboxes)):
            (old() if given is None else given).write.parquet(f"{aside}/{name}")
        places = places or self.places()
        if places:
            places.nodes.write.parquet(f"{aside}/nodes")
            places.refs.write.parquet(f"{aside}/refs")
        pairs = self.state() | (state or {})
        self.spark.createDataFrame([*pairs.items()], "key string, value string").coalesce(1).write.parquet(f"{aside}/state")
        (self.spark.createDataFrame([], DELTA) if delta is None else delta).write.mode("overwrite").parquet(f"{self.path}/deltas/v{number}")
        files.rename(self.spark, aside, f"{self.path}/v{number}")
        for old in found[: max(0, len(found) + 1 - self.kept)]:
            files.remove(self.spark, f"{self.path}/v{old}")
        for old in self._numbered(f"{self.path}/deltas")[:-FEEDS]:
            files.remove(self.spark, f"{self.path}/deltas/v{old}")
        return number


def migrated(emails: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table of an older shape with the columns it lacks, null: schema evolution without rewriting old versions."""
    return emails.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in emails.columns})


SHAPE = {"id": "long", "rowid": "long", "account": "string", "mailbox": "string", "mtime_us": "long", "size": "long", "account_uuid": "string", "account_name": "string", "mailbox_name": "string", "mailbox_role": "string", "subject_norm": "string", "snippet": "string", "attachment_count": "int", "flag_color": "int", "attachment_text": "string", "extract_state": "int", "embed_state": "int", "thread_id": "long", "thread_position": "int", "thread_depth": "int", "indexed_at": "long"}


def _rows(found: DataFrame, now: int) -> DataFrame:
    """Parsed messages as rows of the store, broken files with their error only."""
    m = mail.messages(found).join(found.select(*INVENTORY), "path")
    return m.withColumns({
        "account_uuid": F.col("account"), "mailbox_name": F.element_at(F.split("mailbox", "/"), -1), "subject_norm": fn.normalize_subject(F.coalesce("subject", F.lit(""))),
        "snippet": F.left(F.coalesce("body_plain", F.lit("")), F.lit(512)), "attachment_count": F.size("attachments"), "embed_state": F.lit(0), "extract_state": F.lit(0), "indexed_at": F.lit(now).cast("long"),
    }).withColumn("mailbox_role", fn.mailbox_role(F.col("mailbox_name")))


def listing(spark: SparkSession, root: str, exclude: list[str] = (), include: list[str] | None = None, without: list[str] = (), most: int | None = None) -> DataFrame:
    """The files of a tree that the settings leave: mailboxes by name, accounts, and the newest ``most`` files of each mailbox."""
    name = F.element_at(F.split("mailbox", "/"), -1)
    out = mail.files(spark, root).where(included(name, list(exclude)))
    if include is not None:
        out = out.where(F.lower(name).isin([x.lower() for x in include]))
    if without:
        out = out.where(~F.coalesce(F.lower("account").isin([x.lower() for x in without]), F.lit(False)))
    if most is not None:
        newest = Window.partitionBy("account", "mailbox").orderBy(F.desc("mtime_us"), "path")
        kept = out.select("account", "mailbox", "mtime_us", "path").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
        out = out.join(kept.select("path"), "path", "left_semi")
    return out


def build(store: Store, root: str, now: int, exclude: list[str] = (), names: DataFrame | None = None, reparse: bool = False, by_subject: bool = True, include: list[str] | None = None, without: list[str] = (), most: int | None = None) -> Built:
    """Brings the store up to date with a mail tree. ``names``: account_uuid, account_name. ``reparse`` takes every file as changed. Else see ``listing``."""
    with store.lock:
        return _built(store, root, now, listing(store.spark, root, exclude, include, without, most), names, reparse, by_subject)


def _built(store: Store, root: str, now: int, disk: DataFrame, names: DataFrame | None, reparse: bool, by_subject: bool) -> Built:
    spark = store.spark
    old = store.emails()
    known = old if old is not None else _rows(disk.limit(0), now).drop("error")
    known = migrated(known, SHAPE)
    stamp = lambda df: df.select("path", "rowid", "account", F.col("mtime_us").alias("mtime"), "size")
    # Files that failed before stay out of the table, so they count as added until they can be read.
    diff = ingest.inventory_diff(stamp(disk), stamp(known))
    if reparse:
        diff = diff.withColumn("change", F.when(F.col("change") == "unchanged", "changed").otherwise(F.col("change")))
    folder = f"{store.path}/work-{uuid.uuid4().hex}"
    seen, broken_seen = Observation(), Observation()
    diff.observe(seen, *analytics.change_counts()).write.parquet(f"{folder}/diff")
    diff = spark.read.parquet(f"{folder}/diff")
    wanted = diff.where(F.col("change").isin("added", "changed")).select("path")
    paths = [r[0] for r in wanted.limit(NAMED + 1).collect()]
    # Few files are named, so the bytes of others are not read; many are found by a join.
    found = (mail.files(spark, paths) if paths else disk.limit(0)) if len(paths) <= NAMED else disk.join(wanted, "path", "left_semi")
    rows = _rows(found, now)
    if isinstance(root, str) and found.where("partial").limit(1).count():
        named_beside = mail.with_partial(rows, mail.partial_attachments(spark, root))
        rows = named_beside.withColumn("attachment_count", F.size("attachments"))
    rows.observe(broken_seen, F.count("error").alias("failed")).write.parquet(f"{folder}/parsed")
    parsed = spark.read.parquet(f"{folder}/parsed")
    good, bad = parsed.where("error is null").drop("error"), parsed.where("error is not null").select("path", "error")
    rest = deleted(moved(known, diff.where("change = 'moved'"), disk), diff.where("change = 'deleted'"))
    fresh = good.join(rest.select("path"), "path", "left_anti")
    first = (known.agg(F.max("id")).first()[0] or 0) + 1
    # Written here, so the numbers stay; they grow with each build and are never given twice.
    migrated(fresh.drop("id"), SHAPE).withColumn("id", F.lit(first) + F.monotonically_increasing_id()).write.parquet(f"{folder}/fresh")
    fresh = spark.read.parquet(f"{folder}/fresh")
    every = ingest.merge(rest, good.join(rest.select("path"), "path", "left_semi"), "path", KEPT, RESET).unionByName(fresh, allowMissingColumns=True)
    if names is not None:
        every = named(every, names)
    put = every.join(good.select("path"), "path", "left_semi").select("id", F.lit("put").alias("change"))
    gone = known.join(diff.where("change = 'deleted'").select("path"), "path", "left_semi").select("id", F.lit("gone").alias("change"))
    places, texts = None, put.unionByName(gone)
    if sum(v or 0 for v in seen.get.values()):
        every.write.parquet(f"{folder}/every")
        texts.write.parquet(f"{folder}/delta")
        every, texts = spark.read.parquet(f"{folder}/every"), spark.read.schema(DELTA).parquet(f"{folder}/delta")
        scratch, before = files.Scratch(spark, f"{folder}/threads"), store.places() if store.state().get("by_subject") == str(by_subject) else None
        # Only what a change touches is built again.
        places = threads.next_places(before, known, every, texts, scratch, by_subject) if before else threads.first_places(every, scratch, by_subject)
        every = threaded(every, places.placed)
    counts = {k: v or 0 for k, v in (seen.get | broken_seen.get).items()}
    broken = bad.select("path").join(diff.where("change = 'added'"), "path", "left_semi").count() if counts["failed"] else 0
    dead = ingest.dead_letters(store.dead(), bad, good.select("path"), now)
    version = store.commit(every, dead, {"last_build": str(now), "changes": str(int(store.state().get("changes", 0)) + counts["added"] + counts["changed"] + counts["deleted"] + counts["moved"]), "by_subject": str(by_subject)}, texts, places=places)
    files.remove(spark, folder)
    return Built(counts["added"] - broken, counts["changed"], counts["deleted"], counts["moved"], counts["failed"], version)


def moved(known: DataFrame, moves: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of moved files with their new place; nothing is parsed again."""
    at = moves.select(F.col("path").alias("new_path"), "old_path").join(disk.select(F.col("path").alias("new_path"), *(F.col(c).alias(f"new_{c}") for c in INVENTORY[1:])), "new_path")
    out = known.join(at, known["path"] == at["old_path"], "left")
    new = {c: F.coalesce(f"new_{c}", c) for c in INVENTORY}
    place = F.element_at(F.split("new_mailbox", "/"), -1)
    new |= {"account_uuid": F.coalesce("new_account", "account_uuid"), "mailbox_name": F.coalesce(place, "mailbox_name"), "mailbox_role": F.coalesce(fn.mailbox_role(place), "mailbox_role")}
    # The name of another account is not known here.
    new["account_name"] = F.when(F.col("new_account").isNull() | (F.col("new_account") == F.col("account_uuid")), F.col("account_name"))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in known.columns))


def deleted(known: DataFrame, gone: DataFrame) -> DataFrame:
    return known.join(gone.select("path"), "path", "left_anti")


def named(emails: DataFrame, names: DataFrame) -> DataFrame:
    """Account names filled in from account_uuid, account_name: a small table; a known name stays where there is no new one."""
    n = names.select("account_uuid", F.col("account_name").alias("_name")).dropDuplicates(["account_uuid"])
    return emails.join(F.broadcast(n) if n.count() <= 100_000 else n, "account_uuid", "left").withColumn("account_name", F.coalesce("_name", "account_name")).drop("_name")


def threaded(emails: DataFrame, placed: DataFrame) -> DataFrame:
    """Messages with the threads and positions of ``placed``."""
    at = placed.select("id", F.col("thread_id").alias("_t"), F.col("position").alias("_p"), F.col("depth").alias("_d"))
    return emails.join(at, "id", "left").withColumns({"thread_id": F.col("_t"), "thread_position": F.col("_p"), "thread_depth": F.col("_d")}).drop("_t", "_p", "_d")


def status(store: Store, root: str, now: int, exclude: list[str] = (), include: list[str] | None = None, without: list[str] = (), stale_after: float = DAY) -> dict:
    """Totals, dead letters, pending changes, and whether the store is stale: older than ``stale_after`` seconds, or with changes pending."""
    emails, last = store.emails(), store.state().get("last_build")
    disk = listing(store.spark, root, exclude, include, without)
    stamp = lambda df: df.select("path", "rowid", "account", F.col("mtime_us").alias("mtime"), "size")
    if emails is None:
        pending = disk.count()
        return {"total": 0, "embedded": 0, "failed": 0, "last_build": None, "pending": pending, "stale": True}
    counts = analytics.status_counts(emails, store.dead()).first()
    failed = store.dead().select("path")
    diff = ingest.inventory_diff(stamp(disk), stamp(emails)).where("change <> 'unchanged'").join(failed, "path", "left_anti")
    pending, age = diff.count(), now - int(last)
    return {**counts.asDict(), "last_build": int(last), "pending": pending, "stale": bool(age > stale_after or pending)}


def recoloured(emails: DataFrame, hit: Column, color: int | None) -> DataFrame:
    return emails.withColumn("flag_color", F.when(hit, F.lit(color).cast("int")).otherwise(F.col("flag_color")))


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON document a row, as the tools hand results out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def as_list(value: str | list | None) -> list:
    """A list parameter that may come as a JSON text or a bare string."""
    if value is None or isinstance(value, list):
        return value or []
    try:
        made = json.loads(value)
    except ValueError:
        return [value]
    return made if isinstance(made, list) else [value]
