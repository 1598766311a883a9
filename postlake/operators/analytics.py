"""Mailbox statistics. Each is one grouped aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import rounded
from postlake.operators.filters import COLORS, listed, predicate

#: The fields of a summary.
FIELDS = ("id", "message_id", "account", "mailbox", "mailbox_role", "subject", "sender_name", "sender_addr", "date_received", "snippet", "is_read", "is_flagged", "is_answered", "flag_color", "attachment_count", "thread_id")
SUMMARY = ("id", "message_id", "account_uuid", "mailbox_role", "sender_addr", "sender_name", "subject", "date_received", "is_read", "is_flagged", "attachment_count")


def summary() -> list[Column]:
    """The summary of a message; an empty account name counts as none."""
    given = {"account": F.coalesce(F.nullif("account_name", F.lit("")), F.col("account_uuid")), "mailbox": F.col("mailbox_name"), "flag_color": color_name(F.col("flag_color"))}
    return [given.get(c, F.col(c)).alias(c) for c in FIELDS]


def summaries(emails: DataFrame) -> DataFrame:
    """One summary a message; columns that a table lacks are null."""
    return _with_all(emails, FIELDS, ("account_uuid", "account_name", "mailbox_name")).select(*summary())


def full(emails: DataFrame) -> DataFrame:
    """Summaries with recipients, bodies, attachment names and references; headers are not kept, so there are none."""
    more = {"recipients_to": "array<string>", "recipients_cc": "array<string>", "body_plain": "string", "body_html": "string", "attachments": "array<string>", "references": "array<string>", "in_reply_to": "string", "date_sent": "long"}
    every = _with_all(emails, FIELDS, ("account_uuid", "account_name", "mailbox_name"))
    held = [(F.col(c) if c in emails.columns else F.lit(None).cast(t)).alias(c) for c, t in more.items()]
    return every.select(*summary(), *held, F.create_map().cast("map<string,string>").alias("headers"))


_TYPES = {"id": "long", "date_received": "long", "thread_id": "long", "flag_color": "int", "attachment_count": "int", "is_read": "boolean", "is_flagged": "boolean", "is_answered": "boolean"}


def _with_all(emails: DataFrame, *names: tuple[str, ...]) -> DataFrame:
    lacking = {c for group in names for c in group} - set(emails.columns) - {"account", "mailbox"}
    return emails.withColumns({c: F.lit(None).cast(_TYPES.get(c, "string")) for c in lacking}) if lacking else emails


def color_name(index: Column) -> Column:
    """The colour of a flag index; null for none and for one out of range."""
    return F.get(F.array(*map(F.lit, COLORS)), F.when((index >= 0) & (index < len(COLORS)), index))


def n_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


def top_senders(emails: DataFrame, limit: int = 10, since: int | None = None, **where) -> DataFrame:
    """Count, unread, newest date and the name of the newest message of the busiest senders; ties by address."""
    m = emails.where(predicate(after=since, **where)).where("sender_addr is not null")
    g = m.groupBy("sender_addr").agg(F.count("*").alias("n"), n_if(~F.col("is_read")).alias("unread"), F.max("date_received").alias("last_date"), F.max_by("sender_name", F.struct("date_received", "id")).alias("sender_name"))
    return g.orderBy(F.desc("n"), "sender_addr").limit(limit)


def inbox_counts(emails: DataFrame, as_of: int, account: str | None = None) -> DataFrame:
    m = emails.where(predicate(account=account)).where("mailbox_role = 'inbox'")
    return m.agg(F.count("*").alias("total"), n_if(~F.col("is_read")).alias("unread"), n_if(F.col("is_flagged")).alias("flagged"), n_if(listed("today", as_of)).alias("today"), n_if(listed("last_7_days", as_of)).alias("this_week"))


def by_account(emails: DataFrame) -> DataFrame:
    return emails.where("mailbox_role = 'inbox'").groupBy("account_uuid").agg(F.count("*").alias("total"), n_if(~F.col("is_read")).alias("unread"))


def account_statistics(emails: DataFrame, as_of: int, days: int = 30, account: str | None = None) -> DataFrame:
    m = emails.where(predicate(account=account, after=as_of - days * 86400))
    return m.agg(F.count("*").alias("total"), n_if(F.col("is_read")).alias("n_read"), n_if(F.col("is_flagged")).alias("flagged"), n_if(F.col("mailbox_role") == "sent").alias("sent"), F.coalesce(F.sum("attachment_count"), F.lit(0)).cast("long").alias("attachments"))


def read_percent(read: Column, total: Column) -> Column:
    """Of the messages, how many are read, to one decimal; 0 for none. Ties of the exact binary value round to even."""
    return F.when(total > 0, rounded(100.0 * read / total)).otherwise(0.0)


def account_overview(emails: DataFrame, as_of: int, days: int = 30, account: str | None = None) -> DataFrame:
    """total, read_pct, flagged, sent, attachments of the last days."""
    s = account_statistics(emails, as_of, days, account)
    return s.select("total", read_percent(F.col("n_read"), F.col("total")).alias("read_pct"), "flagged", "sent", "attachments")


def sender_statistics(emails: DataFrame, sender: str, as_of: int, days: int = 30) -> DataFrame:
    m = emails.where((F.col("sender_addr") == sender) & (F.col("date_received") >= as_of - days * 86400))
    return m.agg(F.count("*").alias("total"), F.coalesce(F.sum("attachment_count"), F.lit(0)).cast("long").alias("attachments"))


def mailbox_breakdown(emails: DataFrame) -> DataFrame:
    return emails.groupBy("mailbox_name").agg(F.count("*").alias("total"), n_if(~F.col("is_read")).alias("unread")).orderBy(F.desc("total"), "mailbox_name")


def mailboxes(emails: DataFrame) -> DataFrame:
    return emails.groupBy("account_uuid", "mailbox_name").agg(F.min("mailbox_role").alias("mailbox_role"), F.max("account_name").alias("account_name"), F.count("*").alias("total"), n_if(~F.col("is_read")).alias("unread")).orderBy("account_uuid", "mailbox_name")


def accounts(emails: DataFrame) -> DataFrame:
    return emails.select("account_uuid", "account_name").distinct().orderBy("account_uuid", "account_name")


def listing(emails: DataFrame, kind: str, as_of: int, limit: int = 50, **where) -> DataFrame:
    """The newest messages of a list filter; limit is kept within 1 and 200."""
    m = emails.where(listed(kind, as_of) & predicate(**where))
    return m.orderBy(F.desc_nulls_last("date_received"), "id").limit(min(200, max(1, limit))).select(*SUMMARY)


def newest_copy(emails: DataFrame, key: str = "message_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("date_received"), "id")
    return emails.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def overview(emails: DataFrame, as_of: int, account: str | None = None) -> dict[str, DataFrame]:
    """The inbox at a glance: counts with what wants an answer, senders with unread mail (or all), newest unread, accounts.

    The inbox is one slim projection that all parts read.
    """
    from postlake.operators import triage

    counts = inbox_counts(emails, as_of, account)
    top = top_senders(emails, 5, mailbox="inbox", account=account)
    some = top.where("unread > 0")
    any_unread = top.agg(F.max(F.col("unread") > 0).alias("any"))
    senders = top.crossJoin(F.broadcast(any_unread)).where((F.col("unread") > 0) | ~F.col("any")).select(*some.columns)  # five rows at most
    asked = triage.needs_response(emails, as_of, account=account).agg(F.count("*").alias("needs_response"))
    waiting = triage.awaiting_reply(emails, as_of, account=account).agg(F.count("*").alias("awaiting_reply"))
    return {
        "counts": counts.crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(waiting)).withColumn("index_stale", F.lit(False)),  # one row each
        "top_senders": senders.orderBy(F.desc("n"), "sender_addr"),
        "newest_unread": emails.where(predicate(account=account, unread=True)).where("mailbox_role = 'inbox'").orderBy(F.desc_nulls_last("date_received"), "id").limit(10),
        "by_account": by_account(emails),
    }


def status_counts(emails: DataFrame, dead: DataFrame) -> DataFrame:
    """total, embedded, failed: rows, rows with a vector, and dead letters."""
    counts = emails.agg(F.count("*").alias("total"), n_if(F.col("embed_state") == 2).alias("embedded"))
    return counts.crossJoin(F.broadcast(dead.agg(F.count("*").alias("failed"))))


def change_counts() -> list[Column]:
    """added, changed, deleted, moved of an inventory's difference, as aggregates."""
    return [n_if(F.col("change") == k).alias(k) for k in ("added", "changed", "deleted", "moved")]


def build_counts(diff: DataFrame, failed: int | Column = 0) -> DataFrame:
    """added, changed, deleted, moved and failed of one build."""
    return diff.agg(*change_counts(), F.max(failed if isinstance(failed, Column) else F.lit(failed)).cast("long").alias("failed"))
