"""Who has not answered, and which messages want an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.filters import no_reply, predicate

#: Cues that a message asks for something, or soon.
REQUEST = r"(?i)\b(can you|could you|please|let me know|need|request|review|approve|confirm|deadline)\b"
URGENT = r"(?i)\b(urgent|asap|eod|by end of day|by tomorrow)\b"


def awaiting_reply(emails: DataFrame, as_of: int, days: int = 7, account: str | None = None, limit: int | None = 20) -> DataFrame:
    """Sent messages without a later message from their first recipient that answers by id, reference or subject.

    Of all that came later only the newest date a sender and key (an id replied or referred to, or a subject) is kept, by
    partial sums, and met by equality: a busy address makes no pairs, whatever it wrote.
    """
    since = as_of - days * 86400
    sent = emails.where(predicate(account=account)).where((F.col("mailbox_role") == "sent") & ~F.col("is_bulk") & (F.col("date_sent") >= since) & F.col("recipient").isNotNull() & ~no_reply(F.col("recipient")))
    none = F.array().cast("array<string>")
    by_id = lambda c: F.concat(F.lit("id "), c)
    by_subject = F.when(F.col("subject_norm") != "", F.concat(F.lit("subject "), F.col("subject_norm")))
    referred = F.coalesce(F.transform("references", by_id), none) if "references" in emails.columns else none
    given = F.array_distinct(F.array_compact(F.concat(F.array(by_id(F.col("in_reply_to")), by_subject), referred)))
    wanted = F.array_compact(F.array(by_id(F.col("message_id")), by_subject))
    # An answer is later than some message of these days.
    later = emails.where((F.col("date_received") > since) & F.col("sender_addr").isNotNull())
    answers = later.select(F.col("sender_addr").alias("recipient"), F.explode(given).alias("key"), "date_received").groupBy("recipient", "key").agg(F.max("date_received").alias("newest"))
    had = sent.select("id", "recipient", "date_sent", F.explode(wanted).alias("key")).join(answers, ["recipient", "key"]).where("newest > date_sent").select("id").distinct()
    left = sent.join(had, "id", "left_anti")
    out = left.select("id", "message_id", "recipient", "subject", "date_sent", F.greatest(F.lit(0), F.lit(as_of) - F.col("date_sent")).alias("seconds_waiting"))
    return out.orderBy(F.desc("seconds_waiting"), "id").limit(limit) if limit else out


def needs_response(emails: DataFrame, as_of: int, days: int = 7, account: str | None = None, threshold: int = 4) -> DataFrame:
    """Scores unread, unanswered inbox mail by question, request, urgency or flag, and age."""
    m = emails.where(predicate(account=account, after=as_of - days * 86400)).where((F.col("mailbox_role") == "inbox") & ~F.col("is_read") & ~F.col("is_answered") & ~F.col("is_bulk") & ~F.coalesce(no_reply(F.col("sender_addr")), F.lit(False)))
    text = F.concat_ws(" ", "subject", "snippet")
    question, request = F.contains(text, F.lit("?")), F.rlike(text, F.lit(REQUEST))
    urgent = F.rlike(text, F.lit(URGENT)) | F.col("is_flagged")
    age = F.floor((F.lit(as_of) - F.coalesce("date_received", F.lit(as_of))) / 86400).cast("int")
    score = 3 * question.cast("int") + 2 * request.cast("int") + 3 * urgent.cast("int") + F.least(F.lit(3), F.greatest(F.lit(0), age))
    reasons = F.array_compact(F.array(F.when(question, "contains a question"), F.when(request, "contains a request phrase"), F.when(urgent, "urgency cue or flagged"), F.when(age >= 1, F.concat(F.lit("unanswered for "), age.cast("string"), F.lit("+ day(s)")))))
    out = m.select("id", "sender_addr", "subject", "date_received", score.alias("score"), F.array_join(reasons, "; ").alias("reasons")).where(F.col("score") >= threshold)
    return out.withColumn("priority", F.when(F.col("score") >= 7, "HIGH").when(F.col("score") >= 5, "MEDIUM").otherwise("NORMAL")).orderBy(F.desc("score"), F.desc_nulls_last("date_received"), "id")


def contacts(emails: DataFrame, query: str | None = None, limit: int = 100) -> DataFrame:
    """Received and sent counts per address, whatever its case; name of the newest received message first."""
    key = lambda c: F.lower(c)
    got = emails.where("mailbox_role <> 'sent' and sender_addr is not null and sender_addr <> ''").groupBy(key("sender_addr").alias("address")).agg(F.count("*").alias("received"), F.max("date_received").alias("r_last"), F.max_by("sender_name", F.struct("date_received", "id")).alias("name"))
    sent = emails.where("mailbox_role = 'sent' and recipient is not null and recipient <> ''").groupBy(key("recipient").alias("address")).agg(F.count("*").alias("sent"), F.max("date_received").alias("s_last"))
    c = got.join(sent, "address", "full").select("address", "name", F.coalesce("received", F.lit(0)).cast("long").alias("received"), F.coalesce("sent", F.lit(0)).cast("long").alias("sent"), F.greatest("r_last", "s_last").alias("last_contact")).withColumn("total", F.col("received") + F.col("sent"))
    if query:
        c = c.where(F.contains("address", F.lit(query.lower())) | F.contains(F.lower("name"), F.lit(query.lower())))
    return c.orderBy(F.desc("total"), F.desc(F.coalesce("last_contact", F.lit(0))), "address").limit(min(500, max(1, limit)))


def primary_recipient(to: Column) -> Column:
    """The address of the first To entry, ``Name <addr>`` or bare; null for none."""
    first = F.get(to, F.lit(0))
    inside = F.regexp_extract(first, r"<([^<>]*)>", 1)
    return F.nullif(F.trim(F.when(F.contains(first, F.lit("<")), inside).otherwise(first)), F.lit(""))


def contacts_of(emails: DataFrame, query: str | None = None, limit: int = 100, **where) -> DataFrame:
    """address, name, received, sent, total, last_contact over all To and Cc entries (``recipients_to``, ``recipients_cc``: structs name, addr).

    Every occurrence counts. The name is that of the newest received message, else the first one non-empty in sent
    messages by id, To before Cc; the address is shown as that message has it.
    """
    m = emails.where(predicate(**where))
    got = m.where("mailbox_role <> 'sent' and sender_addr is not null and sender_addr <> ''").groupBy(F.lower("sender_addr").alias("key")).agg(F.count("*").alias("received"), F.max("date_received").alias("r_last"), F.max_by(F.struct("sender_addr", "sender_name"), F.struct("date_received", "id")).alias("r"))
    entries = F.concat(F.coalesce("recipients_to", F.array().cast("array<struct<name:string,addr:string>>")), F.coalesce("recipients_cc", F.array().cast("array<struct<name:string,addr:string>>")))
    each = m.where("mailbox_role = 'sent'").select("id", "date_received", F.posexplode(entries).alias("place", "to")).where("to.addr is not null and to.addr <> ''")
    order = F.struct("id", "place")
    named = F.nullif(F.col("to.name"), F.lit("")).isNotNull()
    sent = each.groupBy(F.lower("to.addr").alias("key")).agg(F.count("*").alias("sent"), F.max("date_received").alias("s_last"), F.min_by("to.addr", order).alias("s_addr"), F.min_by(F.when(named, F.col("to.name")), F.when(named, order)).alias("s_name"))
    c = got.join(sent, "key", "full").select(
        F.coalesce("r.sender_addr", "s_addr").alias("address"), F.coalesce(F.nullif(F.col("r.sender_name"), F.lit("")), "s_name").alias("name"),
        F.coalesce("received", F.lit(0)).cast("long").alias("received"), F.coalesce("sent", F.lit(0)).cast("long").alias("sent"), F.greatest("r_last", "s_last").alias("last_contact"), "key",
    ).withColumn("total", F.col("received") + F.col("sent"))
    if query:
        c = c.where(named_like(query, F.col("name"), F.col("address")))
    return c.orderBy(F.desc("total"), F.desc(F.coalesce("last_contact", F.lit(0))), "key").limit(min(500, max(1, limit))).drop("key")


def named_like(query: str, *columns: Column) -> Column:
    """Whether any of the columns holds the text, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return out


def contact_newest(emails: DataFrame, address: str, most: int = 5) -> DataFrame:
    """The newest messages of one address."""
    return emails.where(F.col("sender_addr") == address).orderBy(F.desc_nulls_last("date_received"), "id").limit(most)


def contact(emails: DataFrame, address: str) -> DataFrame:
    m = emails.where(F.col("sender_addr") == address)
    return m.agg(F.count("*").alias("n"), F.max("date_received").alias("last_date"), F.expr("max_by(sender_name, struct(date_received, id)) filter (where sender_name is not null)").alias("name"))
