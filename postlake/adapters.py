"""Source tables as message tables: one wide row a message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The instant every relative query of the event tables counts from: 2024-01-31 UTC.
AS_OF = 1_706_659_200
ROLES = {"view": "inbox", "click": "inbox", "purchase": "sent", "signup": "archive"}
SUBJECTS = ("weekly report", "can you review this?", "urgent: please confirm", "lunch?", "deadline tomorrow", "")


def events_as_emails(events: DataFrame) -> DataFrame:
    role = F.lit("junk")
    for kind, name in ROLES.items():
        role = F.when(F.col("event_type") == kind, name).otherwise(role)
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    subject = F.when(F.col("k") % 13 < 6, F.element_at(F.array(*map(F.lit, SUBJECTS)), 1 + F.col("k") % 6)).otherwise(F.concat(F.lit("topic "), (F.col("event_id") % 997).cast("string")))
    name = lambda c: F.concat(F.lit("user"), c.cast("string"), F.lit("@example.com"))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("acct"), (F.col("user_id") % 7).cast("string")).alias("account_uuid"),
        F.concat(F.lit("Account "), (F.col("user_id") % 7).cast("string")).alias("account_name"),
        role.alias("mailbox_name"), role.alias("mailbox_role"),
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("@x")).alias("message_id"),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("e"), (F.col("event_id") - 5).cast("string"), F.lit("@x"))).alias("in_reply_to"),
        subject.alias("subject"), subject.alias("subject_norm"), F.lit("").alias("snippet"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.when(F.col("k") % 3 == 0, " jr").otherwise("")).alias("sender_name"),
        name(F.col("user_id")).alias("sender_addr"), name((F.col("user_id") * 7 + 3) % 150).alias("recipient"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date_received"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date_sent"),
        (F.col("k") % 2 == 1).alias("is_read"), (F.col("k") % 10 == 0).alias("is_flagged"), (F.col("k") % 5 == 0).alias("is_answered"), (F.col("k") % 11 == 0).alias("is_bulk"),
        F.when(F.col("k") % 9 < 7, F.col("k") % 9).alias("flag_color"), (F.col("k") % 4).alias("attachment_count"),
    )


#: The same as a DuckDB table expression.
EMAILS_SQL = f"""emails AS (
  SELECT event_id AS id, 'acct' || (user_id % 7) AS account_uuid, 'Account ' || (user_id % 7) AS account_name,
    CASE WHEN event_type IN ('view', 'click') THEN 'inbox' WHEN event_type = 'purchase' THEN 'sent' WHEN event_type = 'signup' THEN 'archive' ELSE 'junk' END AS mailbox_role,
    'e' || event_id || '@x' AS message_id, CASE WHEN k % 7 = 0 THEN 'e' || (event_id - 5) || '@x' END AS in_reply_to,
    CASE WHEN k % 13 < 6 THEN [{", ".join(f"'{s}'" for s in SUBJECTS)}][1 + k % 6] ELSE 'topic ' || (event_id % 997) END AS subject_norm,
    'User ' || user_id || CASE WHEN k % 3 = 0 THEN ' jr' ELSE '' END AS sender_name,
    'user' || user_id || '@example.com' AS sender_addr, 'user' || ((user_id * 7 + 3) % 150) || '@example.com' AS recipient,
    epoch_us(ts) // 1000000 AS date_received, k % 2 = 1 AS is_read, k % 10 = 0 AS is_flagged, k % 5 = 0 AS is_answered, k % 11 = 0 AS is_bulk,
    CASE WHEN k % 9 < 7 THEN k % 9 END AS flag_color, k % 4 AS attachment_count
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""


def conversations_as_emails(turns: DataFrame) -> DataFrame:
    mid = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), t.cast("string"))
    earlier = F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn") - 1), mid)).otherwise(F.array().cast("array<string>"))
    role = F.when(F.col("role") == "user", "inbox").when(F.col("role") == "assistant", "sent").otherwise("other")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), mid(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, mid(F.col("turn") - 1)).alias("in_reply_to"), earlier.alias("references"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("subject_norm"), F.col("role").alias("sender_addr"), role.alias("mailbox_role"),
        (1_700_000_000 + F.col("conv_id") * 86400 + F.col("turn") * 3600).alias("date_received"), (F.col("role") == "user").alias("is_read"), "text",
    )
