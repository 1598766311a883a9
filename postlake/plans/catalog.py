"""Every query by name over the driver's tables, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.adapters import AS_OF, conversations_as_emails, events_as_emails
from postlake.functions import text as fn
from postlake.operators import analytics, filters, ingest, threads, triage
from postlake.plans import search_queries, store_queries  # noqa: F401  they register their queries
from postlake.plans.registry import ORACLES, QUERIES, query, read  # noqa: F401

WEEK = AS_OF - 7 * 86400
MONTH = AS_OF - 30 * 86400
_TOP = "SELECT sender_addr, count(*) AS n, count(*) FILTER (NOT is_read) AS unread, max(date_received) AS last_date, arg_max(sender_name, (date_received, id)) AS sender_name FROM emails WHERE {} GROUP BY sender_addr ORDER BY n DESC, sender_addr LIMIT 10"
_LIST = "SELECT id, message_id, account_uuid, mailbox_role, sender_addr, sender_name, subject_norm AS subject, date_received, is_read, is_flagged, attachment_count FROM emails WHERE {} ORDER BY date_received DESC, id LIMIT 50"


@query("top_senders", _TOP.format("true"))
def _(m):
    return analytics.top_senders(m)


@query("top_senders_inbox", _TOP.format(f"mailbox_role = 'inbox' AND account_uuid = 'acct3' AND date_received >= {WEEK}"))
def _(m):
    return analytics.top_senders(m, since=WEEK, mailbox="inbox", account="acct3")


@query("inbox_overview_counts", f"SELECT count(*) AS total, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_flagged) AS flagged, count(*) FILTER (date_received >= {AS_OF}) AS today, count(*) FILTER (date_received >= {WEEK}) AS this_week FROM emails WHERE mailbox_role = 'inbox'")
def _(m):
    return analytics.inbox_counts(m, AS_OF)


@query("by_account", "SELECT account_uuid, count(*) AS total, count(*) FILTER (NOT is_read) AS unread FROM emails WHERE mailbox_role = 'inbox' GROUP BY 1")
def _(m):
    return analytics.by_account(m)


@query("stats_account", f"SELECT count(*) AS total, count(*) FILTER (is_read) AS n_read, count(*) FILTER (is_flagged) AS flagged, count(*) FILTER (mailbox_role = 'sent') AS sent, sum(attachment_count)::BIGINT AS attachments FROM emails WHERE date_received >= {MONTH} AND account_uuid = 'acct2'")
def _(m):
    return analytics.account_statistics(m, AS_OF, account="acct2")


@query("stats_sender", f"SELECT count(*) AS total, coalesce(sum(attachment_count), 0)::BIGINT AS attachments FROM emails WHERE sender_addr = 'user7@example.com' AND date_received >= {MONTH}")
def _(m):
    return analytics.sender_statistics(m, "user7@example.com", AS_OF)


@query("stats_mailbox", "SELECT mailbox_role AS mailbox_name, count(*) AS total, count(*) FILTER (NOT is_read) AS unread FROM emails GROUP BY 1")
def _(m):
    return analytics.mailbox_breakdown(m)


@query("mailboxes", "SELECT account_uuid, mailbox_role AS mailbox_name, min(mailbox_role) AS mailbox_role, max(account_name) AS account_name, count(*) AS total, count(*) FILTER (NOT is_read) AS unread FROM emails GROUP BY 1, 2")
def _(m):
    return analytics.mailboxes(m)


@query("accounts", "SELECT DISTINCT account_uuid, account_name FROM emails")
def _(m):
    return analytics.accounts(m)


@query("emails_unread", _LIST.format("NOT is_read"))
def _(m):
    return analytics.listing(m, "unread", AS_OF)


@query("emails_flagged", _LIST.format("is_flagged AND mailbox_role = 'inbox'"))
def _(m):
    return analytics.listing(m, "flagged", AS_OF, mailbox="inbox")


@query("emails_last7", _LIST.format(f"date_received >= {WEEK} AND attachment_count > 0"))
def _(m):
    return analytics.listing(m, "last_7_days", AS_OF, has_attachments=True)


@query("emails_color", _LIST.format("flag_color = 3"))
def _(m):
    return analytics.listing(m, "all", AS_OF, color="green")


@query("emails_between", _LIST.format(f"date_received <= {WEEK} AND date_received >= {MONTH} AND attachment_count = 0"))
def _(m):
    return analytics.listing(m, "all", AS_OF, before=WEEK, after=MONTH, has_attachments=False)


_AWAIT = f"""SELECT id, message_id, recipient, subject_norm AS subject, date_received AS date_sent, greatest(0, {AS_OF} - date_received) AS seconds_waiting FROM emails s
WHERE mailbox_role = 'sent' AND NOT is_bulk AND date_received >= {WEEK} AND NOT EXISTS (SELECT 1 FROM emails r WHERE r.sender_addr = s.recipient AND r.date_received > s.date_received AND (r.in_reply_to = s.message_id OR (s.subject_norm <> '' AND r.subject_norm = s.subject_norm)))"""


@query("awaiting_reply", _AWAIT + " ORDER BY seconds_waiting DESC, id LIMIT 20")
def _(m):
    return triage.awaiting_reply(m, AS_OF)


@query("awaiting_reply_references", _AWAIT.replace("r.in_reply_to = s.message_id OR", "r.in_reply_to = s.message_id OR (r.id % 4 = 0 AND s.message_id IN ('e' || (r.id - 11) || '@x', 'e' || (r.id - 18) || '@x')) OR"))
def _(m):
    name = lambda back: F.concat(F.lit("e"), (F.col("id") - back).cast("string"), F.lit("@x"))
    return triage.awaiting_reply(m.withColumn("references", F.when(F.col("id") % 4 == 0, F.array(name(18), name(11)))), AS_OF, limit=None)


@query("awaiting_reply_all", _AWAIT)
def _(m):
    return triage.awaiting_reply(m, AS_OF, limit=None)


@query(
    "needs_response",
    f"""SELECT id, sender_addr, subject_norm AS subject, date_received, score::INTEGER AS score, array_to_string(list_filter([CASE WHEN q THEN 'contains a question' END, CASE WHEN r THEN 'contains a request phrase' END, CASE WHEN u THEN 'urgency cue or flagged' END, CASE WHEN age >= 1 THEN 'unanswered for ' || age || '+ day(s)' END], lambda x: x IS NOT NULL), '; ') AS reasons, CASE WHEN score >= 7 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'NORMAL' END AS priority
FROM (SELECT *, 3 * q::INT + 2 * r::INT + 3 * u::INT + least(3, greatest(0, age)) AS score FROM (SELECT *, contains(subject_norm, '?') AS q, regexp_matches(subject_norm, '\\b(can you|could you|please|let me know|need|request|review|approve|confirm|deadline)\\b', 'i') AS r, regexp_matches(subject_norm, '\\b(urgent|asap|eod|by end of day|by tomorrow)\\b', 'i') OR is_flagged AS u, ({AS_OF} - date_received) // 86400 AS age
FROM emails WHERE mailbox_role = 'inbox' AND NOT is_read AND NOT is_answered AND NOT is_bulk AND date_received >= {WEEK})) WHERE score >= 4""",
)
def _(m):
    return triage.needs_response(m, AS_OF)


@query(
    "contacts",
    """SELECT address, name, coalesce(received, 0)::BIGINT AS received, coalesce(sent, 0)::BIGINT AS sent, greatest(r_last, s_last) AS last_contact, (coalesce(received, 0) + coalesce(sent, 0))::BIGINT AS total
FROM (SELECT lower(sender_addr) AS address, count(*) AS received, max(date_received) AS r_last, arg_max(sender_name, (date_received, id)) AS name FROM emails WHERE mailbox_role <> 'sent' GROUP BY 1) FULL JOIN (SELECT lower(recipient) AS address, count(*) AS sent, max(date_received) AS s_last FROM emails WHERE mailbox_role = 'sent' GROUP BY 1) USING (address) ORDER BY total DESC, last_contact DESC, address LIMIT 100""",
)
def _(m):
    return triage.contacts(m)


@query("contact_one", "SELECT count(*) AS n, max(date_received) AS last_date, arg_max(sender_name, (date_received, id)) AS name FROM emails WHERE sender_addr = 'user42@example.com'")
def _(m):
    return triage.contact(m, "user42@example.com")


@query("newest_copy", "SELECT subject_norm, arg_max(id, (date_received, -id)) AS id, max(date_received) AS date_received FROM emails GROUP BY 1")
def _(m):
    return analytics.newest_copy(m, "subject_norm").select("subject_norm", "id", "date_received")


@query("subject_merge", "SELECT id, first_value(id) OVER (PARTITION BY subject_norm ORDER BY date_received, id) AS anchor FROM emails WHERE subject_norm <> ''")
def _(m):
    return threads.subject_anchor(m)


@query("noreply_flag", "SELECT p_partkey, regexp_matches(a, '\\b(no[-._]?reply|do[-._]?not[-._]?reply|notifications?|mailer-daemon|postmaster|automated)\\b', 'i') AS noreply FROM (SELECT p_partkey, ['no-reply@', 'anna@', 'Notifications@', 'do_not_reply@', 'snoreply@'][1 + p_partkey % 5] || p_brand AS a FROM part)", emails=False)
def _(spark, d):
    a = F.concat(F.element_at(F.array(*map(F.lit, ("no-reply@", "anna@", "Notifications@", "do_not_reply@", "snoreply@"))), (1 + F.col("p_partkey") % 5).cast("int")), "p_brand")
    return read(spark, d, "part").select("p_partkey", filters.no_reply(a).alias("noreply"))


@query("normalize_subject", "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS subject, 'm' || p_partkey || '@x' AS message_id FROM part", emails=False)
def _(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("Re: ", "FWD: re[2]: ", "", "Antwort :", " AW: "))), (1 + F.col("p_partkey") % 5).cast("int"))
    return read(spark, d, "part").select("p_partkey", fn.normalize_subject(F.concat(p, "p_name")).alias("subject"), fn.normalize_message_id(F.concat(F.lit(" <m"), F.col("p_partkey").cast("string"), F.lit("@ x> "))).alias("message_id"))


def _halves(spark, d):
    o = read(spark, d, "orders")
    rows = o.select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("rowid"), F.lit("a").alias("account"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("mtime"), F.length("o_orderpriority").alias("size"))
    known = rows.where("k % 3 <> 0").select("path", "rowid", "account", "mtime", "size")
    disk = rows.where("k % 4 <> 0").select("path", "rowid", "account", F.when(F.col("k") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size")
    return disk, known


_HALVES = """r AS (SELECT 'p/' || o_orderkey AS path, o_custkey AS rowid, o_orderkey AS k, floor(o_totalprice)::BIGINT AS mtime, length(o_orderpriority) AS size FROM orders),
known AS (SELECT * FROM r WHERE k % 3 <> 0), disk AS (SELECT path, rowid, k, CASE WHEN k % 5 = 0 THEN mtime + 1 ELSE mtime END AS mtime, size FROM r WHERE k % 4 <> 0)"""


@query(
    "inventory_diff",
    f"""WITH {_HALVES}, d AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.rowid, b.rowid) AS rowid, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.mtime <> b.mtime OR a.size <> b.size THEN 'changed' ELSE 'unchanged' END AS change FROM disk a FULL JOIN known b ON a.path = b.path),
g AS (SELECT rowid, max(path) AS old_path FROM d WHERE change = 'deleted' GROUP BY rowid HAVING count(*) = 1),
n AS (SELECT d.path, CASE WHEN g.old_path IS NULL THEN 'added' ELSE 'moved' END AS change, g.old_path FROM d LEFT JOIN g USING (rowid) WHERE d.change = 'added')
SELECT * FROM n UNION ALL SELECT path, change, NULL FROM d WHERE change <> 'added' AND path NOT IN (SELECT old_path FROM n WHERE old_path IS NOT NULL)""",
    emails=False,
)
def _(spark, d):
    return ingest.inventory_diff(*_halves(spark, d))


@query("upsert_merge", f"WITH {_HALVES} SELECT coalesce(a.path, b.path) AS path, coalesce(a.mtime, b.mtime) AS mtime, CASE WHEN b.path IS NULL THEN NULL ELSE b.size END AS flag_color, CASE WHEN a.path IS NULL THEN 2 ELSE 0 END AS embed_state FROM disk a FULL JOIN known b ON a.path = b.path", emails=False)
def _(spark, d):
    disk, known = _halves(spark, d)
    return ingest.merge(known.select("path", "mtime", F.col("size").alias("flag_color"), F.lit(2).alias("embed_state")), disk.select("path", "mtime"), "path", kept=("flag_color",), reset={"embed_state": 0})


@query(
    "dead_letter_merge",
    """WITH k AS (SELECT 'f' || event_id AS path, 'old' AS error, (event_id % 3 + 1)::INT AS attempts, event_id AS first_seen, event_id AS last_seen FROM events WHERE event_id % 2 = 0), f AS (SELECT DISTINCT 'f' || event_id AS path FROM events WHERE event_id % 5 = 0), o AS (SELECT 'f' || event_id AS path FROM events WHERE event_id % 7 = 0)
SELECT path, CASE WHEN f.path IS NOT NULL THEN 'new' ELSE error END AS error, coalesce(attempts, 0) + (f.path IS NOT NULL)::INT AS attempts, coalesce(first_seen, 99) AS first_seen, CASE WHEN f.path IS NOT NULL THEN 99 ELSE last_seen END AS last_seen FROM k FULL JOIN f USING (path) WHERE path NOT IN (SELECT path FROM o)""",
    emails=False,
)
def _(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("i"))
    known = e.where("i % 2 = 0").select("path", F.lit("old").alias("error"), (F.col("i") % 3 + 1).cast("int").alias("attempts"), F.col("i").alias("first_seen"), F.col("i").alias("last_seen"))
    return ingest.dead_letters(known, e.where("i % 5 = 0").select("path", F.lit("new").alias("error")), e.where("i % 7 = 0"), 99)


@query("thread_summary", "SELECT conv_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT role)), ',') AS participants, min(1700000000 + conv_id * 86400 + turn * 3600) AS first_date, max(1700000000 + conv_id * 86400 + turn * 3600) AS last_date, count(*) FILTER (role <> 'user') AS unread, arg_max(role, turn) = 'assistant' AS answered_last FROM conversations GROUP BY conv_id", emails=False)
def _(spark, d):
    m = conversations_as_emails(read(spark, d, "conversations"))
    return threads.summaries(m.withColumn("conv_id", F.floor(F.col("id") / 1000)), "conv_id")


@query("thread_positions", "SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS thread_id, turn::INTEGER AS position, turn::INTEGER AS depth FROM conversations", emails=False)
def _(spark, d):
    return threads.threads(conversations_as_emails(read(spark, d, "conversations")))


@query("thread_components", "WITH RECURSIVE e AS (SELECT event_id, CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 7 = 0 THEN event_id - 5 END AS up FROM events), w AS (SELECT event_id, event_id AS top, up FROM e UNION ALL SELECT w.event_id, w.up, e.up FROM w LEFT JOIN e ON e.event_id = w.up WHERE w.up IS NOT NULL), t AS (SELECT event_id, min(top) AS top FROM w GROUP BY event_id) SELECT t.event_id AS id, count(*) OVER (PARTITION BY top) AS n FROM t", emails=False)
def _(spark, d):
    from pyspark.sql import Window

    m = events_as_emails(read(spark, d, "events"))
    return m.join(threads.labelled(m), "message_id").select("id", F.count("*").over(Window.partitionBy("component")).alias("n"))


@query("html_links", "SELECT page_id, array_to_string(list_transform(list_filter(list_distinct_first, lambda x: NOT regexp_matches(x, '^(mailto|javascript|cid|data):', 'i')), lambda x: x), ' ') AS links FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_first FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1, 'i') AS l FROM pages))", emails=False)
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(fn.links(F.col("html")), " ").alias("links"))


_HTML = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<head\b[^>]*>.*?</head>', ' ', 'gis'), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS text FROM pages"""


@query("html_text", _HTML, emails=False)
def _(spark, d):
    from postlake.functions.html import html_to_text

    return read(spark, d, "pages").select("page_id", html_to_text("html").alias("text"))


@query("message_handle", "SELECT event_id AS id, 'amid:v1:' || rtrim(replace(replace(base64(encode('acct' || (user_id % 7) || '|' || event_id)), '+', '-'), '/', '_'), '=') AS handle FROM events", emails=False)
def _(spark, d):
    m = events_as_emails(read(spark, d, "events"))
    return m.select("id", fn.handle(F.col("account_uuid"), F.col("id").cast("string")).alias("handle"))


@query("newest_batch", "SELECT o_custkey AS batch, max(o_orderkey) AS seq, max(epoch_us(o_orderdate) // 1000000) AS ts FROM orders GROUP BY 1 ORDER BY seq DESC LIMIT 500", emails=False)
def _(spark, d):
    from postlake.operators.actions import batches

    o = read(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("seq"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return batches(o)
