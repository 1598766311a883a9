"""Queries of projections, knowledge, upkeep, actions and threads over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.adapters import AS_OF, EMAILS_SQL, conversations_as_emails, events_as_emails
from postlake.functions import text as fn
from postlake.operators import actions, analytics, embedding, export, filters, store, threads, triage
from postlake.plans.registry import query, read
from postlake.sources import accounts, mail

WEEK, MONTH = AS_OF - 7 * 86400, AS_OF - 30 * 86400
_COLORS = "['red', 'orange', 'yellow', 'green', 'blue', 'purple', 'gray'][flag_color + 1]"
_SUMMARY = f"id, message_id, coalesce(nullif(account_name, ''), account_uuid) AS account, mailbox_role AS mailbox, mailbox_role, subject_norm AS subject, sender_name, sender_addr, date_received, '' AS snippet, is_read, is_flagged, is_answered, {_COLORS} AS flag_color, attachment_count, NULL::BIGINT AS thread_id"


@query("summaries", f"SELECT {_SUMMARY} FROM emails")
def _(m):
    return analytics.summaries(m)


@query("message_full", f"SELECT {_SUMMARY}, in_reply_to, date_received AS date_sent FROM emails WHERE message_id = 'e77@x'")
def _(m):
    return analytics.full(m.where("message_id = 'e77@x'")).drop("recipients_to", "recipients_cc", "body_plain", "body_html", "attachments", "references", "headers")


@query("account_overview", f"SELECT count(*) AS total, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (is_read) / count(*), 1) ELSE 0.0 END::DOUBLE AS read_pct, count(*) FILTER (is_flagged) AS flagged, count(*) FILTER (mailbox_role = 'sent') AS sent, coalesce(sum(attachment_count), 0)::BIGINT AS attachments FROM emails WHERE date_received >= {MONTH}")
def _(m):
    return analytics.account_overview(m, AS_OF)


_NEEDS = f"""SELECT count(*) AS needs_response FROM (SELECT 3 * contains(subject_norm, '?')::INT + 2 * regexp_matches(subject_norm, '\\b(can you|could you|please|let me know|need|request|review|approve|confirm|deadline)\\b', 'i')::INT + 3 * (regexp_matches(subject_norm, '\\b(urgent|asap|eod|by end of day|by tomorrow)\\b', 'i') OR is_flagged)::INT + least(3, greatest(0, ({AS_OF} - date_received) // 86400)) AS score FROM emails WHERE mailbox_role = 'inbox' AND NOT is_read AND NOT is_answered AND NOT is_bulk AND date_received >= {WEEK}) WHERE score >= 4"""
_WAITS = f"""SELECT least(20, count(*)) AS awaiting_reply FROM emails s WHERE mailbox_role = 'sent' AND NOT is_bulk AND date_received >= {WEEK} AND NOT EXISTS (SELECT 1 FROM emails r WHERE r.sender_addr = s.recipient AND r.date_received > s.date_received AND (r.in_reply_to = s.message_id OR (s.subject_norm <> '' AND r.subject_norm = s.subject_norm)))"""


@query("overview_counts", f"SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_flagged) AS flagged, count(*) FILTER (date_received >= {AS_OF}) AS today, count(*) FILTER (date_received >= {WEEK}) AS this_week FROM emails WHERE mailbox_role = 'inbox'), ({_NEEDS}), ({_WAITS}), (SELECT false AS index_stale)")
def _(m):
    return analytics.overview(m, AS_OF)["counts"]


@query("overview_senders", "SELECT * FROM (SELECT sender_addr, count(*) AS n, count(*) FILTER (NOT is_read) AS unread, max(date_received) AS last_date, arg_max(sender_name, (date_received, id)) AS sender_name FROM emails WHERE mailbox_role = 'inbox' GROUP BY 1 ORDER BY n DESC, sender_addr LIMIT 5) WHERE unread > 0")
def _(m):
    return analytics.overview(m, AS_OF)["top_senders"]


@query("overview_unread", "SELECT id, date_received FROM emails WHERE mailbox_role = 'inbox' AND NOT is_read ORDER BY date_received DESC, id LIMIT 10")
def _(m):
    return analytics.overview(m, AS_OF)["newest_unread"].select("id", "date_received")


def _with_recipients(m: DataFrame) -> DataFrame:
    """To: the recipient and, for every third message, a second entry in capitals; Cc: the next user, without a name."""
    person = lambda n, a: F.struct(n.cast("string").alias("name"), a.alias("addr"))
    second = F.when(F.col("id") % 3 == 0, F.array(person(F.lit("Dave"), F.upper("recipient")))).otherwise(F.array().cast("array<struct<name:string,addr:string>>"))
    to = F.concat(F.array(person(F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("To "), F.col("recipient"))), F.col("recipient"))), second)
    cc = F.array(person(F.lit(None), F.concat(F.lit("cc"), (F.col("id") % 40).cast("string"), F.lit("@example.com"))))
    return m.withColumn("recipients_to", to).withColumn("recipients_cc", cc)


_ENTRIES = """each AS (SELECT id, date_received, 0 AS place, CASE WHEN id % 2 = 0 THEN '' ELSE 'To ' || recipient END AS name, recipient AS addr FROM emails WHERE mailbox_role = 'sent' UNION ALL SELECT id, date_received, 1, 'Dave', upper(recipient) FROM emails WHERE mailbox_role = 'sent' AND id % 3 = 0 UNION ALL SELECT id, date_received, 2, NULL, 'cc' || (id % 40) || '@example.com' FROM emails WHERE mailbox_role = 'sent'),
got AS (SELECT lower(sender_addr) AS key, count(*) AS received, max(date_received) AS r_last, arg_max(sender_addr, (date_received, id)) AS r_addr, arg_max(sender_name, (date_received, id)) AS r_name FROM emails WHERE mailbox_role <> 'sent' GROUP BY 1),
out AS (SELECT lower(addr) AS key, count(*) AS sent, max(date_received) AS s_last, arg_min(addr, (id, place)) AS s_addr, arg_min(name, (id, place)) FILTER (name <> '') AS s_name FROM each GROUP BY 1)"""
_CONTACTS = "SELECT coalesce(r_addr, s_addr) AS address, coalesce(nullif(r_name, ''), s_name) AS name, coalesce(received, 0)::BIGINT AS received, coalesce(sent, 0)::BIGINT AS sent, greatest(r_last, s_last) AS last_contact, (coalesce(received, 0) + coalesce(sent, 0))::BIGINT AS total FROM got FULL JOIN out USING (key) {} ORDER BY total DESC, coalesce(last_contact, 0) DESC, key LIMIT {}"


@query("contacts_all_recipients", f", {_ENTRIES} {_CONTACTS.format('', 500)}")
def _(m):
    return triage.contacts_of(_with_recipients(m), limit=900)


@query("contacts_named", f", {_ENTRIES} {_CONTACTS.format('''WHERE contains(lower(coalesce(r_addr, s_addr)), 'cc1') OR contains(lower(coalesce(coalesce(nullif(r_name, ''), s_name), '')), 'cc1')''', 100)}")
def _(m):
    return triage.contacts_of(_with_recipients(m), "CC1")


@query("contact_newest", "SELECT id, date_received FROM emails WHERE sender_addr = 'user42@example.com' ORDER BY date_received DESC, id LIMIT 5")
def _(m):
    return triage.contact_newest(m, "user42@example.com").select("id", "date_received")


@query("primary_recipient", "SELECT id, recipient AS addr FROM emails")
def _(m):
    to = F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("User <"), F.col("recipient"), F.lit(">")), F.lit("b@x"))).otherwise(F.array("recipient"))
    return m.select("id", triage.primary_recipient(to).alias("addr"))


@query("mailbox_excluded", "SELECT id FROM emails WHERE mailbox_role <> 'junk'")
def _(m):
    return m.where(filters.included(F.col("mailbox_name"), ["Junk", "Drafts"])).select("id")


@query("pending_queue", "SELECT id FROM emails WHERE id % 3 = 0 AND attachment_count > 0 ORDER BY date_received DESC, id LIMIT 100")
def _(m):
    state = F.when(F.col("id") % 3 == 0, 0).otherwise(2)
    return m.where(filters.pending(state, F.col("attachment_count"))).orderBy(F.desc("date_received"), "id").limit(100).select("id")


@query("embed_states", "SELECT id, CASE WHEN length(trim(subject_norm)) >= 8 THEN 2 ELSE 3 END::INTEGER AS embed_state FROM emails")
def _(m):
    return embedding.backfill(m.withColumn("embed_state", F.lit(0)), _no_vectors(m), Letters())[0].select("id", "embed_state")


@query("embed_vectors", "SELECT id AS vec_id, (length(subject_norm) - length(replace(subject_norm, 'e', '')))::DOUBLE AS e, (length(subject_norm) - length(replace(subject_norm, 't', '')))::DOUBLE AS t FROM emails WHERE length(trim(subject_norm)) >= 8")
def _(m):
    v = embedding.backfill(m.withColumn("embed_state", F.lit(0)), _no_vectors(m), Letters())[1]
    return v.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("e"), F.get("embedding", F.lit(1)).cast("double").alias("t"))


def _no_vectors(m: DataFrame) -> DataFrame:
    return m.limit(0).select(F.col("id").alias("vec_id"), F.array().cast("array<float>").alias("embedding"))


class Letters(embedding.Backend):
    """A backend for tests: how often two letters occur."""

    name, dimension = "letters", 2

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count("e")), float(t.count("t"))] for t in texts]


@query("status_counts", "SELECT count(*) AS total, count(*) FILTER (id % 2 = 0) AS embedded, (SELECT count(*) FROM emails WHERE id % 50 = 1) AS failed FROM emails")
def _(m):
    return analytics.status_counts(m.withColumn("embed_state", F.when(F.col("id") % 2 == 0, 2).otherwise(0)), m.where("id % 50 = 1"))


@query("build_counts", "SELECT count(*) FILTER (k % 3 = 0 AND k % 4 <> 0 AND g.n IS NULL) AS added, count(*) FILTER (k % 3 <> 0 AND k % 4 <> 0 AND k % 5 = 0) AS changed, count(*) FILTER (k % 3 <> 0 AND k % 4 = 0) AS deleted, 0::BIGINT AS moved, 7::BIGINT AS failed FROM (SELECT o_orderkey AS k FROM orders) LEFT JOIN (SELECT NULL AS n) g ON true", emails=False)
def _(spark, d):
    from postlake.operators import ingest

    o = read(spark, d, "orders").select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("rowid"), F.lit("a").alias("account"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("mtime"), F.length("o_orderpriority").alias("size"))
    known = o.where("k % 3 <> 0").select("path", "rowid", "account", "mtime", "size")
    disk = o.where("k % 4 <> 0").select("path", "rowid", "account", F.when(F.col("k") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size")
    return analytics.build_counts(ingest.inventory_diff(disk, known), 7)


@query("delete_by_path", "SELECT id FROM emails WHERE id % 4 <> 0")
def _(m):
    rows = m.withColumn("path", F.concat(F.lit("p"), F.col("id").cast("string")))
    return store.deleted(rows, rows.where("id % 4 = 0").select("path")).select("id")


@query("move_update", "SELECT id, CASE WHEN id % 10 = 0 THEN 'new/' || id ELSE 'old/' || id END AS path, CASE WHEN id % 10 = 0 THEN 'Sent Items' ELSE mailbox_role END AS mailbox_name, CASE WHEN id % 10 = 0 THEN 'sent' ELSE mailbox_role END AS mailbox_role, CASE WHEN id % 20 = 0 THEN NULL ELSE account_name END AS account_name FROM emails")
def _(m):
    at = lambda top: F.concat(F.lit(top), F.col("id").cast("string"))
    rows = m.withColumns({"path": at("old/"), "rowid": F.col("id"), "account": F.col("account_uuid"), "mailbox": F.col("mailbox_name"), "mtime_us": F.lit(1).cast("long"), "size": F.lit(1).cast("long")})
    hit = m.where("id % 10 = 0")
    disk = hit.select(at("new/").alias("path"), F.col("id").alias("rowid"), F.when(F.col("id") % 20 == 0, F.lit("other")).otherwise(F.col("account_uuid")).alias("account"), F.lit("Outer/Sent Items").alias("mailbox"), F.lit(2).cast("long").alias("mtime_us"), F.lit(1).cast("long").alias("size"))
    return store.moved(rows, hit.select(at("new/").alias("path"), at("old/").alias("old_path")), disk).select("id", "path", "mailbox_name", "mailbox_role", "account_name")


@query("account_backfill", "SELECT id, CASE WHEN account_uuid IN ('acct1', 'acct2') THEN 'Named ' || account_uuid ELSE account_name END AS account_name FROM emails")
def _(m):
    names = m.where("account_uuid in ('acct1', 'acct2')").select("account_uuid", F.concat(F.lit("Named "), F.col("account_uuid")).alias("account_name")).distinct()
    return store.named(m, names).select("id", "account_name")


@query("account_names", """WITH RECURSIVE a AS (SELECT c_custkey AS pk, 'uuid' || c_custkey AS identifier, CASE WHEN c_custkey % 4 = 0 THEN ' ' || c_name || ' ' WHEN c_custkey % 4 = 1 THEN '  ' END AS description, CASE WHEN c_custkey % 8 = 1 THEN 'u' || c_custkey END AS username, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey // 2 + c_custkey % 3 END AS parent FROM customer),
w AS (SELECT pk, identifier, pk AS at, parent, coalesce(nullif(trim(description), ''), nullif(trim(username), '')) AS name, 1 AS hop, [pk] AS seen FROM a UNION ALL SELECT w.pk, w.identifier, a.pk, a.parent, coalesce(nullif(trim(a.description), ''), nullif(trim(a.username), '')), hop + 1, list_append(seen, a.pk) FROM w JOIN a ON a.pk = w.parent WHERE w.name IS NULL AND hop < 5 AND NOT list_contains(seen, a.pk))
SELECT DISTINCT identifier AS account_uuid, name AS account_name FROM w WHERE name IS NOT NULL""", emails=False)
def _(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("pk"), F.concat(F.lit("uuid"), k.cast("string")).alias("identifier"), F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).when(k % 4 == 1, F.lit("  ")).alias("description"), F.when(k % 8 == 1, F.concat(F.lit("u"), k.cast("string"))).alias("username"), F.when(k % 5 != 0, F.expr("c_custkey div 2") + k % 3).alias("parent"))
    return accounts.names(rows)


@query("mailbox_roles", "SELECT p_partkey, ['inbox', 'sent', 'sent', 'drafts', 'trash', 'trash', 'junk', 'archive', 'other', 'other'][1 + p_partkey % 10] AS role FROM part", emails=False)
def _(spark, d):
    names = F.array(*map(F.lit, ("INBOX", "Sent Messages", " sent items", "Drafts", "Bin", "Deleted Messages", "Spam", "All Mail", "Receipts", "")))
    return read(spark, d, "part").select("p_partkey", fn.mailbox_role(F.get(names, (F.col("p_partkey") % 10).cast("int"))).alias("role"))


@query("flag_colors", f"SELECT id, {_COLORS} AS color FROM emails")
def _(m):
    return m.select("id", analytics.color_name(F.col("flag_color")).alias("color"))


@query("export_txt", r"SELECT id || '_' || CASE WHEN subject_norm = '' THEN 'no-subject' ELSE left(regexp_replace(subject_norm, '[^\p{L}\p{N} \-_]', '', 'g'), 60) END || '.txt' AS filename, 'From: ' || sender_name || ' <' || sender_addr || '>' || chr(10) || 'Subject: ' || subject_norm || chr(10) || chr(10) AS content FROM emails")
def _(m):
    return export.files(m.withColumn("body_plain", F.lit(None).cast("string")))


@query("export_html", r"SELECT id || '_' || CASE WHEN subject_norm = '' THEN 'no-subject' ELSE left(regexp_replace(subject_norm, '[^\p{L}\p{N} \-_]', '', 'g'), 60) END || '.html' AS filename, '<html><body><h1>' || subject_norm || '</h1><pre>a &lt; b &amp; c</pre></body></html>' AS content FROM emails ORDER BY date_received DESC, id LIMIT 50")
def _(m):
    return export.files(m.withColumn("body_plain", F.lit("a < b & c")), "html", 50)


@query("json_rows", "SELECT '{\"id\":' || id || ',\"flag_color\":' || coalesce(flag_color::VARCHAR, 'null') || '}' AS json FROM emails")
def _(m):
    return store.to_json(m.select("id", "flag_color"))


@query("unsubscribe_decision", "SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'one-click-post' WHEN id % 5 = 0 THEN 'mailto' ELSE 'none-found' END AS method FROM emails")
def _(m):
    https = F.when(F.col("id") % 2 == 0, F.array(F.lit("https://x/leave"))).otherwise(F.array().cast("array<string>"))
    return m.select("id", mail.unsubscribe_decision(https, F.when(F.col("id") % 5 == 0, F.lit("leave@x")), F.col("id") % 3 == 0).alias("method"))


def _ten(m: DataFrame) -> list[int]:
    return [r[0] for r in m.where("mailbox_role = 'inbox'").orderBy("id").limit(10).select("id").collect()]


_TEN = "(SELECT id FROM emails WHERE mailbox_role = 'inbox' ORDER BY id LIMIT 10)"


@query("action_move", f"SELECT id, CASE WHEN id IN {_TEN} THEN 'Archive' ELSE mailbox_role END AS mailbox_name, CASE WHEN id IN {_TEN} THEN 'archive' ELSE mailbox_role END AS mailbox_role FROM emails")
def _(m):
    return actions.move(m, _ten(m), "Archive", "archive", AS_OF).emails.select("id", "mailbox_name", "mailbox_role")


@query("action_flag_color", f"SELECT id, is_flagged OR id IN {_TEN} AS is_flagged, CASE WHEN id IN {_TEN} THEN 4 ELSE flag_color END::INTEGER AS flag_color FROM emails")
def _(m):
    return actions.status(m, _ten(m), "set_flag_color", AS_OF, "blue").emails.select("id", "is_flagged", "flag_color")


@query("action_journal", f"SELECT id, 'status' AS op, '{{\"is_read\":' || CASE WHEN is_read THEN 'true' ELSE 'false' END || '}}' AS prev, false AS undone FROM emails WHERE id IN {_TEN}")
def _(m):
    return actions.status(m, _ten(m), "mark_read", AS_OF).journal.select("id", "op", "prev", "undone")


@query("action_undo", "SELECT id, is_flagged, flag_color, mailbox_role FROM emails")
def _(m):
    done = actions.status(m, _ten(m), "unflag", AS_OF)
    return actions.undo(done.emails, done.journal)[0].select("id", "is_flagged", "flag_color", "mailbox_role")


@query("action_undo_order", f"SELECT id, CASE WHEN id IN {_TEN} THEN true ELSE is_read END AS is_read, CASE WHEN id IN {_TEN} THEN 'Archive' ELSE mailbox_role END AS mailbox_name, is_flagged, flag_color FROM emails")
def _(m):
    """Three changes of one second; the newest alone is taken back."""
    journal, box = m.sparkSession.createDataFrame([], actions.JOURNAL), m
    for change in (lambda b: actions.status(b, _ten(m), "mark_read", AS_OF), lambda b: actions.move(b, _ten(m), "Archive", "archive", AS_OF), lambda b: actions.status(b, _ten(m), "set_flag_color", AS_OF, "blue")):
        done = change(box)
        box, journal = done.emails, actions.appended(journal, done.journal)
    return actions.undo(box, journal)[0].select("id", "is_read", "mailbox_name", "is_flagged", "flag_color")


@query("empty_trash", "SELECT id FROM emails WHERE NOT (mailbox_role = 'junk' AND account_uuid = 'acct1')")
def _(m):
    t = m.withColumn("mailbox_role", F.when(F.col("mailbox_role") == "junk", "trash").otherwise(F.col("mailbox_role")))
    return actions.empty_trash(t, "acct1", confirm=True).emails.select("id")


@query("drafts", "SELECT id, date_received FROM emails WHERE mailbox_role = 'archive' ORDER BY date_received DESC, id LIMIT 50")
def _(m):
    t = m.withColumn("mailbox_role", F.when(F.col("mailbox_role") == "archive", "drafts").otherwise(F.col("mailbox_role")))
    return actions.drafts(t).select("id", "date_received")


@query("resolve_targets", "SELECT 'e' || event_id || '@x' AS target, CASE WHEN event_id % 4 = 3 THEN 'not_found' ELSE 'found' END AS status, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN event_id + 1000000 ELSE event_id END AS id FROM events", emails=False)
def _(spark, d):
    m = events_as_emails(read(spark, d, "events")).select("id", "message_id", "date_received")
    held = m.where("id % 4 <> 3").unionByName(m.where("id % 4 = 1").withColumn("id", F.col("id") + 1000000).withColumn("date_received", F.col("date_received") + 5))
    name = F.col("message_id").alias("target")
    hints = m.where("id % 4 = 0").select(name, "id").unionByName(m.where("id % 4 = 2").select(name, (F.col("id") + 7).alias("id")))  # the latter are of other messages by now
    cache = m.where("id % 4 = 2").select(name, "id", F.lit(1).alias("verified_at"))
    return actions.resolve(actions.candidates(m.select(name), hints, cache, held))


@query("rules_switched", "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN false ELSE true END AS enabled FROM region WHERE r_name <> 'AFRICA'", emails=False)
def _(spark, d):
    rules = read(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(True).alias("enabled"))
    return actions.delete_rule(actions.set_rule(rules, "ASIA", False), "AFRICA", confirm=True)


@query("mailbox_created", "SELECT DISTINCT account_uuid, mailbox_role AS mailbox_name, CASE WHEN mailbox_role IN ('inbox', 'sent', 'archive', 'junk') THEN mailbox_role ELSE 'other' END AS mailbox_role FROM emails UNION ALL SELECT 'acct1', 'Work', 'other' UNION ALL SELECT 'acct1', 'Work/Sent', 'sent'")
def _(m):
    boxes = m.select("account_uuid", "mailbox_name", fn.mailbox_role(F.col("mailbox_name")).alias("mailbox_role")).distinct()
    return actions.create_mailbox(boxes, "acct1", "Sent", "Work")


@query("thread_fetch", "SELECT conv_id * 1000 + turn AS id, turn::INTEGER AS position FROM conversations WHERE conv_id = 3", emails=False)
def _(spark, d):
    m = conversations_as_emails(read(spark, d, "conversations"))
    return threads.fetch(m, threads.threads(m).select("id", "thread_id", "position"), "c3-t1").select("id", "position")


_MERGED = f"""WITH RECURSIVE {EMAILS_SQL}, n AS (SELECT id, message_id, date_received AS date, subject_norm AS subject, CASE WHEN in_reply_to IN (SELECT message_id FROM emails) THEN in_reply_to END AS up, CASE WHEN in_reply_to NOT IN (SELECT message_id FROM emails) THEN in_reply_to END AS ghost FROM emails),
r AS (SELECT id, first_value(id) OVER (PARTITION BY subject ORDER BY date, id) AS anchor FROM n WHERE up IS NULL AND ghost IS NULL AND subject <> ''),
w AS (SELECT n.id, n.message_id, coalesce(a.message_id, n.ghost, n.message_id) AS top, CASE WHEN a.id IS NOT NULL THEN [{{'d': n.date, 'm': 1, 'i': n.id}}] WHEN n.ghost IS NOT NULL THEN [{{'d': n.date, 'm': 0, 'i': n.id}}] ELSE []::STRUCT(d BIGINT, m INTEGER, i BIGINT)[] END AS path FROM n LEFT JOIN r USING (id) LEFT JOIN n a ON a.id = r.anchor AND r.anchor <> n.id WHERE n.up IS NULL
  UNION ALL SELECT n.id, n.message_id, w.top, list_append(w.path, {{'d': n.date, 'm': 0, 'i': n.id}}) FROM w JOIN n ON n.up = w.message_id)
SELECT id, first_value(id) OVER (PARTITION BY top ORDER BY path) AS thread_id, (row_number() OVER (PARTITION BY top ORDER BY path) - 1)::INTEGER AS position, len(path)::INTEGER AS depth FROM w"""


@query("thread_subject_merge", _MERGED, emails=False)
def _(spark, d):
    return threads.threads(events_as_emails(read(spark, d, "events")), by_subject=True)


@query("thread_sizes", "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT n, count(*) AS threads FROM c GROUP BY 1", emails=False)
def _(spark, d):
    placed = threads.threads(conversations_as_emails(read(spark, d, "conversations")))
    return placed.groupBy("thread_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("threads"))


@query("copies_ranked", "SELECT id, row_number() OVER (PARTITION BY subject_norm ORDER BY date_received DESC, id) AS n FROM emails WHERE subject_norm <> '' QUALIFY n <= 3")
def _(m):
    w = Window.partitionBy("subject_norm").orderBy(F.desc_nulls_last("date_received"), "id")
    return m.where("subject_norm <> ''").select("id", F.row_number().over(w).cast("long").alias("n")).where("n <= 3")


@query("text_helpers", "SELECT p_partkey, (p_partkey + 978307200)::BIGINT AS apple, [trim(x) FOR x IN string_split(p_name, ' ') IF trim(x) <> ''] = [trim(x) FOR x IN string_split(p_name, ' ') IF trim(x) <> ''] AS same, 'a &lt;b&gt; &amp; ' || p_brand AS html, 1718409600::BIGINT AS day FROM part", emails=False)
def _(spark, d):
    addresses = fn.listed_addresses(F.concat_ws(" , ", F.split("p_name", " "), F.lit("")))
    words = F.filter(F.split("p_name", " "), lambda x: x != "")
    return read(spark, d, "part").select("p_partkey", fn.apple_seconds(F.col("p_partkey")).alias("apple"), (addresses == words).alias("same"), fn.escaped(F.concat(F.lit("a <b> & "), F.col("p_brand"))).alias("html"), fn.day_seconds(F.lit("2024-06-15")).alias("day"))
