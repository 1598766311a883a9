"""The mail tree, the store built from it, its index, and the watch loop."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from helpers import ACCOUNT, docx, emlx, put
from postlake import config, recipes
from postlake.api import COLUMNS, WEIGHTS, Mailbox, indexed
from postlake.errors import InvalidArgument, InvalidOutputPath, NotFound, ReadOnly
from postlake.operators import actions, embedding, export, filters, index, segments, store, threads
from postlake.sources import accounts, attachments, emlx as source, mail
from postlake.streaming.watch import Watch

NOW = 1_717_100_000


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "V10"
    put(root, 1, emlx("Budget for autumn", mid="a@x", body="The plan is attached.", attachments=[("plan.docx", docx("figure 4471 inside")), ("pic.png", b"\x89PNG")]))
    put(root, 2, emlx("Re: Budget for autumn", sender="ben@cart.example", to="ann@mill.example", mid="b@x", reply="a@x", refs=["a@x"], body="Thanks, the budget looks right.", received=1_717_000_500))
    put(root, 3, emlx("Lunch", mid="c@x", body="Pizza on Friday? naïve café"), mailbox="Work/Sent Messages")
    put(root, 4, b"not-a-number\nbroken")
    return root


def test_build_changes_moves_and_dead_letters(spark, tree, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store")
    first = store.build(kept, str(tree), NOW)
    assert (first.added, first.changed, first.deleted, first.moved, first.failed) == (3, 0, 0, 0, 1)
    rows = {r["rowid"]: r for r in kept.emails().collect()}
    assert rows[3]["mailbox"] == "Work/Sent Messages" and rows[3]["mailbox_role"] == "sent" and rows[1]["account"] == ACCOUNT
    assert rows[2]["thread_id"] == rows[1]["thread_id"] == rows[1]["id"] and rows[2]["thread_position"] == 1
    assert [r["attempts"] for r in kept.dead().collect()] == [1]
    kept.commit(store.recoloured(kept.emails(), F.col("rowid") == 2, 3))
    put(tree, 4, emlx("Mended", mid="d@x"))
    path = put(tree, 2, emlx("Re: Budget for autumn, again", mid="b@x", reply="a@x", refs=["a@x"], received=1_717_000_500))
    (tree / ACCOUNT / "Work.mbox").rename(tree / ACCOUNT / "Old.mbox")
    second = store.build(kept, str(tree), NOW + 60)
    assert (second.added, second.changed, second.deleted, second.moved, second.failed) == (1, 1, 0, 1, 0)
    after = {r["rowid"]: r for r in kept.emails().collect()}
    assert after[3]["mailbox"] == "Old/Sent Messages" and after[3]["id"] == rows[3]["id"] and after[3]["subject"] == "Lunch"
    assert after[2]["flag_color"] == 3 and after[2]["subject"].endswith("again") and after[2]["id"] == rows[2]["id"] and not kept.dead().count()
    path.unlink()
    state = store.status(kept, str(tree), NOW + 61)
    assert state["pending"] == 1 and state["stale"] and state["total"] == 4
    assert store.build(kept, str(tree), NOW + 62).deleted == 1 and kept.emails().count() == 3
    assert not store.status(kept, str(tree), NOW + 63)["stale"] and store.status(kept, str(tree), NOW + 200_000)["stale"]
    assert len(kept.versions()) == 2


def test_mailbox_tools(spark, tree, tmp_path):
    box = Mailbox(store.Store(spark, f"file://{tmp_path}/store"), str(tree), clock=lambda: NOW)
    with pytest.raises(NotFound):
        box.emails
    box.build()
    hits = box.search("budget")
    assert hits.total_estimated == 2 and [r["message_id"] for r in hits.hits.collect()] == ["b@x", "a@x"]  # b has it in the body too
    assert box.search("budget", scope="subject").total_estimated == 2 and box.search("thank").total_estimated == 1
    assert "»budget«" in [r["snippet"] for r in box.search("budgets NOT attached").hits.collect()][0]
    assert box.search("cafe NAIVE").total_estimated == 1 and box.search("(oops").total_estimated == 0 and box.search("4471").total_estimated == 0
    assert box.search("budget", unread=True).total_estimated == 0
    found = attachments.extracted(box.emails, mail.files(spark, str(tree)))
    texts = {r["rowid"]: (r["attachment_text"], r["extract_state"]) for r in found.collect()}
    assert texts[1] == ("figure 4471 inside", 2) and texts[3] == (None, 0)
    assert [r["message_id"] for r in box.get_email_thread(message_id="b@x").collect()] == ["a@x", "b@x"]
    assert box.get_email_attachment("a@x", "pic.png").first()["data"] == b"\x89PNG" and box.get_email("b@x").first()["subject"].startswith("Re:")
    assert box.get_inbox_overview()["counts"].first()["total"] == 2 and {r["address"] for r in box.list_contacts().collect()} >= {"ann@mill.example", "ben@cart.example"}
    ids = [r["id"] for r in box.emails.where("mailbox_role = 'inbox'").collect()]
    for color in ("red", "green", "blue", "purple", "gray"):
        box.update_email_status(ids[:1], "set_flag_color", color)  # five changes at one clock value
    for left in ("purple", "blue", "green", "red", None):
        box.undo_last()
        assert [r["flag_color"] for r in box.emails.where(f"id = {ids[0]}").collect()] == [filters.color_index(left) if left else None]
    done = box.move_email(ids[:1], "Archive")
    assert done.n == 1 and box.emails.where("mailbox_role = 'archive'").count() == 1 and box.update_email_status([ids[0], 999], "set_flag_color", "blue").failed == {999: "not_found"}
    box.undo_last()
    box.undo_last(done.batch)
    assert box.emails.where("mailbox_role = 'archive'").count() == 0 and box.emails.where("flag_color is not null").count() == 0
    assert box.resource("email://stats").first()["total"] == 3
    tree_of = box.get_email_thread_tree("b@x")
    assert [(n["message_id"], [c["message_id"] for c in n["children"]]) for n in tree_of] == [("a@x", ["b@x"])]
    box.config["server"]["read_only"] = True
    with pytest.raises(ReadOnly):
        box.manage_trash("trash", ids[:1])
    assert box.export_emails(f"file://{tmp_path}/out") == 3 and len([*(tmp_path / "out").glob("*.txt")]) == 3


def test_written_messages_rules_and_mailboxes(spark, tree, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, "a@x", "Plan", "ann@x", "Ann", "u1", "One", "INBOX", "inbox", 5, "text"), (2, "b@x", "Other", "bob@x", "Bob", "u2", "Two", "Work", "other", 6, "text")], "id long, message_id string, subject string, sender_addr string, sender_name string, account_uuid string, account_name string, mailbox_name string, mailbox_role string, date_received long, body_plain string")
    kept.commit(rows.withColumn("recipients", F.array(F.lit("me@x"))).withColumn("references", F.array().cast("array<string>")))
    box = Mailbox(kept, str(tree), config.load(given={"confirmation": {"require_confirm": []}}), clock=lambda: NOW)
    name = box.compose_email(["a@x"], "Hello", "words", cc=["c@x"])
    box.reply_to_email(1, "Thanks", mode="send")
    assert {(r["subject"], r["mode"]) for r in kept.outbox().collect()} == {("Hello", "draft"), ("Re: Plan", "send")} and box.compose_email([], "x", "y", dry_run=True) and kept.outbox().count() == 2
    assert [r["draft"] for r in box.manage_drafts().collect()] == [name] and box.manage_drafts("open", draft_subject="Hello").first()["cc"] == ["c@x"]
    assert box.manage_drafts("create", subject="Second", to=["z@x"]).first()["to"] == ["z@x"]
    box.manage_drafts("send", draft_subject="Second")
    box.manage_drafts("delete", draft_subject="Hello")
    assert {(r["subject"], r["mode"]) for r in kept.outbox().collect()} == {("Second", "send"), ("Re: Plan", "send")} and box.manage_drafts().count() == 0
    with pytest.raises(NotFound):
        box.manage_drafts("open", draft_subject="Hello")
    with pytest.raises(InvalidArgument):
        box.compose_email([], "no one", "x", mode="send")
    assert box.create_rich_email_draft("<b>x</b>", "Rich", ["a@x"], outbox=str(tmp_path / "box")).endswith(".eml")
    box.set_rules(spark.createDataFrame([("r1", True, "{}", "{}"), ("r2", True, "{}", "{}")], actions.RULES))
    box.disable_rule("r2")
    box.delete_rule("r1")  # the settings want no confirmation
    assert [(r["name"], r["enabled"]) for r in box.list_rules().collect()] == [("r2", False)]
    assert {r["mailbox_name"] for r in box.create_mailbox("u1", "Sub", "Top").collect()} == {"INBOX", "Work", "Top", "Top/Sub"}
    assert box.move_email([1], "Work", to_account="Two").n == 1 and box.emails.where("id = 1").first()["account_uuid"] == "u2"
    box.undo_last()
    assert (m := box.emails.where("id = 1").first())["account_uuid"] == "u1" and m["account_name"] == "One" and m["mailbox_name"] == "INBOX"
    with pytest.raises(NotFound):
        box.move_email([1], "Work", to_account="Three")
    assert threads.nested([{"m": 1, "depth": 1}, {"m": 2, "depth": 1}]) == [{"children": [{"m": 1, "children": []}, {"m": 2, "children": []}]}]


def test_watch(spark, tree, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store")
    seen = []
    w = Watch(kept, str(tree), clock=lambda: NOW, background=(lambda s: seen.append(s.versions()[-1]),), optimize=lambda s: seen.append("optimized"))
    w.start(f"file://{tmp_path}/check", every=None).awaitTermination(120)
    assert [t.added for t in w.ticks] == [3] and not w.errors and seen == []
    w.start_background(f"file://{tmp_path}/work", every=None).awaitTermination(120)
    assert seen == [1]
    put(tree, 9, emlx("New", mid="z@x"))
    w.start(f"file://{tmp_path}/check", every=None).awaitTermination(120)
    assert w.ticks[-1].added == 1 and kept.emails().count() == 4
    w.root, w.failures = str(tmp_path / "none"), 2
    w.tick()
    assert len(w.errors) == 1
    with pytest.raises(Exception):
        w.tick()


def test_watch_keeps_the_index(spark, tree, tmp_path):
    class Shapes(embedding.Backend):
        name, dimension = "shapes", 3

        def embed(self, texts):
            return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]

    settings = config.load(given={"index": {"enable_trigram": True}, "attachments": {"enabled": True}, "batch_limits": {"delete": 1}})
    box = Mailbox(store.Store(spark, f"file://{tmp_path}/store"), str(tree), settings, clock=lambda: NOW, embed=Shapes())
    w = box.watch()
    w.tick()
    assert not w.errors and len(box.index.segments) == 1 and box.index.n == 3 and len(w.background) == 2
    path = put(tree, 9, emlx("New budget", body="a wholly new file zebra-fish_7.dat", mid="z@x"))
    w.tick()
    assert len(box.index.segments) == 2 and box.index.n == 4 and box.search("zebra").total_estimated == 1 and box.search("ebra-fis").mode == "substring"
    assert box.search("ebra-fis").total_estimated == 1 and box.search("4471").total_estimated == 0
    path.unlink()
    w.work()
    w.tick()
    assert not w.errors and box.search("zebra").total_estimated == 0 and box.search("ebra-fis").total_estimated == 0 and box.index.n == 3
    assert box.search("4471").total_estimated == 1 and box.store.vectors().count() >= 3 and box.search("budget", mode="semantic").mode == "semantic"
    whole = index.build(indexed(box.emails), COLUMNS, f"file://{tmp_path}/whole", WEIGHTS)
    for q in ("budget", "the OR lunch", "not*"):
        assert sorted(index.matches(box.index, spark, q).collect()) == sorted(index.matches(whole, spark, q).collect())
    w.work()
    assert box.store.emails().where("embed_state = 0").count() == 0 and len(box.index.segments) <= 4
    box.manage_trash("permanent_delete", [box.emails.first()["id"]], confirm=True)
    assert box.search("budget OR lunch OR 4471 OR some").total_estimated == 2 and box.index.n == 2
    assert len([n for n in (tmp_path / "store" / "index").iterdir() if n.name.startswith("seg-")]) <= 1 + len(box.index.segments)


def test_segments_merge_by_size(spark, tmp_path):
    texts = {k: f"common w{k} w{k % 7} tail{k % 3}" for k in range(60)}
    rows = lambda ids, more="": spark.createDataFrame([(k, texts[k] + more) for k in ids], "doc_id long, text string")
    held = index.build(rows(range(40), " old"), {"t": "text"}, f"file://{tmp_path}/i", grams=("t",), stemmed=False)
    for a in range(0, 60, 12):
        held = index.updated(held, rows(range(a, a + 12)), spark.createDataFrame([(a,)], "doc_id long") if a == 0 else None)
    kept = index.build(rows(range(60)), {"t": "text"}, f"file://{tmp_path}/whole", grams=("t",), stemmed=False)
    queries = ("w1*", "old", "tail1 NOT w3")

    def same(x):
        assert x.n == 60 and x.mean_length == kept.mean_length
        for q in queries:
            assert {(r[0], round(r[1], 9)) for r in index.matches(x, spark, q).collect()} == {(r[0], round(r[1], 9)) for r in index.matches(kept, spark, q).collect()}, q
        for needle in ("MMON w1", "w59 w3 tail"):
            assert {r[0] for r in segments.holding(x, spark, needle).collect()} == {k for k, t in texts.items() if needle.lower() in t and len(needle) > 2}, needle
        assert {tuple(r) for r in x.terms(spark).collect()} == {tuple(r) for r in kept.terms(spark).collect()}

    assert len(held.segments) == 6
    same(held)
    some = segments.merged(held, spark, 2)
    assert len(some.segments) == 3 and [s.docs for s in some.segments] == [40, 12, 48]
    same(some)
    all_of_it = segments.merged(some, spark, 0)
    assert len(all_of_it.segments) == 1 and not all_of_it.segments[0].gone
    same(all_of_it)
    assert segments.opened(spark, all_of_it.path) == all_of_it and segments.opened(spark, f"file://{tmp_path}/none") is None
    empty = index.updated(all_of_it, rows([]), spark.createDataFrame([(k,) for k in texts], "doc_id long"))
    assert empty.n == 0 and index.matches(empty, spark, "common").count() == 0


def test_attachments_beside_partial_messages(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, 5, emlx("Half", mid="h@x"), partial=True)
    own = root / ACCOUNT / "INBOX.mbox" / "Data" / "Attachments" / "5" / "2"
    own.mkdir(parents=True)
    data = docx("hidden heron")
    (own / "late.docx").write_bytes(data)
    box = Mailbox(store.Store(spark, f"file://{tmp_path}/store"), str(root), config.load(given={"attachments": {"enabled": True}}), clock=lambda: NOW)
    box.build()
    assert [(r["attachments"], r["attachment_count"]) for r in box.emails.collect()] == [(["late.docx"], 1)]
    assert box.get_email_attachment("h@x", "late.docx").first()["data"] == data
    box.extract()
    assert box.emails.first()["attachment_text"] == "hidden heron" and box.search("heron").total_estimated == 1


def test_mail_as_a_data_source(spark, tree, tmp_path):
    source.register(spark)
    rows = source.placed(spark.read.format("emlx").option("files", 2).load(f"file://{tree}"))
    got = {r["rowid"]: r for r in rows.collect()}
    found = mail.files(spark, str(tree))
    want = {r["rowid"]: r for r in mail.messages(found).join(found.drop("content"), "path").collect()}
    assert rows.rdd.getNumPartitions() == 2 and got.keys() == want.keys() and got[4]["error"].startswith("ValueError") and {r["change"] for r in got.values()} == {"added"}
    for k in (1, 2, 3):
        assert all(got[k][c] == want[k][c] for c in ("account", "mailbox", "partial", "size", "mtime_us", "message_id", "subject", "recipients_to", "references", "body_plain", "date_sent", "is_read", "attachments"))
    assert source.placed(spark.read.format("emlx").load(f"file://{tmp_path}/none")).count() == 0

    def run():
        stream = spark.readStream.format("emlx").option("listings", f"file://{tmp_path}/listings").load(f"file://{tree}")
        stream.select("path", "change", "subject").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination(120)
        return sorted((r["path"].rsplit("/", 1)[1], r["change"], r["subject"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    first = run()
    assert [r[:2] for r in first] == [(f"{k}.emlx", "added") for k in (1, 2, 3, 4)]
    next(tree.rglob("3.emlx")).unlink()
    put(tree, 2, emlx("Changed", mid="b@x", body="longer than it was before, by some words"))
    put(tree, 8, emlx("Newer", mid="n@x"))
    assert sorted(set(run()) - set(first)) == [("2.emlx", "changed", "Changed"), ("3.emlx", "deleted", None), ("8.emlx", "added", "Newer")]
    assert run() == run() and len([*(tmp_path / "listings").iterdir()]) <= 2


def test_export_leaves_whole_files_only(spark, tmp_path):
    m = spark.range(40).select("id", F.concat(F.lit("s"), "id").alias("subject"), F.lit("A").alias("sender_name"), F.lit("a@x").alias("sender_addr"), F.lit("words").alias("body_plain"), F.col("id").alias("date_received"))
    out = tmp_path / "out"
    assert export.export(m.repartition(4), f"file://{out}") == 40 and len([*out.glob("*.txt")]) == 40 and not [*out.glob("_*")]
    assert export.export(m, f"file://{out}", most=3) == 3 and len([*out.iterdir()]) == 40
    broken = export.files(m.repartition(2)).withColumn("content", F.when(F.col("filename").contains("s7"), F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        broken.write.format("named_files").mode("append").save(f"file://{tmp_path}/bad")
    assert not [*(tmp_path / "bad").glob("_*")] and all(f.read_text().endswith("words") for f in (tmp_path / "bad").glob("*.txt"))


def test_settings_limit_the_listing(spark, tmp_path):
    root = tmp_path / "tree"
    for k in range(5):
        put(root, k + 1, emlx(f"S{k}", mid=f"{k}@x"), mailbox=("INBOX", "INBOX", "INBOX", "Sent", "Old")[k])
    got = lambda **own: {r["rowid"] for r in store.listing(spark, str(root), **own).collect()}
    assert got() == {1, 2, 3, 4, 5} and got(include=["inbox", "OLD"]) == {1, 2, 3, 5} and got(without=[ACCOUNT.lower()]) == set() and got(exclude=["Sent"]) == {1, 2, 3, 5}
    assert len(got(most=1)) == 3 and len(got(most=2)) == 4


def test_mail_details(spark, tmp_path):
    root = tmp_path / "lib" / "V9"
    (tmp_path / "lib" / "V10").mkdir(parents=True)
    put(root, 1, emlx(headers=[("List-Unsubscribe", "<https://l.example/u?x=1>, <mailto:leave@l.example?subject=Go%20away>"), ("List-Unsubscribe-Post", "List-Unsubscribe=One-Click")]), mailbox="A/B")
    put(root, 2, emlx(to="x@a.example, Dee <d@a.example>"), partial=True)
    beside = root / ACCOUNT / "INBOX.mbox" / "Data" / "Attachments" / "2" / "1"
    beside.mkdir(parents=True)
    (beside / "late.pdf").write_bytes(b"x")
    assert mail.newest_tree(spark, str(tmp_path / "lib")).endswith("/V10") and mail.newest_tree(spark, str(tmp_path / "no")) is None
    found = mail.files(spark, str(root))
    m = {r["subject"] and r["path"].split("/")[-1]: r for r in mail.messages(found).collect()}["1.emlx"]
    assert (m["unsubscribe_https"], m["unsubscribe_mailto"], m["unsubscribe_subject"], m["one_click"], m["is_bulk"]) == (["https://l.example/u?x=1"], "leave@l.example", "Go away", True, True)
    assert {r["mailbox"] for r in found.select("mailbox").collect()} == {"A/B", "INBOX"} and [r[0] for r in mail.accounts(found).collect()] == [ACCOUNT]
    assert [(r["rowid"], r["attachments"]) for r in mail.partial_attachments(spark, str(root)).collect()] == [(2, ["late.pdf"])]


def test_accounts(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.sqlite")
    con.execute("create table ZACCOUNT (Z_PK integer, ZIDENTIFIER text, ZACCOUNTDESCRIPTION text, ZUSERNAME text, ZPARENTACCOUNT integer)")
    con.executemany("insert into ZACCOUNT values (?, ?, ?, ?, ?)", [(1, "u1", " Home ", None, None), (2, "u2", "  ", None, 3), (3, None, None, "me@x", None), (4, "u4", None, None, 5), (5, "u5", None, None, 4), *((10 + k, f"v{k}", None, None, 11 + k) for k in range(5)), (15, "v5", "Top", None, None)])
    con.commit()
    con.close()
    got = {r[0]: r[1] for r in accounts.names(accounts.rows(spark, str(tmp_path / "a.sqlite"))).collect()}
    assert got == {"u1": "Home", "u2": "me@x", "v5": "Top", "v4": "Top", "v3": "Top", "v2": "Top", "v1": "Top"}
    assert accounts.names(accounts.rows(spark, str(tmp_path / "none"))).count() == 0


def test_settings_recipes_and_paths(tmp_path):
    (tmp_path / "c.toml").write_text("[server]\nread_only = true\n[batch_limits]\nmove = 3\n")
    c = config.load(str(tmp_path / "c.toml"), {"POSTLAKE_BATCH_LIMITS_MOVE": "4", "POSTLAKE_ATTACHMENTS_ENABLED": "yes", "POSTLAKE_INDEX_EXCLUDE_MAILBOXES": "Drafts, Junk"}, {"server": {"read_only": False}})
    assert c["batch_limits"]["move"] == 4 and c["attachments"]["enabled"] and c["index"]["exclude_mailboxes"] == ["Drafts", "Junk"] and not c["server"]["read_only"] and config.DEFAULTS["batch_limits"]["move"] == 1
    with pytest.raises(InvalidArgument):
        config.load(given={"server": {"port": 1}})
    assert "last 3 days" in recipes.render("awaiting-reply", days_back="3") and len(recipes.RECIPES) == 5
    with pytest.raises(NotFound):
        recipes.render("none")
    assert export.checked(str(tmp_path / "x"), str(tmp_path)).name == "x"
    for bad in ("/etc/passwd", str(tmp_path / ".ssh" / "k")):
        with pytest.raises(InvalidOutputPath):
            export.checked(bad, str(tmp_path))
    old = export.put_in_outbox(export.draft("Hi", ["a@x"], "text", "<b>t</b>"), str(tmp_path / "box"), 0)
    assert old.exists() and export.put_in_outbox(export.draft("Hi", [], "t"), str(tmp_path / "box"), 9e9).exists() and not old.exists()
    assert store.as_list('["a", "b"]') == ["a", "b"] and store.as_list("a") == ["a"] and store.as_list(None) == []
    assert attachments.docx_text(b"no") is None and attachments.text_of("a.pdf", b"no") is None and attachments.text_of("a.docx", docx("hi"), most=3) is None
