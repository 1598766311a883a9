import random
import re
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import forest
from postlake.errors import BatchTooLarge, ConfirmationRequired, InvalidArgument, ReadOnly
from postlake.files import Scratch
from postlake.functions.stem import stem
from postlake.operators import actions, filters, grammar, index, threads
from postlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "part orders events documents embeddings pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["top_senders", "awaiting_reply_all", "needs_response", "contacts", "inventory_diff", "dead_letter_merge", "bm25_search", "near_search", "search_page", "search_hybrid", "thread_summary", "contacts_all_recipients", "overview_counts", "account_overview", "action_undo", "text_helpers"])
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.execute(catalog.ORACLES[name]).df()
    clean = lambda rows, cols: sorted(str([None if r[c] is None or r[c] != r[c] else r[c] for c in cols]).replace(".0,", ",").replace(".0]", "]") for r in rows)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert clean([r.asDict() for r in got.collect()], cols) == clean(want.astype(object).to_dict("records"), cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


MAIL = "id long, message_id string, `references` array<string>, in_reply_to string, subject_norm string, date_received long"


def random_mail(seed, n=160):
    """Small groups with repeated ids, unseen ids, circles and equal dates, and bare messages."""
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        g = rng.randrange(n // 8)
        name = lambda k: f"g{g}-m{k}"
        chain = [name(rng.randrange(7)) for _ in range(rng.randrange(4))]
        rows.append((i, None if i % 40 == 0 else name(rng.randrange(6)), chain, name(rng.randrange(7)) if rng.random() < 0.3 else None, rng.choice(["", "plan", "lunch", f"s{g}"]), rng.choice([None, 5, 5, 9, rng.randrange(99)])))
    return rows


def by_hand(rows):
    """(id, thread, position, depth) without merged subjects."""
    chained = [{"id": i, "message_id": m, "chain": refs + ([reply] if reply and reply not in refs else []), "date": d, "subject": s} for i, m, refs, reply, s, d in rows if m]
    at = {r["message_id"]: (r["thread_id"], r["position"], r["depth"]) for r in forest(chained)}
    return {i: at[m] if m else (i, 0, 0) for i, m, *_ in rows}


def test_threads_of_random_links(spark):
    rows = random_mail(1) + [(1000 + i, f"circle{i}", [f"circle{(i + 1) % 9}"], None, "", 0) for i in range(9)]
    got = {r["id"]: (r["thread_id"], r["position"], r["depth"]) for r in threads.threads(spark.createDataFrame(rows, MAIL)).collect()}
    assert got == by_hand(rows)
    assert threads.threads(spark.createDataFrame([], MAIL), by_subject=True).count() == 0


def test_long_and_wide_threads(spark):
    chain = spark.range(3000).select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.when(F.col("id") > 0, F.concat(F.lit("m"), (F.col("id") - 1).cast("string"))).alias("in_reply_to"), F.col("id").alias("date_received"))
    wide = spark.range(3000, 6000).select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.when(F.col("id") > 3000, F.lit("m3000")).alias("in_reply_to"), (-F.col("id")).alias("date_received"))
    placed = threads.threads(chain.unionByName(wide))
    assert placed.where("id < 3000 and (position <> id or depth <> id or thread_id <> 0)").count() == 0
    assert placed.where("id > 3000 and (position <> 6000 - id or depth <> 1 or thread_id <> 3000)").count() == 0 and placed.count() == 6000


def test_a_change_rebuilds_touched_threads_only(spark, monkeypatch):
    rows = random_mail(2)
    left = [r for r in rows if r[0] % 16 != 3]  # ten come later
    altered = [(i, m, refs if i != 20 else ["g1-m1"], reply, s if i != 21 else "plan", d) for i, m, refs, reply, s, d in rows if i not in (50, 51)]
    before, emails = spark.createDataFrame(left, MAIL), spark.createDataFrame(altered, MAIL)
    changed = spark.createDataFrame([(r[0],) for r in rows if r[0] % 16 == 3 or r[0] in (20, 21, 50, 51)], "id long")
    with Scratch(spark) as scratch:
        old = threads.first_places(before, scratch)
        asked, build = [], threads.nodes
        monkeypatch.setattr(threads, "nodes", lambda m, s: asked.append(m.count()) or build(m, s))
        new = threads.next_places(old, before, emails, changed, scratch)
        assert asked[0] < len(altered)  # the messages of touched components
        whole = threads.first_places(emails, scratch)
        assert sorted(new.placed.collect()) == sorted(whole.placed.collect())
        assert sorted(new.refs.collect()) == sorted(whole.refs.collect()) and sorted(map(str, new.nodes.select(*whole.nodes.columns).collect())) == sorted(map(str, whole.nodes.collect()))


def words(query):
    """The leaves as text, and how they are combined."""
    split = lambda s: re.findall(r"[^\W_]+", s.lower())
    leaves, expr = grammar.parse(query, split)
    name = lambda leaf: " ~ ".join(" ".join(w + "*" * p for w, p in phrase) for phrase in leaf.phrases) + (f" {leaf.near}" if leaf.near else "")

    def shown(e):
        return name(leaves[e.leaf]) if e.op == "leaf" else f"({shown(e.left)} {e.op} {shown(e.right)})"

    return shown(expr) if expr else None


def test_query_grammar():
    assert words("budget review*") == "(budget and review*)"
    assert words("alice@example.com") == "alice example com"
    assert words('a "b c') == "a b c"
    assert words("a OR b NOT c d") == "(a or (b not (c and d)))"
    assert words("a OR b AND c") == "(a or (b and c))"
    assert words("(a OR b) AND c") == "((a or b) and c)"
    assert words('"a b" + c NEAR(d "e f", 4)') == "(a b c and d ~ e f 4)"
    assert words("near and not") == "((near and and) and not)"
    assert words("AND") == "and" and words("(a OR") == "(a and or)" and words("a )") == "a"
    assert words("") is None and words("  ?! ") is None and words("don't what?") == "(don t and what)"
    assert grammar.wants_substring("report-q3") and not grammar.wants_substring("a b.c")


def test_stems_are_those_of_the_standard_index():
    con = sqlite3.connect(":memory:")
    given = "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky one at by apologies geology running budgets invoices meetings quarterly reviewing universities yes eying sayings".split()
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    for k, w in enumerate(given, 1):
        con.execute("insert into t (rowid, x) values (?, ?)", (k, w))
    want = dict(con.execute("select doc, term from v").fetchall())
    assert {w: stem(w) for w in given} == {w: want[k] for k, w in enumerate(given, 1)}


def test_snippets():
    text = " ".join(f"w{k}" for k in range(40)) + " budget plan"
    assert index.snippet_of(text, {"budget"}.__contains__, 4) == "…w38 w39 »budget« plan"
    assert index.snippet_of("a b c", {"x"}.__contains__, 2) == "a b…" and index.snippet_of(None, {"x"}.__contains__) == ""


def test_subject_merge(spark):
    row = lambda i, s, reply=None, date=0: (i, f"m{i}", reply, s, date)
    rows = [row(1, "budget q3", date=9), row(2, "budget q3", date=4), row(3, "budget q3", "m1", 20), row(4, "other", date=1), row(5, "", date=1), row(6, "", date=2), row(7, "x", "ghost", 5), row(8, "x", "ghost", 3), row(9, "budget q3", "m2", 30), row(10, "budget q3", "m2", 6)]
    emails = spark.createDataFrame([*rows, (11, None, None, "x", 0)], "id long, message_id string, in_reply_to string, subject_norm string, date_received long")
    got = {r["id"]: (r["thread_id"], r["position"], r["depth"]) for r in threads.threads(emails, by_subject=True).collect()}
    # 2 is the earliest root; its children by date: 10 (6), tree of 1 (9), 9 (30).
    assert got == {2: (2, 0, 0), 10: (2, 1, 1), 1: (2, 2, 1), 3: (2, 3, 2), 9: (2, 4, 1), 4: (4, 0, 0), 5: (5, 0, 0), 6: (6, 0, 0), 8: (8, 0, 1), 7: (8, 1, 1), 11: (11, 0, 0)}


def test_actions(spark):
    emails = spark.createDataFrame([(i, "INBOX", "inbox", False, True, 3) for i in range(12)], "id long, mailbox_name string, mailbox_role string, is_read boolean, is_flagged boolean, flag_color int")
    with pytest.raises(ReadOnly):
        actions.move(emails, [1], "Archive", "archive", 1, read_only=True)
    with pytest.raises(BatchTooLarge):
        actions.move(emails, [*range(12)], "Archive", "archive", 1)
    with pytest.raises(ConfirmationRequired):
        actions.delete(emails, [1])
    done = actions.status(emails, [1, 2, 99], "unflag", 5)
    assert done.n == 2 and {r["id"]: r["flag_color"] for r in done.emails.collect()}[1] is None
    back, journal = actions.undo(done.emails, done.journal)
    assert sorted(back.collect()) == sorted(emails.collect()) and journal.where("not undone").count() == 0


def test_unknown_colour():
    with pytest.raises(InvalidArgument):
        filters.color_index("mauve")
