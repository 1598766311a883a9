"""Mixing, fill-in-middle and periodic runs against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import fim, mixing, periodic, queries, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"
PROSE = " ".join(f"w{i * 7 % 61}t{i % 13}" for i in range(900))
ROWS = [
    (0, PROSE, "a"), (1, PROSE, "a"), (2, None, None), (3, "", "b"), (4, "to be or not " * 9 + "to be", "b"), (5, "x " * 4000, "c"), (6, "漢字 Größe\n\tΣΑΣ " * 300, "c"), (7, "has <S> in it", "c"), (8, " \n ", "empty"),
    (9, PROSE[:2000], None), (9, PROSE[:2000], None), (None, PROSE[:700], "b"), (None, PROSE[:700], "b"), (None, None, "b"), (10, "word", "one"), *((i, f"{PROSE[i : i + 300]} end", "hot") for i in range(20, 90)),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("n", "form", "output", "restored", "runs", "start", "size", "sid", "shard", "h", "target", "begin", "words")
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# Mixing
def rows_of(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())


def test_mix_is_its_sql_twin(spark, docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", ROWS)
    for options in ({"block": 7, "seed": 3}, {"weights": (1, 9), "share": 0.4, "most": 1, "block": 16}, {"share": 2.0, "block": 1000}):
        got = rows_of(mixing.mix(docs, **options))
        assert got == collections.Counter(con.execute(mixing.oracle(**options)).fetchall()), options
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7)))


def test_mix_meets_targets_and_says_which_words(spark, docs):
    got = mixing.mix(docs, block=8).collect()
    total, of = sum(r["size"] for r in got), collections.defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["length"] * s["times"] for s in r["spans"])
        times = np.zeros(r["size"], int)
        for s in r["spans"]:
            times[s["start"] : s["start"] + s["length"]] += s["times"]
            assert 0 <= s["start"] and s["start"] + s["length"] <= r["size"] and s["length"] >= 0
        assert times.max(initial=0) <= 2
        of[r["source"]].append(r)
    # Who is not at the most shares by weight; the others are at it.
    level = {s: (x[0]["target"] / w, 2 * x[0]["source_size"] / w) for (s, x), w in zip(sorted(of.items(), key=lambda x: (x[0] is None, x[0])), [5, 2, 1] * 9)}
    top = max(a for a, _ in level.values())
    assert all(a == pytest.approx(min(top, b)) for a, b in level.values())
    assert sum(x[0]["target"] for x in of.values()) == pytest.approx(1.5 * total)
    for x in of.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 8
    assert mixing.mix(docs.limit(0)).count() == 0 and {r["taken"] for r in mixing.mix(docs.where("text is null or doc_id = 3")).collect()} == {0}


def test_seats_go_by_highest_quotients(spark):
    rng = np.random.default_rng(5)
    for n in (1, 7, 60):
        votes = [float(v) for v in rng.choice([1, 2, 2.5, 7, 30, 400], n)]
        caps = [int(c) for c in rng.integers(1, 50, n)]
        parties = spark.createDataFrame([*zip(range(n), votes, caps)], "sid long, vote double, cap long")
        for house in (sum(caps) // 2, sum(caps) - 1):
            order = sorted((-v / (2 * k - 1), i, k) for i, (v, c) in enumerate(zip(votes, caps)) for k in range(1, c + 1))
            want = collections.Counter(i for _, i, _ in order[:house])
            with mixing.Scratch(spark) as scratch:
                got = {r["sid"]: r["seats"] for r in mixing.seats_of_sources(parties, house, scratch).collect()}
            assert got == {i: want[i] for i in range(n)}


# Fill-in-middle
def filled(doc_id, text):
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (n, "psm", i, j - i, f"<P>{a}<S>{c}<M>{b}")


def test_fill_in_middle(spark, docs, empty):
    got = collections.Counter(tuple(r) for r in fim.restore(fim.transform(docs)).collect())
    assert got == collections.Counter((i, *filled(i, t or ""), t or "") for i, t, _ in ROWS)
    assert fim.restore(fim.transform(empty)).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (*(x := filled(i, t or ""))[:4], sha(x[4]), sha(t or "")) for i, t in table}
    assert {r[0]: tuple(r)[1:] for r in queries.op12_fill_in_middle(spark, SF).collect()} == want
    marks = ("<|a|>", "<|b|>", "<|c|>")
    words = fim.restore(fim.transform(docs, unit=r"\s*\S+", rate=100, sentinels=marks), marks)
    for r in words.collect():
        assert r["n"] == len((r["restored"] or "").split()) or r["n"] == 0
        assert r["form"] == "plain" or re.fullmatch(r"(\s*\S+)*\s*", r["restored"])
    texts = collections.Counter((i, t or "") for i, t, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["restored"]) for r in words.collect()) == texts


def test_ropes_split_anywhere():
    rng = np.random.default_rng(3)
    for k in range(400):
        text = "".join(rng.choice([*"ab <S\n é漢P>"], int(rng.integers(0, 70))))
        for unit in (None, re.compile(r"\S+\s*"), re.compile(r"[^\n]*\n")):
            r = fim.rope(text, unit, int(rng.choice([1, 3, 7])))
            assert str(r) == text and r.points == len(text)
            at = int(rng.integers(0, len(text) + 1))
            left, right = fim.split(r, at, "points")
            assert (str(left), str(right)) == (text[:at], text[at:])
            i, j = sorted(int(x) for x in rng.integers(0, r.units + 1, 2))
            head, tail = fim.split(r, j)
            assert head.units == j and tail.units == r.units - j
            if not any(x in text for x in fim.SENTINELS):
                for form in ("psm", "spm"):
                    assert str(fim.inverted(fim.rope(str(fim.arranged(r, i, j, form)[0]), leaf=2), form)) == text
    deep = fim.rope("abc" * 100_000, leaf=8)
    assert str(fim.split(deep, 123_457)[1]) == ("abc" * 100_000)[123_457:] and fim.found(deep, "ca") == 2


# Periodic runs
def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def told(w, found):
    best = min(found, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        k = int(rng.choice([1, 2, 3, 6]))
        w = rng.integers(0, k, int(rng.integers(0, 150))).tolist()
        for _ in range(int(rng.integers(0, 3))):
            a, p, m = int(rng.integers(0, len(w) + 1)), int(rng.integers(1, 14)), int(rng.integers(0, 90))
            unit = rng.integers(0, k + 3, p).tolist()
            w[a : a + m] = [unit[i % p] for i in range(len(w[a : a + m]))]
        assert periodic.runs(w) == brute(w)
    assert periodic.runs(["x"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.strongest([(0, 8, 2), (3, 12, 3), (9, 4, 1)]) == (0, 8, 2) and periodic.strongest([]) is None


def test_chance_meetings_of_hashes_hide_no_lag(monkeypatch):
    monkeypatch.setattr(periodic, "join", lambda a, b: np.zeros_like(a))  # all blocks look alike
    w = [*range(40), *[1, 2, 3, 4, 5] * 6, *range(90, 100)]
    assert periodic.runs(w) == brute(w) != []


def test_periodic_runs(spark, docs, empty):
    got = collections.Counter((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"]) for r in periodic.detect(docs).collect())
    want = collections.Counter()
    for i, t, _ in ROWS:
        w = (t or "").encode().split()
        x = told(w, periodic.runs(w))
        want[(i, *x[:-1], x[-1].decode())] += 1
        assert len(w) > 1000 or periodic.runs(w) == brute(w)
    assert got == want and periodic.detect(empty).count() == 0


def test_periodic_runs_query(spark):
    want = {}
    for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = brute(w)
        x = told(w, found)
        want[i] = *x[:-1], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(x[-1])
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == want and sum(x[0] for x in want.values()) > 5


def test_rows_without_an_id_are_not_planted(spark, docs, empty):
    got = {(r["doc_id"], r["text"]) for r in queries.planted(docs).where("doc_id is null or text is null").collect()}
    assert (None, PROSE[:700]) in got and (2, None) in got and queries.planted(empty).count() == 0


# WARC
def test_ranges_are_those_of_the_written_file(spark):
    rows = [(5, f"u{k}", f"<p>{'x' * (k * 7 % 5)}{k}</p>") for k in range(6)] + [(None, f"n{k}", f"<b>{k}</b>") for k in range(3)] + [(6, "u", None)]
    recs = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    files = {r["file"]: bytes(r["content"]) for r in warc.archive(recs).collect()}
    leaves = warc.leaves(recs).collect()
    assert len(leaves) == len(rows) and all(hashlib.sha256(files[r["file"]][r["first"] : r["end"]]).hexdigest() == r["digest"] for r in leaves)
