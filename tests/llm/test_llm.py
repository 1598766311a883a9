"""The operators against brute force on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm import bpe, classifier, fingerprints, hashing, langid, minhash, packing, projections, quality_rules, queries, runs, squeezed, suffix, warc

PROSE = " ".join(f"word{i * 7 % 61} tail{i % 13}" for i in range(400))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (0, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, f"{PROSE[:900]} changed {PROSE[908:]}", "en", "b"), (3, None, None, None), (4, "", "de", "b"), (5, f"start here {PASSAGE} and end", "en", "a"), (6, f"other {PASSAGE}", "en", None),
    (7, "ab" * 400, "fr", "c"), (8, "Größe naïve ΣΑΣ İ <|endoftext|> x\x1cy don't 漢字   end", "de", "c"), (9, "x" * 3000, "fr", "c"), (10, "the same line\nthe same line\n" * 40, "en", "a"), (11, "   \n\t ", "en", "a"), (None, "no id here", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("words", F.lit(1)).withColumn("found", F.lit("x")).withColumn("bucket", F.lit(2)).withColumn("key", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {i: (t or "") for i, t, *_ in ROWS}


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, queries.vocabulary()).collect()}
    for i, text in TEXTS.items():
        ids = t.encode(text, add_special_tokens=False).ids
        out = t.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
    assert bpe.encode_decode(empty(spark), queries.vocabulary()).count() == 0


def test_transducer_is_the_whole_word_encoder():
    b = bpe.loaded(queries.vocabulary())
    rng = np.random.default_rng(1)
    for alphabet in ("the", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rng.choice([*alphabet], 6000))
        whole = [b.vocab[x] for x in b.merged([*b.symbols(word)[:-1], b.symbols(word)[-1] + b.suffix])]
        t, out, at = bpe.MergeTransducer(b), [], 0
        while at < len(word):
            n = int(rng.integers(1, 700))
            out += t.push(b.symbols(word[at : at + n]))
            at += n
            assert len(t.held) <= b.lookahead + b.longest + 2 * t.STEP
        assert [*out, *t.end()] == whole


def test_suffix(spark, docs):
    seen = collections.Counter()
    data = {i: t.encode() for i, t in TEXTS.items() if i is not None}
    for x in data.values():
        seen.update(x[a : a + 200] for a in range(len(x) - 199))
    got = {r["doc_id"]: r for r in suffix.dedup(docs).collect()}
    for i, x in data.items():
        gone = np.zeros(len(x), bool)
        for a in range(len(x) - 199):
            gone[a : a + 200] |= seen[x[a : a + 200]] > 1
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(x), gone.sum(), hashlib.sha256(kept).hexdigest()), i
    assert got[None]["n_removed"] == 0 and suffix.dedup(empty(spark)).count() == 0


def brute(data):
    first, want = {}, {}
    for i in sorted(data):
        for a in range(len(data[i]) - 12):
            first.setdefault(tuple(data[i][a : a + 13]), i)
    for i, w in data.items():
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - 12):
            gone[a : a + 13] |= first[tuple(w[a : a + 13])] < i
        want[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return want


def test_fingerprints(spark, docs, tmp_path):
    want = brute({i: t.encode().split() for i, t in TEXTS.items() if i is not None})
    got = {r[0]: tuple(r[1:]) for r in fingerprints.dedup(docs).collect()}
    assert got.pop(None)[1] == 0 and got == want
    assert fingerprints.dedup(empty(spark)).count() == 0
    index = fingerprints.FingerprintIndex(spark, f"file://{tmp_path}/index", 16, most=1)
    told = collections.Counter(index.add(docs.where("doc_id < 5"), "a").collect())
    again = index.add(docs.where("doc_id < 5"), "a")
    assert told == collections.Counter(again.collect())  # a retry of a batch doesn't meet itself
    index.n = 64  # buckets may grow
    told = again.unionByName(index.add(docs.where("doc_id >= 5"), "b"))
    split = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fingerprints._finished(docs.where("doc_id is not null"), told.groupBy("doc_id").agg(F.collect_list("found").alias("found")), False).collect()}
    assert split == want and len(index.runs()) == 2 and len(index.compact()) == len(index.runs()) == 1


def test_fingerprint_runs_are_compacted_on_the_way(spark, tmp_path, monkeypatch):
    """The passage is in all three batches, its smaller part in the first two; what no two documents share is no entry."""
    made, compact = [], fingerprints.FingerprintIndex.compact
    monkeypatch.setattr(fingerprints.FingerprintIndex, "compact", lambda self, past=None: made.append((past, self._read(past).collect())) or compact(self, past))
    own = [" ".join(f"own{i}x{k}" for k in range(40)) for i in range(9)]
    rows = [(i, f"{own[i]} {PASSAGE if i % 3 == 1 else ' '.join(PASSAGE.split()[: 20 if i < 6 else 5])} {own[8 - i]}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fingerprints.dedup(docs).collect()}
    assert got == brute({i: t.encode().split() for i, t in rows})
    assert [len(past) for past, _ in made] == [2]
    held = [k for _, run in made for r in run for k in np.frombuffer(r["keys"], np.uint64).tolist()]
    assert 0 < len(held) == len(set(held)) < sum(len(t.split()) - 12 for _, t in rows[:6])
    assert sum(n for _, n, _ in got.values()) > 100


def test_squeezed_texts_come_back(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "ü \x1c漢" * 1000, None), (4, "x" * 5_000_000, "c"), (5, "last", "d")]
    made = squeezed.squeezed(spark.createDataFrame(rows, "doc_id long, text string, other string"))

    def back(batches):
        for b in batches:
            for part in squeezed.restored(b, 4000):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "other": part.column("other"), "text": part.column("text").cast(pa.string()), "n": pa.array([part.num_rows] * part.num_rows)})

    got = made.coalesce(1).mapInArrow(back, "doc_id long, other string, text string, n long").collect()
    assert sorted((r["doc_id"], r["text"], r["other"]) for r in got) == rows and {r["doc_id"]: r["n"] for r in got}[4] == 1


def test_fingerprints_of_equal_keys_part_by_their_checks():
    run = np.array([3, 5, 5, 9], np.uint64), np.array([1, 1, 2, 1], "<u4")
    assert fingerprints._known(np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 3, 2], "<u4"), *run).tolist() == [True, True, True, False, False]
    keys, checks, docs, first = runs.ordered(np.array([5, 5, 5, 5], np.uint64), np.array([2, 1, 2, 1], "<u4"), np.array([4, 3, 1, 2]))
    assert list(zip(checks.tolist(), docs.tolist(), first.tolist())) == [(1, 2, True), (1, 3, False), (2, 1, True), (2, 4, False)]


def shingles(text):
    """Weighted 5-word shingles of a text; the whole text where it has fewer words."""
    w = (text or "").split()
    n = collections.Counter(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else {}
    return {k: 1 + math.log(c) for k, c in n.items()}


def probability_jaccard(x, y):
    if set(x.values()) == set(y.values()) == {1}:
        return len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def brute_classes(rows):
    """{index: smallest index of its class} by all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i].keys() & sets[j].keys()) and (sets[i] == sets[j] or probability_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_minhash(spark, docs):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(i, " ".join("edit" if j == (i * 9) % 300 else w for j, w in enumerate(base)), "en", "a") for i in range(100, 130)] + [(200 + i, " ".join(f"u{i}x{j}" for j in range(50)), "en", "a") for i in range(10)] + [(300, "two words", "en", "a"), (301, "two words", "en", "a")]
    every = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, SCHEMA))
    want = brute_classes([(i, t) for i, t, *_ in [*ROWS, *rows] if i is not None])
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(every).collect()}
    assert got.pop(None) is None and got == want
    assert minhash.classes(empty(spark)).count() == 0


def test_minhash_links_weighted_shingles(spark):
    """Pairs whose repeated blocks differ: linked or not by probability Jaccard of the weights, whatever their sets share."""
    rows = []
    for k in range(12):
        base, line = " ".join(f"b{k}x{j}" for j in range(204)), " ".join(f"l{k}x{j}" for j in range(9 + 6 * k))
        rows += [(2 * k, " ".join([base] + [line] * (1 + k % 3))), (2 * k + 1, " ".join([base] + [line] * 9))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and 0 < sum(i != c for i, c in want.items()) < 12


def test_minhash_rows_of_one_doc_id(spark):
    a, b = (" ".join(f"{x}{j}" for j in range(60)) for x in "ab")
    rows = [(1, a), (2, b), (2, b), (2, a), (3, b), (None, a)]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, False), (2, 2, True), (3, 2, False)]


def test_probability_jaccard():
    rng = np.random.default_rng(2)
    e = np.sort(rng.integers(0, 2**64, 60, dtype=np.uint64))
    x, y = np.append(rng.random(40), np.zeros(20)), np.append(np.zeros(10), rng.random(50))
    want = probability_jaccard(*({k: v for k, v in enumerate(s) if v} for s in (x, y)))
    assert minhash.probability_jaccard(e[x > 0], x[x > 0], e[y > 0], y[y > 0]) == pytest.approx(want)
    own = lambda k: minhash.signatures(np.concatenate([e[x > 0], e[y > 0]]) + np.uint64(k), np.concatenate([x[x > 0], y[y > 0]]), np.array([0, 40, 90]))
    same = np.array([np.mean(s[0] == s[1]) for s in map(own, range(1, 20))]).mean()
    assert abs(same - want) < 0.04


def test_bound_of_many_sets_holds():
    """Never below the similarity; equal to it where nothing repeats."""
    rng = np.random.default_rng(3)
    for top in (1, 6):
        sets = []
        for _ in range(40):
            x = np.unique(rng.integers(0, 60, rng.integers(1, 80)).astype(np.uint64))
            sets.append((x, minhash.weight(rng.integers(1, top + 1, len(x)))))
        held = minhash.Held(sets)
        for i in range(39):
            j = np.arange(i + 1, 40)
            got, want = held.bound(i, j), np.array([minhash.probability_jaccard(*sets[i], *sets[k]) for k in j])
            assert (got >= want - 1e-9).all() and (top > 1 or np.allclose(got, want))
            assert all(held.linked(i, k, g, 0.4) == (w >= 0.4 - 1e-9) for k, g, w in zip(j.tolist(), got, want))


@pytest.mark.parametrize("block, size", [(4096, 8 << 20), (15, 16_000)])
def test_minhash_of_a_template(spark, monkeypatch, block, size):
    """Texts of one template that share bands: some link in chains, most do not; in one block and in many."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BYTES", size)
    rng, rows = np.random.default_rng(8), []
    for i in range(36):
        own = [f"o{i // 3}x{j}" for j in range(28 - 4 * (i % 3))] + [f"p{i}x{j}" for j in range(4 * (i % 3))]
        text = [f"t{j}" for j in range(80)] + own
        rows.append((int(i), " ".join(text + text[: int(rng.integers(0, 12))])))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and 3 < len(set(want.values())) < 36


def test_minhash_recall(spark):
    """Every id divisible by 50 against all rows of a table: links by brute force end in one class."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, names = {}, {}
    for r in table.select("doc_id", "text").collect():
        own = sorted((names.setdefault(k, len(names)), w) for k, w in shingles(r["text"]).items())
        sets[r["doc_id"]] = np.array([k for k, _ in own], np.uint64), np.array([w for _, w in own])
    of = {r["doc_id"]: r["class_id"] for r in minhash.classes(table).collect()}
    links = [(q, d) for q in sets if q % 50 == 0 for d in sets if d != q and minhash.probability_jaccard(*sets[q], *sets[d]) >= 0.8]
    assert links and all(of[q] == of[d] for q, d in links)


def thue_morse(a, b, n, sep=""):
    return sep.join((a, b)[bin(k).count("1") % 2] for k in range(n)), sep.join((b, a)[bin(k).count("1") % 2] for k in range(n))


def test_hashes_tell_thue_morse_apart(spark):
    """Words, bytes and texts of two symbols that meet under every polynomial hash modulo a power of two."""
    for n in (128, 200, 300, 1024, 4096):
        x, y = thue_morse("a", "b", n)
        buf = np.frombuffer(f"{x} {y}".encode(), np.uint8)
        assert len(set(hashing.word_hashes(buf, *hashing.words(buf, np.array([0, len(buf)]))[:2]).tolist())) == 2
    x, y = thue_morse("a", "b", 1024)
    same = " ".join(f"same{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"{same} {x}"), (2, f"{same} {y}")], "doc_id long, text string")
    assert [r["n_removed"] for r in fingerprints.dedup(d).collect()] == [0, 0]
    d = spark.createDataFrame([*enumerate(thue_morse("a", "b", 1024, " "))], "doc_id long, text string")
    assert {r["exact_id"] for r in minhash.classes(d).collect()} == {0, 1}
    d = spark.createDataFrame([*enumerate(thue_morse("a", "b", 256))], "doc_id long, text string")
    assert [r["n_removed"] for r in suffix.dedup(d).collect()] == [0, 0]


def test_quality_rules(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in TEXTS.items():
        w = [x for x in t.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if x]
        n = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {a + k for a in range(len(w) - 2) if n[tuple(w[a : a + 3])] > 1 for k in range(3)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(w), len(hit), sum(map(len, w)))
    assert got[10]["base_failed"] and not got[3]["kept"] and got[10]["n_dup_lines"] == 79
    lines = "\n".join([*(f"{' '.join(f'good{i}x{j}' for j in range(12))}." for i in range(8)), "home | about | news | mail | help"])
    cleaned = quality_rules.clean(spark.createDataFrame([(1, lines, "en", "a")], SCHEMA)).first()
    assert "home |" not in cleaned["text"] and "good7x11." in cleaned["text"]
    assert quality_rules.judge(empty(spark)).count() == 0


def test_language_id(spark):
    words = {"en": "the and with that this from have which would there", "de": "und nicht eine werden sich auch zwischen schon über für", "fr": "les des une dans pour avec cette être nous même"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(w.split(), 40)), lang, "a") for k, (lang, w) in enumerate(words.items()) for i in range(k * 40, k * 40 + 40)] + [(500, None, "en", "a"), (501, "1234 !!", "en", "a")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert all(got[i]["held_out"] == langid.held_out_of(i) and 0 <= got[i]["score"] <= 1 for i in got)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:-2]]) > 0.95
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und"
    assert langid.identify(empty(spark)).count() == 0


def test_language_distances_against_brute_force(spark):
    """Profiles, distances and scores by plain dictionaries; letters beyond the basic plane are letters of their own."""
    texts = {"aa": "the cat and the hat, the rat 𐐀𐐁 sat", "bb": "der Hund und die Katze 𐐂𐐁 und die Maus", "cc": "le chat et le chien et la souris"}

    def grams(text):
        n = collections.Counter()
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            p = f" {w} "
            n.update(p[i : i + k] for k in range(1, 5) for i in range(len(p) - k + 1) if p[i : i + k] != " ")
        return n

    def key(g):
        out = 0
        for c in g:
            out = (out * 0x9E3779B97F4A7C15 + ord(c)) % 2**64 if out else ord(c)
        return out

    def profile(text, size, signed):
        order = lambda g: (-n[g], key(g) - (2**64 if signed and key(g) >= 2**63 else 0))
        n = grams(text)
        return sorted(n, key=order)[:size]

    size = 30
    learned = spark.createDataFrame([(t, lang) for lang, t in texts.items()], "text string, lang string")
    profiles = langid.learn(learned, size)
    for lang, t in texts.items():
        assert [x[2] % 2**64 for x in sorted(profiles) if x[0] == lang] == [key(g) for g in profile(t, size, True)]
    asked = ["the cat sat", "die Katze", "et la 𐐂", "x"]
    got = [tuple(r)[1:] for r in sorted(langid.predict(spark.createDataFrame([*enumerate(asked)], "doc_id long, text string"), profiles, size).collect())]
    for t, (lang, score) in zip(asked, got):
        own = profile(t, size, False)
        apart = []
        for known in texts:
            rank = {g: k for k, g in enumerate(profile(texts[known], size, True))}
            apart.append((sum(min(size, abs(rank[g] - k)) if g in rank else size for k, g in enumerate(own)), known))
        apart.sort()
        assert lang == apart[0][1] and score == pytest.approx((apart[1][0] - apart[0][0]) / max(1, apart[1][0]))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    rows = packing.pack_documents(docs.where("doc_id is not null"), queries.vocabulary(), capacity=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, text in TEXTS.items():
        if i is not None:
            ids = [*t.encode(text, add_special_tokens=False).ids, 1]
            want = [(k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
            assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i) == want
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 500)
    n = packing.best_fit_decreasing(sizes, 100)[2]
    assert -(-sizes.sum() // 100) <= packing.lower_bound(sizes, 100) <= n <= packing.lower_bound(sizes, 100) * 1.1
    assert packing.pack_documents(empty(spark), queries.vocabulary()).count() == 0


def test_packing_reaches_its_bound_over_partitions(spark):
    rng = np.random.default_rng(9)
    sizes = np.minimum(64, rng.geometric(0.06, 3000))
    rows = spark.createDataFrame([(i % 700, i, int(n)) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    for each in (100, 10_000):
        got = packing.pack(rows, 64, each=each).collect()
        assert collections.Counter((r["doc_id"], r["piece"]) for r in got) == collections.Counter((i % 700, i) for i in range(3000))
        by = collections.defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in by.values():
            s.sort()
            assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
        assert len(by) <= packing.lower_bound(sizes, 64) * 1.01 + 1


def test_packing_keeps_rows_of_null_and_repeated_ids(spark):
    texts = [(None, PROSE), (None, PROSE), (None, "no id"), (7, PROSE), (7, "other words"), (7, "other words"), (8, None)]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), queries.vocabulary(), capacity=64).collect()
    want = collections.Counter((i, k, *x) for i, t in texts for k, x in enumerate(packing.cut(t or "", queries.vocabulary(), 64, 1)))
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    prose = [" ".join(f"{x}{k}word{j}" for j in range(80)) for k, x in enumerate("abcdef")]
    rows = [(1, prose[0], "en", "a"), (None, prose[1], "en", "a"), (None, prose[2], None, None), (2, prose[3], "en", "a"), (2, "short", "en", "a"), (3, prose[0], "en", "b"), (3, prose[4], "en", "b"), (4, prose[5], "en", "c"), (4, prose[5], "en", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("found", F.lit("x"))
    of = lambda df: collections.Counter(tuple(r)[:4] for r in df.collect())
    every = collections.Counter(rows)
    assert of(quality_rules.clean(docs)) == every - collections.Counter([rows[4]])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert of(classifier.keep(docs, labels)) == every
    assert of(minhash.keep_one(docs)) == every - collections.Counter([rows[5], rows[8]])
    # Rows of one doc_id are the same document to each other here; row 5 is row 0 again and has no words left.
    assert of(fingerprints.remove(docs)) == every - collections.Counter([rows[5]])
    assert all(f(docs).columns == docs.columns for f in (quality_rules.clean, lambda d: classifier.keep(d, labels), fingerprints.remove, minhash.keep_one))


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>body {i}</p>" if i % 9 else None) for i in range(700)], "page_id long, url string, html string")
    recs = warc.records(pages)
    got = warc.audit(recs, warc.corrupted(recs, F.col("page_id").isin(5, 300, 699))).collect()
    assert sorted((r["page_id"], r["kind"], r["seq"]) for r in got) == [(5, "content", 5), (300, "content", 44), (699, "content", 187)]
    assert warc.audit(recs, recs).count() == 0 and warc.audit(recs.limit(0), recs.limit(0)).count() == 0
    again = warc.read(warc.archive(recs))
    assert again.exceptAll(recs).count() == recs.exceptAll(again).count() == 0


def test_warc_missing_extra_moved_and_nameless(spark):
    row = lambda i, body: (i, f"u{i}", body)
    a = [row(i, f"body {i:03}") for i in range(40)] + [row(None, "x"), row(None, "y"), row(300, "same"), row(300, "same"), row(301, "z")]
    b = [r for r in a if r[0] not in (10, 301)] + [row(500, "extra")]
    b.remove(row(300, "same"))
    b.remove(row(None, "y"))
    recs = [warc.records(spark.createDataFrame(x, "page_id long, url string, html string")) for x in (a, b)]
    got = collections.Counter((r["page_id"], r["kind"]) for r in warc.audit(*recs).collect())
    # What follows the missing record 10 in its file has other offsets.
    assert got == collections.Counter([(10, "missing in b"), *((i, "moved") for i in range(11, 40)), (300, "missing in b"), (301, "missing in b"), (500, "missing in a"), (None, "missing in b")])


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(4)
    make = lambda bad, toxic: " ".join((w + "***" if bad else w) if rng.random() > 0.05 * toxic else "insult" for w in rng.choice([f"plain{k}" for k in range(300)], 80))
    rows = [(i, make(i % 5 == 0, i % 7 == 0), "en", f"s{i % 3}") for i in range(600)] + [(900, None, None, None), (901, "", "en", "s1"), (902, "plain3 " * 3000, "en", "s1")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, SCHEMA), labels


def test_classifier(spark, judged):
    docs, labels = judged
    got = {r["doc_id"]: r["kept"] for r in classifier.judge(docs, labels).collect()}
    held = [i for i in range(600) if i % 2]  # rows without a label
    assert np.mean([got[i] for i in held if i % 5 and i % 7]) > 0.97 and got[900]
    assert np.mean([got[i] for i in held if i % 5 == 0]) < 0.05 and np.mean([got[i] for i in held if i % 7 == 0]) < 0.1
    assert classifier.judge(empty(spark), labels.limit(0)).count() == 0
    assert all(r["kept"] and r["p_toxic"] == 0.5 for r in classifier.judge(docs, labels.limit(0)).collect())


def test_classifier_posteriors_against_brute_force(spark, judged):
    docs, labels = judged
    model = classifier.fit(docs, labels)
    text = {r["doc_id"]: r for r in docs.collect()}
    e = {x: {} for x in classifier.LABELS}
    for i, r in text.items():
        for x in classifier.LABELS:
            m = model[x]
            e[x][i] = sum(w for f, w in m["weights"].items() if f in classifier.features(r["text"])) * m["scale"] + m["shift"] if r["text"] else 0.0
    host = {i: r["source"] or "?" for i, r in text.items()}
    path = {i: (host[i], f"{host[i]}/{r['lang'] or '?'}") for i, r in text.items()}
    want = {}
    for x in classifier.LABELS:
        start = math.log(model[x]["prior"] / (1 - model[x]["prior"]))
        p = {i: 1 / (1 + math.exp(-(v + start))) for i, v in e[x].items()}

        def strength(of):
            g = collections.defaultdict(list)
            for i, k in of.items():
                g[k].append(p[i])
            n, s = sum(map(len, g.values())), sum(map(sum, g.values()))
            mean = s / n
            v = mean * (1 - mean)
            between = (sum(sum(q) ** 2 / len(q) for q in g.values()) - n * mean**2 - (len(g) - 1) * v) / max(1, n - sum(len(q) ** 2 for q in g.values()) / n)
            return mean, max(1, v / between - 1) if between > 0 else 1e6, g

        mean, hk, hosts = strength(host)
        _, pk, paths = strength(path)
        for i in text:
            a = (sum(hosts[host[i]]) - p[i] + hk * mean) / (len(hosts[host[i]]) - 1 + hk)
            b = (sum(paths[path[i]]) - p[i] + pk * a) / (len(paths[path[i]]) - 1 + pk)
            b = min(0.999, max(0.001, b))
            want[i, x] = 1 / (1 + math.exp(-(e[x][i] + math.log(b / (1 - b)))))
    for small in (200_000, 0):  # sent sites, and salted keys
        got = {(r["doc_id"], x): r[f"p_{x}"] for r in classifier.score(docs, model, small=small).collect() for x in classifier.LABELS}
        assert got == pytest.approx(want, abs=1e-6)


def test_projections(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64))
    x = np.concatenate([x, x[:60] + 0.25 * rng.standard_normal((60, 64)), np.repeat(x[:1], 20, 0) + 0.1 * rng.standard_normal((20, 64))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64)]
    got = {r["vec_id"]: r for r in projections.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.9 * want.sum() and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903))


def test_projections_equal_vectors(spark):
    """20,000 equal vectors and some near them: counts and components of brute force."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4, 64))
    y = np.concatenate([x[:1] + 0.1 * rng.standard_normal((3, 64)), x])
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
    many = few.where("vec_id = 3").crossJoin(spark.range(100, 20_100)).select(F.col("id").alias("vec_id"), "embedding")
    got = {r["vec_id"]: r for r in projections.near(few.unionByName(many)).collect()}
    u = y / np.linalg.norm(y, axis=1)[:, None]
    n = np.array([20_001 if i == 3 else 1 for i in range(7)])
    for i in range(7):
        linked = np.flatnonzero(u @ u[i] >= 0.9)
        assert got[i]["n_links"] == n[linked].sum() - 1
        assert got[i]["component_id"] == (0 if i < 4 else i) and got[i]["kept"] == (i == 0 or i > 3)
    assert {(got[i]["n_links"], got[i]["component_id"]) for i in range(100, 20_100)} == {(got[3]["n_links"], 0)} and len(got) == 20_007
    assert projections.near(few.limit(0)).count() == 0


def test_projections_reach_recall_at_any_size(spark, monkeypatch):
    for n in (2, 10**5, 3 * 10**7, 12 * 10**7, 10**9, 10**12):
        dims, tables, need = projections.planned(n, 0.9)
        p = projections.cell_probability(0.9, dims)
        assert need >= 1 and (1 - p) ** tables <= 0.02
    assert projections.planned(10**7, 0.9)[1] == projections.TABLES < projections.planned(10**9, 0.9)[1]
    with pytest.raises(ValueError):
        projections.planned(10**9, 0.1)
    plan = projections.planned(10**9, 0.9)
    monkeypatch.setattr(projections, "planned", lambda *a: plan)
    rng = np.random.default_rng(8)
    x, z = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 1000, 64)))
    z -= (x * z).sum(1)[:, None] * x
    y = 0.901 * x + (1 - 0.901**2) ** 0.5 * z / np.linalg.norm(z, axis=1)[:, None]
    rows = [(2 * i + k, v.tolist()) for i, pair in enumerate(zip(x, y)) for k, v in enumerate(pair)]
    assert projections.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() >= 965
