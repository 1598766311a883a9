import random
import zlib

import numpy as np
import pyarrow as pa

from pyspark.util import PythonEvalType
from tokenizers import Tokenizer

from postlake.llm import packing
from postlake.llm.queries import vocabulary
from postlake.operators import index, segments
from postlake.plans.catalog import QUERIES


def test_postings_lie_in_lists(spark, tmp_path):
    """A row for each term of a chunk, not for each posting; documents without an id or with a shared one are kept and counted once."""
    rng = random.Random(4)
    ids = [None, 0, 5, None, 5, 2**62, -(2**62), 7, *range(100, 400)]
    rows = [(i, " ".join(rng.choices("red green blue grey".split(), k=rng.randrange(9))), "green") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string").coalesce(1)
    x = index.build(docs, {"a": "a", "b": "b"}, f"file://{tmp_path}/i", stemmed=False)
    want = sorted(str((i, c, t, [k for k, w in enumerate(v.split()) if w == t])) for i, *both in rows for c, v in zip("ab", both) for t in set(v.split()))
    assert sorted(str((r["doc_id"], r["col"], r["term"], r["positions"])) for r in x.postings(spark).collect()) == want
    assert spark.read.parquet(f"{x.path}/{x.segments[0].name}/postings").count() == 5  # four terms, and the lengths
    assert sorted(map(str, x.lengths(spark).collect())) == sorted(f"Row(doc_id={i}, len={len(a.split()) + 1})" for i, a, _ in rows)
    df = {t: len({i for i, *both in rows if i is not None and any(t in v.split() for v in both)}) for t in ("red", "green", "blue", "grey")}
    assert {r["term"]: r["df"] for r in x.terms(spark).collect()} == df
    # Merged: the same postings, where batches cut a term's lists.
    held = index.updated(x, docs.where("doc_id = 7"))
    assert {(r["term"], r["df"], r["tf"]) for r in segments.merged(held, spark, 0).terms(spark).collect()} == {(r["term"], r["df"], r["tf"]) for r in x.terms(spark).collect()}


def test_folded_lists_unfold_to_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    many = rng.integers(1, 5, 30)
    row, n = np.cumsum(many) - many, int(many.sum())
    docs, sizes = pa.array([None if k % 6 == 0 else int(v) for k, v in enumerate(rng.integers(-9, 9, n))], pa.int64()), rng.integers(0, 4, n)
    places, cols, lens = rng.integers(0, 1000, int(sizes.sum())), rng.integers(0, 2, n), rng.integers(0, 99, n)
    lists = segments.packed(pa.array([f"t{k}" for k in range(30)]), row, docs, cols, lens, sizes, places)
    monkeypatch.setattr(segments, "FOLDED", 2)
    back = pa.Table.from_batches(segments._unfolded(lists.append_column("bucket", pa.array([0] * 30, pa.int32())), pa.array(["x", "y"])))
    assert back["doc_id"].to_pylist() == docs.to_pylist() and back["len"].to_pylist() == lens.tolist()
    assert [p for v in back["positions"].to_pylist() for p in v] == places.tolist() and [len(v) for v in back["positions"].to_pylist()] == sizes.tolist()
    assert back["col"].to_pylist() == ["xy"[c] for c in cols] and back["term"].to_pylist() == [f"t{k}" for k in np.repeat(np.arange(30), many)]


def test_words_met_again_are_not_merged_again():
    """A full table of words goes on as the older one; what returns is taken from there."""
    made = []
    kept = packing.Recent(lambda w: made.append(w) or w.encode(), 4)
    for k in range(40):
        assert kept["often"] == b"often" and kept[f"w{k}"] == f"w{k}".encode()
        assert len(kept) + len(kept.older) <= 8
    assert made.count("often") == 1 and len(made) == 41


def test_ids_are_those_of_the_library():
    path = vocabulary()
    whole = Tokenizer.from_file(path)
    e = packing.Encoder(path, 6)
    for text in ("The café, don't 42nd Σίσυφος!", "naïve\x7f ab cd x1y2 ４２ é", "a b c a b c d e f g a b c", "word" * 100):
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(e.of(p) if isinstance(p, list) else np.array(e.bpe.run(p), "<u4").tobytes() for p in e.bpe.pieces(text)) == want


def test_texts_encoded_together_give_the_pieces_of_each(monkeypatch):
    """op9: a run that comes again is cut into words once a chunk; pieces are those of the library's ids, whatever the chunks."""
    path = vocabulary()
    whole = Tokenizer.from_file(path)
    texts = ["", None, "  a  b ", "\u0085x　y z\xa0q᠎w​v", "a\x1cb c", "x" * 3000 + " y", "İstanbul ΣΑΣ ﬁ é é ́", "one " * 900, "\n", "'s don't 12,3.4", f"a {[*packing.bpe.loaded(path).special][0]} b", "one two, one"]
    want = []
    for at, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(at, (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))) for s in range(0, len(ids), 64) for x in [ids[s : s + 64]]]
    for most in (1 << 20, 40, 1):
        monkeypatch.setattr(packing, "TOGETHER", most)
        assert sorted(packing.cut_all(pa.array(texts), path, 64, 1)) == want
    e = packing.Encoder(path)
    cut = []
    monkeypatch.setattr(e.bpe, "normal", lambda t, f=e.bpe.normal: cut.append(t) or f(t))
    ids, ends = e.together(pa.array(["one two", "", "two one one"]))
    assert [x.split() for x in cut] == [["one", "two"]] and ends.tolist() == [len(ids) * 2 // 5, len(ids) * 2 // 5, len(ids)]
    assert [x.tolist() for x in e.together(pa.array([], pa.string()))] == [[], []]


def test_html_is_read_a_few_rows_at_a_time(spark):
    """Arrow in, Arrow out; a batch is never Python strings as a whole."""
    from postlake.functions import html

    assert html.html_to_text.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    rows = [(i, None if i % 300 == 7 else f"<head>no</head><p>a{i} &amp;\n <b>ü</b></p>") for i in range(1000)]
    got = spark.createDataFrame(rows, "id long, h string").coalesce(1).select("id", html.html_to_text("h").alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: h and f"a{i} & ü" for i, h in rows}
    assert spark.createDataFrame([], "h string").select(html.html_to_text("h")).count() == 0


def test_tokens_keep_the_language_of_their_row(spark, tmp_path):
    """no join brings the language back, so rows that share a doc_id or have none are counted once."""
    rows = [(1, "en", "One two one"), (1, "de", "Zwei"), (None, "en", "three"), (2, None, "two Zwei"), (3, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["token_table"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == [("de", 1, 1), ("en", 4, 3), (None, 2, 2)]
    plain = spark.sql(f"SELECT * FROM tokens(TABLE(SELECT doc_id, text FROM parquet.`{tmp_path}/documents.parquet` WHERE lang = 'de'), stemmed => false)")
    assert plain.columns == ["doc_id", "position", "term"] and [*map(tuple, plain.collect())] == [(1, 0, "zwei")]
