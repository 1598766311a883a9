"""The whole pipeline against a plain Python version, on a table with nulls, repeats, empties and clashing names."""

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from postlake.llm import queries
from test_llm import probability_jaccard, shingles

INSULTS = ["scoundrel", "fool", "wretch"]
BOILERPLATE = re.compile(r"\b(all rights reserved|privacy policy|click here)\b", re.I)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fixture():
    rng = np.random.default_rng(12)
    prose = lambda k, n=90: " ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{k}x{j}" for j in range(n))
    rows = [(i, prose(i)) for i in range(80)]
    toxic = {i: " ".join(w if rng.random() > 0.12 else rng.choice(INSULTS) for w in prose(i).split()) for i in range(100, 130)}
    rows += toxic.items()
    rows += [(200, rows[3][1]), (201, rows[4][1].replace("x50", "x50 more", 1)), (202, rows[5][1]), (202, rows[6][1] + " and an end")]
    passage = " ".join(f"shared{j}" for j in range(30))
    rows += [(210, f"{prose(210)} {passage} {prose(211, 40)}"), (211, f"{prose(212)} {passage}"), (212, passage + " " + passage + " " + prose(213))]
    rows += [(220, "too short"), (221, None), (222, ""), (223, "again and again " * 60), (224, "\n".join([prose(224), "home | news | mail | help", "All rights reserved."])), (225, "\n".join([prose(225, 55), *("click here " + prose(226 + j, 20) for j in range(9))]))]
    rows += [(None, prose(230)), (None, prose(231)), (None, rows[7][1]), (240, prose(240, 3000)), (241, rows[8][1] + "   \n\t")]
    return rows, set(toxic)


def cleaned(t):
    w = words(t)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    again = {a + k for a in range(len(w) - 2) if n[tuple(w[a : a + 3])] > 1 for k in range(3)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return None
    fails = lambda x: bool(x.strip()) and (x.count("|") >= 3 and 5 * x.count("|") >= len(words(x)) or BOILERPLATE.search(x) is not None)
    lines = t.split("\n")
    lost = sum(len("".join(words(x))) for x in lines if fails(x))
    return "\n".join(x for x in lines if not fails(x)) if lost <= 0.5 * len("".join(w)) else None


def kept_of_classes(rows):
    at = sorted((k for k, r in enumerate(rows) if r[0] is not None), key=lambda k: rows[k][0])
    sets, root = {k: shingles(rows[k][1]) for k in at}, {k: k for k in at}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(at):
        for b in at[i + 1 :]:
            if sets[a] and len(sets[a].keys() & sets[b].keys()) > 0.3 * min(len(sets[a]), len(sets[b])) and probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)), key=at.index)
                root[y] = x
    return [r for k, r in enumerate(rows) if r[0] is None or find(k) == k]


def without_passages(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for a in range(len(w) - 12):
            first.setdefault(tuple(w[a : a + 13]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set() if i is None else {a + k for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < i for k in range(13)}
        if len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def test_pipeline(spark, tmp_path):
    rows, toxic = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))).alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("row"), F.lit("x").alias("found"), F.lit(2).alias("at"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*range(0, 80, 2), *range(100, 130, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, c) for i, t in rows if (c := cleaned(t)) is not None]
    left = without_passages(kept_of_classes([r for r in left if r[0] not in toxic]))
    vocabulary = Tokenizer.from_file(queries.vocabulary())
    want = collections.Counter()
    for i, t in left:
        ids = [*vocabulary.encode(t, add_special_tokens=False).ids, 1]
        want.update((i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 4096) + 1


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row int")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
