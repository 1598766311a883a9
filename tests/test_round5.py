"""Findings of round 3, second pass."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from postlake.llm import hashing, suffix
from postlake.operators import threads

MAIL = "id long, message_id string, in_reply_to string, `references` array<string>, date_received long, subject_norm string"


def test_messages_without_links_are_not_climbed(spark, monkeypatch):
    rows = [(i, f"m{i}", None, None, i, f"s{i % 3}" if i < 6 else "") for i in range(50)]
    # A reply, a copy of it, a reply to one that was never seen, and two that answer each other.
    rows += [(50, "r", "m7", None, 60, "x"), (51, "r", "m7", None, 61, "x"), (52, "g", "ghost", None, 62, "x"), (53, "a", "b", None, 63, ""), (54, "b", "a", None, 64, ""), (55, None, "m7", None, 65, "")]
    asked, climbed = [], threads._climbed
    monkeypatch.setattr(threads, "_climbed", lambda n, s: asked.append({r["node"] for r in n.select("node").collect()}) or climbed(n, s))
    got = {r["id"]: (r["thread_id"], r["position"], r["depth"]) for r in threads.threads(spark.createDataFrame(rows, MAIL), by_subject=True).collect()}
    assert len(asked) == 2 and all(a == {"m7", "r", "ghost", "g", "a", "b"} for a in asked)
    alone = {i: (i % 3, i // 3, i // 3) for i in range(6)} | {i: (i, 0, 0) for i in range(6, 50)}
    assert got == alone | {50: (7, 1, 1), 51: (7, 1, 1), 52: (52, 0, 1), 53: (54, 1, 1), 54: (54, 0, 0), 55: (55, 0, 0)}


def plain(texts):
    """(bytes removed, spans, kept hash) of each text: every window of every text against all others."""
    seen = {}
    for i, x in enumerate(texts):
        for k in range(len(x) - suffix.WIDTH + 1):
            seen.setdefault(x[k : k + suffix.WIDTH], []).append((i, k))
    gone = [np.zeros(len(x) + 2, bool) for x in texts]
    for places in seen.values():
        for i, k in places if len(places) > 1 else []:
            gone[i][k + 1 : k + 1 + suffix.WIDTH] = True
    return [(int(g.sum()), int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(bytes(b for b, d in zip(x, g[1:]) if not d)).hexdigest()) for x, g in zip(texts, gone)]


def odd_texts():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abc", k=n))
    shared, other = word(330), word(205)
    texts = ["", None, "a" * 199, "a" * 200, "b" * 201, "c" * 900, "ab" * 400, word(70) * 9, shared, shared[20:260], other + shared[:250] + other, word(150) + other[:199], "\u00e9" * 150]
    texts += [word(rng.randrange(400)) + shared[rng.randrange(90) :][: rng.randrange(330)] + word(rng.randrange(400)) for _ in range(60)]
    # Longer than a piece, with a repeat across its edge.
    return texts + [word(suffix._PIECE - 100) + shared + word(suffix._PIECE), "d" * (suffix._PIECE + 700)]


def test_suffix_of_odd_texts_against_all_windows(spark):
    texts = odd_texts()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain([(x or "").encode() for x in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_texts_of_a_chunk_are_cut_together(monkeypatch):
    texts = [x for x in odd_texts() if x is None or len(x) < 5000] * 5
    asked, loads = [], hashing.loads
    monkeypatch.setattr(hashing, "loads", lambda b: asked.append(len(b)) or loads(b))
    for a, b, buf, off in hashing.texts(pa.record_batch({"text": texts})):
        s = suffix.Segments(buf, off)
        assert len(asked) < 20 < len(texts)
        # Each window of each text lies in one segment, none across texts.
        windows = s.windows(np.arange(len(s.first)))
        assert windows.tolist() == [k for i in range(len(off) - 1) for k in range(off[i], off[i + 1] - suffix.WIDTH + 1)]
