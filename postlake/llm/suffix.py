"""Exact substring dedup on bytes: repeated WIDTH-byte windows by named samples, remaining suffixes and prefix comparison.

1. Sample. Each window is named by its least GRAM-byte hash. Windows in a row with one name form a segment; its
   segment hash names all bytes they cover. Sampled names are sorted in hash buckets; unique names end here, as a
   repeated window has a repeated name.
2. Names. Segments of one name with equal BLAKE2b digests (64 bits besides the name's 64) are repeated as a whole.
3. Remaining suffixes. Where one name has different segments, the windows of the segments that are alone, and of one
   segment a class, go on as suffixes with their WIDTH-byte prefix: a 64-bit fingerprint and 32 bits of BLAKE2b over
   the bytes themselves. They are sorted with each other, and neighbours with equal prefixes are repeats.

Why the sample is content-defined instead of the residues of a difference cover: see README.

Texts of a chunk are cut together: neither the choice of the samples nor the removed bytes take work per text but for
lists told and the hash of what is kept.

Defined results: a null text has no bytes; texts under WIDTH bytes lose nothing; equal texts of WIDTH bytes or more
lose all; a null doc_id is a document of its own that is compared within itself only; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import hashing, runs
from postlake.llm.shared import buckets_for

WIDTH, GRAM = 200, 50


#: Windows ranked at a time, so that all arrays of a piece stay in the processor's cache; ranks keep places in 16 bits.
_PIECE = 1 << 15
#: Bytes of texts cut together; a longer text comes alone.
_CHUNK = 1 << 18
_U = np.uint64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _ranks(buf: np.ndarray) -> np.ndarray:
    """An order of the GRAM bytes from each place on, as 16 bits above the place itself: of equal ones the first is least. It only chooses; names are hashed anew."""
    n = len(buf) - GRAM + 1
    eight = hashing.loads(buf)[: len(buf) - 7] * _U(0x9E3779B97F4A7C15)
    eight ^= eight >> _U(32)
    two = eight[:-8] * _U(0xBF58476D1CE4E5B9) + eight[8:]
    four = two[:-16] * _U(0x94D049BB133111EB) + two[16:]
    rank = (four[:n] * _U(0xD6E8FEB86659FD93) + two[32 : 32 + n]) * _U(0xA0761D6478BD642F) + eight[GRAM - 8 :]
    return ((rank >> _U(32)).astype(np.uint32) & np.uint32(0xFFFF0000)) | np.arange(n, dtype=np.uint32)


class Segments:
    """The segments of texts that lie one after another: first window, end (exclusive), text, name, and whether the text has the name's bytes at two places."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.raw = buf, off, memoryview(buf)
        last = off[1:] - WIDTH  # a text's last window
        begins, n = off[:-1][last >= off[:-1]], max(0, len(buf) - WIDTH + 1)
        firsts, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, n, _PIECE):
            b = min(n, a + _PIECE)
            least = _sliding_min(_ranks(buf[a : b - 1 + WIDTH]), WIDTH - GRAM + 1)
            new = runs.first_of_runs(least)
            new[begins[slice(*np.searchsorted(begins, (a, b)))] - a] = True
            at = np.flatnonzero(new)
            firsts.append(at + a)
            grams.append((least[at] & np.uint32(0xFFFF)).astype(np.int64) + a)
        first, gram = np.concatenate(firsts), np.concatenate(grams)
        text = np.searchsorted(off, first, "right") - 1
        keep = first <= last[text] if len(first) else np.zeros(0, bool)
        first, gram, text = first[keep], gram[keep], text[keep]
        eight = hashing.loads(buf)
        name = np.zeros(len(gram), _U)
        for k in (*range(0, GRAM - 8, 8), GRAM - 8):
            name = hashing.join(name, eight[gram + k])
        # Only a text that has the gram at two places can hold a repeat within itself.
        twice = np.zeros(len(first), bool)
        one = runs.first_of_runs(name) | runs.first_of_runs(text)
        twice[np.flatnonzero(~one & runs.first_of_runs(gram))] = True
        at = np.flatnonzero(one)
        self.twice = np.logical_or.reduceat(twice, at) if len(at) else twice
        self.first, self.text, self.name = first[at], text[at], name[at]
        self.end = np.minimum(np.append(self.first[1:], n), last[self.text] + 1) if len(at) else self.first
        key = self.name + hashing.mix(self.text.astype(_U))
        order = np.argsort(key)
        again = ~runs.first_of_runs(key[order])
        self.twice[order[again | np.append(again[1:], False)]] = True
        self.at = np.searchsorted(self.text, np.arange(len(off)))

    def of(self, i: int) -> slice:
        """The segments of text i."""
        return slice(self.at[i], self.at[i + 1])

    def hashes(self, which: slice | np.ndarray = slice(None)) -> np.ndarray:
        """BLAKE2b of all bytes that the windows of the segments cover."""
        raw = self.raw
        return np.array([hashing.digest64(raw[a : b - 1 + WIDTH]) for a, b in zip(self.first[which].tolist(), self.end[which].tolist())], np.uint64)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Places of the windows of the chosen segments."""
        return hashing.ranges(self.first[which], (self.end - self.first)[which])

    def prefixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the chosen segments and the fingerprints of their bytes; stretches of neighbouring segments lie one after another, a piece of them is hashed at a time."""
        if not len(which):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start, end = self.first[which], self.end[which]
        new = np.append(True, (start[1:] != end[:-1]) | (start[1:] // _PIECE != start[:-1] // _PIECE))
        start, end = start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
        size = end - start - 1 + WIDTH
        piece = np.cumsum(size) // _PIECE
        out = []
        for a, b in zip(*(lambda c: (c, [*c[1:], len(size)]))(np.flatnonzero(runs.first_of_runs(piece)).tolist())):
            h = hashing.byte_windows(self.buf[hashing.ranges(start[a:b], size[a:b])], WIDTH)
            out.append(h[hashing.ranges(np.cumsum(size[a:b]) - size[a:b], (end - start)[a:b])])
        return self.windows(which), np.concatenate(out)


REQUEST = "bucket int, names binary, hashes binary, many binary, base long, docs binary, doc_id long, whole binary, apart binary"
REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("hashes", pa.binary()), ("many", pa.binary()), ("base", pa.int64()), ("docs", pa.binary()), ("doc_id", pa.int64()), ("whole", pa.binary()), ("apart", pa.binary())])
ANSWER = "doc_id long, whole binary, apart binary"
ANSWER_ARROW = pa.schema([("doc_id", pa.int64()), ("whole", pa.binary()), ("apart", pa.binary())])


def _sorted(names: np.ndarray, hashes: np.ndarray, docs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((docs, hashes, names))
    return names[order], hashes[order], docs[order], many[order]


def _asked(names: np.ndarray, hashes: np.ndarray, docs: np.ndarray, n_buckets: int) -> Iterator[dict]:
    """A chunk's sorted run: one entry a segment class, with a document of it and whether there are more."""
    names, hashes, docs, _ = _sorted(names, hashes, docs, docs)
    keep = runs.first_of_runs(names) | runs.first_of_runs(hashes) | runs.first_of_runs(docs)
    names, hashes, docs = names[keep], hashes[keep], docs[keep]
    first = runs.first_of_runs(names) | runs.first_of_runs(hashes)
    many = ~(first & np.append(first[1:], True))
    for d, blob in runs.by_document(docs[many], hashes[many]):
        yield {"bucket": d % n_buckets, "doc_id": d, "whole": blob}
    names, hashes, docs, many = names[first], hashes[first], docs[first], many[first]
    for b, s in runs.bucketed(names, n_buckets):
        base, blob = runs.small_ids(docs[s])
        yield {"bucket": b, "names": names[s].tobytes(), "hashes": hashes[s].tobytes(), "many": np.packbits(many[s]).tobytes(), "base": base, "docs": blob}


def _named(table: pa.Table) -> pa.Table:
    """Merges a bucket's runs: whole = hashes of segments repeated as a whole; apart = those whose windows go on."""
    out, parts = [], []
    for r in table.to_pylist():
        if r["doc_id"] is not None:
            out.append({"doc_id": r["doc_id"], "whole": r["whole"]})
            continue
        n = np.frombuffer(r["names"], np.uint64)
        parts.append((n, np.frombuffer(r["hashes"], np.uint64), runs.ids_back(r["base"], r["docs"], len(n)), np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(n)).astype(bool)))
    if parts:
        names, hashes, docs, many = _sorted(*(np.concatenate(x) for x in zip(*parts)))
        new_name = runs.first_of_runs(names)
        new_class = new_name | runs.first_of_runs(hashes)
        class_at = np.flatnonzero(new_class)
        of = np.cumsum(new_class) - 1
        # Entries of a class in other chunks, or more documents in the own one.
        repeated = (np.diff(np.append(class_at, len(names))) > 1)[of] | np.logical_or.reduceat(many, class_at)[of]
        name_of_class = (np.cumsum(new_name) - 1)[class_at]
        several = (np.bincount(name_of_class) > 1)[name_of_class][of]
        for d, blob in runs.by_document(docs[repeated], hashes[repeated]):
            out.append({"doc_id": d, "whole": blob})
        go_on = several & new_class
        for d, blob in runs.by_document(docs[go_on], hashes[go_on]):
            out.append({"doc_id": d, "apart": blob})
    return pa.Table.from_pylist(out, ANSWER_ARROW)


def _known(slim: DataFrame, n_buckets: int) -> DataFrame:
    def ask(batches):
        def entries():
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, b, buf, off in hashing.texts(batch, most=_CHUNK):
                    s = Segments(buf, off)
                    yield s.name, s.hashes(), ids[a:b][s.text]

        yield from runs.sent((r for n, h, d in runs.chunks(entries(), 1_000_000) for r in _asked(n, h, d, n_buckets)), REQUEST_ARROW)

    answers = slim.mapInArrow(ask, REQUEST).groupBy("bucket").applyInArrow(_named, ANSWER)
    return answers.groupBy("doc_id").agg(F.collect_list("whole").alias("whole"), F.collect_list("apart").alias("apart"))


def _chosen(s: Segments, blobs: list[list | None]) -> np.ndarray:
    """The segments whose hashes were told, text by text."""
    out = [np.zeros(0, np.int64)]
    for i, told in enumerate(blobs):
        if told:
            out.append(s.at[i] + np.flatnonzero(runs.members(s.hashes(s.of(i)), told)))
    return np.concatenate(out)


def _prefix_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = batch.column(0).to_numpy()
    for a, b, buf, off in hashing.texts(batch, most=_CHUNK):
        s = Segments(buf, off)
        which = _chosen(s, batch.column("apart")[a:b].to_pylist())
        at, h = s.prefixes(which)
        check = b"".join([blake2b(s.raw[k : k + WIDTH], digest_size=4).digest() for k in at.tolist()])
        yield h, np.frombuffer(check, "<u4"), np.repeat(ids[a:b][s.text[which]], (s.end - s.first)[which])


def _repeated(s: Segments, whole: list, apart: list, found: list) -> np.ndarray:
    """The windows of the texts that are repeated, in order."""
    hit = [np.zeros(0, np.int64)]
    hashes = [s.hashes(s.of(i)) if w or f else None for i, (w, f) in enumerate(zip(whole, found))]
    for i, h in enumerate(hashes):
        if whole[i]:
            hit.append(s.windows(s.at[i] + np.flatnonzero(runs.members(h, whole[i]))))
        if found[i]:
            at, p = s.prefixes(s.at[i] + np.flatnonzero(runs.members(h, apart[i])))
            hit.append(at[runs.members(p, found[i])])
    which = np.flatnonzero(s.twice)
    if len(which):
        at, h = s.prefixes(which)
        h = h + hashing.mix(np.repeat(s.text[which], (s.end - s.first)[which]).astype(np.uint64))
        order = np.argsort(h)
        again = ~runs.first_of_runs(h[order])
        hit.append(at[order[again | np.append(again[1:], False)]])
    return np.sort(np.concatenate(hit))


def _spans(at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that the windows cover, and the first run of each text."""
    if not len(at):
        return at, at, np.zeros(len(off), np.int64)
    text = np.searchsorted(off, at, "right")
    new = np.append(True, (np.diff(at) > WIDTH) | (text[1:] != text[:-1]))
    start, end = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + WIDTH
    return start, end, np.searchsorted(start, off)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    slim, n = docs.where("doc_id is not null").select("doc_id", "text"), buckets_for(docs)
    known = _known(slim, n)
    found = runs.in_others(slim.join(known.where(F.size("apart") > 0), "doc_id"), _prefix_pairs, n, later=False, check="<u4")

    def run(batches):
        for batch in batches:
            out = []
            for a, b, buf, off in hashing.texts(batch, most=_CHUNK):
                s = Segments(buf, off)
                start, end, of = _spans(_repeated(s, *(batch.column(c)[a:b].to_pylist() for c in ("whole", "apart", "found"))), off)
                for i, d in enumerate(batch.column(0)[a:b].to_pylist()):
                    kept, at = hashlib.sha256(), off[i]
                    for k in range(of[i], of[i + 1]):
                        kept.update(s.raw[at : start[k]])
                        at = end[k]
                    kept.update(s.raw[at : off[i + 1]])
                    mine = slice(of[i], of[i + 1])
                    out.append({"doc_id": d, "n_bytes": int(off[i + 1] - off[i]), "n_removed": int((end[mine] - start[mine]).sum()), "n_spans": int(of[i + 1] - of[i]), "kept_sha256": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    told = known.join(found, "doc_id", "full")
    bare = docs.where("doc_id is null").select("doc_id", "text").withColumns({c: F.lit(None).cast("array<binary>") for c in ("whole", "apart", "found")})
    return slim.join(told, "doc_id", "left").select("doc_id", "text", "whole", "apart", "found").mapInArrow(run, RESULT).unionByName(bare.mapInArrow(run, RESULT))
