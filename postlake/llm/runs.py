"""Sorted fingerprint runs: which keys of a document also occur in others, without moving texts or meeting skew.

Each task cuts its rows into chunks and turns a chunk into one sorted, immutable run per hash bucket. Within the
chunk every key is settled as far as can be, and goes on once a chunk however many documents have it, so a key that
a third of all rows share costs one entry a chunk. A bucket's task merges its runs and answers per document.

An entry is a 64-bit fingerprint and, where the answer rests on equality, a check: bits of an independent hash of the
same words or bytes. Entries are equal only if both are, so a fingerprint that two share by chance parts them here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "bucket int, keys binary, checks binary, base long, docs binary, doc_id long, found binary"
FOUND = "doc_id long, found binary"
#: Entries a chunk: some tens of MB with all copies that sorting makes.
CHUNK = 500_000


def small_ids(docs: np.ndarray) -> tuple[int, bytes]:
    base = int(docs.min())
    apart = docs - base
    return base, apart.astype("<u4" if int(apart.max()) < 2**32 else "<u8").tobytes()


def ids_back(base: int, blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<u8").astype(np.int64) + base


def by_document(docs: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, its keys) from pairs in any order."""
    if not len(docs):
        return
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    cut = [*np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))).tolist(), len(docs)]
    for a, b in zip(cut, cut[1:]):
        yield int(docs[a]), keys[a:b].tobytes()


def first_of_runs(k: np.ndarray) -> np.ndarray:
    out = np.ones(len(k), bool)
    out[1:] = k[1:] != k[:-1]
    return out


def ordered(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check, document) entries in order, and which of them are the first of their key and check."""
    order = np.lexsort((docs, keys))
    if checks.any() and ((keys[order][1:] == keys[order][:-1]) & (checks[order][1:] != checks[order][:-1])).any():
        order = np.lexsort((docs, checks, keys))  # a fingerprint shared by chance
    keys, checks, docs = keys[order], checks[order], docs[order]
    first = first_of_runs(keys) | first_of_runs(checks)
    keep = first | first_of_runs(docs)
    return keys[keep], checks[keep], docs[keep], first[keep]


def shared(first: np.ndarray, later: bool) -> np.ndarray:
    """Which entries have another document: any, or one before."""
    return ~first if later else ~(first & np.append(first[1:], True))


def bucketed(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets that sorted keys fall into, by their highest bits, and where."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - n_buckets.bit_length() + 1)).astype(np.int64)
    cut = [*np.flatnonzero(first_of_runs(bucket)).tolist(), len(keys)]
    for a, b in zip(cut, cut[1:]):
        yield int(bucket[a]), slice(a, b)


def requests(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, n_buckets: int, later: bool) -> Iterator[dict]:
    keys, checks, docs, first = ordered(keys, checks, docs)
    told = shared(first, later)
    for d, blob in by_document(docs[told], keys[told]):
        yield {"bucket": d % n_buckets, "doc_id": d, "found": blob}
    keys, checks, docs = keys[first], checks[first], docs[first]
    some = checks.any()
    for b, s in bucketed(keys, n_buckets):
        base, blob = small_ids(docs[s])
        yield {"bucket": b, "keys": keys[s].tobytes(), "checks": checks[s].tobytes() if some else None, "base": base, "docs": blob}


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("base", pa.int64()), ("docs", pa.binary()), ("doc_id", pa.int64()), ("found", pa.binary())])
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])


def sent(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def chunks(pairs: Iterator[tuple[np.ndarray, ...]], most: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """Joins arrays until there are ``most`` entries."""
    held, n = [], 0
    for x in pairs:
        if len(x[0]):
            held.append(x)
            n += len(x[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def in_others(rows: DataFrame, pairs: Callable, n_buckets: int, later: bool, check: str = "u1") -> DataFrame:
    """doc_id, found: the keys (array of binary, uint64 each) of a document that other documents have too.

    ``pairs`` turns a record batch into (keys, checks, documents) arrays; ``check`` is the checks' type, zeros where
    keys need none. ``later``: only keys that a document with a smaller id has. A document's keys may come in parts.
    """

    def ask(batches):
        made = chunks(x for batch in batches for x in pairs(batch))
        yield from sent((r for k, c, d in made for r in requests(k, c, d, n_buckets, later)), REQUEST_ARROW)

    def answer(table: pa.Table) -> pa.Table:
        out, keys, checks, docs = [], [], [], []
        for r in table.to_pylist():
            if r["doc_id"] is not None:
                out.append({"doc_id": r["doc_id"], "found": r["found"]})
            else:
                k = np.frombuffer(r["keys"], np.uint64)
                keys.append(k)
                checks.append(np.zeros(len(k), check) if r["checks"] is None else np.frombuffer(r["checks"], check))
                docs.append(ids_back(r["base"], r["docs"], len(k)))
        if keys:
            k, _, d, first = ordered(*map(np.concatenate, (keys, checks, docs)))
            told = shared(first, later)
            out += [{"doc_id": a, "found": b} for a, b in by_document(d[told], k[told])]
        return pa.Table.from_pylist(out, FOUND_ARROW)

    asked = rows.mapInArrow(ask, REQUEST)
    return asked.groupBy("bucket").applyInArrow(answer, FOUND).groupBy("doc_id").agg(F.collect_list("found").alias("found"))


def members(keys: np.ndarray, blobs: list[bytes] | None) -> np.ndarray:
    """Which keys are among those that ``in_others`` gave."""
    if not blobs:
        return np.zeros(len(keys), bool)
    known = np.sort(np.frombuffer(b"".join(blobs), np.uint64))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the windows that begin at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0
