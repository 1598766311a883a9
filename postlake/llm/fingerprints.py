"""Substring dedup on words by a log-structured fingerprint index.

A window of K words has a 64-bit fingerprint, and 32 bits of an independently seeded hash of the same words that
verify a match: with 96 bits in all, 1.6e13 windows (100 TB) are expected to hold 0.002 pairs that match by chance.
``FingerprintIndex`` keeps the fingerprints of past batches as immutable runs, sorted within hash buckets; no
fingerprint is in two runs. ``add`` merge-joins a new batch with all runs, bucket by bucket, tells its documents
which of their windows the past or a smaller doc_id of the batch has, and makes what is new a run; before, past runs
are compacted into one where there are more than ``most``. ``dedup`` and ``remove`` add a table in BATCHES batches of
rising doc_id, and compact before the third. As all batches are at hand there, a first pass over the whole table finds
the anchors (the least hash of ANCHOR words in a window, about one in five words) that two documents share; windows
without such an anchor can match nothing and stay out of the index, which so holds the repeated part of a table only.
Batches that come over time go in whole.

Within a task's chunk equal windows go on once, so a passage of a third of all rows costs one entry a chunk; buckets
are dealt by fingerprint and grow in number with the input. A batch becomes a run by one rename once it is whole, and
a batch that is added again after a crash meets every run but its own, so a retry gives the same answers.

Defined results: a null or empty text has no words; texts under K words lose nothing; of equal texts the one with
the smallest doc_id stays whole; a very long text is hashed alone, some tens of bytes a word; rows with a null doc_id are left as they are, as they have no place in the order;
rows that repeat a doc_id are the same document to each other. Other columns are kept by ``remove``.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm import hashing, runs
from postlake.llm.shared import Scratch, buckets_for, delete, shared_dir, written
from postlake.llm.squeezed import restored, squeezed

K, ANCHOR, BATCHES = 13, 5, 3
CHECK = "<u4"
#: Fingerprints a row of a run.
_ROW = 1 << 20
RUN = "kind int, bucket int, keys binary, checks binary, doc_id long, found binary"
RUN_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("doc_id", pa.int64()), ("found", pa.binary())])


def _windows(buf: np.ndarray, off: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each whole window, the place of its first word among the words of its text, and its anchor."""
    start, end, first = hashing.words(buf, off)
    h = hashing.word_hashes(buf, start, end, seed)
    own, grams = hashing.windows(h, K), hashing.windows(h, ANCHOR)
    anchor = grams[: len(own)].copy()
    for j in range(1, K - ANCHOR + 1):
        np.minimum(anchor, grams[j : j + len(own)], out=anchor)
    text = np.searchsorted(first, np.arange(len(own)), "right") - 1
    whole = np.arange(len(own)) + K <= first[text + 1]
    # Least hashes crowd near zero; mixed, they spread over all buckets.
    return own[whole], text[whole], (np.arange(len(own)) - first[text])[whole], hashing.mix(anchor[whole])


def _anchors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = batch.column(0).to_numpy()
    for a, _, buf, off in hashing.texts(batch):
        _, text, _, anchor = _windows(buf, off)
        new = runs.first_of_runs(anchor) | runs.first_of_runs(text)
        yield anchor[new], np.zeros(int(new.sum()), "u1"), ids[a + text[new]]


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Fingerprints, checks and documents of all windows or, where anchors come along, of the windows with one of them."""
    ids, few = batch.column("doc_id").to_numpy(), "anchors" in batch.schema.names
    for a, b, buf, off in hashing.texts(batch):
        own, text, _, anchor = _windows(buf, off)
        checks = (_windows(buf, off, seed=1)[0] >> np.uint64(32)).astype(CHECK)
        if few:
            cut, known = np.searchsorted(text, np.arange(b - a + 1)), batch.column("anchors").slice(a, b - a)
            keep = [runs.members(anchor[x:y], blobs.as_py()) for x, y, blobs in zip(cut, cut[1:], known)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            own, checks, text = own[keep], checks[keep], text[keep]
        yield own, checks, ids[a + text]


def _known(keys: np.ndarray, checks: np.ndarray, run_keys: np.ndarray, run_checks: np.ndarray) -> np.ndarray:
    """Which fingerprints a sorted run holds, checks included: a merge of two sorted lists."""
    out, at = np.zeros(len(keys), bool), np.searchsorted(run_keys, keys)
    while len(run_keys):
        there = at < len(run_keys)
        place = np.where(there, at, 0)
        same = there & (run_keys[place] == keys)
        out |= same & (run_checks[place] == checks)
        if not (same & ~out).any():
            break
        at = np.where(same & ~out, at + 1, len(run_keys))  # the same fingerprint with another check may follow
    return out


def _rows(bucket: int, keys: np.ndarray, checks: np.ndarray) -> Iterator[dict]:
    for a in range(0, len(keys), _ROW):
        yield {"kind": 0, "bucket": bucket, "keys": keys[a : a + _ROW].tobytes(), "checks": checks[a : a + _ROW].tobytes()}


def _joined(batch: pa.Table, history: pa.Table) -> pa.Table:
    """A bucket: answers for the batch's documents (kind 1), and its new fingerprints as rows of a run (kind 0)."""
    out, parts = [], []
    for r in batch.to_pylist():
        if r["doc_id"] is not None:
            out.append({"kind": 1, "doc_id": r["doc_id"], "found": r["found"]})
        else:
            k = np.frombuffer(r["keys"], np.uint64)
            parts.append((k, np.frombuffer(r["checks"], CHECK) if r["checks"] else np.zeros(len(k), CHECK), runs.ids_back(r["base"], r["docs"], len(k))))
            bucket = r["bucket"]
    if parts:
        keys, checks, docs, first = runs.ordered(*(np.concatenate(x) for x in zip(*parts)))
        past = np.zeros(len(keys), bool)
        for k, c in zip(history["keys"], history["checks"]):
            past |= _known(keys, checks, np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), CHECK))
        told = past | runs.shared(first, later=True)
        out += [{"kind": 1, "doc_id": a, "found": b} for a, b in runs.by_document(docs[told], keys[told])]
        new = first & ~past
        out += _rows(bucket, keys[new], checks[new])
    return pa.Table.from_pylist(out, RUN_ARROW)


def _first(batch: pa.Table) -> pa.Table:
    return _joined(batch, pa.table({"keys": pa.array([], pa.binary()), "checks": pa.array([], pa.binary())}))


def _merged(table: pa.Table) -> pa.Table:
    keys, checks = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("keys", np.uint64), ("checks", CHECK)))
    order = np.lexsort((checks, keys))
    return pa.Table.from_pylist([*_rows(table["bucket"][0].as_py(), keys[order], checks[order])], RUN_ARROW)


class FingerprintIndex:
    """Fingerprints of past batches in a folder: immutable runs, compacted where a batch would meet over ``most``."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 256, most: int = 4):
        self.spark, self.path, self.n, self.most = spark, path.rstrip("/"), n_buckets, most

    def _fs(self):
        of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        p = of(self.path)
        return of, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Whole runs only: a folder gets its name when all of it is written; the answers beside the fingerprints are no run."""
        of, p, fs = self._fs()
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []
        return [x for x in names if x.startswith("run-") and fs.exists(of(f"{self.path}/{x}/kind=0"))]

    def _read(self, names: list[str]) -> DataFrame:
        each = (self.spark.read.schema(RUN).parquet(f"{self.path}/{x}").where("kind = 0") for x in names)
        return functools.reduce(DataFrame.unionByName, each).select("bucket", "keys", "checks")

    def _placed(self, names: list[str]) -> DataFrame:
        """The runs' rows with this index's number of buckets: a row of fewer buckets is cut in its order."""
        n = self.n

        def cut(batches):
            for batch in batches:
                out = []
                for k, c in zip(batch.column(1), batch.column(2)):
                    keys, checks = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), CHECK)
                    out += [{"bucket": b, "keys": keys[s].tobytes(), "checks": checks[s].tobytes()} for b, s in runs.bucketed(keys, n)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary())]))

        return self._read(names).mapInArrow(cut, "bucket int, keys binary, checks binary")

    def _commit(self, rows: DataFrame, name: str) -> None:
        of, _, fs = self._fs()
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/new-{name}")
        fs.delete(of(f"{self.path}/run-{name}"), True)
        if not fs.rename(of(f"{self.path}/new-{name}"), of(f"{self.path}/run-{name}")):
            raise OSError(f"{self.path}/run-{name} could not be named")

    def add(self, docs: DataFrame, batch: str, anchors: DataFrame | None = None) -> DataFrame:
        """doc_id, found: windows of the new batch that the past or a smaller id of the batch has. The batch is a run then.

        ``batch`` names it: adding the last batch again meets every run but its own. The answers lie beside the run, a
        document in several rows, and are replaced when the batch is added again. ``anchors`` (doc_id, found) leaves out the windows without one of their document's.
        """
        n, few, past = self.n, anchors is not None, [x for x in self.runs() if x != f"run-{batch}"]
        if len(past) > self.most:
            past = self.compact(past)

        def ask(batches):
            made = runs.chunks(x for b in batches for part in (restored(b) if few else (b,)) for x in _entries(part))
            yield from runs.sent((r for k, c, d in made for r in runs.requests(k, c, d, n, True)), runs.REQUEST_ARROW)

        slim = docs.where("doc_id is not null").select("doc_id", "text")
        if few:
            slim = squeezed(slim).join(anchors.withColumnRenamed("found", "anchors").hint("merge"), "doc_id")
        asked = slim.mapInArrow(ask, runs.REQUEST)
        by = asked.groupBy("bucket")
        self._commit(by.cogroup(self._placed(past).groupBy("bucket")).applyInArrow(_joined, RUN) if past else by.applyInArrow(_first, RUN), batch)
        return self.spark.read.schema(RUN).parquet(f"{self.path}/run-{batch}").where("kind = 1").select("doc_id", "found")

    def compact(self, past: list[str] | None = None) -> list[str]:
        """Merges runs into one; the old ones go only when it is whole. If they stay after a crash, they hold nothing that it lacks."""
        past, name = self.runs() if past is None else past, f"compact-{uuid.uuid4().hex}"
        self._commit(self._placed(past).groupBy("bucket").applyInArrow(_merged, RUN), name)
        self.forget(past)
        return [f"run-{name}"]

    def forget(self, names: list[str]) -> None:
        """Deletes the fingerprints of runs; the answers given when they were added stay."""
        for x in names:
            delete(self.spark, f"{self.path}/{x}/kind=0")


def later_windows(docs: DataFrame, folder: str, batches: int = BATCHES) -> DataFrame:
    """doc_id, found: fingerprints of the windows that a document with a smaller id has too; the table goes into an index batch by batch.

    The answers lie in ``folder``; the fingerprints go when all batches are in.
    """
    spark, slim = docs.sparkSession, docs.where("doc_id is not null").select("doc_id", "text")
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)})
    bounds, parts = [None, *cuts, None], []
    with Scratch(spark) as s:
        n = buckets_for(docs)
        anchors = s.written(runs.in_others(slim, _anchors, n, later=False), "anchors")
        index = FingerprintIndex(spark, f"{folder}/index-{uuid.uuid4().hex}", n, most=1)
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            of = slim if low is None else slim.where(F.col("doc_id") > low)
            parts.append(index.add(of if high is None else of.where(F.col("doc_id") <= high), f"{k:06d}", anchors))
        index.forget(index.runs())
    return functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.collect_list("found").alias("found"))


def _finished(docs: DataFrame, found: DataFrame, with_text: bool, rest: tuple[str, ...] = ()) -> DataFrame:
    """``rest``: columns that come along in the struct ``rest``."""
    extra = "text string, " if with_text else ""
    along = [F.struct(*rest).alias("rest")] if rest else []

    def run(batches):
        for batch in (part for whole in batches for part in (restored(whole) if pa.types.is_binary(whole.schema.field("text").type) else (whole,))):
            for a, b, buf, off in hashing.texts(batch):
                out, blobs = [], batch.column("found").slice(a, b - a).to_pylist()
                own, text, place, _ = _windows(buf, off) if any(blobs) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), None)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    words = buf[off[i] : off[i + 1]].tobytes().split()
                    r = slice(cut[i], cut[i + 1])
                    hit = place[r][runs.members(own[r], blobs[i])]
                    gone = runs.covered(hit, K, len(words)) if len(hit) else np.zeros(len(words), bool)
                    kept = b" ".join(compress(words, (~gone).tolist()) if len(hit) else words)
                    row = {"doc_id": batch.column("doc_id")[a + i].as_py(), "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                    # A text that loses nothing keeps its own white space.
                    out.append(row | ({"text": kept.decode() if len(hit) else batch.column("text")[a + i].as_py()} if with_text else {}))
                schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * with_text)
                made = pa.RecordBatch.from_pylist(out, schema).select([x.split()[0] for x in f"doc_id long, {extra}n_words long, n_removed long, kept_sha256 string".split(", ")])
                yield made.append_column("rest", batch.column("rest").slice(a, b - a)) if rest else made

    sent = docs.select("doc_id", "text", *along)
    schema = T.StructType([*T.StructType.fromDDL(f"doc_id long, {extra}n_words long, n_removed long, kept_sha256 string"), *(f for f in sent.schema if f.name == "rest")])
    # A worker of a task that runs two of these functions stays and takes turns with the other, so no stage has both: the
    # join shuffles, and texts that cross no shuffle go as they are.
    slim = squeezed(sent.where("doc_id is not null")).join(found.hint("merge"), "doc_id", "left")
    bare = sent.where("doc_id is null").withColumn("found", F.lit(None).cast("array<binary>"))
    return slim.mapInArrow(run, schema).unionByName(bare.mapInArrow(run, schema))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    with Scratch(docs.sparkSession) as s:
        return written(_finished(docs, later_windows(docs, s.folder), with_text=False), "digests")


def remove(docs: DataFrame) -> DataFrame:
    """The documents without words that an earlier document has in a shared window; documents left without words go."""
    rest = tuple(c for c in docs.columns if c != "text")
    done = _finished(docs, later_windows(docs, shared_dir(docs.sparkSession)), with_text=True, rest=rest).where("n_removed < n_words")
    return done.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
