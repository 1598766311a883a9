"""Segments of an inverted index: immutable folders of postings, read together, merged by size.

A change never rewrites what is there. It adds a segment with the postings of new and changed documents and the ids
whose earlier postings are void (tombstones: a posting counts unless a later segment names its document). A manifest
lists the segments in order; it is written aside and named at once, so readers see the index before or after a change,
and a crash leaves a folder that no manifest names. Once enough segments of like size are at the end they are merged
into one, so a posting is rewritten about log(documents) times in all.

A segment holds, by bucket: ``postings`` in lists (a row for each term of a chunk of documents, see ``LISTS``; sorted by
term), bucket -1 of it the length of each document; ``terms``, the dictionary, by a hash of a term's first two letters, sorted; ``gone``, the tombstones;
and for substrings ``grams`` (three code points as a number, a list of doc_ids; a row for each chunk of documents) and ``texts`` (the columns in lower case, in files as the
documents came, each sorted by doc_id; they are not by bucket).

Defined results: documents that share a doc_id, or have none, are one document with the postings of all of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import files

POSTING = "term string, doc_id long, col string, len int, positions array<int>, bucket int"
#: Postings of one term in a chunk of documents, how many documents they are of, and by posting the document (its distance from the one before), the column's place in the index, the document's length and the number of positions; then all positions (distances too).
LISTS = "term string, n int, docs array<long>, cols array<tinyint>, lens array<int>, sizes array<int>, gaps array<int>, bucket int"
TEXTS = "doc_id long, texts array<string>"
#: Documents a bucket is made for, buckets of a segment at least and at most (more are spread inside), and segments of like size that are merged.
EACH, LEAST, MOST, FAN = 16384, 4, 4096, 4
#: Ids up to this many are sent to the tasks, or named in a filter (fewer), instead of joined by a shuffle.
SENT, NAMED = 2_000_000, 2000
#: Manifests that stay, so readers of the one before keep their files.
KEPT = 2
#: (gram, document) pairs, or tokens, a chunk; and rows that are folded into lists at once.
CHUNK, FOLDED = 1 << 22, 1 << 17


@dataclass(frozen=True)
class Segment:
    """A folder, its layout, and what it adds and voids: documents and their summed lengths."""

    name: str
    buckets: int
    docs: int
    length: int
    gone: int = 0
    gone_docs: int = 0
    gone_length: int = 0


@dataclass(frozen=True)
class Index:
    """A manifest: where the index lies, how it is made (name in the index: column of the documents), and its segments, oldest first."""

    path: str
    columns: dict[str, str]
    weights: dict[str, float]
    stemmed: bool
    grams: tuple[str, ...]
    segments: tuple[Segment, ...] = ()
    number: int = 0
    upto: int = 0

    @property
    def n(self) -> int:
        return sum(s.docs - s.gone_docs for s in self.segments)

    @property
    def mean_length(self) -> float:
        return sum(s.length - s.gone_length for s in self.segments) / self.n if self.n else 0.0

    def weight(self, column: str) -> float:
        return float(self.weights.get(column, 1.0))

    def folder(self, s: Segment, kind: str) -> str:
        return f"{self.path}/{s.name}/{kind}"

    def rows(self, spark: SparkSession, kind: str, schema: str, pick: Callable[[Segment], Column | None], each: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
        """Rows of all segments that ``pick`` wants of each (None: none of them) and no later segment voids; ``each`` brings them to one row a document."""
        parts = [each(spark.read.schema(schema).parquet(self.folder(s, kind)).where(cond)).withColumn("_seg", F.lit(k)) for k, s in enumerate(self.segments) if s.docs and (cond := pick(s)) is not None]
        if not parts:
            return each(spark.createDataFrame([], schema))
        return self.live(spark, reduce(DataFrame.unionByName, parts))

    def live(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        dead = [spark.read.schema("doc_id long").parquet(self.folder(s, "gone")).withColumn("_by", F.lit(k)) for k, s in enumerate(self.segments) if s.gone]
        if not dead:
            return rows.drop("_seg")
        last = reduce(DataFrame.unionByName, dead).groupBy("doc_id").agg(F.max("_by").alias("_by"))
        last = F.broadcast(last) if sum(s.gone for s in self.segments) <= SENT else last
        return rows.join(last, "doc_id", "left").where("_by is null or _seg >= _by").drop("_seg", "_by")

    def postings(self, spark: SparkSession, pick: Callable[[Segment], Column | None] = lambda s: F.col("bucket") >= 0) -> DataFrame:
        """Postings (``POSTING``) of the terms that ``pick`` wants of each segment."""
        return self.rows(spark, "postings", LISTS, pick, self.unfolded)

    def unfolded(self, lists: DataFrame) -> DataFrame:
        """A row for each posting of the lists, in their order."""
        names = pa.array([*self.columns], pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _unfolded(batch, names):
                    yield part

        return lists.select(*LISTS.replace(",", " ").split()[::2]).mapInArrow(run, POSTING)

    def lengths(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        """doc_id, len of every document; a row for each that shares a doc_id."""
        each = lambda x: self.unfolded(x).select("doc_id", "len").where(F.lit(True) if where is None else where)
        return self.rows(spark, "postings", LISTS, lambda s: F.col("bucket") == -1, each)

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df, tf over the whole index: the dictionary of a single segment, or counted anew where tombstones are."""
        if not any(s.gone for s in self.segments):
            parts = [spark.read.parquet(self.folder(s, "terms")) for s in self.segments if s.docs]
            if len(parts) == 1:
                return parts[0].select("term", "df", "tf")
        return _dictionary(self.postings(spark)).select("term", "df", "tf")

    def prefixed(self, spark: SparkSession, prefix: str) -> dict[str, list[int]]:
        """By segment, the posting buckets with terms that begin so: at most all buckets. From two letters on, one dictionary bucket a segment is read."""
        out = {}
        for s in self.segments:
            if s.docs:
                read = spark.read.schema("term string, bucket int, head int").parquet(self.folder(s, "terms")).where(F.startswith("term", F.lit(prefix)))
                if len(prefix) >= 2:
                    read = read.where(F.col("head") == _head(F.lit(prefix), s.buckets))
                out[s.name] = [r[0] for r in read.select("bucket").distinct().collect()]
        return out


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _head(term: Column, buckets: int) -> Column:
    return bucket_of(F.left(term, F.lit(2)), buckets)


def _gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The distance of each value from the one before; at ``first`` the value itself."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def _sums(gaps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values that the gaps are of; no stretch is empty."""
    upto = np.cumsum(gaps)
    return upto - np.repeat(upto[first] - gaps[first], np.diff(np.append(first, len(gaps))))


def packed(terms: pa.Array, row: np.ndarray, docs: pa.Array, cols: np.ndarray, lens: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """``LISTS`` out of postings in order: ``row`` tells where each term's begin, and no term is without one."""
    ends = np.append(row, len(docs)).astype(np.int32)
    # A null doc_id repeats the one before, so that distances pass over it.
    known = docs.is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(docs, 0).to_numpy()
    if not known.all():
        at = np.maximum.accumulate(np.where(known, np.arange(len(ids)), -1))
        ids = np.where((at >= np.repeat(row, np.diff(ends))) & (at >= 0), ids[at], 0)
    fresh = np.ones(len(ids), bool)
    fresh[1:] = ids[1:] != ids[:-1]
    fresh[row] = True
    # Of a list that begins with nulls the first known document counts.
    n = np.add.reduceat((fresh & known).astype(np.int64), row) if len(row) else np.zeros(0, np.int64)
    if not known.all():
        n = np.array([len(np.unique(ids[a:b][known[a:b]])) for a, b in zip(ends[:-1], ends[1:])], np.int64)
    upto = np.append(0, np.cumsum(sizes.astype(np.int64)))
    some = upto[:-1][sizes > 0]
    of = lambda values, at=ends: pa.ListArray.from_arrays(pa.array(at), values)
    gaps = _gaps(places.astype(np.int32), some) if len(places) else places.astype(np.int32)
    cells = [of(pa.array(_gaps(ids, row) if len(ids) else ids, pa.int64(), mask=~known)), of(pa.array(cols.astype(np.int8))), of(pa.array(lens.astype(np.int32))), of(pa.array(sizes.astype(np.int32))), of(pa.array(gaps), upto[ends].astype(np.int32))]
    return pa.RecordBatch.from_arrays([terms, pa.array(n.astype(np.int32)), *cells], ["term", "n", "docs", "cols", "lens", "sizes", "gaps"])


def _unfolded(batch: pa.RecordBatch, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """Postings of lists, some thousands of them at once."""
    size = np.append(0, np.cumsum(pc.list_value_length(batch["gaps"]).to_numpy(zero_copy_only=False) + pc.list_value_length(batch["docs"]).to_numpy(zero_copy_only=False)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, size[a] + FOLDED * 4, "right")) - 1)
        x, a = batch.slice(a, b - a), b
        flat = {name: pc.list_flatten(x[name]) for name in ("docs", "cols", "lens", "sizes", "gaps")}
        many = pc.list_value_length(x["docs"]).to_numpy(zero_copy_only=False)
        row = np.cumsum(many) - many
        docs = _sums(pc.fill_null(flat["docs"], 0).to_numpy(), row[many > 0])
        sizes = flat["sizes"].to_numpy()
        upto = np.append(0, np.cumsum(sizes.astype(np.int64)))
        places = _sums(flat["gaps"].to_numpy(), upto[:-1][sizes > 0]).astype(np.int32)
        of = pa.array(np.repeat(np.arange(x.num_rows), many))
        cells = [x["term"].take(of), pa.array(docs, pa.int64(), mask=flat["docs"].is_null().to_numpy(zero_copy_only=False)), names.take(flat["cols"]), flat["lens"], pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(places)), x["bucket"].take(of)]
        yield pa.RecordBatch.from_arrays(cells, ["term", "doc_id", "col", "len", "positions", "bucket"])


def folded(postings: DataFrame, columns: list[str]) -> DataFrame:
    """Lists out of postings: one for each stretch of rows of one term that a task meets; a term's postings of one document must come in a row."""

    def lists(t: pa.Table) -> pa.RecordBatch:
        part = {name: t[name].combine_chunks() for name in t.column_names}
        sizes = pc.fill_null(pc.list_value_length(part["positions"]), 0).to_numpy(zero_copy_only=False)
        cols = pc.fill_null(pc.index_in(part["col"], pa.array(columns, pa.string())), 0).to_numpy(zero_copy_only=False)
        first, _ = _changes(t, ("term",))
        return packed(part["term"].take(pa.array(first)), first, part["doc_id"], cols, part["len"].to_numpy(zero_copy_only=False), sizes, pc.list_flatten(part["positions"]).to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOLDED:
                t = pa.Table.from_batches(held).combine_chunks()
                # The last document of the last term may go on.
                _, last = _changes(t, ("term", "doc_id"))
                if last:
                    yield lists(t.slice(0, last))
                held, size = pa.Table.from_batches(t.slice(last).to_batches()).to_batches(), t.num_rows - last
        if size:
            yield lists(pa.Table.from_batches(held))

    return postings.select("term", "doc_id", "col", "len", "positions").mapInArrow(run, LISTS.replace(", bucket int", ""))


def _changes(t: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """The rows at which a stretch of equal keys begins, and the last of them."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for key in keys:
        codes = pc.fill_null(pc.dictionary_encode(t[key].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first = np.flatnonzero(new)
    return first, int(first[-1]) if len(first) else 0


def _counted(index: Index, lists: DataFrame) -> DataFrame:
    """The dictionary of one segment's lists. A list tells how many documents it is of; only where documents share a doc_id are these counted by their ids."""
    ids = index.unfolded(lists.where("bucket = -1")).select("doc_id")
    lists = lists.where("bucket >= 0")
    if ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _dictionary(index.unfolded(lists))
    return lists.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tf"))


def _dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term").agg(F.countDistinct("doc_id").alias("df"), F.sum(F.size("positions")).cast("long").alias("tf"))


def grams_of(text: str) -> np.ndarray:
    """The distinct stretches of three code points of a text, as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _grams(texts: DataFrame) -> DataFrame:
    """gram, docs: for each chunk of texts (doc_id, texts) the documents of each gram."""

    def lists(grams: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        docs = pa.array(np.repeat(np.array(ids, np.int64), [len(g) for g in grams])[order])
        return pa.RecordBatch.from_arrays([pa.array(every[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(every)).astype(np.int32)), docs)], ["gram", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = [], [], 0
        for batch in batches:
            for doc_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.unique(np.concatenate([grams_of(v) for v in values.as_py() if v and len(v) > 2] or [np.zeros(0, np.int64)]))
                if len(found) and doc_id is not None:
                    held.append(found)
                    ids.append(doc_id)
                    size += len(found)
                if size > CHUNK:
                    yield lists(held, ids)
                    held, ids, size = [], [], 0
        if held:
            yield lists(held, ids)

    return texts.select("doc_id", "texts").mapInArrow(run, "gram long, docs array<long>")


def _layout(docs: int) -> tuple[int, int]:
    """Buckets of a segment, and parts of each, so that no task's share grows with the segment and a frequent term is no single task's work."""
    buckets = LEAST
    while buckets * EACH < docs and buckets < MOST:
        buckets *= 2
    return buckets, max(2, -(-docs // (buckets * EACH)) * 2)


def _put(df: DataFrame, key: list[Column | str], order: list[str], parts: int, folder: str) -> None:
    df.repartition("bucket", F.pmod(F.xxhash64(*key), F.lit(parts))).sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(folder)


def _written(index: Index, spark: SparkSession, lists: DataFrame, texts: DataFrame | None, docs: int) -> Segment:
    """A segment out of lists of postings (without a term: of lengths) and texts, laid out for so many documents."""
    name = f"seg-{uuid.uuid4().hex}"
    buckets, parts = _layout(docs)
    place = F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), buckets)).cast("int")
    _put(lists.withColumn("bucket", place), ["term", F.get("docs", F.lit(0))], ["term"], parts, f"{index.path}/{name}/postings")
    made = spark.read.schema(LISTS).parquet(f"{index.path}/{name}/postings")
    words = _counted(index, made).withColumn("head", _head(F.col("term"), buckets))
    words.repartition("head").sortWithinPartitions("head", "term").write.partitionBy("head").parquet(f"{index.path}/{name}/terms")
    if texts is not None:
        texts.sortWithinPartitions("doc_id").write.option("compression", "zstd").parquet(f"{index.path}/{name}/texts")
        grams = _grams(spark.read.schema(TEXTS).parquet(f"{index.path}/{name}/texts"))
        _put(grams.withColumn("bucket", bucket_of(F.col("gram"), buckets)), ["gram", F.get("docs", F.lit(0))], ["gram"], parts, f"{index.path}/{name}/grams")
    n, length = made.where("bucket = -1").agg(F.sum(F.size("docs")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return Segment(name, buckets, int(n or 0), int(length or 0))


def committed(index: Index, spark: SparkSession) -> Index:
    """The index with its manifest written; then manifests before the last ones go, and the folders that none of those left names."""
    new = replace(index, number=index.number + 1)
    aside = f"{new.path}/new-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(asdict(new)),)], "manifest string").coalesce(1).write.parquet(aside)
    files.rename(spark, aside, f"{new.path}/manifests/m{new.number}")
    old = [k for k in _numbers(spark, new.path) if k <= new.number - KEPT]
    if old:
        named = {s.name for k in _numbers(spark, new.path) if k > new.number - KEPT for s in opened(spark, new.path, k).segments}
        gone = {s.name for k in old for s in opened(spark, new.path, k).segments} - named
        for name in gone:
            files.remove(spark, f"{new.path}/{name}")
        for k in old:
            files.remove(spark, f"{new.path}/manifests/m{k}")
    return new


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[1:]) for n in files.names(spark, f"{path}/manifests") if n.startswith("m") and n[1:].isdigit())


def opened(spark: SparkSession, path: str, number: int | None = None) -> Index | None:
    """The newest manifest of an index (or the given one); None where there is none."""
    found = _numbers(spark, path)
    if not found:
        return None
    x = json.loads(spark.read.parquet(f"{path}/manifests/m{number or found[-1]}").first()[0])
    return Index(**x | {"segments": tuple(Segment(**s) for s in x["segments"]), "grams": tuple(x["grams"])})


def added(index: Index, spark: SparkSession, ids: DataFrame, posted: DataFrame, texts: DataFrame | None, gone: DataFrame | None, upto: int | None = None) -> Index:
    """The index with one more segment: lists of postings of new and changed documents (``ids``: doc_id, a row each), and tombstones for ``gone`` (doc_id) and all of them."""
    docs, own = ids.count(), ids.select("doc_id").distinct()
    seg, void = None, None
    if index.segments:
        void = own if gone is None else own.unionByName(gone.select("doc_id")).distinct()
        # Only ids that are in the index need one.
        few = [r[0] for r in void.where("doc_id is not null").limit(NAMED + 1).collect()]
        held = index.lengths(spark, F.col("doc_id").isin(few)) if len(few) <= NAMED else index.lengths(spark).join(void, "doc_id", "left_semi")
        held = held.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
        aside = f"{index.path}/void-{uuid.uuid4().hex}"
        held.write.parquet(aside)
        void = spark.read.parquet(aside)
        voided, n, length = void.agg(F.count("*"), F.sum("n"), F.sum("len")).first()
    seg = _written(index, spark, posted, texts, docs)
    if index.segments:
        if voided:
            void.select("doc_id").sort("doc_id").write.parquet(f"{index.path}/{seg.name}/gone")
            seg = replace(seg, gone=voided, gone_docs=int(n), gone_length=int(length))
        files.remove(spark, aside)
    return committed(replace(index, segments=(*index.segments, seg), upto=index.upto if upto is None else upto), spark)


def due(index: Index, fan: int = FAN) -> int | None:
    """Where the stretch of segments at the end begins that should be merged: ``fan`` or more, none ``fan`` times the sum behind it."""
    at, total = len(index.segments), 0
    while at and index.segments[at - 1].docs < fan * max(1, total or index.segments[at - 1].docs):
        at -= 1
        total += index.segments[at].docs
    return at if len(index.segments) - at >= fan else None


def merged(index: Index, spark: SparkSession, begin: int | None = None) -> Index:
    """The index with its last segments as one (those that are due, or from ``begin`` on): void postings left out, tombstones kept for older segments."""
    begin = due(index) if begin is None else begin
    if begin is None or len(index.segments) - begin < 2:
        return index
    own = index.segments[begin:]
    part = replace(index, segments=own)
    docs = sum(s.docs for s in own)
    texts = part.rows(spark, "texts", TEXTS, lambda s: F.lit(True)) if index.grams else None
    postings = part.postings(spark, lambda s: F.lit(True))
    if sum(s.gone for s in own) > SENT:
        postings = postings.sortWithinPartitions("term", "doc_id")
    seg = _written(index, spark, folded(postings, [*index.columns]), texts, docs)
    net, length = sum(s.docs - s.gone_docs for s in own), sum(s.length - s.gone_length for s in own)
    seg = replace(seg, gone_docs=seg.docs - net, gone_length=seg.length - length)
    if begin and any(s.gone for s in own):
        gone = reduce(DataFrame.unionByName, (spark.read.parquet(index.folder(s, "gone")) for s in own if s.gone)).distinct()
        gone.sort("doc_id").write.parquet(f"{index.path}/{seg.name}/gone")
        seg = replace(seg, gone=spark.read.parquet(f"{index.path}/{seg.name}/gone").count())
    return committed(replace(index, segments=(*index.segments[:begin], seg)), spark)


def holding(index: Index, spark: SparkSession, needle: str, rarest: int = 4) -> DataFrame:
    """doc_id of the documents with a column that holds the needle in any case; shorter ones than three characters find nothing.

    Postings of the needle's rarest grams are intersected, then the needle is looked for in the texts of the documents
    left, of which only row groups that may hold their ids are read.
    """
    none = spark.createDataFrame([], "doc_id long")
    lower = spark.range(1).select(F.lower(F.lit(needle))).first()[0]
    if not index.grams or len(lower) < 3:
        return none
    wanted = grams_of(lower).tolist()
    of = lambda s, keys: reduce(Column.__or__, ((F.col("bucket") == bucket_of(F.lit(k).cast("long"), s.buckets)) & (F.col("gram") == k) for k in keys))
    lists, flat = "gram long, docs array<long>, bucket int", lambda x: x.select("gram", F.explode("docs").alias("doc_id"))
    # How many documents a gram has, tombstones aside, tells which are rare; one that has none ends it.
    counts = dict(reduce(DataFrame.unionByName, (spark.read.schema(lists).parquet(index.folder(s, "grams")).where(of(s, wanted)).select("gram", F.size("docs").alias("n")) for s in index.segments if s.docs)).groupBy("gram").agg(F.sum("n")).collect()) if index.n else {}
    if len(counts) < len(wanted):
        return none
    keys = sorted(wanted, key=lambda g: (counts[g], g))[:rarest]
    found = index.rows(spark, "grams", lists, lambda s: of(s, keys), flat).groupBy("doc_id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(keys)).select("doc_id")
    few = [r[0] for r in found.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        texts = index.rows(spark, "texts", TEXTS, lambda s: F.col("doc_id").isin(few) if few else None)
    else:
        texts = index.rows(spark, "texts", TEXTS, lambda s: F.lit(True)).join(found, "doc_id", "left_semi")
    return texts.where(F.exists("texts", lambda t: F.contains(t, F.lit(lower)))).select("doc_id").distinct()
