"""A persistent inverted index: postings by term bucket in segments, scored by weighted BM25.

A posting is one term in one column of one document: term, doc_id, col, len (tokens of the whole document), positions.
They are written in lists, one for each term of a chunk of documents, partitioned by a hash of the term and sorted by term, so a query reads the buckets of its words only
and shuffles nothing but their postings, once, by document. See ``segments`` for how the index is kept and changed.
"""

from __future__ import annotations

import collections
import functools
import itertools
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.stem import stem
from postlake.operators import segments
from postlake.operators.grammar import Expr, Leaf, parse
from postlake.operators.segments import Index, bucket_of

K1, B, FLOOR = 1.2, 0.75, 1e-6
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, without diacritics."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    """The index terms of a text, in order."""
    found = _WORD.findall(folded(text)) if text else []
    return [*map(stem, found)] if stemmed else found


class _Chunk:
    """The tokens of some documents in numbers, put by term at once."""

    def __init__(self, stemmed: bool):
        self.stemmed, self.terms = stemmed, collections.defaultdict(itertools.count().__next__)
        self.ids, self.lens, self.parts, self.size = [], [], [], 0

    def add(self, doc_id: int | None, texts: list[str | None]) -> None:
        size = 0
        for col, text in enumerate(texts):
            if own := tokens(text, False):
                self.parts.append((len(self.ids), col, np.fromiter(map(self.terms.__getitem__, own), np.int32, len(own))))
                size += len(own)
        self.ids.append(doc_id)
        self.lens.append(size)
        self.size += size

    def lists(self) -> pa.RecordBatch:
        """``LISTS`` of the chunk, its lengths (without a term) first."""
        ids, lens = pa.array(self.ids, pa.int64()), np.array(self.lens, np.int32)
        sizes = np.array([len(c) for _, _, c in self.parts], np.int64)
        codes = np.concatenate([np.zeros(0, np.int32), *(c for _, _, c in self.parts)])
        terms = [*self.terms]
        if self.stemmed and terms:
            terms, again = np.unique([*map(stem, terms)], return_inverse=True)
            terms, codes = terms.tolist(), again[codes]
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        part = np.repeat(np.arange(len(sizes)), sizes)[order]
        place = (order - np.repeat(np.cumsum(sizes) - sizes, sizes)[order]).astype(np.int32)
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        row = np.flatnonzero(new)  # where a term's tokens begin
        new[1:] |= part[1:] != part[:-1]
        entry = np.flatnonzero(new)  # and those of one column of one document
        doc = np.array([d for d, _, _ in self.parts], np.int64)[part[entry]]
        col = np.array([c for _, c, _ in self.parts], np.int8)[part[entry]]
        # The first list is that of the lengths: as many entries as documents, no positions.
        zero = np.zeros(len(ids), np.int32)
        rows = np.append(0, len(ids) + np.searchsorted(entry, row))
        found = pa.array([None, *(terms[k] for k in codes[row].tolist())], pa.string())
        many = np.append(entry[1:], len(codes)) - entry if len(codes) else entry
        return segments.packed(found, rows, pa.concat_arrays([ids, ids.take(pa.array(doc))]), np.append(zero, col), np.append(lens, lens[doc]), np.append(zero, many), place)


def _posted(docs: DataFrame, columns: dict[str, str], stemmed: bool) -> DataFrame:
    """Lists of postings (``LISTS``) by chunks of documents; a list without a term holds the lengths of a chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(stemmed)
        for batch in batches:
            for i, d in enumerate(batch.column(0).to_pylist()):
                chunk.add(d, [batch.column(k + 1)[i].as_py() for k in range(len(columns))])
                if chunk.size > segments.CHUNK or len(chunk.ids) > segments.CHUNK:
                    yield chunk.lists()
                    chunk = _Chunk(stemmed)
        if chunk.ids:
            yield chunk.lists()

    return docs.select("doc_id", *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns.values()))).mapInArrow(run, segments.LISTS.replace(", bucket int", ""))


def _texts(index: Index, docs: DataFrame) -> DataFrame | None:
    """doc_id, texts: what substrings are looked for in, in lower case."""
    return docs.select("doc_id", F.array(*(F.lower(F.coalesce(F.col(index.columns[c]), F.lit(""))) for c in index.grams)).alias("texts")) if index.grams else None


def build(docs: DataFrame, columns: dict[str, str], path: str, weights: dict[str, float] | None = None, stemmed: bool = True, grams: tuple[str, ...] = (), upto: int = 0) -> Index:
    """A new index of ``columns`` (name in the index: column of ``docs``) in the folder ``path``, as one segment; an index there gets a new manifest.

    ``grams``: columns of the index whose substrings are indexed. ``upto``: what the caller knows the index is level with.
    """
    spark = docs.sparkSession
    old = segments.opened(spark, path)
    empty = Index(path.rstrip("/"), dict(columns), dict(weights or {}), stemmed, tuple(grams), (), old.number if old else 0, upto)
    return updated(empty, docs, None, upto)


def updated(index: Index, changed: DataFrame, gone: DataFrame | None = None, upto: int | None = None) -> Index:
    """The index with a segment of new and changed documents in their present form, without what ``gone`` (doc_id) names. Nothing else is read as text."""
    posted = _posted(changed, index.columns, index.stemmed)
    return segments.added(index, changed.sparkSession, changed.select("doc_id"), posted, _texts(index, changed), gone, upto)


def upkeep(index: Index, spark: SparkSession) -> Index:
    """Merges of segments until none is due."""
    while (then := segments.merged(index, spark)) is not index:
        index = then
    return index


def _atoms(leaves: list[Leaf]) -> list[tuple[str, bool]]:
    """Distinct (word, is a prefix) of a query."""
    return list(dict.fromkeys(a for leaf in leaves for phrase in leaf.phrases for a in phrase))


def _occurrences(leaf: Leaf, at: dict[tuple[str, bool], Column]) -> Column:
    """Places in one column of one document where a leaf matches: of its first phrase, if there are others near it."""

    def starts(phrase) -> Column:
        rest = [*enumerate(phrase)][1:]
        if not rest:
            return at[phrase[0]]
        return F.filter(at[phrase[0]], lambda x: functools.reduce(Column.__and__, (F.array_contains(at[a], x + k) for k, a in rest)))

    def beside(other: Column, lead: int, size: int) -> Callable:
        gap = lambda x, y: F.when(y >= x, y - x - lead).otherwise(x - y - size)
        return lambda x: F.exists(other, lambda y: gap(x, y) <= leaf.near)

    first = starts(leaf.phrases[0])
    for p in leaf.phrases[1:]:
        first = F.filter(first, beside(starts(p), len(leaf.phrases[0]), len(p)))
    return F.size(first)


def matches(index: Index, spark: SparkSession, query: str, scope: str | None = None) -> DataFrame:
    """doc_id, score of the documents that match a query; the words may be asked for in one column only."""
    leaves, expr = parse(query, lambda s: tokens(s, index.stemmed))
    if not leaves:
        return spark.createDataFrame([], "doc_id long, score double")
    atoms = _atoms(leaves)
    whole = [t for t, prefix in atoms if not prefix]
    begun = {t: index.prefixed(spark, t) for t, prefix in atoms if prefix}

    def pick(s: segments.Segment) -> Column | None:
        # Folded to literals, so that only these buckets are listed and read.
        conds = [(F.col("bucket") == bucket_of(F.lit(t), s.buckets)) & (F.col("term") == t) for t in whole]
        conds += [F.col("bucket").isin(at[s.name]) & F.startswith("term", F.lit(t)) for t, at in begun.items() if at[s.name]]
        return functools.reduce(Column.__or__, conds) if conds else None

    found = index.postings(spark, pick).where(F.lit(True) if scope is None else F.col("col") == scope)
    hit = lambda t, prefix: F.startswith("term", F.lit(t)) if prefix else F.col("term") == t
    held = found.groupBy("doc_id", "col").agg(F.first("len").alias("len"), *(F.flatten(F.collect_list(F.when(hit(*a), F.col("positions")))).alias(f"p{k}") for k, a in enumerate(atoms)))
    at = {a: F.col(f"p{k}") for k, a in enumerate(atoms)}
    weight = functools.reduce(lambda c, x: F.when(F.col("col") == x[0], x[1]).otherwise(c), ((c, index.weight(c)) for c in index.columns), F.lit(0.0))
    per = held.groupBy("doc_id").agg(F.first("len").alias("len"), *(F.sum(weight * _occurrences(leaf, at)).alias(f"f{k}") for k, leaf in enumerate(leaves)))
    df = per.agg(*(F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"n{k}") for k in range(len(leaves))))
    score = F.lit(0.0)
    for k in range(len(leaves)):
        n, f = F.coalesce(F.col(f"n{k}"), F.lit(0)), F.col(f"f{k}")
        idf = F.log((index.n - n + 0.5) / (n + 0.5))
        score = score + F.when(idf <= 0, FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / index.mean_length))
    # The counts are one row.
    return per.where(_holds(expr)).crossJoin(F.broadcast(df)).select("doc_id", score.alias("score"))


def _holds(e: Expr) -> Column:
    if e.op == "leaf":
        return F.col(f"f{e.leaf}") > 0
    left, right = _holds(e.left), _holds(e.right)
    return left & right if e.op == "and" else left | right if e.op == "or" else left & ~right


def snippet_of(text: str | None, wanted: Callable[[str], bool], size: int = 12, marks: tuple[str, str, str] = ("»", "«", "…")) -> str:
    """``size`` words around the most distinct hits, hits marked; the head of the text, unmarked, if there are none."""
    text = text or ""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    if not spans:
        return text
    hits = [w if wanted(w := folded(text[a:b])) else None for a, b in spans]
    best, at = 0, 0
    for k, h in enumerate(hits):
        if h is not None and (n := len({x for x in hits[k : k + size] if x is not None})) > best:
            best, at = n, max(0, min(k, len(spans) - size))
    last = min(len(spans), at + size)
    out, place = [], spans[at][0] if at else 0
    for k in range(at, last):
        a, b = spans[k]
        out.append(text[place:a] + (f"{marks[0]}{text[a:b]}{marks[1]}" if hits[k] is not None else text[a:b]))
        place = b
    tail = text[place:] if last == len(spans) else marks[2]
    return ("" if at == 0 else marks[2]) + "".join(out) + tail


def snippets(page: DataFrame, column: str, query: str, stemmed: bool = True) -> DataFrame:
    """Adds ``snippet`` to the rows of a page; Python sees these rows' text only."""
    leaves, _ = parse(query, lambda s: tokens(s, stemmed))
    atoms = _atoms(leaves)

    def run(texts: pa.Array) -> pa.Array:
        form = stem if stemmed else lambda w: w
        wanted = lambda w: any(form(w).startswith(t) if prefix else form(w) == t for t, prefix in atoms)
        return pa.array([snippet_of(t.as_py(), wanted) for t in texts], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return page.withColumn("snippet", F.arrow_udf(run, "string")(F.col(column)))


def fresh(folder: str) -> str:
    return f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
