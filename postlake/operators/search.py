"""Search over messages: ranked keyword, semantic and hybrid modes with filters, totals, snippets and fallbacks.

Keyword search reads the postings of its words (``index``); filters reach the message scan; the page is a top-k and the
total a count over the same matches. Semantic search ranks a scan of vectors; hybrid fuses the best of both by rank.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postlake.errors import InvalidArgument
from postlake.operators import index as inverted
from postlake.operators import segments, vectors
from postlake.operators.filters import predicate
from postlake.operators.grammar import wants_substring

MODES = ("keyword", "semantic", "hybrid")
#: Results of each list that hybrid search fuses.
FUSED = 100


@dataclass
class Found:
    """A page of hits, how many there are in all, and how they were found."""

    hits: DataFrame
    total_estimated: int
    mode: str
    degraded: bool = False
    note: str | None = None


class Backend(ABC):
    """What finds messages: matches as (id, score), higher being better."""

    @abstractmethod
    def matches(self, spark: SparkSession, query: str, scope: str | None = None) -> DataFrame: ...


class KeywordBackend(Backend):
    def __init__(self, index: inverted.Index):
        self.index = index

    def matches(self, spark: SparkSession, query: str, scope: str | None = None) -> DataFrame:
        return inverted.matches(self.index, spark, query, scope).withColumnRenamed("doc_id", "id")


class TrigramBackend(Backend):
    """The same by the index's grams: postings instead of texts."""

    def __init__(self, index: inverted.Index):
        self.index = index

    def matches(self, spark: SparkSession, query: str, scope: str | None = None) -> DataFrame:
        return segments.holding(self.index, spark, query).select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score"))


class SubstringBackend(Backend):
    """By a scan of the messages. Any case, three characters at least; all scores are 0."""

    def __init__(self, emails: DataFrame, columns: tuple[str, ...] = ("subject", "sender_name", "sender_addr", "body_plain")):
        self.emails, self.columns = emails, [c for c in columns if c in emails.columns]

    def matches(self, spark: SparkSession, query: str, scope: str | None = None) -> DataFrame:
        return substring(self.emails.withColumnRenamed("id", "doc_id"), self.columns, query).select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score"))


def substring(docs: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """doc_id of documents that hold the needle in any case; shorter needles than three characters find nothing."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower()))
    return docs.where(cond & F.lit(len(needle) >= 3)).select("doc_id").orderBy("doc_id")


def page(ranked: DataFrame, limit: int = 25, offset: int = 0, key: str = "doc_id") -> DataFrame:
    return ranked.orderBy(F.desc("score"), key).offset(offset).limit(limit)


def _counted(matched: DataFrame, limit: int, offset: int) -> tuple[DataFrame, int]:
    """The page of matches, which is bounded, and how many matches there are: one run of the query gives both."""
    seen = Observation()
    rows = page(matched.observe(seen, F.count("*").alias("n")), limit, offset, "id").collect()
    return matched.sparkSession.createDataFrame(rows, "id long, score double"), seen.get["n"]


def _shown(emails: DataFrame, top: DataFrame, query: str, body: str, stemmed: bool, highlight: bool) -> DataFrame:
    """The page's messages in rank order, with snippets; the page is bounded, so it is sent to the message scan."""
    out = emails.join(F.broadcast(top), "id").orderBy(F.desc("score"), "id")
    return inverted.snippets(out, body, query, stemmed) if highlight and body in emails.columns else out


def search(
    emails: DataFrame, index: inverted.Index, query: str, *, scope: str | None = None, mode: str = "keyword", limit: int = 25, offset: int = 0, highlight: bool = True, body: str = "body_plain",
    substrings: bool = True, embedded: DataFrame | None = None, embed=None, strict_filters: bool = True, **where,
) -> Found:
    """Messages that match. ``where``: see ``filters.predicate``. ``embedded``: vec_id, embedding by message id; ``embed``: query to vector.

    A keyword query without a hit that looks like a part of a word is searched for as a substring. Semantic and hybrid
    search without vectors fall back to keywords and say so. With ``strict_filters`` the filters hold in every mode.
    """
    if mode not in MODES:
        raise InvalidArgument(f"unknown mode {mode!r}")
    if scope is not None and scope not in index.columns:
        raise InvalidArgument(f"unknown scope {scope!r}")
    spark, cond = emails.sparkSession, predicate(**where)
    allowed = emails.where(cond).select("id")
    if mode != "keyword" and (embedded is None or embed is None):
        found = search(emails, index, query, scope=scope, limit=limit, offset=offset, highlight=highlight, body=body, substrings=substrings, **where)
        found.degraded, found.note = True, f"{mode} search needs vectors; keywords were searched"
        return found
    if mode == "semantic":
        near = vectors.knn(_allowed(embedded, allowed, bool(where) and strict_filters), embed(query), offset + limit)
        top = near.select(F.col("vec_id").alias("id"), (1 - F.col("distance")).alias("score"))
        return Found(_shown(emails, page(top, limit, offset, "id"), query, body, index.stemmed, highlight), top.count(), mode)
    words = KeywordBackend(index).matches(spark, query, scope)
    matched = words.join(allowed, "id", "left_semi") if where else words
    if mode == "hybrid":
        best = vectors.ranked(page(matched, FUSED, key="id"), "id", F.desc("score"))
        near = vectors.knn(_allowed(embedded, allowed, bool(where) and strict_filters), embed(query), FUSED).withColumnRenamed("vec_id", "id")
        fused = vectors.fused([best, vectors.ranked(near, "id", F.asc("distance"))], "id")
        return Found(_shown(emails, page(fused.join(emails.select("id"), "id", "left_semi"), limit, offset, "id"), query, body, index.stemmed, highlight), fused.count(), mode)
    top, total = _counted(matched.select("id", "score"), limit, offset)
    if not total and substrings and wants_substring(query):
        backend = TrigramBackend(index) if index.grams else SubstringBackend(emails.where(cond))
        top, total = _counted(backend.matches(spark, query).join(allowed, "id", "left_semi"), limit, offset)
        return Found(_shown(emails, top, query, body, index.stemmed, False), total, "substring")
    return Found(_shown(emails, top, query, body, index.stemmed, highlight), total, mode)


def _allowed(embedded: DataFrame, allowed: DataFrame, filtered: bool) -> DataFrame:
    return embedded.join(allowed.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi") if filtered else embedded
