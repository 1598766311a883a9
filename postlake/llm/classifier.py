"""Quality by hierarchical empirical Bayes: document evidence, host and path posteriors, shrunk towards the corpus.

1. A naive Bayes model per label (quality, toxic) over the presence of words and over shares: of words that hold a kind
   of character, of repeated 3-word windows, of repeated lines; all of whole texts. It is fitted on at most ``fit_rows``
   labelled documents (chosen by a hash of doc_id), with features that differ clearly between the classes, at most
   ``max_features`` a label. Features that go together are counted again and again, so sums are set to scale by a
   logistic curve on rows that did not give the weights: each half of the sample is summed by the other half's weights.
2. Every document's evidence is a log likelihood ratio. Grouped sums of the resulting probabilities give each host
   (``source``) and path (host and ``lang``) a mean; a host's posterior is its mean shrunk to the corpus mean by a
   prior strength estimated from the spread of the hosts, a path's is shrunk to its host's likewise. Sparse sites so
   stay near their parents.
3. The verdict adds the evidence to the log odds of the path's posterior, from which the document's own share is left
   out, as its evidence is added already.

Defined results: a null or empty text has no evidence and gets its path's posterior; a null source or lang counts as
`?`; without labels every probability is one half and all rows are kept; ties and equal texts at one path get equal
verdicts; rows of one doc_id have verdicts of their own, and the smallest text stands for them in the fit; other
columns are kept by ``keep`` and not read otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.shared import Scratch, numbered, plain_ids, written

LABELS = "quality", "toxic"
SITE = "host", "path"
#: Beside these, a sign within a word is a symbol.
_PUNCTUATION = frozenset(".,;:!?'\"()-")
_EDGE = re.compile(r"^\W+|\W+$")
#: Distinct words that are looked up rather than taken apart again.
_CACHED = 60_000


@functools.lru_cache(_CACHED)
def parts(word: str) -> tuple[str, tuple[str, ...]]:
    """A word in lower case without its edges (a digest of it if it is long), and the kinds of characters in it."""
    signs = {c for c in word if not c.isalnum()}
    kinds = {f"has {c}" for c in signs}
    if signs - _PUNCTUATION:
        kinds.add("symbol")
    if word.isupper() and sum(map(str.isalpha, word)) > 1:
        kinds.add("upper")
    if any(map(str.isdigit, word)):
        kinds.add("digit")
    bare = _EDGE.sub("", word).lower()
    return bare if len(bare) <= 64 else hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), tuple(kinds)


def features(text: str) -> set[str]:
    """Words present, and for each share all powers of one half that it reaches."""
    words = text.split()
    total = len(words)
    found, shares = set(), Counter()
    for w, k in Counter(words).items():
        word, kinds = parts(w) if len(w) <= 64 else parts.__wrapped__(w)
        found.add(f"w{word}")
        for kind in kinds:
            shares[kind] += k / total
    if total >= 20:
        shares["again"] = 1 - len(set(zip(words, words[1:], words[2:]))) / (total - 2)
        lines = [x for x in text.split("\n") if not x.isspace() and x]
        shares["lines again"] = 1 - len(set(lines)) / max(1, len(lines))
    for kind, share in shares.items():
        found.update(f"s{kind}:{k}" for k in range(1, 7) if share >= 2.0**-k)
    return found


def _texts(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, text, quality, toxic, half of the sample: ``fit_rows`` rows at most, however often an id is repeated."""
    sample = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(x).alias(x) for x in LABELS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", *LABELS).agg(F.min("text").alias("text")).withColumn("half", F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(2)).cast("int"))


_COUNTS = tuple(f"{x}{y}" for x in ("q1", "q0", "t1", "t0") for y in "ab")


def _counted(rows: DataFrame) -> DataFrame:
    """f and how many documents of each class and half have it; the empty feature counts documents."""

    def run(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            q, t, h = (batch.column(c).to_pylist() for c in (*LABELS, "half"))
            for i, text in enumerate(batch.column("text")):
                at = [base + h[i] for value, base in ((q[i], 0), (t[i], 4)) if value is not None for base in [base + (0 if value else 2)]]
                for f in features(text.as_py()) | {""}:
                    n = found.setdefault(f, [0] * 8)
                    for k in at:
                        n[k] += 1
            cols = [*zip(*([k, *v] for k, v in found.items()), strict=True)] or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] + [pa.int64()] * 8)], ["f", *_COUNTS])

    return rows.mapInArrow(run, "f string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("f").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _weights(counted: DataFrame, total: dict, ones: list[str], zeros: list[str], max_features: int, least: int, z: float) -> dict[str, float]:
    """Log likelihood ratios of the features that differ clearly; ``max_features`` rows at most come to the driver."""
    n1, n0 = sum(total[c] for c in ones), sum(total[c] for c in zeros)
    if not n1 or not n0:
        return {}
    x1, x0, n = sum((F.col(c) for c in ones), F.lit(0)), sum((F.col(c) for c in zeros), F.lit(0)), n1 + n0
    # Signed root of the chi-squared statistic.
    apart = F.abs(x1 * (n0 - x0) - x0 * (n1 - x1)) * math.sqrt(n) / F.sqrt(F.greatest(F.lit(1.0), (x1 + x0) * (n - x1 - x0) * float(n1) * n0))
    ratio = F.log((x1 + 0.5) / (n1 + 1) / ((x0 + 0.5) / (n0 + 1)))
    chosen = counted.where((F.col("f") != "") & (x1 + x0 >= least)).select("f", ratio.alias("on"), apart.alias("z")).where(F.col("z") >= z).orderBy(F.desc("z"), "f").limit(max_features).collect()
    # Presence only: what a short text lacks says nothing about it.
    return {r["f"]: r["on"] for r in chosen}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, max_features: int = 20_000, least: int = 4, z: float = 4.5) -> dict:
    """Per label: features' weights when present, the prior, and the scale of their sums."""
    with Scratch(docs.sparkSession) as s:
        rows = s.written(_texts(docs, labels, fit_rows), "sample")
        counted = s.written(_counted(rows), "features")
        first = counted.where("f = ''").first()
        total = first.asDict() if first else dict.fromkeys(_COUNTS, 0)
        model, halves = {}, ({}, {})
        for x in LABELS:
            ones, zeros = [f"{x[0]}1a", f"{x[0]}1b"], [f"{x[0]}0a", f"{x[0]}0b"]
            n1, n0 = sum(total[c] for c in ones), sum(total[c] for c in zeros)
            model[x] = {"prior": n1 / (n1 + n0) if n1 and n0 else 0.5, "weights": _weights(counted, total, ones, zeros, max_features, least, z)}
            for k in (0, 1):  # the weights that judge half k come from the other one
                halves[k][x] = {"weights": _weights(counted, total, ones[1 - k : 2 - k], zeros[1 - k : 2 - k], max_features, least, z)}
        if any(model[x]["weights"] for x in LABELS):
            # At most fit_rows rows of numbers.
            raw = [r for k in (0, 1) for r in rows.where(F.col("half") == k).select(*LABELS, _evidence(halves[k])("text").alias("e")).collect()]
            for x in LABELS:
                if model[x]["weights"]:
                    pairs = [(r["e"][x], r[x]) for r in raw if r[x] is not None]
                    a, b = scaled(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]) > 0)
                    model[x] |= {"scale": a, "shift": b - math.log(model[x]["prior"] / (1 - model[x]["prior"]))}
        return model


def scaled(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the sums, by Newton steps on targets held off 0 and 1."""
    n1, n0 = int(y.sum()), int((~y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([s, np.ones(len(s))], 1)
    w, ridge = np.array([0.0, math.log(n1 / n0)]), np.array([1e-3, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-6 * np.eye(2), x.T @ (t - p) - ridge * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(w[0])), float(w[1])


def _evidence(model: dict):
    """A text's log likelihood ratio for each label, as a struct; only the text goes to Python, other columns stay in the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        out = {x: [] for x in LABELS}
        for text in texts:
            found = features(text.as_py()) if text.as_py() else None
            for x in LABELS:
                m = model[x]
                s = sum(map(m["weights"].get, sorted(found & m["weights"].keys()))) if found else 0.0
                out[x].append(s * m.get("scale", 1.0) + (m.get("shift", 0.0) if found else 0.0))
        return pa.StructArray.from_arrays([pa.array(out[x], pa.float64()) for x in LABELS], names=LABELS)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "quality double, toxic double")


def _site(host: Column, path: Column) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("?")).alias(name) for c, name in ((host, "host"), (path, "path"))]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _probability(x: str, model: dict) -> Column:
    return 1 / (1 + F.exp(-(F.col(x) + math.log(model[x]["prior"] / (1 - model[x]["prior"])))))


def _strength(groups: DataFrame, n: str, s: str) -> DataFrame:
    """One row, mean and strength, by moments: between-site variance beyond what the sites' sizes explain gives the prior's strength."""
    total = groups.agg(F.sum(s).alias("S"), F.sum(n).alias("N"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("Q"), F.count("*").alias("g"), F.sum(F.col(n) * F.col(n)).alias("N2"))
    mean = F.col("S") / F.col("N")
    v = mean * (1 - mean)
    between = (F.col("Q") - F.col("N") * mean * mean - (F.col("g") - 1) * v) / F.greatest(F.col("N") - F.col("N2") / F.col("N"), F.lit(1.0))
    return total.select(mean.alias("mean"), F.when(between > 0, F.greatest(F.lit(1.0), v / between - 1)).otherwise(F.lit(1e6)).alias("strength"))


def sites(scored: DataFrame, model: dict) -> DataFrame:
    """host, path and, for each label, what a document's prior needs: counts and sums of its path and host, and the shrinking."""
    sums = [F.sum(_probability(x, model)).alias(f"{x}_s") for x in LABELS]
    paths = scored.groupBy(*SITE).agg(F.count("*").alias("n"), *sums)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"{x}_s").alias(f"{x}_host_s") for x in LABELS))
    out = paths.join(hosts, "host")
    for x in LABELS:  # one row each, not a cross join of data
        out = out.crossJoin(F.broadcast(_strength(hosts, "host_n", f"{x}_host_s").select(F.col("mean").alias(f"{x}_mean"), F.col("strength").alias(f"{x}_host_k"))))
        out = out.crossJoin(F.broadcast(_strength(paths, "n", f"{x}_s").select(F.col("strength").alias(f"{x}_k"))))
    return out


def _prior(x: str, model: dict) -> Column:
    """The posterior mean of a document's path without the document: path sums shrunk to the host's, these to the corpus."""
    own = _probability(x, model)
    host = (F.col(f"{x}_host_s") - own + F.col(f"{x}_host_k") * F.col(f"{x}_mean")) / (F.col("host_n") - 1 + F.col(f"{x}_host_k"))
    path = (F.col(f"{x}_s") - own + F.col(f"{x}_k") * host) / (F.col("n") - 1 + F.col(f"{x}_k"))
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), path))


def score(docs: DataFrame, model: dict, host: Column | None = None, path: Column | None = None, small: int = 200_000, least_quality: float = 0.4, most_toxic: float = 0.6) -> DataFrame:
    """doc_id, host, path, p_quality, p_toxic, kept of every row."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))) if path is None else path
    with Scratch(docs.sparkSession) as s:
        found = docs.select("doc_id", *_site(host, path), _evidence(model)("text").alias("e"))
        scored = s.written(found.select("doc_id", *SITE, *(F.col(f"e.{x}").alias(x) for x in LABELS)), "scored")
        by = s.written(sites(scored, model), "sites")
        # A table of sites is sent to all tasks only when counted and small; else it is joined by salted keys.
        if by.count() <= small:
            joined = scored.join(F.broadcast(by), [*SITE])
        else:
            salts = 64
            spread = by.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            joined = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", *LABELS), F.lit(salts)).cast("int")).join(spread, ["salt", *SITE])
        p = {x: 1 / (1 + F.exp(-(F.col(x) + _logit(_prior(x, model))))) for x in LABELS}
        if not any(model[x]["weights"] for x in LABELS):
            p = dict.fromkeys(LABELS, F.lit(0.5))
        out = joined.select("doc_id", *SITE, *(p[x].alias(f"p_{x}") for x in LABELS))
        return written(out.withColumn("kept", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") <= most_toxic)), "verdicts")


def judge(docs: DataFrame, labels: DataFrame, fitted: dict | None = None, **options) -> DataFrame:
    """doc_id, host, path, p_quality, p_toxic, kept. Rejected: likely low quality, or likely toxic."""
    return score(docs, fit(docs, labels, **(fitted or {})), **options)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all columns. Each row has its own verdict, whatever its doc_id."""
    model = fit(docs, labels)
    if plain_ids(docs):
        gone = score(docs, model, **options).where("not kept").select("doc_id")
        return docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, "doc_id", "left_anti")
    rows = numbered(docs)
    gone = score(rows.select(F.col("at").alias("doc_id"), "row.text", "row.source", "row.lang"), model, **options).where("not kept").select(F.col("doc_id").alias("at"))
    return rows.join(gone, "at", "left_anti").select("row.*")
