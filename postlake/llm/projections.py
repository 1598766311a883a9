"""Near-duplicate vectors by collision-counting projections.

TABLES tables or more of some random projections each: all but the last give a vector's cell (a grid of width WIDTH on unit
vectors), the last one is sorted within the cell, and a vector collides with those in a window centred on it. A pair
of cosine ``least`` collides in a table with a probability known from the normal law; ``calibrated`` takes the
largest count of shared cells that such a pair still reaches with probability ``recall``, and ``planned`` adds tables
until there is one. Pairs that reach it, and
whose 8-bit sketches do not rule them out, are verified on the full vectors in double precision, a batch at a time.

Equal vectors (128-bit digests) are compared as one: their smallest vec_id stands for them, and counts of copies make
up ``n_links``, so a group of copies costs one row of each, never its pairs.

Defined results: vectors that are null, zero, hold null or non-finite components link with nothing; vectors of
different lengths do not link; equal vectors link; a null vec_id is left out of comparison and has no links; rows that
repeat a vec_id are vectors of their own; where such an id stands for several different vectors, a link of one counts for all of them.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm import hashing
from postlake.llm.components import components
from postlake.llm.shared import Scratch, written

TABLES, WIDTH, WINDOW = 32, 1.3, 0.9
#: More tables than this are not tried.
MOST_TABLES = 1024


def cell_probability(least: float, dims: int) -> float:
    """Chance that a pair of cosine ``least`` shares a cell and a window in one table."""
    sd = math.sqrt(2 * (1 - least))
    x = WIDTH / sd
    n = NormalDist()
    one = (2 * n.cdf(x) - 1) - 2 / (x * math.sqrt(2 * math.pi)) * (1 - math.exp(-x * x / 2))
    return one ** (dims - 1) * (2 * n.cdf(WINDOW / sd) - 1)


def calibrated(least: float, dims: int, recall: float = 0.98, tables: int = TABLES) -> int:
    """The largest count of tables that a pair of cosine ``least`` shares with probability ``recall``; 0 if there is none."""
    p, below = cell_probability(least, dims), 0.0
    for t in range(tables):
        below += math.comb(tables, t) * p**t * (1 - p) ** (tables - t)
        if below > 1 - recall:
            return t
    return tables


def planned(n: int, least: float, recall: float = 0.98) -> tuple[int, int, int]:
    """Projections a table, tables and shared cells for ``n`` vectors, so that a pair of cosine ``least`` is met with probability ``recall``."""
    dims = max(4, min(9, round(math.log(n) / math.log(10))))
    # The chance to meet in no table is (1 - p) ** tables.
    p = cell_probability(least, dims)
    tables = max(TABLES, math.ceil(math.log(1 - recall) / math.log1p(-p))) if 0 < p < 1 and recall < 1 else TABLES
    need = calibrated(least, dims, recall, tables) if tables <= MOST_TABLES else 0
    if not need:
        raise ValueError(f"no {MOST_TABLES} tables of {dims} projections meet pairs of cosine {least} with probability {recall}")
    return dims, tables, need


def _planes(size: int, dims: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([7, size, dims]))
    return rng.standard_normal((size, tables * dims)).astype(np.float32), rng.uniform(0, WIDTH, tables * dims).astype(np.float32)


def _unit(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    n = np.sqrt((x / max(1e-300, np.abs(x).max())) ** 2 @ np.ones(len(x))) * np.abs(x).max() if np.isfinite(x).all() else 0.0
    return x / n if n > 0 and np.isfinite(n) else None


def _keyed(vectors: DataFrame, dims: int, tables: int) -> DataFrame:
    """A row for each vector and table: tab, cell, at (place on the sorted projection), sketch, cells of all tables."""

    def run(batches):
        for batch in batches:
            by: dict[int, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                u = _unit(v.as_py()) if i is not None else None
                if u is not None:
                    by.setdefault(len(u), []).append((i, u))
            for size, rows in by.items():
                ids, x = np.array([i for i, _ in rows], np.int64), np.stack([u for _, u in rows])
                planes, shift = _planes(size, dims, tables)
                y = (x.astype(np.float32) @ planes).reshape(len(x), tables, dims)
                grid = np.floor((y + shift.reshape(tables, dims)) / WIDTH).astype(np.int64)[:, :, :-1].astype(np.uint64)
                cell = np.full(grid.shape[:2], np.uint64(size))
                for k in range(dims - 1):
                    cell = (cell ^ grid[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                    cell ^= cell >> np.uint64(29)
                scale = 127 / np.abs(x).max(1)
                sketch = np.rint(x * scale[:, None]).astype(np.int8)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(ids), t, np.int32)), pa.array(cell[:, t].astype(np.int64)), pa.array(y[:, t, -1]), pa.array(ids),
                        pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array([r.tobytes() for r in (cell >> np.uint64(56)).astype(np.uint8)], pa.binary()),
                    ], ["tab", "cell", "at", "vec_id", "sketch", "cells"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "tab int, cell long, at float, vec_id long, sketch binary, cells binary")


def _candidates(least: float, need: int, tables: int):
    """Per bucket of cells: pairs in each other's window that share ``need`` cells, in the first table they share."""

    def run(table: pa.Table) -> pa.Table:
        tab, cell, at, ids = (table[c].to_numpy() for c in ("tab", "cell", "at", "vec_id"))
        order = np.lexsort((at, cell, tab))
        tab, cell, at, ids = tab[order], cell[order], at[order], ids[order]
        sketches = [table["sketch"][int(i)].as_py() for i in order]
        cells = np.frombuffer(b"".join(table["cells"][int(i)].as_py() for i in order), np.uint8).reshape(len(order), tables)
        size = np.array([len(s) for s in sketches])
        wide = np.zeros((len(order), size.max() if len(size) else 0), np.float32)
        for k in np.unique(size):
            rows = np.flatnonzero(size == k)
            part = np.frombuffer(b"".join(sketches[i] for i in rows), np.int8).reshape(len(rows), k).astype(np.float32)
            wide[rows, :k] = part / np.linalg.norm(part, axis=1, keepdims=True)
        out_a, out_b, lag, base = [], [], 1, np.arange(len(order))
        while lag < len(order):
            base = base[base + lag < len(order)]
            base = base[(tab[base] == tab[base + lag]) & (cell[base] == cell[base + lag]) & (at[base + lag] - at[base] <= WINDOW)]
            if not len(base):
                break
            for a in np.array_split(base, 1 + len(base) // 50_000):
                b = a + lag
                same = cells[a] == cells[b]
                ok = (same.sum(1) >= need) & (size[a] == size[b])
                a, b = a[ok], b[ok]
                ok = np.einsum("ij,ij->i", wide[a], wide[b]) >= least - 0.03
                out_a.append(ids[a[ok]])
                out_b.append(ids[b[ok]])
            lag += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def links(vectors: DataFrame, least: float = 0.9, recall: float = 0.98) -> DataFrame:
    """a, b: verified pairs, each once."""
    n = max(2, vectors.count())
    dims, tables, need = planned(n, least, recall)
    keyed = _keyed(vectors, dims, tables)
    buckets = 64
    while buckets * 20_000 < n * tables:
        buckets *= 2
    # One row a pair already within its bucket's tables; the same pair of another table falls away in distinct().
    pairs = keyed.withColumn("bucket", F.pmod(F.xxhash64("tab", "cell"), F.lit(buckets))).groupBy("bucket").applyInArrow(_candidates(least, need, tables), "a long, b long").where("a <> b").distinct()

    def check(batches):
        for batch in batches:
            ok = _cosines(batch.column("ea"), batch.column("eb")) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: vectors.select(F.col("vec_id").alias(x), F.col("embedding").alias(f"e{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb").mapInArrow(check, "a long, b long").distinct()


def _cosines(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Row by row, in double precision; the vectors are valid and those of a pair equally long."""
    out, size = np.zeros(len(x)), x.value_lengths().to_numpy()
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        u, v = (c.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), k) for c in (x, y))
        u, v = (w / np.abs(w).max(1, keepdims=True) for w in (u, v))
        out[rows] = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
    return out


def _digested(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding; ka, kb: a digest of the vector, null where it links with nothing."""

    def run(batches):
        for batch in batches:
            keys = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.as_py() if i is not None else None
                keys.append(None if _unit(x) is None else np.frombuffer(hashing.digest((np.array(x, np.float64) + 0.0).tobytes()), np.int64))
            cols = [pa.array([None if k is None else int(k[j]) for k in keys], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["vec_id", "embedding", "ka", "kb"])

    sent = vectors.select("vec_id", "embedding")
    return sent.mapInArrow(run, T.StructType([*sent.schema.fields, *T.StructType.fromDDL("ka long, kb long")]))


def near(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    with Scratch(vectors.sparkSession) as s:
        every = s.written(_digested(vectors), "vectors")
        groups = s.written(every.where("ka is not null").groupBy("ka", "kb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "groups")
        reps = s.written(every.join(groups, ["ka", "kb"]).where("vec_id = rep").dropDuplicates(["ka", "kb"]).select("vec_id", "embedding"), "reps")
        found = s.written(links(reps, least), "pairs")
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        copies = groups.groupBy("rep").agg(F.sum("copies").alias("copies"))
        degree = both.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
        of = components(found, "a", "b", s.folder).select(F.col("node").alias("rep"), "component")
        per = groups.join(degree, "rep", "left").join(of, "rep", "left")
        out = every.select("vec_id", "ka", "kb").join(per, ["ka", "kb"], "left")
        root = F.coalesce("component", "rep", "vec_id")
        n = F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
        return written(out.select("vec_id", n.cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept")), "links")
