"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and verification.

An element of weight w sends arrivals of a Poisson process of rate w; each arrival falls on one of M slots, and a
slot keeps the element that arrived first. Two documents agree in a slot with the probability Jaccard similarity of
their weights. Elements are followed only up to a time horizon; once every slot of a document is filled no later
arrival can matter, so nearly all elements are left after a few arrivals. All documents of a chunk go at once.

Shingles are SHINGLE consecutive words, unchanged (fewer where a text is shorter), of weight 1 + ln(count). A link
is a probability Jaccard similarity of at least ``least`` over these weights, computed from the whole weighted sets;
signatures estimate the same measure. A pair at 0.8 shares one of the BANDS bands with probability 0.997.

Documents with equal word sequences (128-bit digests) are one class from the start and enter as their smallest
doc_id. Each band group is first compared with its smallest member; then members of different classes, which two bits a
slot of both do not rule out (SPREAD standard errors below ``least``; 3 in 100,000 pairs at ``least`` are), are verified
in blocks: sketches first, then the sets of those left, where one set meets many in a few array operations that give
the similarity, or no less than it where weights differ. So a group is not expanded into rows of pairs, and pairs
within a class need no comparison. A text of any length enters whole; its set is held in one block with others.

Defined results: a text that is null or has no word is a class of its own; ties keep the smallest doc_id; a null
doc_id is left out of comparison and kept; rows that repeat a doc_id are documents of their own, whose first row (in
no set order) stands first; further columns are not read by ``classes`` and stay as they are in ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import hashing
from postlake.llm.components import components
from postlake.llm.shared import Scratch, numbered, written

SHINGLE, M, BANDS, ROWS, SPREAD = 5, 512, 51, 10, 4
#: Members of a group whose sketches are compared with as many others in one place.
BLOCK = 4096
#: Bytes of sets that are compared with as many others in one place (a longer set comes whole).
BYTES = 8 << 20
#: So many ids (8 bytes each) are sent to all tasks at most; above it the join shuffles.
SENT = 1_000_000
_U = np.uint64
#: Longs that hold two bits of each slot.
_BITS = tuple(f"b{k}" for k in range(M // 32))


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The M first-arrived elements of each weighted set elements[first[i]:first[i + 1]]; no set is empty."""
    n, size = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n), size)
    best, owner = np.full(n * M, np.inf), np.zeros(n * M, np.uint64)
    state, time = hashing.mix(elements + _U(0x632BE59BD9B4E019)), np.zeros(len(elements))
    horizon = M * (np.log(M) + 0.6) / np.add.reduceat(weights, first[:-1]) if n else np.zeros(0)

    def arrive(who: np.ndarray) -> None:
        state[who] = now = hashing.mix(state[who] + _U(0x9E3779B97F4A7C15))
        time[who] -= np.log(((now >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[who]

    alive, waiting = np.arange(len(elements)), []
    arrive(alive)
    while n:
        late = time[alive] > horizon[doc[alive]]
        waiting.append(alive[late])
        alive = alive[~late]
        if len(alive):
            slot = doc[alive] * M + (hashing.mix(state[alive] ^ _U(0xD1B54A32D192ED03)) & _U(M - 1)).astype(np.int64)
            at = time[alive]
            np.minimum.at(best, slot, at)
            won = best[slot] == at
            owner[slot[won]] = elements[alive[won]]
            arrive(alive)
            continue
        short = best.reshape(n, M).max(1) > horizon
        if not short.any():
            break
        alive, waiting = np.concatenate(waiting), []
        alive = alive[short[doc[alive]]]
        horizon[short] *= 1.3
    return owner.reshape(n, M)


def weight(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def probability_jaccard(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray) -> float:
    """Of two weighted sets, elements in order: the sum over shared i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if xw.max() == xw.min() and yw.max() == yw.min():
        return len(both) / (len(x) + len(y) - len(both))
    # By rising y_j / x_j: up to the ratio of i, x_j decides; beyond it y_j does.
    a, b = xw[i], yw[j]
    ratio = b / a
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    only_x, only_y = xw.sum() - a.sum(), yw.sum() - b.sum()
    upto = np.cumsum(a) + only_x
    beyond = b.sum() - np.cumsum(b) + only_y
    return float((a / (upto + beyond / ratio)).sum())


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes in order, counts) of each text."""
    start, end, first = hashing.words(buf, off)
    h = hashing.word_hashes(buf, start, end)
    grams = hashing.windows(h, SHINGLE)
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1], return_counts=True)
        elif b > a:
            yield hashing.windows(h[a:b], int(b - a)), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


SKETCH = "doc_id long, wa long, wb long, " + ", ".join(f"{c} long" for c in _BITS) + ", bands array<long>"


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id; wa, wb: digest of the word sequence (null without a word); two bits of each slot; a key for each band."""

    def run(batches):
        for batch in batches:
            for a, b, buf, off in hashing.texts(batch, most=1 << 20, rows=1024):
                sets = [*shingle_sets(buf, off)]
                some = np.array([len(e) > 0 for e, _ in sets])
                first = np.concatenate(([0], np.cumsum([len(e) for e, _ in sets if len(e)]))).astype(np.int64)
                full = np.flatnonzero(some)
                own = signatures(np.concatenate([e for e, _ in sets]), weight(np.concatenate([c for _, c in sets])), first) if len(full) else np.zeros((0, M), np.uint64)
                whole = np.frombuffer(b"".join(hashing.digest(b" ".join(buf[off[i] : off[i + 1]].tobytes().split())) for i in full.tolist()), np.int64).reshape(len(full), 2)
                two = (hashing.mix(own) & _U(3)).astype(np.uint8)
                bits = np.ascontiguousarray(two[:, ::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6).view(np.int64)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
                for k in range(ROWS):
                    keys = hashing.join(keys, own[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS)[:, :, k])
                place = np.cumsum(some) - 1
                at = pa.array(place, mask=~some)
                spread = lambda x: pa.array(np.ascontiguousarray(x)).take(at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.astype(np.int64).ravel())).take(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), spread(whole[:, 0]), spread(whole[:, 1]), *(spread(bits[:, k]) for k in range(len(_BITS))), lists], [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def _leave_possible(x: str, y: str, least: float) -> F.Column:
    """Whether two bits a slot of two signatures differ in no more slots than a pair of ``least`` would, and SPREAD standard errors."""
    p, apart = (1 - least) * 3 / 4, F.lit(0)
    for c in _BITS:
        other = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        other = other.bitwiseOR(F.shiftrightunsigned(other, 1))
        apart = apart + F.bit_count(other.bitwiseAND(F.lit(0x5555555555555555)))
    return apart <= int(M * p + SPREAD * (M * p * (1 - p)) ** 0.5)


def _weighted(blob: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    x, w = np.frombuffer(blob, np.uint64), np.ones(len(blob) // 8)
    at, n = np.frombuffer(many, "<i8").reshape(2, -1)
    w[at] = weight(n)
    return x, w


class Held:
    """Weighted sets of one block, none empty, over which one set is compared with many at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets, self.size = sets, np.array([len(x) for x, _ in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.weights = np.concatenate([w for _, w in sets])
        names, self.ids = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
        self.total, self.most = np.add.reduceat(self.weights, self.first), np.maximum.reduceat(self.weights, self.first)
        self.mine = np.zeros(len(names))

    def bound(self, i: int, others: np.ndarray) -> np.ndarray:
        """At least the probability Jaccard similarity of set i to each of the others, and just that where no weight is above 1.

        The sum over j of max(x_j / x_i, y_j / y_i) is no less than all of x over x_i and what is in y alone over y_i,
        and x_i / y_i is no less than 1 over the greatest weight of y.
        """
        own = slice(self.first[i], self.first[i] + self.size[i])
        self.mine[self.ids[own]] = self.weights[own]
        at, cut = hashing.ranges(self.first[others], self.size[others]), np.cumsum(self.size[others]) - self.size[others]
        x = self.mine[self.ids[at]]
        both_x, both_y = np.add.reduceat(x, cut), np.add.reduceat(np.where(x > 0, self.weights[at], 0.0), cut)
        self.mine[self.ids[own]] = 0
        only_x, only_y = self.total[i] - both_x, self.total[others] - both_y
        return np.minimum(both_x / (self.total[i] + only_y / self.most[others]), both_y / (self.total[others] + only_x / self.most[i]))

    def linked(self, i: int, j: int, bound: float, least: float) -> bool:
        plain = self.most[i] == self.most[j] == 1
        return (bound if plain else probability_jaccard(*self.sets[i], *self.sets[j])) >= least - 1e-9


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id; n: shingles; set: their hashes in order; many: places and counts of those that occur more than once; of the texts of ``ids``."""

    def run(batches):
        for batch in batches:
            for a, b, buf, off in hashing.texts(batch):
                found = [*shingle_sets(buf, off)]
                many = [np.flatnonzero(c > 1) for _, c in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(e) for e, _ in found], pa.int64()), pa.array([e.tobytes() for e, _ in found], pa.binary()),
                    pa.array([np.stack([m, c[m]]).astype("<i8").tobytes() for m, (_, c) in zip(many, found)], pa.binary()),
                ], ["doc_id", "n", "set", "many"])

    # Texts stay where they are unless the ids are too many to be sent.
    sent = F.broadcast(ids) if ids.count() <= SENT else ids
    return docs.select("doc_id", "text").join(sent, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, set binary, many binary")


def _parts(units: int, each: int) -> int:
    n = 64
    while n * each < units:
        n *= 2
    return n


def _runs(rows: pa.Table, *names: str):
    """Row ranges of a sorted table in which the named columns do not change."""
    cols = [rows[c].to_numpy() for c in names]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new).tolist()
    return zip(first, [*first[1:], len(rows)])


def _held(rows: pa.Table) -> Held:
    return Held([_weighted(x, m) for x, m in zip(rows["set"].to_pylist(), rows["many"].to_pylist())])


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _starred(stars: DataFrame, docs: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Those pairs of a centre a and a member b that link.

    The members of a centre are dealt in blocks of about BYTES of sets; each block gets the centre's set once.
    """
    needed = scratch.written(stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct(), "needed")
    of = scratch.written(_sets(docs, needed), "sets")
    blocks = scratch.written(stars.join(of.select(F.col("doc_id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("n")), "blocks")
    parts = _parts(8 * (blocks.agg(F.sum("n")).first()[0] or 0), BYTES)
    dealt = stars.join(blocks.select("a", F.ceil(F.col("n") * 8 / BYTES).cast("int").alias("blocks")), "a")
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("doc_id"))
    centres = dealt.select("a", "block").distinct().withColumn("doc_id", F.col("a"))

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.sort_by([("a", "ascending"), ("block", "ascending"), ("doc_id", "ascending")]), []
        for x, y in _runs(rows, "a", "block"):
            unit = rows.slice(x, y - x)
            centre, ids, held = unit["a"][0].as_py(), unit["doc_id"].to_numpy(), _held(unit)
            c = int(np.flatnonzero(ids == centre)[0])
            others = np.flatnonzero(ids != centre)
            bound = held.bound(c, others)
            out += [(centre, int(ids[j])) for j, m in zip(others.tolist(), bound) if m >= least - 1e-6 and held.linked(c, j, m, least)]
        return _pairs(out)

    whole = dealt.unionByName(centres).join(of, "doc_id")
    return whole.withColumn("part", F.pmod(F.xxhash64("a", "block"), F.lit(parts))).groupBy("part").applyInArrow(run, "a long, b long")


def _met(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of groups (key), dealt in as many blocks as ``blocks`` (key, blocks) says: own, and lo, hi for each two blocks that meet."""
    own = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")


_ORDER = [(c, "ascending") for c in ("key", "lo", "hi", "cls", "doc_id")]


def _bits_of(rows: pa.Table) -> np.ndarray:
    cols = rows["bits"].combine_chunks().flatten() if len(rows) else []
    return np.stack([c.to_numpy(zero_copy_only=False) for c in cols], 1).view(np.uint64) if len(rows) else np.zeros((0, len(_BITS)), np.uint64)


def _later(i: int, bits: np.ndarray, cls: np.ndarray, own: np.ndarray, alone: bool, most: int, skip: np.ndarray | None = None) -> np.ndarray:
    """The rows after i, of other classes (and blocks, where two meet), whose sketches leave a link possible."""
    ok = (cls[i + 1 :] != cls[i]) & (alone | (own[i + 1 :] != own[i]))
    if skip is not None:
        ok &= ~skip[cls[i + 1 :]]
    j = i + 1 + np.flatnonzero(ok)
    apart = bits[j] ^ bits[i]
    return j[np.bitwise_count((apart | apart >> _U(1)) & _U(0x5555555555555555)).sum(1, dtype=np.int64) <= most]


def _possible(mixed: DataFrame, most: int) -> DataFrame:
    """The rows of ``mixed`` with a possible partner of another class in their group; only sketches travel."""
    blocks = mixed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = _met(mixed, blocks)
    schema = mixed.schema

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(_ORDER)
        bits, cls, own, some = _bits_of(rows), rows["cls"].to_numpy(), rows["own"].to_numpy(), np.zeros(len(rows), bool)
        lo, hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
        for x, y in _runs(rows, "key", "lo", "hi"):
            for i in range(y - x - 1):
                j = _later(i, bits[x:y], cls[x:y], own[x:y], lo[x] == hi[x], most)
                some[x + j] = True
                some[x + i] |= len(j) > 0
        return rows.select(schema.names).filter(pa.array(some))

    parts = _parts(dealt.count(), 2 * BLOCK)
    met = dealt.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts))).groupBy("part").applyInArrow(run, schema)
    return met.dropDuplicates(["key", "doc_id"])


def _across(mixed: DataFrame, docs: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """a, b: links between members of one group (key, doc_id, cls, bits) that are of different classes, one at least for each two classes that have any.

    Groups are dealt in blocks, and each two blocks are compared in one place, so no group is held whole and only links
    are written. Members without a possible partner go first, by sketches alone; the others' blocks hold about BYTES of sets.
    """
    p = (1 - least) * 3 / 4
    most = int(M * p + SPREAD * (M * p * (1 - p)) ** 0.5)
    left = scratch.written(_possible(mixed, most), "left")
    of = scratch.written(_sets(docs, scratch.written(left.select("doc_id").distinct(), "needed")), "sets")
    sized = left.join(of.select("doc_id", "n"), "doc_id").groupBy("key").agg(F.sum("n").alias("n"))
    blocks = scratch.written(sized.withColumn("blocks", F.ceil(F.col("n") * 8 / BYTES).cast("int")), "blocks")
    parts = _parts(8 * (blocks.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0), BYTES)

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.sort_by(_ORDER), []
        for x, y in _runs(rows, "key", "lo", "hi"):
            unit = rows.slice(x, y - x)
            bits, ids, held, own = _bits_of(unit), unit["doc_id"].to_numpy(), _held(unit), unit["own"].to_numpy()
            names, cls = np.unique(unit["cls"].to_numpy(), return_inverse=True)
            alone, linked = unit["lo"][0] == unit["hi"][0], np.zeros(len(names), bool)
            for i in range(y - x - 1):
                if i and cls[i] != cls[i - 1]:
                    linked[:] = False
                j = _later(i, bits, cls, own, alone, most, linked)
                if not len(j):
                    continue
                bound = held.bound(i, j)
                for k in np.flatnonzero(bound >= least - 1e-6).tolist():
                    other = int(j[k])
                    if not linked[cls[other]] and held.linked(i, other, bound[k], least):
                        linked[cls[other]] = True
                        out.append((min(int(ids[i]), int(ids[other])), max(int(ids[i]), int(ids[other]))))
        return _pairs(out)

    dealt = _met(left, blocks.select("key", "blocks")).join(of, "doc_id")
    return dealt.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts))).groupBy("part").applyInArrow(run, "a long, b long").distinct()


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, class_id, exact_id, kept, where no doc_id is repeated."""
    with Scratch(docs.sparkSession) as s:
        sketch = s.written(_sketched(docs), "sketch")
        known = sketch.where("wa is not null and doc_id is not null")
        exact = known.groupBy("wa", "wb").agg(F.min("doc_id").alias("exact_id"))
        reps = s.written(known.join(exact.withColumnRenamed("exact_id", "doc_id"), ["wa", "wb", "doc_id"]).select("doc_id", F.struct(*_BITS).alias("bits"), "bands"), "reps")
        bands = reps.select("doc_id", F.explode("bands").alias("key"))
        groups = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("c")).where("n > 1").select("key", "c")
        member = s.written(bands.join(groups, "key"), "members")
        bits = reps.select("doc_id", "bits")
        with_bits = lambda df, x: df.join(bits.select(F.col("doc_id").alias(x), F.col("bits").alias(f"bits_{x}")), x)
        stars = s.written(member.where("doc_id <> c").select(F.col("c").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
        near = s.written(with_bits(with_bits(stars, "a"), "b").where(_leave_possible("bits_a", "bits_b", least)).select("a", "b"), "near")
        links = s.written(_starred(near, docs, least, s), "links")
        found = s.written(components(links, "a", "b", s.folder), "found")
        # Groups that still hold several classes are compared across classes.
        placed = member.select("key", "doc_id").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("cls"))
        mixed = placed.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
        held = s.written(placed.join(mixed, "key").join(bits, "doc_id"), "mixed")
        across = s.written(_across(held, docs, least, s), "across")
        if across.limit(1).count():
            found = s.written(components(links.unionByName(across), "a", "b", s.folder), "found")
        per = exact.join(found.select(F.col("node").alias("exact_id"), "component"), "exact_id", "left")
        out = sketch.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("wa")).alias("wa"), "wb").join(per, ["wa", "wb"], "left")
        class_id = F.coalesce("component", "exact_id", "doc_id")
        return written(out.select("doc_id", class_id.alias("class_id"), F.coalesce("exact_id", "doc_id").alias("exact_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept")), "classes")


def _numbered(docs: DataFrame) -> DataFrame | None:
    """Rows with numbers in the order of doc_id (none where that is null), if a doc_id is repeated; else None."""
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return None
    return numbered(docs).withColumn("at", F.when(F.col("row.doc_id").isNotNull(), F.col("at")))


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), exact_id (smallest doc_id with the same words), kept (one row of each class)."""
    rows = _numbered(docs.select("doc_id", "text"))
    if rows is None:
        return _classes(docs, least)
    found = _classes(rows.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), least).where("doc_id is not null").withColumnRenamed("doc_id", "at")
    of = rows.select("at", F.col("row.doc_id").alias("doc_id"))
    name = lambda c: of.where("at is not null").select(F.col("at").alias(c), F.col("doc_id").alias(f"{c}_name"))
    out = of.join(found, "at", "left").join(name("class_id"), "class_id", "left").join(name("exact_id"), "exact_id", "left")
    return out.select("doc_id", F.col("class_id_name").alias("class_id"), F.col("exact_id_name").alias("exact_id"), F.coalesce("kept", F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One document of each class, with all columns. Rows that repeat a doc_id are documents of their own; rows without one stay."""
    rows = _numbered(docs)
    if rows is not None:
        gone = _classes(rows.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), least).where("not kept").select(F.col("doc_id").alias("at"))
        return rows.join(gone, "at", "left_anti").select("row.*")
    gone = _classes(docs, least).where("not kept").select("doc_id")
    return docs.join(F.broadcast(gone) if gone.count() <= SENT else gone, "doc_id", "left_anti")
