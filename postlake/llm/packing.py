"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function lower bounds.

Pieces are dealt by a hash to partitions small enough for one task. Each partition packs best-fit decreasing and
compares its bin count with a lower bound that dual feasible functions give for its lengths: no packing of these
pieces can be better. While the bins of all partitions exceed the bound over all lengths, each partition gives up its
emptiest bin, and those beyond its own bound; their documents are exchanged, i.e. dealt anew among far fewer
partitions, and packed again best-fit decreasing. An exchange that saves no bin is not used and ends the work, so
rounds follow from the data. Only rows of pieces travel, never texts.

Defined results: a null text is an empty one, and as every document ends with the end id it gives one piece of
length 1; equal texts are packed separately; an empty table gives no rows; a text of any length is cut, not dropped;
rows whose doc_id is null or repeated are texts of their own, each piece in one place.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from postlake.llm import bpe, hashing
from postlake.llm.shared import Scratch, written

#: Texts are encoded together up to so many bytes; a longer one goes alone, piece by piece.
TOGETHER = 2 << 20


class Recent(dict):
    """What ``make`` gives for a key; a full table becomes the older one, which keeps what is asked for again until the next is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= bpe.RUN:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Little-endian ids of white-space runs: many runs are normalised and cut into words at once, and words merged by the tokenizers library; up to twice ``most`` words are kept."""

    #: Stands between runs; no id.
    BREAK = 0xFFFFFFFF

    def __init__(self, path: str, most: int = 100_000):
        self.bpe = bpe.loaded(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = {"normalizer", "pre_tokenizer", "post_processor", "decoder", "truncation", "padding"}
        self.model = Tokenizer.from_str(json.dumps(spec | dict.fromkeys(bare) | {"added_tokens": []})).model
        self.words = Recent(self._word, most)
        self.pretoken = regex.compile(rf"\n|{self.bpe.pretoken.pattern}")

    def _word(self, word: str) -> bytes:
        if word == "\n":
            ids = [self.BREAK]
        elif len(word) > bpe.RUN:
            ids = self.bpe.word_ids[word]
        else:
            # Printable ASCII stands for itself in the byte alphabet.
            plain = word.isascii() and word.isalnum()
            ids = [t.id for t in self.model.tokenize(word if plain else "".join(self.bpe.symbols(word)))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _lines(self, runs: str) -> np.ndarray:
        """Ids of runs that each end with a line feed, a BREAK after each: neither normal form nor words reach across one."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.pretoken.findall(self.bpe.normal(runs)))), "<u4")

    def of(self, runs: list[str]) -> bytes:
        """Little-endian ids of runs in a row."""
        ids = self._lines("".join(f"{x}\n" for x in runs))
        return ids[ids != self.BREAK].tobytes()

    def together(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without a null and with white space as the only cuts, and where each text ends; each distinct run is encoded once."""
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        names = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        ids = self._lines(pc.binary_join(names, "\n")[0].as_py() + "\n" * bool(len(coded.dictionary)))
        end = np.flatnonzero(ids == self.BREAK)
        first = np.concatenate(([0], end[:-1] + 1))[: len(end)]
        code = coded.indices.to_numpy()
        size = (end - first)[code]
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids[hashing.ranges(first[code], size)], upto[np.cumsum(pc.list_value_length(lists).to_numpy())]


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _ids(text: str, path: str) -> Iterator[bytes]:
    """Little-endian ids of a text, some thousands at a time."""
    e = _encoder(path)
    for piece in e.bpe.pieces(text):
        yield np.fromiter(e.bpe.run(piece), np.dtype("<u4")).tobytes() if isinstance(piece, str) else e.of(piece)


def _cut(blocks: Iterable[bytes], capacity: int, end_id: int) -> Iterator[tuple[int, int, int]]:
    held, start, full = b"", 0, 4 * capacity
    for more in itertools.chain(blocks, [np.array([end_id], "<u4").tobytes()]):
        held += more
        while len(held) >= full:
            yield start, capacity, zlib.crc32(held[:full])
            held, start = held[full:], start + capacity
    if held:
        yield start, len(held) // 4, zlib.crc32(held)


def cut(text: str, path: str, capacity: int, end_id: int) -> Iterator[tuple[int, int, int]]:
    """start, length and crc32 of each piece of at most ``capacity`` ids, the end id included; holds one piece."""
    return _cut(_ids(text, path), capacity, end_id)


def cut_all(texts: pa.StringArray, path: str, capacity: int, end_id: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """The place of each text and a piece of it, as ``cut`` gives them; texts of about TOGETHER bytes are encoded at once."""
    e, waiting, held = _encoder(path), [], 0

    def encoded():
        ids, ends = e.together(texts.take(pa.array(waiting, pa.int64())))
        for at, a, b in zip(waiting, [0, *ends.tolist()], ends.tolist()):
            yield from ((at, x) for x in _cut([ids[a:b].tobytes()], capacity, end_id))

    texts = pc.fill_null(texts, "")
    for at, size in enumerate(pc.binary_length(texts).to_pylist()):
        text = texts[at].as_py()
        if size > TOGETHER or e.bpe.odd(text):
            yield from ((at, x) for x in cut(text, path, capacity, end_id))
            continue
        if held + size > TOGETHER:
            yield from encoded()
            waiting, held = [], 0
        waiting.append(at)
        held += size
    if waiting:
        yield from encoded()


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text."""

    def run(batches):
        for batch in batches:
            found = [*cut_all(batch.column(1), path, capacity, end_id)]
            at, start, length, crc = (np.array(c, np.int64) for c in zip(*((at, *x) for at, x in found), strict=True)) if found else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Open bins are found by a bit mask of their room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    mask, n = 0, 0
    for k, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left]
            b = at.pop()
            if not at:
                mask &= ~(1 << left)
        else:
            b, left, n = n, capacity, n + 1
        bins[k], offsets[k] = b, capacity - left
        if left > size:
            mask |= 1 << (left - size)
            room.setdefault(left - size, []).append(b)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of two families of dual feasible functions over the lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from how often each length occurs."""
    size = np.arange(capacity + 1)
    n_upto, sum_upto = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    # f_a: lengths over capacity - a count as whole bins, those under a as nothing.
    big = n_upto[-1] - n_upto[capacity - a]
    middle = sum_upto[capacity - a] - np.where(a > 0, sum_upto[np.maximum(a - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    # u_k: x rounds down to multiples of 1 / k of (k + 1) x, unless that is whole already.
    for k in range(1, 33):
        scaled = (k + 1) * size
        worth = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((worth * count).sum()) // (k * capacity)))
    return best


def bound_of(pieces: DataFrame, capacity: int) -> int:
    """The lower bound over all lengths; what comes to the driver is a count for each length."""
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return bound_of_counts(count, capacity)


def pack(pieces: DataFrame, capacity: int = 4096, each: int = 16_000, folder: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any others), row by row. ``each``: about how many pieces a task packs.

    The result reads tables in ``folder``.
    """

    def packed(part_rows: pa.Table) -> pa.Table:
        rows = part_rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, n)
        gap = n - lower_bound(lengths, capacity)
        give = np.zeros(n, bool)
        give[np.argsort(fill, kind="stable")[: 4 * gap + 1]] = True
        give &= fill < capacity
        for name, values in (("bin", bins), ("offset", offsets), ("given", give[bins])):
            rows = rows.append_column(name, pa.array(values))
        return rows

    # A null doc_id is dealt by its row, so that many of them do not meet in one task.
    left = pieces.withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([*left.schema.fields, *T.StructType.fromDDL("part long, bin long, offset long, given boolean")])
    n, floor, total, settled, before, k = left.count(), bound_of(pieces, capacity), 0, None, None, 0

    def placed(done: DataFrame, k: int) -> DataFrame:
        return done.select(*pieces.columns, (F.lit(k << 58) + F.col("part") * (1 << 26) + F.col("bin")).alias("sequence_id"), "offset")

    def bins_of(done: DataFrame) -> tuple[int, int, int]:
        """Bins, those given up, and the rows in these."""
        per = done.groupBy("part", "bin").agg(F.max("given").alias("given"), F.count("*").alias("n"))
        r = per.agg(F.count("*"), F.sum(F.col("given").cast("long")), F.sum(F.when(F.col("given"), F.col("n")))).first()
        return r[0], r[1] or 0, r[2] or 0

    while True:
        parts = max(1, n // each)
        done = written(left.withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", "row"), "piece", F.lit(k)), F.lit(parts)).cast("long")).groupBy("part").applyInArrow(packed, schema), f"pack{k}", folder)
        bins, given, n = bins_of(done)
        if before is not None and bins >= before[1]:
            return settled.unionByName(before[0])  # the exchange saved nothing: the bins stay as they were
        total += bins - (before[1] if before else 0)
        if parts == 1 or given < 2 or total <= floor or k == 31:
            new = placed(done, k)
            return new if settled is None else settled.unionByName(new)
        new = placed(done.where(~F.col("given")), k)
        settled = new if settled is None else settled.unionByName(new)
        before = placed(done.where("given"), k), given
        left, k = done.where("given").select(*left.columns), k + 1


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    with Scratch(docs.sparkSession) as s:
        pieces = s.written(token_pieces(docs, path, capacity, end_id), "pieces")
        done = pack(pieces, capacity, folder=s.folder)
        return written(done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), "packed")
