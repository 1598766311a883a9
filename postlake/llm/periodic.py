"""Periodic runs of words by bit-parallel lags.

The words of a text get numbers, and each bit of the numbers becomes one big integer with a bit a word. For a lag q the
integers are XORed with themselves shifted by q and the differences ORed: a zero bit is a word equal to the one q later.
ANDs with doubling shifts leave the starts of zero stretches that are long enough, and these are the runs of period q.

Only lags that may hold a run are tried. A run of period q, 2^k <= q < 2^(k+1), is at least four periods long, so it holds
a block of 2^(k+1) words that begins at a multiple of 2^k and comes again q later; of the lags of one k at which a block
comes again only the least can be a smallest period (two would give their common divisor, by Fine and Wilf). All blocks
are compared with the 2^k places behind them in one array operation a k, so the search takes n log n steps and finds at
most about sqrt(n) lags, mostly none, where trying all lags would take n^2. Blocks are compared by hashes, and hits word
by word, so no lag is lost and none is wrong.

Defined results: a null text has no words and so no runs, nor have texts of under six words; the same stretch is
reported with its smallest period only; each row is by itself, so repeated rows and null ids are rows like others. A
text's words are held in one task. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlake.llm.hashing import join, mix

#: Bytes of text that leave a task at once.
BATCH = 2 << 20
#: A run has this many words and this many periods at least.
WORDS, PERIODS = 6, 4


def lags(ids: np.ndarray) -> list[int]:
    """The lags at which a run can lie, in order."""
    n, step, out = len(ids), 1, []
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    while PERIODS * step <= n:
        h = join(h[:-step], h[step:])  # of the 2 * step words from each place on
        table = np.zeros(-(-len(h) // step) * step, np.uint64)
        table[: len(h)] = h
        table = table.reshape(-1, step)
        same = table[1:] == table[:-1, :1]
        hit = np.flatnonzero(same.any(axis=1))
        if len(hit):
            lag = step + same[hit].argmax(axis=1)
            at = (hit * step)[:, None] + np.arange(2 * step)
            inside = at + lag[:, None] < n
            true = (inside & (ids[at] == ids[np.minimum(at + lag[:, None], n - 1)])).all(axis=1)
            out.append(lag[true])
            # A chance meeting of hashes must not hide a lag behind it.
            out += [step + np.flatnonzero(same[k]) for k in hit[~true]]
        step *= 2
    found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return found[found * PERIODS <= n].tolist()


def planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the ids; its bit i is that bit of ids[i]."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(int(ids.max()).bit_length())]


def stretches(bits: list[int], n: int, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of places equal to the one ``lag`` later that are ``need`` long at least."""
    apart = 0
    for p in bits:
        apart |= p ^ (p >> lag)
    m = n - lag
    left, long = ~apart & ((1 << m) - 1), 1
    while long < need and left:
        more = min(long, need - long)
        left &= left >> more
        long += more
    if not left:
        return []
    ones = np.unpackbits(np.frombuffer(left.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little").astype(np.int8)
    turn = np.diff(ones, prepend=0, append=0)
    return [(int(a), int(b) + need - 1) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, number = len(words), {}
    if n < WORDS:
        return []
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    tried = lags(ids)
    bits, seen = planes(ids) if tried else [], {}
    for q in tried:
        for a, b in stretches(bits, n, q, max(WORDS - q, (PERIODS - 1) * q)):
            seen.setdefault((a, b + q - a), q)
    return sorted((a, length, q) for (a, length), q in seen.items())


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; the first of equal ones by start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, joined by blanks."""
    if not found:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for a, length, q in found:
        cover[a + q] += 1
        cover[a + length] -= 1
    return b" ".join(w for w, c in zip(words, np.cumsum(cover).tolist()) if not c)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs (all of them), collapsed (the text without repeats)."""
    kind = docs.schema["doc_id"].dataType

    def batch_of(ids: list, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        all_runs = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r[5]] for r in rows], pa.list_(_RUN))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *numbers, all_runs, pa.array([r[6] for r in rows], pa.binary()).cast(pa.string())], ["doc_id", *_NUMBERS, "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids, rows, size = batch.schema.field(0).type, [], [], 0
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                words = (value.as_py() or b"").split()  # at the bytes 20 and 09 to 0D
                found = runs(words)
                a, length, q = strongest(found) or (None, None, None)
                ids.append(doc_id.as_py())
                rows.append((len(found), a, length, q, None if q is None else 1000 * length // q, found, collapsed(words, found)))
                size += len(rows[-1][6]) + 64 * len(found)
                if size > BATCH:
                    yield batch_of(ids, of, rows)
                    ids, rows, size = [], [], 0
            yield batch_of(ids, of, rows)

    return docs.select("doc_id", docs[text].cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
