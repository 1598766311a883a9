"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 4 letters of words padded by a blank) in falling
frequency. A text's distance to a language is the sum over the text's own profile of how far each n-gram is out of
place, with a fixed penalty for one the language does not have; the nearest language wins.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first language by name;
rows with equal texts get equal answers; without learned languages every text is `und`; a row without a doc_id is not
learned from and counts as not held out. Only doc_id, text and, for learning, lang are read, so further columns cannot
clash.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LONGEST = 4
#: Characters counted at a time.
_PIECE = 1 << 18
#: More values of ``lang`` than this are no languages; learning them is refused.
MOST_LANGS = 2000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _piece_counts(codes: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a piece that ends with a word, as 64-bit hashes of their code points, and how often each occurs."""
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one blank stays after each word
    codes = np.where(letter, codes, 32)[kept].astype(np.uint64)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    inside = np.concatenate(([False], letter[kept], [False]))
    out, acc, ok = [codes[inside]], codes, np.ones(len(codes), bool)
    for n in range(2, _LONGEST + 1):
        acc = acc[:-1] * _ODD + codes[n - 1 :]
        ok = ok[:-1] & inside[n - 2 : len(codes) - 1] if n > 2 else inside[1:] | inside[:-1]
        out.append(acc[ok])
    every = np.sort(np.concatenate(out))
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.diff(first, append=len(every))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a whole text and how often each occurs; counted in pieces cut between words, so memory beyond the text follows the distinct n-grams."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    gaps = np.flatnonzero(~letter) if len(codes) > _PIECE else np.zeros(0, np.int64)
    held, a = [], 0
    while a < len(codes):
        at = np.searchsorted(gaps, a + _PIECE)
        b = int(gaps[at]) if at < len(gaps) else len(codes)
        if letter[a:b].any():
            held.append(_piece_counts(codes[a:b], letter[a:b]))
            if len(held) > 32:
                held = [_summed(*map(np.concatenate, zip(*held)))]
        a = b
    if len(held) > 1:
        return _summed(*map(np.concatenate, zip(*held)))
    return held[0] if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def top(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys in falling frequency; ties by key."""
    if len(keys) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))][:size]


def _joined(texts):
    """Short texts put together, so that they are counted at once; a line break is no letter, so no n-gram spans two."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _PIECE:
            yield "\n".join(held)
            held, size = [], 0
    yield "\n".join(held)


def learn(docs: DataFrame, size: int = 400) -> list[tuple[str, int, int]]:
    """(lang, rank, n-gram) of each language's profile, over all rows with a text and a language.

    What comes to the driver is ``size`` rows a language, and no more than MOST_LANGS of them.
    """
    known = docs.where("text is not null and lang is not null").select("lang").distinct().limit(MOST_LANGS + 1).count()
    if known > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} values of lang")

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for text in _joined(t.as_py() for t, of in zip(batch.column(1), langs) if of == lang):
                    held.append(counts(text))
                    if len(held) > 32:
                        held = [_summed(*map(np.concatenate, zip(*held)))]
                keys, n = _summed(*map(np.concatenate, zip(*held)))
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    per = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    total = per.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return [tuple(r) for r in total.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "rank", "gram").collect()]


def predict(docs: DataFrame, profiles: list[tuple[str, int, int]], size: int = 400) -> DataFrame:
    """doc_id, lang_pred, score. Score: how much nearer the best language is than the next one, from 0 to 1."""
    langs = sorted({x[0] for x in profiles})
    known = np.unique(np.array([x[2] for x in profiles], np.int64).astype(np.uint64)) if profiles else np.zeros(0, np.uint64)
    place = np.full((len(langs), len(known) + 1), -1, np.int64)
    for lang, rank, gram in profiles:
        place[langs.index(lang), np.searchsorted(known, np.uint64(gram % 2**64))] = rank - 1

    def one(text: str | None) -> tuple[str, float]:
        keys, n = counts(text) if text else ((), ())
        if not len(keys) or not langs:
            return "und", 0.0
        own = top(keys, n, size)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = np.where(known[at] == own, at, len(known))
        ranks = place[:, at]
        apart = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(own))), size), size).sum(1)
        best = int(np.argmin(apart))
        if len(langs) == 1:
            return langs[0], float(1 - apart[0] / (size * len(own)))
        second = np.partition(apart, 1)[1]
        return langs[best], float((second - apart[best]) / max(1, second))

    def run(batches):
        for batch in batches:
            got = [one(t.as_py()) for t in batch.column(1)]
            lang, score = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 3 is 1: such rows are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def held_out_of(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def identify(docs: DataFrame, size: int = 400) -> DataFrame:
    """Learns from the rows that are not held out, predicts all: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs.where(~held_out()), size)
    return predict(docs, profiles, size).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
