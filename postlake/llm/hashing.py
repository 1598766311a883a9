"""Vectorised hashes over the UTF-8 buffer of an Arrow string column: no Python object per word or byte.

All of them chain a bijective mixer over eight bytes at a time. None is a polynomial, so no text (such as
Thue-Morse words, which meet under any polynomial modulo a power of two) is prone to meet another. Where an answer
rests on equality, 128 bits (``digest``) or the words or bytes themselves are compared besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: A word longer than this is hashed by itself.
_LONG = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Word separators: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes in their order."""
    return mix(a * _ODD + b)


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a view; zeros follow the end."""
    held = np.zeros(len(buf) + 8, np.uint8)
    held[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", held, strides=(1,))


def rolling(x: np.ndarray, width: int, unit: int = 1) -> np.ndarray:
    """The hash of each stretch of ``width`` places, where x[i] stands for the places i to i + unit."""
    n = len(x) + unit - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    made, size = {unit: x}, unit
    while 2 * size <= width:
        made[2 * size] = join(made[size][:-size], made[size][size:])
        size *= 2
    out, done = made[size][:n], size
    while done < width:
        size = max((s for s in made if s <= width - done), default=unit)
        at = min(done, width - size)
        out, done = join(out, made[size][at : at + n]), at + size
    return out


def byte_windows(buf: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` bytes (eight at least)."""
    return rolling(mix(loads(buf)[: max(0, len(buf) - 7)] ^ _ODD), width, 8) if len(buf) >= width else np.zeros(0, np.uint64)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes other than SPACE) of the texts buf[offsets[i]:offsets[i + 1]], and the first word of each text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word, eight bytes at a time; equal lengths up to eight bytes never meet. Seeds give independent hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight, left = loads(buf), end - start
    out = mix(mix(left.astype(np.uint64) * _ODD + _U(seed)) ^ (eight[start] & _MASKS[np.minimum(left, 8)]))
    for i in np.flatnonzero(left > _LONG).tolist():
        out[i] = digest64(buf[start[i] : end[i]].tobytes(), seed)
    rest = np.flatnonzero((left > 8) & (left <= _LONG))
    at, left = start[rest] + 8, left[rest] - 8
    while len(rest):
        out[rest] = join(out[rest], eight[at] & _MASKS[np.minimum(left, 8)])
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes; those that cross texts are for the caller to leave out."""
    return rolling(hashes, k)


def digest(data: bytes) -> bytes:
    """128 bits of a keyless cryptographic hash: equal digests are taken for equal bytes."""
    return hashlib.blake2b(data, digest_size=16).digest()


def digest64(data: bytes, seed: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] to start[i] + size[i], one stretch after another."""
    if not len(size):
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def texts(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets (from 0) of runs of at most ``rows`` rows and about ``most`` bytes each; a null text has no bytes. A longer text comes alone and whole."""
    col = batch.column(column)
    if pa.types.is_large_string(col.type) is False:
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
