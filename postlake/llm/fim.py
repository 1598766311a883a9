"""Fill-in-middle over ropes: a document is split at two unit ranks and its parts change places between sentinels.

A rope is a tree over pieces of text. Leaves hold a bounded piece with its unit and code-point counts, inner nodes the
sums, so a split walks one path, and parts are put together without copying text. Units are code points, or the
matches of a pattern from left to right (what lies between two matches goes with the later one, a tail with the last).
The inverse finds the sentinels, splits the output at their code-point ranks and concatenates the parts in order.

Defined results: a null text is empty; an empty text and one that contains a sentinel stay plain; a null doc_id hashes
as an empty one; each row is by itself, so repeated rows get equal results and hot sources are no group at all. A text
is held whole in one task, as a row is, with its output beside it. Only doc_id and text are read, so further columns
cannot clash.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points of a leaf, and of the results that leave a task at once.
LEAF, BATCH = 4096, 2 << 20
SENTINELS = ("<P>", "<S>", "<M>")


class Rope:
    """A leaf (text, and where its units end unless they are code points) or the concatenation of two ropes."""

    __slots__ = ("text", "ends", "left", "right", "units", "points")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.ends, self.left, self.right = text, ends, left, right
        if left is not None:
            self.units, self.points = left.units + right.units, left.points + right.points
        else:
            self.units, self.points = len(text) if ends is None else len(ends), len(text)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            r = stack.pop()
            if r.left is None:
                yield r.text
            else:
                stack += (r.right, r.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def joined(*ropes: Rope) -> Rope:
    """The ropes one after another, as a balanced tree over them."""
    level = [r for r in ropes if r.points] or [Rope()]
    while len(level) > 1:
        level = [Rope(left=a, right=b) if b is not None else a for a, b in itertools.zip_longest(level[::2], level[1::2])]
    return level[0]


def rope(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """A balanced rope over ``text``; leaves end where units end."""
    if unit is None:
        return joined(*(Rope(text[a : a + leaf]) for a in range(0, len(text), leaf)))
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if ends:
        ends[-1] = len(text)
    parts, begin, held = [], 0, []
    for e in ends:
        held.append(e - begin)
        if held[-1] >= leaf:
            parts.append(Rope(text[begin:e], held))
            begin, held = e, []
    if begin < len(text):
        parts.append(Rope(text[begin:], held))
    return joined(*parts)


def split(r: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What lies before ``rank`` units (or code points), and the rest. A unit cut in two by code points counts on the right."""
    left, right = [], []
    while r.left is not None:
        n = getattr(r.left, by)
        if rank <= n:
            right.append(r.right)
            r = r.left
        else:
            left.append(r.left)
            rank, r = rank - n, r.right
    if r.ends is None:
        at, a, b = min(rank, r.points), None, None
    else:
        at = (r.ends[rank - 1] if rank else 0) if by == "units" else rank
        k = bisect.bisect_right(r.ends, at)
        a, b = r.ends[:k], [e - at for e in r.ends[k:]]
    return joined(*left, Rope(r.text[:at], a)), joined(Rope(r.text[at:], b), *reversed(right))


def found(r: Rope, needle: str) -> int:
    """The code-point rank of the first occurrence, which may lie over several leaves; -1 without one."""
    before, tail = 0, ""
    for piece in r.leaves():
        at = (tail + piece).find(needle)
        if at >= 0:
            return before - len(tail) + at
        before, tail = before + len(piece), (tail + piece)[-(len(needle) - 1) :] if len(needle) > 1 else ""
    return -1


def arranged(r: Rope, i: int, j: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Rope, int, int]:
    """The rope in another order, cut before units i and j, and the code points of its prefix and middle."""
    head, suffix = split(r, j)
    prefix, middle = split(head, i)
    p, s, m = (Rope(x, []) for x in sentinels)
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return joined(*order), prefix.points, middle.points


def inverted(r: Rope, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> Rope:
    """The text an output was made of, out of the output and its form alone."""
    if form == "plain":
        return r
    p, s, m = sentinels
    first, second = (s, p) if form == "spm" else (p, s)
    rest, parts = split(r, len(first), "points")[1], []
    for mark in (second, m):
        part, rest = split(rest, found(rest, mark), "points")
        rest = split(rest, len(mark), "points")[1]
        parts.append(part)
    prefix, suffix = reversed(parts) if form == "spm" else parts
    return joined(prefix, rest, suffix)


def cuts(doc_id: object, n: int, seed: int = 1) -> tuple[int, int, int, int]:
    """Ranks of the two cuts, and two numbers that choose the form, from a hash of seed and doc_id."""
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3 % 100, h4 % 100


def transform(docs: DataFrame, text: str = "text", unit: str | None = None, rate: int = 90, spm: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (psm, spm, plain), prefix_chars, middle_chars (null if plain), output.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of these with the suffix first. ``unit``: a
    pattern whose matches are units; code points without one.
    """
    kind = docs.schema["doc_id"].dataType
    pattern = re.compile(unit, re.S) if unit else None

    def made(doc_id: object, value: str | None) -> dict:
        r = rope(value or "", pattern)
        i, j, first, second = cuts(doc_id, r.units, seed)
        if not r.points or any(found(r, x) >= 0 for x in sentinels) or first >= rate:
            return {"n": r.units, "form": "plain", "output": value or ""}
        form = "spm" if second < spm else "psm"
        out, prefix, middle = arranged(r, i, j, form, sentinels)
        return {"n": r.units, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": str(out)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
            rows, size = [], 0
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                rows.append({"doc_id": (i := doc_id.as_py())} | made(i, value.as_py()))
                size += len(rows[-1]["output"])
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("doc_id", docs[text].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``transform`` with ``restored``: the text, rebuilt from ``output`` and ``form``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = {c: k for k, c in enumerate(whole.schema.names)}
            for a in range(0, whole.num_rows, 128):
                batch = whole.slice(a, 128)
                texts = [str(inverted(rope(o.as_py()), f.as_py(), sentinels)) for o, f in zip(batch.column(at["output"]), batch.column(at["form"]))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    return made.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", restored string")
