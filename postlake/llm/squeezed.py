"""Texts on their way through a shuffle: compressed one by one before it, given back in small batches behind it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with the column ``text`` as compressed bytes; a null text stays null. The other columns come first."""
    rest = [c for c in df.columns if c != "text"]
    df = df.select(*rest, F.col("text"))

    def run(batches):
        to = zstandard.ZstdCompressor(level=1)
        for b in batches:
            made = pa.array([None if x is None else to.compress(x.encode()) for x in (v.as_py() for v in b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [made], names=[*rest, "text"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("text", T.BinaryType())]))


def restored(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a squeezed batch with their texts again, about ``most`` bytes of text a batch; a longer text comes alone."""
    back, held, n, a = zstandard.ZstdDecompressor(), [], 0, 0
    at, names = batch.schema.names.index("text"), batch.schema.names

    def told(b: int) -> pa.RecordBatch:
        part = batch.slice(a, b - a)
        return pa.RecordBatch.from_arrays([pa.array(held, pa.large_string()) if i == at else c for i, c in enumerate(part.columns)], names=names)

    for i, v in enumerate(batch.column("text")):
        blob = v.as_py()
        size = 0 if blob is None else zstandard.frame_content_size(blob)
        if held and n + size > most:
            yield told(i)
            held, n, a = [], 0, i
        held.append(None if blob is None else back.decompress(blob).decode())
        n += size
    if held:
        yield told(batch.num_rows)
