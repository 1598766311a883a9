"""WARC fixity: Merkle trees over records and ordered offset ranges, compared between replicas.

A leaf is the SHA-256 of one record's bytes together with its offset and length in its file. Its place in the tree is
its record id's slot, not its number in the file, so a record that is missing or extra does not push others to other
places; what it does move, their offsets, is reported as moved. An inner node is the hash of its children in order, at
most FANOUT slots, so it stands for one contiguous offset range. Replicas are compared root by root; only below a pair
of nodes that differ is the next level looked at. Levels are written, so each is made once.

Defined results: a null url or body is an empty one; a record that only one replica has is reported as missing; equal
records at different places are different leaves; two replicas that agree, or two empty ones, give no rows; records
without an id are dealt to files of their own (negative numbers) by their digests; rows of one id share its slot and
are numbered in the order of their digests.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.shared import Scratch, written

FANOUT = 16
#: Records a file, of consecutive ids.
RECORDS = 256
#: Files that records without an id are dealt to.
_NAMELESS = 1 << 16


def records(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """file, page_id, record (binary): one response record a page; a file holds the records of consecutive ids, in their order."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    made = pages.select("page_id", F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))
    nameless = -1 - F.pmod(F.xxhash64("record"), F.lit(_NAMELESS))
    # div rounds towards zero, so what is under zero is taken one lower.
    file = F.expr(f"(page_id - pmod(page_id, {per_file})) div {per_file}")
    return made.select(F.coalesce(file, nameless).cast("long").alias("file"), "page_id", "record")


def archive(recs: DataFrame) -> DataFrame:
    """file, content: whole WARC files, records in the order of their ids, of one id in that of their digests, as ``leaves`` has them. A file holds a bounded number of records."""
    ordered = F.sort_array(F.collect_list(F.struct("page_id", F.sha2("record", 256).alias("digest"), "record")))
    return recs.groupBy("file").agg(F.expr("''").alias("_"), ordered.alias("r")).select("file", F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["record"])).alias("content"))


def read(files: DataFrame) -> DataFrame:
    """file, page_id, record out of whole WARC files (file, content), by the lengths that the records state."""
    import re

    import pyarrow as pa

    head = re.compile(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n")

    def run(batches):
        for batch in batches:
            out = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at = content.as_py() or b"", 0
                while at < len(data):
                    m = head.match(data, at)
                    if not m:
                        raise ValueError(f"no record at byte {at} of file {file}")
                    fields = dict(x.split(b": ", 1) for x in m[1].split(b"\r\n") if b": " in x)
                    end = m.end() + int(fields[b"Content-Length"]) + 4
                    name = fields.get(b"WARC-Record-ID", b"")[len(b"<urn:page:") : -1]
                    out.append({"file": file, "page_id": int(name) if name else None, "record": data[at:end]})
                    at = end
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.int64()), ("page_id", pa.int64()), ("record", pa.binary())]))

    return files.select("file", "content").mapInArrow(run, "file long, page_id long, record binary")


def leaves(recs: DataFrame, per_file: int = RECORDS, scratch: Scratch | None = None) -> DataFrame:
    """One row a record: its digest, place and range. Bodies are hashed where they are read and do not travel."""
    slim = recs.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    slim = scratch.written(slim, "leaves") if scratch else slim
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    first = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slot = F.coalesce(F.pmod("page_id", F.lit(per_file)), F.pmod(F.xxhash64("digest"), F.lit(per_file)))
    copy = F.row_number().over(Window.partitionBy("file", "page_id").orderBy("digest")) - 1
    out = slim.select("file", slot.cast("long").alias("node"), copy.cast("long").alias("copy"), "page_id", first.alias("first"), (first + F.col("length")).alias("end"), "digest")
    return out.withColumn("hash", F.sha2(F.concat_ws("|", "first", "end", "digest"), 256))


def parents(level: DataFrame) -> DataFrame:
    """The next level up: a node for each FANOUT slots. Children's hashes are summed up in order."""
    children = F.sort_array(F.collect_list(F.struct("node", "copy", "hash")))
    up = F.expr(f"node div {FANOUT}")
    digest = F.sha2(F.concat_ws("|", F.transform(children, lambda x: F.concat_ws(":", x["node"].cast("string"), x["copy"].cast("string"), x["hash"]))), 256)
    return level.groupBy("file", up.alias("node")).agg(F.min("first").alias("first"), F.max("end").alias("end"), digest.alias("hash")).withColumn("copy", F.lit(0).cast("long"))


def tree(leaf: DataFrame, scratch: Scratch, per_file: int = RECORDS) -> list[DataFrame]:
    """Levels from the leaves to the files' roots."""
    levels, n = [scratch.written(leaf, "level")], 1
    while n < per_file:
        levels.append(scratch.written(parents(levels[-1]), "level"))
        n *= FANOUT
    return levels


def differing(a: DataFrame, b: DataFrame, within: DataFrame | None) -> DataFrame:
    """file, node, copy of the nodes of one level that differ or that one side lacks, looked for only under ``within``."""
    if within is not None:
        under = lambda x: x.join(within.select("file", F.col("node").alias("up")), (x["file"] == within["file"]) & (F.expr(f"node div {FANOUT}") == F.col("up")), "left_semi")
        a, b = under(a), under(b)
    a, b = (x.select("file", "node", "copy", F.col("hash").alias(name)) for x, name in ((a, "ha"), (b, "hb")))
    return a.join(b, ["file", "node", "copy"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node", "copy")


def audit(left: DataFrame, right: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """The records (file, page_id, record) that differ between two replicas: file, seq, page_id, kind, ranges and digests of both.

    ``seq`` is the record's slot. Kinds: missing in a, missing in b, content, moved.
    """
    with Scratch(left.sparkSession) as s:
        ta, tb = (tree(leaves(x, per_file, s), s, per_file) for x in (left, right))
        bad = None
        for a, b in zip(reversed(ta), reversed(tb), strict=True):
            bad = s.written(differing(a, b, bad), "bad")
        at = ["file", "node", "copy"]
        side = lambda x, t: x.select(*at, *(F.col(c).alias(f"{c}_{t}") for c in ("page_id", "first", "end", "digest")))
        both = functools.reduce(lambda x, y: x.join(y, at, "left"), (bad, side(ta[0], "a"), side(tb[0], "b")))
        kind = F.when(F.col("digest_a").isNull(), "missing in a").when(F.col("digest_b").isNull(), "missing in b").when(F.col("digest_a") != F.col("digest_b"), "content").otherwise("moved")
        return written(both.select("file", F.col("node").alias("seq"), F.coalesce("page_id_a", "page_id_b").alias("page_id"), kind.alias("kind"), F.col("first_a").alias("offset_a"), (F.col("end_a") - F.col("first_a")).alias("length_a"), F.col("digest_a").alias("sha256_a"), F.col("first_b").alias("offset_b"), (F.col("end_b") - F.col("first_b")).alias("length_b"), F.col("digest_b").alias("sha256_b")), "audit")


def corrupted(recs: DataFrame, when: Column) -> DataFrame:
    """A replica whose chosen records have their last body byte overwritten by `?`: same ranges, other bytes."""
    n = F.octet_length("record")
    return recs.withColumn("record", F.when(when, F.concat(F.substring(F.col("record"), F.lit(1), n - 5), F.lit("?").cast("binary"), F.lit("\r\n\r\n").cast("binary"))).otherwise(F.col("record")))
