"""Attachments of messages: bytes, and the text of PDF and DOCX files, read in Arrow batches on the executors."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
from email import policy
from email.parser import BytesParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import files

#: Files over this size are not opened.
MOST = 20 << 20
#: States of a message: not looked at, text found, nothing to find.
PENDING, DONE, SKIPPED = 0, 2, 3


def parts(content: bytes) -> list[tuple[str, bytes]]:
    """Names and bytes of the attachments of one message file."""
    line, _, rest = content.partition(b"\n")
    m = BytesParser(policy=policy.default).parsebytes(rest[: int(line.strip())])
    found = ((p.get_filename(), p.get_payload(decode=True)) for p in m.iter_attachments())
    return [(name, data) for name, data in found if name and isinstance(data, bytes)]


def pdf_text(data: bytes) -> str | None:
    """Needs the optional pypdf; None without it, and for a file that it cannot read."""
    try:
        import pypdf
    except ImportError:
        return None
    found = []
    try:
        reader = pypdf.PdfReader(io.BytesIO(data))
        if reader.is_encrypted:
            reader.decrypt("")
        for k in range(len(reader.pages)):
            try:
                found.append(reader.pages[k].extract_text())
            except Exception:  # a page that cannot be read costs only itself
                continue
    except Exception:  # pypdf raises many kinds for broken files
        return None
    return "\n".join(x for x in found if x).strip() or None


def docx_text(data: bytes) -> str | None:
    """The text runs of a DOCX file, one blank between; None for a file that is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError):
        return None
    return " ".join(e.text for e in root.iter() if e.tag.rpartition("}")[2] == "t" and "}" in e.tag and e.text).strip() or None


READERS = {".pdf": pdf_text, ".docx": docx_text}


def text_of(name: str, data: bytes, most: int = MOST) -> str | None:
    reader = next((r for end, r in READERS.items() if name.lower().endswith(end)), None)
    found = reader(data) if reader and len(data) <= most else None
    return found.encode("utf-8", "replace").decode("utf-8") if found else None


def attachments(found: DataFrame) -> DataFrame:
    """path, name, data of each attachment in ``mail.files`` rows; files that cannot be read have none."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                try:
                    held = parts(content.as_py())
                except Exception:  # the mail source reports broken files
                    held = []
                out += [{"path": path.as_py(), "name": n, "data": d} for n, d in held]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("name", pa.string()), ("data", pa.binary())]))

    return found.select("path", "content").mapInArrow(run, "path string, name string, data binary")


def folder_beside(path: str) -> str | None:
    """Where the attachments of a partial message lie: ``Attachments/<rowid>`` next to its folder ``Messages``."""
    folder, _, name = path.rpartition("/")
    number = name.removesuffix(".partial.emlx")
    return f"{folder.rpartition('/')[0]}/Attachments/{number}" if number != name and number.isdigit() else None


def beside(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, data of the attachments of named partial messages, by their files; those that have no folder have none."""
    at = {folder: p for p in paths if (folder := folder_beside(p)) and files.names(spark, folder)}
    if not at:
        return spark.createDataFrame([], "path string, name string, data binary")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([*at])
    place = F.regexp_extract("path", r"^(.*/Attachments/\d+)/", 1)
    clean = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    names = spark.createDataFrame([*at.items()], "_folder string, _path string")
    # As many rows as paths were named.
    joined = raw.withColumn("_at", clean(place)).join(F.broadcast(names.withColumn("_at", clean(F.col("_folder")))), "_at")
    return joined.select(F.col("_path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def one(found: DataFrame, path: str, name: str) -> DataFrame:
    """The bytes of one attachment; only its message is read, or its own file if the message is partial."""
    held = attachments(found.where(F.col("path") == path)).unionByName(beside(found.sparkSession, [path]))
    return held.where(F.col("name") == name).limit(1)


def _joined_texts(own: DataFrame, most: int) -> DataFrame:
    """path, _text: the texts of attachments that are files of their own (path, name, data), by name."""

    def run(batches):
        for batch in batches:
            texts = [text_of(n.as_py(), d.as_py(), most) for n, d in zip(batch.column("name"), batch.column("data"))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), pa.array(texts, pa.string())], ["path", "name", "_one"])

    read = own.select("path", "name", "data").mapInArrow(run, "path string, name string, _one string").where("_one is not null")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("name", "_one"))), lambda x: x["_one"])
    return read.groupBy("path").agg(F.array_join(texts, " ").alias("_text"))


def extracted(emails: DataFrame, found: DataFrame, newest: int | None = None, most: int = MOST, own: DataFrame | None = None) -> DataFrame:
    """The messages with ``attachment_text`` and ``extract_state`` of pending ones with attachments filled in, ``newest`` at most.

    ``own``: path, name, data of attachments of partial messages (see ``beside``).
    """
    todo = emails.where((F.col("extract_state") == PENDING) & (F.col("attachment_count") > 0)).select("path", "date_received")
    if newest is not None:
        todo = todo.orderBy(F.desc_nulls_last("date_received"), "path").limit(newest)

    def run(batches):
        for batch in batches:
            texts = []
            for content in batch.column("content"):
                try:
                    got = [text_of(n, d, most) for n, d in parts(content.as_py())]
                except Exception:  # the mail source reports broken files
                    got = []
                texts.append(" ".join(t for t in got if t).strip() or None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], ["path", "_text"])

    read = found.select("path", "content").join(todo.select("path"), "path", "left_semi").mapInArrow(run, "path string, _text string")
    if own is not None:
        read = read.unionByName(_joined_texts(own.join(todo.select("path"), "path", "left_semi"), most))
        read = read.groupBy("path").agg(F.max("_text").alias("_text"))
    out = emails.join(read.withColumn("_read", F.lit(True)), "path", "left")
    state = F.when(F.col("_read") & F.col("_text").isNotNull(), DONE).when(F.col("_read"), SKIPPED).otherwise(F.col("extract_state"))
    return out.withColumn("attachment_text", F.when(F.col("_read"), F.col("_text")).otherwise(F.col("attachment_text"))).withColumn("extract_state", state).select(*emails.columns)
