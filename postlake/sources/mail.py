"""Mail trees of EMLX files: the inventory, and messages parsed in Arrow batches.

A file holds a line with the message's byte count, an RFC 822 message and an XML property list. A file that cannot be
parsed gives a row with ``error`` set and no other parsed field; a bad property list counts as an empty one. Partial
files (``.partial.emlx``) have no body.
"""

from __future__ import annotations

import plistlib
from email import policy
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime
from urllib.parse import parse_qs, unquote, urlsplit

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the property list's ``flags``.
FLAGS = {"is_read": 0, "is_answered": 1, "is_flagged": 2, "is_deleted": 3, "is_draft": 4}
TEXT = ("message_id", "subject", "sender_name", "sender_addr", "in_reply_to", "body_plain", "body_html", "unsubscribe_mailto", "unsubscribe_subject")
_PERSON = pa.struct([("name", pa.string()), ("addr", pa.string())])
_LISTS = {"references": pa.string(), "recipients": pa.string(), "attachments": pa.string(), "unsubscribe_https": pa.string(), "recipients_to": _PERSON, "recipients_cc": _PERSON}
PARSED = pa.schema([("path", pa.string()), ("error", pa.string()), *((c, pa.string()) for c in TEXT), *((c, pa.list_(t)) for c, t in _LISTS.items()), ("date_sent", pa.int64()), ("date_received", pa.int64()), *((c, pa.bool_()) for c in (*FLAGS, "is_bulk", "one_click"))])
DDL = "path string, error string, " + ", ".join(f"{c} string" for c in TEXT) + ", " + ", ".join(f"`{c}` array<{'string' if t == pa.string() else 'struct<name:string,addr:string>'}>" for c, t in _LISTS.items()) + ", date_sent long, date_received long, " + ", ".join(f"{c} boolean" for c in (*FLAGS, "is_bulk", "one_click"))


def newest_tree(spark: SparkSession, library: str) -> str | None:
    """The mail tree ``V<n>`` of the highest n in a folder; None if there is none or it may not be read."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(library)
    try:
        names = [str(s.getPath().getName()) for s in of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(of)]
    except Py4JJavaError:
        return None
    found = [n for n in names if n.startswith("V") and n[1:].isdigit()]
    return f"{library.rstrip('/')}/{max(found, key=lambda n: int(n[1:]))}" if found else None


def place() -> dict[str, Column]:
    """account and mailbox of a path: the folder before the outermost ``.mbox`` one, and the ``.mbox`` folders, outer first."""
    parts = F.split("path", "/")
    boxes = F.filter(parts, lambda x: F.endswith(x, F.lit(".mbox")))
    before = F.get(parts, F.array_position(parts, F.get(boxes, F.lit(0))).cast("int") - 2)
    account = F.when(F.contains(before, F.lit("-")) & (before != "MailData"), before)
    return {"account": account, "mailbox": F.array_join(F.transform(boxes, lambda x: F.regexp_replace(x, r"\.mbox$", "")), "/")}


def files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """path, mtime_us, size, rowid, account, mailbox, partial, content of a tree or of named files; content is read only where it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").load(root)
    name = F.regexp_extract("path", r"/(\d+)(\.partial)?\.emlx$", 1)
    columns = [name.cast("long").alias("rowid"), *(c.alias(k) for k, c in place().items())]
    return raw.where(name != "").select("path", F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"), *columns, F.col("path").endswith(".partial.emlx").alias("partial"), "content")


def accounts(found: DataFrame) -> DataFrame:
    return found.where("account is not null").select("account").distinct().orderBy("account")


def partial_attachments(spark: SparkSession, root: str) -> DataFrame:
    """account, mailbox, rowid, attachments: names of the files that lie beside partial messages, in ``Attachments/<rowid>/``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = raw.select("path", *(c.alias(k) for k, c in place().items()), F.regexp_extract("path", r"/Attachments/(\d+)/", 1).alias("n"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return at.where("n <> ''").groupBy("account", "mailbox", F.col("n").cast("long").alias("rowid")).agg(F.sort_array(F.collect_list("name")).alias("attachments"))


def with_partial(messages: DataFrame, beside: DataFrame) -> DataFrame:
    """Messages (account, mailbox, rowid, attachments, path) with the attachments of partial ones, whose bytes lie in files of their own, filled in."""
    at = beside.select(*(F.col(c).alias(f"_{c}") for c in ("account", "mailbox", "rowid")), F.col("attachments").alias("_beside"))
    same = F.col("path").endswith(".partial.emlx") & F.col("account").eqNullSafe(F.col("_account")) & (F.col("mailbox") == F.col("_mailbox")) & (F.col("rowid") == F.col("_rowid"))
    return messages.join(at, same, "left").withColumn("attachments", F.coalesce("_beside", "attachments")).select(*messages.columns)


def _clean(value: object) -> str | None:
    return None if value is None else str(value).encode("utf-8", "replace").decode("utf-8")


def _ids(value: object) -> list[str]:
    return [x.strip("<>") for x in str(value or "").split() if x.strip("<>")]


def _seconds(value: object) -> int | None:
    return int(value) if isinstance(value, (int, float)) else None


def parsed(content: bytes, partial: bool) -> dict:
    """Fields of one file; ValueError if its byte count is missing or beyond the file."""
    line, _, rest = content.partition(b"\n")
    size = int(line.strip())
    if not 0 <= size <= len(rest):
        raise ValueError(f"byte count {size} of {len(rest)} bytes")
    m = BytesParser(policy=policy.default).parsebytes(rest[:size])
    try:
        extra = plistlib.loads(rest[size:].strip())
        extra = extra if isinstance(extra, dict) else {}
    except Exception:  # plistlib raises many kinds for bytes that are no property list
        extra = {}
    flags, body = _seconds(extra.get("flags")) or 0, {}
    for kind in ("plain", "html") if not partial else ():
        part = m.get_body((kind,))
        body[kind] = _clean(part.get_content()) if part is not None else None
    name, addr = (getaddresses([str(m["From"] or "")]) or [("", "")])[0]
    to = getaddresses([str(v) for h in ("To", "Cc", "Bcc") for v in m.get_all(h, [])])
    try:
        sent = int(parsedate_to_datetime(str(m["Date"])).timestamp())
    except ValueError:
        sent = None
    lists = any(m[h] for h in ("List-Unsubscribe", "List-Id", "List-Post"))
    auto = str(m["Auto-Submitted"] or "no").strip().lower() != "no"
    row = {"message_id": next(iter(_ids(m["Message-ID"])), None), "subject": m["Subject"], "sender_name": name or None, "sender_addr": addr.lower() or None, "in_reply_to": next(iter(_ids(m["In-Reply-To"])), None), "body_plain": body.get("plain"), "body_html": body.get("html")}
    row = {k: _clean(v) for k, v in row.items()} | {f: bool(flags >> bit & 1) for f, bit in FLAGS.items()}
    people = lambda *heads: [{"name": _clean(n) or None, "addr": _clean(a)} for n, a in getaddresses([str(v) for h in heads for v in m.get_all(h, [])]) if a]
    row |= {"recipients_to": people("To"), "recipients_cc": people("Cc")} | unsubscribe(m)
    row |= {"references": _ids(m["References"]), "recipients": [_clean(a.lower()) for _, a in to if a], "attachments": [_clean(p.get_filename()) for p in m.iter_attachments() if p.get_filename()] if not partial else []}
    row |= {"date_sent": _seconds(extra.get("date-sent")) or sent, "date_received": _seconds(extra.get("date-received"))}
    return row | {"is_bulk": bool(lists or auto or str(m["Precedence"] or "").strip().lower() in ("bulk", "list", "junk"))}


def unsubscribe(m) -> dict:
    """What a sender offers for leaving a list: https addresses, the first mail address with its subject, one click."""
    out = {"unsubscribe_https": [], "unsubscribe_mailto": None, "unsubscribe_subject": None, "one_click": "one-click" in str(m["List-Unsubscribe-Post"] or "").lower()}
    for uri in (x.partition(">")[0].strip() for x in str(m["List-Unsubscribe"] or "").split("<")[1:]):
        kind = uri.partition(":")[0].lower()
        if kind == "https":
            out["unsubscribe_https"].append(_clean(uri))
        elif kind == "mailto" and out["unsubscribe_mailto"] is None:
            at = urlsplit(uri)
            out["unsubscribe_mailto"] = next((_clean(a) for _, a in getaddresses([unquote(at.path)]) if a), None)
            out["unsubscribe_subject"] = _clean(next(iter(parse_qs(at.query).get("subject", [])), None))
    return out


def unsubscribe_decision(https: Column, mailto: Column, one_click: Column) -> Column:
    """How to leave a list: one-click-post, mailto or none-found. Nothing is sent."""
    return F.when(one_click & (F.size(https) > 0), "one-click-post").when(mailto.isNotNull(), "mailto").otherwise("none-found")


def messages(found: DataFrame) -> DataFrame:
    """The parsed fields of each of ``files``."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, partial in zip(*(batch.column(c) for c in ("path", "content", "partial"))):
                row = {"path": path.as_py()}
                try:
                    row |= parsed(content.as_py(), partial.as_py())
                except Exception as e:  # a broken file must not end the job; it becomes a dead letter
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, PARSED)

    return found.select("path", "content", "partial").mapInArrow(run, DDL)
