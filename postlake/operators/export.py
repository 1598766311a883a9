"""Files out of messages: one text or HTML file each, attachments, drafts. Paths are checked before anything is written."""

from __future__ import annotations

import time
from email.message import EmailMessage
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postlake.errors import InvalidArgument, InvalidOutputPath, NotFound
from postlake.functions import text as fn
from postlake.sources import filesink

#: Folders nothing is written into.
SENSITIVE = frozenset({".ssh", ".gnupg", ".aws", ".config", ".kube", ".docker", "Library"})
OUTBOX_SECONDS = 3600


def files(emails: DataFrame, kind: str = "txt", most: int | None = None) -> DataFrame:
    """filename, content of each message, newest first; HTML is escaped."""
    if kind not in ("txt", "html"):
        raise InvalidArgument(f"unknown format {kind!r}")
    m = emails.orderBy(F.desc_nulls_last("date_received"), "id").limit(most) if most else emails
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if kind == "html":
        body: Column = F.concat(F.lit("<html><body><h1>"), fn.escaped(text("subject")), F.lit("</h1><pre>"), fn.escaped(text("body_plain")), F.lit("</pre></body></html>"))
    else:
        body = F.concat(F.lit("From: "), text("sender_name"), F.lit(" <"), text("sender_addr"), F.lit(">\nSubject: "), text("subject"), F.lit("\n\n"), text("body_plain"))
    return m.select(fn.email_filename(F.col("id"), F.col("subject"), kind).alias("filename"), body.alias("content"))


def export(emails: DataFrame, folder: str, kind: str = "txt", most: int | None = None) -> int:
    """Writes one file a message to a folder that the executors share, by the tasks themselves; how many."""
    spark, seen = emails.sparkSession, Observation()
    filesink.register(spark)
    rows = files(emails, kind, most)
    # The order of the newest is in their choice only; without a shuffle a task writes what it reads.
    rows.observe(seen, F.count("*").alias("n")).write.format("named_files").mode("append").save(folder)
    return seen.get["n"]


def checked(path: str, home: str | None = None) -> Path:
    """A local path under the home folder and outside sensitive folders."""
    top = Path(home).resolve() if home else Path.home().resolve()
    target = Path(path).expanduser().resolve()
    if not target.is_relative_to(top):
        raise InvalidOutputPath(f"{path!r} is not under the home folder")
    if SENSITIVE & {*target.relative_to(top).parts}:
        raise InvalidOutputPath(f"{path!r} is in a sensitive folder")
    return target


def save_attachment(rows: DataFrame, path: str, home: str | None = None) -> int:
    """Writes the one attachment in ``rows`` (data) so that only its owner can read it; its size."""
    target, found = checked(path, home), rows.select("data").limit(1).collect()
    if not found:
        raise NotFound("no such attachment")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(found[0]["data"])
    target.chmod(0o600)
    return len(found[0]["data"])


def draft(subject: str, to: list[str], text: str, html: str | None = None, cc: list[str] = (), bcc: list[str] = (), sender: str | None = None) -> EmailMessage:
    """A message with a text part and, if given, an HTML one."""
    m = EmailMessage()
    m["Subject"] = subject
    for name, value in (("From", sender), ("To", ", ".join(to)), ("Cc", ", ".join(cc)), ("Bcc", ", ".join(bcc))):
        if value:
            m[name] = value
    m.set_content(text)
    if html is not None:
        m.add_alternative(html, subtype="html")
    return m


def put_in_outbox(message: EmailMessage, outbox: str, now: float | None = None) -> Path:
    """Writes a draft to the outbox, where files over an hour old go first."""
    folder, now = Path(outbox), time.time() if now is None else now
    folder.mkdir(parents=True, exist_ok=True, mode=0o700)
    for old in folder.glob("*.eml"):
        if old.stat().st_mtime < now - OUTBOX_SECONDS:
            old.unlink(missing_ok=True)
    target = folder / f"{time.time_ns()}.eml"
    target.write_bytes(bytes(message))
    target.chmod(0o600)
    return target
