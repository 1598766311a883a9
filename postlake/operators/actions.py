"""Guarded, journaled, reversible changes of message rows. Every change is a plan over the store, never row by row."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.errors import BatchTooLarge, ConfirmationRequired, InvalidArgument, NotFound, ReadOnly
from postlake.functions import text as fn
from postlake.operators.filters import color_index

#: Rows one call may change, by action; and the actions that want a confirmation.
CAPS = {"move": 10, "status": 10, "trash": 5, "permanent_delete": 1}
CONFIRM = frozenset({"permanent_delete", "empty_trash", "delete_rule"})
JOURNAL = "batch string, seq long, ts long, op string, id long, prev string, undone boolean"
OUTBOX = "draft string, mode string, `to` array<string>, cc array<string>, bcc array<string>, subject string, in_reply_to string, `references` array<string>, body string, body_html string, created long"
RULES, MAILBOXES = "name string, enabled boolean, conditions string, actions string", "account_uuid string, mailbox_name string, mailbox_role string"
#: What may become of a message that was written: queued for a mail program, kept, or kept and shown.
MODES = ("send", "draft", "open")
STATES = {"mark_read": {"is_read": True}, "mark_unread": {"is_read": False}, "flag": {"is_flagged": True}, "unflag": {"is_flagged": False, "flag_color": None}}
#: Actions whose journal rows can be taken back.
UNDOABLE = frozenset({"move", "status", "trash"})


@dataclass
class Outcome:
    """What a call did, or would do; ``failed`` names what was asked for and why it was not done."""

    op: str
    n: int
    dry_run: bool
    batch: str | None = None
    emails: DataFrame | None = None
    journal: DataFrame | None = None
    preview: list[int] = field(default_factory=list)
    failed: dict[int, str] = field(default_factory=dict)


def gate(op: str, *, read_only: bool = False, dry_run: bool = False, confirm: bool = False, confirmed_ops: frozenset[str] = CONFIRM) -> bool:
    """Whether to go on, for actions on other things than messages; False for a dry run. ``confirmed_ops`` want a confirmation."""
    if read_only:
        raise ReadOnly(op)
    if dry_run:
        return False
    if op in confirmed_ops and not confirm:
        raise ConfirmationRequired(op)
    return True


def guard(emails: DataFrame, op: str, ids: list[int], *, read_only: bool = False, dry_run: bool = False, confirm: bool = False, cap: int | None = None, confirmed_ops: frozenset[str] = CONFIRM) -> list[int]:
    """Read-only, cap against the rows that exist, confirmation: in this order. Never truncates."""
    if read_only:
        raise ReadOnly(op)
    most = min(CAPS.get(op, 10), cap) if cap else CAPS.get(op, 10)
    wanted = emails.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long") if ids else emails.select("id").limit(0)
    # One row beyond the cap is enough to know; only as many ids come to the driver.
    found = sorted(r[0] for r in emails.select("id").join(wanted, "id", "left_semi").distinct().limit(most + 1).collect())
    if len(found) > most:
        raise BatchTooLarge(f"over {most} of the {len(ids)} messages asked for exist, at most {most} may be changed")
    if op in confirmed_ops and not confirm and not dry_run:
        raise ConfirmationRequired(op)
    return found


def change(emails: DataFrame, op: str, ids: list[int], values: dict, now: int, **gates) -> Outcome:
    """Sets ``values`` on the rows and journals what they were; ids without a row are reported, the others go through.

    Journal rows get their place among other batches by ``appended``.
    """
    found = guard(emails, op, ids, **gates)
    failed = {i: NotFound.code for i in ids if i not in set(found)}
    if gates.get("dry_run") or not found:
        return Outcome(op, len(found), bool(gates.get("dry_run")), preview=found, failed=failed)
    hit, batch = F.col("id").isin(found), uuid.uuid4().hex
    prev = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    journal = emails.where(hit).select(F.lit(batch).alias("batch"), F.lit(0).cast("long").alias("seq"), F.lit(now).cast("long").alias("ts"), F.lit(op).alias("op"), "id", prev.alias("prev"), F.lit(False).alias("undone"))
    types = dict(emails.dtypes)
    new = emails.withColumns({c: F.when(hit, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})
    return Outcome(op, len(found), False, batch, new, journal, found, failed)


def move(emails: DataFrame, ids: list[int], mailbox: str, role: str, now: int, account: tuple[str, str | None] | None = None, **gates) -> Outcome:
    """``account``: uuid and name of another account, for moves across accounts."""
    there = {"account_uuid": account[0], "account_name": account[1]} if account else {}
    return change(emails, "move", ids, {"mailbox_name": mailbox, "mailbox_role": role} | there, now, **gates)


def status(emails: DataFrame, ids: list[int], state: str, now: int, color: str | None = None, **gates) -> Outcome:
    """mark_read, mark_unread, flag, unflag, or set_flag_color with a colour."""
    if state == "set_flag_color":
        return change(emails, "status", ids, {"is_flagged": True, "flag_color": color_index(color or "")}, now, **gates)
    if state not in STATES:
        raise InvalidArgument(f"unknown state {state!r}")
    return change(emails, "status", ids, STATES[state], now, **gates)


def trash(emails: DataFrame, ids: list[int], now: int, **gates) -> Outcome:
    return change(emails, "trash", ids, {"mailbox_name": "Trash", "mailbox_role": "trash"}, now, **gates)


def delete(emails: DataFrame, ids: list[int], **gates) -> Outcome:
    found = guard(emails, "permanent_delete", ids, **gates)
    return Outcome("permanent_delete", len(found), bool(gates.get("dry_run")), emails=None if gates.get("dry_run") else emails.where(~F.col("id").isin(found)), preview=found, failed={i: NotFound.code for i in ids if i not in set(found)})


def empty_trash(emails: DataFrame, account: str | None = None, **gates) -> Outcome:
    """All messages in the trash of one account, or of all, go for good."""
    hit = F.col("mailbox_role") == "trash"
    if account is not None:
        hit = hit & ((F.col("account_uuid") == account) | (F.col("account_name") == account))
    on = gate("empty_trash", **gates)
    return Outcome("empty_trash", emails.where(hit).count(), not on, emails=emails.where(~F.coalesce(hit, F.lit(False))) if on else None)


def undo(emails: DataFrame, journal: DataFrame, batch: str | None = None, read_only: bool = False, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The store and the journal after the newest batch that can be taken back (or the given one) is.

    One join with the journal; rows that are gone by now stay open in the journal.
    """
    if read_only:
        raise ReadOnly("undo")
    open_rows = journal.where(~F.col("undone") & F.col("op").isin(*sorted(UNDOABLE)))
    if batch is None:
        newest = batches(open_rows, 1).first()
        batch = newest["batch"] if newest else None
    if batch is None or dry_run:
        return emails, journal
    rows = open_rows.where(F.col("batch") == batch)
    columns = sorted({c for values in (*STATES.values(), {"mailbox_name": 0, "mailbox_role": 0, "account_uuid": 0, "account_name": 0}) for c in values} & set(emails.columns))
    types = dict(emails.dtypes)
    kept = rows.groupBy("id").agg(F.min_by("prev", F.struct("seq", "ts")).alias("_prev"))
    # A batch holds no more rows than a call may change.
    joined = emails.join(F.broadcast(kept), "id", "left").withColumn("_had", F.json_object_keys("_prev"))
    back = {c: F.when(F.array_contains(F.coalesce("_had", F.array().cast("array<string>")), c), F.get_json_object("_prev", f"$.{c}").cast(types[c])).otherwise(F.col(c)) for c in columns}
    done = rows.select("batch", "id").join(emails.select("id"), "id", "left_semi").withColumn("_done", F.lit(True))
    after = journal.join(F.broadcast(done), ["batch", "id"], "left").withColumn("undone", F.col("undone") | F.coalesce("_done", F.lit(False))).select(*journal.columns)
    return joined.withColumns(back).select(*emails.columns), after


def undo_failures(emails: DataFrame, journal: DataFrame, batch: str) -> DataFrame:
    """id, error of the rows of a batch that cannot be taken back."""
    return journal.where((F.col("batch") == batch) & ~F.col("undone")).join(emails.select("id"), "id", "left_anti").select("id", F.lit(NotFound.code).alias("error"))


def appended(journal: DataFrame, new: DataFrame) -> DataFrame:
    """The journal with a new batch behind all others, whatever the clock says: batches are in the order of ``seq``."""
    last = journal.agg(F.max("seq")).first()[0] or 0
    return journal.unionByName(new.withColumn("seq", F.lit(last + 1).cast("long")))


def batches(journal: DataFrame, most: int = 500) -> DataFrame:
    """batch, seq, ts of the newest batches, which retention keeps. The clock decides only between batches that were never appended."""
    return journal.groupBy("batch").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts")).orderBy(F.desc("seq"), F.desc("ts"), F.desc("batch")).limit(most)


def pruned(journal: DataFrame, most: int = 500) -> DataFrame:
    return journal.join(batches(journal, most).select("batch"), "batch", "left_semi")


def candidates(targets: DataFrame, hints: DataFrame, cache: DataFrame, emails: DataFrame) -> DataFrame:
    """target, id, priority: a caller's hint (0), the last verified place (1), the newest copy known (2), any copy (3).

    ``targets``: target (message id); ``hints``: target, id; ``cache``: target, id, verified_at. Ids whose message has another id now do not count.
    """
    last = cache.groupBy("target").agg(F.max_by("id", F.struct("verified_at", "id")).alias("id"))
    held = emails.select("id", F.col("message_id").alias("target"), "date_received")
    newest = held.groupBy("target").agg(F.max_by("id", F.struct(F.coalesce("date_received", F.lit(0)), -F.col("id"))).alias("id"))
    every = hints.select("target", "id", F.lit(0).alias("priority")).unionByName(last.select("target", "id", F.lit(1).alias("priority"))).unionByName(newest.select("target", "id", F.lit(2).alias("priority"))).unionByName(held.select("target", "id", F.lit(3).alias("priority")))
    true = every.join(held.select("target", "id"), ["target", "id"], "left_semi").dropDuplicates(["target", "id", "priority"])
    return targets.select("target").distinct().join(true, "target", "left")


def resolve(candidates: DataFrame) -> DataFrame:
    """target, status (found, not_found, multiple), id. Candidates: target, id (may be null), priority; the least priority that has any wins."""
    best = candidates.where("id is not null").groupBy("target").agg(F.min("priority").alias("priority"))
    hit = candidates.where("id is not null").join(best, ["target", "priority"]).groupBy("target").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    s = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "multiple").otherwise("found")
    return candidates.select("target").distinct().join(hit, "target", "left").select("target", s.alias("status"), F.when(s == "found", F.col("id")).alias("id"))


def create_mailbox(mailboxes: DataFrame, account: str, name: str, parent: str | None = None, **gates) -> DataFrame:
    """The mailboxes (account_uuid, mailbox_name, mailbox_role) with a new one and those it lies in; nested by `/`."""
    if not gate("create_mailbox", **gates):
        return mailboxes
    parts = [p for p in f"{parent or ''}/{name}".split("/") if p]
    if not parts:
        raise InvalidArgument("a mailbox needs a name")
    new = mailboxes.sparkSession.createDataFrame([(account, "/".join(parts[: k + 1])) for k in range(len(parts))], "account_uuid string, mailbox_name string")
    new = new.withColumn("mailbox_role", fn.mailbox_role(F.element_at(F.split("mailbox_name", "/"), -1))).join(mailboxes, ["account_uuid", "mailbox_name"], "left_anti")
    return mailboxes.select("account_uuid", "mailbox_name", "mailbox_role").unionByName(new.select("account_uuid", "mailbox_name", "mailbox_role"))


def found_mailbox(mailboxes: DataFrame, hint: str) -> DataFrame:
    """The mailboxes that a name or one of its aliases means: exact name first, then names of its role."""
    role = next((r for r, names in fn.ROLES.items() if hint.strip().lower() in names), None)
    exact = F.lower("mailbox_name") == hint.strip().lower()
    alias = F.lower("mailbox_name").isin(*fn.ROLES[role]) if role else F.lit(False)
    ranked = mailboxes.where(exact | alias).withColumn("_rank", F.when(exact, 0).otherwise(1))
    return ranked.orderBy("account_uuid", "_rank", "mailbox_name").dropDuplicates(["account_uuid"]).drop("_rank")


def set_rule(rules: DataFrame, name: str, enabled: bool, **gates) -> DataFrame:
    """The rules (name, enabled, ...) with one switched on or off."""
    _one_rule(rules, name)
    return rules.withColumn("enabled", F.when(F.col("name") == name, F.lit(enabled)).otherwise(F.col("enabled"))) if gate("set_rule", **gates) else rules


def delete_rule(rules: DataFrame, name: str, **gates) -> DataFrame:
    _one_rule(rules, name)
    return rules.where(F.col("name") != name) if gate("delete_rule", **gates) else rules


def _one_rule(rules: DataFrame, name: str) -> None:
    if not rules.where(F.col("name") == name).limit(1).count():
        raise NotFound(f"no rule {name!r}")


def drafts(emails: DataFrame, limit: int = 50) -> DataFrame:
    """Messages in drafts mailboxes, newest first."""
    return emails.where("mailbox_role = 'drafts'").orderBy(F.desc_nulls_last("date_received"), "id").limit(limit)


def answer(emails: DataFrame, id: int, body: str, to_all: bool = False, forward_to: list[str] | None = None) -> DataFrame:
    """The outbox row of a reply or a forward: to, subject, in_reply_to, references, body with the quoted text. Nothing is sent."""
    m = emails.where(F.col("id") == id)
    bare = F.regexp_replace("subject", rf"(?i)^(\s*({fn.PREFIXES})\s*(\[\d+\])?\s*:\s*)+", "")
    quoted = F.concat(F.lit(f"{body}\n\n"), F.regexp_replace(F.coalesce("body_plain", F.lit("")), r"(?m)^", "> "))
    own = F.array("sender_addr")
    to = F.array(*map(F.lit, forward_to)) if forward_to else F.array_distinct(F.concat(own, F.coalesce("recipients", F.array().cast("array<string>")))) if to_all else own
    refs = F.array_distinct(F.concat(F.coalesce("references", F.array().cast("array<string>")), F.array("message_id")))
    return m.select(to.alias("to"), F.concat(F.lit("Fwd: " if forward_to else "Re: "), bare).alias("subject"), F.when(F.lit(not forward_to), F.col("message_id")).alias("in_reply_to"), (F.when(F.lit(not forward_to), refs)).alias("references"), quoted.alias("body"))


def written(outbox: DataFrame, draft: str, mode: str, now: int, to: list[str], subject: str, body: str, cc: list[str] = (), bcc: list[str] = (), body_html: str | None = None) -> DataFrame:
    """The outbox with a new message. Nothing is sent."""
    if mode not in MODES:
        raise InvalidArgument(f"unknown mode {mode!r}")
    if mode == "send" and not to:
        raise InvalidArgument("a message needs a recipient")
    row = (draft, mode, list(to), list(cc), list(bcc), subject, None, None, body, body_html, now)
    return outbox.unionByName(outbox.sparkSession.createDataFrame([row], OUTBOX))


def found_draft(outbox: DataFrame, subject: str) -> DataFrame:
    """The newest draft of a subject."""
    hit = outbox.where((F.col("subject") == subject) & (F.col("mode") != "send")).orderBy(F.desc("created"), "draft").limit(1)
    if not hit.count():
        raise NotFound(f"no draft {subject!r}")
    return hit
