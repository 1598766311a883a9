"""One object for a message store with the tools of a mail assistant: reading, search, knowledge, guarded changes.

Each method is a thin call of an operator; results are DataFrames, or small values where one row is meant. Changes are
committed as a new version of the store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import config as settings
from postlake.errors import InvalidArgument, NotFound
from postlake.functions import text as fn
from postlake.operators import actions, analytics, embedding, export, index, search, segments, store, threads, triage
from postlake.operators.filters import predicate
from postlake.sources import attachments, mail
from postlake.streaming.watch import Watch

#: Columns of the index and their weights.
COLUMNS = {"subject": "subject", "sender": "index_sender", "recipients": "index_recipients", "body": "body_plain", "attachments": "index_attachments"}
WEIGHTS = {"subject": 10.0, "sender": 8.0, "recipients": 4.0, "body": 1.0, "attachments": 3.0}
#: Columns whose substrings are indexed, where the settings want it; rows a share of background work takes.
GRAMS, SHARE = ("subject", "sender", "body"), 128


def indexed(emails: DataFrame) -> DataFrame:
    """The messages as the index takes them: a sender's name and address in one field, recipients, names and text of attachments."""
    people = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string,addr:string>>")), lambda p: F.concat_ws(" ", p["name"], p["addr"])), " ")
    return emails.select(
        F.col("id").alias("doc_id"), "subject", "body_plain", fn.index_text(F.col("sender_name"), F.col("sender_addr")).alias("index_sender"),
        fn.index_text(people("recipients_to"), people("recipients_cc")).alias("index_recipients"), fn.index_text(F.array_join("attachments", " "), F.col("attachment_text")).alias("index_attachments"),
    )


class Mailbox:
    """A store, its index and its settings."""

    def __init__(self, kept: store.Store, root: str, config: dict | None = None, clock: Callable[[], int] = lambda: int(time.time()), embedded: DataFrame | None = None, embed=None):
        self.store, self.root, self.config, self.clock = kept, root, config or settings.load(), clock
        self.embedded, self.embed, self.index = embedded, embed, None
        self._index_at = f"{kept.path}/index"

    @property
    def emails(self) -> DataFrame:
        found = self.store.emails()
        if found is None:
            raise NotFound("the store has not been built")
        return found

    def _account(self, account: str | None) -> str | None:
        return account or self.config["defaults"]["account"]

    def _gates(self, kind: str | None = None, **given) -> dict:
        cap = self.config["batch_limits"].get(kind) if kind else None
        return {"read_only": self.config["server"]["read_only"], "confirmed_ops": frozenset(self.config["confirmation"]["require_confirm"]), **({"cap": cap} if cap else {}), **given}

    # Index
    def _disk(self) -> dict:
        """What of the mail tree the settings leave."""
        own = self.config["index"]
        return {"exclude": own["exclude_mailboxes"], "include": own["include_mailboxes"], "without": own["exclude_accounts"], "most": own["max_emails"]}

    def build(self, names: DataFrame | None = None, **options) -> store.Built:
        built = store.build(self.store, self.root, self.clock(), names=names, **self._disk(), **options)
        self.level()
        return built

    def level(self, _: store.Store | None = None) -> index.Index:
        """Brings the index to the store's newest version: a segment with what changed since, or a new index where that is not known any more."""
        spark, grams = self.store.spark, GRAMS if self.config["index"]["enable_trigram"] else ()
        with self.store.lock:
            version, held = self.store.versions()[-1], segments.opened(spark, self._index_at)
            delta = self.store.delta(held.upto, version) if held and (held.columns, held.grams) == (COLUMNS, grams) else None
            if delta is None:
                held = index.build(indexed(self.emails), COLUMNS, self._index_at, WEIGHTS, grams=grams, upto=version)
            elif held.upto < version:
                new = indexed(self.emails.join(delta.where("change = 'put'").select("id").distinct(), "id", "left_semi"))
                held = index.updated(held, new, delta.where("change = 'gone'").select(F.col("id").alias("doc_id")), version) if delta.limit(1).count() else segments.committed(replace(held, upto=version), spark)
                held = index.upkeep(held, spark)
            self.index = held
        return held

    def watch(self) -> Watch:
        """A loop that keeps store and index current, with background work as the settings want it."""
        work = (*((self.extract,) if self.config["attachments"]["enabled"] else ()), *((self.embed_pending,) if self.embed is not None and hasattr(self.embed, "label") else ()))
        return Watch(self.store, self.root, self.clock, level=(), background=work, optimize=lambda _: index.upkeep(self.level(), self.store.spark), build=self.build)

    def extract(self, _: store.Store | None = None, newest: int = SHARE) -> None:
        """Texts of attachments of the newest pending messages, a bounded share of them."""
        with self.store.lock:
            old = self.emails
            pending = (F.col("extract_state") == attachments.PENDING) & (F.col("attachment_count") > 0)
            todo = [r["path"] for r in old.where(pending).orderBy(F.desc_nulls_last("date_received"), "path").limit(newest).select("path").collect()]
            if not todo:
                return
            most = self.config["attachments"]["max_bytes"]
            new = attachments.extracted(old, mail.files(self.store.spark, todo), newest, most, attachments.beside(self.store.spark, todo))
            put = new.where(F.col("path").isin(todo)).select("id", F.lit("put").alias("change"))
            self.store.commit(new, delta=put)
            self.level()

    def embed_pending(self, _: store.Store | None = None, batches: int = 2) -> None:
        """Vectors of the newest pending messages by the backend ``embed``, so many batches of them; another backend than before starts over."""
        with self.store.lock:
            old, vectors = embedding.invalidated(self.emails, self.store.vectors(), self.store.state().get("backend"), self.embed)
            if old.where(F.col("embed_state") == embedding.PENDING).limit(1).count():
                new, vectors = embedding.backfill(old, vectors, self.embed, batches)
                self.store.commit(new, state={"backend": self.embed.label}, vectors=vectors)

    def status(self) -> dict:
        own = self._disk()
        return store.status(self.store, self.root, self.clock(), own["exclude"], own["include"], own["without"], 3600 * self.config["index"]["staleness_hours"])

    # Reading
    def list_accounts(self) -> DataFrame:
        return analytics.accounts(self.emails)

    def list_mailboxes(self, account: str | None = None) -> DataFrame:
        return analytics.mailboxes(self.emails.where(predicate(account=self._account(account))))

    def get_emails(self, filter: str = "all", account: str | None = None, mailbox: str | None = None, limit: int = 50, **where) -> DataFrame:
        return analytics.listing(self.emails, filter, self.clock(), limit, account=self._account(account), mailbox=mailbox or self.config["defaults"]["mailbox"], **where)

    def _newest(self, message_id: str, account: str | None = None, mailbox: str | None = None) -> DataFrame:
        m = self.emails.where((F.col("message_id") == message_id) & predicate(account=account, mailbox=mailbox))
        return m.orderBy(F.desc_nulls_last("date_received"), "id").limit(1)

    def get_email(self, message_id: str, account: str | None = None, mailbox: str | None = None) -> DataFrame:
        return analytics.full(self._newest(message_id, account, mailbox))

    def get_email_links(self, message_id: str) -> DataFrame:
        return self._newest(message_id).select(F.explode(fn.links(F.coalesce("body_html", F.lit("")))).alias("url"))

    def get_email_attachment(self, message_id: str, name: str) -> DataFrame:
        row = self._newest(message_id).select("path").first()
        if row is None:
            raise NotFound(f"no message {message_id!r}")
        return attachments.one(mail.files(self.store.spark, [row["path"]]), row["path"], name)

    def save_email_attachment(self, message_id: str, name: str, path: str, home: str | None = None) -> int:
        return export.save_attachment(self.get_email_attachment(message_id, name), path, home)

    def export_emails(self, folder: str, output_format: str = "txt", max_emails: int | None = None, account: str | None = None, mailbox: str | None = None) -> int:
        return export.export(self.emails.where(predicate(account=account, mailbox=mailbox)), folder, output_format, max_emails)

    def search(self, query: str, account: str | None = None, **options) -> search.Found:
        if self.index is None or self.index.upto != self.store.versions()[-1]:
            self.level()
        account = self._account(account)
        embed = (lambda q: self.embed.embed([q])[0]) if hasattr(self.embed, "embed") else self.embed
        embedded = self.store.vectors() if self.embedded is None and hasattr(self.embed, "embed") else self.embedded
        return search.search(self.emails, self.index, query, embedded=embedded, embed=embed, substrings=self.config["index"]["enable_trigram"], **options, **({"account": account} if account else {}))

    def get_email_thread(self, message_id: str | None = None, thread_id: int | None = None) -> DataFrame:
        placed = self.emails.select("id", "thread_id", F.col("thread_position").alias("position"), F.col("thread_depth").alias("depth"))
        return threads.fetch(self.emails.drop("thread_id", "thread_position", "thread_depth"), placed, message_id, thread_id)

    def get_email_thread_tree(self, message_id: str | None = None, thread_id: int | None = None) -> list[dict]:
        """One thread as nested messages."""
        rows = self.get_email_thread(message_id, thread_id).select("message_id", F.coalesce(F.nullif("account_name", F.lit("")), "account_uuid").alias("account"), F.col("mailbox_name").alias("mailbox"), "subject", F.col("sender_addr").alias("sender"), F.col("date_received").alias("date"), "is_read", "snippet", "position", "depth")
        return threads.nested([r.asDict() for r in rows.collect()])

    # Knowledge
    def get_inbox_overview(self, account: str | None = None) -> dict[str, DataFrame]:
        return analytics.overview(self._with_recipient(), self.clock(), self._account(account))

    def _with_recipient(self) -> DataFrame:
        return self.emails.withColumn("recipient", F.get("recipients_to", F.lit(0))["addr"])

    def get_awaiting_reply(self, days_back: int = 7, account: str | None = None) -> DataFrame:
        return triage.awaiting_reply(self._with_recipient(), self.clock(), days_back, self._account(account))

    def get_needs_response(self, days_back: int = 7, account: str | None = None) -> DataFrame:
        return triage.needs_response(self.emails, self.clock(), days_back, self._account(account))

    def get_top_senders(self, limit: int = 10, account: str | None = None, mailbox: str | None = None, since: int | None = None) -> DataFrame:
        return analytics.top_senders(self.emails, limit, since, account=self._account(account), mailbox=mailbox)

    def get_statistics(self, scope: str = "account_overview", sender: str | None = None, days_back: int = 30, account: str | None = None) -> DataFrame:
        if scope == "account_overview":
            return analytics.account_overview(self.emails, self.clock(), days_back, self._account(account))
        if scope == "sender_stats" and sender:
            return analytics.sender_statistics(self.emails, sender, self.clock(), days_back)
        if scope == "mailbox_breakdown":
            return analytics.mailbox_breakdown(self.emails)
        raise InvalidArgument(f"unknown scope {scope!r}, or no sender")

    def list_contacts(self, query: str | None = None, limit: int = 100, account: str | None = None) -> DataFrame:
        return triage.contacts_of(self.emails, query, limit, account=self._account(account))

    def get_contact(self, address: str) -> tuple[DataFrame, DataFrame]:
        return triage.contact(self.emails, address), triage.contact_newest(self.emails, address)

    # Changes
    def _done(self, change: Callable[[], actions.Outcome]) -> actions.Outcome:
        with self.store.lock:
            out = change()
            if out.emails is not None:
                journal = actions.pruned(actions.appended(self.journal(), out.journal)) if out.journal is not None else None
                gone = self.emails.select("id").join(out.emails.select("id"), "id", "left_anti").withColumn("change", F.lit("gone")) if out.journal is None else None
                self.store.commit(out.emails, journal=journal, delta=gone)
        return out

    def journal(self) -> DataFrame:
        return self.store.journal()

    def move_email(self, ids: list[int], mailbox: str, to_account: str | None = None, **given) -> actions.Outcome:
        """To a mailbox of the same account, or of another one by its id or name."""
        role = self.store.spark.range(1).select(fn.mailbox_role(F.lit(mailbox))).first()[0]
        account = None
        if to_account is not None:
            account = self.emails.where((F.col("account_uuid") == to_account) | (F.col("account_name") == to_account)).select("account_uuid", "account_name").first()
            if account is None:
                raise NotFound(f"no account {to_account!r}")
        return self._done(lambda: actions.move(self.emails, ids, mailbox, role, self.clock(), account and tuple(account), **self._gates("move", **given)))

    def update_email_status(self, ids: list[int], action: str, color: str | None = None, **given) -> actions.Outcome:
        return self._done(lambda: actions.status(self.emails, ids, action, self.clock(), color, **self._gates("status", **given)))

    def manage_trash(self, action: str, ids: list[int] = (), account: str | None = None, **given) -> actions.Outcome:
        if action == "trash":
            return self._done(lambda: actions.trash(self.emails, list(ids), self.clock(), **self._gates("trash", **given)))
        if action == "permanent_delete":
            return self._done(lambda: actions.delete(self.emails, list(ids), **self._gates("delete", **given)))
        if action == "empty_trash":
            return self._done(lambda: actions.empty_trash(self.emails, account, **self._gates(**given)))
        raise InvalidArgument(f"unknown action {action!r}")

    def undo_last(self, batch: str | None = None, dry_run: bool = False) -> None:
        with self.store.lock:
            emails, journal = actions.undo(self.emails, self.journal(), batch, self.config["server"]["read_only"], dry_run)
            if not dry_run:
                self.store.commit(emails, journal=journal)

    # What is written here; sending is for a mail program that reads the outbox.
    def _put(self, outbox: Callable[[DataFrame], DataFrame], op: str, **given) -> bool:
        gates = {k: v for k, v in self._gates(**given).items() if k != "cap"}
        if not actions.gate(op, **gates):
            return False
        with self.store.lock:
            self.store.commit(self.emails, outbox=outbox(self.store.outbox()))
        return True

    def compose_email(self, to: list[str], subject: str, body: str, cc: list[str] = (), bcc: list[str] = (), mode: str = "draft", body_html: str | None = None, **given) -> str:
        """The new message's name in the outbox. ``mode``: send (queued), draft or open."""
        name = uuid.uuid4().hex
        self._put(lambda o: actions.written(o, name, mode, self.clock(), to, subject, body, cc, bcc, body_html), "compose", **given)
        return name

    def create_rich_email_draft(self, html_body: str, subject: str = "", to: list[str] = (), text_body: str = "", cc: list[str] = (), bcc: list[str] = (), outbox: str | None = None, **given) -> str:
        """A draft with an HTML part, never queued; with ``outbox``, a local folder, also as a file to open."""
        name = self.compose_email(list(to), subject, text_body, cc, bcc, "open", html_body, **given)
        return str(export.put_in_outbox(export.draft(subject, list(to), text_body, html_body, cc, bcc), outbox)) if outbox else name

    def _answer(self, row: DataFrame, mode: str, cc: list[str], bcc: list[str], op: str, **given) -> DataFrame:
        if mode not in actions.MODES:
            raise InvalidArgument(f"unknown mode {mode!r}")
        name = uuid.uuid4().hex
        full = row.select(F.lit(name).alias("draft"), F.lit(mode).alias("mode"), "to", *(F.array(*map(F.lit, x)).cast("array<string>").alias(k) for k, x in (("cc", cc), ("bcc", bcc))), "subject", "in_reply_to", "references", "body", F.lit(None).cast("string").alias("body_html"), F.lit(self.clock()).cast("long").alias("created"))
        self._put(lambda o: o.unionByName(full), op, **given)
        return row

    def reply_to_email(self, id: int, body: str, to_all: bool = False, mode: str = "draft", cc: list[str] = (), bcc: list[str] = (), **given) -> DataFrame:
        return self._answer(actions.answer(self.emails, id, body, to_all), mode, list(cc), list(bcc), "reply", **given)

    def forward_email(self, id: int, to: list[str], body: str = "", mode: str = "draft", cc: list[str] = (), bcc: list[str] = (), **given) -> DataFrame:
        return self._answer(actions.answer(self.emails, id, body, forward_to=to), mode, list(cc), list(bcc), "forward", **given)

    def manage_drafts(self, action: str = "list", limit: int = 50, draft_subject: str | None = None, **written) -> DataFrame:
        """list, create (see ``compose_email``), open, send (queues), delete; the last three by a draft's subject."""
        if action == "list":
            mine = self.store.outbox().where("mode <> 'send'").select("draft", "subject", F.col("created").alias("date"))
            return actions.drafts(self.emails, limit).select(F.col("id").cast("string").alias("draft"), "subject", F.col("date_received").alias("date")).unionByName(mine).orderBy(F.desc_nulls_last("date"), "draft").limit(limit)
        if action == "create":
            name = self.compose_email(written.pop("to", []), written.pop("subject", ""), written.pop("body", ""), **written)
            return self.store.outbox().where(F.col("draft") == name)
        found = actions.found_draft(self.store.outbox(), draft_subject or "")
        if action in ("send", "delete"):
            hit = F.col("draft") == found.first()["draft"]
            self._put(lambda o: o.where(~hit) if action == "delete" else o.withColumn("mode", F.when(hit, "send").otherwise(F.col("mode"))), f"draft_{action}", **written)
        elif action != "open":
            raise InvalidArgument(f"unknown action {action!r}")
        return found

    # Rules and mailboxes
    def list_rules(self) -> DataFrame:
        return self.store.rules().orderBy("name")

    def set_rules(self, rules: DataFrame) -> None:
        """Takes over the rules of a mail program."""
        self.store.commit(self.emails, rules=rules.select(*(c.split()[0] for c in actions.RULES.split(", "))))

    def _rules(self, change: Callable[[DataFrame, dict], DataFrame], **given) -> None:
        with self.store.lock:
            self.store.commit(self.emails, rules=change(self.store.rules(), {k: v for k, v in self._gates(**given).items() if k != "cap"}))

    def enable_rule(self, name: str, **given) -> None:
        self._rules(lambda r, g: actions.set_rule(r, name, True, **g), **given)

    def disable_rule(self, name: str, **given) -> None:
        self._rules(lambda r, g: actions.set_rule(r, name, False, **g), **given)

    def delete_rule(self, name: str, **given) -> None:
        self._rules(lambda r, g: actions.delete_rule(r, name, **g), **given)

    def create_mailbox(self, account: str, name: str, parent: str | None = None, **given) -> DataFrame:
        """All mailboxes, with the new one and those it lies in."""
        known = self.emails.select("account_uuid", "mailbox_name", "mailbox_role").unionByName(self.store.mailboxes()).distinct()
        with self.store.lock:
            every = actions.create_mailbox(known, account, name, parent, **{k: v for k, v in self._gates(**given).items() if k != "cap"})
            self.store.commit(self.emails, mailboxes=every)
        return self.store.mailboxes()

    def unsubscribe_from_sender(self, message_id: str) -> DataFrame:
        m = self._newest(message_id)
        how = mail.unsubscribe_decision(F.col("unsubscribe_https"), F.col("unsubscribe_mailto"), F.col("one_click"))
        return m.select(how.alias("method"), F.when(how == "one-click-post", F.get("unsubscribe_https", F.lit(0))).when(how == "mailto", F.col("unsubscribe_mailto")).alias("target"))

    def resource(self, uri: str) -> DataFrame:
        """The rows behind an ``email://`` address."""
        name, _, rest = uri.removeprefix("email://").partition("/")
        found = {
            "accounts": lambda: self.list_accounts(), "mailboxes": lambda: self.list_mailboxes(rest or None), "threads": lambda: self.get_email_thread(thread_id=int(rest)), "message": lambda: self.get_email(rest),
            "contacts": lambda: self.get_contact(rest)[0] if rest else self.list_contacts(), "inbox-summary": lambda: self.get_inbox_overview()["counts"], "awaiting-reply": lambda: self.get_awaiting_reply(),
            "needs-response": lambda: self.get_needs_response(), "stats": lambda: self.get_statistics(),
        }
        if name not in found:
            raise NotFound(f"no resource {uri!r}")
        return found[name]()
