"""Optional, AND-ed message predicates; all are plain column expressions, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.errors import InvalidArgument

#: Flag colours by index.
COLORS = ("red", "orange", "yellow", "green", "blue", "purple", "gray")
#: Fixed value: addresses that nobody reads.
NO_REPLY = r"(?i)\b(no[-._]?reply|do[-._]?not[-._]?reply|notifications?|mailer-daemon|postmaster|automated)\b"


def color_index(name: str) -> int:
    if name not in COLORS:
        raise InvalidArgument(f"unknown flag colour {name!r}")
    return COLORS.index(name)


def predicate(*, account: str | None = None, mailbox: str | None = None, before: int | None = None, after: int | None = None, unread: bool = False, flagged: bool = False, color: str | None = None, has_attachments: bool | None = None) -> Column:
    """An account by uuid or name, a mailbox by name or role; both date bounds inclusive; attachments may be either."""
    parts = [F.lit(True)]
    if account is not None:
        parts.append((F.col("account_uuid") == account) | (F.col("account_name") == account))
    if mailbox is not None:
        parts.append((F.col("mailbox_name") == mailbox) | (F.col("mailbox_role") == mailbox))
    if before is not None:
        parts.append(F.col("date_received") <= before)
    if after is not None:
        parts.append(F.col("date_received") >= after)
    if unread:
        parts.append(~F.col("is_read"))
    if flagged:
        parts.append(F.col("is_flagged"))
    if color is not None:
        parts.append(F.col("flag_color") == color_index(color))
    if has_attachments is not None:
        parts.append((F.col("attachment_count") > 0) == has_attachments)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def listed(kind: str, as_of: int) -> Column:
    """The list filters all, unread, flagged, today, last_7_days."""
    day = as_of - as_of % 86400
    kinds = {"all": F.lit(True), "unread": ~F.col("is_read"), "flagged": F.col("is_flagged"), "today": F.col("date_received") >= day, "last_7_days": F.col("date_received") >= as_of - 7 * 86400}
    if kind not in kinds:
        raise InvalidArgument(f"unknown filter {kind!r}")
    return kinds[kind]


def included(mailbox: Column, excluded: list[str]) -> Column:
    """Mailboxes that are not excluded, in any case."""
    return ~F.lower(mailbox).isin([x.lower() for x in excluded]) if excluded else F.lit(True)


def pending(state: Column, attachments: Column | None = None) -> Column:
    """A work queue: rows in state 0, and with attachments where these are the work."""
    return (state == 0) if attachments is None else (state == 0) & (attachments > 0)


def no_reply(address: Column) -> Column:
    return F.rlike(address, F.lit(NO_REPLY))
