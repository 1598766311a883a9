"""Text functions of messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply and forward prefixes.
PREFIXES = "re|fw|fwd|aw|wg|sv|tr|antwort|odp|res"


def normalize_subject(s: Column) -> Column:
    bare = F.regexp_replace(F.trim(s), rf"(?i)^(\s*({PREFIXES})\s*(\[\d+\])?\s*:\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def normalize_message_id(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\s+", ""), r"^<(.*)>$", "$1")


def safe_filename(s: Column, most: int = 60) -> Column:
    return F.left(F.regexp_replace(s, r"[^A-Za-z0-9._ -]", "_"), F.lit(most))


def handle(*parts: Column) -> Column:
    """An opaque id: unpadded base64url of the parts."""
    return F.concat(F.lit("amid:v1:"), F.rtrim(F.translate(F.base64(F.concat_ws("|", *parts).cast("binary")), "+/", "-_"), F.lit("=")))


def links(html: Column) -> Column:
    """Distinct targets of anchors, first place kept, without mail, script, inline and data targets."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~F.rlike(x, F.lit(r"(?i)^(mailto|javascript|cid|data):"))))


#: Mailbox names by role.
ROLES = {
    "inbox": ("inbox",), "sent": ("sent", "sent messages", "sent items"), "drafts": ("drafts",), "trash": ("trash", "deleted messages", "bin"),
    "junk": ("junk", "junk e-mail", "spam"), "archive": ("archive", "all mail"),
}


def mailbox_role(name: Column) -> Column:
    """The role of a mailbox by its name; other for one without a name."""
    key, out = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("other")
    for role, names in ROLES.items():
        out = F.when(key.isin(*names), role).otherwise(out)
    return F.when(name.isNotNull(), out)


def email_filename(id: Column, subject: Column, kind: str = "txt") -> Column:
    """``<id>_<subject>.<kind>`` of letters, digits, blanks, hyphens and underscores; no-subject for an empty one."""
    bare = lambda s: F.left(F.regexp_replace(s, r"[^\p{L}\p{N} \-_]", ""), F.lit(60))
    none = F.lit("no-subject")
    return F.concat(id.cast("string"), F.lit("_"), F.coalesce(F.nullif(bare(F.coalesce(F.nullif(subject, F.lit("")), none)), F.lit("")), none), F.lit(f".{kind}"))


def escaped(s: Column) -> Column:
    """Text for HTML."""
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def listed_addresses(s: Column) -> Column:
    """Addresses parted by commas, without blanks and empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def index_text(*columns: Column) -> Column:
    """One index field of several columns; null ones count as empty."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))


def rounded(x: Column, digits: int = 1) -> Column:
    """For presentation: to some digits, exact ties to even, as the value is in binary."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def apple_seconds(x: Column) -> Column:
    """Seconds since 2001-01-01 UTC as Unix seconds."""
    return x + 978307200


def day_seconds(day: Column) -> Column:
    """Midnight UTC of a YYYY-MM-DD day."""
    return F.unix_date(F.to_date(day, "yyyy-MM-dd")).cast("long") * 86400
