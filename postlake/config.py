"""Settings: defaults, then a TOML file, then the environment (``POSTLAKE_<SECTION>_<KEY>``), then what the caller gives."""

from __future__ import annotations

import copy
import json
import tomllib
from pathlib import Path

from postlake.errors import InvalidArgument

#: Sections, keys and their defaults.
DEFAULTS: dict[str, dict] = {
    "defaults": {"account": None, "mailbox": "INBOX"},
    "index": {"path": "", "max_emails": None, "staleness_hours": 24.0, "exclude_mailboxes": ["Drafts"], "include_mailboxes": None, "exclude_accounts": [], "enable_trigram": False},
    "server": {"read_only": False},
    "batch_limits": {"move": 1, "status": 10, "trash": 5, "delete": 1},
    "confirmation": {"require_confirm": ["permanent_delete", "empty_trash", "delete_rule"]},
    "embeddings": {"enabled": False, "backend": "", "model": None},
    "attachments": {"enabled": False, "max_bytes": 20 << 20},
    "timeouts": {"call_sec": 20.0, "http_sec": 15.0},
}


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, section by section; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _value(text: str, like: object) -> object:
    """Text as a value of the default's kind."""
    if isinstance(like, bool):
        if text.strip().lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off", ""):
            raise InvalidArgument(f"{text!r} is neither true nor false")
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)):
        return type(like)(text)
    if isinstance(like, list):
        try:
            made = json.loads(text)
            return made if isinstance(made, list) else [text]
        except ValueError:
            return [x.strip() for x in text.split(",") if x.strip()]
    return text


def from_environment(environment: dict[str, str]) -> dict:
    out: dict[str, dict] = {}
    for section, keys in DEFAULTS.items():
        for key, like in keys.items():
            text = environment.get(f"POSTLAKE_{section}_{key}".upper())
            if text is not None:
                out.setdefault(section, {})[key] = _value(text, like)
    return out


def load(path: str | None = None, environment: dict[str, str] | None = None, given: dict | None = None) -> dict:
    """All settings; unknown sections and keys are errors."""
    out = DEFAULTS
    if path and Path(path).is_file():
        out = merged(out, tomllib.loads(Path(path).read_text()))
    out = merged(merged(out, from_environment(environment or {})), given or {})
    for section, keys in out.items():
        if section not in DEFAULTS or set(keys) - set(DEFAULTS[section]):
            raise InvalidArgument(f"unknown settings in {section!r}")
    return out
