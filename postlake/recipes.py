"""Named prompts with arguments: what to ask of which tools, filled in from ``{{argument}}`` places."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from postlake.errors import NotFound


@dataclass(frozen=True)
class Recipe:
    name: str
    description: str
    tools: tuple[str, ...]
    prompt: str
    #: Argument names and their defaults.
    arguments: dict[str, str] = field(default_factory=dict)


RECIPES = {
    r.name: r
    for r in (
        Recipe("daily-triage", "Sort today's inbox into what to do.", ("get_inbox_overview", "get_needs_response", "get_awaiting_reply"), "Look at the inbox of {{account}}: counts, messages that want an answer, answers that are due. Propose what to do first.", {"account": "all accounts"}),
        Recipe("inbox-zero", "Empty the inbox step by step.", ("get_emails", "move_email", "update_email_status"), "List the inbox of {{account}}, {{count}} messages at a time; propose for each group to archive, answer or delete, and wait for a yes.", {"account": "all accounts", "count": "20"}),
        Recipe("awaiting-reply", "Find sent messages nobody answered.", ("get_awaiting_reply",), "List sent messages of the last {{days_back}} days that wait for an answer, longest first; draft a reminder for each that needs one.", {"days_back": "7"}),
        Recipe("weekly-review", "What the week brought.", ("get_statistics", "get_top_senders", "get_inbox_overview"), "Sum up the last {{days}} days: volume, busiest senders, open threads.", {"days": "7"}),
        Recipe("thread-catchup", "Catch up with one thread.", ("get_email_thread",), "Read the thread of {{message_id}} in order: who said what, what was decided, what is open.", {"message_id": ""}),
    )
}


def render(name: str, **values: str) -> str:
    """The prompt with its arguments, or their defaults, filled in."""
    if name not in RECIPES:
        raise NotFound(f"no recipe {name!r}")
    r = RECIPES[name]
    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values.get(m[1]) or r.arguments.get(m[1], "")), r.prompt)
