"""Message files for tests."""

import io
import plistlib
import zipfile
from email.message import EmailMessage

ACCOUNT = "0F0E0D0C-1234-4321-8888-ABCDEFABCDEF"


def emlx(subject="Note", sender="Ann Miller <ann@mill.example>", to="Ben Carter <ben@cart.example>", body="Some words for Ben.", mid="n1@mill.example", refs=(), reply=None, flags=1, received=1_717_000_000, attachments=(), headers=()):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["Date"] = subject, sender, to, f"<{mid}>", "Wed, 29 May 2024 16:26:40 +0000"
    if reply:
        m["In-Reply-To"] = f"<{reply}>"
    if refs:
        m["References"] = " ".join(f"<{r}>" for r in refs)
    for k, v in headers:
        m[k] = v
    m.set_content(body)
    for name, data in attachments:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    raw = bytes(m)
    return b"%d\n" % len(raw) + raw + plistlib.dumps({"flags": flags, "date-received": received, "date-sent": received - 9})


def put(root, rowid, data, mailbox="INBOX", account=ACCOUNT, partial=False):
    folder = root
    for part in (account, *(f"{x}.mbox" for x in mailbox.split("/")), "Data", "Messages"):
        folder = folder / part
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{rowid}{'.partial' if partial else ''}.emlx"
    path.write_bytes(data)
    return path


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def forest(rows):
    """A forest, message by message, to compare with: one component's forest: first parent wins, links that would close a cycle are dropped, children by date.

    Rows: id, message_id, chain (its references in order), date, and subject if trees are to be merged. Yields, for
    each message, id, thread_id (of the first message in pre-order), position, depth, and for merging: the root's id
    (None for an unseen one), date and subject, and the part (0 the root, k its k-th child's branch), its date and the
    place in it. Iterative, and linear but for sorting, so a chain may be of any length.
    """
    parent = {}
    known = {}
    set_of = {}

    def find(x):
        top = x
        while set_of[top] != top:
            top = set_of[top]
        while set_of[x] != top:
            set_of[x], x = top, set_of[x]
        return top

    def link(a, b):
        # b has no parent, so it is the root of its set: a below b is a in b's set.
        if b not in parent and find(a) != find(b):
            parent[b] = a
            set_of[find(b)] = find(a)

    for r in sorted(rows, key=lambda r: r["id"]):
        known[r["message_id"]] = r
        chain = [c for c in r["chain"] if c]
        for c in (*chain, r["message_id"]):
            set_of.setdefault(c, c)
        for a, b in zip(chain, chain[1:]):
            link(a, b)
        if chain:
            link(chain[-1], r["message_id"])
    children = {}
    date = lambda m: (known[m]["date"] or 0) if m in known else 0
    for n in set_of:
        if n in parent:
            children.setdefault(parent[n], []).append(n)
    for top in (n for n in set_of if n not in parent):
        root, own = known.get(top), {}
        branches = {c: k for k, c in enumerate(sorted(children.get(top, []), key=date), 1)}
        stack, position, first, part, part_date = [(top, 0)], 0, None, 0, 0
        while stack:
            n, depth = stack.pop()
            if depth == 1:
                part, part_date = branches[n], date(n)
            if n in known:
                first = known[n]["id"] if first is None else first
                place = own[part] = own.get(part, -1) + 1
                yield {"id": known[n]["id"], "message_id": n, "thread_id": first, "position": position, "depth": depth, "root_id": root and root["id"], "root_date": (root["date"] or 0) if root else 0, "root_subject": root and root.get("subject"), "part": part, "part_date": part_date, "place": place}
                position += 1
            stack += [(c, depth + 1) for c in reversed(sorted(children.get(n, []), key=date))]
