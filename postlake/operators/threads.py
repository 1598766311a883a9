"""Conversation threads: reference edges, components, first-parent trees, trees of one subject merged, fetch.

Only slim rows (ids, references, dates, subjects) travel. Trees are numbered by pointer doubling over their nodes, and
trees with one subject are then put together by offsets over their parts; neither is ever in one task's memory.

Defined results: of copies of one message id the last one by id is in the tree, and all copies get its place; a message
without an id is a thread of its own; cycles are cut at the link that would close them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.files import Scratch, result
from postlake.operators.prefix import running


def _chain(emails: DataFrame) -> Column:
    """A message's references in order, in_reply_to behind them if it is not among them."""
    refs = F.coalesce(F.col("references") if "references" in emails.columns else F.lit(None), F.array().cast("array<string>"))
    return F.when(F.col("in_reply_to").isNotNull() & ~F.array_contains(refs, F.col("in_reply_to")), F.concat(refs, F.array("in_reply_to"))).otherwise(refs)


def edges(emails: DataFrame) -> DataFrame:
    """a, b: consecutive ids of each message's chain, itself last."""
    e = emails.select("id", F.concat(_chain(emails), F.array("message_id")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))
    return e.where(F.size("c") > 1).select("id", F.explode(pairs).alias("p")).select("id", "p.a", "p.b").where("a <> b")


def labelled(emails: DataFrame, rounds: int = 100) -> DataFrame:
    """message_id, component: least id string reachable over reference edges, phantom ids included.

    Label propagation with pointer jumping; each round's table is written to the shared folder.
    """
    e = edges(emails).select("a", "b").distinct()
    own = emails.where("message_id is not null").select(F.col("message_id").alias("a"), F.col("message_id").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own).distinct()
    with Scratch(emails.sparkSession) as scratch:
        both = scratch.written(both, "edges")
        label, last = scratch.written(both.groupBy("a").agg(F.min("b").alias("l")), "labels"), None
        for _ in range(rounds):
            near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("l"))
            up = label.select(F.col("a").alias("l"), F.col("l").alias("l2"))
            label = scratch.written(near.join(up, "l", "left").select("a", F.least("l", F.coalesce("l2", "l")).alias("l")), "labels", over=label)
            now = label.agg(F.sum(F.xxhash64("a", "l").cast("decimal(38,0)"))).first()[0]
            if now == last:
                return result(label.select(F.col("a").alias("message_id"), F.col("l").alias("component")))
            last = now
    raise RuntimeError(f"components are not settled after {rounds} rounds")


_OUT = ("id", "thread_id", "position", "depth")
#: A message's place in its tree before trees of one subject are merged: the root (its id null if it was never seen), the branch below it by its first position (0 for the root) and date, and the place in that.
NODE = "id long, message_id string, thread_id long, position long, depth long, root_id long, root_date long, root_subject string, part long, part_date long, place long"


def _entries(emails: DataFrame) -> DataFrame:
    """The ids of each message's chain: id, pos, node, parent (the id before it, if another), above (whether another id follows), m (the message, with its own id)."""
    subject = F.col("subject_norm") if "subject_norm" in emails.columns else F.lit(None).cast("string")
    named = F.filter(_chain(emails), lambda c: c.isNotNull() & (c != ""))
    rows = emails.where("message_id is not null").select("id", F.concat(named, F.array("message_id")).alias("c"), F.col("date_received").cast("long").alias("date"), subject.alias("subject"))
    rows = rows.select("*", F.posexplode("c").alias("pos", "node"))
    before, after = F.get("c", F.col("pos") - 1), F.get("c", F.col("pos") + 1)
    m = F.when(after.isNull(), F.struct("id", "date", "subject"))
    return rows.select("id", "pos", "node", F.when(before != F.col("node"), before).alias("parent"), F.coalesce(after != F.col("node"), F.lit(False)).alias("above"), m.alias("m"))


def _graph(emails: DataFrame) -> DataFrame:
    """Nodes: node, when it was first seen, the message if there is one and how many copies, the parent by the first link that says so and that link, and whether any link makes it a parent."""
    at = F.struct("id", "pos")
    link = F.when(F.col("parent").isNotNull(), F.struct(at.alias("at"), "parent"))
    grouped = _entries(emails).groupBy("node").agg(F.min(at).alias("seen"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("id"))).alias("m"), F.count("m").alias("copies"), F.min(link).alias("p"), F.max("above").alias("above"))
    return grouped.select("node", "seen", "m", "copies", "p.parent", "p.at", "above")


def _links(emails: DataFrame) -> DataFrame:
    """Possible parents: node, parent, at (the first link that says so)."""
    return _entries(emails).where("parent is not null").groupBy("node", "parent").agg(F.min(F.struct("id", "pos")).alias("at"))


def _climbed(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """For each node with a parent (node, parent, at, own: 1 for a message) its root, branch, depth and size, by pointer doubling.

    In round k a node knows its 2^k-th ancestor, and the messages less than 2^k below it; the rounds are the logarithm of
    the greatest depth. Roots are not in the table: who is not found there has no parent. If links run in circles, the
    last link of each circle is given instead, as second value.
    """
    up = F.col("parent")
    state = scratch.written(nodes.where("parent is not null").select("node", up.alias("up"), up.alias("top"), F.col("node").alias("branch"), F.lit(1).cast("long").alias("depth"), F.col("own").alias("size"), F.col("at").alias("last")), "climb")
    before, reach = -1, 1
    while True:
        active = state.where("up is not null")
        n = active.count()
        if not n:
            return state, None
        if n == before and reach >= n:
            # Depths are without gaps, so with none between reach / 2 and reach all that is left runs in circles.
            circle = active.select(F.col("up").alias("node")).distinct()
            return state, state.join(circle, "node", "left_semi").select("last").distinct()
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("branch").alias("branch2"), F.col("depth").alias("depth2"), F.col("last").alias("last2"))
        more = active.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        moved = active.join(far, "up", "left").select("node", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), F.coalesce("branch2", "branch").alias("branch"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), "size", F.greatest("last", "last2").alias("last"))
        every = moved.unionByName(state.where("up is null")).join(more, "node", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        state, before, reach = scratch.written(every, "climb", over=state), n, 2 * reach


def _path_sums(values: DataFrame, scratch: Scratch) -> DataFrame:
    """node, total: the sum of ``v`` over a node and all above it. Values: node, up (the parent), v."""
    state = scratch.written(values.select("node", "up", F.col("v").alias("total")), "sums")
    while state.where("up is not null").limit(1).count():
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"))
        moved = state.where("up is not null").join(far, "up").select("node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"))
        state = scratch.written(moved.unionByName(state.where("up is null")), "sums", over=state)
    return state.select("node", "total")


def _trees(emails: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``nodes``, and the message ids (message_id) that several messages have."""
    found = scratch.written(_graph(emails).withColumn("own", F.col("m").isNotNull().cast("long")), "nodes")
    several = scratch.written(found.where("copies > 1").select(F.col("node").alias("message_id")), "several")
    # Who is in no link is a tree alone, and is neither climbed nor summed.
    linked = F.col("parent").isNotNull() | F.col("above")
    alone, base = found.where(~linked), found.where(linked)
    links = refused = None
    while True:
        climbed, last = _climbed(base, scratch)
        if last is None:
            break
        links = scratch.written(_links(emails), "links") if links is None else links
        now = links.join(last.withColumnRenamed("last", "at"), "at", "left_semi").select("node", F.col("at").alias("_not"))
        refused = scratch.written((now if refused is None else now.unionByName(refused)).groupBy("node").agg(F.max("_not").alias("_not")), "refused")
        left = links.join(refused, "node", "left").where("_not is null or at > _not")
        parent = left.groupBy("node").agg(F.min(F.struct("at", "parent")).alias("p")).select("node", "p.parent", "p.at")
        base = scratch.written(found.where(linked).drop("parent", "at").join(parent, "node", "left"), "base")
    x = base.join(climbed.drop("up", "last"), "node", "left").withColumns({"top": F.coalesce("top", "node"), "depth": F.coalesce("depth", F.lit(0))})
    x = scratch.written(x, "x")
    day = F.coalesce("m.date", F.lit(0))
    siblings = x.where("parent is not null").select("node", "parent", "size", day.alias("_day"), F.col("seen.id").alias("_id"), F.col("seen.pos").alias("_pos"))
    ahead = running(siblings, "parent", [F.col("_day"), F.col("_id"), F.col("_pos")], "size", "ahead", scratch).select("node", "ahead")
    values = x.join(ahead, "node", "left").select("node", F.col("parent").alias("up"), (F.coalesce("ahead", F.lit(0)) + F.col("own")).alias("v"))
    placed = x.join(_path_sums(values, scratch), "node").withColumn("position", F.col("total") - F.col("own"))
    placed = scratch.written(placed.select("node", "m", "own", "top", "branch", "depth", "position"), "placed")
    firsts = placed.where("own = 1 and position = 0").select("top", F.col("m.id").alias("thread_id"))
    roots = placed.where("node = top").select("top", F.col("m.id").alias("root_id"), day.alias("root_date"), F.col("m.subject").alias("root_subject"))
    branches = placed.where("node = branch").select("branch", F.col("position").alias("part"), day.alias("part_date"))
    out = placed.where("own = 1").join(firsts.join(roots, "top"), "top").join(branches, "branch", "left")
    out = out.select(F.col("m.id").alias("id"), F.col("node").alias("message_id"), "thread_id", "position", "depth", "root_id", "root_date", "root_subject", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("part_date", F.lit(0)).alias("part_date"), (F.col("position") - F.coalesce("part", F.lit(0))).alias("place"))
    own, none = F.col("m.id"), F.lit(0).cast("long")
    alone = alone.select(own.alias("id"), F.col("node").alias("message_id"), own.alias("thread_id"), none.alias("position"), none.alias("depth"), own.alias("root_id"), day.alias("root_date"), F.col("m.subject").alias("root_subject"), none.alias("part"), none.alias("part_date"), none.alias("place"))
    return out.unionByName(alone), several


def nodes(emails: DataFrame, scratch: Scratch) -> DataFrame:
    """The place of every message in its tree (``NODE``). No task holds a tree, so a chain or a list may be of any length.

    A node's parent is what the first link says, by message id and place in its chain; a link that would close a circle
    is refused, and the node takes the next. In a circle that is the last link: those before it stand, as from any of
    them one comes to the node whose link was refused, and all its later links are later still.
    """
    return _trees(emails, scratch)[0]


def merged(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Trees whose root is a message with one non-empty subject become children of the earliest such root, among its own by date."""
    roots = nodes.where("position = 0 and id = root_id and root_subject <> ''").select("root_id", "root_subject", "root_date")
    groups = roots.groupBy("root_subject").agg(F.min(F.struct("root_date", "root_id")).alias("first"), F.count("*").alias("trees")).where("trees > 1").select("root_subject", F.col("first.root_id").alias("anchor"))
    # Every message knows the subject of its root (null if that was never seen), so trees need not be gathered first.
    at = nodes.join(scratch.written(groups, "groups"), "root_subject", "left")
    alone, joined = at.where("anchor is null"), at.where("anchor is not null")
    # Parts: branches of the anchor by their dates, and whole other trees by their roots'; each lies in one stretch.
    own = F.col("root_id") == F.col("anchor")
    part = joined.select("id", "message_id", "anchor", "root_id", own.alias("own"), F.when(own, F.col("part")).otherwise(-1).alias("part"), F.when(own, F.col("part_date")).otherwise(F.col("root_date")).alias("date"), F.when(own, F.col("place")).otherwise(F.col("position")).alias("place"), F.when(own, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"))
    sizes = part.where("part <> 0").groupBy("anchor", "root_id", "part").agg(F.first("date").alias("date"), F.first("own").alias("own"), F.count("*").alias("n"))
    offsets = running(sizes, "anchor", [F.col("date"), F.desc("own"), F.col("part"), F.col("root_id")], "n", "offset", scratch).select("anchor", "root_id", "part", (1 + F.col("offset")).alias("offset"))
    placed = part.join(offsets, ["anchor", "root_id", "part"], "left").select("id", "message_id", F.col("anchor").alias("thread_id"), (F.coalesce("offset", F.lit(0)) + F.col("place")).alias("position"), "depth")
    return alone.select("id", "message_id", "thread_id", "position", "depth").unionByName(placed)


def _with_copies(emails: DataFrame, placed: DataFrame, copies: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Places of all messages: copies of a message id share one, and a message without an id is a thread of its own.

    ``copies``: the message ids that several messages have, and these messages, if known; only they are joined then.
    """
    ids = emails.select("id", "message_id")
    if copies is None:
        every = ids.join(placed.drop("id"), "message_id")
    else:
        several, messages = copies
        every = placed.join(several, "message_id", "left_anti").unionByName(messages.join(placed.drop("id"), "message_id"))
    with_id = every.select("id", "thread_id", F.col("position").cast("int").alias("position"), F.col("depth").cast("int").alias("depth"))
    bare = ids.where("message_id is null").select("id", F.col("id").alias("thread_id"), F.lit(0).alias("position"), F.lit(0).alias("depth"))
    return with_id.unionByName(bare).select(*_OUT)


def threads(emails: DataFrame, by_subject: bool = False) -> DataFrame:
    """id, thread_id, position, depth of every message; ``by_subject`` merges trees of one subject.

    A thread's id is that of its first message in pre-order.
    """
    with Scratch(emails.sparkSession) as scratch:
        places, several = _trees(emails, scratch)
        # Written, so that Spark knows their size: where there are no copies, nothing is moved to find them.
        copies = several, scratch.written(emails.select("id", "message_id").join(several, "message_id", "left_semi"), "copies")
        placed = merged(scratch.written(places, "places"), scratch) if by_subject else places
        return result(_with_copies(emails, placed, copies))


@dataclass
class Places:
    """What is kept beside a message table so that a change rebuilds touched threads only: ``nodes`` (``NODE`` and component), ``refs`` (message_id, component of every id that a message has or names), and the threads that come of them (id, thread_id, position, depth)."""

    nodes: DataFrame
    refs: DataFrame
    placed: DataFrame


NODES, REFS = f"message_id string, {NODE.replace('message_id string, ', '')}, component string", "message_id string, component string"


def _components(emails: DataFrame, scratch: Scratch) -> DataFrame:
    """message_id, component of every id that a message with an id has or names; others are in no tree and link nothing."""
    return scratch.written(labelled(emails.where("message_id is not null")), "refs")


def first_places(emails: DataFrame, scratch: Scratch, by_subject: bool = True) -> Places:
    refs = _components(emails, scratch)
    made = scratch.written(nodes(emails, scratch).join(refs, "message_id"), "nodes")
    placed = _with_copies(emails, merged(made, scratch) if by_subject else made)
    return Places(made, refs, scratch.written(placed, "places"))


def next_places(old: Places, before: DataFrame, emails: DataFrame, changed: DataFrame, scratch: Scratch, by_subject: bool = True) -> Places:
    """The places after a change, the same as those of all messages anew.

    ``before``, ``emails``: the messages then and now; ``changed``: id of those that came, went or have another text.
    Components that a changed message is in, was in or names are built again, out of their messages alone; trees are put
    together again only for the subjects of their roots, then and now. Everything else keeps its rows.
    """
    changed = scratch.written(changed.select("id").distinct(), "changed")
    then, now = before.join(changed, "id", "left_semi"), emails.join(changed, "id", "left_semi")
    named = lambda m: m.select(F.explode(F.concat(_chain(m), F.array("message_id"))).alias("message_id")).where("message_id is not null")
    touched = scratch.written(old.refs.join(named(then).unionByName(named(now)).distinct(), "message_id", "left_semi").select("component").distinct(), "touched")
    ids = old.refs.join(touched, "component", "left_semi").select("message_id").unionByName(now.where("message_id is not null").select("message_id")).distinct()
    own = scratch.written(emails.select("id", "message_id", "in_reply_to", *({"references", "subject_norm"} & {*emails.columns}), "date_received").join(ids, "message_id", "left_semi"), "own")
    refs = _components(own, scratch)
    made = scratch.written(nodes(own, scratch).join(refs, "message_id"), "nodes")
    gone = old.nodes.join(touched, "component", "left_semi")
    rest = scratch.written(old.nodes.join(touched, "component", "left_anti"), "rest")
    every = rest.unionByName(made.select(*rest.columns))
    redone = made
    if by_subject:
        subjects = gone.select("root_subject").unionByName(made.select("root_subject")).where("root_subject <> ''").distinct()
        # Whole groups of trees of a subject, with the trees of these messages.
        redone = scratch.written(made.unionByName(rest.join(subjects, "root_subject", "left_semi").select(*made.columns)), "redone")
    new = scratch.written(merged(redone, scratch) if by_subject else redone.select("id", "message_id", "thread_id", "position", "depth"), "new")
    again = emails.select("id", "message_id").join(new.select("message_id").distinct(), "message_id", "left_semi")
    bare = emails.where("message_id is null").select("id", "message_id").join(changed, "id", "left_semi")
    fresh = _with_copies(again.unionByName(bare), new)
    fresh = scratch.written(fresh, "fresh")
    stay = old.placed.join(fresh.select("id"), "id", "left_anti").join(emails.select("id"), "id", "left_semi")
    kept = old.refs.join(touched, "component", "left_anti").unionByName(refs).select("message_id", "component")
    return Places(scratch.written(every, "nodes"), scratch.written(kept, "refs"), scratch.written(stay.select(*_OUT).unionByName(fresh), "places"))


def subject_anchor(roots: DataFrame) -> DataFrame:
    """id, anchor: roots with one normalised subject join the earliest of them."""
    w = Window.partitionBy("subject_norm").orderBy(F.asc_nulls_first("date_received"), "id")
    return roots.where("subject_norm <> ''").select("id", F.first("id").over(w).alias("anchor"))


def summaries(emails: DataFrame, thread: str) -> DataFrame:
    """Per thread: messages, participants, dates, unread, and whether the last message was sent."""
    return emails.groupBy(thread).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("sender_addr")), ",").alias("participants"), F.min("date_received").alias("first_date"), F.max("date_received").alias("last_date"), F.sum((~F.col("is_read")).cast("long")).alias("unread"), (F.max_by("mailbox_role", F.struct(F.coalesce("date_received", F.lit(0)), -F.col("id"))) == "sent").alias("answered_last"))


def fetch(emails: DataFrame, placed: DataFrame, message_id: str | None = None, thread_id: int | None = None) -> DataFrame:
    """The messages of one thread in order, by the newest copy of a message id or by the thread's id. ``placed``: rows of ``threads``."""
    if thread_id is None:
        newest = emails.where(F.col("message_id") == message_id).orderBy(F.desc_nulls_last("date_received"), "id").limit(1).select("id")
        wanted = placed.join(newest, "id").select("thread_id")
    else:
        wanted = placed.where(F.col("thread_id") == thread_id).select("thread_id").limit(1)
    # One row, so the rows of the thread are found without moving the others.
    rows = placed.join(F.broadcast(wanted.distinct()), "thread_id")
    return emails.join(rows, "id").orderBy("position", "id")


def nested(rows: list[dict]) -> list[dict]:
    """One thread's messages (in order, with depth) as trees: each has ``children``. A message whose parents were never seen stands under empty nodes."""
    top: list[dict] = []
    path: list[list[dict]] = [top]
    for r in rows:
        while len(path) > r["depth"] + 1:
            path.pop()
        while len(path) < r["depth"] + 1:
            unseen = {"children": []}
            path[-1].append(unseen)
            path.append(unseen["children"])
        node = {k: v for k, v in r.items() if k not in ("depth", "position")} | {"children": []}
        path[-1].append(node)
        path.append(node["children"])
    return top
