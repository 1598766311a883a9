"""Mixing sources to target weights by Sainte-Laguë apportionment, all of it in DataFrame functions.

Sources share a budget of words by weight, each up to a multiple of what it has (the excess is shared again). The budget
is cut into blocks of equal length, and blocks go to sources by highest quotients, votes / 1, votes / 3, votes / 5 and
so on. A source lies in shards, about as many as the square root of its rows, so neither a shard nor a source's list
of shards is large; its blocks go to these by highest quotients too. In a shard, documents in the order of a seeded hash
are one stretch of words cut in equal blocks; a quota of q of m blocks is q div m passes over all, and q mod m blocks
whose number, times a prime and plus a seeded offset modulo m, is below that: a permutation, so their count is exact.

Quotients are not listed: two levels that bound the last one granted leave at most about three seats a party to be
ranked. Only rows of (doc_id, source, size, hash) are shuffled, and a hot source is spread over its shards.

Defined results: a null text has no words; null is a source of its own, behind the others; without any words nothing is
taken; a null doc_id hashes as its text; rows that are the same in doc_id and size are taken in any order, so the set of
results is the same at each run. A document's words stay in order however long it is. Columns other than doc_id, text
and source are not read, so they cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.quality_rules import words_of
from postlake.llm.shared import Scratch, written

#: The largest primes below 2^31. A shard has fewer blocks, so they have no divisor in common.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
#: Sources up to this many are sent to the tasks; with more, documents are joined with them by a shuffle.
SENT = 100_000


def _number(hashed: Column, at: int) -> Column:
    """Eight hex digits of a hash as a number."""
    return F.conv(F.substring(hashed, at, 8), 16, 10).cast("long")


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """Adds ``name``: the place from 0 in the order, by a range-partitioned sort; one row a partition meets in a task."""
    placed = scratch.written(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(counts), "_p").withColumn(name, F.col("_before") + inside).drop("_p", "_m", "_before")


def level(parties: DataFrame, cap: str, weight: str, budget: float) -> float:
    """The water level: the factor at which weights times it, each at most its cap, sum to the budget.

    Each step is one aggregate; who is at the cap stays there, so the level only rises until it is right.
    """
    now = 0.0
    while budget > 0:
        full = F.col(cap) <= F.lit(now) * F.col(weight)
        held, rest = parties.agg(F.sum(F.when(full, F.col(cap))), F.sum(F.when(~full, F.col(weight)))).first()
        if not rest:
            break
        new = (budget - float(held or 0)) / float(rest)
        if new <= now:
            break
        now = new
    return now


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Adds target to sources (source_size, weight): ``share`` of all words by weight, at most ``most`` times what a source has."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    factor = level(sources.withColumn("cap", most * F.col("source_size")), "cap", "weight", share * total)
    return sources.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(factor) * F.col("weight")))


def seats_of_sources(parties: DataFrame, house: int, scratch: Scratch) -> DataFrame:
    """sid, seats: ``house`` seats to parties (sid, vote, cap) by highest quotients vote / (2 k - 1), ties by sid, none beyond its cap."""
    n = parties.count()
    seats = lambda factor: F.least(F.col("cap"), F.floor(F.lit(factor) * F.col("vote") + 0.5))
    low, high = (level(parties, "cap", "vote", house + d * (n / 2 + 1)) for d in (-1, 1))
    bounds = scratch.written(parties.select("sid", "vote", seats(low).alias("low"), seats(high).alias("high")), "bounds")
    left = house - (bounds.agg(F.sum("low")).first()[0] or 0)
    open_seats = bounds.where("high > low").select("sid", "vote", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k"))
    got = ranked(open_seats.withColumn("quotient", F.col("vote") / (2 * F.col("k") - 1)), [F.desc("quotient"), F.asc("sid"), F.asc("k")], scratch, "seat")
    more = got.where(F.col("seat") < left).groupBy("sid").agg(F.count("*").alias("more"))
    return bounds.join(more, "sid", "left").select("sid", (F.col("low") + F.coalesce("more", F.lit(0))).alias("seats"))


def quotas_of_shards(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds quota to shards (sid, shard, blocks): a source's seats by highest quotients blocks / (2 k - 1), ties by shard. Sources: sid, seats, blocks_all, shards."""
    x = shards.join(sources, "sid")
    seats = lambda d: F.floor(F.greatest(F.lit(0.0), F.col("seats") + d * (F.col("shards") / 2 + 1)) / F.col("blocks_all") * F.col("blocks") + 0.5)
    x = x.withColumns({"low": seats(-1), "high": seats(1)})
    left = x.groupBy("sid").agg((F.first("seats") - F.sum("low")).alias("left"))
    open_seats = x.where("high > low").select("sid", "shard", "blocks", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k"))
    order = Window.partitionBy("sid").orderBy(F.desc(F.col("blocks") / (2 * F.col("k") - 1)), "shard", "k")
    got = open_seats.withColumn("seat", F.row_number().over(order)).join(left, "sid").where("seat <= left").groupBy("sid", "shard").agg(F.count("*").alias("more"))
    return x.join(got, ["sid", "shard"], "left").select(*shards.columns, (F.col("low") + F.coalesce("more", F.lit(0))).alias("quota"))


def _chosen(pick) -> Column:
    """``pick(block, words of the document in it, where they begin)`` of each block that a document's shard draws beside whole passes."""
    first = F.expr("((begin + 1) * blocks - 1) div words")
    last = F.expr("((begin + size) * blocks - 1) div words")
    drawn = lambda j: F.pmod(F.col("prime") * j + F.col("offset"), F.col("blocks")) < F.col("drawn")
    edge = lambda j: F.call_function("div", j * F.col("words"), F.col("blocks"))

    def one(j: Column) -> Column:
        a, b = F.greatest(F.col("begin"), edge(j)), F.least(F.col("begin") + F.col("size"), edge(j + 1))
        return pick(a - F.col("begin"), b - a)

    return F.transform(F.filter(F.when((F.col("drawn") > 0) & (F.col("size") > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), drawn), one)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, seed: int = 1) -> DataFrame:
    """doc_id, source, size (words), source_size, target (words of its source), taken (words the mix takes, repeats counted), spans.

    ``weights`` go round over the sources in order; ``share`` of all words is the budget; no source or document is
    taken more than ``most`` times. ``spans`` has (start, length, times) of the words that are taken.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
        slim = scratch.written(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("h")), "slim")
        sources = ranked(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), [F.asc_nulls_last("source")], scratch, "sid")
        weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
        sources = targets(sources.withColumns({"weight": weight, "n": F.greatest(F.lit(1), F.ceil(F.sqrt("rows") / 2))}), share, most)
        sources = scratch.written(sources, "sources")
        own = sources.select(F.col("source").alias("_source"), "sid", "n", "source_size", "target")
        own = F.broadcast(own) if sources.count() <= SENT else own
        placed = slim.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(_number(F.col("h"), 1), F.col("n"))).drop("_source", "n")
        shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words")).where("words > 0")
        shards = scratch.written(shards.withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}")), "shards")
        parties = shards.groupBy("sid").agg(F.sum("blocks").alias("blocks_all"), F.count("*").alias("shards")).join(sources, "sid")
        wanted = (F.col("target") * F.col("blocks_all") / F.col("source_size")).cast("decimal(30,8)")
        parties = scratch.written(parties.select("sid", "blocks_all", "shards", wanted.alias("wanted"), (most * F.col("blocks_all")).alias("cap"), (F.col("weight") * F.col("blocks_all") / F.col("source_size")).alias("vote")), "parties")
        house = int(parties.agg(F.floor(F.coalesce(F.sum("wanted"), F.lit(0)) + F.lit(0.5))).first()[0])
        seats = seats_of_sources(parties, house, scratch).join(parties.select("sid", "blocks_all", "shards"), "sid")
        hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col("sid"), F.col("shard")))
        prime = F.element_at(F.array(*map(F.lit, PRIMES)), (_number(hashed, 1) % len(PRIMES) + 1).cast("int")).cast("long")
        drawn = quotas_of_shards(shards, seats).select("sid", "shard", "words", "blocks", F.expr("quota div blocks").alias("passes"), F.expr("quota % blocks").alias("drawn"), prime.alias("prime"), (_number(hashed, 9) % F.col("blocks")).alias("offset"))
        before = Window.partitionBy("sid", "shard").orderBy("h", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.coalesce(F.sum("size").over(before), F.lit(0))
        rows = placed.withColumn("begin", begin).join(scratch.written(drawn, "drawn"), ["sid", "shard"], "left")
        rows = written(rows.drop("sid", "h").fillna(0, ["passes", "drawn"]), "mix")
    taken = F.col("passes") * F.col("size") + F.aggregate(_chosen(lambda at, n: n), F.lit(0).cast("long"), lambda a, n: a + n)
    span = lambda at, n, times: F.struct(at.cast("long").alias("start"), n.cast("long").alias("length"), times.cast("long").alias("times"))
    whole = F.when((F.col("passes") > 0) & (F.col("size") > 0), F.array(span(F.lit(0), F.col("size"), F.col("passes"))))
    spans = F.concat(F.coalesce(whole, F.array().cast("array<struct<start:bigint,length:bigint,times:bigint>>")), _chosen(lambda at, n: span(at, n, F.lit(1))))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), spans.alias("spans"))


def oracle(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, seed: int = 1) -> str:
    """The mix in DuckDB: levels by a sort of the sources, seats by listing every quotient."""
    number = lambda h, at: f"('0x' || substr({h}, {at}, 8))::BIGINT"
    return f"""
WITH slim AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, greatest(1, ceil(sqrt(count(*)) / 2))::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM slim GROUP BY source),
s1 AS (SELECT *, [{", ".join(map(str, weights))}][sid % {len(weights)} + 1] AS weight, {most} * source_size AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held, sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest, sum(source_size) OVER ()::DOUBLE * {share}::DOUBLE AS budget FROM s1),
f AS (SELECT arg_min((budget - held) / rest, held) FILTER (cap > (budget - held) / rest * weight) AS factor FROM s2),
src AS (SELECT s1.*, coalesce(least(cap::DOUBLE, factor * weight), cap::DOUBLE) AS target FROM s1, f),
placed AS (SELECT slim.*, sid, source_size, target, {number("h", 1)} % n AS shard FROM slim JOIN src ON slim.source IS NOT DISTINCT FROM src.source),
shards AS (SELECT sid, shard, sum(size)::BIGINT AS words, ((sum(size) + {block - 1}) // {block})::BIGINT AS blocks, md5(concat_ws(':', '{seed}', sid, shard)) AS hs FROM placed GROUP BY sid, shard HAVING sum(size) > 0),
parties AS (SELECT sid, sum(blocks)::BIGINT AS blocks_all FROM shards GROUP BY sid),
p AS (SELECT sid, blocks_all, (target * blocks_all / source_size)::DECIMAL(30, 8) AS wanted, weight * blocks_all / source_size AS vote FROM parties JOIN src USING (sid)),
listed AS (SELECT sid, row_number() OVER (ORDER BY vote / (2 * k - 1) DESC, sid, k) AS seat FROM (SELECT sid, vote, unnest(range(1, {most} * blocks_all + 1)) AS k FROM p)),
seats AS (SELECT sid, count(*) AS seats FROM listed WHERE seat <= (SELECT floor(sum(wanted) + 0.5) FROM p) GROUP BY sid),
dealt AS (SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY blocks / (2 * k - 1) DESC, shard, k) AS seat FROM (SELECT sid, shard, blocks, unnest(range(1, {most} * blocks + 1)) AS k FROM shards)),
quotas AS (SELECT sid, shard, count(*) AS quota FROM dealt JOIN seats USING (sid) WHERE seat <= seats GROUP BY sid, shard),
drawn AS (SELECT sid, shard, words, blocks, coalesce(quota, 0) // blocks AS passes, coalesce(quota, 0) % blocks AS drawn, [{", ".join(map(str, PRIMES))}][{number("hs", 1)} % {len(PRIMES)} + 1]::BIGINT AS prime, {number("hs", 9)} % blocks AS off FROM shards LEFT JOIN quotas USING (sid, shard)),
ranges AS (SELECT sid, shard, unnest(range(0, blocks)) AS j, words, blocks, prime, off, drawn FROM drawn),
picked AS (SELECT sid, shard, (j * words) // blocks AS a, ((j + 1) * words) // blocks AS b FROM ranges WHERE (prime * j + off) % blocks < drawn),
x AS (SELECT row_number() OVER () AS r, *, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_ FROM placed),
t AS (SELECT r, sum(least(begin_ + size, b) - greatest(begin_, a)) AS n FROM x JOIN picked USING (sid, shard) WHERE a < begin_ + size AND b > begin_ GROUP BY r)
SELECT doc_id, size, source_size, target, (coalesce(passes, 0) * size + coalesce(t.n, 0))::BIGINT AS taken FROM x LEFT JOIN drawn USING (sid, shard) LEFT JOIN t USING (r)
"""
