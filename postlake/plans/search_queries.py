"""Search queries over `documents` as messages, and their DuckDB twins, which count tokens in whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import files
from postlake.functions import table
from postlake.operators import index, search, segments, vectors
from postlake.plans.registry import query, read

COLUMNS, WEIGHTS = {"subject": "subject", "body": "text"}, {"subject": 10.0, "body": 1.0}
_OPENED: dict[tuple[str, str], index.Index] = {}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("subject", F.get(F.split("text", "\n"), F.lit(0)))


def as_emails(spark: SparkSession, d: str) -> DataFrame:
    """Documents as messages: source as account, language as mailbox, doc_id as date."""
    x = docs(spark, d)
    return x.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"), F.col("source").alias("account_uuid"), F.col("source").alias("account_name"), F.col("lang").alias("mailbox_name"), F.col("lang").alias("mailbox_role"), "subject", F.col("text").alias("body_plain"), F.col("doc_id").alias("date_received"), (F.col("doc_id") % 2 == 0).alias("is_read"), F.lit(False).alias("is_flagged"), F.lit(0).alias("attachment_count"), F.lit(None).cast("int").alias("flag_color"))


def opened(spark: SparkSession, d: str) -> index.Index:
    """The index over a table, built once a session in the shared folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _OPENED:
        _OPENED[key] = index.build(docs(spark, d), COLUMNS, index.fresh(files.shared(spark)), WEIGHTS, stemmed=False, grams=("subject", "body"))
    return _OPENED[key]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _matches(spark, d, text, scope=None) -> DataFrame:
    return index.matches(opened(spark, d), spark, text, scope)


def sql(terms: list[str], scope: str | None = None, any_of: bool = False, without: tuple = (), where: str = "true", tail: str = "ORDER BY s DESC, doc_id LIMIT 25", out: str = "doc_id, round(s, 6) AS score") -> str:
    """BM25 of words, ``prefix*``, phrases (words with blanks) and ``a ~n b`` (a within n words of b)."""
    tok = lambda c: f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"

    def found(t: str, c: str) -> str:
        words = t.split()
        if len(words) == 3 and words[1].startswith("~"):
            n = words[1][1:]
            return f"list_filter(range(1, len({c}) + 1), lambda x: {c}[x] = '{words[0]}' AND len(list_filter(range(greatest(1, x - 1 - {n}), least(len({c}), x + 1 + {n}) + 1), lambda y: {c}[y] = '{words[2]}')) > 0)"
        if len(words) > 1:
            return f"list_filter(range(1, len({c}) - {len(words) - 2}), lambda x: {' AND '.join(f'''{c}[x + {k}] = '{w}' ''' for k, w in enumerate(words))})"
        return f"list_filter({c}, lambda x: starts_with(x, '{t[:-1]}'))" if t.endswith("*") else f"list_filter({c}, lambda x: x = '{t}')"

    cnt = lambda t: " + ".join(f"{WEIGHTS[c]} * len({found(t, f'{c[0]}t')})" for c in COLUMNS if scope in (None, c))
    fs = ", ".join(f"{cnt(t)} AS f{i}" for i, t in enumerate([*terms, *without]))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    sc = " + ".join(f"CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{i} + 0.5) / (n{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avgdl))" for i in range(len(terms)))
    has = (" OR " if any_of else " AND ").join(f"f{i} > 0" for i in range(len(terms)))
    no = "".join(f" AND NOT f{len(terms) + i} > 0" for i in range(len(without)))
    return f"""WITH t AS (SELECT doc_id, lang, {tok("string_split(text, chr(10))[1]")} AS st, {tok("text")} AS bt FROM documents), c AS (SELECT doc_id, lang, len(st) + len(bt) AS len, {fs} FROM t), z AS (SELECT count(*) AS N, avg(len) AS avgdl, {ns} FROM c),
m AS (SELECT doc_id, lang, {sc} AS s FROM c, z WHERE ({has}){no}) SELECT {out} FROM m WHERE {where} {tail}"""


_TERMS = "SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')) AS x FROM documents"


@query("index_build", f"SELECT count(DISTINCT x) AS terms, count(*) AS tokens FROM ({_TERMS.format('text')} UNION ALL {_TERMS.format('string_split(text, chr(10))[1]')})", emails=False)
def _(spark, d):
    return opened(spark, d).terms(spark).agg(F.count("*").alias("terms"), F.sum("tf").cast("long").alias("tokens"))


@query("token_table", f"SELECT lang, count(*) AS tokens, count(DISTINCT x) AS terms FROM (SELECT lang, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')) AS x FROM documents) GROUP BY lang", emails=False)
def _(spark, d):
    """The tokens of the table by the SQL table function, each with the language of its row, so none is joined."""
    table.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("token_table_documents")
    return spark.sql("SELECT lang, count(*) AS tokens, count(DISTINCT term) AS terms FROM tokens(TABLE(SELECT doc_id, text, lang FROM token_table_documents), false, 'lang') GROUP BY lang")


@query("stemmed_search", "SELECT count(*) AS found FROM documents WHERE len(list_intersect(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+'), ['license', 'licensed', 'licenses', 'licensing'])) > 0", emails=False)
def _(spark, d):
    """Forms of one word by the stemmed index."""
    key = spark.sparkContext.applicationId, f"stems of {d}"
    if key not in _OPENED:
        _OPENED[key] = index.build(read(spark, d, "documents"), {"body": "text"}, index.fresh(files.shared(spark)))
    return index.matches(_OPENED[key], spark, "licensing").agg(F.count("*").alias("found"))


@query("bm25_search", sql(["the", "ndtion"]), emails=False)
def _(spark, d):
    return _rounded(search.page(_matches(spark, d, "the ndtion")))


@query("bm25_scoped", sql(["estion"], scope="subject", tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, "estion", "subject"))


@query("bm25_filtered", sql(["the"], where="lang = 'en'", tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, "the").join(read(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi"))


@query("bm25_count", sql(["the"], out="count(*) AS total_estimated", tail=""), emails=False)
def _(spark, d):
    return _matches(spark, d, "the").agg(F.count("*").alias("total_estimated"))


@query("bm25_offset", sql(["estion"], tail="ORDER BY s DESC, doc_id LIMIT 10 OFFSET 10"), emails=False)
def _(spark, d):
    return _rounded(search.page(_matches(spark, d, "estion"), 10, 10))


@query("boolean_search", sql(["ndtion", "estion"], any_of=True, without=("and",), tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, "(ndtion OR estion) NOT and"))


@query("prefix_search", sql(["ndt*"], tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, "ndt*"))


@query("phrase_search", sql(["of the"], tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, '"of the"'))


@query("near_search", sql(["of ~3 and"], tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, "NEAR(of and, 3)"))


@query("phrase_prefix_search", sql(["of the", "ndt*"], tail=""), emails=False)
def _(spark, d):
    return _rounded(_matches(spark, d, '"of" + "the" AND ndt*'))


@query("trigram_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'example.com')", emails=False)
def _(spark, d):
    return segments.holding(opened(spark, d), spark, "Example.com").orderBy("doc_id")


@query("trigram_scan", "SELECT doc_id FROM documents WHERE contains(lower(text), 'er th')", emails=False)
def _(spark, d):
    return search.substring(docs(spark, d), ["subject", "text"], "eR th")


def in_segments(spark: SparkSession, d: str) -> index.Index:
    """The table as three segments: two thirds of it, every fifth document in an older form and ghosts; the last third; the changes, without the ghosts."""
    x = docs(spark, d)
    older = x.where("doc_id % 3 <> 1").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" estion older ghostly"))).otherwise(F.col("text")))
    ghosts = x.where("doc_id % 7 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    one = index.build(older.unionByName(ghosts), COLUMNS, index.fresh(files.shared(spark)), WEIGHTS, stemmed=False, grams=("subject", "body"))
    two = index.updated(one, x.where("doc_id % 3 = 1"))
    return index.updated(two, x.where("doc_id % 3 <> 1 AND doc_id % 5 = 0"), ghosts.select("doc_id"))


def segmented(spark: SparkSession, d: str) -> index.Index:
    key = spark.sparkContext.applicationId, f"segments of {d}"
    if key not in _OPENED:
        _OPENED[key] = in_segments(spark, d)
    return _OPENED[key]


@query("segments_search", sql(["the", "estion"], any_of=True, tail=""), emails=False)
def _(spark, d):
    return _rounded(index.matches(segmented(spark, d), spark, "the OR estion"))


@query("segments_prefix", sql(["ndt*"], tail=""), emails=False)
def _(spark, d):
    return _rounded(index.matches(segmented(spark, d), spark, "ndt*"))


@query("segments_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'xample.c')", emails=False)
def _(spark, d):
    return segments.holding(segmented(spark, d), spark, "xample.C")


@query("segments_merged", f"SELECT x AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM ({_TERMS.format('text')} UNION ALL {_TERMS.format('string_split(text, chr(10))[1]')}) GROUP BY x", emails=False)
def _(spark, d):
    key = spark.sparkContext.applicationId, f"merged segments of {d}"
    if key not in _OPENED:
        _OPENED[key] = segments.merged(segmented(spark, d), spark, 0)
    return _OPENED[key].terms(spark)

@query("term_statistics", f"SELECT x AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM ({_TERMS.format('text')} UNION ALL {_TERMS.format('string_split(text, chr(10))[1]')}) GROUP BY x", emails=False)
def _(spark, d):
    return opened(spark, d).terms(spark).select("term", "df", F.col("tf").cast("long").alias("tf"))


def _found(f: search.Found) -> DataFrame:
    return f.hits.select("id", F.round("score", 6).alias("score"), F.lit(f.total_estimated).cast("long").alias("total"))


_PAGE = "doc_id AS id, round(s, 6) AS score, count(*) OVER () AS total"


@query("search_page", sql(["the", "estion"], any_of=True, where="lang = 'en' AND doc_id % 2 = 1 AND doc_id >= 100", out=_PAGE, tail="ORDER BY s DESC, doc_id LIMIT 20 OFFSET 5"), emails=False)
def _(spark, d):
    return _found(search.search(as_emails(spark, d), opened(spark, d), "the OR estion", limit=20, offset=5, mailbox="en", unread=True, after=100))


@query("search_substring_fallback", "SELECT doc_id AS id, 0.0::DOUBLE AS score, count(*) OVER () AS total FROM documents WHERE contains(lower(text), 'xample.co') ORDER BY doc_id LIMIT 25", emails=False)
def _(spark, d):
    return _found(search.search(as_emails(spark, d), opened(spark, d), "xample.co"))


@query("search_degraded", sql(["estion"], out=f"{_PAGE}, 'keyword' AS mode, true AS degraded", tail="ORDER BY s DESC, doc_id LIMIT 25"), emails=False)
def _(spark, d):
    f = search.search(as_emails(spark, d), opened(spark, d), "estion", mode="semantic")
    return _found(f).withColumn("mode", F.lit(f.mode)).withColumn("degraded", F.lit(f.degraded))


@query("search_nothing", "SELECT doc_id AS id, 0.0::DOUBLE AS score, 0::BIGINT AS total FROM documents WHERE false", emails=False)
def _(spark, d):
    return _found(search.search(as_emails(spark, d), opened(spark, d), "  "))


_COS = "1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"


def _first(v: DataFrame) -> list[float]:
    return [float(x) for x in v.where("vec_id = 0").select("embedding").first()[0]]


@query("knn", f"WITH {_V} SELECT vec_id, round({_COS}, 6) AS distance FROM v ORDER BY {_COS}, vec_id LIMIT 10", emails=False)
def _(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.knn(v, _first(v)).select("vec_id", F.round("distance", 6).alias("distance"))


@query("semantic_page", f"WITH {_V} SELECT vec_id, round({_COS}, 6) AS distance FROM v WHERE label = 3 ORDER BY {_COS}, vec_id LIMIT 25", emails=False)
def _(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.knn(v, _first(v), 25, F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))


@query("search_semantic", f"WITH {_V} SELECT vec_id AS id, round(1 - ({_COS}), 6) AS score, 15::BIGINT AS total FROM v JOIN documents ON doc_id = vec_id WHERE lang = 'en' ORDER BY {_COS}, vec_id LIMIT 10 OFFSET 5", emails=False)
def _(spark, d):
    v = read(spark, d, "embeddings")
    return _found(search.search(as_emails(spark, d), opened(spark, d), "any", mode="semantic", limit=10, offset=5, embedded=v, embed=lambda _: _first(v), mailbox="en"))


_HYBRID = f"WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM ({sql(['the'], tail='ORDER BY s DESC, doc_id LIMIT 100', out='doc_id, s')})), {_V}, k AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, {_COS} AS d FROM v ORDER BY d, vec_id LIMIT 100)), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM b UNION ALL SELECT * FROM k) GROUP BY doc_id) "


@query("hybrid_rrf", _HYBRID + "SELECT doc_id, round(s, 6) AS score FROM f", emails=False)
def _(spark, d):
    v = read(spark, d, "embeddings")
    words = vectors.ranked(search.page(_matches(spark, d, "the"), 100), "doc_id", F.desc("score"))
    near = vectors.ranked(vectors.knn(v, _first(v), 100).withColumnRenamed("vec_id", "doc_id"), "doc_id", F.asc("distance"))
    return _rounded(vectors.fused([words, near], "doc_id"))


@query("search_hybrid", _HYBRID + "SELECT doc_id AS id, round(s, 6) AS score, (SELECT count(*) FROM f) AS total FROM f JOIN documents USING (doc_id) ORDER BY s DESC, doc_id LIMIT 25", emails=False)
def _(spark, d):
    v = read(spark, d, "embeddings")
    return _found(search.search(as_emails(spark, d), opened(spark, d), "the", mode="hybrid", embedded=v, embed=lambda _: _first(v)))
