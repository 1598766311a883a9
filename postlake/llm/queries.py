"""The registered queries of this subpackage, one per operator, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import bpe, classifier, fim, fingerprints, langid, minhash, mixing, packing, periodic, projections, quality_rules, suffix, warc


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.dedup(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' archive against a replica in which every 97th record had a byte overwritten and every 211th is missing; what follows these is moved."""
    recs = warc.records(table(spark, sf_dir, "pages"))
    return warc.audit(recs, warc.corrupted(recs, F.col("page_id") % 97 == 5).where(~F.coalesce(F.col("page_id") % 211 == 7, F.lit(False))))


OP7_SQL = """
WITH p AS (SELECT page_id, page_id // 256 AS file, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages),
r AS (SELECT *, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', u, chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(h), chr(13), chr(10), chr(13), chr(10)) AS head FROM p),
a AS (SELECT page_id, file, concat(head, h, chr(13), chr(10), chr(13), chr(10)) AS rec FROM r),
b AS (SELECT page_id, file, CASE WHEN page_id % 97 = 5 THEN concat(left(concat(head, h), length(concat(head, h)) - 1), '?', chr(13), chr(10), chr(13), chr(10)) ELSE concat(head, h, chr(13), chr(10), chr(13), chr(10)) END AS rec FROM r WHERE page_id % 211 <> 7),
x AS (SELECT page_id, file, sha256(rec) AS d, strlen(rec)::BIGINT AS len, coalesce(sum(strlen(rec)) OVER w, 0)::BIGINT AS off FROM a WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT page_id, file, sha256(rec) AS d, strlen(rec)::BIGINT AS len, coalesce(sum(strlen(rec)) OVER w, 0)::BIGINT AS off FROM b WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT x.file::BIGINT AS file, (page_id % 256)::BIGINT AS seq, page_id, CASE WHEN y.d IS NULL THEN 'missing in b' WHEN x.d <> y.d THEN 'content' ELSE 'moved' END AS kind, x.off AS offset_a, x.len AS length_a, x.d AS sha256_a, y.off AS offset_b, y.len AS length_b, y.d AS sha256_b FROM x LEFT JOIN y USING (page_id) WHERE y.d IS NULL OR x.d <> y.d OR x.off <> y.off
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near(table(spark, sf_dir, "embeddings"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a checksum of the id, gets a stretch of its own words over and over from some place on; rows without an id do not."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")).otherwise("")

    return docs.withColumn("text", F.when(F.coalesce(h % 10 == 0, F.lit(False)), quality_rules.let(quality_rules.words_of(F.col("text")), repeated)).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    told = F.array_join(F.transform("runs", line), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_bpe": op2_bpe,
        "op3_suffix_array": op3_suffix_array,
        "op4_quality_rules": op4_quality_rules,
        "op5_minhash": op5_minhash,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_warc": op7_warc,
        "op8_language_id": op8_language_id,
        "op9_packing": op9_packing,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_mixing": op11_mixing,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.ORACLE_SQL, "op7_warc": OP7_SQL, "op11_mixing": mixing.oracle()}
