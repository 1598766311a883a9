"""A training corpus out of `documents`: rules, classifier, near and substring dedup, packing, one stage after another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import classifier, fingerprints, minhash, packing, quality_rules
from postlake.llm.queries import table, vocabulary
from postlake.llm.shared import delete, shared_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fingerprints.remove(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality_rules", rules), ("quality_classifier", quality), ("minhash_near_dedup", near_duplicates), ("substring_dedup", substrings), ("best_fit_packing", packed)]

#: The classifier and MinHash stages cannot be said in SQL; tests hold the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and reread by the next, and goes once that is whole."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
    return docs
