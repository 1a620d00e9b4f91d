"""Stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents. Rows are dropped only by a stage's own decision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import packing as packing_op
from tallyspark.llm import pii as pii_op
from tallyspark.llm import quality as quality_op
from tallyspark.llm import simhash, toxicity
from tallyspark.llm.common import broadcast_if_small, checkpoint, checkpoint_dir, pii_key, remove, table, text_of

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep. The counts are those of docs; trusted are the texts that labels call good."""
    return quality_op.kept_rows(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't predicted toxic, by a model learnt from docs and labels."""
    return toxicity.kept_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id.

    Rows with a null id stand for themselves and are kept. Of rows that share the smallest id, all
    are kept if their texts differ; equal rows give one.
    """
    classes = simhash.near_duplicates(docs)
    dropped = checkpoint(classes.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = checkpoint(classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(broadcast_if_small(dropped), "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    again = broadcast_if_small(repeated)
    # Rows of one id may be in several classes: each is judged by its own fingerprint.
    rows = docs.join(again, "doc_id", "left_semi").select(*docs.columns).distinct().withColumn("_k", F.xxhash64(text_of()))
    prints = simhash.fingerprints(rows.select("_k", "text").distinct(), "_k").select(F.col("_id").alias("_k"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")).distinct()
    first = classes.where("doc_id = component_id").select("doc_id", "fingerprint").distinct()
    own = rows.join(prints, "_k").join(first, ["doc_id", "fingerprint"], "left_semi").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(own)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for PII in their texts; n_chars is the new text's."""
    return pii_op.pseudonymise(docs, pii_key(spark)).drop("n_pii", "pii_kinds").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in a batch of its length bucket."""
    return packing_op.pack(docs)


def run(spark: SparkSession, sf_dir: str, stages: list[Stage]) -> DataFrame:
    """The stages in order over documents; each result is written to the shared folder and read again.

    A stage's table is removed when the next one is written. The last one is what is returned, so it
    stays; it is the caller's to copy and remove.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(stages):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
