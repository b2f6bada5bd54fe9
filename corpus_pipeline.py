"""The corpus pipeline: quality rules, near-dedup, decontamination, redaction, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns
a DataFrame; all but the last return the columns of ``documents``. Rows are
told apart by a key of their own, not by doc_id, which may be null or repeated. ``run`` writes every stage's result
to the shared folder and reads it back, so a lost executor costs one stage at most, and deletes it when the next one is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.bpe import encode_documents
from alphaloom.llm.common import forget, keyed, table, written
from alphaloom.llm.decontaminate import decontaminated
from alphaloom.llm.near_dedup import near_duplicates
from alphaloom.llm.pii import redact
from alphaloom.llm.quality_rules import apply_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without boilerplate lines."""
    return apply_rules(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; one without an id only if no other has one."""
    rows, key = keyed(spark, docs)
    number = F.col("doc_id").cast("long")
    found = near_duplicates(spark, rows.select(F.col(key).alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    # texts without shingles link with nothing: repeated rows among them are told by id and text
    plain = (F.col("n_shingles") == 0) & number.isNotNull()
    group = [F.when(~plain, F.col("component_id")), F.when(plain, number), F.when(plain, F.col("content"))]
    ids = rows.select(F.col(key).alias("row"), "doc_id", F.xxhash64("text").alias("content")).join(found, "row")
    kept = ids.groupBy(*group).agg(F.min(F.struct(number.isNull().alias("none"), number.alias("id"), "row"))["row"].alias(key)).select(key)
    return rows.join(kept, key, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest and that of the bytes they decode to."""
    return encode_documents(spark, docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("bpe", encode)]

#: Near-dedup's components and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(spark, stage(spark, docs, sf_dir), name)
        if k:
            forget(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
