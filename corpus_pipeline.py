"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``; the last returns packed
pieces with their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsift.llm import secrets
from tagsift.llm.neardup import BROADCAST_IDS, near_duplicates, text_digest
from tagsift.llm.packing import pack
from tagsift.llm.quality import judge
from tagsift.llm.shared import table, written
from tagsift.llm.winnowing import decontaminate


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on documents and hosts."""
    return judge(docs).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words): the one with the smallest doc_id.

    Rows are told apart by (doc_id, text), so a doc_id at several texts loses only those that are copies.  Of rows
    that repeat both, one stays: the first by its columns as JSON.  Rows without a doc_id, and of null or empty texts, are copies of
    nothing and stay; an empty table gives no rows.
    """
    found = near_duplicates(docs, words=5)
    marks = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "digest").agg(
        F.bool_and("chosen").alias("chosen"), F.count(F.lit(1)).alias("n"))
    marks = written(marks.where("NOT chosen OR n > 1"), "marks")
    few = marks.count() <= BROADCAST_IDS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("_id"),
                       text_digest(F.col("text")).alias("_digest"))
    on = (F.col("_id") == F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    rows = rows.join(F.broadcast(marks) if few else marks, on, "left")
    once = rows.where("chosen IS NULL").select("doc.*")
    again = rows.where("chosen").groupBy("_id", "_digest").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc.*")
    return once.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark (n_chars follows the text)."""
    found = secrets.find_secrets(docs)
    out = found.withColumn("new", secrets.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("new")).otherwise(F.col("doc.text")),
           "n_chars": F.when(changed, F.length("new")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", packing)]

# Tokenisation has no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
