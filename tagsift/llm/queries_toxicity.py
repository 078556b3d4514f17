"""Query op11 (toxicity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.llm.shared import table
from tagsift.llm.toxicity import learn, score

THRESHOLD = 0.3


def op11_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    known = labels.where(~held_out & F.col("toxic").isNotNull())
    # The class prior: the toxic share of the labelled rows that may be learned from.
    prior = known.agg(F.avg("toxic").alias("p")).first()["p"]
    prior = min(max(prior or 0.0, 0.001), 0.5)
    model = learn(docs, known.where("toxic = 1"), ~held_out, prior)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLE = {}
