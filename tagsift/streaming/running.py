"""Structured Streaming variants (ST-01, ST-02).

The reference has no event time, so there is no watermark: ST-01 keeps a
complete-mode aggregate over at most classes^2 keys; ST-02 processes
prediction files as they arrive and writes the evidence of each micro-batch
to a folder of its own, so a replayed batch (after a failure) writes the same
folder again instead of appending duplicates.  Both keep their state and progress in the shared
checkpoint folder and run with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsift.operators.evidence import local_evidence


# The state has classes^2 rows; each part of it costs a task and files in every batch.
STATE_PARTITIONS = 4


def running_confusion(spark: SparkSession, source_dir: str, schema, checkpoint: str, query_name: str,
                      label: str = "label", prediction: str = "prediction", files_per_batch: int = 1) -> DataFrame:
    """ST-01: confusion matrix updated batch by batch; returns the final state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    agg = stream.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
                .agg(F.count(F.lit(1)).alias("n"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), STATE_PARTITIONS)))     # a stream keeps the settings it starts with
    try:
        q = (agg.writeStream.outputMode("complete").format("memory").queryName(query_name)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    return spark.table(query_name)


def streaming_local_evidence(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint: str,
                             files_per_batch: int = 1, **evidence_kwargs) -> DataFrame:
    """ST-02: local evidence built as prediction files land; returns the evidence table.

    Each file holds whole documents, so the evidence of a micro-batch is final for the documents in it.
    A batch owns the folder ``batch=<id>`` and overwrites only that: a replay after a failure writes the
    same rows again, and files of any number and order lose nothing.  If a document lands again in a later
    file, the rows of its newest batch count.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        local_evidence(batch, **evidence_kwargs).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.lastProgress is None:        # no file has landed
        return local_evidence(spark.createDataFrame([], schema), **evidence_kwargs)
    landed = spark.read.parquet(out_dir)
    newest = landed.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return landed.join(newest, ["doc_id", "batch"]).drop("batch")
