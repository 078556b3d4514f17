"""Streaming queries (ST-01, ST-02): stream the fixture rows as files, return the final state."""

from __future__ import annotations

import uuid

from tagsift.session import checkpoint_path
from tagsift.sources.fixtures import fixture
from tagsift.streaming.running import running_confusion, streaming_local_evidence

BATCHES = 8


def _land(df, path, by):
    """Write the rows as files (the 'arriving' inputs), cut by ``by``; as many as the session has shuffle partitions.  Their number is returned."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.mode("overwrite").parquet(path)
    return n


def q_stream_confusion(spark, sf):
    """ST-01: running confusion matrix over the evaluation rows, final state."""
    run = uuid.uuid4().hex
    src = checkpoint_path(spark, f"st01-src-{run}")
    e = fixture(spark, sf, "fx_eval")
    n = _land(e, src, "row_id")
    return running_confusion(spark, src, e.schema, checkpoint_path(spark, f"st01-ckpt-{run}"), f"st01_{run}", files_per_batch=-(-n // BATCHES))


def q_stream_local_evidence(spark, sf):
    """ST-02: local evidence from prediction files of whole documents, two files a batch, final state."""
    run = uuid.uuid4().hex
    src = checkpoint_path(spark, f"st02-src-{run}")
    p = fixture(spark, sf, "fx_prediction_long")
    p.repartition("doc_id").write.parquet(src)
    return streaming_local_evidence(spark, src, p.schema, checkpoint_path(spark, f"st02-out-{run}"),
                                    checkpoint_path(spark, f"st02-ckpt-{run}"), files_per_batch=2, threshold=1.01, min_count=1)


QUERIES = {
    "stream_confusion": q_stream_confusion,
    "stream_local_evidence": q_stream_local_evidence,
}

ORACLE = {
    "stream_confusion": """
WITH e AS (SELECT label % 5 AS label, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 5 ELSE label % 5 END AS prediction FROM embeddings)
SELECT label, prediction, count(*) AS n FROM e GROUP BY label, prediction""",
}


def _oracle_st02():
    from tagsift.plans.lists import ORACLE as L
    return L["local_evidence"]


ORACLE["stream_local_evidence"] = _oracle_st02()
