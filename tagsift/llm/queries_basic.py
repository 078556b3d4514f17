"""Queries op5 (sharding) and op9 (content-addressed archive)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.llm import sharding, warc
from tagsift.llm.shared import table

N_SHARDS = 40


def op5_sharding(spark, sf_dir):
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * N_SHARDS)
    return out.withColumn("law", F.lit("key"))


def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = warc.archive_folder(spark)
    warc.write_archive(pages, path)
    key = pages.schema["page_id"].dataType
    return warc.read_archive(spark, path).select(
        F.col("key").cast(key).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key).alias("refers_to"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         strlen(coalesce(html, '')) AS payload_bytes
  FROM pages),
g AS (SELECT h, payload_bytes, min(page_id) AS first_id FROM p GROUP BY ALL),
d AS (
  SELECT h, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)),
         'string_agg', '') AS payload_digest
  FROM (SELECT DISTINCT h FROM g))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g USING (h, payload_bytes) JOIN d USING (h)
"""

QUERIES = {"op5_sharding": op5_sharding, "op9_warc": op9_warc}
ORACLE = {"op9_warc": OP9_SQL}
