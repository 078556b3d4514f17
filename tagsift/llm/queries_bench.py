"""Query op7 (benchmark decontamination)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.llm.shared import table
from tagsift.llm.winnowing import decontaminate


def op7_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc.doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.size("hits") > 0).alias("contaminated"))


# Reusable: words of documents and hits of windows, for a relation {docs}.
HITS_SQL = r"""
  b_w AS (SELECT doc_id, list_filter(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {docs}),
  b_i AS (SELECT item_id, list_filter(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
  b_n AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b_i WHERE len(w) > 0)),
  b_d AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM b_w, (SELECT DISTINCT n FROM b_n) WHERE len(w) >= n)),
  b_h AS (SELECT doc_id, item_id, i, n FROM b_d JOIN b_n USING (n, win)),
  b_c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM b_h)) GROUP BY doc_id),
  b_s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM b_h) GROUP BY doc_id)"""

OP7_SQL = "WITH" + HITS_SQL.format(docs="documents") + """
SELECT b_w.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM b_w LEFT JOIN b_c USING (doc_id) LEFT JOIN b_s USING (doc_id)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE = {"op7_decontamination": OP7_SQL}
