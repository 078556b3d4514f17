"""Queries op2 (near-duplicates), op3 (repeated passages) and op10 (language identification)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.llm.langid import identify, learn
from tagsift.llm.neardup import near_duplicates
from tagsift.llm.shared import table
from tagsift.llm.substrings import remove_repeats


def op2_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_substrings(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = identify(docs, learn(docs, ~held_out))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_near_dedup": op2_near_dedup, "op3_substrings": op3_substrings, "op10_language": op10_language}
OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT win, min(doc_id) AS first_id FROM g GROUP BY win),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (win) WHERE doc_id > first_id),
k AS (SELECT doc_id, count(p.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (p.p IS NULL), '') AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) x LEFT JOIN p USING (doc_id, p)
      GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

ORACLE = {"op3_substrings": OP3_SQL}
