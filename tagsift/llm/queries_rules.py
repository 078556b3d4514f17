"""Queries op4 (secret scans) and op6 (quality rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.llm import secrets
from tagsift.llm.quality import MAX_HOST_RATE, judge
from tagsift.llm.shared import table


def op4_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < secrets.KINDS.index("markov"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(secrets.KINDS)]
    return found.select("doc.doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def op6_quality(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "host_failed", "kept")


# Reusable: one row per document of a relation {docs}, with the columns of op6_quality.
JUDGED_SQL = r"""
  q_w AS (SELECT doc_id, source, coalesce(text, '') AS text,
                 list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM {docs}),
  q_l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM q_w)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  q_s AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM q_w WHERE len(w) >= 8)),
  q_r AS (SELECT doc_id, i FROM q_s QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
  q_p AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM q_r) GROUP BY doc_id),
  q_c AS (SELECT doc_id, source, len(w) AS n_words,
                 length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM q_w LEFT JOIN q_l USING (doc_id) LEFT JOIN q_p USING (doc_id)),
  q_f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
                 OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS soft FROM q_c),
  q_h AS (SELECT source, count(*) AS n, count_if(base_failed OR soft) AS f FROM q_f WHERE source IS NOT NULL
          GROUP BY source),
  q_m AS (SELECT sum(f) / sum(n) AS m, coalesce(var_pop(f / n), 0) AS v FROM q_h),
  q_t AS (SELECT m, CASE WHEN v > 0 THEN greatest(10, m * (1 - m) / v - 1) ELSE 10 END AS s FROM q_m),
  q_b AS (SELECT source, (f + m * s) / (n + s) > {rate} AS bad FROM q_h, q_t),
  q_j AS (SELECT q_f.*, coalesce(bad, false) AND soft AS host_failed,
                 NOT base_failed AND NOT (coalesce(bad, false) AND soft) AS kept
          FROM q_f LEFT JOIN q_b USING (source))"""

OP6_SQL = "WITH" + JUDGED_SQL.format(docs="documents", rate=MAX_HOST_RATE) + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, kept FROM q_j
"""

QUERIES = {"op4_secrets": op4_secrets, "op6_quality": op6_quality}
ORACLE = {"op6_quality": OP6_SQL}
