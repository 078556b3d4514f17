"""QA window and n-best queries (QA-*, TOP-02/03, JN-11, WIN-05) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.operators import qa
from tagsift.operators.passages import max_context_regular, white_words
from tagsift.sources.fixtures import duck_with, fixture, table

N_BEST, MAX_ANSWER = 20, 30
MAX_TOKENS, STRIDE = 128, 64


def q_best_starts(spark, sf):
    """TOP-02: the 20 best start positions per example."""
    return qa.best_indexes(fixture(spark, sf, "fx_logit"), "start_logit", N_BEST)


def q_nbest(spark, sf):
    """QA-04/07 + JN-11 + TOP-03: n-best answers with probabilities (n = 20, max length 30)."""
    return qa.nbest(fixture(spark, sf, "fx_logit"), N_BEST, MAX_ANSWER)


def q_predictions(spark, sf):
    """QA-05: final answer per example with the null-score difference (threshold 0)."""
    return qa.predictions(qa.nbest(fixture(spark, sf, "fx_logit"), N_BEST, MAX_ANSWER))


def _lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(white_words("text")).alias("n"))


def _windows(spark, sf):
    return _lengths(spark, sf).select("doc_id", F.posexplode(qa.window_spans("n", MAX_TOKENS, STRIDE)).alias("window", "w")) \
            .select("doc_id", "window", F.col("w.start").alias("start"), F.col("w.length").alias("length"))


def q_windows(spark, sf):
    """QA-02/03: all sliding windows (128 tokens, stride 64) over every document's whitespace tokens."""
    return _windows(spark, sf)


def q_max_context(spark, sf):
    """WIN-05: for every document token, the window giving it the most context."""
    return max_context_regular(_lengths(spark, sf), "doc_id", "n", MAX_TOKENS, STRIDE)


QUERIES = {
    "qa_best_starts": q_best_starts,
    "qa_nbest": q_nbest,
    "qa_predictions": q_predictions,
    "qa_windows": q_windows,
    "qa_max_context": q_max_context,
}

_NB = duck_with("fx_logit") + f""",
s AS (SELECT example_id, pos AS start, start_logit, row_number() OVER (PARTITION BY example_id ORDER BY start_logit DESC, pos) AS s_rank
      FROM fx_logit QUALIFY s_rank <= {N_BEST}),
e AS (SELECT example_id, pos AS "end", end_logit, row_number() OVER (PARTITION BY example_id ORDER BY end_logit DESC, pos) AS e_rank
      FROM fx_logit QUALIFY e_rank <= {N_BEST}),
pre AS (SELECT s.example_id, start, "end", start_logit, end_logit, s_rank, e_rank FROM s JOIN e ON s.example_id = e.example_id
        WHERE start >= 1 AND "end" >= 1 AND "end" >= start AND "end" - start + 1 <= {MAX_ANSWER}
        UNION ALL SELECT example_id, 0, 0, start_logit, end_logit, {N_BEST + 1}, {N_BEST + 1} FROM fx_logit WHERE pos = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY start_logit + end_logit DESC, s_rank, e_rank) AS rank FROM pre),
kept AS (SELECT * FROM rk WHERE rank <= {N_BEST} OR start = 0),
mx AS (SELECT *, max(start_logit + end_logit) OVER (PARTITION BY example_id) AS m FROM kept),
nb AS (SELECT example_id, rank, CASE WHEN start = 0 THEN '' ELSE CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) END AS text,
              start, "end", start_logit, end_logit,
              exp(start_logit + end_logit - m) / sum(exp(start_logit + end_logit - m)) OVER (PARTITION BY example_id)
              AS probability FROM mx)
"""

_WIN = f"""
WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\x{{202F}}]+'), lambda x: x <> '')) AS n FROM documents),
k AS (SELECT doc_id, n, 1 + CAST(ceil(greatest(n - {MAX_TOKENS}, 0) / {min(MAX_TOKENS, STRIDE)}) AS BIGINT) AS k FROM d WHERE n > 0),
win AS (SELECT doc_id, CAST(i AS INTEGER) AS "window", CAST(i * {min(MAX_TOKENS, STRIDE)} AS INTEGER) AS start,
               CAST(least({MAX_TOKENS}, n - i * {min(MAX_TOKENS, STRIDE)}) AS INTEGER) AS length
        FROM k CROSS JOIN LATERAL range(0, k.k) AS r(i))
"""

ORACLE = {
    "qa_best_starts": duck_with("fx_logit") + f"""
SELECT example_id, pos, start_logit, row_number() OVER (PARTITION BY example_id ORDER BY start_logit DESC, pos) AS rank
FROM fx_logit QUALIFY rank <= {N_BEST}""",
    "qa_nbest": _NB + " SELECT * FROM nb",
    "qa_predictions": _NB + """,
nul AS (SELECT example_id, start_logit + end_logit AS null_score FROM nb WHERE text = ''),
best AS (SELECT example_id, text, start_logit + end_logit AS score FROM nb WHERE text <> ''
         QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY rank) = 1)
SELECT nul.example_id, CASE WHEN best.text IS NULL OR nul.null_score - best.score > 0.0 THEN '' ELSE best.text END AS prediction,
       nul.null_score - best.score AS score_diff
FROM nul LEFT JOIN best ON nul.example_id = best.example_id""",
    "qa_windows": _WIN + " SELECT * FROM win",
    "qa_max_context": _WIN + """,
t AS (SELECT doc_id, "window", start, length, CAST(p AS INTEGER) AS pos FROM win CROSS JOIN LATERAL range(start, start + length) AS r(p))
SELECT doc_id, pos, "window" FROM t
QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY least(pos - start, start + length - 1 - pos) + 0.01 * length DESC, "window") = 1""",
}
