"""Metric queries (EV-*, AGG-10..13, SRC-16/17) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.operators import metrics as mt
from tagsift.sources.fixtures import duck_with, fixture

NUM_CLASSES = 6   # five labels plus the classifier's extra output (Q-10)


def q_confusion(spark, sf):
    """AGG-13: weighted confusion matrix."""
    return mt.confusion_matrix(fixture(spark, sf, "fx_eval"), weight="weight")


def q_eval_report(spark, sf):
    """EV-01..05: accuracy (weighted) and micro / macro / weighted P, R, F1 over 6 classes."""
    rows = fixture(spark, sf, "fx_eval")
    return mt.eval_report(rows, NUM_CLASSES, weight="weight", loss=mt.cross_entropy(F.col("probs"), F.col("label")))


def q_prf_positive(spark, sf):
    """EV-02..04 with positive classes 1..4 (class 0 treated as negative), beta 2, per averaging."""
    cm = mt.confusion_matrix(fixture(spark, sf, "fx_eval"))
    return mt.prf_rows(cm, NUM_CLASSES, ["micro", "macro", "weighted"], pos_indices=[1, 2, 3, 4], beta=2.0)


def _binary(spark, sf):
    s = fixture(spark, sf, "fx_score")
    return s.select(F.col("y_true").alias("label"), F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("prediction"))


def q_binary_report(spark, sf):
    """EV-07: binary relation report (class 1 P/R/F1, specificity)."""
    return mt.binary_report(_binary(spark, sf))


def q_relation_micro(spark, sf):
    """EV-08: string gold labels (missing -> 'False') indexed by sorted order; micro P/R/F over 0..4."""
    e = fixture(spark, sf, "fx_eval")
    e = e.withColumn("gold", F.when(F.col("label") == 0, F.lit(None)).otherwise(
        F.concat(F.lit("CPR:"), F.col("label").cast("string"))))
    idx = mt.label_index(e, "gold", [f"CPR:{i}" for i in range(1, 5)])
    cm = mt.confusion_matrix(idx, "label_index", "prediction")
    return mt.prf(cm, NUM_CLASSES, "micro", pos_indices=[0, 1, 2, 3, 4])


def q_pr_curve(spark, sf):
    """EV-06: precision / recall / F1 per score threshold."""
    return mt.pr_curve(fixture(spark, sf, "fx_score"))


def q_pr_summary(spark, sf):
    """EV-06: best F1, best threshold, area under the PR curve."""
    return mt.pr_summary(mt.pr_curve(fixture(spark, sf, "fx_score")))


def q_chunk_eval(spark, sf):
    """EV-09: chunk-level P / R / F1 per type and overall, token accuracy."""
    return mt.chunk_eval(fixture(spark, sf, "fx_token_tag"))


def q_run_results(spark, sf):
    """SRC-17: last TEST-RESULT line per log file, parsed."""
    return mt.parse_run_results(fixture(spark, sf, "fx_log_line"))


def q_run_summary(spark, sf):
    """AGG-10: run scores per hyper-parameter setting: number, mean, population std."""
    return mt.run_summary(mt.parse_run_results(fixture(spark, sf, "fx_log_line")))


def q_latency(spark, sf):
    """AGG-11 + EV-10: latency mean and percentiles after 2 warm-up batches, throughput at batch 8."""
    return mt.latency_summary(fixture(spark, sf, "fx_batch_time"), batch_size=8)


def q_latency_engine(spark, sf):
    """AGG-12: engine-benchmark percentiles (one rank higher, no warm-up skip)."""
    return mt.latency_summary(fixture(spark, sf, "fx_batch_time"), skip_first=0, quantiles=(0.95, 0.99),
                              rank_offset=1)


QUERIES = {
    "confusion_matrix": q_confusion,
    "eval_report": q_eval_report,
    "prf_positive_classes": q_prf_positive,
    "binary_report": q_binary_report,
    "relation_micro": q_relation_micro,
    "pr_curve": q_pr_curve,
    "pr_summary": q_pr_summary,
    "chunk_eval": q_chunk_eval,
    "run_results": q_run_results,
    "run_summary": q_run_summary,
    "latency_summary": q_latency,
    "latency_engine": q_latency_engine,
}

# ---------------------------------------------------------------------------

_PC = """
cls AS (SELECT CAST(range AS INTEGER) AS cls FROM range({k})),
pc AS (SELECT c.cls,
              coalesce((SELECT sum(n) FROM cm WHERE label = c.cls AND prediction = c.cls), 0) AS tp,
              coalesce((SELECT sum(n) FROM cm WHERE prediction = c.cls), 0) AS np,
              coalesce((SELECT sum(n) FROM cm WHERE label = c.cls), 0) AS ng FROM cls c {where}),
pcs AS (SELECT cls, ng, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS p, CASE WHEN ng = 0 THEN 0 ELSE tp / ng END AS r FROM pc),
pcf AS (SELECT *, CASE WHEN {b2} * p + r = 0 THEN 0 ELSE (1 + {b2}) * p * r / ({b2} * p + r) END AS f FROM pcs)
"""


def _pc(k=NUM_CLASSES, where="", b2="1.0e0"):
    return _PC.format(k=k, where=where, b2=b2)


_CM = "cm AS (SELECT label, prediction, CAST(count(*) AS DOUBLE) AS n FROM fx_eval GROUP BY label, prediction)"

_EVAL = duck_with("fx_eval") + ",\n" + _CM + ",\n" + _pc() + """,
mi AS (SELECT sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n) AS p FROM cm)
SELECT 'eval_accuracy' AS metric, sum(weight * CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) / sum(weight) AS value FROM fx_eval
UNION ALL SELECT 'eval_loss', sum(weight * -ln(probs[label + 1])) / sum(weight) FROM fx_eval
UNION ALL SELECT 'precision', p FROM mi UNION ALL SELECT 'recall', p FROM mi
UNION ALL SELECT 'f1-score', CASE WHEN p = 0 THEN 0 ELSE 2 * p * p / (p + p) END FROM mi
UNION ALL SELECT 'precision_mac', sum(p) / 6 FROM pcf UNION ALL SELECT 'recall_mac', sum(r) / 6 FROM pcf
UNION ALL SELECT 'f1-macro', sum(f) / 6 FROM pcf
UNION ALL SELECT 'precision_weighted', sum(p * ng) / sum(ng) FROM pcf
UNION ALL SELECT 'recall_weighted', sum(r * ng) / sum(ng) FROM pcf
UNION ALL SELECT 'f1-weighted', sum(f * ng) / sum(ng) FROM pcf"""

_PRF_POS = duck_with("fx_eval") + ",\n" + _CM + ",\n" + _pc(where="WHERE c.cls IN (1, 2, 3, 4)", b2="4.0e0") + """,
mic AS (SELECT sum(CASE WHEN label = prediction AND label IN (1,2,3,4) THEN n ELSE 0 END) AS d,
               sum(CASE WHEN prediction IN (1,2,3,4) THEN n ELSE 0 END) AS tpred,
               sum(CASE WHEN label IN (1,2,3,4) THEN n ELSE 0 END) AS tgold FROM cm),
mi AS (SELECT CASE WHEN tpred = 0 THEN 0 ELSE d / tpred END AS p, CASE WHEN tgold = 0 THEN 0 ELSE d / tgold END AS r FROM mic)
SELECT 'micro' AS average, p AS precision, r AS recall,
       CASE WHEN 4.0 * p + r = 0 THEN 0 ELSE 5.0 * p * r / (4.0 * p + r) END AS fbeta FROM mi
UNION ALL SELECT 'macro', sum(p) / 4, sum(r) / 4, sum(f) / 4 FROM pcf
UNION ALL SELECT 'weighted', CASE WHEN sum(ng) = 0 THEN 0 ELSE sum(p * ng) / sum(ng) END,
                 CASE WHEN sum(ng) = 0 THEN 0 ELSE sum(r * ng) / sum(ng) END,
                 CASE WHEN sum(ng) = 0 THEN 0 ELSE sum(f * ng) / sum(ng) END FROM pcf"""

_BIN = duck_with("fx_score") + """,
b AS (SELECT y_true AS label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM fx_score),
cm AS (SELECT label, prediction, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY label, prediction),
""" + _pc(k=2) + """
SELECT max(CASE WHEN cls = 1 THEN f END) AS f1, max(CASE WHEN cls = 1 THEN r END) AS recall,
       max(CASE WHEN cls = 1 THEN p END) AS precision, max(CASE WHEN cls = 0 THEN r END) AS specificity FROM pcf"""

_REL = duck_with("fx_eval") + """,
g AS (SELECT *, coalesce(CASE WHEN label = 0 THEN NULL ELSE 'CPR:' || CAST(label AS VARCHAR) END, 'False') AS gold FROM fx_eval),
ix AS (SELECT gold, CAST(dense_rank() OVER (ORDER BY gold) - 1 AS INTEGER) AS li FROM (SELECT DISTINCT gold FROM g)),
cm AS (SELECT ix.li AS label, g.prediction, CAST(count(*) AS DOUBLE) AS n FROM g JOIN ix ON g.gold = ix.gold GROUP BY ix.li, g.prediction),
mic AS (SELECT sum(CASE WHEN label = prediction AND label IN (0,1,2,3,4) THEN n ELSE 0 END) AS d,
               sum(CASE WHEN prediction IN (0,1,2,3,4) THEN n ELSE 0 END) AS tpred,
               sum(CASE WHEN label IN (0,1,2,3,4) THEN n ELSE 0 END) AS tgold FROM cm),
mi AS (SELECT CASE WHEN tpred = 0 THEN 0 ELSE d / tpred END AS p, CASE WHEN tgold = 0 THEN 0 ELSE d / tgold END AS r FROM mic)
SELECT p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS fbeta FROM mi"""

_CURVE = duck_with("fx_score") + """,
per AS (SELECT score AS threshold, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg FROM fx_score GROUP BY score),
c AS (SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
             CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
             sum(pos) OVER () AS npos FROM per),
pr AS (SELECT threshold, tp, fp, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
              CASE WHEN npos = 0 THEN 1.0 ELSE tp / npos END AS recall FROM c),
curve AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * recall * precision / (recall + precision) END AS f1 FROM pr)
"""

# Chunks as groups of tokens: a token that can't be of one chunk with the token before it begins a group, and a
# group is a chunk unless it stands outside.
_CHUNK_SIDE = """
{w}0 AS (SELECT sent_id, pos, string_split({w}, '-')[1] AS mark, substr({w}, len(string_split({w}, '-')[1]) + 2) AS ct FROM fx_token_tag),
{w}1 AS (SELECT *, mark IN ('I', 'E') AND lag(mark IN ('B', 'I')) OVER o AND lag(ct) OVER o = ct AS joined
         FROM {w}0 WINDOW o AS (PARTITION BY sent_id ORDER BY pos)),
{w}2 AS (SELECT *, count(*) FILTER (coalesce(joined, false) = false) OVER (PARTITION BY sent_id ORDER BY pos) AS grp FROM {w}1),
{w}c AS (SELECT sent_id, min(pos) AS start, max(pos) AS stop, min(ct) AS type FROM {w}2 GROUP BY sent_id, grp
         HAVING bool_and(mark NOT IN ('O', '.')))
"""

_CHUNK = duck_with("fx_token_tag") + "," + _CHUNK_SIDE.format(w="gold") + "," + _CHUNK_SIDE.format(w="pred") + """,
cor AS (SELECT g.type, count(*) AS correct FROM goldc g JOIN predc p
        ON g.sent_id = p.sent_id AND g.start = p.start AND g.stop = p.stop AND g.type = p.type GROUP BY g.type),
gl AS (SELECT type, count(*) AS gold FROM goldc GROUP BY type),
gu AS (SELECT type, count(*) AS guessed FROM predc GROUP BY type),
bt AS (SELECT coalesce(gl.type, gu.type) AS type, coalesce(gold, 0) AS gold, coalesce(guessed, 0) AS guessed
       FROM gl FULL JOIN gu ON gl.type = gu.type),
cor_all AS (SELECT 1 FROM goldc g JOIN predc p ON g.sent_id = p.sent_id AND g.start = p.start AND g.stop = p.stop AND g.type = p.type),
rows_ AS (SELECT bt.type, bt.gold, bt.guessed, coalesce(cor.correct, 0) AS correct FROM bt LEFT JOIN cor ON bt.type = cor.type
          UNION ALL SELECT '__overall__', (SELECT count(*) FROM goldc), (SELECT count(*) FROM predc), (SELECT count(*) FROM cor_all)),
m AS (SELECT type, CAST(gold AS BIGINT) AS gold, CAST(guessed AS BIGINT) AS guessed, CAST(correct AS BIGINT) AS correct,
             CASE WHEN guessed = 0 THEN 0 ELSE correct / guessed END AS precision,
             CASE WHEN gold = 0 THEN 0 ELSE correct / gold END AS recall FROM rows_),
acc AS (SELECT '__overall__' AS type, count(*) AS tokens, CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS BIGINT) AS correct_tags
        FROM fx_token_tag)
SELECT m.*, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
       acc.tokens, acc.correct_tags, CASE WHEN acc.tokens = 0 THEN 0 ELSE acc.correct_tags / acc.tokens END AS accuracy
FROM m LEFT JOIN acc ON m.type = acc.type"""

_RUN_RE = (r"^TEST-RESULT\s+init_checkpoint\s+(\S+)\s+data_dir\s+(\S+)\s+max_seq_length\s+(\d+)"
           r"\s+train_batch_size\s+(\d+)\s+learning_rate\s+(\S+)\s+num_train_epochs\s+(\d+)"
           r"\s+f-score\s+(\d+\.\d+)\s+accuracy\s+(\d+\.\d+)$")
_RUN_NAMES = ("init_checkpoint", "data_dir", "max_seq_length", "train_batch_size", "learning_rate",
              "num_train_epochs", "f_score", "accuracy")
_RUNS = duck_with("fx_log_line") + """,
m AS (SELECT file_name, line_no, """ + ", ".join(
    f"regexp_extract(line, '{_RUN_RE}', {i + 1}) AS {n}" for i, n in enumerate(_RUN_NAMES)) + f"""
      FROM fx_log_line WHERE starts_with(line, 'TEST-RESULT') AND regexp_matches(line, '{_RUN_RE}')),
runs AS (SELECT * EXCLUDE (line_no) FROM m QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY line_no DESC) = 1)
"""

_LAT = duck_with("fx_batch_time") + """,
b AS (SELECT * FROM fx_batch_time QUALIFY row_number() OVER (ORDER BY batch_no) > {skip}),
r AS (SELECT elapsed_ms, row_number() OVER (ORDER BY elapsed_ms, batch_no) AS rk FROM b),
nn AS (SELECT count(*) AS n, avg(elapsed_ms) AS mean, sum(elapsed_ms) AS total FROM b),
q AS (SELECT * FROM (VALUES {qs}) t(metric, q)),
k AS (SELECT q.metric, CAST(floor(nn.n * q.q) + {off} AS BIGINT) AS k FROM q, nn)
SELECT k.metric, r.elapsed_ms AS value FROM k LEFT JOIN r ON r.rk = k.k
"""

ORACLE = {
    "confusion_matrix": duck_with("fx_eval") + """
SELECT label, prediction, sum(weight) AS n FROM fx_eval GROUP BY label, prediction""",
    "eval_report": _EVAL,
    "prf_positive_classes": _PRF_POS,
    "binary_report": _BIN,
    "relation_micro": _REL,
    "pr_curve": _CURVE + " SELECT * FROM curve",
    "pr_summary": _CURVE + """,
seg AS (SELECT threshold, f1, (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0.0))
                 * (precision + coalesce(lag(precision) OVER (ORDER BY threshold DESC), 1.0)) / 2.0 AS s FROM curve)
SELECT max(coalesce(f1, 0.0)) AS best_f1,
       (SELECT threshold FROM curve ORDER BY coalesce(f1, 0.0) DESC, threshold ASC LIMIT 1) AS best_threshold,
       sum(s) AS auc_pr FROM seg""",
    "chunk_eval": _CHUNK,
    "run_results": _RUNS + " SELECT * FROM runs",
    "run_summary": _RUNS + """
SELECT init_checkpoint, learning_rate, num_train_epochs, train_batch_size, max_seq_length,
       count(*) AS n,
       avg(CAST(accuracy AS DOUBLE)) AS mean, stddev_pop(CAST(accuracy AS DOUBLE)) AS std
FROM runs GROUP BY ALL""",
    "latency_summary": _LAT.format(skip=2, off=0, qs="('p50', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99), ('p100', 1.0)")
    + " UNION ALL SELECT 'mean', mean FROM nn UNION ALL SELECT 'throughput', n * 8 / (total / 1000.0) FROM nn",
    "latency_engine": _LAT.format(skip=0, off=1, qs="('p95', 0.95), ('p99', 0.99)")
    + " UNION ALL SELECT 'mean', mean FROM nn",
}
