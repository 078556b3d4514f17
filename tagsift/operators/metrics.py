"""Evaluation metrics (AGG-13, EV-01..10, AGG-10..12, WIN-06, SRC-16/17, PRJ-04).

Metrics are aggregates: the confusion matrix is one hash aggregate (at most
classes^2 groups, partial aggregation map-side); everything else is computed
from it or counted on a sentence's own row.  Whole-table orderings (PR curve,
latency percentiles) use ``global_running`` instead of an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tagsift.functions.scoring import safe_div
from tagsift.functions.text import bind
from tagsift.operators.features import label_id
from tagsift.operators.ordered import global_running


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- confusion matrix and P / R / F ------------------------------------------

def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     weight: str | None = None) -> DataFrame:
    """AGG-13: label, prediction, n (sum of weights, or row count)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
             .agg(F.sum(w).alias("n"))


def _fbeta(pr: Column, re: Column, beta: float) -> Column:
    return safe_div((1.0 + beta ** 2) * pr * re, beta ** 2 * pr + re)


def class_totals(cm: DataFrame, num_classes: int, extra: Sequence[Column] = ()) -> DataFrame:
    """One row: arrays tp, n_pred, n_gold by class 0..num_classes-1, from one aggregate over the matrix.

    Classes that never occur get zeros (Q-10: the class count is an argument).
    """
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0.0))

    lab, pred = F.col("label"), F.col("prediction")
    ids = range(num_classes)
    return cm.agg(F.array(*[total((lab == i) & (pred == i)) for i in ids]).alias("tp"),
                  F.array(*[total(pred == i) for i in ids]).alias("n_pred"),
                  F.array(*[total(lab == i) for i in ids]).alias("n_gold"), *extra)


def _averages(average: str, pos: Sequence[int], beta: float) -> tuple[Column, Column, Column]:
    """precision, recall, fbeta columns over the arrays of ``class_totals``."""
    def at(name: str, i: int) -> Column:
        return F.get(name, F.lit(i))

    def total(cols: Sequence[Column]) -> Column:
        return sum(cols, F.lit(0.0))

    if average == "micro":
        hit, said, real = (total([at(c, i) for i in pos]) for c in ("tp", "n_pred", "n_gold"))
        pr, re = safe_div(hit, said), safe_div(hit, real)
        return pr, re, _fbeta(pr, re, beta)
    each = []
    for i in pos:
        pr, re = safe_div(at("tp", i), at("n_pred", i)), safe_div(at("tp", i), at("n_gold", i))
        each.append((pr, re, _fbeta(pr, re, beta)))
    if average == "macro":
        return tuple(total([e[k] for e in each]) / F.lit(float(len(pos))) for k in range(3))
    if average == "weighted":
        real = total([at("n_gold", i) for i in pos])
        return tuple(safe_div(total([e[k] * at("n_gold", i) for e, i in zip(each, pos)]), real) for k in range(3))
    raise ValueError(average)


def prf_rows(cm: DataFrame, num_classes: int, averages: Sequence[str], pos_indices: Sequence[int] | None = None,
             beta: float = 1.0) -> DataFrame:
    """EV-02..04: one row (average, precision, recall, fbeta) for each averaging, from one pass over the matrix."""
    pos = list(range(num_classes)) if pos_indices is None else list(pos_indices)
    rows = []
    for avg in averages:
        pr, re, fb = _averages(avg, pos, beta)
        rows.append(F.struct(F.lit(avg).alias("average"), pr.alias("precision"), re.alias("recall"), fb.alias("fbeta")))
    return class_totals(cm, num_classes).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def prf(cm: DataFrame, num_classes: int, average: str = "micro", pos_indices: Sequence[int] | None = None,
        beta: float = 1.0) -> DataFrame:
    """EV-02..04: one row (precision, recall, fbeta) under ``micro``, ``macro`` or ``weighted`` averaging."""
    return prf_rows(cm, num_classes, [average], pos_indices, beta).drop("average")


def eval_report(df: DataFrame, num_classes: int, label: str = "label", prediction: str = "prediction",
                weight: str | None = "weight", loss: Column | None = None) -> DataFrame:
    """EV-01..05: the evaluation metrics as (metric, value) rows, from one aggregate over the rows.

    Accuracy and loss use the example weight; precision / recall / F1 use the row counts.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.sum(F.lit(1.0)).alias("n"), F.sum(w).alias("w"), F.sum(w * (loss if loss is not None else F.lit(0.0))).alias("w_loss"))
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("w")).otherwise(0.0))
    totals = class_totals(cells, num_classes, [F.sum("w").alias("w"), right.alias("w_right"), F.sum("w_loss").alias("w_loss")])
    out = [("eval_accuracy", safe_div(F.col("w_right"), F.col("w")))]
    if loss is not None:
        out.append(("eval_loss", safe_div(F.col("w_loss"), F.col("w"))))
    names = {"micro": ("precision", "recall", "f1-score"), "macro": ("precision_mac", "recall_mac", "f1-macro"),
             "weighted": ("precision_weighted", "recall_weighted", "f1-weighted")}
    for avg, of in names.items():
        out += zip(of, _averages(avg, range(num_classes), 1.0))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in out])
    return totals.select(F.explode(rows).alias("m")).select("m.*")


def cross_entropy(probs: Column, label: Column) -> Column:
    """FN-21: -log p[label] for an array of class probabilities (0-based label)."""
    return -F.log(F.element_at(probs, label + 1))


# --- binary / relation reports (EV-07, EV-08) --------------------------------

def binary_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EV-07: precision, recall, F1 of class 1 and specificity (= recall of class 0)."""
    t = class_totals(confusion_matrix(df, label, prediction), 2)
    pr, re = (safe_div(F.get("tp", F.lit(1)), F.get(c, F.lit(1))) for c in ("n_pred", "n_gold"))
    return t.select(_fbeta(pr, re, 1.0).alias("f1"), re.alias("recall"), pr.alias("precision"),
                    safe_div(F.get("tp", F.lit(0)), F.get("n_gold", F.lit(0))).alias("specificity"))


def label_index(df: DataFrame, label: str, labels: Sequence[str], missing: str = "False") -> DataFrame:
    """EV-08 / SRC-12: class index = place of the label in the sorted label list (missing -> ``missing``)."""
    return df.withColumn("_lab", F.coalesce(F.col(label), F.lit(missing))).withColumn(
        "label_index", label_id("_lab", [*labels, missing])).drop("_lab")


# --- PR curve (EV-06) ----------------------------------------------------------

def pr_curve(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """EV-06: one row per distinct score threshold: tp, fp, precision, recall, f1.

    tp / fp count the rows with score >= threshold; recall = tp / positives
    (1 when there are none).  Built on per-score counts and a distributed
    running sum in descending score order.
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(y_true) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y_true) == 1, 0).otherwise(1)).alias("neg"))
    r = global_running(per, ["threshold"], sum_cols=["pos", "neg"], with_totals=True, descending=True)
    tp, fp, P = F.col("cum_pos"), F.col("cum_neg"), F.col("total_pos")
    prec = safe_div(tp, tp + fp)
    rec = F.when(P == 0, F.lit(1.0)).otherwise(tp / P)
    f1 = F.when(prec + rec > 0, 2 * rec * prec / (rec + prec))
    return r.select("threshold", tp.alias("tp"), fp.alias("fp"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def pr_summary(curve: DataFrame) -> DataFrame:
    """EV-06 summary: best F1, its threshold (lowest on a tie), area under the PR curve.

    The curve is read in descending threshold order and closed with the
    point (recall 0, precision 1); the area is the trapezoid rule over recall.
    """
    r = global_running(curve.select("threshold", "precision", "recall", "f1"), ["threshold"],
                       prev_cols=["precision", "recall"], descending=True)
    p0 = F.coalesce(F.col("prev_precision"), F.lit(1.0))
    r0 = F.coalesce(F.col("prev_recall"), F.lit(0.0))
    seg = (F.col("recall") - r0) * (F.col("precision") + p0) / 2.0
    best = F.max(F.coalesce(F.col("f1"), F.lit(0.0)))
    return r.agg(best.alias("best_f1"),
                 F.min_by("threshold", F.struct(-F.coalesce(F.col("f1"), F.lit(0.0)), F.col("threshold")))
                 .alias("best_threshold"),
                 F.sum(seg).alias("auc_pr"))


# --- chunk-level evaluation (EV-09, WIN-06) -------------------------------------

# The tag scheme, from what each prefix does (the parts before and after its first '-'):
# B and S open a chunk; E and S close it after the token; O and . are outside; [ and ] are chunks of one
# token; I and E go on with the chunk before, or open one if there is none.
_OPENS, _CLOSES, _OUTSIDE, _SINGLE = ("B", "S"), ("E", "S"), ("O", "."), ("[", "]")


def _tag_parts(tag: str | None) -> tuple[bool, bool, bool, str | None]:
    """(inside, back, ahead, type) of a tag, by the scheme above: is the token inside a chunk, can
    that chunk be the one of the token before (``back``), can it be that of the token after (``ahead``)?"""
    if tag is None:
        return False, False, False, None
    p, _, typ = tag.partition("-")
    inside = p not in _OUTSIDE + _SINGLE
    return p not in _OUTSIDE, inside and p not in _OPENS, inside and p not in _CLOSES, typ


# Of one sentence: its tokens with equal tags, and per chunk type the gold, guessed and correct chunks.
_TYPE_COUNTS = StructType().add("type", StringType()).add("gold", LongType()).add("guessed", LongType()).add("correct", LongType())
_CHUNKS = StructType().add("rights", LongType()).add("types", ArrayType(_TYPE_COUNTS))


@F.pandas_udf(_CHUNKS)
def _sentence_chunks(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Chunk counts of sentences, each given as its gold and its predicted tags in order.

    A token goes on with the chunk of the token before if that one is inside a chunk, doesn't close it, has
    the same type, and the token itself doesn't open one or stand outside; else it is a break of that side, and
    a chunk begins there if the token is inside.  A chunk ends before its side's next break.  So a gold and a
    predicted chunk that begin at one token with one type are the same if the next token that is a break of
    either side is a break of both.  Linear in a sentence of any length.
    """
    def one(g, p):
        n = len(g)
        codes, tags = pd.factorize(np.concatenate([g, p]), use_na_sentinel=False)
        parts = [_tag_parts(x if isinstance(x, str) else None) for x in tags]
        types = sorted({x[3] for x in parts if x[3] is not None})
        place = {t: k for k, t in enumerate(types)}
        inside, back, ahead = (np.array([x[k] for x in parts], bool)[codes] for k in range(3))
        kind = np.array([place.get(x[3], -1) for x in parts], int)[codes]

        def breaks(side):
            b, a, k = back[side], ahead[side], kind[side]
            return np.concatenate([[True], ~(b[1:] & a[:-1] & (k[1:] == k[:-1]))])

        gs, ps = slice(0, n), slice(n, 2 * n)
        gb, pb = breaks(gs), breaks(ps)
        at = np.flatnonzero(gb | pb)
        both_end = np.append((gb & pb)[at[1:]], True)
        gold_at, pred_at, gk, pk = (gb & inside[gs])[at], (pb & inside[ps])[at], kind[gs][at], kind[ps][at]
        count = lambda k: np.bincount(k, minlength=len(types))
        each = zip(types, count(gk[gold_at]), count(pk[pred_at]), count(gk[gold_at & pred_at & (gk == pk) & both_end]))
        known = np.array([isinstance(x, str) for x in tags], bool)[codes[gs]]
        return int((known & (codes[gs] == codes[ps])).sum()), [
            {"type": t, "gold": int(x), "guessed": int(y), "correct": int(z)} for t, x, y, z in each if x or y]

    made = [one(g, p) if len(g) else (0, []) for g, p in zip(gold, pred)]
    return pd.DataFrame({"rights": [x[0] for x in made], "types": [x[1] for x in made]})


def chunk_eval(tags: DataFrame) -> DataFrame:
    """EV-09: per type and overall: correct, guessed, gold chunks, precision, recall, F1; token accuracy.

    ``tags``: sent_id, pos, gold, pred (one sentence per sent_id; a sentence boundary acts as an O tag).
    """
    rows = tags.select("sent_id", F.struct("pos", "gold", "pred").alias("t")).repartition("sent_id")
    return chunk_eval_sentences(rows.groupBy("sent_id").agg(F.array_sort(F.collect_list("t")).alias("tags")))


def chunk_eval_sentences(sentences: DataFrame) -> DataFrame:
    """``chunk_eval`` of rows that hold a whole sentence each: ``tags``, an array of structs with gold and pred in order.

    Every sentence is counted on its own row, so no token is shuffled or sorted.
    """
    side = lambda c: F.transform("tags", lambda t: t[c])
    s = sentences.select(F.size("tags").cast("long").alias("tokens"), _sentence_chunks(side("gold"), side("pred")).alias("m"))

    # The row without a type brings a sentence's token counts.
    counts = ("gold", "guessed", "correct", "tokens", "correct_tags")
    zero, no_type = F.lit(0).cast("long"), F.lit(None).cast("string")
    row = lambda kind, *values: F.struct(kind.alias("type"), *[v.alias(c) for c, v in zip(counts, values)])
    marks = F.concat(F.transform("m.types", lambda x: row(x["type"], x["gold"], x["guessed"], x["correct"], zero, zero)),
                     F.array(row(no_type, zero, zero, zero, F.col("tokens"), F.col("m.rights"))))
    by_type = s.select(F.explode(marks).alias("m")).select("m.*").groupBy("type").agg(*[F.sum(c).alias(c) for c in counts])
    # A type's few counts go to its own row and to that of all; computed once, and the row of all is there without sentences too.
    to = lambda overall, kind: F.struct(F.lit(overall).alias("overall"), kind.alias("type"), *counts)
    both = by_type.select(F.explode(F.array(to(False, F.col("type")), to(True, no_type))).alias("m")).select("m.*").where("overall OR type IS NOT NULL")
    none = sentences.sparkSession.range(1).select(F.lit(True).alias("overall"), no_type.alias("type"), *[zero.alias(c) for c in counts])
    out = both.unionByName(none).groupBy("overall", "type").agg(*[F.sum(c).alias(c) for c in counts])
    out = out.withColumns({"type": F.when(F.col("overall"), F.lit("__overall__")).otherwise(F.col("type")),
                           **{c: F.when(F.col("overall"), F.col(c)) for c in ("tokens", "correct_tags")}})
    pr, re = safe_div(F.col("correct"), F.col("guessed")), safe_div(F.col("correct"), F.col("gold"))
    return out.select("type", *[F.col(c).cast("long").alias(c) for c in ("gold", "guessed", "correct")], pr.alias("precision"),
                      re.alias("recall"), safe_div(2 * pr * re, pr + re).alias("f1"), "tokens", "correct_tags",
                      F.when(F.col("tokens").isNotNull(), safe_div(F.col("correct_tags"), F.col("tokens"))).alias("accuracy"))


# --- run logs and summaries (SRC-17, PRJ-04, AGG-10) -----------------------------

# The names that a result line carries, in any order, and the checks on their values.
_RUN_FIELDS = {"init_checkpoint": "init_checkpoint", "data_dir": "data_dir", "max_seq_length": "max_seq_length",
               "train_batch_size": "train_batch_size", "learning_rate": "learning_rate",
               "num_train_epochs": "num_train_epochs", "f_score": "f-score", "accuracy": "accuracy"}
_WHOLE, _DECIMAL = ("max_seq_length", "train_batch_size", "num_train_epochs"), ("f_score", "accuracy")


def parse_run_results(lines: DataFrame, file_col: str = "file_name", order_col: str = "line_no") -> DataFrame:
    """SRC-17: per log file, the fields of its LAST ``TEST-RESULT`` line; other and incomplete lines dropped.

    A result line is the mark and then name / value pairs, all divided by white space.  A line counts if it has
    every name once, whole numbers and decimals where they belong, and nothing else.
    """
    # Only lines with the mark are split, once each; the pairs become one map that all checks read.
    size = 1 + 2 * len(_RUN_FIELDS)
    picked = lambda w, first: F.transform(F.sequence(F.lit(first), F.lit(size - 2 + first), F.lit(2)), lambda i: F.get(w, i))
    pairs = bind(F.split(F.col("line"), r"\s+"), lambda w: F.when(
        (F.size(w) == size) & (F.size(F.array_distinct(picked(w, 1))) == len(_RUN_FIELDS)),
        F.map_from_arrays(picked(w, 1), picked(w, 2))))
    m = lines.where(F.col("line").rlike(r"^TEST-RESULT\s")).select(file_col, order_col, pairs.alias("pairs"))

    def good(v: Column) -> Column:
        ok = v.isNotNull()
        for c in _RUN_FIELDS:
            ok = ok & v[c].isNotNull()
            if c in _WHOLE + _DECIMAL:
                ok = ok & v[c].rlike(r"^[0-9]+$" if c in _WHOLE else r"^[0-9]+\.[0-9]+$")
        return ok

    values = bind(F.col("pairs"), lambda p: F.when(p.isNotNull(), F.struct(*[p[name].alias(c) for c, name in _RUN_FIELDS.items()])))
    m = m.select(file_col, order_col, bind(values, lambda v: F.when(good(v), v)).alias("r"))
    last = m.groupBy(file_col).agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col(order_col))).alias("r"))
    last = last.where(F.col("r").isNotNull())
    return last.select(file_col, "r.*")


def run_summary(results: DataFrame, score: str = "accuracy") -> DataFrame:
    """AGG-10: per hyper-parameter key: number of scores, mean and population standard deviation.

    The scores themselves stay rows (``parse_run_results``): a setting may have any number of runs.
    """
    key = ["init_checkpoint", "learning_rate", "num_train_epochs", "train_batch_size", "max_seq_length"]
    s = F.col(score).cast("double")
    return results.groupBy(*key).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))


# --- latency (AGG-11, AGG-12, EV-10) ------------------------------------------------

def latency_summary(times: DataFrame, batch_col: str = "batch_no", time_col: str = "elapsed_ms",
                    skip_first: int = 2, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99, 1.0),
                    rank_offset: int = 0, batch_size: int | None = None) -> DataFrame:
    """AGG-11/12 + EV-10: (metric, value) rows: mean, the q-quantiles, and throughput.

    The first ``skip_first`` batches (in batch order) are warm-up and dropped.
    The q-quantile is the value at sorted 1-based position floor(n*q) +
    ``rank_offset`` (0 for the classifier's hook, 1 for the engine benchmark);
    positions outside 1..n give NULL.  Throughput = rows * batch_size / seconds.
    """
    t = times.select(batch_col, time_col)
    if skip_first > 0:
        warm = t.orderBy(batch_col).limit(skip_first).select(batch_col)      # skip_first rows
        t = t.join(F.broadcast(warm), batch_col, "left_anti")
    # Equal times are one row with their number; the k-th time is the first whose running number reaches k.
    counts = t.groupBy(time_col).agg(F.count(F.lit(1)).alias("c"))
    r = global_running(counts, [time_col], sum_cols=["c"])
    n = r.agg(F.sum("c").alias("n"), (F.sum(F.col(time_col) * F.col("c")) / F.sum("c")).alias("mean"),
              F.sum(F.col(time_col) * F.col("c")).alias("total"))
    qs = F.array(*[F.struct(F.lit(f"p{int(round(q * 100))}").alias("metric"), F.lit(float(q)).alias("q"))
                   for q in quantiles])
    want = n.select("n", F.explode(qs).alias("m")) \
        .select(F.col("m.metric").alias("metric"),
                (F.floor(F.col("n") * F.col("m.q")) + rank_offset).cast("long").alias("k"))
    spans = r.select(F.col(time_col).alias("value"), (F.col("cum_c") - F.col("c")).alias("lo"), F.col("cum_c").alias("hi"))
    # One row per quantile on the broadcast side.
    vals = spans.join(F.broadcast(want), (F.col("k") > F.col("lo")) & (F.col("k") <= F.col("hi"))).select("metric", "value")
    vals = want.join(vals, "metric", "left").select("metric", "value")
    extra = [n.select(F.lit("mean").alias("metric"), F.col("mean").alias("value"))]
    if batch_size is not None:
        extra.append(n.select(F.lit("throughput").alias("metric"),
                              safe_div(F.col("n") * batch_size, F.col("total") / 1000.0).alias("value")))
    out = vals
    for e in extra:
        out = out.unionByName(e)
    return out
