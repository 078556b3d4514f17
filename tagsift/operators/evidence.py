"""Local and global evidence (AGG-02..05, FLT-08..11).

Inputs are class probabilities per mention in long form: one row per
(mention, class) with columns ``doc_id, name, s_type, class, p``.  The target
class of a mention is its own type (``s_type``), as in the reference pipeline,
so all types are handled in one job with ``type`` as a grouping column instead
of one job per type.

Plan shape at scale: the local evidence is ONE hash aggregate keyed by
(doc_id, name, s_type) with per-class conditional sums, so it runs partial
(map-side) aggregation and shuffles one small row per key and map task; no
second exchange and no array of mentions.  The global evidence is a second
hash aggregate keyed by (name, type); a frequent name is a hot key only for
the final merge of partial sums, which is one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.functions.scoring import LOG10_ZERO, PROTECTED_NAMES, is_protected

# The 5-class label set of the reference classifier.
CLASSES = ("che", "dis", "ggp", "org", "out")
# Per-type thresholds of the global candidate list (the
# reference's list building uses 0.5, and 0.85 for diseases).
GLOBAL_THRESHOLDS = {"dis": 0.85}


def predictions_to_long(pred: DataFrame, probs_col: str = "probs",
                        keep: Sequence[str] = ("doc_id", "ann_ids", "name", "s_type")) -> DataFrame:
    """Prediction rows with a MAP<class, p> column -> one row per (mention, class)."""
    return pred.select(*keep, F.explode(probs_col).alias("class", "p"))


def _log10_checked(p: Column, cls: Column, classes: Sequence[str], zero_prob: str) -> Column:
    if zero_prob == "raise":
        lp = F.when(p <= 0, F.raise_error(F.lit("probability 0 has no log10 (zero_prob='raise')"))) \
              .otherwise(F.log10(p))
    elif zero_prob == "floor":
        lp = F.log10(F.greatest(p, F.lit(1e-300)))
    else:
        raise ValueError(zero_prob)
    return F.when(~cls.isin(*classes), F.raise_error(F.concat(F.lit("class not in class list: "), cls))) \
            .otherwise(lp)


def local_evidence(pred_long: DataFrame, classes: Sequence[str] = CLASSES,
                   source_types: Sequence[str] | None = None, threshold: float = 1.01,
                   min_count: int = 1, zero_prob: str = "raise", verbose: bool = False) -> DataFrame:
    """AGG-02/04 + FLT-08/09: per (document, name, type) posterior of the target class.

    Sum of log10 p per class over the mentions, base-10 exp-normalised over the
    classes; ``log_prob`` is log10 of the target posterior (LOG10_ZERO when it
    underflows to 0), ``count`` the number of mentions.  Rows are kept when
    posterior < threshold and count >= min_count (the pipeline's 1.01 / 1 keep
    everything).  Output: log_prob, count, doc_id, name, type.
    """
    df = pred_long
    if source_types is not None:
        df = df.where(F.col("s_type").isin(*source_types))
    lp = _log10_checked(F.col("p"), F.col("class"), classes, zero_prob)
    sums = [F.sum(F.when(F.col("class") == c, lp)).alias(f"ls_{c}") for c in classes]
    aggs = sums + [F.count(F.when(F.col("class") == F.col("s_type"), 1)).alias("count")]
    if verbose:
        aggs.append(F.array_sort(F.collect_list(F.when(F.col("class") == F.col("s_type"),
                                                        F.struct("ann_id", "p")))).alias("_tp"))
    g = df.groupBy("doc_id", "name", "s_type").agg(*aggs)

    ls = [F.col(f"ls_{c}") for c in classes]
    m = F.greatest(*ls)
    denom = sum(F.coalesce(F.pow(F.lit(10.0), x - m), F.lit(0.0)) for x in ls)
    target = F.when(F.col("s_type") == classes[0], ls[0])
    for c, x in zip(classes[1:], ls[1:]):
        target = target.when(F.col("s_type") == c, x)
    target = F.coalesce(target, F.raise_error(F.lit("target class missing from the predictions")))
    post = F.pow(F.lit(10.0), target - m) / denom
    out = g.withColumn("_post", post).where((F.col("_post") < threshold) & (F.col("count") >= min_count))
    cols = [F.when(F.col("_post") > 0, F.log10("_post")).otherwise(F.lit(LOG10_ZERO)).alias("log_prob"),
            F.col("count"), F.col("doc_id"), F.col("name"), F.col("s_type").alias("type")]
    if verbose:
        # AGG-03: most likely class (first class wins a tie), its posterior,
        # and the target-class probabilities in mention order.
        posts = F.array(*[F.struct(F.lit(c).alias("c"), (F.pow(F.lit(10.0), x - m) / denom).alias("q"))
                          for c, x in zip(classes, ls)])
        best_q = F.array_max(F.transform(posts, lambda s: s["q"]))
        best = F.filter(posts, lambda s: s["q"] == best_q)[0]
        cols += [best["c"].alias("most_likely"), best["q"].alias("most_likely_prob"),
                 F.transform("_tp", lambda s: s["p"]).alias("target_probs")]
    return out.select(*cols)


def global_evidence(local: DataFrame, min_count: int = 2, threshold: float = 0.5,
                    type_thresholds: dict | None = None, protected=PROTECTED_NAMES,
                    types: Sequence[str] | None = None, audit: bool = False) -> DataFrame:
    """AGG-05 + FLT-10/11: per (name, type) document count and mean non-target probability.

    ``avg_prob`` = mean of 1 - 10^log_prob, ``expected_errors`` = avg_prob * count.
    Kept when count >= min_count and avg_prob >= the type's threshold, and the
    pair is not protected.  With ``audit`` the protected rows are returned
    instead (the reference notes them on stderr).
    """
    df = local if types is None else local.where(F.col("type").isin(*types))
    g = df.groupBy("name", "type").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(1 - F.pow(F.lit(10.0), F.col("log_prob"))).alias("avg_prob"))
    thr = F.lit(float(threshold))
    for t, v in (type_thresholds or {}).items():
        thr = F.when(F.col("type") == t, F.lit(float(v))).otherwise(thr)
    keep = (F.col("count") >= min_count) & (F.col("avg_prob") >= thr)
    prot = is_protected(F.col("name"), F.col("type"), protected)
    g = g.where(keep & (prot if audit else ~prot))
    return g.select((F.col("avg_prob") * F.col("count")).alias("expected_errors"),
                    "count", "avg_prob", "name", "type")

