"""Block and allow lists: global decision, local lists, list sets, merge, application.

(FN-13..16, JN-06, JN-13, PRJ-01/02, SET-01..04, AGG-14.)

The global probability table has one row per (name, type) and is joined to the
local evidence on (name, type).  It grows with the number of distinct names,
so no broadcast is forced: AQE picks a broadcast hash join from the runtime
size when it is small and otherwise a sort-merge join, and splits a skewed
(frequent-name) partition of the evidence side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsift.functions.scoring import PROTECTED_NAMES, is_protected, odds_ratio, ranking_value

BLOCK, ALLOW = "t", "f"


def global_decision(gprob: DataFrame, min_doc_count: int = 10, threshold: float = 0.5,
                    protected=PROTECTED_NAMES) -> DataFrame:
    """FN-13: mark (name, type) globally blocked: count >= min, non-target prob >= threshold, not protected.

    The defaults (10 documents, 0.5) are the ones the local-list step uses,
    which differ from the global list's own 2 documents (Q-02).  A (name, type) that stands twice in the
    table raises (SRC-10).
    """
    once = gprob.groupBy("name", "type").agg(
        F.max("count").alias("count"), F.max("avg_prob").alias("avg_prob"), F.count(F.lit(1)).alias("_rows"))
    gprob = once.select("name", "type", F.when(F.col("_rows") == 1, F.col("count")).otherwise(F.raise_error(
        F.concat(F.lit("repeated global row: "), "name", F.lit(", "), "type")).cast("long")).alias("count"), "avg_prob")
    return gprob.withColumn(
        "global_block",
        (F.col("count") >= min_doc_count) & (F.col("avg_prob") >= threshold)
        & ~is_protected(F.col("name"), F.col("type"), protected))


def _join_global(local: DataFrame, gprob: DataFrame, types: Sequence[str] | None,
                 min_doc_count: int, threshold: float, protected) -> DataFrame:
    if types is not None:
        local = local.where(F.col("type").isin(*types))
        gprob = gprob.where(F.col("type").isin(*types))
    g = global_decision(gprob.select("name", "type", "count", "avg_prob"),
                        min_doc_count, threshold, protected) \
        .select("name", "type", F.col("avg_prob").alias("g_non"), "global_block")
    j = local.select("name", "type", "doc_id", "count", "log_prob").join(g, ["name", "type"], "inner")
    return j.withColumn("l_p", F.pow(F.lit(10.0), F.col("log_prob"))) \
            .withColumn("g_p", 1 - F.col("g_non"))


def _list_rows(j: DataFrame, value) -> DataFrame:
    return j.select(value.alias("value"), "name", "doc_id", "count",
                    F.col("g_p").alias("global_prob"), F.col("l_p").alias("local_prob"), "type")


def local_block_list(local: DataFrame, gprob: DataFrame, ratio: float | None = 1000.0,
                     function: str = "ratio", types: Sequence[str] | None = ("che", "ggp"),
                     min_doc_count: int = 10, threshold: float = 0.5,
                     protected=PROTECTED_NAMES) -> DataFrame:
    """FN-14 + JN-06: mentions of names NOT globally blocked that look wrong in this document.

    Rule: not globally blocked, 1 - l > g, inverted odds ratio > ``ratio``.
    Output: value, name, doc_id, count, global_prob, local_prob, type.
    """
    j = _join_global(local, gprob, types, min_doc_count, threshold, protected)
    cond = ~F.col("global_block") & ((1 - F.col("l_p")) > F.col("g_p"))
    if ratio is not None:
        cond = cond & (odds_ratio("g_p", "l_p", invert=True) > F.lit(float(ratio)))
    return _list_rows(j.where(cond), ranking_value(function, F.col("g_p"), F.col("l_p"), invert=True))


def local_allow_list(local: DataFrame, gprob: DataFrame, ratio: float | None = 1e15,
                     global_prob: float | None = 0.3, function: str = "ratio",
                     types: Sequence[str] | None = ("ggp",), min_doc_count: int = 10,
                     threshold: float = 0.5, protected=PROTECTED_NAMES) -> DataFrame:
    """FN-15 + JN-06: mentions of globally blocked names that look right in this document.

    Rule: globally blocked, l > 1 - g, odds ratio > ``ratio``, g > ``global_prob``.
    """
    j = _join_global(local, gprob, types, min_doc_count, threshold, protected)
    cond = F.col("global_block") & (F.col("l_p") > F.col("g_non"))
    if ratio is not None:
        cond = cond & (odds_ratio("g_p", "l_p") > F.lit(float(ratio)))
    if global_prob is not None:
        cond = cond & (F.col("g_p") > F.lit(float(global_prob)))
    return _list_rows(j.where(cond), ranking_value(function, F.col("g_p"), F.col("l_p")))


def global_list(candidates: DataFrame, typed: bool = False) -> DataFrame:
    """PRJ-01: ``name, 't'`` rows of a global candidate table (``typed`` keeps the type, Q-01)."""
    cols = ["name"] + (["type"] if typed else []) + [F.lit(BLOCK).alias("flag")]
    return candidates.select(*cols)


def local_list(rows: DataFrame, flag: str) -> DataFrame:
    """PRJ-02: ``name, doc_id, flag`` rows of a local block (t) or allow (f) table."""
    return rows.select("name", "doc_id", F.lit(flag).alias("flag"))


def auto_local(allow_rows: DataFrame, block_rows: DataFrame) -> DataFrame:
    """SET-02: bag union of the local allow and block lists (duplicates and t/f clashes kept, Q-24)."""
    return local_list(allow_rows, ALLOW).unionByName(local_list(block_rows, BLOCK))


def auto_global(candidates: DataFrame) -> DataFrame:
    """SET-03 / AGG-14: distinct names over the global lists of all types."""
    return global_list(candidates).distinct()


def merge_lists(curated: DataFrame, auto: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-04: curated + automatic entries; the curated flag wins a clash on ``keys``.

    One hash aggregate on the keys: max_by over a priority column (curated = 1)
    picks the winning flag.  Duplicates inside one side keep the first flag in
    (flag) order, i.e. an allow 'f' beats a block 't'.
    """
    both = curated.select(*keys, "flag", F.lit(1).alias("_prio")) \
        .unionByName(auto.select(*keys, "flag", F.lit(0).alias("_prio")))
    return both.groupBy(*keys).agg(
        F.max_by("flag", F.struct(F.col("_prio"), F.when(F.col("flag") == ALLOW, 1).otherwise(0))).alias("flag"))


def apply_lists(mentions: DataFrame, global_rows: DataFrame, local_rows: DataFrame, variants: Sequence[str] = ()) -> DataFrame:
    """JN-13: drop mentions whose name is blocked; a local (name, doc) row overrides the global one.

    ``global_rows``: name, flag; ``local_rows``: name, doc_id, flag (t = block,
    f = allow).  Both lists are deduplicated to one decision per key first (an
    allow beats a block on a clash), so the joins cannot multiply mentions.
    ``variants``: list variants to apply side by side; both lists then have a column ``variant``, and a mention comes
    once per variant that it survives.  It meets the lists once, whose rows carry the decisions of all variants.
    """
    by = ["variant"] if variants else []
    g = global_rows.groupBy(*by, "name").agg(F.min(F.col("flag") == BLOCK).alias("g_block"))
    loc = local_rows.groupBy(*by, "name", "doc_id").agg(F.min(F.col("flag") == BLOCK).alias("l_block"))
    if variants:
        every = lambda rows, block, *keys: rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("variant", block))).alias(block))
        g, loc = every(g, "g_block", "name"), every(loc, "l_block", "name", "doc_id")
    j = mentions.join(g, "name", "left").join(loc, ["name", "doc_id"], "left")
    l_block, g_block = F.col("l_block"), F.col("g_block")
    if variants:
        j = j.select(F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"), "*")
        l_block, g_block = (F.try_element_at(c, F.col("variant")) for c in (l_block, g_block))
    return j.where(~F.coalesce(l_block, g_block, F.lit(False))).drop("g_block", "l_block")
