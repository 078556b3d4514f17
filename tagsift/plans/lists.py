"""Composite list-building queries (Q-LOCAL .. Q-MERGE) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsift.operators import evidence as ev
from tagsift.operators import lists as ls
from tagsift.session import materialized
from tagsift.sources.fixtures import duck_with, fixture


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_prediction_long")


def q_local(spark, sf):
    """Q-LOCAL: local evidence of every type, pipeline parameters (keep all)."""
    return ev.local_evidence(predictions(spark, sf), threshold=1.01, min_count=1)


def _local_once(spark, sf):
    """The local evidence, written once: block, allow and global lists all read it."""
    return materialized(q_local(spark, sf), "local-evidence")


def q_local_default(spark, sf):
    """Q-LOCAL with the script defaults: ggp only, posterior < 0.5, >= 2 mentions."""
    return ev.local_evidence(predictions(spark, sf), source_types=["ggp"], threshold=0.5, min_count=2)


def q_local_verbose(spark, sf):
    """AGG-03: verbose local evidence (most likely class, its posterior, target probabilities)."""
    return ev.local_evidence(predictions(spark, sf), source_types=["dis"], threshold=1.01,
                             min_count=1, verbose=True)


def q_global(spark, sf):
    """Q-GLOBAL: global candidates per type (0.5, 0.85 for dis, >= 2 documents)."""
    return ev.global_evidence(q_local(spark, sf), min_count=2, threshold=0.5,
                              type_thresholds=ev.GLOBAL_THRESHOLDS)


def q_global_audit(spark, sf):
    """FLT-11 audit: candidates removed because they are protected."""
    return ev.global_evidence(q_local(spark, sf), min_count=2, threshold=0.5,
                              type_thresholds=ev.GLOBAL_THRESHOLDS, audit=True)


def q_global_list(spark, sf):
    """PRJ-01 typed: name, type, 't' per global candidate."""
    return ls.global_list(q_global(spark, sf), typed=True)


def q_gprob(spark, sf):
    """Q-GPROB: global non-target probabilities for che and ggp (threshold 0, >= 2 documents)."""
    return ev.global_evidence(q_local(spark, sf), min_count=2, threshold=0.0, types=["che", "ggp"])


def q_lblock(spark, sf):
    """Q-LBLOCK: local block list, ratio 1000, che and ggp."""
    local = _local_once(spark, sf)
    return ls.local_block_list(local, ev.global_evidence(local, 2, 0.0, types=["che", "ggp"]),
                               ratio=1000.0, types=["che", "ggp"])


def _allow(spark, sf, ratio):
    local = _local_once(spark, sf)
    return ls.local_allow_list(local, ev.global_evidence(local, 2, 0.0, types=["che", "ggp"]),
                               ratio=ratio, global_prob=0.3, types=["ggp"])


def q_lallow(spark, sf):
    """Q-LALLOW: local allow list, ratio 1e15, global prob 0.3, ggp."""
    return _allow(spark, sf, 1e15)


def q_lallow_r1e3(spark, sf):
    """Q-LALLOW at ratio 1e3 (the comparison FIXTURES.md recommends for the oracle)."""
    return _allow(spark, sf, 1e3)


def q_lblock_diff(spark, sf):
    """FN-16 `diff` ranking on the block list."""
    local = _local_once(spark, sf)
    return ls.local_block_list(local, ev.global_evidence(local, 2, 0.0, types=["che", "ggp"]),
                               ratio=1000.0, function="diff", types=["che", "ggp"])


def q_lblock_simple(spark, sf):
    """FN-12 `simple_ratio` ranking on the block list."""
    local = _local_once(spark, sf)
    return ls.local_block_list(local, ev.global_evidence(local, 2, 0.0, types=["che", "ggp"]),
                               ratio=1000.0, function="simple_ratio", types=["che", "ggp"])


def _lists(spark, sf):
    local = _local_once(spark, sf)
    gprob = ev.global_evidence(local, 2, 0.0, types=["che", "ggp"])
    block = ls.local_block_list(local, gprob, ratio=1000.0, types=["che", "ggp"])
    allow = ls.local_allow_list(local, gprob, ratio=1e15, global_prob=0.3, types=["ggp"])
    cands = ev.global_evidence(local, 2, 0.5, type_thresholds=ev.GLOBAL_THRESHOLDS)
    return ls.auto_local(allow, block), ls.auto_global(cands)


def q_auto_local(spark, sf):
    """Q-LISTS: auto_local (allow ggp 'f' + block ggp/che 't', bag union)."""
    return _lists(spark, sf)[0]


def q_auto_global(spark, sf):
    """Q-LISTS: auto_global (distinct names over all types' global lists)."""
    return _lists(spark, sf)[1]


def q_merged_global(spark, sf):
    """Q-MERGE: curated + automatic global list, curated wins."""
    _, auto_g = _lists(spark, sf)
    return ls.merge_lists(fixture(spark, sf, "fx_curated_global"), auto_g, ["name"])


def q_merged_local(spark, sf):
    """Q-MERGE: curated + automatic local list, curated wins."""
    auto_l, _ = _lists(spark, sf)
    return ls.merge_lists(fixture(spark, sf, "fx_curated_local"), auto_l, ["name", "doc_id"])


def q_applied(spark, sf):
    """Q-MERGE + JN-13: mentions that survive the merged lists."""
    auto_l, auto_g = _lists(spark, sf)
    g = ls.merge_lists(fixture(spark, sf, "fx_curated_global"), auto_g, ["name"])
    loc = ls.merge_lists(fixture(spark, sf, "fx_curated_local"), auto_l, ["name", "doc_id"])
    mentions = predictions(spark, sf).where(F.col("class") == F.col("s_type")) \
        .select("doc_id", "ann_id", "name", "s_type")
    return ls.apply_lists(mentions, g, loc)


def q_variants(spark, sf):
    """Q-VARIANT: mentions that survive no list, the curated, the automatic and the merged lists, side by side."""
    auto_l, auto_g = _lists(spark, sf)
    cur_g, cur_l = fixture(spark, sf, "fx_curated_global"), fixture(spark, sf, "fx_curated_local")
    sides = {"curated": (cur_g, cur_l), "auto": (auto_g, auto_l),
             "merged": (ls.merge_lists(cur_g, auto_g, ["name"]), ls.merge_lists(cur_l, auto_l, ["name", "doc_id"]))}
    both: list = [None, None]
    for variant, rows in sides.items():
        for k, cols in enumerate((["name", "flag"], ["name", "doc_id", "flag"])):
            one = rows[k].select(F.lit(variant).alias("variant"), *cols)
            both[k] = one if both[k] is None else both[k].unionByName(one)
    mentions = predictions(spark, sf).where(F.col("class") == F.col("s_type")) \
        .select("doc_id", "ann_id", "name", "s_type")
    return ls.apply_lists(mentions, *both, variants=["none", *sides])


QUERIES = {
    "local_evidence": q_local,
    "local_evidence_default": q_local_default,
    "local_evidence_verbose": q_local_verbose,
    "global_candidates": q_global,
    "global_protected_audit": q_global_audit,
    "global_list_typed": q_global_list,
    "global_probabilities": q_gprob,
    "local_block": q_lblock,
    "local_block_diff": q_lblock_diff,
    "local_block_simple": q_lblock_simple,
    "local_allow": q_lallow,
    "local_allow_r1e3": q_lallow_r1e3,
    "auto_local": q_auto_local,
    "auto_global": q_auto_global,
    "merged_global": q_merged_global,
    "merged_local": q_merged_local,
    "applied_mentions": q_applied,
    "list_variants": q_variants,
}

# ---------------------------------------------------------------------------
# DuckDB oracles.  Written directly in SQL from the reference's rules.

_LE_SUMS = """
g AS (
  SELECT doc_id, name, s_type,
         sum(CASE WHEN class = 'che' THEN log10(p) END) AS s_che,
         sum(CASE WHEN class = 'dis' THEN log10(p) END) AS s_dis,
         sum(CASE WHEN class = 'ggp' THEN log10(p) END) AS s_ggp,
         sum(CASE WHEN class = 'org' THEN log10(p) END) AS s_org,
         sum(CASE WHEN class = 'out' THEN log10(p) END) AS s_out,
         count(CASE WHEN class = s_type THEN 1 END) AS n
  FROM fx_prediction_long {where} GROUP BY doc_id, name, s_type),
mx AS (SELECT *, greatest(s_che, s_dis, s_ggp, s_org, s_out) AS m FROM g),
po AS (SELECT *, pow(10, CASE s_type WHEN 'che' THEN s_che WHEN 'dis' THEN s_dis WHEN 'ggp' THEN s_ggp
                                     WHEN 'org' THEN s_org ELSE s_out END - m)
                 / (coalesce(pow(10, s_che - m), 0) + coalesce(pow(10, s_dis - m), 0) + coalesce(pow(10, s_ggp - m), 0)
                    + coalesce(pow(10, s_org - m), 0) + coalesce(pow(10, s_out - m), 0)) AS post FROM mx),
le AS (SELECT CASE WHEN post > 0 THEN log10(post) ELSE -1000.0e0 END AS log_prob, n AS "count", doc_id, name,
              s_type AS type, post FROM po WHERE post < {thr} AND n >= {minc})
"""


def _le(where: str = "", thr: str = "1.01e0", minc: int = 1) -> str:
    return duck_with("fx_prediction_long") + "," + _LE_SUMS.format(where=where, thr=thr, minc=minc)


_GLOBAL = """
ge AS (SELECT name, type, count(*) AS "count", avg(1 - pow(10, log_prob)) AS avg_prob FROM le GROUP BY name, type)
"""

_NOT_PROT = "NOT ((name = 'insulin' AND type = 'ggp') OR (name = 'INSULIN' AND type = 'ggp'))"

_CAND = _le() + "," + _GLOBAL + """,
cand AS (SELECT avg_prob * "count" AS expected_errors, "count", avg_prob, name, type FROM ge
         WHERE "count" >= 2 AND avg_prob >= CASE WHEN type = 'dis' THEN 0.85e0 ELSE 0.5e0 END AND """ + _NOT_PROT + ")"

_GPROB = """
gp AS (SELECT name, type, "count", avg_prob FROM ge WHERE type IN ('che', 'ggp') AND "count" >= 2 AND avg_prob >= 0.0e0
       AND """ + _NOT_PROT + """),
j AS (SELECT le.name, le.type, le.doc_id, le."count", pow(10, le.log_prob) AS l_p, gp.avg_prob AS g_non,
             1 - gp.avg_prob AS g_p,
             (gp."count" >= 10 AND gp.avg_prob >= 0.5e0 AND """ + _NOT_PROT.replace("name", "gp.name").replace("type", "gp.type") + """) AS gb
      FROM le JOIN gp ON le.name = gp.name AND le.type = gp.type)
"""


# The inverted ratio complements both probabilities first and then takes the
# complements again (as the reference does), so 1 - (1 - l) keeps its rounding.
_INV_RATIO = ("CASE WHEN (1 - (1 - l_p)) * (1 - (1 - g_p)) = 0 THEN 'inf'::DOUBLE "
              "ELSE ((1 - l_p) * (1 - g_p)) / ((1 - (1 - l_p)) * (1 - (1 - g_p))) END")
_RATIO = "CASE WHEN (1 - l_p) * (1 - g_p) = 0 THEN 'inf'::DOUBLE ELSE (l_p * g_p) / ((1 - l_p) * (1 - g_p)) END"


def _block_sql(value: str) -> str:
    return (_le() + "," + _GLOBAL + "," + _GPROB + f"""
SELECT {value} AS value, name, doc_id, "count", g_p AS global_prob, l_p AS local_prob, type FROM j
WHERE type IN ('che', 'ggp') AND NOT gb AND (1 - l_p) > g_p
  AND ({_INV_RATIO}) > 1000.0e0""")


def _allow_sql(ratio: str) -> str:
    return (_le() + "," + _GLOBAL + "," + _GPROB + f"""
SELECT {_RATIO} AS value, name, doc_id, "count", g_p AS global_prob, l_p AS local_prob, type FROM j
WHERE type = 'ggp' AND gb AND l_p > g_non AND ({_RATIO}) > {ratio} AND g_p > 0.3e0""")


_LISTS = (_le() + "," + _GLOBAL + "," + _GPROB.rstrip() + f""",
blk AS (SELECT name, doc_id FROM j WHERE type IN ('che', 'ggp') AND NOT gb AND (1 - l_p) > g_p AND ({_INV_RATIO}) > 1000.0e0),
alw AS (SELECT name, doc_id FROM j WHERE type = 'ggp' AND gb AND l_p > g_non AND ({_RATIO}) > 1e15 AND g_p > 0.3e0),
auto_local AS (SELECT name, doc_id, 'f' AS flag FROM alw UNION ALL SELECT name, doc_id, 't' AS flag FROM blk),
cand AS (SELECT name FROM ge WHERE "count" >= 2 AND avg_prob >= CASE WHEN type = 'dis' THEN 0.85e0 ELSE 0.5e0 END
         AND {_NOT_PROT}),
auto_global AS (SELECT DISTINCT name, 't' AS flag FROM cand)
""")

_CURATED = duck_with("fx_curated_global", "fx_curated_local").replace("WITH ", "", 1)

_MERGED = _LISTS + "," + _CURATED + """,
mg AS (SELECT name, max_by(flag, prio * 2 + CASE WHEN flag = 'f' THEN 1 ELSE 0 END) AS flag FROM (
         SELECT name, flag, 1 AS prio FROM fx_curated_global UNION ALL SELECT name, flag, 0 FROM auto_global) GROUP BY name),
ml AS (SELECT name, doc_id, max_by(flag, prio * 2 + CASE WHEN flag = 'f' THEN 1 ELSE 0 END) AS flag FROM (
         SELECT name, doc_id, flag, 1 AS prio FROM fx_curated_local UNION ALL SELECT name, doc_id, flag, 0 FROM auto_local)
       GROUP BY name, doc_id)
"""

ORACLE = {
    "local_evidence": _le() + " SELECT log_prob, \"count\", doc_id, name, type FROM le",
    "local_evidence_default": _le("WHERE s_type = 'ggp'", "0.5e0", 2)
    + " SELECT log_prob, \"count\", doc_id, name, type FROM le",
    "global_candidates": _CAND + " SELECT * FROM cand",
    "global_protected_audit": _le() + "," + _GLOBAL + """
SELECT avg_prob * "count" AS expected_errors, "count", avg_prob, name, type FROM ge
WHERE "count" >= 2 AND avg_prob >= CASE WHEN type = 'dis' THEN 0.85e0 ELSE 0.5e0 END AND NOT """ + _NOT_PROT,
    "global_list_typed": _CAND + " SELECT name, type, 't' AS flag FROM cand",
    "global_probabilities": _le() + "," + _GLOBAL + """
SELECT avg_prob * "count" AS expected_errors, "count", avg_prob, name, type FROM ge
WHERE type IN ('che', 'ggp') AND "count" >= 2 AND avg_prob >= 0.0e0 AND """ + _NOT_PROT,
    "local_block": _block_sql(_INV_RATIO),
    "local_block_diff": _block_sql("(1 - l_p) - g_p"),
    "local_block_simple": _block_sql("CASE WHEN 1 - (1 - g_p) = 0 THEN 'inf'::DOUBLE ELSE (1 - l_p) / (1 - (1 - g_p)) END"),
    "local_allow": _allow_sql("1e15"),
    "local_allow_r1e3": _allow_sql("1e3"),
    "auto_local": _LISTS + " SELECT * FROM auto_local",
    "auto_global": _LISTS + " SELECT * FROM auto_global",
    "merged_global": _MERGED + " SELECT * FROM mg",
    "merged_local": _MERGED + " SELECT * FROM ml",
    "applied_mentions": _MERGED + """,
mention AS (SELECT doc_id, ann_id, name, s_type FROM fx_prediction_long WHERE class = s_type),
gb AS (SELECT name, min(flag = 't') AS g_block FROM mg GROUP BY name),
lb AS (SELECT name, doc_id, min(flag = 't') AS l_block FROM ml GROUP BY name, doc_id)
SELECT m.doc_id, m.ann_id, m.name, m.s_type FROM mention m
LEFT JOIN gb ON m.name = gb.name LEFT JOIN lb ON m.name = lb.name AND m.doc_id = lb.doc_id
WHERE NOT coalesce(lb.l_block, gb.g_block, false)""",
}


ORACLE["list_variants"] = _MERGED + """,
gv AS (SELECT 'curated' AS variant, name, flag FROM fx_curated_global UNION ALL SELECT 'auto', name, flag FROM auto_global
       UNION ALL SELECT 'merged', name, flag FROM mg),
lv AS (SELECT 'curated' AS variant, name, doc_id, flag FROM fx_curated_local UNION ALL SELECT 'auto', name, doc_id, flag FROM auto_local
       UNION ALL SELECT 'merged', name, doc_id, flag FROM ml),
mention AS (SELECT variant, doc_id, ann_id, name, s_type FROM fx_prediction_long, (VALUES ('none'), ('curated'), ('auto'), ('merged')) v(variant)
            WHERE class = s_type),
gb AS (SELECT variant, name, min(flag = 't') AS g_block FROM gv GROUP BY variant, name),
lb AS (SELECT variant, name, doc_id, min(flag = 't') AS l_block FROM lv GROUP BY variant, name, doc_id)
SELECT m.* FROM mention m LEFT JOIN gb ON m.variant = gb.variant AND m.name = gb.name
LEFT JOIN lb ON m.variant = lb.variant AND m.name = lb.name AND m.doc_id = lb.doc_id
WHERE NOT coalesce(lb.l_block, gb.g_block, false)"""


def _verbose_oracle() -> str:
    qs = ", ".join(f"pow(10, s_{c} - m) / den AS q_{c}" for c in ev.CLASSES)
    best = "greatest(" + ", ".join(f"q_{c}" for c in ev.CLASSES) + ")"
    pick = "CASE " + " ".join(f"WHEN q_{c} = {best} THEN '{c}'" for c in ev.CLASSES) + " END"
    val = "CASE " + " ".join(f"WHEN q_{c} = {best} THEN q_{c}" for c in ev.CLASSES) + " END"
    den = " + ".join(f"coalesce(pow(10, s_{c} - m), 0)" for c in ev.CLASSES)
    return _le("WHERE s_type = 'dis'") + f""",
dq AS (SELECT *, {den} AS den FROM mx),
qq AS (SELECT doc_id, name, s_type, {qs} FROM dq),
tp AS (SELECT doc_id, name, s_type, list(p ORDER BY ann_id, p) AS target_probs FROM fx_prediction_long
       WHERE class = s_type AND s_type = 'dis' GROUP BY doc_id, name, s_type)
SELECT le.log_prob, le."count", le.doc_id, le.name, le.type, {pick} AS most_likely, {val} AS most_likely_prob,
       tp.target_probs
FROM le JOIN qq ON le.doc_id = qq.doc_id AND le.name = qq.name AND le.type = qq.s_type
JOIN tp ON le.doc_id = tp.doc_id AND le.name = tp.name AND le.type = tp.s_type"""


ORACLE["local_evidence_verbose"] = _verbose_oracle()
