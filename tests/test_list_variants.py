"""List variants applied side by side."""

from __future__ import annotations

from tagsift.operators import lists as ls


def test_variants_meet_the_lists_once(spark):
    m = spark.createDataFrame([(1, 10, "a", "che"), (2, 11, "a", "che"), (1, 12, "b", "dis"), (None, 13, None, "ggp")],
                              "doc_id long, ann_id long, name string, s_type string")
    g = spark.createDataFrame([("x", "a", "t"), ("y", "a", "f"), ("y", "b", "t"), ("y", "b", "f"), ("x", None, "t")], "variant string, name string, flag string")
    loc = spark.createDataFrame([("x", "a", 1, "f"), ("y", "a", 2, "t")], "variant string, name string, doc_id long, flag string")
    out = ls.apply_lists(m, g, loc, variants=["none", "x", "y"])
    got = {}
    for r in out.collect():
        got.setdefault(r.variant, set()).add(r.ann_id)
    assert got == {"none": {10, 11, 12, 13}, "x": {10, 12, 13}, "y": {10, 12, 13}}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(") < plan.index("Join LeftOuter")
