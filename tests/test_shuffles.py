"""What is shuffled: rows that grow out of a text stay in its task."""

from __future__ import annotations

import re


def exchanges(df) -> list[str]:
    """The keys of the plan's shuffles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"(?<!Broadcast)Exchange (\w+\([^()]*\))", plan)]


def test_dictionary_tags_shuffle_texts_only(spark):
    from tagsift.operators.textstats import tag_documents, word_runs
    docs = spark.createDataFrame([(1, "..Heat shock; heat--"), (2, "heat"), (2, "heat"), (None, "shock heat")], "doc_id long, text string")
    names = spark.createDataFrame([("heat shock", -1, "hs"), ("heat", -2, "h")], "name string, type int, identifier string")
    tags = tag_documents(docs, names)
    assert [e.split(",")[0] for e in exchanges(tags)] == ["hashpartitioning(doc_id"]
    got = sorted((tuple(r) for r in tags.collect()), key=str)
    # Rows of one doc_id follow each other word by word.
    assert got == sorted([(1, 2, 11, -1, "hs"), (1, 14, 17, -2, "h"), (2, 0, 3, -2, "h"), (2, 4, 7, -2, "h"), (None, 6, 9, -2, "h")], key=str)
    runs = sorted(tuple(r) for r in word_runs(docs.where("doc_id = 1"), pattern="[a-z]+").collect())
    assert runs == [(1, 1, 3, 5, "eat"), (1, 2, 7, 11, "shock"), (1, 3, 14, 17, "heat")]


def test_contexts_shuffle_tags_and_texts_once(spark):
    from tagsift.operators.context import contexts
    docs = spark.createDataFrame([(1, "one  two-x\tthree. four"), (2, "no tags"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    tags = spark.createDataFrame([(1, 5, 7, -1, "x"), (1, 5, 7, -1, "y"), (1, 12, 15, -2, "z"), (3, 0, 0, -1, "x")],
                                 "doc_id long, start int, stop int, type int, identifier string")
    out = contexts(docs, tags, words=1)
    assert [e.split(",")[0] for e in exchanges(out)] == ["hashpartitioning(doc_id"] * 2
    got = sorted(tuple(r)[:2] + tuple(r)[3:] for r in out.collect())
    assert got == [(1, "1", "t", "hree", ". four"), (1, "2,3", "one", "two", "-x"),
                   (3, "1,2", "DOCSTART", "a", "a"), (3, "1,2", "DOCSTART", "a", "a")]


def test_running_sums_and_numbers_below(spark):
    from pyspark.sql import functions as F

    from tagsift.functions.text import numbers_below, running_sums
    df = spark.createDataFrame([([3, 1, 2], [0, 3, 4, 9]), ([], [5]), (None, None)], "v array<int>, x array<int>")
    got = [tuple(r) for r in df.select(running_sums("v"), numbers_below(running_sums("v"), F.col("x"))).collect()]
    assert got == [([3, 4, 6], [0, 0, 1, 3]), ([], [0]), (None, None)]


def test_running_confusion_states_and_batches_are_bounded(spark, tmp_path):
    from tagsift.streaming import running
    src, n = str(tmp_path / "src"), spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.createDataFrame([(i % 3, i % 2) for i in range(60)], "label int, prediction int")
    rows.repartition(10).write.parquet(src)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = running.running_confusion(spark, src, rows.schema, str(tmp_path / "ckpt"), "confusion_bounded", files_per_batch=4)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert sorted(tuple(r) for r in out.collect()) == [(a, b, 10) for a in range(3) for b in range(2)]
    assert len([p for p in (tmp_path / "ckpt" / "offsets").iterdir() if p.name.isdigit()]) == 3
    assert len([p for p in (tmp_path / "ckpt" / "state" / "0").iterdir() if p.name.isdigit()]) == running.STATE_PARTITIONS


def test_landed_folders_have_bounded_parts_in_order(spark, tmp_path):
    from tagsift.plans.textio import _landed
    from tagsift.sources.lines import numbered_lines
    rows = spark.range(100).selectExpr("id % 3 AS file", "id AS n", "concat('l', id) AS value")
    want = sorted(((i % 3, i) for i in range(100)))
    for back in (False, True):
        path = str(tmp_path / f"lines-{back}")
        _landed(rows, path, 3, part_rows=10, backwards=back)
        assert max(sum(1 for _ in open(p)) for p in (tmp_path / f"lines-{back}").rglob("part-*")) < 40
        assert len(list((tmp_path / f"lines-{back}").rglob("part-*"))) > 6
        got = [int(r["line"][1:]) for r in numbered_lines(spark, path, descending=back).orderBy("place").collect()]
        assert got == [i for _, i in sorted(want, key=lambda x: (-x[0] if back else x[0], x[1]))]


def test_pretrain_instances_shuffle_their_tokens_once(spark):
    from tagsift.operators.pretrain import INSTANCE, instances
    docs = spark.createDataFrame([(1, "One two. Three four! Five six seven? Eight."), (2, "a b c d e f g\nh i"), (2, "a b c d e f g\nh i"), (3, "")],
                                 "doc_id long, text string")
    words = spark.createDataFrame([("a", 0), ("b", 1)], "token string, word_no long")
    out = instances(docs, words, max_seq_length=16, dupe_factor=2)
    own = [e for e in exchanges(out) if e.startswith("hashpartitioning(" + ", ".join(INSTANCE))]
    # The plan and the sentences, once for the instances and once (the same shuffle) for the drawn places; the drawn words.
    assert len(own) <= 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(side" in plan and "tokens, tokens" not in plan
    rows = out.collect()
    assert rows and all(r["tokens"][0] == "[CLS]" and "" not in r["tokens"] and r["tokens"].count("[SEP]") == 2 for r in rows)
