"""Token tags stay with their sentence: made, read and counted on its row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.test_shuffles import exchanges


def _chunks(tags):
    """(type, start, end) of a sentence's chunks, tag by tag."""
    out, open_ = set(), None
    for i, t in enumerate([*tags, "O"]):
        p, _, k = t.partition("-")
        goes_on = open_ is not None and p in ("I", "E") and open_[0] == k
        if not goes_on:
            if open_ is not None:
                out.add((*open_, i))
            open_ = None if p in ("O", ".") else (k, i)
        if open_ is not None and p in ("E", "S", "[", "]"):
            out.add((*open_, i + 1))
            open_ = None
    return out


def test_chunks_are_counted_on_the_sentence(spark, tmp_path):
    from tagsift.operators import metrics as mt
    from tagsift.sources import tsv
    rng = random.Random(5)
    kinds = ["O", ".", *[f"{p}-{t}" for p in "BIES" for t in ("a", "b-c", "")], "B", "]-a"]
    sents = [([rng.choice(kinds) for _ in range(n)], [rng.choice(kinds) for _ in range(n)]) for n in (1, 2, 7, 60, 400)]
    sents = [(g, [x if rng.random() < 0.6 else y for x, y in zip(g, p)]) for g, p in sents]
    path = str(tmp_path / "tags")
    text = "\n\n".join("\n".join(f"t{i}\t{g}  {p}" for i, (g, p) in enumerate(zip(*s))) for s in sents)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)

    want = {}
    for g, p in sents:
        gold, pred = _chunks(g), _chunks(p)
        for kind in {c[0] for c in gold | pred}:
            n = [sum(c[0] == kind for c in x) for x in (gold, pred, gold & pred)]
            want[kind] = [x + y for x, y in zip(want.get(kind, [0, 0, 0]), n)]
    want["__overall__"] = [sum(x[k] for x in want.values()) for k in range(3)]
    right = sum(x == y for s in sents for x, y in zip(*s))

    by_sentence = mt.chunk_eval_sentences(tsv.scan_token_sentences(spark, path))
    # Only types' counts are shuffled, and the sentences are read once.
    assert not [e for e in exchanges(by_sentence) if "sent_id" in e]
    assert by_sentence._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    for out in (by_sentence, mt.chunk_eval(tsv.scan_token_tags(spark, path))):
        rows = out.collect()
        assert {r["type"]: [r["gold"], r["guessed"], r["correct"]] for r in rows} == want
        assert [(r["tokens"], r["correct_tags"]) for r in rows if r["type"] == "__overall__"] == [(470, right)]


def test_token_tag_sentences_shuffle_texts_only(spark):
    from tagsift.sources.fixtures import SPARK_SQL, token_tag_sentences
    docs = spark.createDataFrame([(3, "a b  c d e f g h"), (3, "x y"), (9, ""), (None, "p q r"), (4, None)], "doc_id long, text string")
    s = token_tag_sentences(docs)
    assert [e.split(",")[0] for e in exchanges(s)] == ["hashpartitioning(doc_id"]
    got = s.select("sent_id", F.inline("s")).select("sent_id", "pos", "gold", "pred")
    want = spark.sql(SPARK_SQL["fx_token_tag"], documents=docs).select("sent_id", "pos", "gold", "pred")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(want) and len(key(got)) == 15
    assert s.count() == 3
