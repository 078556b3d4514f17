import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_neardup import plain_components
from tests.llm.test_packing import check_pieces, check_sequences
from tests.llm.test_quality import plain as plain_counts
from tests.llm.test_secrets import plain_spans
from tests.llm.test_winnowing import plain as plain_hits


def plain_stages(docs, items):
    """Rows (doc_id, text) after each of the first four stages, in plain Python; no host is bad in these tables."""
    kept = [(k, t) for k, t in docs if (c := plain_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    yield kept
    groups = plain_components(kept, 5)
    kept = [(k, t) for k, t in kept if groups[k][1] == k]
    yield kept
    kept = [(k, t) for k, t in kept if not next(plain_hits([(k, t)], _near(t, items)))[2]]
    yield kept
    yield [(k, _redacted(t)) for k, t in kept]


def _near(text, items):
    """Items that share a 10-word window's first five words with the text (the others can't have a window in it)."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    five = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    for item, item_text in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", item_text.lower())
        if len(w) < 10 or any(tuple(w[i:i + 5]) in five for i in range(len(w) - 4)):
            yield item, item_text


def _redacted(text):
    out, at = "", 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in plain_spans(text)):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = plain_stages([(r.doc_id, r.text) for r in docs.collect()], items)
    now = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want):
        now = corpus_pipeline.written(stage(spark, now, SMALL), f"test-{name}")
        got = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == docs.columns, name
        if name == "secret_scan":                  # the models may mark more than the patterns
            got = {k: t for k, t in got.items() if t.count("[SECRET]") == dict(rows)[k].count("[SECRET]")}
            assert len(got) >= 0.99 * len(rows)
            rows = [(k, t) for k, t in rows if k in got]
        assert got == dict(rows), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SMALL).toPandas()
    check_pieces(pieces, {r.doc_id: r.text for r in now.collect()})
    check_sequences(pieces, 2048)
    ran = corpus_pipeline.run(spark, SMALL).toPandas()
    total = lambda p: np.frombuffer(b"".join(p.sort_values(["doc_id", "start"]).ids), "<u4").tolist()
    assert total(ran) == total(pieces)


def test_every_stage_takes_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 50, None, "s", 250), (2, "word " * 50, None, "s", 250),
            (3, " ".join(f"v{i}" for i in range(60)), "en", None, 9), (4, " ".join(f"v{i}" for i in range(60)), "en", None, 9),
            (4, " ".join(f"v{i}" for i in range(60)), "en", None, 9), (None, " ".join(f"u{i}" for i in range(60)), "en", "s", 9),
            (5, "token=abcdefghijklmnop " + " ".join(f"x{i}" for i in range(30_000)), "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("kept", "doc", "class", "spans", "hits", "v")})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SMALL), f"odd-{name}")
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_dedup":
            ids = [r.doc_id for r in out.collect()]
            assert sorted(map(str, ids)) == ["1", "2", "3", "5", "None", "None"]
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_dedup_decides_by_id_and_text(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(0, long("a"), "x"), (1, long("a"), "x"), (1, long("b"), "x"), (2, long("c"), "y"), (2, long("c"), "x"), (2, long("d"), "x"),
            (3, None, "x"), (3, None, "x"), (4, "", "x"), (5, "", "x"), (6, "five five five five", "x"), (7, long("a") + " tail", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chosen string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SMALL).collect()), key=str)
    assert got == sorted([(0, long("a"), "x"), (1, long("b"), "x"), (2, long("c"), "x"), (2, long("d"), "x"), (3, None, "x"),
                          (4, "", "x"), (5, "", "x"), (6, "five five five five", "x")], key=str)
