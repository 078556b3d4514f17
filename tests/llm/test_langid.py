import zlib

import numpy as np

from tagsift.llm import langid
from tagsift.llm.queries_text import op10_language

SF = "/root/testdata/sf0.01"


def plain_vector(text, dims):
    """Letter by letter, one n-gram after the other."""
    signs, total = [], np.zeros(dims)
    for c in f" {text.lower()} ":
        sign = ord(c) if c.isalpha() else langid.GAP
        if sign != langid.GAP or not signs or signs[-1] != langid.GAP:
            signs.append(sign)
    for i in range(len(signs) - 2):
        a, b, c = (langid._letter(s, dims).astype(float) for s in signs[i:i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total / np.linalg.norm(total)


def test_vectors_against_plain_binding(monkeypatch):
    text = "Größe, l'été 12 ñandú — 𝒳y ok"
    for block in (1_000_000, 7, 3, 1):
        monkeypatch.setattr(langid, "_BLOCK", block)
        got = langid._Space(256).vector(text)
        assert np.allclose(got, plain_vector(text, 256), atol=1e-5)
    assert langid._Space(64).vector("12 -- !") is None and langid._Space(64).vector(None) is None


def test_held_out_accuracy(spark):
    out = op10_language(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(out) == len(docs) and out.score.between(0, 1).all()
    assert all(out.held_out[k] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out.index)
    held = out[out.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() >= 0.97


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "en", "x"),
            (4, "123 !!", "de", "x"), (5, "the dog", None, "x"), (None, "die katze", None, "x"), (5, "the dog", None, "x"),
            (6, "the cat " * 300_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    from pyspark.sql import functions as F
    protos = langid.learn(df, F.lit(True))
    out = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.identify(df, protos).collect()}
    assert out == {(1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "en", True),
                   (None, "de", True), (6, "en", True)}
    assert langid.learn(df.limit(0), F.lit(True)) == {}
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
