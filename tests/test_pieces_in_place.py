"""Words are divided where their texts are, by a vocabulary sent there; a larger one takes the joins, with the same rows."""

from __future__ import annotations

import pytest

DOCS = [(1, "Ab cab, cad. Ab​ ​ ΑΣ x̧y\tcab 漢字ab cab"), (2, "cab ab. cab"), (2, "Zq é"), (3, ""), (4, None), (5, "ab " * 300)]
TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c", "ab", "##b", "##ab", "##a", ",", ".", "ας", "x", "##y", "漢"]


@pytest.fixture
def plans(spark, monkeypatch):
    from tagsift.operators import features as ft
    from tagsift.plans import features as pf
    from tagsift.plans import passages as pp
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    vocab = spark.createDataFrame(list(enumerate(TOKENS)), "line_no int, token string")
    tags = spark.createDataFrame([(d, s, s + 1, -1, "x") for d, at in ((1, 4), (2, 4), (5, 3)) for s in (0, at)], "doc_id long, start int, stop int, type int, identifier string")
    for m in (pf, pp):
        monkeypatch.setattr(m, "table", lambda *a: docs)
        monkeypatch.setattr(m, "fixture", lambda s, d, name: vocab if name == "fx_vocab_line" else tags)

    def both(make):
        sent = make()
        monkeypatch.setattr(ft, "SENT_VOCAB", 0)
        return sent, make()
    return both


def _rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))


def test_passages_shuffle_texts_only(spark, plans):
    from tagsift.plans import passages as pp
    from tests.test_shuffles import exchanges
    sent, joined = plans(lambda: pp._features(spark, ""))
    assert [e.split(",")[0] for e in exchanges(sent)] == ["hashpartitioning(doc_id"]
    rows = _rows(sent)
    assert rows == _rows(joined) and {r["doc_id"] for r in sent.collect()} == {1, 2, 5}


def test_span_features_shuffle_tags_and_texts_only(spark, plans):
    from tagsift.plans import features as pf
    from tests.test_shuffles import exchanges
    sent, joined = plans(lambda: pf.q_span_features(spark, ""))
    assert {e.split(",")[0] for e in exchanges(sent)} == {"hashpartitioning(doc_id"}
    rows = _rows(sent)
    assert rows == _rows(joined) and len(rows) == 6


def test_no_id_for_a_word(spark):
    from tagsift.operators.features import Pieces
    assert Pieces({"a": 1, "##b": 2, "[UNK]": 0})("ab  b ab") == (("a", "##b", "[UNK]", "a", "##b"), (1, 2, 0, 1, 2))
    with pytest.raises(ValueError):
        Pieces({"a": 1})("b")
