import re

import pytest

from tagsift.llm import quality
from tagsift.llm.quality import judge
from tagsift.llm.queries_rules import OP6_SQL, op6_quality
from tests.conftest import SMALL
from tests.oracle_compare import compare_one, duck_connection


def plain(text):
    text = text or ""
    words = text.encode().split()
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), len(re.sub("[\x20\x09-\x0d]", "", text)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(repeated))


def test_query_against_sql(spark):
    info = compare_one(spark, duck_connection(SMALL), "op6", op6_quality, OP6_SQL, SMALL)
    assert info["ok"], info


def test_counts_and_cases(spark):
    texts = [None, "", "\n \n", "a\na\n a\n\na", "w " * 19, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2, "a b c d e f g h i a b c d e f g h x",
             "x " * 30_000, "é#ñ ** <b> |", "\x0b\x1c a b", " ".join(f"u{i}" for i in range(40)) + " é"]
    rows = [(i, t, None if i % 2 else "s", "doc", True) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[6], "s", "doc", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, doc string, kept boolean")
    out = judge(df).selectExpr("doc.text AS t", "doc.kept AS extra", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                               "n_repeat_words", "base_failed", "kept").collect()
    assert len(out) == len(rows) and all(r.extra for r in out)
    for r in out:
        want = plain(r.t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert [r.kept for r in out if r.t == texts[-1]] == [True]
    assert judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [quality.BROADCAST_BYTES, 0])
def test_host_verdicts(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
    clean = " ".join(f"word{i}" for i in range(40))
    soft = clean + " " + " ".join(f"#{i}" for i in range(30))
    rows = [(i, soft, "bad", 0) for i in range(30)] + [(100 + i, clean, "bad", 0) for i in range(3)]
    rows += [(200 + i, clean, "good", 0) for i in range(40)] + [(300, soft, "good", 0), (301, soft, "new", 0), (302, soft, None, 0)]
    rows += [(400 + 50 * h + i, clean, f"h{h}", 0) for h in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    out = {r.doc_id: r for r in judge(df, keep=["doc_id"]).select("doc.doc_id", "kept", "host_failed").collect()}
    assert all(not out[i].kept and out[i].host_failed for i in range(30))
    assert all(out[i].kept for i in out if i >= 100)     # clean rows of the bad host, and soft ones elsewhere
