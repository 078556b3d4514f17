import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsift.llm.periodicity import find_runs, runs_of
from tagsift.llm.queries_runs import op12_periodic_runs, repeated_tails
from tagsift.llm.recompression import extend_left, extend_right, grammar

SF = "/root/testdata/sf0.001"


def same_right(s, i, j):
    k = 0
    while j + k < len(s) and s[i + k] == s[j + k]:
        k += 1
    return k


def plain_runs(w, least=12):
    """Every period: the maximal stretches of words equal to those q places on."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            e = i + same_right(w, i, i + q)
            if e > i and e + q - i >= max(least, 2 * q):
                out.setdefault((i, e + q), q)
            i = max(e, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(draw, most):
    n, k = draw.randint(0, most), draw.choice([1, 2, 3, 5, 9])
    s = [draw.randrange(k) for _ in range(n)]
    if n and draw.random() < 0.6:
        p, a = draw.randint(1, 12), draw.randrange(n)
        for x in range(a, n):
            s[x] = s[a + (x - a) % p]
    return s


@pytest.mark.parametrize("seed", range(150))
def test_extensions(seed):
    draw = random.Random(seed)
    s = random_words(draw, 50) or [1]
    levels = grammar(np.array(s), seed)
    assert len(set(levels[-1].symbols.tolist())) == len(levels[-1].symbols)
    pairs = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
    i, j = (np.array(x) for x in zip(*pairs))
    assert extend_right(levels, i, j).tolist() == [same_right(s, *x) for x in pairs]
    back = [same_right(s[::-1], len(s) - b, len(s) - a) for a, b in pairs]
    assert extend_left(levels, i, j).tolist() == back


@pytest.mark.parametrize("seed", range(200))
def test_runs(seed):
    draw = random.Random(seed)
    texts = [[b"%d" % x for x in random_words(draw, 90)] for _ in range(draw.randint(1, 5))]
    assert [[tuple(r) for r in x.tolist()] for x in runs_of(texts)] == [plain_runs(t) for t in texts]


def test_long_texts():
    one = [b"a"] * 200_000
    assert runs_of([one])[0].tolist() == [[0, 200_000, 1]]
    seven = [b"%d" % (i % 7) for i in range(100_003)]
    assert runs_of([seven, one[:13]])[0].tolist() == [[0, 100_003, 7]]
    assert runs_of([[b"%d" % i for i in range(100_000)]])[0].tolist() == []


def test_cases(spark):
    rows = [(1, "a b " * 8, "x"), (2, None, "x"), (3, "", "x"), (4, "q r " * 12, "x"), (1, "a b " * 8, "y"), (None, "z " * 11, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in find_runs(df).collect()))
    assert got == [(0, 11, [], " ".join("z" * 11)), (1, 16, [(0, 16, 2)], "a b"), (1, 16, [(0, 16, 2)], "a b"), (2, 0, [], ""),
                   (3, 0, [], ""), (4, 12, [(0, 12, 1)], "q r")]
    assert find_runs(df.limit(0)).collect() == []
    small = find_runs(df, batch_words=3).where("doc_id = 1").select("collapsed_text").distinct().collect()
    assert [r[0] for r in small] == ["a b"]


def test_query_against_brute_force(spark):
    import hashlib
    import zlib
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_periodic_runs(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        w = (text or "").encode().split()
        h = zlib.crc32(str(k).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue                             # too slow here; long texts have a test of their own
        runs = plain_runs(w)
        gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_tails_keep_other_texts(spark):
    df = spark.createDataFrame([(i, t) for i in range(40) for t in ("a  b\tc", "", None)], "doc_id long, text string")
    out = repeated_tails(df).withColumn("h", F.crc32(F.col("doc_id").cast("string")) % 10)
    assert {r.text for r in out.where("h <> 0").collect()} == {"a  b\tc", "", None}
    assert {r.text for r in out.where("h = 0").collect()} <= {"a b c", "a b b", "a a a", "", None}
