import random
import re

from pyspark.sql import functions as F

from tagsift.llm.queries_bench import OP7_SQL, op7_decontamination
from tagsift.llm.winnowing import decontaminate, fingerprints, item_words
from tests.conftest import SMALL
from tests.oracle_compare import compare_one, duck_connection


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(docs, items):
    for key, text in docs:
        own, hits, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            n = min(10, len(w))
            for j in range(len(w) - n + 1 if w else 0):
                for i in range(len(own) - n + 1):
                    if own[i:i + n] == w[j:j + n]:
                        hits |= set(range(i, i + n))
                        found.add(str(item).replace("None", "null"))
        yield str(key), len(own), sorted(hits), sorted(found)


def test_query_against_sql(spark):
    info = compare_one(spark, duck_connection(SMALL), "op7", op7_decontamination, OP7_SQL, SMALL)
    assert info["ok"], info


def cases():
    rng = random.Random(11)
    vocab = ["a", "B", "c1", "é", "dd", "Éé"]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 30])))) for i in range(12)]
    items += [(50, None), (51, " .!"), (52, "zz"), (None, "q1 q2 q3"), (3, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11"), (3, "zz")]
    docs = []
    for key in range(40):
        parts = rng.choices(vocab, k=rng.randint(0, 30))
        if key % 2:
            parts[5:5] = words(rng.choice(items)[1])[rng.randint(0, 3):]
        docs.append((key, "-".join(parts)))
    docs += [(90, None), (91, ""), (92, "ZZ"), (93, "q1 q2 q3"), (93, "q1 q2 q3"), (None, "zz zz"),
             (94, "pad " * 20_000 + "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10")]
    return docs, items


def test_against_every_window_and_cases(spark):
    docs, items = cases()
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    for rows in (500_000, 0):                      # broadcast and shuffled fingerprints
        out = decontaminate(df, bench, broadcast_rows=rows).select("doc.doc_id", "n_words", "hits", "items").collect()
        assert sorted((str(r[0]), r[1], list(r[2]), list(r[3])) for r in out) == sorted(plain(docs, items))
    assert decontaminate(df.limit(0), bench).count() == 0
    assert all(not r.hits for r in decontaminate(df, bench.limit(0)).collect())


def test_every_long_shared_span_shares_a_fingerprint_place(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        span = rng.choices("abcdefgh", k=10)
        left, right = (rng.choices("abcdefgh", k=rng.randint(0, 15)) for _ in range(2))
        rows.append((" ".join(span), " ".join(left + span + right), len(left)))
    df = spark.createDataFrame(rows, "span string, text string, at int")
    own = fingerprints(item_words(F.col("span")), 10, 5)
    all_ = fingerprints(item_words(F.col("text")), 10, 5)
    moved = F.transform(own, lambda f: F.struct(f["h"], (f["at"] + F.col("at")).alias("at")))
    assert df.where(~F.arrays_overlap(moved, all_)).count() == 0


def test_repetitive_texts_against_every_window(spark):
    rng = random.Random(21)

    def periodic():
        out = []
        for _ in range(rng.randint(1, 4)):
            q, n = rng.randint(1, 7), rng.randint(1, 45)
            unit = [rng.choice("ab") for _ in range(q)]
            out += [unit[i % q] for i in range(n)] + [rng.choice("abc")] * rng.randint(0, 2)
        return out

    items = [(i, " ".join(periodic())) for i in range(40)]
    docs = [(i, " ".join(periodic())) for i in range(160)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(df, bench).select("doc.doc_id", "n_words", "hits", "items").collect()
    assert sorted((str(r[0]), r[1], list(r[2]), list(r[3])) for r in out) == sorted(plain(docs, items))


def test_long_text_of_one_word(spark):
    import time
    rows = [(0, "w " * 20_000), (1, "x " + "w " * 9), (2, "v w " * 10_000)]
    bench = [("a", "w " * 2_000), ("b", "w v " * 1_000), ("c", "w " * 30 + "end")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    began = time.time()
    out = {r[0]: (len(r.hits), r["items"]) for r in decontaminate(df, bench).select("doc.doc_id", "hits", "items").collect()}
    assert out == {0: (20_000, ["a", "c"]), 1: (0, []), 2: (20_000, ["b"])}
    assert time.time() - began < 60
