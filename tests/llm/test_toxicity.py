import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tagsift.llm import toxicity
from tagsift.llm.queries_toxicity import op11_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    out = op11_toxicity(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    assert len(out) == len(docs) and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.3).astype(int)).all()
    assert all(out.held_out[k] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out.index)
    held = out[out.held_out].join(labels, how="inner").join(docs)
    assert held[held.toxic == 1].predicted.mean() >= 0.9
    assert held[held.toxic == 0].predicted.mean() <= 0.08
    english = held[held.lang == "en"]
    assert english[english.toxic == 0].predicted.mean() <= 0.02


def test_risk_is_non_negative_and_prior_corrected():
    draw = random.Random(5)
    texts, positive = [], []
    for k in range(1200):
        toxic = k % 10 == 0
        words = [draw.choice("abcdefgh") + draw.choice("stuvwxyz") for _ in range(20)] + (["nastyword"] if toxic else [])
        texts.append(words)
        positive.append(toxic and k < 600)
    ids, counts = [], []
    for words in texts:
        k, n = np.unique([f for w in set(words) for f in toxicity.features_of(w)], return_counts=True)
        ids.append(k.astype(np.int32))
        counts.append(n)
    bias, chosen, weights = toxicity.fit_nnpu(ids, counts, np.array(positive), 0.1)
    model = toxicity.Model(bias, dict(zip(chosen.tolist(), weights.tolist())))
    # Unlabelled toxic texts get high scores though they were never marked: nothing was learned as "clean".
    scores = np.array([toxicity.margin(model, " ".join(t)) for t in texts])
    toxic = np.arange(1200) % 10 == 0
    assert (scores[toxic] > 0).all() and (scores[~toxic] < -0.8).all()


def test_scores_against_plain(spark):
    model = toxicity.Model(-1.5, {f: 0.25 * k for k, f in enumerate(toxicity.features_of("größten") + toxicity.features_of("idiot"))})
    texts = ["Idiot, idiot! IDIOTS", "größten groß", "", None, "12 -- _", "idiot " * 300_000 + "größten"]
    df = spark.createDataFrame([(k, t, 0.5, "k") for k, t in enumerate(texts)], "doc_id long, text string, score double, key string")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for k, t in enumerate(texts):
        assert math.isclose(got[k], 1 / (1 + math.exp(-toxicity.margin(model, t))))
    counts = {}
    for w in {"idiot", "idiots"}:
        for f in toxicity.features_of(w):
            counts[f] = counts.get(f, 0) + 1
    assert math.isclose(toxicity.margin(model, texts[0]), -1.5 + sum(model.weights.get(f, 0) * math.sqrt(n) for f, n in counts.items()))


def test_blocks_cut_between_words(monkeypatch):
    text = "Größe, l'été 12 ñandú — a_b ok " * 5 + "x" * 50
    whole = toxicity.words_of(text)
    for block in (1, 3, 7):
        monkeypatch.setattr(toxicity, "_BLOCK", block)
        assert toxicity.words_of(text) == whole
    assert whole == {"größe", "l", "été", "ñandú", "a", "b", "ok", "x" * 50}


def test_cases(spark):
    own = [chr(97 + k % 26) * 3 + chr(97 + k // 26) for k in range(60)]
    rows = [(k, f"you nasty thing {own[k]}" if k % 3 == 0 else f"a kind thing {own[k]}", "x") for k in range(60)]
    rows += [(61, None, "x"), (62, "", "x"), (None, "nasty", "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, member string")
    toxic = spark.createDataFrame([(k,) for k in range(0, 45, 3)] + [(None,), (0,)], "doc_id long")
    model = toxicity.learn(df, toxic, F.lit(True), 0.33)
    got = [(r.doc_id, r.score) for r in toxicity.score(df, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    low = max(s for k, s in got if k is not None and k < 60 and k % 3)
    assert min(s for k, s in got if k is None or (k < 60 and k % 3 == 0)) > low
    assert model == toxicity.learn(df, toxic, F.lit(True), 0.33)
    nothing = toxicity.learn(df, toxic.limit(0), F.lit(True), 0.33)
    assert {r.score for r in toxicity.score(df, nothing).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == []
