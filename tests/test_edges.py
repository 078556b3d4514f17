"""Hand-made edge rows (FIXTURES.md §4) checked against plain-Python statements of the rules."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tagsift.functions.scoring import odds_ratio
from tagsift.functions.text import unescape_text
from tagsift.operators import evidence as ev
from tagsift.operators import features as ft
from tagsift.operators import metrics as mt
from tagsift.operators.context import bad_span, contexts

# --- plain-Python statements of the rules (written for these tests) ---------


def py_unescape(s):
    s = re.sub(r"(^|[^\\]|\\\\)\\t", "\\1\t", s)
    return s.replace("\\\\", "\\").replace("\t", " ")


def py_norm(s):
    return " ".join(s.split())


def py_is_word(tok):
    return any(c.isalnum() for c in tok)


def py_words(s, n, reverse=False):
    """Shortest leading (or trailing) run of tokens with n words in it, all tokens if there are fewer: by the places
    of the words."""
    toks = (s.split(" ") if s else [""])[::-1 if reverse else 1]
    places = [i for i, t in enumerate(toks) if py_is_word(t)]
    cut = toks if len(places) < n else toks[:places[n - 1] + 1] if n else []
    return " ".join(cut[::-1 if reverse else 1])


def py_context(text, start, end, n):
    return (py_words(py_norm("DOCSTART " + text[:start]), n, reverse=True), py_words(py_norm(text[end:] + " DOCEND"), n))


def py_chunks(tags):
    """Chunk spans of a tag sequence, as matches of one pattern over a string with a letter for each tag.

    Runs of equal types are told apart first; inside a run a chunk is a B or nothing, then Is, then an E or
    nothing; an S or a bracket is a chunk of its own.
    """
    split = [t.split("-", 1) if "-" in t else [t, ""] for t in tags]
    letters = "".join("O" if p in "O." else p for p, _ in split)
    spans, start = [], 0
    for i in range(1, len(tags) + 1):
        if i == len(tags) or split[i][1] != split[start][1]:
            spans += [(start + m.start(), start + m.end() - 1, split[start][1])
                      for m in re.finditer(r"BI*E?|I+E?|E|S|[\[\]]", letters[start:i])]
            start = i
    return spans


# --- tests -----------------------------------------------------------------

def test_unescape_cases(spark):
    cases = ["a\\tb", "a\\t\\tb", "\\tb", "a\\\\tb", "a\\\\\\tb", "x\\\\y", "plain"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(unescape_text(F.col("s"))).collect()]
    assert got == [py_unescape(c) for c in cases]


def test_contexts_edge_texts(spark):
    texts = {1: "Alpha beta\u00a0gamma, delta (eps) zeta.\u2028Eta theta 𝔘 iota kappa lambda mu.",
             2: "one  two\tthree\x1cfour five six seven eight nine ten eleven twelve",
             3: "short", 4: "ab cd"}
    tags = [(1, 0, 4, -1, "x"), (1, 6, 14, -2, "y"), (1, 46, 46, -26, "astral"), (2, 9, 12, 9606, "g"),
            (2, 5, 6, -1, "c"), (3, 0, 4, 0, "u"), (1, 2, 3, -1, "mid"), (1, 48, 51, -1, "after-astral"),
            (1, 53, 59, -1, "runs-on"), (4, 0, 2, -1, "bad")]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tg = spark.createDataFrame(tags, "doc_id long, start int, stop int, type int, identifier string")
    gate = re.compile(r"^\s+.*|.*\s+$")
    bad = {d for d, s, e, _, _ in tags if gate.match(texts[d].replace("\t", " ")[s:e + 1])}
    for n in (0, 1, 3, 100):
        got = {(r["doc_id"], r["text"]): (r["before"], r["after"]) for r in contexts(docs, tg, words=n).collect()}
        assert {k[0] for k in got} == {d for d, *_ in tags} - bad
        for d, s, e, _, _ in tags:
            if d in bad:
                continue
            t = texts[d].replace("\t", " ")
            want = py_context(t, s, e + 1, n) if n > 0 else ("", "")
            assert got[(d, t[s:e + 1])] == want, (d, s, e, n)


def test_quality_gate_drops_whole_document(spark):
    docs = spark.createDataFrame([(1, "aa bb cc\ndd ee"), (2, "ff gg hh")], "doc_id long, text string")
    # doc 1: span 'bb ' ends with a space (drops the doc, even though its type is filtered out)
    tg = spark.createDataFrame([(1, 3, 5, -26, "x"), (1, 0, 1, -1, "y"), (2, 0, 1, -1, "z")],
                               "doc_id long, start int, stop int, type int, identifier string")
    out = contexts(docs, tg, words=2, types=["che"]).collect()
    assert [r["doc_id"] for r in out] == [2]
    # the newline rule: 'cc\ndd ' does not count as ending in whitespace
    s = spark.createDataFrame([("cc\ndd ",), (" a",), ("a ",), ("ab",)], "s string")
    assert [r[0] for r in s.select(bad_span(F.col("s"))).collect()] == [False, True, True, False]


def test_missing_document_raises(spark):
    docs = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    tg = spark.createDataFrame([(2, 0, 1, -1, "x")], "doc_id long, start int, stop int, type int, identifier string")
    with pytest.raises(Exception):
        contexts(docs, tg).collect()


def test_ann_ids_text_order(spark):
    # tag lines sort as text: "1<TAB>100..." comes before "1<TAB>20...", so the span at 100 is tag 1
    t = "x" * 20 + "AB" + "x" * 78 + "CD" + "x" * 48
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    tg = spark.createDataFrame([(1, 20, 21, -1, "a"), (1, 100, 101, -1, "b")],
                               "doc_id long, start int, stop int, type int, identifier string")
    got = {r["text"]: r["ann_ids"] for r in contexts(docs, tg).collect()}
    assert got == {"CD": "1", "AB": "2"}


def test_odds_ratio_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.5, 1.0), (0.3, 0.6)], "g double, l double")
    got = df.select(odds_ratio("g", "l").alias("r"), odds_ratio("g", "l", invert=True).alias("ri")).collect()

    def py(g, l, inv=False):
        if inv:
            g, l = 1 - g, 1 - l
        den = (1 - l) * (1 - g)
        return math.inf if den == 0 else (l * g) / den
    for (g, l), r in zip([(1.0, 1.0), (0.0, 0.0), (0.5, 1.0), (0.3, 0.6)], got):
        assert r["r"] == pytest.approx(py(g, l)) and r["ri"] == pytest.approx(py(g, l, True))


def test_zero_probability_raises_and_underflow(spark):
    rows = [(1, i, "n", "ggp", c, p) for i in range(3) for c, p in
            (("ggp", 0.0 if i == 0 else 0.5), ("che", 0.5))]
    df = spark.createDataFrame(rows, "doc_id long, ann_id long, name string, s_type string, class string, p double")
    with pytest.raises(Exception):
        ev.local_evidence(df).collect()
    many = [(1, i, "n", "ggp", c, p) for i in range(400) for c, p in (("ggp", 1e-3), ("che", 0.999))]
    df2 = spark.createDataFrame(many, "doc_id long, ann_id long, name string, s_type string, class string, p double")
    r = ev.local_evidence(df2).collect()[0]
    assert r["log_prob"] == -1000.0 and r["count"] == 400


def test_chunk_eval_random(spark):
    rnd = random.Random(3)
    tags = ["O", "B-a", "I-a", "B-b", "I-b", "E-a", "S-b"]
    rows, gold_sp, pred_sp = [], set(), set()
    for sid in range(300):
        n = rnd.randint(1, 7)
        g = [rnd.choice(tags) for _ in range(n)]
        p = [rnd.choice(tags) for _ in range(n)]
        rows += [(str(sid), i + 1, g[i], p[i]) for i in range(n)]
        gold_sp |= {(str(sid),) + s for s in py_chunks(g)}
        pred_sp |= {(str(sid),) + s for s in py_chunks(p)}
    df = spark.createDataFrame(rows, "sent_id string, pos int, gold string, pred string")
    out = {r["type"]: r for r in mt.chunk_eval(df).collect()}
    o = out["__overall__"]
    assert o["gold"] == len(gold_sp) and o["guessed"] == len(pred_sp)
    assert o["correct"] == len(gold_sp & pred_sp)


def test_chunk_eval_long_sentence(spark):
    n = 200_000
    t = spark.range(1, n + 1).select(F.lit(1).alias("sent_id"), F.col("id").alias("pos"), F.lit("I-x").alias("gold"),
                                     F.when(F.col("id") == n, "O").otherwise("I-x").alias("pred"))
    out = {r["type"]: r for r in mt.chunk_eval(t).collect()}
    o = out["__overall__"]
    assert (o["gold"], o["guessed"], o["correct"], o["tokens"], o["correct_tags"]) == (1, 1, 0, n, n - 1)


def test_wordpiece_random(spark):
    vocab = ["[UNK]", "a", "b", "c", "ab", "abc", "##a", "##b", "##c", "##bc", "ca"]
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(200)})
    v = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "token string, line_no int")
    got = {r["word"]: list(r["pieces"]) for r in ft.wordpiece(spark.createDataFrame([(w,) for w in words], "word string"),
                                                               ft.load_vocab(v)).collect()}

    # Longest first among the pieces that may stand there: one pattern for the first piece, one for the others.
    first, rest = (re.compile("|".join(sorted((t.removeprefix("##") for t in vocab[1:] if t.startswith("##") == inner), key=len, reverse=True)))
                   for inner in (False, True))

    def py_wp(w):
        head = first.match(w)
        tail = re.fullmatch(f"(?:{rest.pattern})*", w[head.end():]) if head else None
        greedy = rest.findall(w[head.end():]) if tail else []
        return [head[0]] + ["##" + t for t in greedy] if tail and sum(map(len, greedy)) == len(w) - head.end() else ["[UNK]"]
    for w in words:
        assert got[w] == py_wp(w), w


def test_pretrain_invariants(spark):
    from tagsift.operators.pretrain import instances
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vocab = spark.createDataFrame([("foo", 0), ("bar", 1)], "token string, word_no long")
    inst = instances(docs, vocab, max_seq_length=64, dupe_factor=2).collect()
    assert inst
    for r in inst:
        toks = list(r["tokens"])
        assert len(toks) <= 64 and len(toks) == len(r["segment_ids"])
        n = min(20, max(1, int(round(len(toks) * 0.15))))
        assert len(r["masked_lm_positions"]) == min(n, len(toks) - 3)
        assert len(r["masked_lm_labels"]) == len(r["masked_lm_positions"])
        assert toks[0] == "[CLS]" and toks[-1] == "[SEP]" and toks.count("[SEP]") == 2
        assert list(r["segment_ids"]) == [0] * (toks.index("[SEP]") + 1) + [1] * (len(toks) - toks.index("[SEP]") - 1)
        assert list(r["masked_lm_positions"]) == sorted(set(r["masked_lm_positions"]))
        for at, label in zip(r["masked_lm_positions"], r["masked_lm_labels"]):
            assert label not in ("[CLS]", "[SEP]") and toks[at] in ("[MASK]", label, "foo", "bar")


def test_pretrain_plan_covers_every_sentence_once(spark):
    from tagsift.operators import pretrain as pt
    docs = spark.createDataFrame([(1, "One two. Three four! Five six seven? Eight."), (2, "a b c d e f g\nh i"), (3, "x")],
                                 "doc_id long, text string")
    table = pt.document_lengths(pt.sentences(docs))
    lengths = {r["doc_id"]: [x["n"] for x in r["s"]] for r in table.collect()}
    rows = pt.plan(table, 12, 20, 0.3, 7).collect()
    for doc, n in lengths.items():
        for dupe in range(1, 21):
            own = sorted((r for r in rows if (r["doc_id"], r["dupe"]) == (doc, dupe)), key=lambda r: r["inst_no"])
            covered = []
            for r in own:
                assert r["is_random_next"] == (r["b_doc"] != doc)
                covered += range(r["a_from"], (r["a_to"] if r["is_random_next"] else r["b_to"]) + 1)
                if not r["is_random_next"]:
                    assert r["b_from"] == r["a_to"] + 1
                assert 0 <= r["b_from"] <= r["b_to"] < len(lengths[r["b_doc"]])
            assert covered == list(range(len(n)))


def test_streamed_evidence_keeps_every_file_and_the_newest_rows(spark, tmp_path):
    from tagsift.operators.evidence import CLASSES, local_evidence
    from tagsift.streaming.running import streaming_local_evidence
    schema = "doc_id long, ann_id long, name string, s_type string, class string, p double"

    def rows(doc, p):
        other = (1 - p) / 4
        return [(doc, 1, "n", "ggp", c, p if c == "ggp" else other) for c in CLASSES]
    src, out, log = (f"{tmp_path}/{d}" for d in ("src", "out", "log"))
    frames = [spark.createDataFrame(rows(4, 0.5) + rows(8, 0.6), schema), spark.createDataFrame(rows(12, 0.7), schema),
              spark.createDataFrame(rows(16, 0.8), schema)]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    first = streaming_local_evidence(spark, src, frames[0].schema, out, log)
    assert {r["doc_id"] for r in first.collect()} == {4, 8, 12, 16}
    again = spark.createDataFrame(rows(8, 0.9), schema)              # a document that lands once more
    again.coalesce(1).write.mode("append").parquet(src)
    got = streaming_local_evidence(spark, src, frames[0].schema, out, log)
    want = local_evidence(frames[1].union(frames[2]).union(again).union(frames[0].where("doc_id = 4")))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_last_entity_of_a_serial_and_unique_global_rows(spark):
    from tagsift.operators.corpus import resolve_matches
    from tagsift.operators.lists import global_decision
    raw = spark.createDataFrame([(1, 0, 2, 7)], "doc_id long, start int, stop int, serial long")
    ent = spark.createDataFrame([(7, -1, "old", 1), (7, -2, "new", 2)], "serial long, type int, identifier string, line_no int")
    assert [(r["type"], r["identifier"]) for r in resolve_matches(raw, ent, "line_no").collect()] == [(-2, "new")]
    twice = spark.createDataFrame([("n", "ggp", 12, 0.6), ("n", "ggp", 3, 0.1)], "name string, type string, count long, avg_prob double")
    with pytest.raises(Exception, match="repeated global row"):
        global_decision(twice).collect()


def test_label_ids_do_not_depend_on_the_data(spark):
    from tagsift.operators.features import label_id
    df = spark.createDataFrame([("ggp",), ("org",)], "label string")
    assert [r[0] for r in df.select(label_id("label", ["org", "che", "ggp", "dis"])).collect()] == [2, 3]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("x",)], "label string").select(label_id("label", ["a"])).collect()
    with pytest.raises(ValueError):
        label_id("label", ["a", "a"])


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from tagsift.session import ensure_checkpoint_dir
    seen = []
    context = SimpleNamespace(setCheckpointDir=seen.append)

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session(**{"spark.master": "spark://host:7077"}))
    assert ensure_checkpoint_dir(session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x"})) == "hdfs://x" == seen[0]
    assert ensure_checkpoint_dir(session(**{"spark.master": "local[2]"})) == seen[1]


def test_dictionary_tags_longest_match_and_homonyms(spark):
    from tagsift.operators.textstats import tag_documents
    docs = spark.createDataFrame([(1, "Heat shock protein, heat"), (2, None), (3, ""), (4, "...")], "doc_id int, text string")
    names = spark.createDataFrame([("heat shock", -1, "hs"), ("Heat", -2, "h1"), ("heat", -2, "h2"), ("shock protein", -1, "sp"),
                                   ("protein", -26, "p"), ("protein", -26, "p")], "name string, type int, identifier string")
    got = sorted(tuple(r) for r in tag_documents(docs, names).collect())
    # "shock protein" starts inside "heat shock"; "protein" inside "shock protein"; both identifiers of "heat" stay.
    assert got == [(1, 0, 9, -1, "hs"), (1, 20, 23, -2, "h1"), (1, 20, 23, -2, "h2")]
    alone = sorted(tuple(r) for r in tag_documents(docs, names, max_words=1).collect())
    assert alone == [(1, 0, 3, -2, "h1"), (1, 0, 3, -2, "h2"), (1, 11, 17, -26, "p"), (1, 20, 23, -2, "h1"), (1, 20, 23, -2, "h2")]


def test_pretrain_records_against_plain_python(spark):
    from tagsift.operators.pretrain import instances, records
    docs = spark.createDataFrame([(1, "One two. Three four! Five six seven? Eight."), (2, "a b c d e f g\nh i"), (3, ""), (4, None)],
                                 "doc_id long, text string")
    names = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "One", "two", "a", "b", "c", "."]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token string, id int")
    words = spark.createDataFrame([("a", 0), ("b", 1)], "token string, word_no long")
    inst = instances(docs, words, max_seq_length=16, dupe_factor=3)
    number = lambda tokens: [names.index(t) if t in names else 1 for t in tokens]
    fill = lambda values, n, zero=0: list(values) + [zero] * (n - len(values))
    want = {(r["doc_id"], r["dupe"], r["inst_no"]): (
        fill(number(r["tokens"]), 16), fill([1] * len(r["tokens"]), 16), fill(r["segment_ids"], 16), fill(r["masked_lm_positions"], 4),
        fill(number(r["masked_lm_labels"]), 4), fill([1.0] * len(r["masked_lm_positions"]), 4, 0.0), int(r["is_random_next"]))
        for r in inst.collect()}
    got = {tuple(r[:3]): tuple(list(v) if isinstance(v, list) else v for v in r[3:]) for r in records(inst, vocab, 16, 4).collect()}
    assert want and got == want
    with pytest.raises(Exception, match="more than 4 places"):
        records(inst, vocab, 4, 4).collect()
    assert records(inst.limit(0), vocab, 16, 4).count() == 0
    with pytest.raises(ValueError):
        records(inst, vocab.where("token <> '[UNK]'"), 16, 4)


def test_missed_keys(spark):
    from tagsift.operators.corpus import missed_keys
    rows = spark.createDataFrame([("p53", "ggp"), ("p53", "ggp"), ("p53", "che"), (None, "ggp"), ("brca", "ggp")], "name string, type string")
    known = spark.createDataFrame([("p53", "che", 1), ("brca", "ggp", 2), ("brca", "ggp", 3)], "name string, type string, n_rows int")
    got = missed_keys(rows, known, ["name", "type"])
    assert sorted(map(tuple, got.collect()), key=str) == [("p53", "ggp", 2), (None, "ggp", 1)]
    assert missed_keys(rows.limit(0), known, ["name", "type"]).count() == 0
    assert missed_keys(rows, known.limit(0), ["name", "type"]).count() == 4
