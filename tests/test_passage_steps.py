"""Steps of passages and word pieces that are made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsift.operators import features as ft
from tagsift.operators import passages as ps


def test_best_windows_are_those_of_every_place(spark):
    cases = [(n, room, min(room, step)) for n in (1, 7, 25, 64, 130, 333) for room, step in ((5, 9), (10, 4), (12, 3), (125, 64), (110, 64))]
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n int, room int, step int").withColumn("first", F.floor(F.col("n") / 3))
    one = F.transform(F.sequence(F.col("first"), F.col("n") - 1), lambda p: ps.best_window(p, F.col("n"), F.col("room"), F.col("step")))
    for r in d.select("k", "n", ps.best_windows("n", "room", "step", "first").alias("got"), one.alias("want")).collect():
        assert r.got == r.want, cases[r.k]


def test_answer_in_a_long_text(spark):
    orig = " ".join(f"Wört{k}" for k in range(20_000))
    df = spark.createDataFrame([(1, "wort19998 wort19999", orig), (2, None, "a"), (3, "a", None), (4, "a", "  ")], "k int, pred_text string, orig_text string")
    got = {r.k: r.answer for r in ps.answer_text(df).collect()}
    assert got == {1: "Wört19998 Wört19999", 2: "a", 3: None, 4: "  "}


def test_pieces_are_tried_up_to_their_kinds_longest(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[UNK]", "a", "ab", "abcdef", "##c", "##cd", "##d", "##", "##x"])], "token string, id int")
    words = spark.createDataFrame([(w,) for w in ["abcdef", "abcd", "abcc", "abce", "##x", "", None, "a" * 101, "ax"]], "word string")
    sub = ft.wordpiece(words, vocab)
    got = {r.word: r.pieces for r in sub.collect()}
    u = ["[UNK]"]
    assert got == {"abcdef": ["abcdef"], "abcd": ["ab", "##cd"], "abcc": ["ab", "##c", "##c"], "abce": u, "##x": ["##x"], "": u, None: u,
                   "a" * 101: u, "ax": ["a", "##x"]}
    assert ft.piece_ids(sub.where("word = 'abcd'"), vocab).first().ids == [2, 5]
