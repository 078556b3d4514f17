"""Preference formatting, in SQL functions only.

Two tables of turns hold the chosen and the rejected conversation of every pair.  The longest common
prefix of turns (equal role and text, place by place) is rendered once as the prompt; what follows on
either side is rendered as a completion, with the spans of the assistant's texts as its loss mask.  If
the prefix is a whole side, that side's completion is empty.

A turn is rendered as ``<|role|>`` + line end + text + ``<|end|>`` + line end; ``<|`` inside a text becomes
``< |``, so a text can't forge a turn.  Mask spans are code points of the completion, ends exclusive.

Scale: each side is one aggregate by pair (a row of the result is a pair's whole text, so its turns must
meet) and the sides are one join by pair; both sides shuffle by the pair, nothing is paired with
anything else.

Cases: a null role or text is an empty one; turns are ordered by number, then role and text (a null
number first); repeated turns stay; a pair without turns on one side has an empty completion there; a
null pair key is a pair of its own; empty tables give no rows.  Only the named columns are read, so
other columns of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.llm.shared import bind

END = "<|end|>\n"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _side(turns: DataFrame, pair: str, name: str) -> DataFrame:
    clean = [F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |")).alias(c) for c in ("role", "text")]
    return turns.select(F.col(pair).alias("pair"), F.struct(F.col("turn").cast("long").alias("turn"), *clean).alias("t")) \
        .groupBy("pair").agg(F.sort_array(F.collect_list("t")).alias(name))


def _common(a: Column, b: Column) -> Column:
    """Number of turns at the beginning that are equal on both sides."""
    least = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, least), lambda t, i: (t["role"] == F.get(b, i)["role"]) & (t["text"] == F.get(b, i)["text"]))
    return bind(F.array_position(same, False), lambda p: F.when(p == 0, least).otherwise(p.cast("int") - 1))


def _rest(turns: Column, common: Column) -> Column:
    return F.slice(turns, common + 1, F.size(turns))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of the assistant's texts in the rendered turns, joined by commas."""
    def spans(lengths: Column) -> Column:
        def place(t: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x)
            start = before + F.length(t["role"]) + F.lit(len("<|") + len("|>\n"))
            span = F.concat_ws(":", start.cast("string"), (start + F.length(t["text"])).cast("string"))
            return F.when(t["role"] == "assistant", span)

        return F.array_join(F.transform(turns, place), ",")

    return bind(F.transform(turns, lambda t: F.length(_render(t))), spans)


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask; turns have columns pair, turn, role, text."""
    a, b = _side(chosen, pair, "a"), _side(rejected, pair, "b")
    both = a.withColumn("ka", F.struct("pair")).join(b.withColumnRenamed("pair", "pair_b"),
                                                      F.col("pair").eqNullSafe(F.col("pair_b")), "full")
    none = F.array().cast(_TURNS)
    # A null pair on both sides is one pair; ``ka`` tells a missing left side from a null pair.
    both = both.select(F.when(F.col("ka").isNotNull(), F.col("pair")).otherwise(F.col("pair_b")).alias("pair"),
                       F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = both.withColumn("n", _common(F.col("a"), F.col("b")))
    both = both.select("pair", "n", F.slice("a", 1, F.col("n")).alias("p"), _rest(F.col("a"), F.col("n")).alias("a"),
                       _rest(F.col("b"), F.col("n")).alias("b"))
    return both.select(F.col("pair").alias("pair_id"), F.col("n").cast("long").alias("n_common"), _text(F.col("p")).alias("prompt"),
                       _text(F.col("a")).alias("chosen"), _mask(F.col("a")).alias("chosen_mask"),
                       _text(F.col("b")).alias("rejected"), _mask(F.col("b")).alias("rejected_mask"))


def swapped_last_reply(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A rejected side for every conversation: its last assistant turn gets the text of the partner's.

    Partners are the conversations 2k and 2k + 1.  Without a partner that has an assistant turn the last reply
    is left out.  Returns pair_id, turn, role, text.
    """
    t = turns.select(F.col(conv).alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = t.where((F.col("role") == "assistant") & F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).groupBy("pair_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    partner = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("other"))
    swap = last.select("pair_id", F.col("last.turn").alias("turn"), F.lit("assistant").alias("role")).join(partner, "pair_id", "left")
    out = t.join(swap.withColumn("swap", F.lit(True)), ["pair_id", "turn", "role"], "left")
    return out.where(F.col("swap").isNull() | F.col("other").isNotNull()).select(
        "pair_id", "turn", "role", F.when(F.col("swap"), F.col("other")).otherwise(F.col("text")).alias("text"))
