"""Runs of repeated words (maximal repetitions) in texts, found with recompression grammars.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, 2 * q)`` words long,
that no neighbouring word extends keeping that period.  Words are ``[^\\x20\\x09-\\x0D]+``.

Several texts at a time become one sequence of integers in which words of different texts differ, and one
run-length grammar (see ``recompression``) is built over it.  For every period q the words are compared with
those q places on, at every m-th place, m = max(least - q, q): a run of period q agrees with itself at m places
in a row at least, so one of them is met (a harmonic grid, n / m places a period).  Where two words and one pair of
their neighbours agree, the grammar gives the exact extension to both sides.  A stretch that two periods
give belongs to the smaller one, as the larger is then its multiple.

Scale: one pass over the texts without a shuffle or any driver work; a task holds the texts of one batch, at most
``BATCH_WORDS`` words or one longer text.  Time is n log n in a text's words.

Cases: null and empty texts have no words, no runs and an empty collapsed text; texts of any length are read
whole; repeated rows and null keys count each by itself; an empty table gives no rows.  Only the key
and text columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsift.llm.recompression import extend_left, extend_right, grammar

LEAST = 12                       # words of the shortest run
BATCH_WORDS = 300_000            # words that share a grammar
_QUERIES = 500_000               # extensions asked for at once


def _sequence(texts: list[list[bytes]]) -> np.ndarray:
    """One array of numbers; equal words of a text have equal numbers, words of different texts never."""
    out, base = [], 0
    for words in texts:
        names: dict[bytes, int] = {}
        own = [names.setdefault(w, len(names)) for w in words]
        out.append(np.array(own, dtype=np.int64) + base)
        base += len(names)
    return np.concatenate(out)


def _grid(seq: np.ndarray, reach: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) on the grid at which a run may be; ``reach[q]``: words of the texts of 2 * q words and more."""
    places, periods, held = [], [], 0
    for q in range(1, len(reach)):
        m = max(least - q, q)
        at = np.arange(0, max(int(reach[q]) - q, 0), m)
        at = at[seq[at] == seq[at + q]]
        if len(at):
            # A run agrees at m >= 2 places in a row: at one of the neighbours too.
            after = seq[np.minimum(at + 1, len(seq) - 1)] == seq[np.minimum(at + q + 1, len(seq) - 1)]
            after &= at + q + 1 < len(seq)
            before = (at > 0) & (seq[at - 1] == seq[at + q - 1])
            at = at[after | before] if m > 1 else at
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held >= _QUERIES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For every text its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts])
    out = [np.empty((0, 3), np.int64) for _ in texts]
    order = [k for k in np.argsort(-sizes, kind="stable") if sizes[k] >= least]
    if not order:
        return out
    seq = _sequence([texts[k] for k in order])
    begins = np.cumsum(np.r_[0, sizes[order]])
    # Longest texts first, so those of 2 * q words and more are a beginning of the sequence.
    long = np.searchsorted(-sizes[order], -np.maximum(2 * np.arange(sizes.max() // 2 + 1), least), side="right")
    levels = None
    found = np.empty((0, 3), np.int64)           # start, end, period
    for at, q in _grid(seq, begins[long], least):
        levels = levels or grammar(seq)
        right = extend_right(levels, at, at + q)
        left = extend_left(levels, at, at + q)
        keep = right + left >= np.maximum(least - q, q)
        new = np.stack([at - left, at + right + q, q], axis=1)[keep]
        found = np.concatenate([found, new])
        # Of the periods of a stretch the smallest counts.
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]] if len(found) else found
    text = np.searchsorted(begins, found[:, 0], side="right") - 1
    rows = np.stack([found[:, 0] - begins[text], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    cuts = np.searchsorted(text, np.arange(len(order) + 1))
    for n, k in enumerate(order):
        own = rows[cuts[n]:cuts[n + 1]]
        out[k] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words but those that a run contains after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        gone = np.cumsum(change)[:-1] > 0
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _detect(least: int, batch_words: int):
    def answer(keys: list, texts: list[list[bytes]]) -> pd.DataFrame:
        runs = runs_of(texts, least)
        return pd.DataFrame({
            "key": pd.Series(keys, dtype=object), "n_words": [len(t) for t in texts],
            "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs],
            "collapsed_text": [_collapsed(t, r) for t, r in zip(texts, runs)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts, held = [], [], 0
            for key, text in zip(batch["key"], batch["text"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()    # bytes split at these blanks alone
                if held and held + len(words) > batch_words:
                    yield answer(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(words)
                held += len(words)
            if keys:
                yield answer(keys, texts)
    return run


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
              batch_words: int = BATCH_WORDS) -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and collapsed_text of every row.

    ``collapsed_text``: the words that no run contains after its first period, joined by one space.
    Integer keys come back in their type; others as text.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = "key string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = rows.mapInPandas(_detect(least, batch_words), schema)
    cast = kind if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    return out.withColumn("key", F.col("key").cast(cast)).withColumnRenamed("key", key)
