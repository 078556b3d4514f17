"""Substring de-duplication: exact repeated word windows, found through merged count-min sketches.

Texts are laid down once in blocks (one row per few megabytes of text).  Then:

1. Every block sketches its windows: DEPTH rows of counters, indexed by hash; as few counters of a row
   are touched by a block, the touched ones are kept as a sorted, delta-coded list.  The blocks' sketches
   are merged by counter range; of the merged sketch each block gets back one bit for each counter it
   touched: is its sum two or more?
2. A window is estimated repeated if all its counters are (in the merged sketch or inside the block).
   Sums only ever overestimate, so no repeated window is lost; about one unique window in a hundred
   passes with them.  Only the windows that pass are grouped exactly, by 96 bits of hash: a block sends
   each of them once, with the smallest document that has it, and gets back one bit: does another block
   have it in a smaller document?
3. A block removes the words covered by the windows that start in a smaller document.

Scale: text is never shuffled row by row; blocks are compressed and join their bits twice.  What is
shuffled besides is a few bytes for each window (sketches) and about 14 for each window that seems
repeated.  A window that a third of all documents share is sent once per block, not once per document.
The sketch's width, and with it the number of ranges, follows the counted words, so the share of false
alarms stays the same at every size, and a merging task handles RANGE_SLOTS counters on average.

Cases: a null text has no words; texts under ``size`` words have no windows; a text of any length is
one block at most; a null key sorts after all others, and nulls are not smaller than each other; rows
with equal keys do not remove each other's words; an empty table gives no rows.  Only the key (a whole
number below 2^63 - 1) and text columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsift.llm.shared import written
from tagsift.llm.shingles import mix, word_hashes

DEPTH = 2
BLOCK_CHARS = 4_000_000
RANGE_SLOTS = 2_000_000         # counters merged by one task, on average
LOAD = 8                        # counters of a row per word, at least
_NO_KEY = 2**63 - 1
_U = np.uint64


def _pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that the planes of small numbers compress to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _deltas(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=rising.dtype.type(0))


def _spread(keys: np.ndarray, bits: int, range_bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges (by the upper ``range_bits`` of ``bits``) of rising keys, and their places."""
    of = (keys >> _U(bits - range_bits)).astype(np.int64) if range_bits else np.zeros(len(keys), np.int64)
    ids, at = np.unique(of, return_index=True)
    for i, a, b in zip(ids.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]):
        yield i, slice(a, b)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, made = TaskContext.get().partitionId(), 0
    keys, texts, chars = [], [], 0

    def row() -> pd.DataFrame:
        raw = [t.encode() for t in texts]
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
        sizes = np.array([len(r) for r in raw], np.uint64)
        return pd.DataFrame([((part << 32) + made, sum(len(r.split()) for r in raw), _pack(np.array(keys, np.int64)),
                              _pack(sizes), body)], columns=["block", "words", "keys", "sizes", "body"])

    for batch in batches:
        for key, text in zip(batch["doc_id"].tolist(), batch["text"].fillna("").tolist()):
            if texts and chars + len(text) > BLOCK_CHARS:
                yield row()
                made, keys, texts, chars = made + 1, [], [], 0
            keys.append(key)
            texts.append(text)
            chars += len(text)
    if texts:
        yield row()


class _Block:
    """Words of a block and its windows: hashes (96 bits), document and place of each."""

    def __init__(self, row, size: int):
        self.keys, sizes = _unpack(row.keys).view(np.int64), _unpack(row.sizes).astype(np.int64)
        body = zstandard.ZstdDecompressor().decompress(row.body, max_output_size=max(1, int(sizes.sum())))
        ends = np.cumsum(sizes).tolist()
        self.words = [body[a:b].split() for a, b in zip([0, *ends], ends)]
        hashes, self.counts = word_hashes(self.words)
        n = max(0, len(hashes) - size + 1)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        other = mix(hashes ^ _U(0xA0761D6478BD642F))
        for i in range(size):
            one = one * _U(0x9E3779B97F4A7C15) + hashes[i:i + n]
            two = two * _U(0xE7037ED1A0B428DB) + other[i:i + n]
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.at = np.flatnonzero(doc[:n] == doc[size - 1:size - 1 + n])
        self.doc = doc[self.at]
        self.one, self.two = mix(one[self.at]), mix(two[self.at]) >> _U(32)

    def slots(self, row: int, bits: int) -> np.ndarray:
        return mix(self.one ^ _U((row + 1) * 0x8EBC6AF09C88C6E3 & (2**64 - 1))) >> _U(64 - bits)

    def seem_repeated(self, sent: dict, bits: int, range_bits: int) -> np.ndarray:
        """Windows all of whose counters are two or more; ``sent``: (row, range) -> bits of the merged sketch."""
        seems = np.ones(len(self.one), bool)
        for row in range(DEPTH):
            own, back, n = np.unique(self.slots(row, bits), return_inverse=True, return_counts=True)
            more = n >= 2
            for i, places in _spread(own, bits, range_bits):
                more[places] |= np.unpackbits(np.frombuffer(sent[row, i], np.uint8), count=places.stop - places.start).astype(bool)
            seems &= more[back]
        return seems

    def distinct(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chosen windows (places), each one's number among the distinct ones, and of these both hashes and
        the smallest key."""
        at = np.flatnonzero(chosen)
        key = self.keys[self.doc[at]]
        order = np.lexsort((key, self.two[at], self.one[at]))
        one, two = self.one[at][order], self.two[at][order]
        first = np.ones(len(at), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(first) - 1
        return at, number, one[first], two[first], key[order][first]


def _sketch(size: int, bits: int, range_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                block, out = _Block(r, size), []
                for row in range(DEPTH):
                    own = np.unique(block.slots(row, bits))
                    out += [(r.block, row, i, _pack(_deltas(own[p]))) for i, p in _spread(own, bits, range_bits)]
                yield pd.DataFrame(out, columns=["block", "row", "range", "data"])
    return run


def _bits_of(blocks: list, flags: np.ndarray, lengths: list[int], row: int, range_: int) -> pd.DataFrame:
    cuts = np.split(flags, np.cumsum(lengths)[:-1])
    return pd.DataFrame({"block": blocks, "row": row, "range": range_, "bits": [np.packbits(c).tobytes() for c in cuts]})


def _merge_sketches(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    own = [np.cumsum(_unpack(d), dtype=np.uint64) for d in rows["data"]]
    _, back, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    return _bits_of(rows["block"].tolist(), (n >= 2)[back], [len(o) for o in own], int(key[0]), int(key[1]))


def _sent(list_) -> dict:
    return {(s["row"], s["range"]): s["bits"] for s in (list_ if list_ is not None else ())}


def _candidates(size: int, bits: int, range_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                block = _Block(r, size)
                seems = block.seem_repeated(_sent(r.sent), bits, range_bits)
                _, _, one, two, key = block.distinct(seems)
                yield pd.DataFrame([(r.block, i, _pack(_deltas(one[p])), two[p].astype("<u4").tobytes(), _pack(key[p]))
                                    for i, p in _spread(one, 64, range_bits)],
                                   columns=["block", "range", "one", "two", "least"])
    return run


def _merge_candidates(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of each block's windows: does another block have it in a smaller document?"""
    own = [np.cumsum(_unpack(d), dtype=np.uint64) for d in rows["one"]]
    one = np.concatenate(own)
    two = np.concatenate([np.frombuffer(d, "<u4") for d in rows["two"]])
    least = np.concatenate([_unpack(d) for d in rows["least"]]).view(np.int64)
    order = np.lexsort((least, two, one))
    first = np.ones(len(one), bool)
    first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    smallest = np.empty_like(least)
    smallest[order] = least[order][first][np.cumsum(first) - 1]
    return _bits_of(rows["block"].tolist(), smallest < least, [len(o) for o in own], DEPTH, int(key[0]))


def _remove(size: int, bits: int, range_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                block, sent = _Block(r, size), _sent(r.sent)
                at, number, one, _, least = block.distinct(block.seem_repeated(sent, bits, range_bits))
                elsewhere = np.zeros(len(one), bool)
                for i, p in _spread(one, 64, range_bits):
                    elsewhere[p] = np.unpackbits(np.frombuffer(sent[DEPTH, i], np.uint8), count=p.stop - p.start)
                later = elsewhere[number] | (block.keys[block.doc[at]] > least[number])
                starts = block.at[at[later]]
                steps = np.zeros(int(block.counts.sum()) + size + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + size, -1)
                gone = (np.cumsum(steps) > 0).tolist()
                out, a = [], 0
                for key, words in zip(block.keys.tolist(), block.words):
                    b = a + len(words)
                    n = sum(gone[a:b])
                    left = [w for w, g in zip(words, gone[a:b]) if not g] if n else words
                    out.append((key, b - a, n, b" ".join(left).decode()))
                    a = b
                yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words, joined by a space) of every row."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("doc_id"), F.col(text).alias("text"))
    blocks = written(rows.mapInPandas(_blocks, "block long, words long, keys binary, sizes binary, body binary"), "blocks")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    range_bits = max(0, math.ceil(math.log2(max(1, words / RANGE_SLOTS))))
    bits = max(range_bits + 1, math.ceil(math.log2(max(2, LOAD * words))))

    sketches = blocks.mapInPandas(_sketch(size, bits, range_bits), "block long, row int, range int, data binary")
    back = "block long, row int, range int, bits binary"
    first = written(sketches.groupBy("row", "range").applyInPandas(_merge_sketches, back), "sketch-bits")

    def with_bits(sent: DataFrame) -> DataFrame:
        lists = sent.groupBy("block").agg(F.collect_list(F.struct("row", "range", "bits")).alias("sent"))
        return blocks.join(lists, "block", "left")

    seem = with_bits(first).mapInPandas(_candidates(size, bits, range_bits),
                                        "block long, range int, one binary, two binary, least binary")
    second = written(seem.groupBy("range").applyInPandas(_merge_candidates, back), "repeat-bits")
    kept = with_bits(first.unionByName(second)).mapInPandas(
        _remove(size, bits, range_bits), "doc_id long, n_words long, n_removed long, kept_text string")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != _NO_KEY, F.col("doc_id")))
