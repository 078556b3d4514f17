"""Packing of documents into sequences of a fixed number of tokens: bounded-space online packing.

Each input partition is packed as it streams by, with a fixed number of open windows: a document's
ids (and an end id) are cut into full sequences and a rest; the rest goes to the open window it fits
best; when it fits none, a window is opened, or, with all of them open, the fullest one is emitted
first.  A partition ends with a few windows that aren't full.  These leftovers (their number depends
on the partitions, not on the rows) are merged: the windows of ``fan_in`` partitions are laid end to
end and cut at the sequence length, which leaves one sequence per group that isn't full.

The first phase is written to the shared folder, since both its finished windows and its leftovers
are used; nothing is shuffled but the leftovers.

Cases: a null or empty text is just the end id; texts of any length are cut, never dropped; repeated
rows are packed each on its own; null keys are kept; an empty table gives no rows.  Only the key and
text columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsift.llm.shared import written
from tagsift.llm.tokens import encoder

TEXTS_AT_ONCE = 2_000_000      # characters tokenised in one go
PIECES_AT_ONCE = 2_000         # rows handed back in one go
MERGED = 1 << 62               # sequence ids of merged windows start here


class _Windows:
    """The open windows of one partition, kept by the space that is left in them."""

    def __init__(self, seq_len: int, most: int):
        self.seq_len, self.most = seq_len, most
        self.spaces: list[tuple[int, int]] = []              # (space, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.count = 0

    def place(self, piece: tuple, size: int) -> list[tuple[int, list[tuple]]]:
        """Put a piece into the window it fits best; the windows that this closes."""
        closed = []
        at = bisect_left(self.spaces, (size, -1))
        if at < len(self.spaces):
            space, window = self.spaces.pop(at)
        else:
            if len(self.spaces) == self.most:
                _, fullest = self.spaces.pop(0)
                closed.append((fullest, self.pieces.pop(fullest)))
            space, window, self.count = self.seq_len, self.count, self.count + 1
            self.pieces[window] = []
        self.pieces[window].append((*piece, self.seq_len - space))
        if space == size:
            closed.append((window, self.pieces.pop(window)))
        else:
            insort(self.spaces, (space - size, window))
        return closed


_PIECE = ["start", "length", "doc_tokens", "ids", "offset"]


def _pack_partition(path: str, end_id: int, seq_len: int, most: int, special_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, enc, windows, out = TaskContext.get().partitionId(), encoder(path, special_ids), _Windows(seq_len, most), []

        def rows(window: int, pieces: list[tuple], done: bool) -> None:
            out.extend((*p, part, window, done) for p in pieces)

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["doc_id", *_PIECE, "part", "window", "done"])
            out.clear()
            return made

        for batch in batches:
            keys = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            texts = batch["text"].fillna("").tolist()
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) <= TEXTS_AT_ONCE):
                    size, to = size + len(texts[to]), to + 1
                for key, ids in zip(keys[at:to], enc.encode(texts[at:to])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, seq_len):
                        n = min(seq_len, total - start)
                        piece = (key, start, n, total, ids[4 * start:4 * (start + n)])
                        for window, pieces in windows.place(piece, n):
                            rows(window, pieces, True)
                    if len(out) >= PIECES_AT_ONCE:
                        yield frame()
                at = to
        for window, pieces in windows.pieces.items():
            rows(window, pieces, False)
        if out:
            yield frame()

    return run


def _merge_leftovers(seq_len: int):
    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["part", "window", "offset"])
        out, sequence, fill = [], 0, 0
        for doc, start, length, total, ids in zip(*(left[c] for c in ["doc_id", "start", "length", "doc_tokens", "ids"])):
            done = 0
            while done < length:
                n = min(length - done, seq_len - fill)
                out.append((doc, start + done, n, total, ids[4 * done:4 * (done + n)],
                            MERGED + (int(key[0]) << 32) + sequence, fill))
                done, fill = done + n, fill + n
                if fill == seq_len:
                    sequence, fill = sequence + 1, 0
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
         seq_len: int = 2048, open_windows: int = 64, fan_in: int = 32, special_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32 bit), sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can open.  With ``special_ids`` the strings
    of its special tokens get their ids, as the file has it; else they are ordinary text.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    piece = [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
             T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
             T.StructField("offset", T.LongType())]
    first = T.StructType([*piece, T.StructField("part", T.LongType()), T.StructField("window", T.LongType()),
                          T.StructField("done", T.BooleanType())])
    placed = written(rows.mapInPandas(_pack_partition(tokenizer, end_id, seq_len, open_windows, special_ids), first),
                     "packed", compression="zstd")
    cols = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    full = placed.where("done").withColumn("sequence_id", F.shiftleft("part", 32) + F.col("window")).select(*cols)
    merged = (placed.where(~F.col("done")).groupBy(F.floor(F.col("part") / fan_in).cast("long").alias("_group"))
              .applyInPandas(_merge_leftovers(seq_len), T.StructType(
                  [*piece[:5], T.StructField("sequence_id", T.LongType()), piece[5]])))
    return full.unionByName(merged)
