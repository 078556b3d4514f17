"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone.  Letters are lower-cased;
anything between letters is one gap sign.  An n-gram of three signs is bound: the first letter's vector
rolled by two places, the second's by one, and the third's, multiplied.  A text's vector is the sum of
its n-grams' vectors (each n-gram weighted by how often it occurs), scaled to length one; a language's
prototype is the sum over its training texts.  A text gets the language whose prototype has the largest
cosine; the score is that cosine, cut to 0 to 1.

Training texts are a sample of the labelled rows, about ``sample_rows`` in all, taken by a hash of the
key; every labelled row is counted to find the share.  Each task adds up one vector per language, and
these (tasks * languages rows) are summed by position, so what reaches the driver is one vector per
language.  Predicting is one pass over the texts without a shuffle; the prototypes go with the task.

Cases: null texts and texts without letters are "und" with score 0, also when nothing could be learned;
texts of any length are read whole, in blocks; ties go to the language that sorts first; null labels and
null texts aren't learned; repeated rows count each; an empty table gives no rows.  Only key, text and
label columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SAMPLE_ROWS = 40_000
GAP = 32                        # the sign between words
_BLOCK = 1_000_000              # characters of a text handled at once


@lru_cache(maxsize=100_000)
def _letter(code: int, dims: int) -> np.ndarray:
    if code == GAP:
        return np.random.default_rng([7, 0]).integers(0, 2, dims, dtype=np.int8) * 2 - 1
    return np.random.default_rng([7, code]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=30_000)
def _bound(key: int, dims: int) -> np.ndarray:
    a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
    return (np.roll(_letter(a, dims), 2) * np.roll(_letter(b, dims), 1) * _letter(c, dims)).astype(np.float32)


class _Letters:
    """For each code point: itself if a letter, else the gap sign."""

    def __init__(self):
        self.table = np.array([c if chr(c).isalpha() else GAP for c in range(0x10000)], dtype=np.int64)

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        out = self.table[np.minimum(codes, 0xFFFF)]
        for at in np.flatnonzero(codes > 0xFFFF):
            out[at] = codes[at] if chr(codes[at]).isalpha() else GAP
        return out


@lru_cache(maxsize=1)
def _letters() -> _Letters:
    return _Letters()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (21 bits a sign) and their counts; none without a letter."""
    keys, counts, letters = [], [], False
    signs = np.array([GAP])
    for at in range(0, len(text) + 1, _BLOCK):
        own = _letters().of(text[at:at + _BLOCK])
        letters = letters or bool((own != GAP).any())
        ends = [GAP] if at + _BLOCK > len(text) else []
        signs = np.concatenate([signs, own, np.array(ends, dtype=np.int64)])
        signs = signs[~((signs == GAP) & (np.r_[-1, signs[:-1]] == GAP))]
        if len(signs) >= 3:
            k, n = np.unique((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:], return_counts=True)
            keys.append(k)
            counts.append(n)
        signs = signs[-2:]                       # begins the next block's n-grams
    if not letters:
        keys = []
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


class _Space:
    """Vectors of the n-grams that a task has met, as rows of one matrix that starts anew when it is full."""

    def __init__(self, dims: int, most: int = 20_000):
        self.dims, self.most = dims, most
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((2048, dims), np.float32)

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text, or None without letters."""
        keys, counts = grams(text or "")
        if not len(keys):
            return None
        total = np.zeros(self.dims, np.float32)
        for at in range(0, len(keys), 4096):
            total += self._sum(keys[at:at + 4096].tolist(), counts[at:at + 4096])
        norm = float(np.linalg.norm(total))
        return total / norm if norm else None

    def _sum(self, keys: list[int], counts: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(keys) > self.most:
            self.rows = {}
        for k in keys:
            if k not in self.rows:
                if len(self.rows) == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                self.matrix[len(self.rows)] = _bound(k, self.dims)
                self.rows[k] = len(self.rows)
        places = np.fromiter((self.rows[k] for k in keys), np.int64, len(keys))
        return counts.astype(np.float32) @ self.matrix[places]


def _bundle(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = _Space(dims), {}
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                v = space.vector(text)
                if v is not None:
                    sums[label] = sums.get(label, 0) + v.astype(np.float64)
        if sums:
            yield pd.DataFrame({"label": list(sums), "vector": [v.tolist() for v in sums.values()]})
    return run


def learn(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "lang",
          sample_rows: int = SAMPLE_ROWS, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype of every label among the sampled rows that are ``learnable``."""
    rows = docs.where(F.coalesce(learnable, F.lit(False)) & F.col(label).isNotNull() & F.col(text).isNotNull())
    # A label with few rows is taken whole; the shares are one number per label.
    labels = [(r[0], r[1]) for r in rows.groupBy(F.col(label).cast("string")).count().collect()]
    if not labels:
        return {}
    each = max(1, sample_rows // len(labels))
    drawn = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in labels for x in (k, min(1.0, each / n))])
    taken = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), drawn.alias("drawn"))
    taken = taken.where(F.col("drawn") < share[F.col("label")]).select("label", "text")
    sums = (taken.mapInPandas(_bundle(dims), "label string, vector array<double>")
            .select("label", F.posexplode("vector").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x")))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():                     # labels * dims rows
        out.setdefault(r["label"], np.zeros(dims))[r["at"]] = r["x"]
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in out.items()}


def _predict(names: list[str], matrix: np.ndarray, dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = _Space(dims)
        for batch in batches:
            labels, scores = [], []
            for text in batch["text"]:
                v = space.vector(text) if names else None
                if v is None:
                    labels.append("und")
                    scores.append(0.0)
                else:
                    cosines = matrix @ v
                    best = int(np.argmax(cosines))
                    labels.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": labels, "score": scores})
    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text",
             dims: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).astype(np.float32)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        _predict(names, matrix, dims), f"doc_id {kind}, lang_pred string, score double")
