"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a label; every other text is unlabelled and may be toxic too.  With class
prior p, positives P, unlabelled texts U and logistic loss l the risk of a scorer g is

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

The second part estimates the loss on clean texts, which can't be negative; where a step has made it
so, the next step climbs out of it instead of fitting the sample's noise.

A text is the set of its lower-cased words (runs of letters).  A word has hashed features: itself, and the stretches of GRAM
letters of the word with marks at its ends, so inflected and joined forms share features.  A feature's value is the root of
the number of distinct words that have it.

``MEMBERS`` linear models are trained with numpy, one task each, on their own draws of about ``POSITIVES`` and
``UNLABELLED`` rows (by hash of the key; all rows are counted to find the shares) and averaged.  A task keeps features
that positives have clearly more often than unlabelled texts, at most ``MAX_FEATURES``.  The driver gets these weights
only.  Scoring is one pass over whole texts without a shuffle.

Cases: null and empty texts get the score of a text without words; texts of any length are read whole, in
blocks; a key labelled both ways counts as toxic; repeated rows are each scored and, if drawn, learned once per
member; null keys and null texts aren't learned; without positives every score is 0; an empty table gives no rows.
Only the key and text columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 5
FEATURE_BITS = 20
POSITIVES = 3_000                # drawn rows a member, about
UNLABELLED = 9_000
MEMBERS = 3
MAX_FEATURES = 30_000
_BLOCK = 1_000_000               # characters of a text split at once
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


@dataclass
class Model:
    bias: float = -math.inf      # without positives nothing is toxic
    weights: dict[int, float] = field(default_factory=dict)


def words_of(text: str | None) -> set[str]:
    text, out, at = (text or "").lower(), set(), 0
    while at < len(text):
        cut = _GAP.search(text, at + _BLOCK)
        end = cut.start() if cut else len(text)
        out.update(_WORD.findall(text, at, end))
        at = end
    return out


def features_of(word: str) -> list[int]:
    """Hashed features of a word, each once."""
    marked = f"<{word}>"
    grams = {marked, *(marked[k:k + GRAM] for k in range(len(marked) - GRAM + 1))}
    return list({zlib.crc32(g.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS) for g in grams})


class _Known(dict):
    """Features of the words that a task has met; starts anew when full."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = features_of(word)
        return out


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Known()
    for batch in batches:
        ids, counts = [], []
        for text in batch["text"]:
            own = [f for w in words_of(text) for f in known[w]]
            k, n = np.unique(np.array(own, dtype=np.int32), return_counts=True)
            ids.append(k)
            counts.append(n.astype(np.int32))
        yield pd.DataFrame({"member": batch["member"], "positive": batch["positive"], "ids": ids, "counts": counts})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _select(ids: list[np.ndarray], positive: np.ndarray, size: int) -> np.ndarray:
    """Features that at least three positives have, and clearly more often than unlabelled texts do."""
    def holders(rows):
        return np.bincount(np.concatenate([ids[r] for r in rows] + [np.empty(0, np.int32)]).astype(np.int64), minlength=size)
    n_pos, n_un = positive.sum(), (~positive).sum()
    in_pos, in_un = holders(np.flatnonzero(positive)), holders(np.flatnonzero(~positive))
    rate = (in_un + 1.0) / (n_un + 2.0)
    z = (in_pos - n_pos * rate) / np.sqrt(n_pos * rate * (1 - rate) + 1e-12)
    good = np.flatnonzero((in_pos >= 3) & (z >= 4.0))
    return good[np.lexsort((good, -z[good]))][:MAX_FEATURES]


def fit_nnpu(ids: list[np.ndarray], counts: list[np.ndarray], positive: np.ndarray, prior: float,
             steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features, weights) of a linear scorer, by Adam on the whole sample."""
    chosen = _select(ids, positive, 1 << FEATURE_BITS)
    column = np.full(1 << FEATURE_BITS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    row, col, val = [], [], []
    for r, (k, n) in enumerate(zip(ids, counts)):
        c = column[k]
        row.append(np.full((c >= 0).sum(), r))
        col.append(c[c >= 0])
        val.append(np.sqrt(n[c >= 0]))
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    n, d = len(ids), len(chosen)
    pos, un = positive / positive.sum(), ~positive / (~positive).sum()
    theta = np.zeros(d + 1)
    theta[d] = math.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        g = np.bincount(row, weights=val * theta[col], minlength=n) + theta[d]
        as_clean = np.logaddexp(0, g)                      # l(-g)
        clean_risk = (un * as_clean).sum() - prior * (pos * as_clean).sum()
        p = _sigmoid(g)
        clean_slope = (un - prior * pos) * p
        slope = prior * pos * (p - 1) + clean_slope if clean_risk >= 0 else -clean_slope
        grad = np.r_[np.bincount(col, weights=val * slope[row], minlength=d) + decay * theta[:d], slope.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return float(theta[d]), chosen, theta[:d]


def _train(prior: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, and each text's features once: a drawn group of copies is one example.
        ids, counts, seen, positive = [], [], set(), []
        keyed = sorted((bool(p), k.tobytes() + n.tobytes(), i) for i, (p, k, n) in enumerate(
            zip(rows["positive"], map(np.asarray, rows["ids"]), map(np.asarray, rows["counts"]))))
        for p, name, i in keyed:
            if (p, name) not in seen:
                seen.add((p, name))
                ids.append(np.asarray(rows["ids"].iloc[i]))
                counts.append(np.asarray(rows["counts"].iloc[i]))
                positive.append(p)
        positive = np.array(positive, dtype=bool)
        out = {"member": int(rows["member"].iloc[0]), "feature": [-1], "weight": [0.0]}
        if positive.any() and not positive.all():
            bias, chosen, weights = fit_nnpu(ids, counts, positive, prior)
            out |= {"feature": [-1, *chosen.tolist()], "weight": [bias, *weights.tolist()]}
        else:
            out["weight"] = [-math.inf]
        return pd.DataFrame(out)
    return run


def _drawn(key: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def learn(docs: DataFrame, toxic: DataFrame, learnable: Column, prior: float, key: str = "doc_id", text: str = "text",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = MEMBERS) -> Model:
    """``toxic``: keys of confirmed toxic rows; ``learnable``: a condition on the key; ``prior``: toxic share of all rows."""
    rows = docs.where(F.coalesce(learnable, F.lit(False)) & F.col(key).isNotNull() & F.col(text).isNotNull())
    marked = toxic.select(F.col(key)).where(F.coalesce(learnable, F.lit(False)) & F.col(key).isNotNull()).distinct()
    n_pos, n_all = marked.count(), rows.count()
    if not n_pos or not n_all:
        return Model()
    # About members * positives keys: a bound given by parameters, not by the data.
    share = [min(1.0, positives / n_pos), min(1.0, unlabelled / n_all)]
    on = lambda salt, s: F.filter(F.array(*[F.when(_drawn(key, f"{salt}{m}") < s, m) for m in range(members)]), lambda x: x.isNotNull())
    few = marked.withColumn("_pos", on("p", share[0])).where(F.size("_pos") > 0)
    both = rows.select(key, F.col(text).alias("text"), on("u", share[1]).alias("_un")).join(F.broadcast(few), key, "left")
    drawn = both.select("text", F.concat(
        F.transform("_un", lambda m: F.struct(m.alias("member"), F.lit(False).alias("positive"))),
        F.coalesce(F.transform("_pos", lambda m: F.struct(m.alias("member"), F.lit(True).alias("positive"))), F.array())).alias("d"))
    drawn = drawn.where(F.size("d") > 0).select("text", F.explode("d").alias("d")).select("d.*", "text")
    made = drawn.mapInPandas(_featured, "member int, positive boolean, ids array<int>, counts array<int>")
    weights = made.groupBy("member").applyInPandas(_train(prior), "member int, feature int, weight double").collect()
    own = sorted({r["member"] for r in weights})
    out = Model(bias=0.0)
    for r in sorted(weights, key=lambda r: (r["feature"], r["member"])):
        if r["feature"] < 0:
            out.bias += r["weight"] / len(own)
        else:
            out.weights[r["feature"]] = out.weights.get(r["feature"], 0.0) + r["weight"] / len(own)
    return out


def margin(model: Model, text: str | None, features=features_of) -> float:
    counts: dict[int, int] = {}
    for w in words_of(text) if model.weights else ():
        for f in features(w):
            if f in model.weights:
                counts[f] = counts.get(f, 0) + 1
    return model.bias + sum(model.weights[f] * math.sqrt(n) for f, n in sorted(counts.items()))


class _Relevant(dict):
    """Of the words met, the features with a weight (most have none); starts anew when full."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        out = self[word] = tuple(f for f in features_of(word) if f in self.weights)
        return out


def _scored(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Relevant(model.weights)
        for batch in batches:
            z = [margin(model, text, known.__getitem__) for text in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "score": [1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0 for x in z]})
    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the estimated probability that a row's text is toxic."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = rows.mapInPandas(_scored(model), "key string, score double")
    return out.select(F.col("key").cast(kind).alias(key), "score")
