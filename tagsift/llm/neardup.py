"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Signatures.  A document's set of word shingles (``words`` each, five unless asked otherwise) gets CHUNKS * CHUNK_SYMBOLS MinHash values, each cut to
SYMBOL_BITS bits.  Two documents' signatures differ in about (1 - similarity) of the symbols.

Multi-index.  The signature is split into CHUNKS chunks.  By the pigeonhole principle two signatures
that differ in at most ``CHUNKS * (CHUNK_ERRORS + 1) - 1`` symbols (23 of 72) have a chunk with at most
CHUNK_ERRORS errors.  The places of these errors are enumerated: each chunk gives one key for every way
to leave out CHUNK_ERRORS of its symbols, and documents that share a key are candidates.  That holds for
all pairs under the distance, and finds most pairs above it: at a similarity of exactly 0.8 a pair has no
common key with odds of 3 in a million.

Links.  Texts with equal sets are one class first (a hash aggregate), so thousands of exact copies are
one vertex.  Candidates are confirmed on their full sets.  Inside a bucket not all pairs are made: first
every member is confirmed against one pivot, the bucket's smallest member it shares most keys with, then
against its other pivots, and after each round components are formed.  A bucket whose members are all in
one component has nothing left to find.  In the others, members outside the bucket's largest component
are compared with all members of other components, which covers every pair of the bucket that could still
join two components.  Candidates are pruned by signatures before the exact check, never one under the distance: sketches
of 64 of the symbols may differ in 24, and in large buckets, which are compared block by block, a pair passes if at
most 23 symbols differ or if it is near by wide signatures of 2,048 further bits; of the former those are
left out whose sets, counted by hash range, can't have enough in common (a proof, not an estimate).  Above the distance, at a similarity
of exactly 0.8, the sketches lose a pair with odds of 8 in 10 billion and the wide ones with 1.7 in a million.  What is compared in blocks
grows with outsiders times members, which nothing exact avoids when very many texts are just too far apart.

Scale: texts are read by the signature pass and by one semi-join that picks the candidates' texts (a
broadcast only if the counted ids are few); keys are 16-byte rows, shuffled with partial minima; hot
buckets are split by AQE in the joins.  All intermediate tables live in the shared folder.

Cases: null texts, empty texts and texts without words have an empty set and are linked with nothing; a
text of fewer words than a shingle is one shingle; texts of any length are read whole; rows without a key take no part
(component null, kept, chosen); rows with equal key and text get equal results; if a key stands at different
texts, each row is judged by its own text: classes are numbered by (smallest key, class), so no two are one vertex,
and of rows with the smallest key of their component those of its first class are ``chosen``; an empty table gives
no rows.  Only the key and text columns are read, so other columns of any name don't
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsift.llm.components import components
from tagsift.llm.shared import written
from tagsift.llm.shingles import mix, shingle_sets
from tagsift.operators.ordered import global_running

CHUNKS = 12
CHUNK_SYMBOLS = 6
CHUNK_ERRORS = 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
SYMBOL_BITS = 16
SKETCH_ERRORS = 24              # of 64 one-bit symbols; at similarity 0.8 more differ with odds of 8 in 10 billion
WIDE_BITS = 2048                # one-bit symbols compared in large buckets; similar pairs differ in a tenth at most,
WIDE_ERRORS = 270               # in more than 270 (five deviations) with odds of 1.7 in a million
SPREAD_BITS = 9                 # of a hash: the range in which it is counted
SMALL_BUCKET = 16               # members of a bucket whose open pairs are made by a plain join
BLOCK = 1024
PERCENT = 80
NEAR_SYMBOLS = CHUNKS * (CHUNK_ERRORS + 1) - 1   # the signature distance up to which every pair is confirmed
BROADCAST_IDS = 1_000_000       # candidate ids (32 bytes each) that may be broadcast
_CHARS_AT_ONCE = 1_000_000
_U = np.uint64

_RNG = np.random.default_rng(20_240_501)
_MULTIPLIERS = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)
_WIDE_MULTIPLIERS = _RNG.integers(0, 2**63, WIDE_BITS, dtype=np.uint64) * _U(2) + _U(1)
_KEEP = [c for c in combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - CHUNK_ERRORS)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS symbols for every (not empty) set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for i, a in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(flat * a, starts)
        out[:, i] = (mix(least) >> _U(64 - SYMBOL_BITS)).astype(np.uint16)
    return out


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of every signature: one for each chunk and each way to leave out its errors."""
    wide, out = sigs.astype(np.uint64), []
    for chunk in range(CHUNKS):
        for no, places in enumerate(_KEEP):
            key = np.full(len(sigs), chunk * len(_KEEP) + no + 1, np.uint64)
            for p in places:
                key = mix(key * _U(0x9E3779B97F4A7C15) + wide[:, chunk * CHUNK_SYMBOLS + p] + _U(1))
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def sketch(sigs: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 symbols."""
    return np.packbits((sigs[:, :64] & 1).astype(np.uint8), axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()


def wide_bits(sets: list[np.ndarray]) -> list[bytes]:
    """One bit of each of WIDE_BITS MinHash values of every set (of an empty set: zeros)."""
    out = np.zeros((len(sets), WIDE_BITS), np.uint8)
    for row, own in zip(out, sets):
        step = max(1, 64_000 // max(1, len(own)))          # products that fit a core's cache
        for at in range(0, WIDE_BITS if len(own) else 0, step):
            least = (own[:, None] * _WIDE_MULTIPLIERS[None, at:at + step]).min(axis=0)
            row[at:at + step] = (mix(least) >> _U(63)).astype(np.uint8)
    return [np.packbits(row).tobytes() for row in out]


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= _CHARS_AT_ONCE):
            size, to = size + len(texts[to] or ""), to + 1
        yield at, to
        at = to


def _sign(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at, to in _slices(texts):
                sets = shingle_sets(texts[at:to], words)
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full) if full else ())
                made = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(sigs).tobytes()) if len(s)
                        else (0, None, None) for s in sets]
                out = pd.DataFrame(made, columns=["n_shingles", "class", "signature"])
                out.insert(0, "doc_id", batch["doc_id"].iloc[at:to].to_numpy())
                out.insert(1, "digest", batch["digest"].iloc[at:to].to_numpy())
                yield out
    return run


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 4000):
            part = batch.iloc[at:at + 4000]
            keys = chunk_keys(np.frombuffer(b"".join(part["signature"]), np.uint16).reshape(-1, SYMBOLS))
            yield pd.DataFrame({"key": keys.ravel(), "v": np.repeat(part["v"].to_numpy(), keys.shape[1])})


def _confirm(words: int):
    """Pairs (u, v) of batches with u_text and v_text whose sets are similar enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            u_text, v_text = batch["u_text"].tolist(), batch["v_text"].tolist()
            for at, to in _slices([a + b for a, b in zip(u_text, v_text)]):
                distinct = list(dict.fromkeys([*u_text[at:to], *v_text[at:to]]))
                sets = dict(zip(distinct, shingle_sets(distinct, words)))
                for i in range(at, to):
                    a, b = sets[u_text[i]], sets[v_text[i]]
                    if 100 * min(len(a), len(b)) >= PERCENT * max(len(a), len(b)):
                        common = len(np.intersect1d(a, b, assume_unique=True))
                        keep[i] = 100 * common >= PERCENT * (len(a) + len(b) - common)
            yield batch.loc[keep, ["u", "v"]]
    return run


def _wide(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at, to in _slices(texts):
                sets = shingle_sets(texts[at:to], words)
                yield pd.DataFrame({"v": batch["v"].iloc[at:to].to_numpy(), "wide": wide_bits(sets), "spread": [_spread(s) for s in sets]})
    return run


def _spread(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of SPREAD ranges (255: so many or more)."""
    counts = np.bincount((own >> _U(64 - SPREAD_BITS)).astype(np.int64), minlength=1 << SPREAD_BITS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _can_be_similar(spread: np.ndarray, other: np.ndarray) -> np.ndarray:
    """False for rows of ``spread`` that share too few of their hashes with ``other`` for PERCENT, whatever the hashes are.

    Two sets have in common at most the smaller count of every range.
    """
    most = np.minimum(spread, other).sum(axis=1, dtype=np.int64)
    whole = spread.sum(axis=1, dtype=np.int64) + int(other.sum(dtype=np.int64))
    full = (spread == 255).any(axis=1) | bool((other == 255).any())
    return full | (100 * most >= PERCENT * (whole - most))


def _block_pairs(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a block of outsiders and a block of members whose signatures or wide signatures are near.

    A pair that only the signatures call near is left out if its hashes' spread proves that it isn't similar.

    A pair that shares several keys is made only in the bucket of its first one.
    """
    sigs = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, SYMBOLS)
    wide = np.frombuffer(b"".join(rows["wide"]), np.uint64).reshape(-1, WIDE_BITS // 64)
    spread = np.frombuffer(b"".join(rows["spread"]), np.uint8).reshape(-1, 1 << SPREAD_BITS)
    v, c = rows["v"].to_numpy(), rows["c_v"].to_numpy()
    here = int(np.flatnonzero(chunk_keys(sigs[:1])[0] == group[0])[0])
    members = np.flatnonzero(~rows["outsider"].to_numpy())
    out = []
    for o in np.flatnonzero(rows["outsider"].to_numpy()):
        far = np.bitwise_count(wide[members] ^ wide[o]).sum(axis=1)
        wrong = (sigs[members] != sigs[o]).sum(axis=1)
        open_ = (wrong <= NEAR_SYMBOLS) & (far > WIDE_ERRORS) & (c[members] != c[o])
        ok = (far <= WIDE_ERRORS) & (c[members] != c[o])
        if open_.any():
            ok[open_] = _can_be_similar(spread[members[open_]], spread[o])
        near = members[ok]
        if len(near):
            wrong = (sigs[near] != sigs[o]).reshape(-1, CHUNKS, CHUNK_SYMBOLS)
            errors = wrong.sum(axis=2)
            chunk = (errors <= CHUNK_ERRORS).argmax(axis=1)
            # Ways to leave out CHUNK_ERRORS symbols, in the order of the keys; the first that leaves out the errors.
            of = wrong[np.arange(len(near)), chunk]
            way = np.array([[not e[list(keep)].any() for keep in _KEEP] for e in of]).argmax(axis=1)
            near = near[chunk * len(_KEEP) + way == here]
            out.append(np.stack([np.minimum(v[near], v[o]), np.maximum(v[near], v[o])], axis=1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _large_pairs(rows: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Candidate pairs (u, v) of large open buckets: every outsider against every member of another component.

    ``rows``: key, v, c_v, top, size, inside.  The signatures are compared in blocks of BLOCK outsiders by BLOCK
    members, so a task holds two blocks however large a bucket is, and a hot bucket spreads over many tasks.
    """
    needed = written(rows.select("v").distinct(), "large-bucket-ids")
    few = needed.count() <= BROADCAST_IDS
    wide = texts.join(F.broadcast(needed) if few else needed, "v", "left_semi").mapInPandas(_wide(words), "v long, wide binary, spread binary")
    marks = written(wide.join(classes.select("v", "signature"), "v"), "wide-signatures")
    # A document's keys (one per way of its signature at most) travel as one list, so its marks join it once.
    lists = rows.groupBy("v").agg(F.collect_list(F.struct("key", "c_v", "top", "size", "inside")).alias("at"))
    rows = lists.join(marks, "v").select("v", "signature", "wide", "spread", F.explode("at").alias("at")).select(
        "v", "signature", "wide", "spread", "at.*").withColumns({"_o": F.ceil((F.col("size") - F.col("inside")) / BLOCK).cast("int"),
                                              "_m": F.ceil(F.col("size") / BLOCK).cast("int")})
    keep = ["key", "v", "c_v", "signature", "wide", "spread"]

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    members = rows.select(*keep, F.lit(False).alias("outsider"), every("_o").alias("i"),
                          F.pmod(F.xxhash64("v"), F.col("_m")).cast("int").alias("j"))
    outsiders = rows.where("c_v <> top").select(*keep, F.lit(True).alias("outsider"),
                                                F.pmod(F.xxhash64("v"), F.col("_o")).cast("int").alias("i"), every("_m").alias("j"))
    return members.unionByName(outsiders).groupBy("key", "i", "j").applyInPandas(_block_pairs, "u long, v long")


class _Links:
    """The confirmed links so far and their components."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, words: int):
        self.texts, self.sketches, self.words, self.found = texts, sketches, words, None

    def labelled(self, df: DataFrame, *cols: str) -> DataFrame:
        """``df`` with the component of each column as c_<column>."""
        for c in cols:
            if self.found is None:
                df = df.withColumn(f"c_{c}", F.col(c))
            else:
                own = self.found.select(F.col("v").alias(c), F.col("component").alias("_c"))
                df = df.join(own, c, "left").withColumn(f"c_{c}", F.coalesce("_c", c)).drop("_c")
        return df

    def add(self, pairs: DataFrame, name: str, near_pairs: DataFrame | None = None) -> None:
        """Confirm the candidate pairs (u, v) that lie in different components; ``near_pairs`` are known to be near."""
        s = self.sketches
        near = (pairs.join(s.select(F.col("v").alias("u"), F.col("sketch").alias("a")), "u")
                .join(s.select("v", F.col("sketch").alias("b")), "v")
                .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= SKETCH_ERRORS).select("u", "v"))
        if near_pairs is not None:
            near = near.unionByName(near_pairs).distinct()
        near = self.labelled(near, "u", "v").where("c_u <> c_v").select("u", "v")
        t = self.texts
        both = (near.join(t.select(F.col("v").alias("u"), F.col("text").alias("u_text")), "u")
                .join(t.select("v", F.col("text").alias("v_text")), "v"))
        links = both.mapInPandas(_confirm(self.words), "u long, v long")
        if self.found is not None:
            links = links.unionByName(self.found.select(F.col("v").alias("u"), F.col("component").alias("v")))
        self.found = components(links, name)


def text_digest(text: Column) -> Column:
    """16 bytes that name a text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id, kept and chosen of every row; ``key`` is a whole number.

    ``kept``: doc_id is its component's smallest.  ``chosen``: the row has besides the text that stands for the component, which
    makes one (doc_id, digest) a component.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    signed = written(rows.mapInPandas(_sign(words), "doc_id long, digest binary, n_shingles long, class binary, signature binary"), "signed")
    first = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(
        F.min(F.struct("doc_id", "digest")).alias("first"), F.first("signature").alias("signature"))
    first = first.select("class", "signature", F.col("first.doc_id").alias("v0"), F.col("first.digest").alias("digest0"))
    # Vertices are numbered in the order of their smallest keys.
    classes = written(global_running(first, ["v0", "class"], with_rank=True).withColumnRenamed("rank", "v"), "classes")
    keys = classes.select("v", "signature").mapInPandas(_keys, "key long, v long")
    shared = keys.groupBy("key").agg(F.min("v").alias("u"), F.max("v").alias("_max")).where("u < _max").select("key", "u")
    members = written(keys.join(written(shared, "shared-keys"), "key"), "members")

    ids = written(members.select("v").distinct().join(classes.select("v", "v0", "digest0"), "v"), "candidates")
    few = ids.count() <= BROADCAST_IDS
    own = (F.col("doc_id") == F.col("v0")) & (F.col("digest") == F.col("digest0"))
    texts = rows.join(F.broadcast(ids) if few else ids, own).where(F.col("text").isNotNull()).select("v", "text")
    texts = written(texts.dropDuplicates(["v"]), "candidate-texts", compression="zstd")
    sketches = written(classes.select("v", "signature").mapInPandas(_sketches, "v long, sketch long")
                       .join(ids, "v", "left_semi"), "sketches")
    links = _Links(texts, sketches, words)

    stars = written(members.where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")), "stars")
    best = stars.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u"))
    links.add(best.select("u", "v"), "links-best")
    links.add(stars.select("u", "v"), "links-stars")

    placed = links.labelled(members.select("key", "v"), "v")
    counts = placed.groupBy("key", "c_v").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("c_v", F.struct("n", -F.col("c_v"))).alias("top"),
                                        F.sum("n").alias("size"), F.max("n").alias("inside"),
                                        F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = written(placed.join(largest.drop("parts"), "key"), "open-buckets")
    outside = open_.where((F.col("size") <= SMALL_BUCKET) & (F.col("c_v") != F.col("top"))).select(
        "key", F.col("v").alias("u"), F.col("c_v").alias("c_u"))
    rest = open_.where(F.col("size") <= SMALL_BUCKET).join(outside, "key").where("c_u <> c_v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    large = _large_pairs(open_.where(F.col("size") > SMALL_BUCKET), classes, texts, words)
    links.add(rest.distinct(), "links-rest", large)

    # Only linked classes have another's name.
    heads = classes.select(F.col("v").alias("component"), F.col("v0").alias("head"), F.col("digest0").alias("head_digest"))
    named = classes.select("class", "v", "v0", "digest0").join(links.found.join(heads, "component"), "v", "left").select(
        "class", F.coalesce("head", "v0").alias("component_id"), F.coalesce("head_digest", "digest0").alias("_digest"))
    out = signed.drop("signature").join(named, "class", "left")
    alone = F.col("class").isNull() | F.col("doc_id").isNull()
    own = F.when(F.col("class").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(own)
    return out.select("doc_id", "digest", "n_shingles", own.alias("component_id"), kept.alias("kept"),
                      F.coalesce(alone | (kept & (F.col("digest") == F.col("_digest"))), F.lit(False)).alias("chosen"))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            sigs = np.frombuffer(b"".join(batch["signature"]), np.uint16).reshape(-1, SYMBOLS)
            yield pd.DataFrame({"v": batch["v"].to_numpy(), "sketch": sketch(sigs)})
