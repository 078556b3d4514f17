import random
import re

import numpy as np

from tagsift.llm import neardup
from tagsift.llm.queries_text import op2_near_dedup
from tests.conftest import SMALL


def plain_set(text, size=2):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(rows, size=2):
    """doc_id -> (set size, smallest reachable), every pair compared."""
    sets = {k: plain_set(t, size) for k, t in rows}
    near = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for k in sorted(sets):
        if k not in out:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = k
                    todo += near[x]
    return {k: (len(sets[k]), out[k]) for k in sets}


def check(out, rows, size=2):
    want = plain_components(rows, size)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = op2_near_dedup(spark, SMALL).collect()
    assert len(out) == len(docs)
    check(out, docs)


def test_chains_groups_and_cases(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    rows, k = [], 100
    passage = rng.choices(vocab, k=60)
    for base in range(12):
        words = rng.choices(vocab, k=80)
        for _ in range(12):                      # a drifting chain: neighbours are near, ends are not
            rows.append((k, " ".join(words)))
            k += 1
            words = list(words)
            for _ in range(rng.choice([1, 3, 5])):
                words[rng.randrange(80)] = rng.choice(vocab)
    rows += [(k + i, " ".join(passage + rng.choices(vocab, k=40))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, "É x"), (9, "é x"),
             (10, "a b " * 40_000), (11, "a b " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 0) for r in [*rows, (4, "One"), (None, "one")]], "doc_id long, text string, kept int")
    for size in (5, 2):
        out = neardup.near_duplicates(df, words=size).collect()
        assert len(out) == len(rows) + 2
        check(out, rows, size)
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_every_pair_under_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    most = neardup.CHUNKS * (neardup.CHUNK_ERRORS + 1) - 1
    a = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        places = rng.choice(neardup.SYMBOLS, most, replace=False)
        row[places] ^= rng.integers(1, 1 << 16, most).astype(np.uint16)
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    base, rows = rng.choices(vocab, k=120), []
    for k in range(80):                          # copies of one text, edited from lightly to too much
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(120)] = rng.choice(vocab)
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(neardup.near_duplicates(df, words=2).collect(), rows)


def test_blocks_take_every_pair_under_the_distance():
    import pandas as pd
    rng = np.random.default_rng(4)
    most = neardup.NEAR_SYMBOLS
    a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
    sigs = np.tile(a, (41, 1))
    for n, row in enumerate(sigs[1:], 1):        # differing in 11 to 30 symbols, never in the first chunk
        places = rng.choice(np.arange(neardup.CHUNK_SYMBOLS, neardup.SYMBOLS), 11 + n % 20, replace=False)
        row[places] ^= rng.integers(1, 1 << 16, len(places)).astype(np.uint16)
    key = int(neardup.chunk_keys(sigs[:1])[0][0])
    # Wide signatures as far apart as can be: they alone would drop every pair.
    rows = pd.DataFrame({"key": key, "v": range(41), "c_v": range(41), "signature": [s.tobytes() for s in sigs],
                         "wide": [b"\x00" * 256] + [b"\xff" * 256] * 40, "spread": [b"\x03" * 512] * 41, "outsider": False})
    both = pd.concat([rows, rows[:1].assign(outsider=True)], ignore_index=True)
    got = neardup._block_pairs((key, 0, 0), both)
    want = {n for n in range(1, 41) if 11 + n % 20 <= most}
    assert set(got.v) == want and len(got) == len(want) and {23, 24} & {11 + n % 20 for n in want} == {23}


def test_one_key_at_several_texts(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(f"{x}{rng.randrange(9)}{i}" for i in range(80)) for x in "abc")
    near_a = a.replace(" a", " q", 1)
    rows = [(0, a), (1, near_a), (1, b), (2, c), (2, c), (2, c + " more"), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (5, 2):
        got = {(r.doc_id, bytes(r.digest)): (r.component_id, r.chosen) for r in neardup.near_duplicates(df, words=size).collect()}
        import hashlib
        at = lambda k, t: got[k, hashlib.md5(t.encode()).digest()]
        assert at(0, a) == (0, True) and at(1, near_a) == (0, False) and at(1, b) == (1, True) and at(3, b) == (1, False)
        assert at(2, c)[0] == at(2, c + " more")[0] == 2 and at(2, c)[1] != at(2, c + " more")[1]


def test_spread_never_drops_a_similar_pair():
    rng = np.random.default_rng(9)
    for n in (1, 5, 100, 3000, 200_000):
        for share in (0.0, 0.5, 0.7, 0.78, 0.8, 0.85, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            b[:int(len(b) * (1 - share) / (1 + share))] += np.uint64(1)
            rows = np.stack([np.frombuffer(neardup._spread(x), np.uint8) for x in (a, b)])
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert neardup._can_be_similar(rows[:1], rows[1])[0]
    far = np.stack([np.frombuffer(neardup._spread(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)), np.uint8) for _ in range(2)])
    assert not neardup._can_be_similar(far[:1], far[1])[0]
