import random

import pytest

from tagsift.llm import substrings


def plain(rows, size):
    first = {}
    for key, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - size + 1):
            win = tuple(words[i:i + size])
            first[win] = min(first.get(win, 1 << 62), 1 << 62 if key is None else key)
    out = []
    for key, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i:i + size])] < (1 << 62 if key is None else key):
                gone |= set(range(i, i + size))
        out.append((key, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_chars, range_slots", [(4_000_000, 2_000_000), (700, 300)])
def test_against_plain_grouping(spark, monkeypatch, block_chars, range_slots):
    # Small blocks and ranges take every path that large inputs take; tasks see the patched values by closure.
    monkeypatch.setattr(substrings, "RANGE_SLOTS", range_slots)
    rng = random.Random(block_chars)
    vocab = ["a", "B", "c,", "é", "dd", "e\x0b", " x"]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(3, 40))) for _ in range(20)]
    rows = []
    for key in range(150):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 25))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((key, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, None), (502, ""), (503, "short"), (None, rows[4][1]),
             (None, passages[0] + " " + passages[0]), (504, "z " * 30_000), (505, "z " * 20)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    real = substrings._blocks
    source = (lambda batches: _small_blocks(real, batches, block_chars))
    monkeypatch.setattr(substrings, "_blocks", source)
    out = substrings.remove_repeats(df, size=5).collect()
    assert sorted([tuple(r) for r in out], key=repr) == plain(rows, 5)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def _small_blocks(real, batches, chars):
    from tagsift.llm import substrings as s
    s.BLOCK_CHARS = chars
    return real(batches)


def test_packed_integers():
    import numpy as np
    for values in ([], [0], [5, 2**64 - 1, 7], list(range(1000))):
        x = np.array(values, np.uint64)
        assert (substrings._unpack(substrings._pack(x)) == x).all()
