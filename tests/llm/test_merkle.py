import hashlib
import string
import zlib

import pytest
from pyspark.sql import functions as F

from tagsift.llm import merkle
from tagsift.llm.merkle import manifest
from tagsift.llm.queries_runs import op13_merkle_manifest

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h("".join(x[i:i + 16])) for i in range(0, len(x), 16)])
    return levels


def path(levels, i):
    out = []
    for x in levels[:-1]:
        s = i // 16 * 16
        out.append(("".join(x[s:i]), "".join(x[i + 1:s + 16])))
        i //= 16
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted(groups[s], key=lambda x: x[:3]) for s in names}
    trees = {s: tree([x[2] for x in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(groups[s]):
            steps, base = path(trees[s], i) + path(top, k), own
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                own = leaf({**r, "text": r["text"].translate(LOWER)})
            version = [own]
            for a, b in steps:
                version.append(h(a + version[-1] + b))
            yield (r["doc_id"], base, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), version[-1],
                   version[-1] == top[-1][0])


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("height", [3, 2, 1])
def test_query_against_plain(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** height)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = by_text(op13_merkle_manifest(spark, SF).collect())
    assert got == by_text(plain(rows))
    assert any(not r[-1] for r in got)


def build(df):
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest(df, "source", "doc_id", list(COLUMNS), F.crc32(F.col("doc_id").cast("string")) % 5 == 0, {"text": lower})


@pytest.mark.parametrize("height", [2, 1])
def test_cases(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** height)
    rows = [(i, "Text %d É" % i if i % 3 else None, None if i % 4 else "en", "hot" if i % 2 else None, None, "r") for i in range(700)]
    rows += [(7, "Text 7", "en", "hot", 5, "r")] * 20 + [(None, "X", "en", "lone", 1, "r"), (9, "", "", "", 0, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    leaves, nodes = build(df)
    got = leaves.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("siblings")), "folded_root",
                        F.col("folded_root") == F.col("root")).collect()
    assert by_text(got) == by_text(plain([r.asDict() for r in df.collect()]))
    empty, none = build(df.limit(0))
    assert empty.collect() == [] and none.collect() == []


def test_versions_share_nodes(spark):
    rows = [(i, "Text %d" % i, "en", "s%d" % (i % 3), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves, nodes = build(df)
    base = {r.digest for r in nodes.collect()}
    for r in leaves.collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert (r.version is not None) == changed and r.leaf in base and r.root in base and r.subroot in base
        if changed:                              # the leaf and its ancestors are new, one a level, the siblings shared
            assert len(r.version) == len(r.siblings) + 1 == 5 and not set(r.version) & base
            assert r.version[-1] == r.folded_root != r.root
            for s in r.siblings:
                both = s.left + s.right
                assert all(both[i:i + 64] in base for i in range(0, len(both), 64))
