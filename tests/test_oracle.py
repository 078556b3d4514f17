"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

from tagsift.operators.evidence import CLASSES
from tagsift.plans import all_oracles, all_queries
from tests.conftest import SMALL
from tests.oracle_compare import compare_one

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    info = compare_one(spark, duck, name, QUERIES[name], ORACLES[name], SMALL)
    assert info["ok"], info


def _classifier_scores(rows):
    for r in rows:
        p = r["probs"]
        assert set(p) == set(CLASSES) and abs(sum(p.values()) - 1) < 1e-9 and all(0 <= x <= 1 for x in p.values())
        assert p[r["p_type"]] == max(p.values())
    keys = [(r["doc_id"], r["ann_ids"]) for r in rows]
    assert len(keys) == len(set(keys))


def _classifier_grid(rows):
    assert len(rows) == 8 and all(0.0 <= r["accuracy"] <= 1.0 for r in rows)
    by_rep = [{(r["reg_param"], r["max_iter"]): r["accuracy"] for r in rows if r["repetition"] == k} for k in (0, 1)]
    assert set(by_rep[0]) == set(by_rep[1]) and by_rep[0] != by_rep[1]


def _classifier_chain(rows):
    assert all(r["log_prob"] <= 1e-12 and r["count"] >= 1 for r in rows)
    keys = [(r["doc_id"], r["name"], r["type"]) for r in rows]
    assert len(keys) == len(set(keys))


def _pretrain(rows):
    assert all(len(r["tokens"]) <= 128 and 1 <= len(r["masked_lm_positions"]) <= 20 for r in rows)
    assert {r["dupe"] for r in rows} == set(range(1, 11))


def _feed(rows):
    batches = {}
    for r in rows:
        batches[r["batch"]] = batches.get(r["batch"], 0) + 1
    assert set(batches.values()) == {32} and sorted(batches) == list(range(len(batches)))


INVARIANTS = {"classifier_scores": _classifier_scores, "classifier_grid": _classifier_grid,
              "classifier_chain_evidence": _classifier_chain,
              "pretrain_instances": _pretrain, "training_feed": _feed}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_invariants_without_oracle(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows
    INVARIANTS[name](rows)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
