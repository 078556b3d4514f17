"""Registered composite queries: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracles."""

from __future__ import annotations

import importlib

_MODULES = ("lists", "corpus", "context", "metrics", "features", "textstats", "qa", "passages", "streaming", "pretrain", "model", "files", "textio")


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"tagsift.plans.{m}")
        for k, v in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query name {k}")
            queries[k] = v
        oracle.update(mod.ORACLE)
    missing = set(oracle) - set(queries)
    if missing:
        raise ValueError(f"oracle without query: {sorted(missing)}")
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
