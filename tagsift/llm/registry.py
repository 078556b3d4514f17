"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tagsift.llm import (queries_basic, queries_bench, queries_chat, queries_rules, queries_runs, queries_text, queries_tokens,
                         queries_toxicity)

_MODULES = (queries_basic, queries_bench, queries_chat, queries_rules, queries_runs, queries_text, queries_tokens,
            queries_toxicity)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
