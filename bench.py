"""Benchmark: run the headline composite queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).  Each query is forced
to completion with the ``noop`` sink (full execution, nothing collected), so
the time is Spark's, not the driver's conversion of the result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "local_evidence", "global_candidates", "local_block", "local_allow", "auto_local",
    "applied_mentions", "documents_table", "database_matches", "species_matches",
    "contexts_w100", "eval_report", "pr_curve", "chunk_eval", "run_summary", "latency_summary",
    "word_frequencies", "wordpiece_tokens", "span_features", "qa_nbest",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tagsift.plans import all_queries
    from tagsift.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    qs = all_queries()
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else [n for n in HEADLINE if n in qs]
    times, errors = {}, {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # keep going; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
