"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "verdict_counts", "decide_releases", "extract_features", "batch_score_heuristic", "attach_labels",
    "merge_corpora", "source_match", "diff_trees", "line_counts", "pair_manifest", "top_files",
    "assemble_text_signal", "pack_budget_full", "stratified_split", "kfold", "length_stats", "tree_fingerprint",
    "auroc", "average_precision", "calibration", "evaluation_report", "osv_to_cases", "project_npm",
    "unify_releases", "fold_state", "plan_eviction", "gate_inventory", "parse_responses", "to_sft",
)


def main() -> None:
    from checks import all_checks
    from pkgrisk.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    chosen = sys.argv[1:] or HEADLINE
    took = {}
    for name in chosen:
        runs = []
        for _ in range(2):  # the first run also compiles; the better one is reported
            t0 = time.perf_counter()
            all_checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        took[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
