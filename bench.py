"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with a no-op write (every row computed, nothing
collected to the driver). Learners use <= 10 trees and 3 folds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans.registry import QUERIES  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "feature_matrix",      # B1-B13 + quintile edges + exact medians
    "stratified_folds",    # E2, distributed row number
    "pct_rank",            # E1, distributed percent rank
    "roc_auc_by_fold",     # D11/I1, exact AUC per fold
    "meta_features",       # C1 + H7: 3-way score join, logits, ranks
    "stack_fit_bayes",     # H8: grouped Gram pass + Bayesian ridge
    "stack_fit_logreg",    # H8: Newton steps of all fold models together
    "validate_submission", # L1: key contract via one full outer join
    "cross_fit_gbt",       # H1/H2: GBT 10 trees x 3 folds, OOF and test scores
    "drift_auc_in_sample", # H10: one GBT 10 trees depth 5 on all 150k rows (sizing probe)
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, app_name="riskloom-bench")
    # warm-up on the smallest tables (JVM JIT, codegen caches); not timed
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in ("feature_matrix", "roc_auc_by_fold", "meta_features", "cross_fit_gbt"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()              # nothing of one query helps the next
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
