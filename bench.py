"""Time the headline queries: one JSON line with seconds per query.

`BENCH_SF_DIR` names the tables (default sf0.1), `BENCH_CPUS` the local cores,
`BENCH_QUERIES` a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sieveline.plans import QUERIES  # noqa: E402
from sieveline.session import local_session  # noqa: E402

HEADLINE = (
    "harmonize_a",
    "harmonize_b",
    "group_folds",
    "train_test_split",
    "column_profile",
    "physical_screen_summary",
    "iqr_fences",
    "preprocess_stages",
    "screened_split_metrics",
    "spearman_matrix",
    "prf_metrics",
    "average_precision",
    "threshold_tuning",
    "evaluation_grid",
    "permutation_importance",
    "linear_attribution",
    "knn_exact",
    "validate_rows",
    "logreg_scores",
    "rf_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle=int(cpus) if cpus.isdigit() else 8, app="bench")
    # the first query of a session pays for starting the JVM's compilers and Python workers
    QUERIES["harmonize_b"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
