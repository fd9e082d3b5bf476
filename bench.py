"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitpanel.plans.queries import QUERIES  # noqa: E402
from pitpanel.session import local_session  # noqa: E402

HEADLINE = [
    "panel_prices", "flagship_features_latest", "feat_all", "feat_target_rank", "validate_issues",
    "coverage_year", "fingerprint", "universe_monthly", "asof_financials", "asof_macro",
    "norm_feed_b", "merge_sources", "crosscheck", "fold_counts", "snapshots", "topm_ewma",
    "adaptive_selection", "ewma_cov", "shrunk_cov", "subset_gap", "backtest_equal",
    "allocate_weights", "market_metrics", "regimes", "sector_bootstrap", "rank_ic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
