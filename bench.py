"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "bars_daily", "core_features", "cross_features", "full_features", "cross_sectional_label", "tail_statistics",
    "first_touch_exits", "non_overlapping_positions", "equity_curve", "trade_statistics", "weekly_momentum_portfolio",
    "forecast_paths", "regression_agreement", "path_stability_and_chaos", "market_regime", "financial_confidence",
    "decision_bundle", "trade_tiers", "market_scanner", "classification_metrics", "robust_scaling", "sentiment_scores",
    "daily_sentiment", "experiment_grid",
]


def main() -> None:
    from tidebar.plans.catalog import QUERIES
    from tidebar.session import build_session, scoped_tables

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", cpus)
    times = {}
    for name in HEADLINE:
        seen = []
        for _ in range(runs):
            start = time.perf_counter()
            with scoped_tables(spark):
                QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
                seen.append(time.perf_counter() - start)
        times[name] = round(min(seen), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "median": round(statistics.median(times.values()), 3)}))


if __name__ == "__main__":
    main()
