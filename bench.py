"""Headline queries at one scale; prints a single JSON line.

Layers (raw, clean, warehouse, rollup, features) are built once and timed under their own
names; the other queries read the stored layers, as the jobs do.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "c8_clean_oil", "w6_dim_store_date", "w8_w9_fact_daily_sales", "q18_warehouse_reconciliation",
    "q25_q26_classified_checks", "v1_daily_store_performance", "v2_family_performance", "v3_store_performance",
    "v4_holiday_performance", "v5_seasonality", "a1_daily_summary", "a8_to_a13_store_performance",
    "a17_a18_a19_family_performance", "a23_sales_histogram", "p2_p3_dimension_summary", "p5_p6_p7_matched_analysis",
    "h3_h4_h5_h6_holiday_frame", "h7_category_summary", "t2_t3_outliers_and_trend", "t5_monthly_driver",
    "n5_n6_sales_anomalies", "r2_forecast_readiness", "d1_d2_volume_over_time", "f19_causal_training_frame",
    "m2_m3_m4_m14_baseline_scores", "i8_intermittent_scores", "u12_interval_segments", "g3_g4_g5_recursive_steps",
    "g1_g2_g6_global_backtest",
]
LAYERS = ["raw", "clean", "warehouse", "rollup", "training_frame"]


def main() -> None:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from shelfcast.plans import all_queries
    from shelfcast.plans.registry import runner
    from shelfcast.plans.workspace import Workspace
    from shelfcast.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times: dict[str, float] = {}
    space = Workspace.of(spark, folder)
    for layer in LAYERS:
        start = time.perf_counter()
        getattr(space, layer)()
        times[f"layer_{layer}"] = round(time.perf_counter() - start, 3)
    registered = all_queries()
    for name in HEADLINE:
        start = time.perf_counter()
        runner(registered[name])(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
