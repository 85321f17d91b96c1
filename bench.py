"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "s3_daily_bars", "s4_aligned_panel", "q1_quality_report", "q2_return_summary", "r4_close_to_close_vol",
    "r10_ewm_variance", "r12_base_features", "r18_sequences", "t2_atr", "t6_macd", "m4_rolling_shape",
    "m7_rolling_correlation", "m14_ewma_beta", "m19_spillover_features", "i3_realised_kernel", "i6_lee_mykland",
    "i10_estimator_comparison", "i13_moment_features", "x1_adf", "x2_ljung_box", "x7_all_model_pairs", "x14_granger",
    "x16_rolling_granger", "f1_ridge_predictions", "f3_har_variants", "f5_spillover_forecast", "f6_walk_forward",
    "f9_periodic_retrain", "f10_bootstrap_intervals", "f21_combination_summary", "f23_mutual_information",
    "f25_recursive_elimination", "f31_garch_scan", "k1_rolling_covariance", "k7_dcc_choice",
    "k13_portfolio_var_backtest", "v5_fevd", "v8_rolling_connectedness", "e7_metrics_by_regime",
    "e14_pipeline_summary", "d3_drift_scan", "d10_monitor_log", "d12_online_ewma_ridge", "d16_event_time_bars",
    "n1_daily_sentiment",
)


def main() -> None:
    from barograph.plans import load
    from barograph.plans.session import local_session

    spark = local_session(CPUS)
    queries = load()
    queries["q2_return_summary"].run(spark, SF_DIR).count()  # start the JVM paths once
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
