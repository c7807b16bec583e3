"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidebook.plans import load_all
from tidebook.plans.registry import QUERIES
from tidebook.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))

# name → what its time covers
HEADLINE = (
    "read_ticks",  # JSON lines to silver (files written beforehand)
    "flagship_oscillation",
    "tick_features",
    "tick_quality",
    "window_gates",
    "window_finalize",
    "excursion_stats",
    "window_outcomes",  # one replay configuration over every window
    "fill_timeline",
    "run_sweep",  # the 24-configuration grid over every window, with metrics
    "nearest_reference",
    "recon_report",
    "shock_reaction",
    "prints_at_price_since",
    "asof_backward",
    "stratified_cut",
    "file_verify",
    "window_close",  # streaming
)
# these read the written outcome table, so they run after it exists
ON_OUTCOMES = ("replay_rollup", "max_drawdown", "bootstrap_ci", "permutation_null")


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    from tidebook.plans.bronze import bronze_path
    from tidebook.plans.outcomes import base_outcomes
    from tidebook.plans.results import GRID, sweep_outcomes

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("capture_stats")  # JVM warm-up
    start = time.perf_counter()
    bronze_path(spark, SF_DIR)
    times = {"write_bronze": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        times[name] = run(name)
    base_outcomes(spark, SF_DIR)
    sweep_outcomes(spark, SF_DIR)
    for name in ON_OUTCOMES:
        times[name] = run(name)

    ticks = QUERIES["capture_stats"](spark, SF_DIR).groupBy().sum("lines").first()[0]
    windows = base_outcomes(spark, SF_DIR).count()
    rates = {
        "ingest_rows_per_sec": round(ticks / times["read_ticks"]),
        "replay_ticks_per_sec": round(ticks / times["window_outcomes"]),
        "replay_windows_per_sec": round(windows / times["window_outcomes"], 1),
        "sweep_window_evals_per_sec": round(windows * len(GRID) / times["run_sweep"], 1),
        "sweep_tick_evals_per_sec": round(ticks * len(GRID) / times["run_sweep"]),
    }
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates, "ticks": ticks, "windows": windows, "configs": len(GRID), "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
