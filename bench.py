"""Wall time of the headline queries: one warm-up, then the median of BENCH_REPEATS (2) runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fraudspark.plans import QUERIES
from fraudspark.session import local_session

HEADLINE = [
    "score_transactions", "velocity_window", "rolling_velocity", "realtime_score", "cep_small_to_large", "cep_round_trip",
    "cep_burst", "cep_duplicates", "rule_match", "rule_multi_match", "rescore_rules", "backtest_rule", "screen_names",
    "screen_entities", "ip_signals", "enrich_transaction", "device_risk", "graph_features", "fund_flow", "communities",
    "khop_network", "psi_report", "anomaly_percentile", "reason_codes", "feedback_precision", "entity_summary",
    "debug_transaction", "sar_package", "sink_upsert", "latest_score",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
