"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated ids) choose data, cores and queries.
Every query is run in full by writing its rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hearken.plans.catalog import QUERIES  # noqa: E402
from hearken.session import build_session  # noqa: E402

HEADLINE = (
    "pain_point_ranking dedup_first agg_word_freq tfidf agg_top_terms painpoint_table agg_axis_yield "
    "agg_app_summary agg_monthly_trend identifier_scan content_hash encode_survey impute_median "
    "standardize tvd agg_fidelity topk_painpoints run_drift gate_ranges gate_reconcile profile_violations "
    "routine_commands chunk_split size_report crosswalk_report residue_audit change_events replay_guard "
    "command_atomic_reject frame_reassembly"
).split()


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    times = {}
    for name in names:
        times[name] = round(run(spark, name, folder), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
