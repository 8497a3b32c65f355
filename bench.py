"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three runs.

Prints one JSON line.  Results are written to Spark's ``noop`` sink, so every
row and column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from millrace import plans, session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINES = (
    "tpch_q1", "tpch_q3", "tpch_q5", "tpch_q6", "tpch_q7", "tpch_q8", "tpch_q10", "tpch_q14", "tpch_q18", "window_rank", "window_frame_rows_offsets", "agg_cube", "agg_distinct_several",
    "join_salted", "join_range_binned", "sort_top_n", "sort_external", "set_intersect", "flatten_list", "window_tumble", "window_session",
)


def once(spark, query) -> float:
    began = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = session.build(
        f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = plans.queries(), {}
    for name in HEADLINES:
        once(spark, known[name])
        took[name] = round(statistics.median(once(spark, known[name]) for _ in range(RUNS)), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
