"""Benchmark: prints one JSON line with the wall seconds of each headline query.

BENCH_SF_DIR and BENCH_CPUS choose the data and the local cores; BENCH_QUERIES may name
other queries (comma separated, or 'all').
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import QUERIES
from tidemark.session import build_session

HEADLINE = (
    "top_10", "top_10_year", "top_02", "top_18", "kpi_10", "kpi_12", "kpi_13", "act_08",
    "act_14", "act_14_week", "ev_05", "ev_06", "ml_15", "ml_16", "doc_07", "doc_13", "txt_01",
    "txt_14", "dq_04", "dq_07", "dq_18_splits", "sel_03", "sel_05", "sel_17", "sel_20", "sel_26",
    "ml_01", "ml_02", "ml_13", "src_12", "cx_10", "str_01", "str_02", "str_05",
)


def timed(spark, name: str, root: str) -> float:
    """Seconds to plan the query and compute every row and column of its result."""
    start = time.perf_counter()
    QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/orders.parquet").groupBy("o_orderstatus").count().collect()
    took = {}
    for name in names:
        took[name] = round(timed(spark, name, root), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": root.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
