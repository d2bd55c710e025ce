"""Run queries next to their SQL twins: python -m checks.compare [sf] [name prefix ...]."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from checks import ORACLES, QUERIES
from tidemark.session import build_session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        out = []
        for v in row:
            if hasattr(v, "item"):
                v = v.item()
            if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
                v = None
            out.append((kind(v), repr(v)))
        rows.append(tuple(out))
    return sorted(rows)


def connect(root: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{root}/{name}.parquet'")
    return db


def check(spark, db, root: str, name: str) -> str:
    start = time.time()
    got = QUERIES[name](spark, root).toPandas()
    took = time.time() - start
    if name not in ORACLES:
        return f"rows {len(got):7d}  {took:6.2f}s"
    start = time.time()
    want = db.execute(ORACLES[name]).df()
    sql = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(set(got.columns) ^ set(want.columns))}"
    a, b = normal(got), normal(want)
    if a != b:
        seen_a, seen_b = set(a), set(b)
        only_a = [r for r in a if r not in seen_b][:2]
        only_b = [r for r in b if r not in seen_a][:2]
        cols = sorted(got.columns)
        lines = [f"DIFF spark {len(a)} sql {len(b)}"]
        for x, y in zip(only_a, only_b):
            lines += [f"    {c}: spark {p} sql {q}" for c, p, q in zip(cols, x, y) if p != q]
        if not (only_a and only_b):
            lines.append(f"    spark only {only_a} sql only {only_b}"[:600])
        return "\n".join(lines)
    return f"ok {len(a):7d}  {took:6.2f}s  (sql {sql:.2f}s)"


def main(args: list[str]) -> int:
    sf = args[0] if args else "0.01"
    root = f"/root/testdata/sf{sf}"
    prefixes = tuple(args[1:])
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(root), 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            result = check(spark, db, root, name)
        except Exception as error:  # noqa: BLE001
            result = "ERROR " + "".join(traceback.format_exception_only(error))[:900]
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:18s} {result}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
