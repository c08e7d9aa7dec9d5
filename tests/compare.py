"""Run queries and their SQL counterparts side by side.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def duckdb_on(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(con, df, sql: str | None) -> str:
    """Empty text if both sides agree, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    if got == want:
        return "" if got else "no rows"
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows against {sum(want.values())}, {sum(extra.values())} differ\n"
        f"    spark {list(extra)[:2]}\n    sql   {list(missing)[:2]}"
    )


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from listingloom import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duckdb_on(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.perf_counter()
        try:
            problem = compare(con, fn(spark, folder), sqls.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.perf_counter() - start:.2f}s {problem}", flush=True)
    print(f"{bad} failed", flush=True)
