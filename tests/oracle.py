"""Run bound queries against DuckDB on the same Parquet tables.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return value + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(made, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark_frame, connection, sql: str) -> str | None:
    """None if both sides agree, else the first difference."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    left = rows_of(spark_frame.columns, spark_frame.collect())
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(names)}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    if not left:
        return "no rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {sorted(names)} {bad[0]}"
    types = [(type(a), type(b)) for a, b in zip(left[0], right[0]) if a is not None and b is not None]
    odd = [pair for pair in types if pair[0] is not pair[1]]
    return f"types differ: {odd}" if odd else None


def main() -> int:
    import __spark_entry__ as entry
    from tidepanel.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    connection = duck(folder)
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracle:
                fault = compare(frame, connection, oracle[name])
                note = "ok" if fault is None else f"FAIL {fault}"
            else:
                fault, note = None, f"rows {frame.count()}"
        except Exception as error:  # report and go on
            fault, note = error, f"ERROR {str(error)[:1500]}"
        failed += fault is not None
        print(f"{time.time() - started:6.2f}s {name}: {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
