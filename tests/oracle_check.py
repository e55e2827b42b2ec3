"""Runs every registered query next to its SQL oracle and compares all values.

    python -m tests.oracle_check /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.isoformat()
    return value if isinstance(value, int) else float(value)


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = sorted_rows(names, expected.fetchall())
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    differing = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(differing)} of {len(want)} rows differ: {differing[:3]}" if differing else None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from flowsieve.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                problem, kind = compare(df, con, oracles[name]), "equal"
            else:
                problem, kind = None, f"{df.count()} rows, no oracle"
        except Exception as error:  # noqa: BLE001 - report every query
            problem, kind = str(error)[:1500], ""
        bad += problem is not None
        print(f"{name:26s} {time.time() - start:6.2f}s  {'DIFFERS ' + problem if problem else kind}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
