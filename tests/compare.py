"""Runs registered queries against their SQL in DuckDB and lists differences.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=_key)


def difference(name: str, spark, con, sf_dir: str, result=None) -> tuple[str | None, int]:
    """What differs between the query and its SQL (None when equal), and the number of rows."""
    result = result or entry.queries()[name](spark, sf_dir)
    columns, got = _rows(result.columns, result.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    cursor = con.execute(sql)
    expected_columns, expected = _rows([c[0] for c in cursor.description], cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}", len(got)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}", len(got)
    bad = [(a, b) for a, b in zip(got, expected) if not _same(a, b)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {columns}: {bad[0][0]} != {bad[0][1]}", len(got)
    types = {
        c: (sorted(ts), sorted(us))
        for i, c in enumerate(columns)
        for ts, us in [({_kind(r[i]) for r in got} - {"none"}, {_kind(r[i]) for r in expected} - {"none"})]
        if ts != us
    }
    return (f"types differ: {types}" if types else None), len(got)


def _kind(v):
    return "none" if v is None else type(v).__name__


def _same(a, b):
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
        for x, y in zip(a, b)
    )


def main() -> int:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in args.names or entry.queries():
        start = time.time()
        try:
            problem, rows = difference(name, spark, con, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem, rows = f"{type(e).__name__}: {str(e)[:1500]}", 0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {rows:8d} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
