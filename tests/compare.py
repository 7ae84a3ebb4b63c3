"""Compare registered queries with their SQL on DuckDB: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in records)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def difference(spark, sf, connection, run, sql):
    """None when equal, else a short description."""
    columns, got = spark_rows(run(spark, sf))
    if sql is None:
        return None if got else "no rows"
    expected_columns, expected = sql_rows(connection, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(got) != len(expected):
        extra = list(set(got) - set(expected))[:3]
        missing = list(set(expected) - set(got))[:3]
        return f"{len(got)} rows != {len(expected)}; extra {extra}; missing {missing}"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(wrong)} rows differ, first {wrong[:3]}" if wrong else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from varloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:] or list(queries())
    connection = oracle(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, sf, connection, queries()[name], oracle_sql().get(name))
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        note = "" if name in oracle_sql() else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name}{note} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
