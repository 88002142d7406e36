"""Run registered queries next to their SQL and compare rows, names and kinds of types."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, Decimal):
        return f"decimal {value}"
    return value


def kinds(row):
    return [type(v).__name__ for v in row]


def compare(frame, connection, sql: str) -> str | None:
    """``None`` when both agree, else what differs."""
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    wanted = relation.fetchall()
    got = [tuple(r) for r in frame.collect()]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    order = [names.index(c) for c in frame.columns]
    left = Counter(tuple(plain(v) for v in r) for r in got)
    right = Counter(tuple(plain(r[i]) for i in order) for r in wanted)
    left_types = {i: {type(r[i]).__name__ for r in left if r[i] is not None} for i in range(len(names))}
    right_types = {i: {type(r[i]).__name__ for r in right if r[i] is not None} for i in range(len(names))}
    if left_types != right_types:
        return f"types {left_types} != {right_types}"
    if left != right:
        return (
            f"rows {len(got)} vs {len(wanted)}; only spark {list((left - right).items())[:3]}; "
            f"only sql {list((right - left).items())[:3]}"
        )
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from framescope.session import build_session

    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "oracle", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = contract.oracle_sql()
    only = sys.argv[1:]
    failed = 0
    for name, build in contract.queries().items():
        if name not in oracles or only and name not in only:
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            problem = compare(frame, connection, oracles[name])
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
