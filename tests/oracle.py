"""Compare a registered query with its SQL twin."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _kind(value):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((_kind(v), _cell(v)) if v is not None else None for v in (row[i] for i in order)) for row in rows)


def difference(frame, con, sql: str) -> str | None:
    """None when the two results hold the same rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = bag(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    got = bag(frame.columns, [tuple(r) for r in frame.collect()])
    if not got:
        return "no rows"
    if got == wanted:
        return None
    only_spark, only_sql = got - wanted, wanted - got
    return (
        f"{sum(got.values())} rows, SQL {sum(wanted.values())}; "
        f"only Spark {sum(only_spark.values())}: {list(only_spark)[:2]}; "
        f"only SQL {sum(only_sql.values())}: {list(only_sql)[:2]}"
    )
