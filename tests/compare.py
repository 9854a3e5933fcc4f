"""Compare a Spark result with DuckDB's, column by column and row by row, in any order."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and all values agree."""
    relation = con.sql(sql)
    ours, theirs = list(spark_df.columns), list(relation.columns)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    found = []
    kinds = dict(zip(theirs, map(str, relation.types)))
    for name, kind in spark_df.dtypes:
        if SAME_TYPE.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    left = _rows(ours, [tuple(r) for r in spark_df.collect()])
    right = _rows(theirs, relation.fetchall())
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
