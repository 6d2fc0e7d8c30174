"""Compare a Spark result with the result of the same query in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _rows(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    columns = [
        [None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in column.to_pylist()]
        for column in table.columns
    ]
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in zip(*columns, strict=True)]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def _kind(field: pa.Field) -> str:
    if pa.types.is_floating(field.type):
        return "double"
    return str(field.type).replace("large_", "").replace("string_view", "string")


def differences(spark_result: pa.Table, oracle_result: pa.Table) -> list[str]:
    """Messages about differing schema, row count or values; empty if equal."""
    mine, theirs = ({f.name: _kind(f) for f in t.schema} for t in (spark_result, oracle_result))
    found = []
    if mine != theirs:
        found.append(f"schema: {sorted(set(mine.items()) ^ set(theirs.items()))}")
    if sorted(mine) != sorted(theirs):
        return found
    left, right = _rows(spark_result), _rows(oracle_result)
    if len(left) != len(right):
        found.append(f"rows: {len(left)} and {len(right)}")
    unequal = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first: {unequal[0]}")
    return found
