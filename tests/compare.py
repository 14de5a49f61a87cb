"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import math

import duckdb

from numberboard.sources.fixtures import TEST_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TEST_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


_KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def spark_rows(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def spark_types(df):
    return {name: _KINDS.get(kind, kind) for name, kind in df.dtypes}


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [item[0] for item in cursor.description]
    types = {item[0]: str(item[1]) for item in cursor.description}
    columns, rows = canonical(columns, cursor.fetchall())
    return columns, rows, types


def differences(df, con, sql) -> str | None:
    """None if both sides agree in columns, types and rows, else a short description."""
    columns, rows = spark_rows(df)
    duck_columns, duck, types = duck_rows(con, sql)
    if columns != duck_columns:
        return f"columns {columns} != {duck_columns}"
    if spark_types(df) != types:
        wrong = {k: (v, types[k]) for k, v in spark_types(df).items() if v != types[k]}
        return f"types {wrong}"
    if len(rows) != len(duck):
        return f"{len(rows)} rows != {len(duck)}"
    for left, right in zip(rows, duck):
        if left != right:
            return f"{left} != {right}"
    return None
