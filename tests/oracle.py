"""Run a registered query and its DuckDB twin on one folder and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb
import pyarrow as pa


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("dec", float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(data_type: pa.DataType) -> str:
    text = str(data_type)
    if text.startswith("timestamp"):
        return "timestamp"
    return {"large_string": "string", "string_view": "string", "large_binary": "binary"}.get(text, text)


def rows_of(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    schema = [(n, kind(table.schema.field(n).type)) for n in names]
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return schema, sorted(zip(*columns), key=repr) if columns else []


def compare(spark_df, con, sql: str) -> str | None:
    """None when schema and rows agree, else a description of the first difference."""
    got_schema, got = rows_of(spark_df.toArrow())
    want_schema, want = rows_of(con.execute(sql).to_arrow_table())
    if got_schema != want_schema:
        pairs = [(a, b) for a, b in zip(got_schema, want_schema) if a != b]
        return f"schema: {pairs or (got_schema, want_schema)}"
    if len(got) != len(want):
        return f"rows: {len(got)} != {len(want)}; {got[:2]} | {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"values: {str(a)[:600]} | {str(b)[:600]}"
    return None if got else "empty result"
