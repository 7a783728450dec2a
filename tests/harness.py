"""Runs a registered query and its SQL side by side and compares them as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tablesense.catalogue.schema import GIVEN


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", repr(value + 0.0))
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, decimal.Decimal):
        return ("d", str(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return ("t", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return ("s", value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got_cols, got = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; got {bad[0][0]} want {bad[0][1]}"
    return None
