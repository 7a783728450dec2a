"""Bounded SQL over published views, result shapes, saved queries and their refresh."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesense import values as V
from tablesense.functions import text as X


def register(tables: Mapping[str, DataFrame]) -> None:
    """Published tables as temporary views: the only thing a query can read."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def bounded(df: DataFrame, cap: int = V.MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(at most ``cap`` rows, one-row flag whether more exist); cap + 1 rows are read at most."""
    flag = df.limit(cap + 1).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("rows_returned"), (F.count(F.lit(1)) > cap).alias("truncated"))
    return df.limit(cap), flag


DAY = r"^\d{4}-\d{2}-\d{2}"
MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"
#: (chart, rows, columns, date columns, numeric columns, other columns), each as (least, most); the first that fits.
CHARTS = (
    ("metric", (1, 1), (1, 1), (0, None), (0, None), (0, None)),
    ("line", (0, None), (2, 2), (1, 1), (1, 1), (0, None)),
    ("pie", (2, 3), (2, 2), (0, None), (1, 1), (1, 1)),
    ("bar", (0, None), (2, 2), (0, None), (1, 1), (1, 1)),
    ("multi_line", (0, None), (3, None), (1, 1), (2, None), (0, None)),
    ("line", (0, None), (3, None), (1, 1), (1, 1), (0, None)),
    ("table", (0, None), (0, None), (0, None), (0, None), (0, None)),
)


def is_dated(text: Column) -> Column:
    """Text that opens with a day of the calendar, or is a month."""
    return (text.rlike(DAY) & F.substring(text, 1, 10).try_cast("date").isNotNull()) | text.rlike(MONTH)


def result_shape(df: DataFrame, cap: int = V.MAX_ROWS) -> dict:
    """The chart that the bounded answer suggests: metric, line, pie, bar, multi_line or table.

    A text column is a date if every value in the answer is one.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    row = df.limit(cap).agg(F.count(F.lit(1)).alias("rows"), *[
        F.min(F.coalesce(is_dated(F.col(f"`{c}`")), F.lit(False)).cast("int")).alias(f"s{i}") for i, c in enumerate(strings)]).first()
    stored = {T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "date", T.TimestampNTZType: "date"}
    kinds = {f.name: "numeric" if isinstance(f.dataType, T.NumericType) else stored.get(type(f.dataType), "text") for f in df.schema.fields}
    kinds |= {c: "date" for i, c in enumerate(strings) if row[f"s{i}"]}
    by = {k: [c for c, x in kinds.items() if x == k] for k in ("numeric", "date", "text", "boolean")}
    facts = (row["rows"], len(kinds), len(by["date"]), len(by["numeric"]), len(by["text"]) + len(by["boolean"]))
    chart = next(name for name, *spans in CHARTS if all(least <= x and (most is None or x <= most) for x, (least, most) in zip(facts, spans)))
    return {"chart": chart, "kinds": kinds, "numeric": by["numeric"], "dates": by["date"]}


def date_filtered(df: DataFrame, start: date | None, end: date | None, dates: list[str] | None = None) -> DataFrame:
    """``start`` <= date < ``end`` on the one date column; untouched when there is not exactly one."""
    if dates is None:
        dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if len(dates) != 1:
        return df
    c = F.col(f"`{dates[0]}`")
    if start is not None:
        df = df.where(c >= F.lit(start.isoformat()).cast(df.schema[dates[0]].dataType))
    if end is not None:
        df = df.where(c < F.lit(end.isoformat()).cast(df.schema[dates[0]].dataType))
    return df


def answer_saved(spark: SparkSession, saved: DataFrame, question: str, cap: int = V.MAX_ROWS) -> DataFrame | None:
    """The bounded answer of a saved query that asks the same question, if it still resolves.

    Spark analyses a statement before any job runs, so a stale one costs nothing.
    """
    same = X.normalise_question(F.col("question")) == X.normalise_question(F.lit(question))
    for row in saved.where(same).orderBy("question", "sql").toLocalIterator():
        try:
            return bounded(spark.sql(row.sql), cap)[0]
        except PySparkException:
            continue
    return None


def refresh(spark: SparkSession, saved: Mapping[str, str], start: date | None = None, end: date | None = None, cap: int = V.MAX_ROWS) -> DataFrame:
    """Every saved query on current data under one date range: (query, ok, result as JSON rows).

    A query that no longer resolves is one ``ok = false`` row and disturbs no other.
    """
    out = None
    for name, sql in saved.items():
        try:
            df = date_filtered(spark.sql(sql), start, end).limit(cap)
            part = df.select(F.lit(name).alias("query"), F.lit(True).alias("ok"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("result"))
        except PySparkException:
            part = spark.range(1).select(F.lit(name).alias("query"), F.lit(False).alias("ok"), F.lit(None).cast("string").alias("result"))
        out = part if out is None else out.unionAll(part)
    return out
