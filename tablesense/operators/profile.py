"""Column statistics and distributions, from value counts and narrow aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablesense import values as V
from tablesense.functions import text as X
from tablesense.operators.ranks import exact_medians, medians_of_counts, summary
from tablesense.operators.value_counts import ColumnRef, column_catalogue, column_refs, value_counts
from tablesense.session import as_catalogue, cut_lineage, row_counts, spread


def with_names(df: DataFrame, refs: list[ColumnRef]) -> DataFrame:
    """Replace ``cid`` by table and column names (literals, so no join)."""
    tables, columns = (F.array(*[F.lit(x) for x in xs]) for xs in ([r.table for r in refs], [r.column for r in refs]))
    at = F.col("cid") + 1
    return df.select(
        F.element_at(tables, at).alias("table_name"), F.element_at(columns, at).alias("column_name"),
        *[c for c in df.columns if c != "cid"],
    )


def basic_stats(tables: Mapping[str, DataFrame], refs: list[ColumnRef] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Rows, filled and blank cells, distinct values, and their 4-digit ratios, per column."""
    refs = refs or column_refs(tables)
    counts = counts if counts is not None else value_counts(tables, refs)
    per = counts.groupBy("cid").agg(F.sum("n").alias("non_null_count"), F.count(F.lit(1)).alias("unique_count"))
    catalogue = column_catalogue(counts.sparkSession, refs).join(F.broadcast(row_counts(tables)), "table_name")
    filled, unique = (F.coalesce(c, F.lit(0)) for c in ("non_null_count", "unique_count"))
    return (
        catalogue.join(per, "cid", "left")
        .withColumn("non_null_count", filled).withColumn("unique_count", unique)
        .withColumn("null_count", F.col("row_count") - F.col("non_null_count"))
        .withColumn("null_ratio", F.when(F.col("row_count") > 0, F.bround(F.col("null_count") / F.col("row_count"), 4)).otherwise(0.0))
        .withColumn("unique_ratio", F.when(F.col("non_null_count") > 0, F.bround(F.col("unique_count") / F.col("non_null_count"), 4)).otherwise(0.0))
    )


def numeric_refs(tables: Mapping[str, DataFrame]) -> list[ColumnRef]:
    return [r for r in column_refs(tables) if r.family == "numeric"]


def numeric_long(tables: Mapping[str, DataFrame], refs: list[ColumnRef]) -> DataFrame:
    """(group_id, x) with one row per filled numeric cell; NaN is a blank."""
    parts = []
    for name, df in tables.items():
        mine = [r for r in refs if r.table == name]
        if mine:
            cells = F.array(*[
                F.struct(F.lit(str(r.cid)).alias("group_id"), F.col(f"`{r.column}`").cast("double").alias("x")) for r in mine])
            narrow = spread(df.select(*[F.col(f"`{r.column}`") for r in mine]))
            parts.append(narrow.select(F.inline(cells)).where(F.col("x").isNotNull() & ~F.isnan("x")))
    return reduce(DataFrame.unionAll, parts)


def numeric_distribution(
    spark: SparkSession, tables: Mapping[str, DataFrame], refs: list[ColumnRef] | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Min, max, mean, exact median, sample deviation, sum, zeros and negatives per column.

    With ``counts``, the tables' checkpointed value counts, medians are sought among distinct values, not rows.
    """
    refs = refs or numeric_refs(tables)
    long = numeric_long(tables, refs)
    x = F.col("x")
    sketch = [summary("x").alias("points")] if counts is None else []
    rows = as_catalogue(long.groupBy("group_id").agg(
        F.count(x).alias("filled"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.sum(x).alias("sum"), F.count_if(x == 0).alias("zero_count"), F.count_if(x < 0).alias("negative_count"), *sketch))
    if counts is None:
        medians = exact_medians(long, {r.group_id: (r.filled, r.min, r.max, r.points) for r in rows.collect()})
    else:
        values = counts.where(F.col("cid").isin([r.cid for r in refs])).select(F.col("cid").alias("span"), F.col("value").cast("double").alias("x"), "n")
        medians = medians_of_counts(values, {int(r.group_id): r.filled for r in rows.collect()})
    stats = rows.drop("points")
    middle = spark.createDataFrame([(int(g), m) for g, m in medians.items()], "cid int, median double")
    return (
        stats.withColumn("cid", F.col("group_id").cast("int")).drop("group_id").join(F.broadcast(middle), "cid", "left")
        .withColumn("std", F.when(F.col("filled") == 1, 0.0).otherwise(F.col("std")))
    )


def histogram(spark: SparkSession, tables: Mapping[str, DataFrame], refs: list[ColumnRef] | None = None, bins: int = V.HISTOGRAM_BINS) -> DataFrame:
    """(cid, bin, lo, hi, n): at most ten equal bins, the last one closed.

    Bounds and distinct counts come first (one row per column); filling the bins
    is then a narrow scan with a per-bin count.
    """
    refs = refs or numeric_refs(tables)
    long = numeric_long(tables, refs)
    few = value_counts(tables, refs).groupBy("cid").agg(F.count(F.lit(1)).alias("d"))
    edges = long.groupBy(F.col("group_id").cast("int").alias("cid")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = [
        (str(r.cid), r.lo - 0.5 if r.lo == r.hi else r.lo, r.hi + 0.5 if r.lo == r.hi else r.hi, min(bins, max(1, r.d)))
        for r in edges.join(few, "cid").collect()
    ]
    spans = spark.createDataFrame(rows, "group_id string, lo double, hi double, bins int")
    step = (F.col("hi") - F.col("lo")) / F.col("bins")

    def edge(i: Column) -> Column:
        return F.when(i == F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * step)

    first = F.least(F.floor((F.col("x") - F.col("lo")) / step), F.col("bins") - 1)
    placed = long.join(F.broadcast(spans), "group_id").withColumn("b", first)
    down = F.when(F.col("x") < edge(F.col("b")), 1).otherwise(0)
    up = F.when((F.col("b") < F.col("bins") - 1) & (F.col("x") >= edge(F.col("b") + 1)), 1).otherwise(0)
    counted = placed.groupBy("group_id", (F.col("b") - down + up).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spans.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins").cast("bigint") - 1)).alias("bin"))
    return grid.join(counted, ["group_id", "bin"], "left").select(
        F.col("group_id").cast("int").alias("cid"), "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


def top_values(counts: DataFrame, k: int = V.TOP_VALUES) -> DataFrame:
    """(cid, rank, value, n): tasks keep their best ``k`` per column before the shuffle."""
    w = Window.partitionBy("cid").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def categorical_distribution(counts: DataFrame, k: int = V.TOP_VALUES) -> DataFrame:
    """(cid, distinct, total, longest_value, rank, value, n, share)."""
    totals = counts.groupBy("cid").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("total"), F.max(F.length("value")).alias("longest_value"))
    return top_values(counts, k).join(F.broadcast(totals), "cid").withColumn("share", F.col("n") / F.col("total"))


def temporal_distribution(df: DataFrame, column: str, months: int | None = None) -> DataFrame:
    """One row per month (the first ``months``, if given) with the column's first, last and whole days between."""
    t = F.col(f"`{column}`").cast("timestamp_ntz")
    edge = df.agg(F.date_format(F.min(t), "yyyy-MM-dd'T'HH:mm:ss").alias("first_at"), F.date_format(F.max(t), "yyyy-MM-dd'T'HH:mm:ss").alias("last_at"),
                  F.floor(F.timestamp_diff("MICROSECOND", F.min(t), F.max(t)) / 86_400_000_000).alias("span_days")).first()
    by = df.where(t.isNotNull()).groupBy(F.date_trunc("month", t).cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return (by if months is None else by.orderBy("month").limit(months)).select(
        F.date_format("month", "yyyy-MM").alias("period"), "n", F.lit(edge.first_at).alias("first_at"), F.lit(edge.last_at).alias("last_at"),
        F.lit(edge.span_days).cast("bigint").alias("span_days"))


def boolean_distribution(counts: DataFrame) -> DataFrame:
    """(cid, value, n, share) over lower-cased, trimmed values."""
    by = counts.groupBy("cid", F.lower(X.strip(F.col("value"))).alias("value")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("cid"))
    return by.withColumn("share", F.col("n") / total)


def profile(spark: SparkSession, tables: Mapping[str, DataFrame], types: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per column: stats and the distribution its type calls for, as JSON.

    ``types`` is (cid, column_type); ``counts`` the tables' value counts, checkpointed, where the caller has them.  Every kind is one branch over all columns of
    that kind, so a dataset costs a fixed number of jobs, not one per column.
    """
    refs = column_refs(tables)
    counts = counts if counts is not None else cut_lineage(value_counts(tables, refs))
    kind = {r.cid: r.column_type for r in types.collect()}
    numeric = [r for r in refs if kind.get(r.cid) in V.NUMERIC_COLUMN_TYPES and r.family == "numeric"]
    boolean = [r.cid for r in refs if kind.get(r.cid) == "boolean"]
    dated = [r for r in refs if kind.get(r.cid) == "date" and r.family == "datetime"]
    taken = {r.cid for r in numeric} | set(boolean) | {r.cid for r in dated}
    rest = [r.cid for r in refs if r.cid not in taken]
    parts = []
    if numeric:
        parts.append(numeric_distribution(spark, tables, numeric, counts).select(
            "cid", F.to_json(F.struct(F.lit("numeric").alias("kind"), "min", "max", "mean", "median", "std", "sum", "zero_count", "negative_count")).alias("distribution")))
    if boolean:
        parts.append(boolean_distribution(counts.where(F.col("cid").isin(boolean))).groupBy("cid").agg(
            F.to_json(F.struct(F.lit("boolean").alias("kind"), F.array_sort(F.collect_list(F.struct("value", "n", F.bround("share", 4).alias("share")))).alias("values"))).alias("distribution")))
    for r in dated:
        parts.append(temporal_distribution(tables[r.table], r.column).agg(
            F.to_json(F.struct(F.lit("temporal").alias("kind"), F.min("first_at").alias("min"), F.max("last_at").alias("max"), F.max("span_days").alias("span_days"),
                               F.array_sort(F.collect_list(F.struct("period", "n"))).alias("by_month"))).alias("distribution")).select(F.lit(r.cid).alias("cid"), "distribution"))
    if rest:
        parts.append(categorical_distribution(counts.where(F.col("cid").isin(rest))).groupBy("cid").agg(
            F.to_json(F.struct(F.lit("categorical").alias("kind"), F.max("distinct_values").alias("distinct"), F.max("longest_value").alias("longest_value"),
                               F.array_sort(F.collect_list(F.struct("rank", "value", "n", F.bround("share", 4).alias("share")))).alias("top_values"))).alias("distribution")))
    return basic_stats(tables, refs, counts).join(types, "cid", "left").join(reduce(DataFrame.unionAll, parts), "cid", "left")
