"""Tables that repeat an earlier table, cell for cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense.session import row_counts


def arrival(name: Column) -> Column:
    """Sorts names by when they came: ``t`` before ``t_2`` before ``t_3``."""
    number = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.struct(F.when(number == "", 1).otherwise(number.try_cast("bigint")).alias("number"), name.alias("name"))


def table_digest(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row: a digest of every cell, independent of partitioning.

    Row hashes are summed as decimals and xor-ed, so equal multisets of rows agree.
    """
    flagged = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    h1, h2 = F.xxhash64(*flagged), F.xxhash64(F.lit(104729), *flagged)
    return df.select(h1.alias("h1"), h2.alias("h2")).agg(
        F.coalesce(F.sum(F.col("h1").cast("decimal(38,0)")), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("h2").cast("decimal(38,0)")), F.lit(0)).alias("total2"),
        F.coalesce(F.bit_xor("h1"), F.lit(0)).alias("mix"),
    )


def duplicate_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(copy, original): tables with the digest, columns and rows of one that came earlier.

    Only tables of equal shape are ever read in full.
    """
    shapes = row_counts(tables).join(
        spark.createDataFrame([(n, df.columns) for n, df in tables.items()], "table_name string, columns array<string>"), "table_name")
    twins = shapes.groupBy("row_count", "columns").agg(F.collect_list("table_name").alias("names")).where("size(names) > 1")
    names = [n for r in twins.select("names").collect() for n in r.names]
    if not names:
        return spark.createDataFrame([], "copy string, original string")
    digests = reduce(DataFrame.unionAll, [
        table_digest(tables[n]).select(F.lit(n).alias("table_name"), "total", "total2", "mix") for n in names])
    alike = digests.join(shapes, "table_name").groupBy("row_count", "columns", "total", "total2", "mix").agg(
        F.min_by("table_name", arrival(F.col("table_name"))).alias("original"), F.collect_list("table_name").alias("names"))
    return alike.select(F.explode("names").alias("copy"), "original").where("copy <> original")


def without_copies(catalogue: DataFrame, copies: DataFrame, column: str = "table_name") -> DataFrame:
    """Catalogue rows that do not come from a copied table."""
    return catalogue.join(F.broadcast(copies.select(F.col("copy").alias(column))), column, "left_anti")
