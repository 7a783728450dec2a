"""Unique names inside each table, in input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense import values as V


def _suffixed(base: Column, rank: Column) -> Column:
    tail = F.concat(F.lit("_"), rank.cast("string"))
    return F.when(rank == 1, base).otherwise(
        F.concat(F.rtrim(base.substr(F.lit(1), F.lit(V.MAX_IDENTIFIER_LENGTH) - F.length(tail)), F.lit("_")), tail)
    )


def unique_names(df: DataFrame, table: list[str], order: str, name: str, out: str) -> DataFrame:
    """Later repeats of a name get ``_2``, ``_3`` …; a suffixed name that collides is suffixed again.

    Passes follow until no name repeats in its table.  From the fourth on their numbers start higher each
    time, so names cut to the longest length cannot meet for ever.  Windows are as wide as one name
    within one table, so a table's width bounds them.
    """
    current, done = df.withColumn(out, F.col(name)), 0
    while done < 1 or not current.groupBy(*table, out).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        w = Window.partitionBy(*table, out).orderBy(order)
        number = F.row_number().over(w)
        current = current.withColumn("_rank", F.when(number == 1, 1).otherwise(number + max(0, done - 2))).withColumn(
            out, _suffixed(F.col(out), F.col("_rank"))
        ).drop("_rank")
        done += 1
    return current
