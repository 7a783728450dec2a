"""Rows and counts for and against a reference, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesense import values as V
from tablesense.operators.value_counts import cell_text
from tablesense.session import broadcast_if_small


def comparison_key(df: DataFrame, column: str) -> Column:
    """How two columns' values are compared: whole floats as integers, trimmed text."""
    return F.btrim(cell_text(F.col(f"`{column}`"), df.schema[column].dataType))


def real_keys(parent: DataFrame, key: str) -> DataFrame:
    return parent.select(comparison_key(parent, key).alias("_key")).where("_key IS NOT NULL").distinct()


def supporting_rows(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose value is a real key; blanks are neither for nor against."""
    return child.join(broadcast_if_small(real_keys(parent, key)), comparison_key(child, column) == F.col("_key"), "left_semi")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    present = child.where(F.col(f"`{column}`").isNotNull())
    return present.join(broadcast_if_small(real_keys(parent, key)), comparison_key(present, column) == F.col("_key"), "left_anti")


def reference_counts(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: rows for, rows against, blank rows, orphan values.

    Child values are counted first, so the join sees each value once, however hot.
    """
    counted = child.groupBy(comparison_key(child, column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(real_keys(parent, key).withColumn("_real", F.lit(True)), F.col("v") == F.col("_key"), "left")
    real, blank = F.col("_real").isNotNull(), F.col("v").isNull()

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))

    return joined.agg(
        total(real).alias("supporting_rows"), total(~real & ~blank).alias("orphan_rows"), total(blank).alias("blank_rows"),
        F.count_if(~real & ~blank).alias("orphan_values"),
    )


def reference_sql(child: str, column: str, parent: str, key: str, limit: int = V.EVIDENCE_ROWS) -> tuple[str, str]:
    """The two statements a person can replay: rows for, rows against."""
    base = f"SELECT * FROM `{child}` WHERE `{column}` IS NOT NULL AND `{column}` {{}} (SELECT `{key}` FROM `{parent}` WHERE `{key}` IS NOT NULL) LIMIT {limit}"
    return base.format("IN"), base.format("NOT IN")


def reference_evidence(tables: dict[str, DataFrame], child: str, column: str, parent: str, key: str, limit: int = V.EVIDENCE_ROWS) -> dict[str, DataFrame | str]:
    """Counts, a few rows each way, and the SQL text for one reference."""
    support, against = reference_sql(child, column, parent, key, limit)
    c, p = tables[child], tables[parent]
    return {
        "counts": reference_counts(c, column, p, key),
        "supporting": supporting_rows(c, column, p, key).limit(limit),
        "contradicting": orphan_rows(c, column, p, key).limit(limit),
        "supporting_sql": support, "contradicting_sql": against,
    }
