"""What is wrong with each table, and how urgent that is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablesense import values as V

SEVERITY = {"info": 0, "warning": 1, "error": 2}
ISSUE = "table_name string, code string, severity string, columns array<string>"


def _columns_where(columns: DataFrame, when: Column, code: str, severity: str) -> DataFrame:
    """One issue per table naming every column that meets a rule."""
    return (
        columns.where(when).groupBy("table_name").agg(F.sort_array(F.collect_list("column_name")).alias("columns"))
        .select("table_name", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "columns")
    )


def _tables_where(tables: DataFrame, when: Column, code: str, severity: str) -> DataFrame:
    return tables.where(when).select(
        "table_name", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.array().cast("array<string>").alias("columns"))


def issues(tables: DataFrame, columns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """All issues of a dataset from its catalogues.

    ``tables``: table_name, row_count, duplicate_rows and optionally header_confidence,
    header_rows, banner_rows.  ``columns``: table_name, column_name, null_ratio and the
    cleaning report (retyped_to, coerced_to_null, unconverted_type, unconverted_ratio, mixed_ratio).
    """
    for name, default in (("header_confidence", 1.0), ("header_rows", 1), ("banner_rows", 0), ("duplicate_rows", 0)):
        if name not in tables.columns:
            tables = tables.withColumn(name, F.lit(default))
    for name, kind in (("retyped_to", "string"), ("coerced_to_null", "bigint"), ("unconverted_type", "string"),
                       ("unconverted_ratio", "double"), ("mixed_ratio", "double")):
        if name not in columns.columns:
            columns = columns.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    null = c("null_ratio")
    data = tables.where("row_count > 0")
    filled = columns.join(F.broadcast(data.select("table_name")), "table_name", "left_semi")
    parts = [
        _tables_where(tables, c("row_count") == 0, "no_data", "error"),
        _tables_where(data, c("row_count") < V.MIN_ANALYSIS_ROWS, "too_few_rows", "error"),
        _tables_where(data, c("header_confidence") < 0.6, "uncertain_header", "error"),
        _columns_where(filled, c("column_name").startswith("col_"), "unnamed_columns", "warning"),
        _tables_where(data, c("header_rows") > 1, "multi_row_header", "info"),
        _tables_where(data, c("banner_rows") > 0, "banner_rows_skipped", "info"),
        _columns_where(filled, null == 1, "empty_columns", "warning"),
        _columns_where(filled, (null < 1) & (null > V.HIGH_NULL), "high_null_ratio", "warning"),
        _columns_where(filled, (null <= V.HIGH_NULL) & (null > V.MODERATE_NULL), "missing_values", "info"),
        _tables_where(data, c("duplicate_rows") > 0, "duplicate_rows", "info"),
        _columns_where(filled, (c("mixed_ratio") > V.MIXED_TYPES) & c("retyped_to").isNull(), "mixed_types", "warning"),
        _columns_where(filled, c("unconverted_type").isNotNull() & (c("unconverted_ratio") > V.PARTLY_TYPED), "partly_typed", "warning"),
        _columns_where(filled, c("retyped_to").isNotNull(), "retyped_columns", "info"),
        _columns_where(filled, c("coerced_to_null") > 0, "values_lost_in_cast", "warning"),
        _columns_where(filled, suffixed(c("column_name")), "duplicate_column_names", "warning"),
    ]
    if keys is not None:
        parts += key_issues(keys.join(F.broadcast(data.select("table_name")), "table_name", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def key_issues(keys: DataFrame) -> list[DataFrame]:
    offered = F.col("needs_confirmation") & (F.size("candidates") > 0)
    return [
        _tables_where(keys, F.col("declared_key_holds") == F.lit(False), "declared_key_broken", "warning"),
        keys.where(offered).select("table_name", F.lit("composite_key_candidate").alias("code"), F.lit("warning").alias("severity"),
                                   F.split(F.element_at("candidates", 1), r" \+ ").alias("columns")),
        _tables_where(keys, ~offered & F.col("needs_synthetic_key"), "no_primary_key", "warning"),
    ]


def suffixed(name: Column) -> Column:
    """Names that were made unique with a numeric suffix."""
    return name.rlike(r"_\d+$") | name.rlike(r"^\d+$")


def statuses(tables: DataFrame, found: DataFrame) -> DataFrame:
    """clean / fixable / needs_attention / structural_issues per table: its worst issue."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = found.groupBy("table_name").agg(F.max(rank).alias("_worst"), F.count(F.lit(1)).alias("issues"))
    status = F.when(F.col("_worst") == 2, "structural_issues").when(F.col("_worst") == 1, "needs_attention").when(
        F.col("_worst") == 0, "fixable").otherwise("clean")
    return tables.join(worst, "table_name", "left").select("table_name", status.alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))


def analysable(tables: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    kept = tables if skipped is None else tables.join(skipped, "table_name", "left_anti")
    return kept.where(F.col("row_count") >= V.MIN_ANALYSIS_ROWS)
