"""Columns of different tables that mean the same thing."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense import values as V
from tablesense.functions.ratios import lexical_similarity
from tablesense.functions.text import normalise_name
from tablesense.functions.vectors import name_similarity
from tablesense.operators.value_counts import column_refs, overlaps


def column_pairs(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every pair of columns of two different tables, with shared values over the smaller side.

    Pairs are of column *names*; the values behind ``value_overlap`` come from one
    pass of column signatures.
    """
    refs = column_refs(tables)
    shared = {(r.left_cid, r.right_cid): r.matched for r in overlaps(tables, refs).collect()}
    rows = []
    for a, b in combinations(refs, 2):
        if a.table == b.table:
            continue
        sizes = [shared.get((r.cid, r.cid), 0) for r in (a, b)]
        same = a.family == b.family
        overlap = shared.get((a.cid, b.cid), 0) / min(sizes) if same and min(sizes) else None
        rows.append((a.table, a.column, b.table, b.column, same, shared.get((a.cid, b.cid), 0), overlap))
    return spark.createDataFrame(
        rows,
        "left_table string, left_column string, right_table string, right_column string, type_compatible boolean, "
        "shared_values bigint, value_overlap double",
    )


def equivalence_score() -> Column:
    score = V.EQ_EMBEDDING * F.col("name_similarity") + V.EQ_LEXICAL * F.col("lexical_similarity")
    score = score - F.when(~F.col("type_compatible"), V.EQ_TYPE_PENALTY).otherwise(0.0)
    score = score - F.when(F.col("type_compatible") & (F.col("value_overlap") == 0), V.EQ_DISJOINT_PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def verdict() -> Column:
    """linked / unrelated / ask."""
    c = F.col
    return (
        F.when(~c("type_compatible"), "unrelated").when(c("value_overlap") == 0, "unrelated")
        .when(c("score") >= V.EQ_CONFIRM, "linked").when(c("score") < V.EQ_REJECT, "unrelated")
        .when(c("value_overlap") >= V.EQ_OVERLAP, "linked").otherwise("ask")
    )


def equivalences(spark: SparkSession, tables: Mapping[str, DataFrame], threshold: float = V.EQUIVALENCE) -> DataFrame:
    left, right = normalise_name(F.col("left_column")), normalise_name(F.col("right_column"))
    pairs = column_pairs(spark, tables)
    named = pairs.select("left_column", "right_column").distinct().select(
        "left_column", "right_column", name_similarity(left, right).alias("name_similarity"),
        lexical_similarity(left, right).alias("lexical_similarity"))
    return (
        pairs.join(named, ["left_column", "right_column"]).withColumn("score", equivalence_score())
        .where(F.col("score") >= threshold).withColumn("verdict", verdict())
    )
