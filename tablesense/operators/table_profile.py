"""What each table is: thirteen labels, then a written decision tree over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense import values as V
from tablesense.operators.dependencies import longest_chains
from tablesense.operators.ranks import spacing


def column_roles(columns: DataFrame) -> DataFrame:
    """is_enum, is_numeric, is_measure per column (needs ``is_structural`` for key columns)."""
    c = F.col
    kind, label = c("column_type"), c("taxonomy_label")
    few = (c("unique_count") > 1) & (c("unique_count") <= V.MAX_ENUM_DISTINCT) & (c("unique_ratio") <= V.ENUM_UNIQUE)
    enum = F.when(kind == "boolean", True).when(kind.isin("float", "currency", "date"), False).when(
        label.isin(*V.ENUM_LABELS), True).otherwise(few)
    numeric = kind.isin(*V.NUMERIC_COLUMN_TYPES)
    measure = (
        F.when(c("is_structural"), False).when(label.isin(*V.MEASURE_LABELS), True).when(label.isin(*V.NON_MEASURE_LABELS), False)
        .when(~numeric | (kind == "integer_nominal"), False).otherwise(~enum)
    )
    return columns.withColumn("is_numeric", numeric).withColumn("is_measure", measure).withColumn("is_enum", enum & ~measure)


def structural(columns: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Flag key and foreign-key columns; rejected edges do not count."""
    live = edges.where("status <> 'rejected' AND rel_type = 'foreign_key'")
    marks = (
        keys.select("table_name", "column_name")
        .union(live.select("from_table", "from_column")).distinct().withColumn("_s", F.lit(True))
    )
    return columns.join(marks, ["table_name", "column_name"], "left").withColumn("is_structural", F.coalesce("_s", F.lit(False))).drop("_s")


def _named(when: Column) -> Column:
    """Names of the columns that meet a condition, in table order."""
    item = F.when(when, F.struct("position", "column_name"))
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["column_name"])


def table_features(
    spark: SparkSession, tables: DataFrame, columns: DataFrame, keys: DataFrame, edges: DataFrame,
    periodic: DataFrame | None = None,
) -> DataFrame:
    """One row per table with everything labels and types are decided from.

    ``tables`` (table_name, row_count[, header_rows]), ``columns`` the column profile,
    ``keys`` (table_name, column_name), ``edges`` relationships, ``periodic``
    (table_name, periodic) for time keys.  All are catalogues.
    """
    roles = column_roles(structural(columns, keys, edges))
    if "header_rows" not in tables.columns:
        tables = tables.withColumn("header_rows", F.lit(1))
    c = F.col
    discrete = c("is_numeric") & ~c("is_structural")
    in_ladder = [F.array_sort(F.collect_set(F.when(c("taxonomy_label").isin(*rungs), c("taxonomy_label")))).alias(f"ladder{i}")
                 for i, rungs in enumerate(V.LABEL_LADDERS)]
    per_column = roles.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"), _named(c("is_measure")).alias("measures"), _named(c("is_enum")).alias("enums"),
        F.count_if(discrete).alias("numeric_count"), _named(discrete & (c("unique_ratio") <= V.NOMINAL_RATIO)).alias("discrete"),
        _named(F.lower("column_name").rlike(V.HIERARCHY_NAME_PATTERN)).alias("level_names"), *in_ladder,
        F.collect_set(F.when(c("null_ratio") > V.TABLE_HIGH_NULL, c("column_name"))).alias("sparse"),
    )
    typed = keys.join(columns.select("table_name", "column_name", "column_type", "position"), ["table_name", "column_name"], "left")
    per_key = typed.groupBy("table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]).alias("primary_key"),
        F.transform(F.array_sort(F.collect_list(F.when(c("column_type") == "date", F.struct("position", "column_name")))), lambda x: x["column_name"]).alias("time_key"))
    live = edges.where("status <> 'rejected'")
    fks = live.where("rel_type = 'foreign_key'")
    sets = lambda x: F.array_sort(F.collect_set(x))
    out = fks.groupBy(c("from_table").alias("table_name")).agg(
        sets(c("from_column")).alias("outgoing"), sets(c("to_table")).alias("references_tables"),
        sets(F.when(c("to_table") == c("from_table"), c("from_column"))).alias("self_columns"))
    back = fks.groupBy(c("to_table").alias("table_name")).agg(sets(F.when(c("from_table") != c("to_table"), c("from_table"))).alias("referenced_by"))
    fd = live.where("rel_type = 'functional_dependency'").select(
        c("from_table").alias("table_name"), c("from_column").alias("determinant"), c("to_column").alias("dependent"))
    chains = longest_chains(spark, fd)
    pairs = fd.groupBy("table_name").agg(F.array_distinct(F.flatten(F.collect_list(F.array("determinant", "dependent")))).alias("fd_columns"))
    joined = tables.withColumn("peers", F.lit(0))
    for part in (per_column, per_key, out, back, chains, pairs):
        joined = joined.join(part, "table_name", "left")
    joined = joined.join(periodic, "table_name", "left") if periodic is not None else joined.withColumn("periodic", F.lit(False))
    empty = F.array().cast("array<string>")
    arrays = ["measures", "enums", "discrete", "level_names", "sparse", "primary_key", "time_key", "outgoing", "references_tables",
              "self_columns", "referenced_by", "chain", "fd_columns", *[f"ladder{i}" for i in range(len(V.LABEL_LADDERS))]]
    for name in arrays:
        joined = joined.withColumn(name, F.coalesce(name, empty))
    peers = tables.agg((F.count(F.lit(1)) - 1).alias("peers")).first().peers
    return joined.withColumn("peers", F.lit(max(0, peers))).withColumn("column_count", F.coalesce("column_count", F.lit(0))).withColumn(
        "periodic", F.coalesce("periodic", F.lit(False)))


def table_labels(features: DataFrame) -> DataFrame:
    """features + ``labels``: the array of labels that hold, in their fixed order."""
    c, n = F.col, lambda x: F.size(F.col(x))
    ladder = F.lit(False)
    for i in range(len(V.LABEL_LADDERS)):
        ladder = ladder | (n(f"ladder{i}") >= 2)
    rules = (
        n("time_key") > 0, (n("time_key") > 0) & c("periodic"), n("measures") == 1, n("enums") == 1,
        (c("numeric_count") > 0) & (n("discrete") * 2 >= c("numeric_count")), (n("enums") > 0) & (n("enums") * 2 > c("column_count")),
        (n("level_names") > 0) | ladder | (c("header_rows") > 1),
        (n("referenced_by") >= 2) | ((n("referenced_by") > 0) & (c("peers") > 0) & (n("referenced_by") * 2 >= c("peers"))),
        n("self_columns") > 0, n("primary_key") != 1, n("outgoing") == 2, n("chain") >= V.MIN_CHAIN,
        (n("fd_columns") > 0) & ~F.arrays_overlap("fd_columns", "sparse"),
    )
    held = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in zip(V.TABLE_LABELS, rules)]))
    none = F.when(n("primary_key") != 1, F.array(F.lit("is_no_single_value_as_primary_key"))).otherwise(F.array().cast("array<string>"))
    return features.withColumn("labels", F.when(c("row_count") > 0, held).otherwise(none))


def table_types(labelled: DataFrame) -> DataFrame:
    """table_type, confidence and the branch that decided it, from the labels."""
    c, n = F.col, lambda x: F.size(F.col(x))
    held = lambda x: F.array_contains("labels", x)
    measured, out, keyed = n("measures") > 0, n("outgoing"), n("primary_key") > 0
    enumerated = held("is_enum_containing_most") | (c("column_count") <= 3)
    ticking = held("is_primary_key_periodic")
    tree = (
        (c("row_count") == 0, "unknown", F.lit(0.0), "no rows to read a shape from"),
        ((out >= 2) & ~measured & (c("column_count") <= out + 2), "bridge", F.lit(0.9), "little more than its references"),
        (held("is_primary_key_time") & (ticking | measured), "time_series", F.when(ticking, 0.9).otherwise(0.8), "keyed by time"),
        ((out > 0) & measured, "fact", F.when(out >= 2, 0.9).otherwise(0.8), "measures that hang off other tables"),
        (held("is_self_reference"), "hierarchy", F.lit(0.9), "rows refer to rows of the same table"),
        (held("is_label_having_hierarchy_column") & held("is_having_dependency_chain"), "hierarchy", F.lit(0.75), "levels that fix one another"),
        (keyed & ~measured & (n("referenced_by") > 0), "dimension", F.when(held("is_mostly_referenced"), 0.85).otherwise(0.75), "described, keyed and pointed at"),
        ((out == 0) & (c("row_count") <= V.LOOKUP_ROWS) & enumerated, "lookup", F.lit(0.7), "a short code list"),
        (c("column_count") >= V.WIDE_COLUMNS, "wide", F.lit(0.7), "everything in one table"),
        (measured, "fact", F.lit(0.6), "measures that stand alone"),
        (keyed, "dimension", F.lit(0.6), "described and keyed, not yet pointed at"),
    )
    kind, confidence, why = F.lit("unknown"), F.lit(0.0), F.lit("no branch fits")
    for when, name, score, reason in reversed(tree):
        kind, confidence, why = F.when(when, name).otherwise(kind), F.when(when, score).otherwise(confidence), F.when(when, reason).otherwise(why)
    typed = labelled.withColumn("table_type", kind).withColumn("type_confidence", confidence).withColumn("rationale", why)
    return typed.withColumn("table_type", F.when(c("type_confidence") < V.MIN_TYPE_CONFIDENCE, "unknown").otherwise(c("table_type")))


def periodic_keys(tables: Mapping[str, DataFrame], time_keys: Mapping[str, str]) -> DataFrame | None:
    """(table_name, periodic) for tables keyed by a time column."""
    out = None
    for table, column in time_keys.items():
        steady = (F.col("points") >= V.MIN_PERIODIC_POINTS) & (F.col("std_seconds") / F.col("mean_seconds") <= V.MAX_PERIOD_VARIATION)
        part = spacing(tables[table], column).select(F.lit(table).alias("table_name"), steady.alias("periodic"))
        out = part if out is None else out.unionAll(part)
    return out


def with_overrides(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """A person's type and label edits beside the detected ones; withdrawing is a null.

    ``overrides``: table_name, user_table_type, added_labels, removed_labels.
    """
    known = F.array(*[F.lit(x) for x in V.TABLE_LABELS])
    o = overrides.select("table_name", "user_table_type", F.array_intersect("added_labels", known).alias("added"),
                         F.array_intersect("removed_labels", known).alias("removed"))
    empty = F.array().cast("array<string>")
    kept = F.array_except("labels", F.coalesce("removed", empty))
    return (
        profiles.join(o, "table_name", "left")
        .withColumn("effective_type", F.coalesce("user_table_type", "table_type"))
        .withColumn("effective_labels", F.array_union(kept, F.coalesce("added", empty)))
    )
