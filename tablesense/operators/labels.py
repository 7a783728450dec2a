"""What a column is about: the first of an ordered list of label rules that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense import values as V
from tablesense.operators.profile import top_values

SAMPLE = 20


def pattern_shares(counts: DataFrame) -> DataFrame:
    """Share of a column's 20 most frequent values that fit each value pattern."""
    sample = top_values(counts, SAMPLE)
    return sample.groupBy("cid").agg(*[
        F.avg(F.col("value").rlike(p).cast("double")).alias(f"share_{k}") for k, p in V.LABEL_PATTERNS.items()])


def label_columns(types: DataFrame, counts: DataFrame) -> DataFrame:
    """taxonomy_label, label_confidence and label_source per column; ``unknown`` when no rule fits."""
    facts = types.join(pattern_shares(counts), "cid", "left")
    name = F.btrim(F.regexp_replace(F.lower("column_name"), "[^a-z0-9]+", "_"), F.lit("_"))
    shares = F.create_map(*[x for k in V.LABEL_PATTERNS for x in (F.lit(k), F.coalesce(F.col(f"share_{k}"), F.lit(0.0)))])
    facts = facts.withColumn("_name", name).withColumn("_tokens", F.split(name, "_")).withColumn("_shares", shares)
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(min(0.99, c + 0.03) if p and words else c).alias("score"), F.lit(p).cast("string").alias("pattern"),
                 F.lit(share).alias("share"), lits(allowed).alias("allowed"), lits(words).alias("words"))
        for label, c, p, share, allowed, words in V.LABEL_RULES])

    def fits(rule: Column) -> Column:
        named = F.exists(rule["words"], lambda w: F.when(F.contains(w, F.lit("_")), F.contains(F.col("_name"), w)).otherwise(F.array_contains(F.col("_tokens"), w)))
        return (
            ((F.size(rule["allowed"]) == 0) | F.array_contains(rule["allowed"], F.col("column_type")))
            & ((F.size(rule["words"]) == 0) | named)
            & (rule["pattern"].isNull() | (F.try_element_at(F.col("_shares"), rule["pattern"]) >= rule["share"]))
        )

    return (
        facts.withColumn("_hit", F.get(F.filter(table, fits), F.lit(0)))
        .withColumn("taxonomy_label", F.coalesce(F.col("_hit.label"), F.lit("unknown")))
        .withColumn("label_confidence", F.coalesce(F.col("_hit.score"), F.lit(0.0)))
        .withColumn("label_source", F.when(F.col("_hit").isNotNull(), "rule").otherwise("fallback"))
        .drop("_hit", "_name", "_tokens", "_shares", *[f"share_{k}" for k in V.LABEL_PATTERNS])
    )


def with_supplied_labels(columns: DataFrame, supplied: DataFrame) -> DataFrame:
    """Labels a caller brings (table_name, column_name, label) fill the unknown ones."""
    s = supplied.select("table_name", "column_name", F.col("label").alias("_label"))
    unknown = F.col("taxonomy_label") == "unknown"
    return columns.join(s, ["table_name", "column_name"], "left").withColumn(
        "label_source", F.when(unknown & F.col("_label").isNotNull(), "supplied").otherwise(F.col("label_source"))
    ).withColumn("taxonomy_label", F.when(unknown, F.coalesce("_label", F.lit("unknown"))).otherwise(F.col("taxonomy_label"))).drop("_label")


def unknown_columns(columns: DataFrame) -> DataFrame:
    return columns.where("taxonomy_label = 'unknown'")


def with_overrides(columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """A person's type or label beside the detected one; the effective value is either."""
    o = overrides.select("table_name", "column_name", "user_type", "user_label")
    return (
        columns.join(o, ["table_name", "column_name"], "left")
        .withColumn("effective_type", F.coalesce("user_type", "column_type"))
        .withColumn("effective_label", F.coalesce("user_label", "taxonomy_label"))
    )
