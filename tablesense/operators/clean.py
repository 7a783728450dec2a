"""Decide each text column's real type from its value counts, then re-type it once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablesense import values as V
from tablesense.functions import dates, text as X
from tablesense.operators.value_counts import ColumnRef, column_catalogue, column_refs, value_counts
from tablesense.session import cut_lineage


def rank_date_formats(counts: DataFrame) -> DataFrame:
    """(cid, format, hits, rank): which spelling explains most distinct values of a column."""
    names = F.array(*[F.lit(f) for f in V.DATE_FORMAT_NAMES])
    hits = (
        counts.select("cid", X.strip(F.col("value")).alias("text"))
        .select("cid", F.explode(dates.matching_formats(F.col("text"))).alias("pos"))
        .groupBy("cid", "pos").agg(F.count(F.lit(1)).alias("hits"))
    )
    w = Window.partitionBy("cid").orderBy(F.desc("hits"), "pos")
    return hits.select(
        "cid", F.element_at(names, F.col("pos") + 1).alias("format"), "hits", F.row_number().over(w).alias("rank")
    )


def text_refs(tables: Mapping[str, DataFrame]) -> list[ColumnRef]:
    return [r for r in column_refs(tables) if isinstance(r.data_type, T.StringType)]


def column_evidence(counts: DataFrame) -> DataFrame:
    """Per column: weighted hits of every reading, in one aggregate over value counts."""
    n = F.col("n")

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0))

    # Two projections: the trimmed text is computed once and read many times.
    trimmed = counts.select("cid", "n", "value", X.strip(F.col("value")).alias("text"))
    text, filled = F.col("text"), ~F.col("blank")
    marked = trimmed.select("*", F.lower("text").isin(*V.NULL_TOKENS).alias("blank")).select(
        "cid", "n", "blank", (text != F.col("value")).alias("untrimmed"),
        F.when(filled, X.parse_percent(text)).alias("percent"), F.when(filled, X.to_number(text)).alias("number"),
        (filled & X.is_zero_padded(text)).alias("padded"), F.when(filled, X.currency_symbol(text)).alias("symbol"),
        F.when(filled, dates.parse_trimmed(text)).alias("moment"),
    )
    c = F.col
    symbols = [total(c("symbol") == s).alias(f"s{i}") for i, s in enumerate(V.CURRENCY_SYMBOLS)]
    return marked.groupBy("cid").agg(
        total(~c("blank")).alias("total"), total(c("blank")).alias("nulls_normalised"),
        total(c("untrimmed")).alias("whitespace_trimmed"), total(c("percent").isNotNull()).alias("percent_hits"),
        total(c("number").isNotNull()).alias("numeric_hits"), total(c("padded")).alias("padded_hits"),
        total(c("moment").isNotNull()).alias("date_hits"),
        F.coalesce(F.bool_and(c("number") % 1 == 0), F.lit(False)).alias("whole"), *symbols,
    )


def decisions(evidence: DataFrame) -> DataFrame:
    """The reading each column is converted to, and why: percent, numeric, date or text."""
    c = F.col
    filled = c("total") > 0
    share = {k: c(f"{k}_hits") / c("total") for k in ("percent", "numeric", "date", "padded")}
    padded = share["padded"] > V.ZERO_PADDED_SHARE
    kind = (
        F.when(~filled, "empty").when(share["percent"] >= V.NUMERIC_CONVERT, "percent")
        .when((share["numeric"] >= V.NUMERIC_CONVERT) & ~padded, "numeric")
        .when(share["date"] >= V.DATE_CONVERT, "date").otherwise("text")
    )
    hits = F.when(c("kind") == "percent", c("percent_hits")).when(c("kind") == "numeric", c("numeric_hits")).when(
        c("kind") == "date", c("date_hits"))
    found = F.array(*[
        F.struct(c(f"s{i}").alias("n"), F.lit(-i).alias("p"), F.lit(s).alias("symbol"))
        for i, s in enumerate(V.CURRENCY_SYMBOLS)
    ])
    best = F.array_max(found)
    symbols = reduce(Column.__add__, [c(f"s{i}") for i in range(len(V.CURRENCY_SYMBOLS))])
    numeric = c("kind") == "numeric"
    nearer_date = filled & (c("kind") == "text") & (share["date"] >= share["numeric"]) & (c("date_hits") > 0)
    nearer_number = filled & (c("kind") == "text") & (c("numeric_hits") > 0)
    return (
        evidence.withColumn("kind", kind)
        .withColumn("retyped_to", F.when(c("kind") == "percent", "float").when(numeric, "numeric").when(c("kind") == "date", "datetime"))
        .withColumn("parse_success", hits / c("total"))
        .withColumn("coerced_to_null", F.coalesce(F.when(c("kind") != "percent", c("total") - hits), F.lit(0)))
        .withColumn("currency_stripped", F.when(numeric, symbols).otherwise(0))
        .withColumn("currency_symbol", F.when(numeric & (best["n"] > 0), best["symbol"]))
        .withColumn("unconverted_type", F.when(nearer_date, "date").when(nearer_number, "numeric"))
        .withColumn("unconverted_ratio", F.when(nearer_date, share["date"]).when(nearer_number, share["numeric"]).otherwise(0.0))
        .drop(*[f"s{i}" for i in range(len(V.CURRENCY_SYMBOLS))])
    )


def clean_report(tables: Mapping[str, DataFrame], refs: list[ColumnRef] | None = None) -> DataFrame:
    """One row per text column of every table; one shuffle of value counts in all."""
    refs = refs or text_refs(tables)
    counts = cut_lineage(value_counts(tables, refs))
    ranked = rank_date_formats(counts).groupBy("cid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "format"))), lambda x: x["format"]).alias("date_formats")
    )
    spark = counts.sparkSession
    return (
        column_catalogue(spark, refs).join(decisions(column_evidence(counts)), "cid", "left")
        .join(ranked, "cid", "left").withColumn("kind", F.coalesce("kind", F.lit("empty")))
    )


def markers_kept(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Declared sources keep their values: markers are counted, nothing is rewritten."""
    refs = text_refs(tables)
    blank = X.is_null_token(F.col("value"))
    counted = value_counts(tables, refs).groupBy("cid").agg(
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("null_like_kept"))
    return column_catalogue(counted.sparkSession, refs).join(F.broadcast(counted), "cid", "left").select(
        "table_name", "column_name", F.coalesce("null_like_kept", F.lit(0)).alias("null_like_kept"))


def clean_table(df: DataFrame, name: str = "table") -> tuple[DataFrame, DataFrame]:
    """(cleaned table, report).  One small row per column reaches the driver."""
    found = clean_report({name: df})
    rows = found.collect()
    rules = {r.column_name: r for r in rows}
    report = df.sparkSession.createDataFrame(rows, found.schema)
    texts = set(rules)
    trimmed = df.select(*[
        X.normalise_text(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    out = []
    for c in df.columns:
        rule, text = rules.get(c), F.col(f"`{c}`")
        kind = rule.kind if rule else "typed"
        if kind == "percent":
            text = X.parse_percent(text)
        elif kind == "numeric":
            text = X.to_number(text).try_cast("bigint") if rule.whole else X.to_number(text)
        elif kind == "date":
            text = dates.parse_trimmed(text, tuple(rule.date_formats))
        out.append(text.alias(c))
    return trimmed.select(*out), report


def drop_empty_edges(df: DataFrame) -> DataFrame:
    """Without rows blank in every column, then without columns blank in every row."""
    kept = df.na.drop("all")
    counts = kept.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(kept.columns)]).first()
    return kept.select(*[F.col(f"`{c}`") for i, c in enumerate(kept.columns) if counts[f"c{i}"] > 0])
