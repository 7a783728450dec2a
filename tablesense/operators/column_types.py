"""Nine column types from value counts: one grouped aggregate, one cascade."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesense import values as V
from tablesense.functions import dates, text as X
from tablesense.operators.value_counts import ColumnRef, column_catalogue, column_refs, value_counts
from tablesense.session import cut_lineage


def name_has(name: Column, words: tuple[str, ...]) -> Column:
    """Does a column name, lower-cased and underscored, contain one of the words?"""
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    out = F.lit(False)
    for word in words:
        out = out | flat.contains(word)
    return out


def type_evidence(counts: DataFrame, refs: list[ColumnRef]) -> DataFrame:
    """Per column: weighted shares and extremes of everything the cascade asks."""
    ids = {group: [r.cid for r in refs if r.family == group] for group in ("text", "numeric")}
    text, numeric = (F.col("cid").isin(x) if x else F.lit(False) for x in ids.values())
    v = F.col("v")

    def marks(rows: DataFrame, number: Column, **flags: Column) -> DataFrame:
        trimmed = rows.select("cid", "n", "value", X.strip(F.col("value")).alias("v"))
        return trimmed.select("*", F.lower("v").alias("word")).select(
            "cid", "n", "v", "word", F.col("word").isin(*V.BOOLEAN_TRUE, *V.BOOLEAN_FALSE).alias("truth"), number.alias("number"),
            *[flag.alias(name) for name, flag in flags.items()], v.rlike(r"^[\p{L}\p{N}]+$|[-_]").alias("plain"), F.length(v).alias("len"))

    # stored numbers and moments, most distinct values of a schema, are asked none of the questions about text
    stored = marks(counts.where(~text), F.when(numeric, F.col("value").try_cast("double")), **{
        name: F.lit(False) for name in ("date", "padded", "uuid", "hex", "code")})
    written = marks(
        counts.where(text), X.to_number(v), date=dates.parse_trimmed(v).isNotNull(), padded=X.is_zero_padded(v),
        uuid=v.rlike(V.UUID_PATTERN), hex=v.rlike(V.HEX_PATTERN), code=v.rlike(V.CODE_PATTERN))
    marked = stored.unionAll(written)

    # plain sums by length and truth word first: the sets below then see few rows, not every distinct value
    flags = ("date", "padded", "uuid", "hex", "code")
    by_length = marked.groupBy("cid", "len", F.when(F.col("truth"), F.col("word")).alias("truth_word")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("values_"), F.bool_and("truth").alias("truth"),
        *[F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag) for flag in flags], F.bool_and("plain").alias("plain"),
        F.bool_and(F.col("number").isNotNull()).alias("numbers"), F.min("number").alias("lo"), F.max("number").alias("hi"),
        F.bool_and(F.coalesce(F.col("number") % 1 == 0, F.lit(False))).alias("whole"),
    )
    return by_length.groupBy("cid").agg(
        F.sum("n").alias("filled"), F.sum("values_").alias("distinct_values"), F.bool_and("truth").alias("all_truth"),
        F.size(F.collect_set("truth_word")).alias("truth_words"),
        *[(F.sum(flag) / F.sum("n")).alias(f"{flag}_share") for flag in flags], F.bool_and("plain").alias("all_plain"),
        F.size(F.collect_set("len")).alias("lengths"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.bool_and("numbers").alias("all_numbers"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and("whole").alias("whole"),
    )


def _steady(counts: DataFrame, evidence: DataFrame) -> list[int]:
    """Columns whose distinct whole numbers advance by one constant step.

    d distinct numbers between lo and hi do so exactly when (hi - lo) / (d - 1) is
    a whole step and every value is lo plus a multiple of it: counting, no sort.
    """
    few = evidence.where("all_numbers AND whole AND distinct_values >= 5").select("cid", "lo", "hi", "distinct_values").collect()
    steps = {}
    for r in few:
        step, rest = divmod(r.hi - r.lo, r.distinct_values - 1)
        if step > 0 and rest == 0:
            steps[r.cid] = (r.lo, step)
    sure = [cid for cid, (_, step) in steps.items() if step == 1]
    check = {cid: s for cid, s in steps.items() if s[1] != 1}
    if check:
        off = F.lit(False)
        for cid, (lo, step) in check.items():
            off = off | ((F.col("cid") == cid) & ((X.to_number(F.col("value")) - lo) % step != 0))
        bad = {r.cid for r in counts.where(F.col("cid").isin(list(check))).where(off).select("cid").distinct().collect()}
        sure += [cid for cid in check if cid not in bad]
    return sure


def cascade(facts: DataFrame, steady: list[int], symbols: Mapping[int, str] | None = None) -> DataFrame:
    """column_type and confidence for rows of catalogue + evidence."""
    c, name = F.col, F.col("column_name")
    numeric, dated, text = (c("family") == x for x in ("numeric", "datetime", "text"))
    unique = c("distinct_values") / c("filled")
    hinted = name_has(name, V.IDENTIFIER_NAME_HINTS)
    even = c("lengths") <= 2
    coded = (c("code_share") >= 0.9) & (unique >= 0.5)
    code_conf = F.when(even, 0.9).otherwise(0.82)
    fixed = even & (unique > 0.95) & hinted & c("all_plain")
    boolean = (c("family") == "boolean") | (c("all_truth") & (c("truth_words") <= 2))
    symbol = c("cid").isin(list(symbols)) if symbols else F.lit(False)
    fraction = (c("hi") <= 1.0) & (c("lo") >= 0.0)
    money = name_has(name, V.FINANCIAL_KEYWORDS) & ~name_has(name, V.RATIO_NAME_HINTS) & ~fraction
    number = c("all_numbers") & ~dated
    constant_step = c("cid").isin(steady) if steady else F.lit(False)
    chain = [
        (c("filled").isNull(), "text", F.lit(0.0)),
        (boolean, "boolean", F.when((c("family") == "boolean"), 1.0).when(c("truth_words") == 2, 0.98).otherwise(0.75)),
        (dated, "date", F.lit(1.0)),
        (text & (c("date_share") >= V.DATE_TYPE), "date", F.bround(c("date_share"), 3)),
        (text & (c("padded_share") > V.ZERO_PADDED_SHARE), "identifier", F.lit(0.9)),
        (text & (c("uuid_share") >= 0.9), "identifier", F.lit(0.99)),
        (text & (c("hex_share") >= 0.9) & (unique > 0.9), "identifier", F.lit(0.9)),
        (text & coded, "identifier", F.bround(F.when(hinted, F.least(F.lit(0.97), code_conf + 0.06)).otherwise(code_conf), 3)),
        (text & fixed, "identifier", F.lit(0.8)),
        (number & symbol, "currency", F.lit(0.97)), (number & money, "currency", F.lit(0.85)),
        (number & ~c("whole"), "float", F.lit(0.95)),
        (number & (unique > 0.98) & hinted, "identifier", F.lit(0.85)),
        (number & constant_step, "integer_ordinal", F.lit(0.9)),
        (number & (unique <= V.NOMINAL_RATIO), "integer_nominal", F.bround(0.7 + (V.NOMINAL_RATIO - unique), 3)),
        (number, "integer_continuous", F.lit(0.85)),
    ]
    kind, confidence = F.lit("text"), F.when(c("avg_length") > 3, 0.8).otherwise(0.65)
    for when, label, score in reversed(chain):
        kind, confidence = F.when(when, label).otherwise(kind), F.when(when, score).otherwise(confidence)
    return facts.withColumn("column_type", kind).withColumn("type_confidence", confidence)


def column_types(spark: SparkSession, tables: Mapping[str, DataFrame], symbols: Mapping[tuple[str, str], str] | None = None,
                 counts: DataFrame | None = None) -> DataFrame:
    """Type, confidence and the evidence behind them, one row per column.

    ``symbols`` are the currency signs cleaning found, by (table, column).
    """
    refs = column_refs(tables)
    counts = counts if counts is not None else cut_lineage(value_counts(tables, refs))
    # One row per column: computed once, then reasoned about as a catalogue.
    evidence = type_evidence(counts, refs)
    evidence = spark.createDataFrame(evidence.collect(), evidence.schema)
    steady = _steady(counts, evidence)
    by_cid = {r.cid: (symbols or {}).get((r.table, r.column)) for r in refs}
    facts = column_catalogue(spark, refs).join(evidence, "cid", "left")
    return cascade(facts, steady, {k: v for k, v in by_cid.items() if v})
