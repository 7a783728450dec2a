"""Queries that profile, type and label columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.operators import profile as P
from tablesense.operators.column_types import column_types
from tablesense.operators.labels import label_columns
from tablesense.operators.ranks import spacing
from tablesense.operators.value_counts import column_refs, value_counts
from tablesense.session import cut_lineage, load_tables

ALL = S.columns()
NUMERIC = S.columns(S.TPC, ("int", "float"))

STATS = S.union(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null_count, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM {t}" for t, c, _ in ALL)


@query("basic_stats", f"""
SELECT *, count_bucket FROM (SELECT *, CAST(floor(unique_count * 10000 / row_count) AS BIGINT) AS count_bucket FROM ({STATS}))""".replace("SELECT *, count_bucket FROM (", "SELECT * FROM ("))
def basic_stats(spark, path):
    return P.basic_stats(load_tables(spark, path)).select(
        "table_name", "column_name", "row_count", "non_null_count", "null_count", "unique_count",
        F.floor(F.col("unique_count") * 10000 / F.col("row_count")).alias("count_bucket"))


@query("numeric_distribution", S.union(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, "
    f"round(median({c})::DOUBLE, 4) AS median, round(stddev_samp({c}), 4) AS std, round(sum({c})::DOUBLE, 0) AS sum, "
    f"count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} < 0) AS negative_count FROM {t}"
    for t, c, _ in NUMERIC))
def numeric_distribution(spark, path):
    tables = load_tables(spark, path, S.TPC)
    refs = P.numeric_refs(tables)
    return P.with_names(P.numeric_distribution(spark, tables, refs), column_refs(tables)).select(
        "table_name", "column_name", "min", "max", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"),
        F.round("std", 4).alias("std"), F.round("sum", 0).alias("sum"), "zero_count", "negative_count")


def histogram_sql(t: str, c: str) -> str:
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, bin, round(CASE WHEN bin = bins THEN hi ELSE lo + bin * step END, 4) AS lo,
  round(CASE WHEN bin + 1 = bins THEN hi ELSE lo + (bin + 1) * step END, 4) AS hi, coalesce(n, 0) AS n
FROM (SELECT *, unnest(range(bins)) AS bin FROM e) g LEFT JOIN (
  SELECT b - CASE WHEN x < lo + b * step THEN 1 ELSE 0 END + CASE WHEN b < bins - 1 AND x >= lo + (b + 1) * step THEN 1 ELSE 0 END AS bin, count(*) AS n
  FROM (SELECT {c}::DOUBLE AS x, e.*, least(floor(({c} - lo) / step)::BIGINT, bins - 1) AS b FROM {t}, e) GROUP BY 1) h USING (bin)"""


def histogram_oracle() -> str:
    parts = []
    for t, c in (("part", "p_retailprice"), ("part", "p_size"), ("lineitem", "l_discount"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice")):
        e = (f"WITH r AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, least(10, count(DISTINCT {c})) AS bins FROM {t}), "
             f"e AS (SELECT lo, hi, bins, (hi - lo) / bins AS step FROM r) ")
        parts.append(f"SELECT * FROM ({e}{histogram_sql(t, c)})")
    return S.union(parts)


@query("histograms", histogram_oracle())
def histograms(spark, path):
    t = load_tables(spark, path, ["part", "lineitem", "orders"])
    tables = {"part": t["part"].select("p_retailprice", "p_size"), "lineitem": t["lineitem"].select("l_discount", "l_extendedprice"),
              "orders": t["orders"].select("o_totalprice")}
    return P.with_names(P.histogram(spark, tables), column_refs(tables)).select(
        "table_name", "column_name", "bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


TEXTS = (("part", "p_brand"), ("part", "p_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("documents", "source"),
         ("documents", "lang"), ("events", "props"))


@query("categorical_distribution", S.union(
    f"""SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) OVER () AS distinct_values, sum(n) OVER ()::BIGINT AS total,
  max(length(value)) OVER () AS longest_value, row_number() OVER (ORDER BY n DESC, value) AS rank, value, n
  FROM (SELECT {c} AS value, count(*) AS n FROM {t} GROUP BY 1)) WHERE rank <= 10""" for t, c in TEXTS))
def categorical_distribution(spark, path):
    loaded = load_tables(spark, path, dict.fromkeys(t for t, _ in TEXTS))
    tables = {t: df.select(*[c for x, c in TEXTS if x == t]) for t, df in loaded.items()}
    refs = column_refs(tables)
    return P.with_names(P.categorical_distribution(value_counts(tables, refs)).drop("share"), refs)


@query("temporal_distribution", """
WITH e AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders)
SELECT strftime(m, '%Y-%m') AS period, n, strftime(a, '%Y-%m-%dT%H:%M:%S') AS first_at, strftime(b, '%Y-%m-%dT%H:%M:%S') AS last_at,
       (epoch_us(b) - epoch_us(a)) // 86400000000 AS span_days
FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1), e""")
def temporal_distribution(spark, path):
    return P.temporal_distribution(load_tables(spark, path, ["orders"])["orders"], "o_orderdate")


@query("boolean_distribution", S.union(
    f"SELECT 'labels' AS table_name, '{c}' AS column_name, lower(CAST({c} AS VARCHAR)) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY {c}"
    for c in ("quality", "toxic")))
def boolean_distribution(spark, path):
    tables = {"labels": load_tables(spark, path, ["labels"])["labels"].select("quality", "toxic")}
    refs = column_refs(tables)
    return P.with_names(P.boolean_distribution(value_counts(tables, refs)), refs).withColumn("share", F.round("share", 6))


@query("sample_values", S.union(
    f"SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, CAST({c} AS VARCHAR) AS value FROM {t} GROUP BY {c}) WHERE rank <= 5"
    for t, c, k in S.columns(S.TPC, ("int", "text"))))
def sample_values(spark, path):
    tables = {t: df.select(*[c for c, k in S.GIVEN[t] if k in ("int", "text")]) for t, df in load_tables(spark, path, S.TPC).items()}
    refs = column_refs(tables)
    return P.with_names(P.top_values(value_counts(tables, refs), 5), refs).select("table_name", "column_name", "rank", "value")


@query("event_spacing", """
WITH s AS (SELECT DISTINCT epoch(date_trunc('second', ts))::BIGINT AS s FROM events), g AS (SELECT s, s - lag(s) OVER (ORDER BY s) AS gap FROM s)
SELECT count(*) AS points, round(avg(gap), 4) AS mean_seconds, round(stddev_pop(gap), 3) AS std_seconds, stddev_pop(gap) / avg(gap) <= 0.1 AS periodic FROM g""")
def event_spacing(spark, path):
    df = spacing(load_tables(spark, path, ["events"])["events"], "ts")
    return df.select("points", F.round("mean_seconds", 4).alias("mean_seconds"), F.round("std_seconds", 3).alias("std_seconds"),
                     (F.col("std_seconds") / F.col("mean_seconds") <= V.MAX_PERIOD_VARIATION).alias("periodic"))


@query("order_day_spacing", """
WITH s AS (SELECT DISTINCT epoch(o_orderdate)::BIGINT AS s FROM orders), g AS (SELECT s, s - lag(s) OVER (ORDER BY s) AS gap FROM s)
SELECT count(*) AS points, round(avg(gap), 3) AS mean_seconds, stddev_pop(gap) / avg(gap) <= 0.1 AS periodic FROM g""")
def order_day_spacing(spark, path):
    df = spacing(load_tables(spark, path, ["orders"])["orders"], "o_orderdate")
    return df.select("points", F.round("mean_seconds", 3).alias("mean_seconds"),
                     (F.col("std_seconds") / F.col("mean_seconds") <= V.MAX_PERIOD_VARIATION).alias("periodic"))


# --- column types -------------------------------------------------------------
LONG = "[" + ", ".join(S.quote(f) for f in V.DATE_FORMAT_NAMES if "%y" not in f) + "]"


def has(name: str, words) -> str:
    return "(" + " OR ".join(f"contains('{name}', '{w}')" for w in words) + ")"


def type_sql(t: str, c: str, k: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    numeric = k in ("int", "float")
    number = f"{c}::DOUBLE" if numeric else (f"CASE WHEN regexp_matches({v}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({v} AS DOUBLE) END" if k == "text" else "NULL::DOUBLE")
    truth = f"lower({v}) IN {S.in_list(V.BOOLEAN_TRUE + V.BOOLEAN_FALSE)}"
    is_date = f"(length({v}) <= 25 AND regexp_matches({v}, '^[0-9A-Za-z][0-9A-Za-z ,./:-]*$') AND regexp_matches({v}, '\\d{{4}}') AND try_strptime({v}, {LONG}) IS NOT NULL)" if k == "text" else "false"
    pattern = lambda p: f"regexp_matches({v}, {S.quote(p)})" if k == "text" else "false"
    stats = f"""SELECT count({c}) AS filled, count(DISTINCT {c}) AS d, bool_and({truth}) AS all_truth, count(DISTINCT lower({v})) AS words,
  avg(CASE WHEN {is_date} THEN 1.0 ELSE 0 END) AS date_share, avg(CASE WHEN {pattern('^0[0-9]+$')} THEN 1.0 ELSE 0 END) AS padded,
  avg(CASE WHEN {pattern(V.UUID_PATTERN)} THEN 1.0 ELSE 0 END) AS uuid, avg(CASE WHEN {pattern(V.HEX_PATTERN)} THEN 1.0 ELSE 0 END) AS hex,
  avg(CASE WHEN {pattern(V.CODE_PATTERN)} THEN 1.0 ELSE 0 END) AS code, count(DISTINCT length({v})) AS lengths,
  bool_and(regexp_matches({v}, '^[\\p{{L}}\\p{{N}}]+$|[-_]')) AS plain, avg(length({v})) AS avg_length,
  bool_and(({number}) IS NOT NULL) AS numbers, min({number}) AS lo, max({number}) AS hi, bool_and(({number}) = floor({number})) AS whole,
  (SELECT count(DISTINCT gap) = 1 AND count(*) >= 4 FROM (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM (SELECT DISTINCT {number} AS x FROM {t})) WHERE gap IS NOT NULL) AS steady FROM {t}"""
    text = "true" if k == "text" else "false"
    hinted = has(c, V.IDENTIFIER_NAME_HINTS)
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN filled = 0 THEN 'text' WHEN all_truth AND words <= 2 THEN 'boolean'
  WHEN {'true' if k == 'time' else 'false'} OR ({text} AND date_share >= 0.85) THEN 'date'
  WHEN {text} AND (padded > 0.1 OR uuid >= 0.9 OR (hex >= 0.9 AND d / filled > 0.9) OR (code >= 0.9 AND d / filled >= 0.5)
       OR (lengths <= 2 AND d / filled > 0.95 AND {hinted} AND plain)) THEN 'identifier'
  WHEN NOT numbers THEN 'text' WHEN {has(c, V.FINANCIAL_KEYWORDS)} AND NOT {has(c, V.RATIO_NAME_HINTS)} AND NOT (hi <= 1 AND lo >= 0) THEN 'currency'
  WHEN NOT whole THEN 'float' WHEN d / filled > 0.98 AND {hinted} THEN 'identifier' WHEN steady THEN 'integer_ordinal'
  WHEN d / filled <= 0.2 THEN 'integer_nominal' ELSE 'integer_continuous' END AS column_type FROM ({stats})"""


TYPES = S.union(type_sql(t, c, k) for t, c, k in ALL)


@query("column_types", TYPES)
def types_of_columns(spark, path):
    return column_types(spark, load_tables(spark, path)).select("table_name", "column_name", "column_type")


PAYABLE = "CASE WHEN o_orderkey % 50 = 7 THEN 'n/a' ELSE '$' || CAST(CAST(o_totalprice AS BIGINT) AS {s}) END AS payable"


@query("derived_column_types", f"""
WITH d AS (SELECT 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS order_code, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS phone_number,
  strftime(o_orderdate, '%d/%m/%Y') AS placed, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS active, o_orderkey * 5 AS ladder FROM orders)
SELECT column_name, column_type FROM (VALUES ('order_code', 'identifier'), ('phone_number', 'identifier'), ('placed', 'date'), ('active', 'boolean'), ('ladder', 'integer_ordinal')) v(column_name, column_type)
WHERE (SELECT count(*) FROM d WHERE regexp_matches(order_code, '^ORD-[0-9]+$') AND try_strptime(placed, '%d/%m/%Y') IS NOT NULL AND active IN ('Yes', 'no')) = (SELECT count(*) FROM orders)""")
def derived_column_types(spark, path):
    o = load_tables(spark, path, ["orders"])["orders"]
    d = o.select(
        F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("order_code"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("phone_number"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("placed"),
        F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("active"), (F.col("o_orderkey") * 5).alias("ladder"))
    return column_types(spark, {"d": d}).select("column_name", "column_type")


# --- labels -------------------------------------------------------------------
def rule_rows() -> str:
    out = []
    for rank, (label, confidence, pattern, share, allowed, words) in enumerate(V.LABEL_RULES):
        lst = lambda xs: "[" + ", ".join(S.quote(x) for x in xs) + "]::VARCHAR[]"
        out.append(f"({rank}, '{label}', {S.quote(pattern) if pattern else 'NULL'}, {share}, {lst(allowed)}, {lst(words)})")
    return "(VALUES " + ",\n".join(out) + ") r(rank, label, pattern, share, allowed, words)"


LABELS = f"""
WITH types AS ({TYPES}),
samples AS ({S.union(f"SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t} GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 20)" for t, c, k in ALL)}),
shares AS (SELECT table_name, column_name, {", ".join(f"avg(CASE WHEN regexp_matches(value, {S.quote(p)}) THEN 1.0 ELSE 0 END) AS s_{k}" for k, p in V.LABEL_PATTERNS.items())}
  FROM samples GROUP BY ALL),
hits AS (SELECT t.table_name, t.column_name, r.rank, r.label FROM types t LEFT JOIN shares s USING (table_name, column_name), {rule_rows()}
  WHERE (len(allowed) = 0 OR list_contains(allowed, t.column_type))
  AND (len(words) = 0 OR len(list_filter(words, lambda w: CASE WHEN contains(w, '_') THEN contains(t.column_name, w) ELSE list_contains(string_split(t.column_name, '_'), w) END)) > 0)
  AND (pattern IS NULL OR CASE pattern {" ".join(f"WHEN {S.quote(k)} THEN s_{k}" for k in V.LABEL_PATTERNS)} END >= share))
SELECT t.table_name, t.column_name, coalesce(h.label, 'unknown') AS taxonomy_label FROM types t
LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY rank) = 1) h USING (table_name, column_name)"""


@query("column_labels", LABELS)
def column_labels(spark, path):
    tables = load_tables(spark, path)
    counts = cut_lineage(value_counts(tables))
    return label_columns(column_types(spark, tables, counts=counts), counts).select("table_name", "column_name", "taxonomy_label")


@query("column_profile")
def column_profile(spark, path):
    tables = load_tables(spark, path, S.TPC)
    counts = cut_lineage(value_counts(tables))
    types = column_types(spark, tables, counts=counts)
    return P.profile(spark, tables, types.select("cid", "column_type"), counts).select(
        "table_name", "column_name", "column_type", "row_count", "null_count", "unique_count", "distribution")


@query("type_counts", f"SELECT column_type, count(*) AS columns FROM ({TYPES}) GROUP BY column_type")
def type_counts(spark, path):
    return column_types(spark, load_tables(spark, path)).groupBy("column_type").agg(F.count(F.lit(1)).alias("columns"))
