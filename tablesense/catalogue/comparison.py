"""Queries that compare results, measure drift, and evaluate runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.operators import compare as CMP, runs as R, sample as SM
from tablesense.session import load_tables


# --- results ------------------------------------------------------------------
@query("results_scored", """
SELECT * FROM (VALUES ('same rows, other order', true, true, true, 0, true), ('numbers as text', false, true, true, 0, true), ('one column more', false, false, true, 1, true),
  ('other filter', false, false, false, NULL, false), ('columns swapped', false, false, true, 0, true)) v(question, strict, normalised, relaxed_match, extra_columns, relaxed)
WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) > 1""")
def results_scored(spark, path):
    o = load_tables(spark, path, ["orders"])["orders"]
    gold = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return CMP.score_table(spark, {
        "same rows, other order": (gold.orderBy(F.desc("n")).union(gold.limit(2)), gold),
        "numbers as text": (gold.select("o_orderpriority", F.col("n").cast("string").alias("n"), "mean"), gold),
        "one column more": (gold.select("n", F.lit("x").alias("extra"), "o_orderpriority", "mean"), gold),
        "other filter": (o.where("o_orderkey % 2 = 0").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")), gold),
        "columns swapped": (gold.select("mean", "o_orderpriority", "n"), gold),
    })


NORM = ("CASE WHEN regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(round_even(CAST(v AS DOUBLE), 6) AS VARCHAR) "
        "WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]00:00:00$') THEN substring(v, 1, 10) ELSE v END")


@query("values_normalised", f"""
SELECT o_orderkey, {NORM} AS value FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS VARCHAR) WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || '.50'
  WHEN 2 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS w, trim(w) AS v FROM orders)""")
def values_normalised(spark, path):
    from pyspark.sql import types as T

    o = load_tables(spark, path, ["orders"])["orders"]
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".50"))).when(
        k == 2, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", cell.alias("v")).select("o_orderkey", CMP.normalised_value(F.col("v"), T.StringType()).alias("value"))


@query("gold_on_copy", """
SELECT * FROM (VALUES ('retyped', 'respelled'), ('blanked', 'different'), ('reordered', 'same')) v(copy, verdict) WHERE (SELECT count(*) FROM customer) > 5""")
def gold_on_copy(spark, path):
    c = load_tables(spark, path, ["customer"])["customer"].select("c_custkey", "c_mktsegment")
    copies = {"retyped": c.withColumn("c_custkey", F.col("c_custkey").cast("string")), "reordered": c.orderBy(F.desc("c_custkey")),
              "blanked": c.withColumn("c_mktsegment", F.when(F.col("c_custkey") != 3, F.col("c_mktsegment")))}
    return spark.createDataFrame([(k, CMP.gold_on_copy(c, v)) for k, v in copies.items()], "copy string, verdict string")


@query("column_drift", """
WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS s, c_name AS n FROM customer),
b AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 10 = 0 THEN c_name || '!' ELSE c_name END AS n FROM customer)
SELECT 'c_custkey' AS column_name, 'retyped' AS kinds, 0 AS values_lost, 0 AS values_gained
UNION ALL SELECT 'c_mktsegment', 'values', (SELECT count(*) FROM (SELECT s FROM a EXCEPT SELECT s FROM b)), (SELECT count(*) FROM (SELECT s FROM b EXCEPT SELECT s FROM a))
UNION ALL SELECT 'c_name', 'values', (SELECT count(*) FROM (SELECT n FROM a EXCEPT SELECT n FROM b)), (SELECT count(*) FROM (SELECT n FROM b EXCEPT SELECT n FROM a))""")
def column_drift(spark, path):
    c = load_tables(spark, path, ["customer"])["customer"]
    after = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
                     F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return CMP.column_drift(c, after, {"c_custkey": "id", "c_mktsegment": "segment", "c_name": "name"}).select(
        "column_name", F.array_join("kinds", ",").alias("kinds"), "values_lost", "values_gained")


# --- run records --------------------------------------------------------------
RECORDS = """SELECT CASE WHEN event_id % 2 = 0 THEN 'raw' ELSE 'semantic' END AS arm, event_type AS db_id, event_id {div} 2 AS question_id,
 CASE user_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty, CASE WHEN event_id % 11 = 0 THEN 'no_sql' ELSE 'answered' END AS outcome,
 event_id % 5 < 2 AS strict, event_id % 5 < 3 AS normalised, event_id % 7 < 5 AS relaxed, event_id % 7 < 6 AS relaxed_match, event_id % 6 AS extra_columns,
 value / 100 AS confidence, value AS elapsed_seconds, 1 + event_id % 3 AS n_attempts, event_id % 4 = 0 AS first_attempt_ok, event_id % 1000 AS total_tokens,
 CASE WHEN event_id % 11 <> 0 THEN 'SELECT 1' END AS predicted_sql, CASE WHEN event_id % 13 = 0 THEN 'failed' END AS predicted_error, user_id % 30 AS examples_in_store FROM {table}"""
RECORDS_SQL = RECORDS.format(div="//", table="events")


def records(spark, path):
    load_tables(spark, path, ["events"])["events"].createOrReplaceTempView("ts_events")
    return spark.sql(RECORDS.format(div="div", table="ts_events"))


METRIC_COLUMNS = """count(*) AS n, count(*) FILTER (WHERE strict) AS strict, count(*) FILTER (WHERE normalised) AS normalised, count(*) FILTER (WHERE relaxed OR normalised) AS relaxed,
 count(*) FILTER (WHERE outcome = 'answered') AS answered, count(*) FILTER (WHERE predicted_sql IS NOT NULL AND predicted_error IS NULL) AS valid_sql, sum(total_tokens)::BIGINT AS tokens"""


@query("run_metrics", f"""
WITH r AS ({RECORDS_SQL}), m AS (SELECT 'arm' AS slice, arm, NULL AS difficulty, NULL AS db_id, {METRIC_COLUMNS} FROM r GROUP BY arm
 UNION ALL SELECT 'difficulty', arm, difficulty, NULL, {METRIC_COLUMNS} FROM r GROUP BY arm, difficulty UNION ALL SELECT 'database', arm, NULL, db_id, {METRIC_COLUMNS} FROM r GROUP BY arm, db_id)
SELECT *, round((relaxed / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(relaxed / n * (1 - relaxed / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low FROM m""")
def run_metrics(spark, path):
    return R.run_metrics(records(spark, path)).select("slice", "arm", "difficulty", "db_id", "n", "strict", "normalised", "relaxed", "answered", "valid_sql", "tokens", F.round("low", 6).alias("low"))


@query("run_latency", f"""
WITH r AS ({RECORDS_SQL}), o AS (SELECT arm, elapsed_seconds AS x, row_number() OVER (PARTITION BY arm ORDER BY elapsed_seconds) AS k, count(*) OVER (PARTITION BY arm) AS n FROM r)
SELECT arm, n, round(median(x), 6) AS median_seconds, max(x) FILTER (WHERE k - 1 = least(n - 1, round_even(0.9 * (n - 1), 0)::BIGINT)) AS p90_seconds FROM o GROUP BY arm, n""")
def run_latency(spark, path):
    return R.latency(spark, records(spark, path)).withColumn("median_seconds", F.round("median_seconds", 6))


PAIRED = "count(*) AS n, count(*) FILTER (WHERE a.relaxed AND b.relaxed) AS both_correct, count(*) FILTER (WHERE NOT a.relaxed AND b.relaxed) AS semantic_only, count(*) FILTER (WHERE a.relaxed AND NOT b.relaxed) AS raw_only, count(*) FILTER (WHERE NOT a.relaxed AND NOT b.relaxed) AS neither"


@query("paired_runs", f"""
WITH r AS ({RECORDS_SQL}) SELECT a.difficulty, {PAIRED} FROM r a JOIN r b ON a.question_id = b.question_id AND a.db_id = b.db_id AND a.arm = 'raw' AND b.arm = 'semantic' GROUP BY a.difficulty""")
def paired_runs(spark, path):
    r = records(spark, path)
    return R.paired(r.where("arm = 'raw'"), r.where("arm = 'semantic'"), by=["difficulty"]).drop("mcnemar_p", "semantic_minus_raw")


@query("paired_significance")
def paired_significance(spark, path):
    r = records(spark, path)
    return R.paired(r.where("arm = 'raw'"), r.where("arm = 'semantic'"), by=["db_id"])


@query("selective_accuracy", f"""
WITH r AS ({RECORDS_SQL}) SELECT cut::DOUBLE AS min_confidence, count(*) AS n, count(*) FILTER (WHERE outcome = 'answered' AND confidence >= cut) AS kept,
 count(*) FILTER (WHERE outcome = 'answered' AND confidence >= cut AND relaxed) AS correct FROM r, (VALUES (0.3::DOUBLE), (0.45::DOUBLE), (0.6::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) c(cut) GROUP BY cut""")
def selective_accuracy(spark, path):
    return R.selective(records(spark, path)).drop("coverage", "accuracy")


@query("example_store_buckets", f"""
WITH r AS ({RECORDS_SQL}) SELECT CASE WHEN examples_in_store = 0 THEN '0' WHEN examples_in_store <= 5 THEN '1-5' WHEN examples_in_store <= 20 THEN '6-20' ELSE '21+' END AS examples,
 count(*) AS n, count(*) FILTER (WHERE relaxed) AS correct FROM r GROUP BY 1""")
def example_store_buckets(spark, path):
    return R.store_buckets(records(spark, path))


@query("verdicts_recapped", f"""
WITH r AS ({RECORDS_SQL}) SELECT arm, count(*) FILTER (WHERE (relaxed_match AND extra_columns <= 1) OR normalised) AS relaxed FROM r GROUP BY arm""")
def verdicts_recapped(spark, path):
    return R.verdicts(records(spark, path), 1).groupBy("arm").agg(F.count_if("relaxed").alias("relaxed"))


@query("retrieval_recall", """
WITH g AS (SELECT DISTINCT l_orderkey AS question, l_suppkey % 20 AS name FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS question, l_suppkey % 20 AS name FROM lineitem WHERE l_linenumber <= 4)
SELECT g.question, count(*) AS needed, count(s.name) AS sent, count(s.name) / count(*) AS recall FROM g LEFT JOIN s ON g.question = s.question AND g.name = s.name GROUP BY g.question""")
def retrieval_recall(spark, path):
    li = load_tables(spark, path, ["lineitem"])["lineitem"].select(F.col("l_orderkey").alias("question"), (F.col("l_suppkey") % 20).alias("name"), "l_linenumber")
    return R.retrieval_recall(li, li.where("l_linenumber <= 4"), ["question"], "name")


@query("questions_on_changed_columns", """
SELECT DISTINCT l_orderkey AS question FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)""")
def questions_on_changed_columns(spark, path):
    t = load_tables(spark, path, ["lineitem", "part"])
    gold = t["lineitem"].select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("name"))
    return R.touches_drift(gold, t["part"].where("p_size = 7").select(F.col("p_partkey").alias("name")), ["question"], "name")


def metric_slices_sql() -> str:
    sums = """count(*) AS n, count(*) FILTER (WHERE strict) AS strict, count(*) FILTER (WHERE normalised) AS normalised,
 count(*) FILTER (WHERE relaxed OR normalised) AS relaxed, count(*) FILTER (WHERE outcome = 'answered') AS answered, count(*) FILTER (WHERE relaxed OR normalised) / count(*) AS accuracy"""
    cut = "m JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) c(cut) ON recall >= cut"
    return f"""
WITH r AS ({RECORDS_SQL}), g AS (SELECT DISTINCT l_orderkey AS question, l_suppkey % 20 AS name FROM lineitem),
s AS (SELECT DISTINCT l_orderkey AS question, l_suppkey % 20 AS name FROM lineitem WHERE l_linenumber <= 4),
q AS (SELECT g.question, count(s.name) / count(*) AS recall FROM g LEFT JOIN s ON g.question = s.question AND g.name = s.name GROUP BY g.question),
d AS (SELECT DISTINCT l_orderkey AS question FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)),
m AS (SELECT r.*, q.recall, d.question IS NOT NULL AS changed FROM r LEFT JOIN q ON r.question_id = q.question LEFT JOIN d ON r.question_id = d.question)
SELECT 'all' AS slice, arm, NULL::BOOLEAN AS changed, NULL::DOUBLE AS min_recall, {sums} FROM m GROUP BY arm
UNION ALL SELECT 'changed', arm, changed, NULL, {sums} FROM m GROUP BY arm, changed
UNION ALL SELECT 'recall', arm, NULL, cut, {sums} FROM {cut} GROUP BY arm, cut
UNION ALL SELECT 'changed, recall', arm, changed, cut, {sums} FROM {cut} GROUP BY arm, changed, cut"""


@query("metric_slices", metric_slices_sql())
def metric_slices(spark, path):
    named = [F.col("question").alias("question_id")]
    recalls = retrieval_recall(spark, path).select(*named, "recall")
    return R.metric_slices(records(spark, path), recalls, questions_on_changed_columns(spark, path).select(*named), ["question_id"])


# --- samples ------------------------------------------------------------------
QUOTAS = """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS t FROM c),
s AS (SELECT c.*, n * 97 // t AS f, n * 97 / t - floor(n * 97 / t) AS rest FROM c, t)
SELECT lang, source, n, (f + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang DESC, source DESC) <= 97 - (SELECT sum(f) FROM s) THEN 1 ELSE 0 END)::BIGINT AS quota FROM s"""


@query("sample_quotas", QUOTAS)
def sample_quotas(spark, path):
    return SM.quotas(load_tables(spark, path, ["documents"])["documents"], ["lang", "source"], 97)


@query("stratified_sample", f"SELECT lang, source, quota AS chosen FROM ({QUOTAS}) WHERE quota > 0")
def stratified_sample(spark, path):
    d = load_tables(spark, path, ["documents"])["documents"].select("doc_id", "lang", "source")
    return SM.stratified_sample(d, ["lang", "source"], ["doc_id"], 97).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("chosen"))


@query("rest_of_questions", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rest_of_questions(spark, path):
    t = load_tables(spark, path, ["documents", "labels"])
    return SM.rest_of(t["documents"].select("doc_id", "lang"), t["labels"], ["doc_id"])


@query("run_order", """
SELECT doc_id, lang, source FROM documents ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, CASE WHEN lang IN ('fr', 'en') THEN '' ELSE lang END,
 CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END, doc_id""")
def run_order(spark, path):
    d = load_tables(spark, path, ["documents"])["documents"].select("doc_id", "lang", "source")
    return d.orderBy(*SM.run_order(["fr", "en"], ["src1", "src2"], "lang", "source", "doc_id"))
