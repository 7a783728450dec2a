"""Queries that find what a question needs and answer it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.catalogue.text import terms_sql
from tablesense.operators import answer as A, retrieve as R
from tablesense.session import load_tables

CENTRES = "SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label"


@query("nearest_neighbours", f"""
WITH c AS ({CENTRES}), s AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS sim FROM c, embeddings)
SELECT query_id, vec_id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 8""")
def nearest_neighbours(spark, path):
    e = load_tables(spark, path, ["embeddings"])["embeddings"]
    centres = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return R.nearest(centres, e, "label", "vec_id", "embedding", 8).withColumn("similarity", F.round("similarity", 6))


@query("tables_ranked", f"""
WITH c AS ({CENTRES}), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT 'table_' || query_id AS table_name, round(list_cosine_similarity(c.q, v), 6) AS score, row_number() OVER (ORDER BY list_cosine_similarity(c.q, v) DESC, query_id) AS rank FROM c, q QUALIFY rank <= 8""")
def tables_ranked(spark, path):
    e = load_tables(spark, path, ["embeddings"])["embeddings"]
    question = e.orderBy("vec_id").limit(1).first().embedding
    tables = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    from tablesense.functions.vectors import cosine

    scored = tables.select(F.concat(F.lit("table_"), F.col("label").cast("string")).alias("table_name"),
                           cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in question])).alias("score"), F.lit(True).alias("ranked"))
    return R.select_tables(scored).select("table_name", F.round("score", 6).alias("score"), "rank")


@query("references_expanded", """
WITH r AS (SELECT DISTINCT 'u' || user_id AS f, 'e' || event_type AS t FROM events), s AS (SELECT DISTINCT f FROM r WHERE f IN ('u1', 'u2'))
SELECT f AS table_name FROM s UNION SELECT t FROM r WHERE f IN (SELECT f FROM s) UNION SELECT f FROM r WHERE t IN (SELECT f FROM s)""")
def references_expanded(spark, path):
    e = load_tables(spark, path, ["events"])["events"]
    refs = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("from_table"), F.concat(F.lit("e"), "event_type").alias("to_table")).distinct()
    return R.expand_by_references(refs.where(F.col("from_table").isin("u1", "u2")).select(F.col("from_table").alias("table_name")), refs)


@query("recent_turns", """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (
  SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)""")
def recent_turns(spark, path):
    c = load_tables(spark, path, ["conversations"])["conversations"].select("conv_id", "turn", "role")
    return R.recent_turns(c, "conv_id", "turn", 3)


def similar_sql() -> str:
    return ("SELECT c.conv_id, c.turn, c.text AS question, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS similarity, "
            "array_to_string(regexp_extract_all(lower(c.text), '[a-z0-9]+'), ' ') = (SELECT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') FROM conversations WHERE conv_id = 1 AND turn = 0) AS same_question "
            "FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE c.role = 'user'")


@query("examples_ranked", f"""
SELECT conv_id, turn, same_question, round(similarity, 6) AS similarity FROM ({similar_sql()}) ORDER BY same_question DESC, similarity DESC, question LIMIT 3""")
def examples_ranked(spark, path):
    from tablesense.functions.vectors import cosine

    t = load_tables(spark, path, ["conversations", "embeddings"])
    first = t["embeddings"].where("vec_id = 0").first().embedding
    asked = t["conversations"].where("conv_id = 1 AND turn = 0").first().text
    saved = t["conversations"].where("role = 'user'").join(t["embeddings"], F.col("conv_id") == F.col("vec_id")).select("conv_id", "turn", F.col("text").alias("question"), "embedding")
    ranked = R.rank_examples(saved, cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first])), asked)
    return R.worth_showing(ranked, floor=-1.0).select("conv_id", "turn", "same_question", F.round("similarity", 6).alias("similarity"))


@query("columns_selected")
def columns_selected(spark, path):
    """Columns a question needs, from the metadata of the star schema."""
    from tablesense.catalogue.publishing import metadata
    from tablesense.functions.vectors import dense_vector

    question = "total price of orders by customer segment"
    rows = metadata(spark, path)
    return R.select_columns(rows, dense_vector(F.lit(question)), R.terms_of(spark, question), ["o_orderdate"], 10).select(
        "table_name", "column_name", "is_primary_key", "is_foreign_key", F.round("score", 4).alias("score"))


@query("schema_context")
def schema_context(spark, path):
    from tablesense.catalogue.publishing import metadata

    return R.schema_context(metadata(spark, path)).select("table_name", "table_type", F.to_json("columns").alias("columns"))


# --- answering ----------------------------------------------------------------
@query("bounded_read", "SELECT least(count(*), 1000) AS rows_returned, count(*) > 1000 AS truncated FROM lineitem")
def bounded_read(spark, path):
    return A.bounded(load_tables(spark, path, ["lineitem"])["lineitem"])[1]


@query("orders_in_range", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def orders_in_range(spark, path):
    o = load_tables(spark, path, ["orders"])["orders"].select("o_orderkey", "o_totalprice", "o_orderdate")
    return A.date_filtered(o, date(1998, 1, 1), date(1999, 1, 1)).drop("o_orderdate")


MONTHLY = "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1"


@query("cards_refreshed", f"""
SELECT 'by month' AS query, true AS ok, '{{"month":"' || strftime(month, '%Y-%m-%dT%H:%M:%S') || '.000","n":' || n || '}}' AS result FROM ({MONTHLY}) WHERE month >= TIMESTAMP '1999-01-01'
UNION ALL SELECT 'stale', false, NULL
UNION ALL SELECT 'by priority', true, '{{"o_orderpriority":"' || o_orderpriority || '","n":' || count(*) || '}}' FROM orders GROUP BY o_orderpriority""")
def cards_refreshed(spark, path):
    A.register(load_tables(spark, path, ["orders"]))
    return A.refresh(spark, {
        "by month": MONTHLY.replace("date_trunc('month', o_orderdate)", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ)"),
        "stale": "SELECT no_such_column FROM orders", "by priority": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"}, date(1999, 1, 1))


@query("saved_answer", "SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def saved_answer(spark, path):
    A.register(load_tables(spark, path, ["orders", "customer"]))
    saved = spark.createDataFrame([
        ("Orders per segment?", "SELECT gone FROM orders"), ("orders, per SEGMENT", "SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
        ("top 5", "SELECT 1")], "question string, sql string")
    return A.answer_saved(spark, saved, "orders per segment!")


@query("result_shapes")
def result_shapes(spark, path):
    A.register(load_tables(spark, path, ["orders", "customer"]))
    asked = {
        "total": "SELECT count(*) AS n FROM orders", "by day": "SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1",
        "by segment": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", "by status": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
        "by month": "SELECT date_format(o_orderdate, 'yyyy-MM') AS m, count(*) AS n, avg(o_totalprice) AS a FROM orders GROUP BY 1", "rows": "SELECT * FROM orders"}
    rows = [(name, A.result_shape(spark.sql(sql))["chart"]) for name, sql in asked.items()]
    return spark.createDataFrame(rows, "query string, chart string")


STAR = """SELECT n_name, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' GROUP BY n_name"""


@query("star_join_answer", STAR)
def star_join_answer(spark, path):
    A.register(load_tables(spark, path, ["customer", "orders", "lineitem", "nation", "region"]))
    return spark.sql(STAR)


SETS = """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal < 0"""


@query("set_answer", SETS)
def set_answer(spark, path):
    A.register(load_tables(spark, path, ["orders", "customer", "supplier"]))
    return spark.sql(SETS)
