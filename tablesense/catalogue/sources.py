"""Queries that read sources: delimited text, COPY lines, record lines, inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.session import load_tables, scratch_folder
from tablesense.sources import readers as R, snapshots, versions


@query("delimited_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment AS c_mktsegment FROM customer")
def delimited_scan(spark, path):
    folder = scratch_folder(spark, "csv") + "/customer.csv"
    df = load_tables(spark, path, ["customer"])["customer"].select("c_custkey", "c_name", "c_mktsegment")
    df.write.option("header", True).csv(folder)
    return R.load_source(spark, folder)


@query("scan_truncated", "SELECT count(*) > 5000 AS truncated FROM lineitem")
def scan_truncated(spark, path):
    return R.scan_table(load_tables(spark, path, ["lineitem"])["lineitem"], 5000)[1]


@query("source_inspected", S.union(f"SELECT '{t}' AS table_name, {len(cols)} AS columns, (SELECT count(*) FROM {t}) AS row_count" for t, cols in S.GIVEN.items()))
def source_inspected(spark, path):
    return R.inspect_source(load_tables(spark, path)).groupBy("table_name", "row_count").agg(F.count(F.lit(1)).alias("columns"))


@query("copy_lines_decoded", r"""
SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'a' || chr(9) || 'b\' ELSE l_returnflag END AS flag FROM lineitem WHERE l_linenumber <> 7""")
def copy_lines_decoded(spark, path):
    li = load_tables(spark, path, ["lineitem"])["lineitem"]
    n = F.col("l_linenumber")
    flag = F.when(n == 1, "\\N").when(n == 2, "a\\tb\\\\").when(n == 7, "x\ty").otherwise(F.col("l_returnflag"))
    return R.decode_copy_lines(li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("\t"), flag).alias("line")), "line", ["id", "flag"])[0]


@query("records_loaded", """
SELECT role AS arm, CAST(conv_id % 7 AS VARCHAR) AS db_id, turn AS question_id, max(conv_id) AS score FROM conversations WHERE conv_id % 5 <> 0 GROUP BY ALL""")
def records_loaded(spark, path):
    c = load_tables(spark, path, ["conversations"])["conversations"]
    line = F.to_json(F.struct(F.col("role").alias("arm"), (F.col("conv_id") % 7).cast("string").alias("db_id"), F.col("turn").alias("question_id"), F.col("conv_id").alias("score")))
    lines = c.select(F.col("conv_id").alias("position"), line.alias("line")).select("position", F.when(F.col("position") % 5 == 0, F.substring("line", 1, 9)).otherwise(F.col("line")).alias("value"))
    return R.load_records(lines, "arm string, db_id string, question_id bigint, score bigint")


@query("snapshot_restored", "SELECT s_suppkey, s_name FROM supplier")
def snapshot_restored(spark, path):
    tables = {"supplier": load_tables(spark, path, ["supplier"])["supplier"].select("s_suppkey", "s_name")}
    root = scratch_folder(spark, "snapshots")
    snapshots.snapshot(tables, root, "before")
    return snapshots.restore(spark, root, "before", ["supplier"])["supplier"]


@query("layer_version_read", """
SELECT 1 AS version, p_brand AS brand, count(*) AS parts, max(p_size) AS largest FROM part GROUP BY p_brand
UNION ALL SELECT 2, p_brand, count(*), max(p_size) FROM part WHERE p_size <= 25 GROUP BY p_brand""")
def layer_version_read(spark, path):
    """Both versions of a layer, read after a third write that was interrupted."""
    part = load_tables(spark, path, ["part"])["part"]
    root = scratch_folder(spark, "layer")

    def layer(parts):
        return parts.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts"), F.max("p_size").alias("largest"))

    first, second = (versions.publish_version(layer(p), root) for p in (part, part.where("p_size <= 25")))
    versions.stage(layer(part.where("p_size <= 5")), root)
    return versions.read_version(spark, root, first).select(F.lit(first).alias("version"), "*").unionByName(
        versions.read_version(spark, root).select(F.lit(second).alias("version"), "*"))
