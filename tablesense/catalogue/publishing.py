"""Queries about table types, published types, keys, references and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.catalogue.profiling import LABELS, TYPES
from tablesense.catalogue.relations import SCORED, STAR_KEYS
from tablesense.operators import dependencies as FD, foreign_keys as FK, keys as K, profile as P, publish as PB, settle, table_profile as TP
from tablesense.operators.column_types import column_types
from tablesense.operators.labels import label_columns, unknown_columns, with_overrides
from tablesense.operators.value_counts import gather_evidence, value_counts
from tablesense.session import as_catalogue, cut_lineage, load_tables, row_counts, scratch_folder

EDGES = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
         ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_linenumber", "part", "p_size"))
EDGE_SCHEMA = "from_table string, from_column string, to_table string, to_column string"
EDGE_ROWS = "(VALUES " + ", ".join("(" + ", ".join(S.quote(x) for x in e) + ")" for e in EDGES) + ") e(from_table, from_column, to_table, to_column)"
KEY_ROWS = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in STAR_KEYS) + ") k(table_name, column_name)"
COLUMN_ROWS = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, c, _ in S.columns(S.TPC)) + ") c(table_name, column_name)"


def confirmed_edges(spark):
    df = spark.createDataFrame(list(EDGES), EDGE_SCHEMA)
    return df.select(F.lit("foreign_key").alias("rel_type"), "*", F.lit("confirmed").alias("status"))


def key_columns(spark):
    return spark.createDataFrame(list(STAR_KEYS), "table_name string, column_name string")


def profiled(spark, tables):
    """Stats, types and labels of every column from one set of value counts."""
    counts = cut_lineage(value_counts(tables))
    labelled = label_columns(column_types(spark, tables, counts=counts), counts).select(
        "cid", "column_type", "type_confidence", "taxonomy_label", "label_confidence")
    samples = P.top_values(counts, 5).groupBy("cid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample_values"))
    return as_catalogue(P.basic_stats(tables, counts=counts).join(labelled, "cid").join(samples, "cid", "left"))


COUNTS = S.union(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS u, count(DISTINCT {c}) / count({c}) AS r FROM {t}" for t, c, _ in S.columns(S.TPC))
KEYED = "(" + " OR ".join(f"(table_name = '{t}' AND column_name = '{c}')" for t, c in STAR_KEYS) + ")"


@query("column_roles", f"""
WITH f AS (SELECT * FROM ({TYPES}) JOIN ({LABELS}) USING (table_name, column_name) JOIN ({COUNTS}) USING (table_name, column_name)),
e AS (SELECT *, CASE WHEN column_type = 'boolean' THEN true WHEN column_type IN ('float', 'currency', 'date') THEN false
  WHEN taxonomy_label IN {S.in_list(V.ENUM_LABELS)} THEN true ELSE u > 1 AND u <= 25 AND r <= 0.5 END AS enum,
  column_type IN {S.in_list(V.NUMERIC_COLUMN_TYPES)} AS is_numeric FROM f),
m AS (SELECT *, CASE WHEN {KEYED} THEN false WHEN taxonomy_label IN {S.in_list(V.MEASURE_LABELS)} THEN true WHEN taxonomy_label IN {S.in_list(V.NON_MEASURE_LABELS)} THEN false
  WHEN NOT is_numeric OR column_type = 'integer_nominal' THEN false ELSE NOT enum END AS is_measure FROM e)
SELECT table_name, column_name, is_numeric, is_measure, enum AND NOT is_measure AS is_enum FROM m""")
def column_roles(spark, path):
    columns = profiled(spark, load_tables(spark, path, S.TPC))
    marked = TP.structural(columns, key_columns(spark), confirmed_edges(spark).limit(0))
    return TP.column_roles(marked).select("table_name", "column_name", "is_numeric", "is_measure", "is_enum")


def understood(spark, path):
    """Keys, references, dependencies, columns and table profiles of the star schema."""
    tables = load_tables(spark, path, S.TPC)
    evidence = gather_evidence(tables)
    found = K.discover_keys(tables, max_depth=1, evidence=evidence)
    single = {t: a.primary_key[0] for t, a in found.items() if len(a.primary_key) == 1}
    references = settle.settle_foreign_keys(spark, FK.foreign_keys(spark, tables, single, evidence=evidence))
    inner = as_catalogue(FD.dependencies(spark, tables, {t: [c] for t, c in single.items()}, evidence).where("exact"))
    edges = references.select(F.lit("foreign_key").alias("rel_type"), *FK.PAIR, "status").unionByName(inner.select(
        F.lit("functional_dependency").alias("rel_type"), F.col("table_name").alias("from_table"), F.col("determinant").alias("from_column"),
        F.col("table_name").alias("to_table"), F.col("dependent").alias("to_column"), F.lit("confirmed").alias("status")))
    keys = spark.createDataFrame(list(single.items()), "table_name string, column_name string")
    columns = profiled(spark, tables)
    features = as_catalogue(TP.table_features(spark, as_catalogue(row_counts(tables)), columns, keys, as_catalogue(edges)))
    return tables, columns, keys, edges, TP.table_types(TP.table_labels(features))


@query("table_types")
def table_types(spark, path):
    return understood(spark, path)[-1].select("table_name", "table_type", "type_confidence", "rationale", "row_count", "column_count")


@query("table_labels")
def table_labels(spark, path):
    return understood(spark, path)[-1].select("table_name", F.explode("labels").alias("label"))


@query("table_sentences")
def table_sentences(spark, path):
    tables, columns, keys, edges, profiles = understood(spark, path)
    confirmed = settle.relationship_map(edges).select(
        "table_name", F.transform("references", lambda r: F.concat(r["to_table"], F.lit(" through "), F.regexp_replace(r["from_column"], "_", " "))).alias("references"),
        F.col("referenced_by").alias("_by"))
    names = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("taxonomy_label").isin(*V.ADDITIVE_LABELS), F.col("column_name")))).alias("additive"),
        F.array_sort(F.collect_list(F.when(~F.col("taxonomy_label").isin(*V.ADDITIVE_LABELS), F.col("column_name")))).alias("rest"))
    empty = F.array().cast("array<string>")
    joined = profiles.join(confirmed, "table_name", "left").join(names, "table_name", "left").select(
        "table_name", "table_type", "row_count", "column_count", "primary_key", F.coalesce("references", empty).alias("references"),
        F.coalesce("_by", empty).alias("referenced_by"), "additive", F.array_except(F.array_except("rest", "primary_key"), "outgoing").alias("others"))
    return PB.table_sentences(joined)


def fit_sql(t: str, c: str, k: str) -> str:
    x = f"{c}::DOUBLE" if k in ("int", "float") else "NULL::DOUBLE"
    cell = f"CASE WHEN {c} = floor({c}) THEN CAST({c}::BIGINT AS VARCHAR) ELSE CAST({c} AS VARCHAR) END" if k == "float" else f"CAST({c} AS VARCHAR)"
    lost = ", ".join(f"count(*) FILTER (WHERE abs({x} - round_even({x}, {s})) >= 1e-9) AS lost{s}" for s in (2, 4, 6, 8))
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, max(length({cell})) AS longest, max(abs({x})) AS largest, {lost} FROM {t}"


FITTED = f"""
SELECT table_name, column_name, column_type, CASE column_type WHEN 'integer_continuous' THEN 'NUMERIC' WHEN 'integer_ordinal' THEN CASE WHEN largest > 2147483647 THEN 'BIGINT' ELSE 'INTEGER' END
  WHEN 'integer_nominal' THEN CASE WHEN longest > 50 THEN 'TEXT' ELSE 'VARCHAR(50)' END WHEN 'identifier' THEN CASE WHEN longest > 100 THEN 'TEXT' ELSE 'VARCHAR(100)' END
  WHEN 'currency' THEN CASE WHEN scale IS NULL THEN 'NUMERIC' ELSE 'NUMERIC(' || greatest(15, digits + scale) || ',' || scale || ')' END
  WHEN 'date' THEN 'TIMESTAMP' WHEN 'boolean' THEN 'BOOLEAN' WHEN 'float' THEN 'DOUBLE PRECISION' ELSE 'TEXT' END AS sql_type
FROM (SELECT *, CASE WHEN lost2 = 0 THEN 2 WHEN lost4 = 0 THEN 4 WHEN lost6 = 0 THEN 6 WHEN lost8 = 0 THEN 8 END AS scale,
  CASE WHEN largest < 1 THEN 1 ELSE floor(log10(largest))::INT + 1 END AS digits FROM ({TYPES}) JOIN ({S.union(fit_sql(t, c, k) for t, c, k in S.columns())}) USING (table_name, column_name))"""


@query("published_types", FITTED)
def published_types(spark, path):
    tables = load_tables(spark, path)
    types = as_catalogue(column_types(spark, tables))
    return PB.plan_types(PB.fit_facts(spark, tables, types), types).select("table_name", "column_name", "column_type", "sql_type")


@query("published_orders", """
SELECT o_orderkey::BIGINT AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""")
def published_orders(spark, path):
    tables = {"orders": load_tables(spark, path, ["orders"])["orders"]}
    kinds = spark.createDataFrame([("orders", c, k) for c, k in (
        ("o_orderkey", "integer_ordinal"), ("o_custkey", "integer_nominal"), ("o_orderstatus", "text"), ("o_totalprice", "currency"),
        ("o_orderdate", "date"), ("o_orderpriority", "text"))], "table_name string, column_name string, column_type string")
    plan = PB.plan_names(spark, PB.plan_types(PB.fit_facts(spark, tables), kinds)).orderBy("position").collect()
    return PB.prepare_table(tables["orders"], plan).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority")


@query("published_rows", S.union(f"SELECT '{t}' AS table_name, count(*) AS rows_written FROM {t}" for t in S.TPC))
def published_rows(spark, path):
    tables = load_tables(spark, path, S.TPC)
    types = as_catalogue(column_types(spark, tables))
    plan = PB.plan_names(spark, as_catalogue(PB.plan_types(PB.fit_facts(spark, tables, types), types)))
    return PB.publish(spark, tables, plan, scratch_folder(spark, "published")).select("table_name", "rows_written")


@query("verified_keys", S.union(
    f"SELECT '{t}' AS table_name, '{c}' AS primary_key, count(*) = count(DISTINCT {c}) AS holds, count(*) - count({c}) AS blank_rows, count(*) - count(DISTINCT {c}) AS repeated_rows FROM {t}"
    for t, c in (*STAR_KEYS, ("lineitem", "l_orderkey"))))
def verified_keys(spark, path):
    tables = load_tables(spark, path, S.TPC)
    return PB.verified_keys(tables, {t: [c] for t, c in (*STAR_KEYS, ("lineitem", "l_orderkey"))})


@query("reference_status", f"""
WITH t AS ({FITTED}), o AS ({S.union(f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column, count(DISTINCT {b}) AS orphan_values FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c})" for a, b, c, d in EDGES)}),
k AS (SELECT table_name, column_name, CASE WHEN sql_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN sql_type LIKE 'NUMERIC%' THEN 'numeric' WHEN sql_type = 'DOUBLE PRECISION' THEN 'float' WHEN sql_type = 'BOOLEAN' THEN 'boolean' ELSE 'text' END AS kind FROM t)
SELECT o.*, (o.to_table, o.to_column) IN (SELECT (table_name, column_name) FROM {KEY_ROWS}) AND a.kind = b.kind AND orphan_values = 0 AS enforced
FROM o JOIN k a ON a.table_name = o.from_table AND a.column_name = o.from_column JOIN k b ON b.table_name = o.to_table AND b.column_name = o.to_column""")
def reference_status(spark, path):
    tables = load_tables(spark, path, S.TPC)
    types = as_catalogue(column_types(spark, tables))
    plan = as_catalogue(PB.plan_types(PB.fit_facts(spark, tables, types), types))
    keys = PB.verified_keys(tables, {t: [c] for t, c in STAR_KEYS})
    return PB.reference_status(tables, plan, confirmed_edges(spark), keys).drop("reason", "deferrable")


@query("roles_projected", f"""
SELECT c.table_name, c.column_name, k.column_name IS NOT NULL AS is_primary_key, e.from_column IS NOT NULL AS is_foreign_key, e.to_table AS references_table, e.to_column AS references_column
FROM {COLUMN_ROWS} LEFT JOIN {KEY_ROWS} ON k.table_name = c.table_name AND k.column_name = c.column_name
LEFT JOIN {EDGE_ROWS} ON e.from_table = c.table_name AND e.from_column = c.column_name""")
def roles_projected(spark, path):
    """Key flags from verified keys, so the work is the verification of whole tables."""
    tables = load_tables(spark, path, S.TPC)
    held = PB.verified_keys(tables, {t: [c] for t, c in STAR_KEYS}).where("holds").select("table_name", F.col("primary_key").alias("column_name"))
    columns = spark.createDataFrame([(t, c) for t, c, _ in S.columns(S.TPC)], "table_name string, column_name string")
    return settle.project_roles(columns, held, confirmed_edges(spark))


@query("relationship_map", SCORED + """,
s AS (SELECT * FROM best WHERE overlap >= 0.98 AND name_similarity >= 0.45)
SELECT table_name, max(outgoing) AS outgoing FROM (SELECT from_table AS table_name, string_agg(from_column || '>' || to_table, ', ' ORDER BY from_column, to_table) AS outgoing FROM s GROUP BY 1) GROUP BY table_name""")
def relationship_map(spark, path):
    tables = load_tables(spark, path, S.TPC)
    evidence = gather_evidence(tables)
    single = {t: a.primary_key[0] for t, a in K.discover_keys(tables, max_depth=1, evidence=evidence).items() if len(a.primary_key) == 1}
    found = FK.foreign_keys(spark, tables, single, evidence=evidence).withColumn("status", settle.verdict()).withColumn("rel_type", F.lit("foreign_key"))
    return settle.relationship_map(found).where("references IS NOT NULL").select(
        "table_name", F.array_join(F.transform("references", lambda r: F.concat_ws(">", r["from_column"], r["to_table"])), ", ").alias("outgoing"))


@query("relationship_graph", f"""
WITH n AS ({S.union(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count" for t in S.TPC)})
SELECT n.table_name, n.row_count, count(e.from_table) AS links FROM n LEFT JOIN {EDGE_ROWS} ON n.table_name IN (e.from_table, e.to_table) GROUP BY ALL""")
def relationship_graph(spark, path):
    nodes, links = settle.relationship_graph(row_counts(load_tables(spark, path, S.TPC)), confirmed_edges(spark))
    ends = links.select(F.explode(F.array_distinct(F.array("from_table", "to_table"))).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("links"))
    return nodes.join(ends, "table_name", "left").select("table_name", "row_count", F.coalesce("links", F.lit(0)).alias("links"))


@query("decisions_merged", SCORED + """,
stored AS (SELECT * FROM (VALUES ('orders', 'o_custkey', 'customer', 'c_custkey', 'rejected', 'person', 'detected'), ('nation', 'n_name', 'region', 'r_name', 'proposed', NULL, 'detected'),
  ('customer', 'c_name', 'nation', 'n_name', 'confirmed', NULL, 'manual'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey', 'confirmed', 'auto', 'detected')) v(from_table, from_column, to_table, to_column, status, decided_by, origin))
SELECT coalesce(s.from_table, b.from_table) AS from_table, coalesce(s.from_column, b.from_column) AS from_column, coalesce(s.to_table, b.to_table) AS to_table,
  coalesce(s.to_column, b.to_column) AS to_column, coalesce(s.status, 'proposed') AS status, s.decided_by
FROM stored s FULL JOIN best b ON s.from_table = b.from_table AND s.from_column = b.from_column AND s.to_table = b.to_table AND s.to_column = b.to_column
WHERE b.score IS NOT NULL OR s.origin = 'manual' OR (s.status <> 'proposed' AND coalesce(s.decided_by, '') <> 'auto')""")
def decisions_merged(spark, path):
    tables = load_tables(spark, path, S.TPC)
    evidence = gather_evidence(tables)
    single = {t: a.primary_key[0] for t, a in K.discover_keys(tables, max_depth=1, evidence=evidence).items() if len(a.primary_key) == 1}
    found = FK.foreign_keys(spark, tables, single, evidence=evidence).withColumn("rel_type", F.lit("foreign_key"))
    stored = spark.createDataFrame([
        ("foreign_key", "orders", "o_custkey", "customer", "c_custkey", "rejected", "person", "detected", 0.5),
        ("foreign_key", "nation", "n_name", "region", "r_name", "proposed", None, "detected", 0.5),
        ("foreign_key", "customer", "c_name", "nation", "n_name", "confirmed", None, "manual", 0.5),
        ("foreign_key", "lineitem", "l_orderkey", "orders", "o_orderkey", "confirmed", "auto", "detected", 0.5),
    ], "rel_type string, from_table string, from_column string, to_table string, to_column string, status string, decided_by string, origin string, score double")
    return settle.merge_decisions(stored, found).select(*FK.PAIR, "status", "decided_by")


def metadata(spark, path):
    tables = load_tables(spark, path, S.TPC)
    columns = profiled(spark, tables)
    plan = PB.plan_types(PB.fit_facts(spark, tables, columns), columns.select("table_name", "column_name", "column_type"))
    roles = settle.project_roles(columns, key_columns(spark), confirmed_edges(spark))
    joined = (
        roles.join(plan.select("table_name", "column_name", "sql_type"), ["table_name", "column_name"])
        .select("table_name", "column_name", "position", F.col("column_type").alias("data_type"), "sql_type", "taxonomy_label", "is_primary_key", "is_foreign_key",
                "references_table", "references_column", "null_ratio", "row_count", "sample_values", F.lit("").alias("description"), F.lit("data").alias("table_type"))
    )
    return as_catalogue(PB.metadata_rows(as_catalogue(joined)))


@query("sem_metadata", f"""
SELECT f.table_name, f.column_name, f.column_type AS data_type, f.sql_type, l.taxonomy_label, k.column_name IS NOT NULL AS is_primary_key, e.from_column IS NOT NULL AS is_foreign_key,
  e.to_table AS references_table, l.taxonomy_label IN {S.in_list(V.ADDITIVE_LABELS)} AS is_additive, k.column_name IS NULL AS is_nullable
FROM ({FITTED}) f JOIN ({LABELS}) l USING (table_name, column_name) JOIN {COLUMN_ROWS} ON c.table_name = f.table_name AND c.column_name = f.column_name
LEFT JOIN {KEY_ROWS} ON k.table_name = f.table_name AND k.column_name = f.column_name LEFT JOIN {EDGE_ROWS} ON e.from_table = f.table_name AND e.from_column = f.column_name""")
def sem_metadata(spark, path):
    return metadata(spark, path).select("table_name", "column_name", "data_type", "sql_type", "taxonomy_label", "is_primary_key", "is_foreign_key",
                                        "references_table", "is_additive", "is_nullable")


@query("metadata_sentences")
def metadata_sentences(spark, path):
    return metadata(spark, path).select("table_name", "column_name", "semantic_description", F.size("embedding").alias("dimensions"))


@query("layer_bundle")
def layer_bundle(spark, path):
    return PB.bundle(metadata(spark, path))


@query("unknown_columns", f"SELECT table_name, column_name FROM ({LABELS}) WHERE taxonomy_label = 'unknown'")
def unlabelled(spark, path):
    tables = load_tables(spark, path)
    counts = cut_lineage(value_counts(tables))
    return unknown_columns(label_columns(column_types(spark, tables, counts=counts), counts)).select("table_name", "column_name")


@query("types_overridden", f"""
SELECT table_name, column_name, column_type, CASE WHEN column_name = 'o_custkey' THEN 'identifier' ELSE column_type END AS effective_type FROM ({TYPES})""")
def types_overridden(spark, path):
    overrides = spark.createDataFrame([("orders", "o_custkey", "identifier", None)], "table_name string, column_name string, user_type string, user_label string")
    types = column_types(spark, load_tables(spark, path)).withColumn("taxonomy_label", F.lit("unknown"))
    return with_overrides(types, overrides).select("table_name", "column_name", "column_type", "effective_type")


GAPS = S.union(
    f"SELECT 'documents' AS table_name, '{c}' AS column_name, 1 - count({e}) / count(*) AS null_ratio, count(DISTINCT {e}) / count({e}) AS unique_ratio FROM documents"
    for c, e in (("doc_id", "doc_id"), ("text", "CASE WHEN doc_id % 4 <> 0 THEN text END"), ("lang", "lang"), ("source", "CASE WHEN doc_id % 3 <> 0 THEN source END"), ("n_chars", "n_chars")))


@query("quality_scores", f"""
SELECT table_name, round(100 * (1 - avg(null_ratio)), 1) AS completeness, round(100 * avg(unique_ratio), 1) AS uniqueness FROM ({GAPS}) GROUP BY table_name""")
def quality_scores(spark, path):
    d = load_tables(spark, path, ["documents"])["documents"]
    gappy = d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"), "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"), "n_chars")
    stats = P.basic_stats({"documents": gappy}).select(
        "table_name", (F.col("null_count") / F.col("row_count")).alias("null_ratio"), (F.col("unique_count") / F.col("non_null_count")).alias("unique_ratio"),
        F.lit(1.0).alias("type_confidence"), F.lit(1.0).alias("label_confidence"))
    return PB.quality(stats).select("table_name", "completeness", "uniqueness")


WRITTEN = ("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'No description yet: documents.' || source ELSE 'the source called ' || source END")


@query("written_share", f"""
SELECT lang AS dataset, count(*) AS columns, count(*) FILTER (WHERE doc_id % 4 >= 2) AS written, count(*) FILTER (WHERE doc_id % 3 = 0) AS unknown_labels FROM documents GROUP BY lang""")
def written_share(spark, path):
    d = load_tables(spark, path, ["documents"])["documents"]
    return PB.written_share(d.select(F.col("lang").alias("dataset"), F.expr(WRITTEN).alias("description"),
                                     F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise("note").alias("taxonomy_label")))
