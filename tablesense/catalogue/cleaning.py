"""Queries that clean tables, apply reviewed steps and triage the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.catalogue.text import NULLS
from tablesense.operators import clean, duplicates, keys as K, plan, steps as ST, triage
from tablesense.operators.ranks import number_rows
from tablesense.operators.retrieve import keep_latest
from tablesense.session import load_tables, row_counts

#: The orders table as a workbook would hold it: everything is text, some of it marked or padded.
MESSY = """SELECT CAST(o_orderkey AS {s}) AS order_id,
 CASE WHEN o_orderkey % 20 = 0 THEN 'N/A' WHEN o_orderkey % 3 = 0 THEN ' $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS {s}) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS {s}) END AS amount,
 CASE WHEN o_orderkey % 25 = 0 THEN 'soon' ELSE {date} END AS placed,
 CASE WHEN o_orderkey % 10 < 6 THEN {date} ELSE o_orderpriority END AS mixed,
 CAST(o_orderkey % 90 AS {s}) || '%' AS share,
 '0' || CAST(o_custkey AS {s}) AS phone,
 CASE WHEN o_orderkey % 7 = 0 THEN '  ' || lower(o_orderpriority) ELSE o_orderpriority END AS priority,
 CAST(NULL AS {s}) AS notes FROM {t}"""
MESSY_SQL = MESSY.format(s="VARCHAR", date="strftime(o_orderdate, '%d/%m/%Y')", t="orders")


def messy_orders(spark, path):
    load_tables(spark, path, ["orders"])["orders"].createOrReplaceTempView("ts_orders")
    return spark.sql(MESSY.format(s="STRING", date="date_format(o_orderdate, 'dd/MM/yyyy')", t="ts_orders"))


def norm(c: str) -> str:
    return f"CASE WHEN lower({S.strip(c)}) IN {NULLS} THEN NULL ELSE {S.strip(c)} END"


@query("cleaned_orders", f"""
SELECT CAST({norm('order_id')} AS BIGINT) AS order_id, CAST(replace({norm('amount')}, '$', '') AS BIGINT) AS amount,
  strftime(try_strptime({norm('placed')}, '%d/%m/%Y'), '%Y-%m-%d') AS placed, {norm('mixed')} AS mixed, CAST(replace(share, '%', '') AS DOUBLE) / 100.0 AS share,
  phone, {norm('priority')} AS priority, notes FROM ({MESSY_SQL})""")
def cleaned_orders(spark, path):
    cleaned, _ = clean.clean_table(messy_orders(spark, path))
    return cleaned.withColumn("placed", F.date_format("placed", "yyyy-MM-dd"))


def clean_report_sql() -> str:
    hits = {"numeric": "regexp_matches(replace(v, '$', ''), '^[0-9]+$')", "percent": "regexp_matches(v, '^[0-9]+%$')",
            "date": "try_strptime(v, '%d/%m/%Y') IS NOT NULL OR try_strptime(v, '%m/%d/%Y') IS NOT NULL"}
    parts = []
    for c in ("order_id", "amount", "placed", "mixed", "share", "phone", "priority", "notes"):
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) - count(v) AS nulls_normalised, count(*) FILTER (WHERE {S.strip(c)} <> {c}) AS whitespace_trimmed,
 count(v) AS total, count(*) FILTER (WHERE {hits['percent']}) AS percent_hits, count(*) FILTER (WHERE {hits['numeric']}) AS numeric_hits,
 count(*) FILTER (WHERE {hits['date']}) AS date_hits, count(*) FILTER (WHERE regexp_matches(v, '^0[0-9]+$')) AS padded_hits FROM (SELECT {c}, {norm(c)} AS v FROM m)""")
    return f"""WITH m AS ({MESSY_SQL}), r AS ({S.union(parts)})
SELECT column_name, nulls_normalised, whitespace_trimmed, kind, CASE WHEN kind = 'numeric' THEN total - numeric_hits WHEN kind = 'date' THEN total - date_hits ELSE 0 END AS coerced_to_null,
  CASE WHEN kind <> 'text' THEN NULL WHEN date_hits >= numeric_hits AND date_hits > 0 THEN 'date' WHEN numeric_hits > 0 THEN 'numeric' END AS unconverted_type
FROM (SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN percent_hits >= 0.8 * total THEN 'percent' WHEN numeric_hits >= 0.8 * total AND padded_hits <= 0.1 * total THEN 'numeric'
  WHEN date_hits >= 0.8 * total THEN 'date' ELSE 'text' END AS kind FROM r)"""


@query("clean_report", clean_report_sql())
def clean_report(spark, path):
    report = clean.clean_report({"orders": messy_orders(spark, path)})
    zero = F.lit(0).cast("bigint")
    return report.select(
        "column_name", F.coalesce("nulls_normalised", zero).alias("nulls_normalised"), F.coalesce("whitespace_trimmed", zero).alias("whitespace_trimmed"),
        "kind", F.coalesce("coerced_to_null", zero).alias("coerced_to_null"), "unconverted_type")


MARKS = "SELECT *, CASE WHEN doc_id % 8 = 0 THEN 'tbd' ELSE source END AS src, CASE WHEN doc_id % 5 = 0 THEN '-' ELSE lang END AS lng FROM {}"


@query("markers_kept", f"""
WITH d AS ({MARKS.format('documents')})
SELECT 'documents' AS table_name, 'src' AS column_name, count(*) FILTER (WHERE lower(src) IN {NULLS}) AS null_like_kept FROM d
UNION ALL SELECT 'documents', 'lng', count(*) FILTER (WHERE lower(lng) IN {NULLS}) FROM d
UNION ALL SELECT 'documents', 'text', count(*) FILTER (WHERE lower({S.strip('text')}) IN {NULLS}) FROM d""")
def markers_kept(spark, path):
    load_tables(spark, path, ["documents"])["documents"].createOrReplaceTempView("ts_documents")
    return clean.markers_kept({"documents": spark.sql(MARKS.format("ts_documents")).select("src", "lng", "text")})


@query("blank_edges_dropped", """
SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN source END AS source FROM (SELECT CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS doc_id, source FROM documents) WHERE doc_id IS NOT NULL""")
def blank_edges_dropped(spark, path):
    d = load_tables(spark, path, ["documents"])["documents"]
    kept = F.col("doc_id") % 3 != 0
    df = d.select(F.when(kept, F.col("doc_id")).alias("doc_id"), F.when(kept, F.col("source")).alias("source"), F.lit(None).cast("string").alias("empty"))
    return clean.drop_empty_edges(df)


# --- reviewed steps -----------------------------------------------------------
@query("changed_cells", """
SELECT count(*) AS rows_, count(*) FILTER (WHERE upper(p_name) <> p_name) AS cells_changed FROM part""")
def changed_cells(spark, path):
    df = load_tables(spark, path, ["part"])["part"]
    return ST.changed_cells(df, "p_name", ST.standardised(df, "p_name", "upper"))


@query("deduplicated_first", """
SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def deduplicated_first(spark, path):
    df = load_tables(spark, path, ["events"])["events"].select("event_id", "user_id", "event_type", "value")
    return ST.deduplicate(df, ["user_id", "event_type"], "first", ["event_id"])


@query("deduplicated_last", """
SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def deduplicated_last(spark, path):
    df = load_tables(spark, path, ["events"])["events"].select("event_id", "user_id", "event_type", "value")
    return ST.deduplicate(df, ["user_id", "event_type"], "last", ["event_id"])


@query("never_repeated", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1""")
def never_repeated(spark, path):
    df = load_tables(spark, path, ["lineitem"])["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
    return ST.deduplicate(df, ["l_orderkey", "l_linenumber"], False)


@query("rows_numbered", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_id, l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def rows_numbered(spark, path):
    df = load_tables(spark, path, ["lineitem"])["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ST.add_synthetic_key(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_suppkey", "l_extendedprice")


@query("tables_merged", """
SELECT o.o_orderkey, o.k, c.name, c.note AS note_customer, o.note FROM
 (SELECT o_orderkey, CASE WHEN o_orderkey % 40 <> 0 THEN o_custkey END AS k, o_orderstatus AS note FROM orders) o
 LEFT JOIN (SELECT CASE WHEN c_custkey <> 1 THEN c_custkey END AS k, c_name AS name, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 1) c ON o.k IS NOT DISTINCT FROM c.k""")
def tables_merged(spark, path):
    t = load_tables(spark, path, ["orders", "customer"])
    left = t["orders"].select("o_orderkey", F.when(F.col("o_orderkey") % 40 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderstatus").alias("note"))
    right = t["customer"].where("c_custkey % 2 = 1").select(
        F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    return ST.merge_tables(left, right, "k", "k", "left", "customer")


@query("tables_merged_outer", """
SELECT n_name, n_regionkey, r_regionkey, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) r ON n.n_regionkey = r.r_regionkey""")
def tables_merged_outer(spark, path):
    t = load_tables(spark, path, ["nation", "region"])
    return ST.merge_tables(t["nation"].where("n_regionkey < 3").select("n_name", "n_regionkey"), t["region"].where("r_regionkey > 1"), "n_regionkey", "r_regionkey", "outer", "region")


@query("unmatched_left_rows", """
SELECT count(*) AS unmatched_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)""")
def unmatched_left_rows(spark, path):
    t = load_tables(spark, path, ["orders", "customer"])
    return ST.unmatched_left(t["orders"], t["customer"].where("c_custkey % 2 = 1"), "o_custkey", "c_custkey")


@query("plan_applied", """
SELECT DISTINCT upper(p_brand) AS brand, p_type, trim(string_split(p_name, ' ')[1]) AS colour,
  CASE WHEN contains(p_name, ' ') THEN substring(p_name, strpos(p_name, ' ') + 1) END AS thing, p_size::DOUBLE AS p_size FROM part""")
def plan_applied(spark, path):
    df = load_tables(spark, path, ["part"])["part"].select("p_brand", "p_name", "p_type", F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("p_size"), "p_retailprice")
    steps = [
        ST.Step("deduplicate", "part"), ST.Step("type_cast", "part", {"column": "p_size", "to": "numeric"}),
        ST.Step("standardize_casing", "part", {"column": "brand", "casing": "upper"}), ST.Step("rename_column", "part", {"column": "p_brand", "new_name": "brand"}),
        ST.Step("drop_column", "part", {"column": "p_retailprice"}), ST.Step("split_column", "part", {"column": "p_name", "into": ["colour", "thing"], "delimiter": " "}),
        ST.Step("drop_column", "part", {"column": "p_missing"}), ST.Step("impute", "part", {"column": "p_size"}),
    ]
    tables, _ = ST.run_plan({"part": df}, steps)
    return tables["part"].drop("p_name").dropDuplicates()


def reviewed_steps():
    """A plan over parts with sizes as text, and events: one step names a column that is not there, one is forbidden."""
    return [
        ST.Step("deduplicate", "events", {"subset": ["user_id", "event_type"]}), ST.Step("type_cast", "part", {"column": "p_size", "to": "numeric"}),
        ST.Step("standardize_casing", "part", {"column": "brand", "casing": "lower"}), ST.Step("rename_column", "part", {"column": "p_brand", "new_name": "brand"}),
        ST.Step("strip_whitespace", "part", {"column": "p_name"}), ST.Step("drop_column", "part", {"column": "p_missing"}),
        ST.Step("impute", "part", {"column": "p_size"})]


SIZES = "CASE WHEN p_partkey % 7 = 0 THEN 'big' WHEN p_partkey % 2 = 0 THEN ' ' || CAST(p_size AS {}) ELSE CAST(p_size AS {}) END"


def step_tables(spark, path):
    t = load_tables(spark, path, ["part", "events"])
    part = t["part"].withColumn("p_size", F.expr(SIZES.format("STRING", "STRING"))).withColumn(
        "p_name", F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' ELSE p_name END"))
    return {"part": part, "events": t["events"].select("event_id", "user_id", "event_type")}


def ran(place, step, table, column, note, before="n", after="n", changed="0", blanked="0", source="part"):
    """One row of what a step did, from a count over its table."""
    texts = ", ".join(f"{'NULL::VARCHAR' if x is None else S.quote(x)} AS {c}" for c, x in (("step", step), ("table_name", table), ("column_name", column), ("note", note)))
    return (f"SELECT {place} AS place, {texts}, {before} AS rows_before, {after} AS rows_after, {changed} AS cells_changed, {blanked} AS cells_blanked, "
            f"greatest({before} - {after}, 0) AS rows_removed FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS padded, "
            f"count(*) FILTER (WHERE lower(p_brand) <> p_brand) AS cased, count(*) FILTER (WHERE p_partkey % 7 = 0) AS words FROM part) p, "
            f"(SELECT count(*) AS e, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS kept FROM events) e")


@query("step_outcomes", S.union([
    ran(0, "drop_column", "part", "p_missing", "not applied: StepError", "NULL::BIGINT", "NULL::BIGINT", "NULL::BIGINT", "NULL::BIGINT"),
    ran(1, "rename_column", "part", "p_brand", "now brand"), ran(2, "type_cast", "part", "p_size", None, changed="n", blanked="words"),
    ran(3, "strip_whitespace", "part", "p_name", None, changed="padded"), ran(4, "standardize_casing", "part", "brand", None, changed="cased"),
    ran(5, "deduplicate", "events", None, None, "e", "kept"),
    ran(6, "impute", "part", "p_size", "not applied: StepError", "NULL::BIGINT", "NULL::BIGINT", "NULL::BIGINT", "NULL::BIGINT")]))
def step_outcomes(spark, path):
    """What each step of a reviewed plan did: rows, cells changed, cells blanked, and why two were not applied."""
    return ST.step_outcomes(spark, step_tables(spark, path), reviewed_steps(), {"events": ["event_id"]})


@query("step_preview", f"""
WITH p AS (SELECT p_partkey, {SIZES.format('VARCHAR', 'VARCHAR')} AS s FROM part),
e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events)
SELECT 'trimmed' AS preview, * FROM (SELECT row_number() OVER (ORDER BY p_partkey)::INT AS position, p_partkey::VARCHAR AS row_key, 'p_size' AS column_name, s AS before, trim(s) AS after
  FROM p WHERE trim(s) <> s ORDER BY p_partkey LIMIT 10)
UNION ALL SELECT 'repeated', * FROM (SELECT row_number() OVER (ORDER BY event_id)::INT, event_id::VARCHAR, NULL, user_id || '|' || event_type, NULL
  FROM e WHERE r > 1 ORDER BY event_id LIMIT 10)""")
def step_preview(spark, path):
    """The first ten cells that trimming changes, and the first ten rows that a de-duplication removes."""
    t = step_tables(spark, path)
    parts = {"trimmed": ST.step_preview(t["part"], ST.Step("strip_whitespace", "part", {"column": "p_size"}), ["p_partkey"]),
             "repeated": ST.step_preview(t["events"], ST.Step("deduplicate", "events", {"subset": ["user_id", "event_type"]}), ["event_id"])}
    return parts["trimmed"].select(F.lit("trimmed").alias("preview"), "*").unionAll(parts["repeated"].select(F.lit("repeated").alias("preview"), "*"))


SPELT = "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN upper(source) WHEN doc_id % 6 = 1 THEN source || ' ' ELSE source END AS source, lang, CAST(NULL AS {}) AS empty FROM {}"


@query("proposed_plan", f"""
WITH d AS ({SPELT.format('VARCHAR', 'documents')})
SELECT 'drop_column' AS step, 'docs' AS table_name, 'empty' AS column_name, '' AS detail WHERE (SELECT count(empty) FROM d) = 0
UNION ALL SELECT 'strip_whitespace', 'docs', 'source', '' WHERE (SELECT count(*) FROM d WHERE trim(source) <> source) > 0
UNION ALL SELECT 'standardize_casing', 'docs', 'source', (SELECT CASE WHEN count(*) FILTER (WHERE upper(trim(source)) = trim(source)) >= count(*) FILTER (WHERE lower(trim(source)) = trim(source)) THEN 'upper' ELSE 'lower' END FROM d)
  WHERE (SELECT max(n) FROM (SELECT count(DISTINCT trim(source)) AS n FROM d GROUP BY lower(trim(source)))) > 1""")
def proposed_plan(spark, path):
    load_tables(spark, path, ["documents"])["documents"].createOrReplaceTempView("ts_documents")
    tables = {"docs": spark.sql(SPELT.format("STRING", "ts_documents"))}
    return plan.plan_table(spark, plan.propose_plan(spark, tables)).drop("position")


@query("latest_events", """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def latest_events(spark, path):
    df = load_tables(spark, path, ["events"])["events"]
    return keep_latest(df, ["user_id"], [F.desc("ts"), F.desc("event_id")], V.HISTORY_SIZE).select("user_id", "event_id")


@query("banded_sample")
def banded_sample(spark, path):
    return K.banded_sample(load_tables(spark, path, ["lineitem"])["lineitem"], "l_orderkey", 2000).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


# --- triage -------------------------------------------------------------------
@query("duplicate_tables", """
SELECT * FROM (VALUES ('nation_2', 'nation'), ('orders_3', 'orders')) v(copy, original)
WHERE (SELECT count(*) FROM (SELECT * FROM nation EXCEPT SELECT * FROM nation WHERE n_nationkey >= 0)) = 0""")
def duplicate_tables(spark, path):
    t = load_tables(spark, path, ["nation", "orders", "region"])
    changed = t["orders"].withColumn("o_totalprice", F.when(F.col("o_orderkey") == 3, 0.0).otherwise(F.col("o_totalprice")))
    tables = {"nation_2": t["nation"].orderBy(F.desc("n_name")), "nation": t["nation"], "orders": t["orders"], "orders_2": changed, "orders_3": t["orders"], "region": t["region"]}
    return duplicates.duplicate_tables(spark, tables)


GAPPY = """SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN NULL ELSE source END AS col_2, CASE WHEN doc_id % 10 < 3 THEN NULL ELSE lang END AS lang_2,
 CAST(NULL AS {}) AS empty FROM {}"""


@query("triage_issues", f"""
WITH d AS ({GAPPY.format('VARCHAR', 'documents')}), r AS (SELECT count(*) AS n, count(col_2) AS a, count(lang_2) AS b, count(empty) AS c FROM d)
SELECT 'docs' AS table_name, code, severity, columns FROM r, (VALUES ('unnamed_columns', 'warning', 'col_2'), ('duplicate_column_names', 'warning', 'col_2, lang_2')) v(code, severity, columns)
UNION ALL SELECT 'docs', 'empty_columns', 'warning', 'empty' FROM r WHERE c = 0
UNION ALL SELECT 'docs', 'high_null_ratio', 'warning', 'col_2' FROM r WHERE 1 - a / n > 0.5
UNION ALL SELECT 'docs', 'missing_values', 'info', 'lang_2' FROM r WHERE 1 - b / n > 0.2 AND 1 - b / n <= 0.5
UNION ALL SELECT 'few', 'too_few_rows', 'error', '' FROM (SELECT count(*) AS k FROM region WHERE r_regionkey < 2) WHERE k < 3""")
def triage_issues(spark, path):
    t = load_tables(spark, path, ["documents", "region"])
    t["documents"].createOrReplaceTempView("ts_documents")
    tables = {"docs": spark.sql(GAPPY.format("STRING", "ts_documents")), "few": t["region"].where("r_regionkey < 2"), "region": t["region"]}
    found = triage.issues(row_counts(tables), null_ratios(tables), K.key_table(spark, K.discover_keys(tables)))
    return found.withColumn("columns", F.array_join("columns", ", "))


def null_ratios(tables):
    from tablesense.operators.value_counts import column_refs, non_null_counts

    refs = column_refs(tables)
    filled = non_null_counts(tables, refs)
    spark = next(iter(tables.values())).sparkSession
    rows = [(r.table, r.column, 1 - filled[r.cid][1] / filled[r.cid][0] if filled[r.cid][0] else 0.0) for r in refs]
    return spark.createDataFrame(rows, "table_name string, column_name string, null_ratio double")


@query("triage_status", f"""
SELECT table_name, CASE WHEN n = 0 THEN 'structural_issues' WHEN n < 3 THEN 'structural_issues' ELSE 'clean' END AS status
FROM ({S.union(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in S.GIVEN if t not in ('lineitem', 'conversations'))})""")
def triage_status(spark, path):
    tables = load_tables(spark, path, [t for t in S.GIVEN if t not in ("lineitem", "conversations")])
    counts = row_counts(tables)
    found = triage.issues(counts, null_ratios(tables), K.key_table(spark, K.discover_keys(tables)))
    return triage.statuses(counts, found).select("table_name", "status")


def status_facts(table: str) -> str:
    """One row of SQL: rows, distinct rows, most distinct values of a filled column that may be a key, largest share of blanks."""
    best = ", ".join(f"CASE WHEN count({c}) = count(*) AND count(DISTINCT {c}) >= 2 THEN count(DISTINCT {c}) ELSE 0 END" for c, k in S.GIVEN[table] if k not in ("float", "array"))
    gap = ", ".join(f"1 - count({c}) / count(*)" for c, _ in S.GIVEN[table])
    return f"SELECT '{table}' AS table_name, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS u, greatest({best}) AS best, greatest({gap}) AS gap FROM {table}"


@query("triage_status_all", f"""
SELECT table_name, CASE WHEN n < 3 THEN 'structural_issues' WHEN gap > 0.5 OR best < u THEN 'needs_attention'
  WHEN gap > 0.2 OR n > u THEN 'fixable' ELSE 'clean' END AS status
FROM ({S.union(status_facts(t) for t in S.GIVEN)})""")
def triage_status_all(spark, path):
    """All given tables, with repeated rows and missing keys; ``triage_status`` covers twelve of them."""
    tables = load_tables(spark, path, list(S.GIVEN))
    keys = K.key_table(spark, K.discover_keys(tables))
    counts = row_counts(tables).join(F.broadcast(keys.select("table_name", "duplicate_rows")), "table_name")
    return triage.statuses(counts, triage.issues(counts, null_ratios(tables), keys)).select("table_name", "status")


@query("analysable_tables", f"SELECT * FROM ({S.union(f'SELECT {S.quote(t)} AS table_name, count(*) AS row_count FROM {t}' for t in S.GIVEN)}) WHERE row_count >= 3")
def analysable_tables(spark, path):
    return triage.analysable(row_counts(load_tables(spark, path)))
