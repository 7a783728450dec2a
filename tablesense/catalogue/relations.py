"""Queries that find keys, references, equivalent columns and dependencies."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.operators import foreign_keys as FK, keys as K
from tablesense.operators.value_counts import column_catalogue, column_refs, gather_evidence, overlaps
from tablesense.session import load_tables

#: Single-column keys of the star schema, spelled out in the SQL only.
STAR_KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"),
             ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))
ORDER = {t: i for i, t in enumerate(S.TPC)}
INTS = S.columns(S.TPC, ("int",))
PAIRS = S.union(
    f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{kt}' AS to_table, '{kc}' AS to_column, {ORDER[kt]} AS target_order, "
    f"(SELECT count(*) FROM {t}) AS from_rows, (SELECT count(*) FROM {kt}) AS to_rows, "
    f"(SELECT count(DISTINCT {c}) FROM {t}) AS source_distinct, (SELECT count(DISTINCT {kc}) FROM {kt}) AS target_distinct, "
    f"(SELECT count(DISTINCT {c}) FROM {t} WHERE {c} IN (SELECT {kc} FROM {kt})) AS matched"
    for t, c, _ in INTS for kt, kc in STAR_KEYS if (t, c) != (kt, kc)
)
NAMES = f"""
pairs AS ({PAIRS}),
sides AS (
  SELECT from_column, to_column, 1 AS side, unnest({S.grams('a')}) AS g FROM (SELECT DISTINCT from_column, to_column, {S.normal_name('from_column')} AS a FROM pairs)
  UNION ALL
  SELECT from_column, to_column, 2, unnest({S.grams('b')}) FROM (SELECT DISTINCT from_column, to_column, {S.normal_name('to_column')} AS b FROM pairs)),
buckets AS (SELECT from_column, to_column, {S.bucket('g', 384)} AS k,
  sum(CASE WHEN side = 1 THEN {S.sign('g')} ELSE 0 END)::BIGINT AS x, sum(CASE WHEN side = 2 THEN {S.sign('g')} ELSE 0 END)::BIGINT AS y
  FROM sides GROUP BY ALL),
alike AS (SELECT from_column, to_column, sum(x * y) / sqrt(sum(x * x)::DOUBLE * sum(y * y)::DOUBLE) AS name_similarity FROM buckets GROUP BY ALL)"""
SCORED = f"""
WITH {NAMES},
scored AS (SELECT pairs.*, name_similarity, matched / source_distinct AS overlap, matched / target_distinct AS reach,
  least(1.0, {V.OVERLAP_WEIGHT} * (matched / source_distinct) + {V.REACH_WEIGHT} * (matched / target_distinct) + {V.NAME_BOOST} * greatest(0.0, name_similarity)) AS score
  FROM pairs JOIN alike USING (from_column, to_column)
  WHERE from_rows >= {V.FK_MIN_ROWS} AND to_rows >= {V.FK_MIN_ROWS} AND source_distinct >= 2),
kept AS (SELECT * FROM scored WHERE overlap >= {V.MIN_OVERLAP} AND reach > {V.MIN_REACH} AND score >= {V.FUZZY_FLOOR}),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY from_table, from_column ORDER BY score DESC, target_order) = 1)"""


def star(spark, path):
    return load_tables(spark, path, S.TPC)


def star_keys(tables, evidence):
    found = K.discover_keys(tables, max_depth=1, evidence=evidence)
    return {t: a.primary_key[0] for t, a in found.items() if len(a.primary_key) == 1}


@query("foreign_key_candidates", SCORED + """
SELECT from_table, from_column, to_table, to_column, source_distinct, target_distinct, matched,
       source_distinct - matched AS orphans, round(score, 6) AS score,
       CASE WHEN score >= 0.60 THEN 'detected' ELSE 'fuzzy' END AS origin FROM best""")
def foreign_key_candidates(spark, path):
    """Which columns of the star schema refer to which keys."""
    tables = star(spark, path)
    evidence = gather_evidence(tables)
    found = FK.foreign_keys(spark, tables, star_keys(tables, evidence), evidence=evidence)
    return found.select(
        *FK.PAIR, "source_distinct", "target_distinct", "matched",
        (F.col("source_distinct") - F.col("matched")).alias("orphans"), F.round("score", 6).alias("score"), "origin",
    )


ALL_INTS = S.columns(None, ("int",))


OVERLAPS = S.union(
    f"SELECT DISTINCT '{t}.{c}' AS col, {c}::BIGINT AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, _ in ALL_INTS)


@query("value_overlaps", f"""
WITH v AS ({OVERLAPS})
SELECT a.col AS left_column, b.col AS right_column, count(*) AS matched FROM v a JOIN v b ON a.v = b.v GROUP BY ALL""")
def value_overlaps(spark, path):
    """Distinct values every pair of whole-number columns shares, all pairs in one pass."""
    tables = {t: df.select(*[c for c, k in S.GIVEN[t] if k == "int"]) for t, df in load_tables(spark, path).items()}
    refs = column_refs(tables)
    names = F.array(*[F.lit(f"{r.table}.{r.column}") for r in refs])
    return overlaps(tables, refs).select(
        F.element_at(names, F.col("left_cid") + 1).alias("left_column"),
        F.element_at(names, F.col("right_cid") + 1).alias("right_column"), "matched",
    )


@query("small_tables", f"SELECT * FROM ({S.union(f'SELECT {S.quote(t)} AS table_name, (SELECT count(*) FROM {t}) AS row_count' for t in S.GIVEN)}) WHERE row_count < {V.FK_MIN_ROWS}")
def small_tables(spark, path):
    from tablesense.session import row_counts

    return FK.small_tables(row_counts(load_tables(spark, path)))


WHOLE = S.columns(None, ("int", "text", "time"))
COLUMN_COUNTS = S.union(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM {t}) AS row_count, "
    f"(SELECT count(DISTINCT {c}) FROM {t}) AS distinct_values" for t, c, _ in WHOLE)


@query("single_column_keys", f"SELECT table_name, column_name, distinct_values FROM ({COLUMN_COUNTS}) WHERE distinct_values = row_count")
def single_column_keys(spark, path):
    tables = load_tables(spark, path)
    evidence = gather_evidence(tables)
    rows = [
        (r.table, r.column, evidence.distinct(r)) for r in evidence.refs
        if not r.fractional and evidence.distinct(r) == evidence.filled[r.cid][0] == evidence.filled[r.cid][1]
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, distinct_values bigint")


@query("eligible_key_columns", f"""
SELECT table_name, column_name, distinct_values, row_number() OVER (PARTITION BY table_name ORDER BY distinct_values DESC, position) AS selectivity_rank
FROM (SELECT *, row_number() OVER () AS position FROM ({COLUMN_COUNTS})) WHERE distinct_values >= 2""")
def eligible_key_columns(spark, path):
    from pyspark.sql import Window

    tables = load_tables(spark, path)
    evidence = gather_evidence(tables)
    rows = [
        (r.table, r.column, evidence.distinct(r), r.cid) for r in evidence.refs
        if not r.fractional and evidence.filled[r.cid][0] == evidence.filled[r.cid][1] and evidence.distinct(r) >= 2
    ]
    w = Window.partitionBy("table_name").orderBy(F.desc("distinct_values"), "cid")
    return (
        spark.createDataFrame(rows, "table_name string, column_name string, distinct_values bigint, cid int")
        .select("table_name", "column_name", "distinct_values", F.row_number().over(w).cast("bigint").alias("selectivity_rank"))
    )


@query("order_key_holds", """
SELECT count(*) AS row_count, count(*) FILTER (WHERE o_orderkey IS NULL) AS blank_rows,
       count(*) - count(DISTINCT o_orderkey) AS repeated_rows, count(*) = count(DISTINCT o_orderkey) AS holds FROM orders""")
def order_key_holds(spark, path):
    return K.key_violations(star(spark, path)["orders"], ["o_orderkey"]).withColumnRenamed("rows_", "row_count")


@query("composite_key_violations", """
SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS repeated_rows, max(n) = 1 AS holds
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def composite_key_violations(spark, path):
    return K.key_violations(star(spark, path)["lineitem"], ["l_orderkey", "l_linenumber"]).select(
        F.col("rows_").alias("row_count"), "repeated_rows", "holds")


@query("composite_keys", """
SELECT 'conv_id + turn' AS columns WHERE (SELECT count(*) FROM conversations) = (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations))
UNION ALL SELECT 'conv_id + role' WHERE (SELECT count(*) FROM conversations) = (SELECT count(*) FROM (SELECT DISTINCT conv_id, role FROM conversations))
UNION ALL SELECT 'turn + role' WHERE (SELECT count(*) FROM conversations) = (SELECT count(*) FROM (SELECT DISTINCT turn, role FROM conversations))""")
def composite_keys(spark, path):
    df = load_tables(spark, path, ["conversations"])["conversations"].drop("text")
    found = K.discover_keys({"conversations": df})["conversations"]
    position = {c: i for i, c in enumerate(df.columns)}
    return spark.createDataFrame(
        [(" + ".join(sorted(c, key=position.get)),) for c in found.candidates], "columns string")


KEY_SCORE = "CASE WHEN regexp_matches(column_name, '(^|_)(id|key|code|no|num|number|ref|sku|uuid)(_|$)') THEN 2 WHEN regexp_matches(column_name, 'id|key|code|no|num|number|ref|sku|uuid') THEN 1 ELSE 0 END"
ROW_SETS = S.union(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows"
    for t in S.GIVEN)


@query("key_discovery", f"""
WITH c AS (SELECT *, row_number() OVER () AS position FROM ({COLUMN_COUNTS})),
k AS (SELECT table_name, column_name FROM c WHERE distinct_values = row_count
      QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY {KEY_SCORE} DESC, position) = 1)
SELECT d.table_name, d.duplicate_rows, k.column_name AS primary_key, CASE WHEN k.column_name IS NULL THEN 'none' ELSE 'detected' END AS source
FROM ({ROW_SETS}) d LEFT JOIN k USING (table_name)""")
def key_discovery(spark, path):
    tables = load_tables(spark, path)
    return K.key_table(spark, K.discover_keys(tables)).select("table_name", "duplicate_rows", "primary_key", "source")


LINE_COLUMNS = [c for t, c, k in WHOLE if t == "lineitem"]
LINE_SETS = {n: list(itertools.combinations(LINE_COLUMNS, n)) for n in (1, 2, 3)}
LINE_COUNTS = S.union(
    f"SELECT {n} AS size, [{', '.join(map(S.quote, cols))}] AS cols, "
    f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM lineitem)) = (SELECT n FROM whole) AS holds"
    for n, sets in LINE_SETS.items() for cols in sets)
LINE_SCORE = "list_sum(list_transform(cols, lambda column_name: " + KEY_SCORE + "))"


@query("lineitem_key_discovery", f"""
WITH whole AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem)),
few AS (SELECT column_name AS c FROM ({COLUMN_COUNTS}) WHERE table_name = 'lineitem' AND distinct_values >= 2),
sets AS (SELECT * FROM ({LINE_COUNTS}) WHERE holds AND list_has_all((SELECT list(c) FROM few), cols)),
first AS (SELECT * FROM sets WHERE size = (SELECT min(size) FROM sets)
          ORDER BY {LINE_SCORE} DESC, list_sum(list_transform(cols, lambda c: list_position([{', '.join(S.quote(c) for c, _ in S.GIVEN['lineitem'])}], c))) LIMIT {V.MAX_CANDIDATES})
SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS row_count, (SELECT count(*) FROM lineitem) - (SELECT n FROM whole) AS duplicate_rows,
       CASE WHEN (SELECT min(size) FROM sets) = 1 THEN 'detected' ELSE 'none' END AS source,
       coalesce((SELECT min(size) FROM sets) > 1, false) AS needs_confirmation, (SELECT count(*) FROM sets) = 0 AS needs_synthetic_key,
       coalesce((SELECT string_agg(array_to_string(list_sort(cols), ' + '), '; ' ORDER BY array_to_string(list_sort(cols), ' + ')) FROM first), '') AS candidates""")
def lineitem_key_discovery(spark, path):
    """No single column identifies a line: pairs, then triples, then a counter is asked for."""
    df = star(spark, path)["lineitem"]
    return K.key_table(spark, K.discover_keys({"lineitem": df})).select(
        "table_name", "row_count", "duplicate_rows", "source", "needs_confirmation", "needs_synthetic_key",
        # a set's order is that of its selectivity, which ties leave open: names are listed in their own order
        F.array_join(F.array_sort(F.transform("candidates", lambda c: F.array_join(F.array_sort(F.split(c, " \\+ ")), " + "))), "; ").alias("candidates"))


@query("duplicate_rows", """
SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, props FROM events)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, props FROM events)) AS duplicate_rows FROM events""")
def duplicate_rows(spark, path):
    return K.duplicate_rows(load_tables(spark, path, ["events"])["events"].select("user_id", "event_type", "props"))


# --- references: evidence and decisions ---------------------------------------
@query("reference_counts", """
SELECT count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) AS supporting_rows,
       count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) AS orphan_rows,
       count(*) FILTER (WHERE o_custkey IS NULL) AS blank_rows,
       count(DISTINCT o_custkey) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) AS orphan_values
FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders)""")
def reference_counts(spark, path):
    from tablesense.operators import evidence as E

    t = star(spark, path)
    child = t["orders"].select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"))
    return E.reference_counts(child, "o_custkey", t["customer"].where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("orphan_rows", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def orphan_rows(spark, path):
    from tablesense.operators import evidence as E

    t = star(spark, path)
    return E.orphan_rows(t["orders"].select("o_orderkey", "o_custkey"), "o_custkey",
                         t["customer"].where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("supporting_rows", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def supporting_rows(spark, path):
    from tablesense.operators import evidence as E

    t = star(spark, path)
    return E.supporting_rows(t["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber"), "l_partkey",
                             t["part"].where("p_size > 10"), "p_partkey")


@query("orphan_samples", """
SELECT 'orders' AS from_table, 'o_custkey' AS from_column, 'customer' AS to_table, 'c_custkey' AS to_column, orphan,
       row_number() OVER (ORDER BY orphan) AS position
FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS orphan FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) QUALIFY position <= 10""")
def orphan_samples(spark, path):
    t = star(spark, path)
    tables = {"orders": t["orders"], "customer": t["customer"].where("c_mktsegment <> 'BUILDING'")}
    return FK.orphan_samples(tables, [("orders", "o_custkey", "customer", "c_custkey")])


#: What a link is called in the list of those in place, from either side.
LINK, BACK = "concat_ws('|', from_table, from_column, to_table, to_column)", "concat_ws('|', to_table, to_column, from_table, from_column)"
VERDICT = f"""CASE WHEN own <> 'confirmed' THEN own WHEN list_contains(links, {BACK}) THEN 'rejected'
  WHEN name_similarity < {V.SECOND_LINK_NAME} AND list_contains(pairs, from_table || '|' || to_table) THEN 'rejected' ELSE 'confirmed' END"""


@query("references_settled", SCORED.replace("WITH", "WITH RECURSIVE", 1) + f""",
v AS (SELECT *, CASE WHEN name_similarity < 0.45 THEN 'rejected' WHEN overlap >= 0.98 THEN 'confirmed'
   WHEN overlap >= 0.90 AND name_similarity >= 0.85 THEN 'confirmed' WHEN overlap >= 0.90 THEN 'proposed' ELSE 'rejected' END AS own,
   row_number() OVER (ORDER BY score DESC, from_table, from_column, to_table, to_column) AS place FROM best),
walk AS (
  SELECT 0::BIGINT AS place, []::VARCHAR[] AS links, []::VARCHAR[] AS pairs, NULL::VARCHAR AS status
  UNION ALL
  SELECT v.place, CASE WHEN {VERDICT} = 'confirmed' THEN list_append(links, {LINK}) ELSE links END,
    CASE WHEN {VERDICT} = 'confirmed' THEN list_append(pairs, from_table || '|' || to_table) ELSE pairs END, {VERDICT}
  FROM walk JOIN v ON v.place = walk.place + 1)
SELECT from_table, from_column, to_table, to_column, walk.status FROM walk JOIN v USING (place)""")
def references_settled(spark, path):
    from tablesense.operators.settle import settle_foreign_keys

    tables = star(spark, path)
    evidence = gather_evidence(tables)
    found = FK.foreign_keys(spark, tables, star_keys(tables, evidence), evidence=evidence)
    return settle_foreign_keys(spark, found).select(*FK.PAIR, "status")


LOST = "substr(c_name, 1, 5) || substr(c_name, 7)"


@query("fuzzy_recovered", f"""
WITH k AS (SELECT DISTINCT c_name AS key FROM customer), o AS (SELECT DISTINCT {LOST} AS orphan FROM customer),
cut AS (SELECT key, substr(key, 1, i - 1) || substr(key, i + 1) AS rest FROM (SELECT key, unnest(range(1, length(key) + 1)) AS i FROM k)),
less AS (SELECT orphan, substr(orphan, 1, i - 1) || substr(orphan, i + 1) AS rest FROM (SELECT orphan, unnest(range(1, length(orphan) + 1)) AS i FROM o)),
near AS (SELECT orphan, orphan AS key, 0 AS distance FROM o WHERE orphan IN (SELECT key FROM k)
         UNION SELECT orphan, key, 1 FROM o JOIN cut ON rest = orphan UNION SELECT orphan, key, 1 FROM less JOIN k ON rest = key)
SELECT orphan, key, 100 * (1 - distance / (length(orphan) + length(key))) AS ratio FROM near
WHERE 100 * distance <= {100 - V.FUZZY_RATIO} * (length(orphan) + length(key))
QUALIFY row_number() OVER (PARTITION BY orphan ORDER BY distance, length(key) DESC, key) = 1""")
def fuzzy_recovered(spark, path):
    """Customer names with one character lost, each matched back to the nearest real name."""
    from tablesense.operators.fuzzy import best_matches

    customers = star(spark, path)["customer"]
    return best_matches(customers.select(F.expr(LOST).alias("value")), customers.select(F.col("c_name").alias("value")))


# --- dependencies -------------------------------------------------------------
def fd_sql(table: str, keys: tuple[str, ...]) -> str:
    cols = [c for c, k in S.GIVEN[table] if k in ("int", "text", "time")]
    return S.union(
        f"SELECT '{table}' AS table_name, '{a}' AS determinant, '{b}' AS dependent, count(*) FILTER (WHERE n > 1) AS witness_groups, "
        f"count(*) FILTER (WHERE n > 1 AND d = 1) AS consistent_witnesses, count(*) AS total_groups, sum(n)::BIGINT AS rows_considered, "
        f"(SELECT count(DISTINCT {a}) / count(*) FROM {table}) AS ratio, (SELECT least(count(DISTINCT {a}), count(DISTINCT {b})) FROM {table}) AS fewest "
        f"FROM (SELECT {a}, count(*) AS n, count(DISTINCT {b}) AS d FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})"
        for a in cols if a not in keys for b in cols if a != b)


FD_KEYS = {"nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
           "orders": ("o_orderkey",), "documents": ("doc_id",), "events": ("event_id",), "region": ("r_regionkey",),
           "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",)}
FD_TABLES = {t: FD_KEYS.get(t, ()) for t in S.GIVEN}
#: Customers with columns that depend on each other: exactly, approximately, and on a determinant with padded spellings.
PLACES = """SELECT c_nationkey % 10 AS city, c_nationkey % 5 AS zone,
 CASE WHEN c_custkey % 500 = 1 THEN 'odd' ELSE 'zone' || CAST(c_nationkey % 5 AS {text}) END AS zone_name,
 CASE c_custkey % 3 WHEN 0 THEN ' n' WHEN 1 THEN 'n ' ELSE 'n' END || CAST(c_custkey % 40 AS {text}) AS spelling, c_custkey % 120 AS third,
 'seg' || CAST(c_custkey % 120 % 7 AS {text}) AS segment FROM {table}"""
PLACE_COLUMNS = ("city", "zone", "zone_name", "spelling", "third", "segment")


def places_sql() -> str:
    return S.union(
        f"SELECT 'places' AS table_name, '{a}' AS determinant, '{b}' AS dependent, count(*) FILTER (WHERE n > 1) AS witness_groups, "
        f"count(*) FILTER (WHERE n > 1 AND d = 1) AS consistent_witnesses, count(*) AS total_groups, sum(n)::BIGINT AS rows_considered, "
        f"(SELECT count(DISTINCT {a}) / count(*) FROM places) AS ratio, (SELECT least(count(DISTINCT {a}), count(DISTINCT {b})) FROM places) AS fewest "
        f"FROM (SELECT {a}, count(*) AS n, count(DISTINCT {b}) AS d FROM places GROUP BY {a})"
        for a in PLACE_COLUMNS for b in PLACE_COLUMNS if a != b)


@query("dependencies", f"""
WITH places AS ({PLACES.format(text='VARCHAR', table='customer')})
SELECT table_name, determinant, dependent, witness_groups, consistent_witnesses, total_groups, rows_considered,
       consistent_witnesses = witness_groups AS exact
FROM ({places_sql()} UNION ALL {S.union(x for t, k in FD_TABLES.items() if (x := fd_sql(t, k)))})
WHERE ratio <= 0.9 AND fewest >= 2 AND total_groups >= 2 AND witness_groups >= 2 AND rows_considered >= 12 AND consistent_witnesses / witness_groups >= 0.95""")
def dependencies(spark, path):
    from tablesense.operators import dependencies as FD

    tables = load_tables(spark, path)
    tables["customer"].createOrReplaceTempView("ts_customer")
    tables["places"] = spark.sql(PLACES.format(text="STRING", table="ts_customer"))
    return FD.dependencies(spark, tables, FD_TABLES).drop("score")


DERIVED = "SELECT *, c_nationkey % 5 AS zone, CASE WHEN c_custkey % 500 = 1 THEN 'odd' ELSE 'zone' || CAST(c_nationkey % 5 AS {}) END AS zone_name FROM {}"


@query("dependency_evidence", f"""
SELECT zone AS value, count(*) AS rows_, count(DISTINCT zone_name) AS distinct_values, min(zone_name) AS target
FROM ({DERIVED.format('VARCHAR', 'customer')}) GROUP BY zone""")
def dependency_evidence(spark, path):
    from tablesense.operators import dependencies as FD

    star(spark, path)["customer"].createOrReplaceTempView("ts_customer")
    return FD.dependency_evidence(spark.sql(DERIVED.format("STRING", "ts_customer")), "zone", "zone_name")


@query("dependency_violations", f"""
WITH t AS ({DERIVED.format('VARCHAR', 'customer')}),
bad AS (SELECT c_nationkey AS value, count(DISTINCT zone_name) AS distinct_values FROM t GROUP BY 1 HAVING count(DISTINCT zone_name) > 1 ORDER BY 1 LIMIT 5)
SELECT value, target, distinct_values FROM (SELECT DISTINCT value, zone_name AS target, distinct_values FROM t JOIN bad ON c_nationkey = value)
QUALIFY row_number() OVER (PARTITION BY value ORDER BY target) <= 5""")
def dependency_violations(spark, path):
    from tablesense.operators import dependencies as FD

    star(spark, path)["customer"].createOrReplaceTempView("ts_customer")
    return FD.violations(spark.sql(DERIVED.format("STRING", "ts_customer")), "c_nationkey", "zone_name")


@query("dependency_chains", """
SELECT 'nation' AS table_name, 'n_name > n_nationkey > n_regionkey' AS chain, 3 AS length
WHERE (SELECT count(*) FROM nation) = (SELECT count(DISTINCT n_nationkey) FROM nation)
UNION ALL SELECT 'c', 'city > zone > half', 3
WHERE NOT EXISTS (SELECT 1 FROM (SELECT c_nationkey % 10 AS city, c_nationkey % 5 AS zone FROM customer) GROUP BY city HAVING count(DISTINCT zone) > 1)""")
def dependency_chains(spark, path):
    from tablesense.operators import dependencies as FD

    t = star(spark, path)
    repeated = t["nation"].union(t["nation"])
    c = t["customer"].select(
        (F.col("c_nationkey") % 10).alias("city"), (F.col("c_nationkey") % 5).alias("zone"),
        F.when(F.col("c_nationkey") % 5 > 2, "hi").otherwise("lo").alias("half"))
    found = FD.dependencies(spark, {"nation": repeated, "c": c}).where("exact")
    return FD.longest_chains(spark, found).select(
        "table_name", F.array_join("chain", " > ").alias("chain"), F.size("chain").alias("length"))


# --- equivalent columns -------------------------------------------------------
EQ_COLUMNS = S.columns(S.TPC, ("int", "text", "time"))
EQ_VALUES = S.union(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {i} AS p, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {t}"
    for i, (t, c, k) in enumerate(EQ_COLUMNS))


@query("equivalence_overlaps", f"""
WITH v AS ({EQ_VALUES}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL)
SELECT a.t AS left_table, a.c AS left_column, b.t AS right_table, b.c AS right_column, count(*) AS shared_values,
       count(*) / least(any_value(x.n), any_value(y.n)) AS value_overlap
FROM v a JOIN v b ON a.v = b.v AND a.k = b.k AND a.p < b.p AND a.t <> b.t
JOIN n x ON x.t = a.t AND x.c = a.c JOIN n y ON y.t = b.t AND y.c = b.c GROUP BY a.t, a.c, b.t, b.c""")
def equivalence_overlaps(spark, path):
    from tablesense.operators.equivalence import column_pairs

    tables = {t: df.select(*[c for c, k in S.GIVEN[t] if k != "float"]) for t, df in star(spark, path).items()}
    return column_pairs(spark, tables).where("shared_values > 0").drop("type_compatible")


@query("equivalences")
def equivalences(spark, path):
    from tablesense.operators.equivalence import equivalences as run

    return run(spark, load_tables(spark, path))
