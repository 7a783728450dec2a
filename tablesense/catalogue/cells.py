"""Queries over raw sheet cells: one sheet per sixty customers, with a banner and two header rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense.catalogue import query
from tablesense.session import cut_lineage, load_tables
from tablesense.sources import cells as C

#: Row 1 banner, rows 2 and 3 stacked headers, customers from row 4.
CELLS_SQL = """
WITH r AS (SELECT c_custkey // 60 AS sheet, 4 + c_custkey % 60 AS row, * FROM customer),
cells AS (SELECT sheet, row, 1 AS col, c_name AS value FROM r UNION ALL SELECT sheet, row, 2, CAST(c_custkey AS VARCHAR) FROM r
  UNION ALL SELECT sheet, row, 3, c_mktsegment FROM r UNION ALL SELECT sheet, row, 4, CAST(c_acctbal AS VARCHAR) FROM r
  UNION ALL SELECT DISTINCT sheet, 1, 1, 'Customers of ' || sheet FROM r
  UNION ALL SELECT DISTINCT sheet, 2, 1, 'Who' FROM r UNION ALL SELECT DISTINCT sheet, 2, 3, 'Facts & figures' FROM r
  UNION ALL SELECT DISTINCT sheet, 3, unnest([1, 2, 3, 4]), unnest(['Full name', 'No.', 'Segment', 'Balance %']) FROM r)"""


def sheets(spark, path):
    customers = load_tables(spark, path, ["customer"])["customer"]
    customers = customers.withColumn("sheet", F.floor(F.col("c_custkey") / 60)).withColumn("row", (4 + F.col("c_custkey") % 60).cast("int"))
    body = customers.select("sheet", "row", F.inline(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(("c_name", "c_custkey", "c_mktsegment", "c_acctbal"), 1)])))
    head = customers.select("sheet").distinct().select("sheet", F.inline(F.array(
        F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.concat(F.lit("Customers of "), F.col("sheet").cast("string")).alias("value")),
        *[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.lit(v).alias("value")) for a, b, v in ((2, 1, "Who"), (2, 3, "Facts & figures"), (3, 1, "Full name"), (3, 2, "No."), (3, 3, "Segment"), (3, 4, "Balance %"))])))
    merges = head.where("row <= 2").select(
        "sheet", F.col("row").alias("row_from"), F.col("row").alias("row_to"), F.col("col").alias("col_from"),
        F.when(F.col("row") == 1, 4).otherwise(F.col("col") + 1).alias("col_to"))
    return body.unionAll(head), merges


FILLED_SQL = CELLS_SQL + """,
spread AS (SELECT sheet, 1 AS row, unnest([1, 2, 3, 4]) AS col, value AS anchor FROM cells WHERE row = 1
  UNION ALL SELECT sheet, 2, col + unnest([0, 1]), value FROM cells WHERE row = 2),
filled AS (SELECT coalesce(c.sheet, s.sheet) AS sheet, coalesce(c.row, s.row) AS row, coalesce(c.col, s.col) AS col, coalesce(c.value, s.anchor) AS value
  FROM cells c FULL JOIN spread s ON c.sheet = s.sheet AND c.row = s.row AND c.col = s.col)"""


@query("merged_cells_filled", FILLED_SQL + " SELECT sheet, row, col, value FROM filled")
def merged_cells_filled(spark, path):
    return C.fill_merged(*sheets(spark, path))


def filled(spark, path):
    """The filled cell table, written once as a stored cell table would be."""
    return cut_lineage(C.fill_merged(*sheets(spark, path)))


@query("banner_rows", FILLED_SQL + " SELECT sheet, row FROM filled WHERE row = 1 GROUP BY sheet, row HAVING count(DISTINCT value) <= 1")
def banner_rows(spark, path):
    return C.banner_rows(filled(spark, path))


SHAPE = "substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '\\s+', ' ', 'g'), '\\p{L}+', 'a', 'g'), '\\p{Nd}+', '9', 'g'), '9([.,]9)+', '9', 'g'), 1, 24)"
MODAL_SQL = FILLED_SQL + f""",
n AS (SELECT sheet, max(row) AS height FROM filled GROUP BY sheet),
modal AS (SELECT sheet, col, shape FROM (SELECT f.sheet, col, {SHAPE} AS shape, count(*) AS k, min(row) AS f FROM filled f JOIN n USING (sheet)
  WHERE row BETWEEN CASE WHEN height >= 7 THEN 6 ELSE 3 END AND CASE WHEN height >= 7 THEN 6 ELSE 3 END + 29 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sheet, col ORDER BY k DESC, f) = 1)"""


@query("modal_shapes", MODAL_SQL + " SELECT * FROM modal")
def modal_shapes(spark, path):
    return C.modal_shapes(filled(spark, path))


@query("header_scores", MODAL_SQL + f"""
SELECT f.sheet, f.row, round(avg(CASE WHEN {SHAPE.replace('value', 'f.value')} <> m.shape THEN 1.0 ELSE 0.0 END), 6) AS score FROM filled f JOIN modal m ON f.sheet = m.sheet AND f.col = m.col WHERE f.row BETWEEN 2 AND 5 GROUP BY ALL""")
def header_scores(spark, path):
    return C.header_scores(filled(spark, path)).select("sheet", "row", F.round("score", 6).alias("score"))


@query("headers_detected", CELLS_SQL + " SELECT DISTINCT sheet, 2 AS header_from, 3 AS header_to, 4 AS data_start FROM cells")
def headers_detected(spark, path):
    return C.detect_header(filled(spark, path)).select("sheet", "header_from", "header_to", "data_start")


@query("headers_flattened", CELLS_SQL + """
SELECT DISTINCT sheet, unnest([1, 2, 3, 4]) AS col, unnest(['who_full_name', 'who_no', 'facts_and_figures_segment', 'facts_and_figures_balance_pct']) AS name FROM cells""")
def headers_flattened(spark, path):
    return C.flatten_header(filled(spark, path)).drop("auto_named")


@query("mixed_cells", """
SELECT l_suppkey AS sheet, 1 AS col, 1 - max(n) / sum(n) AS mixed_ratio FROM (
  SELECT l_suppkey, CASE WHEN l_linenumber = 1 THEN 'text' ELSE 'number' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def mixed_cells(spark, path):
    li = load_tables(spark, path, ["lineitem"])["lineitem"]
    cells = li.select(F.col("l_suppkey").alias("sheet"), F.lit(1).alias("col"), F.col("l_quantity").cast("string").alias("value"),
                      F.when(F.col("l_linenumber") == 1, "text").otherwise("number").alias("kind"))
    return C.mixed_ratio(cells)
