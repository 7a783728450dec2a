"""Header detection over raw cells of many sheets at once: (sheet, row, col, value).

A sheet's first rows decide its header, so only the scan window and thirty body rows
of each sheet take part; the table of cells itself is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.functions import text as X
from tablesense.session import cut_lineage

SCAN_ROWS = 5
BODY_ROWS = 30
TEXT_RATIO = 0.60


def fill_merged(cells: DataFrame, merges: DataFrame, max_rows: int = SCAN_ROWS) -> DataFrame:
    """Spread each merged range's anchor value over the cells it spans.

    ``merges``: sheet, row_from, row_to, col_from, col_to.  A range becomes one row per
    spanned cell, so the join back to the cells is an equi-join on (sheet, row, col).
    """
    anchors = merges.join(
        cells.select("sheet", F.col("row").alias("row_from"), F.col("col").alias("col_from"), F.col("value").alias("anchor")),
        ["sheet", "row_from", "col_from"]).where(F.col("anchor").isNotNull())
    spread = anchors.select("sheet", F.explode(F.sequence("row_from", "row_to")).alias("row"), "col_from", "col_to", "anchor").select(
        "sheet", "row", F.explode(F.sequence("col_from", "col_to")).alias("col"), "anchor")
    return cells.join(spread, ["sheet", "row", "col"], "full_outer").select("sheet", "row", "col", F.coalesce("value", "anchor").alias("value"))


def _blank(c: Column) -> Column:
    return c.isNull() | (X.strip(c) == "")


def banner_rows(cells: DataFrame, scan: int = SCAN_ROWS) -> DataFrame:
    """(sheet, row) of blank or single-valued rows, from the top down to the first other row."""
    sized = cells.groupBy("sheet").agg(F.max("col").alias("width"), F.max("row").alias("height"))
    rows = cells.where(F.col("row") <= scan).groupBy("sheet", "row").agg(
        F.size(F.collect_set(F.when(~_blank(F.col("value")), X.strip(F.col("value"))))).alias("distinct_values"))
    grid = sized.select("sheet", "width", F.explode(F.sequence(F.lit(1), F.least(F.lit(scan), F.col("height")))).alias("row"))
    marked = grid.join(rows, ["sheet", "row"], "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    flat = (F.col("distinct_values") == 0) | ((F.col("width") >= 3) & (F.col("distinct_values") <= 1))
    first_other = marked.groupBy("sheet").agg(F.min(F.when(~flat, F.col("row"))).alias("stop"))
    # A window of nothing but banners has no header to skip to: the first row is used.
    return marked.join(first_other, "sheet").where(F.col("stop").isNotNull() & (F.col("row") < F.col("stop"))).select("sheet", "row")


def _starts(cells: DataFrame, scan: int) -> DataFrame:
    """Per sheet: width, height, first row after the banners, first body row of the profile."""
    sized = cells.groupBy("sheet").agg(F.max("col").alias("width"), F.max("row").alias("height"))
    cursor = banner_rows(cells, scan).groupBy("sheet").agg(F.max("row").alias("skipped"))
    start = F.coalesce("skipped", F.lit(0))
    below = F.greatest(F.least(F.lit(scan), F.col("height")) + 1, start + 2)
    enough = F.col("height") - below + 1 >= 2
    return sized.join(cursor, "sheet", "left").select(
        "sheet", "width", "height", (start + 1).alias("first_row"), F.when(enough, below).otherwise(start + 2).alias("body_from"))


def modal_shapes(cells: DataFrame, scan: int = SCAN_ROWS, starts: DataFrame | None = None) -> DataFrame:
    """(sheet, col, shape): most common value shape over the body rows, earliest on ties."""
    starts = _starts(cells, scan) if starts is None else starts
    body = cells.join(starts, "sheet").where(F.col("row").between(F.col("body_from"), F.col("body_from") + BODY_ROWS - 1))
    shaped = body.where(~_blank(F.col("value"))).select("sheet", "col", "row", X.value_shape(F.col("value")).alias("shape"))
    counted = shaped.groupBy("sheet", "col", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    return counted.groupBy("sheet", "col").agg(F.max_by("shape", F.struct("n", -F.col("first_row"))).alias("shape"))


def _texty(c: Column) -> Column:
    return ~X.strip(c).rlike(r"^[-+]?[\d,]*\.?\d+%?$")


def header_scores(cells: DataFrame, scan: int = SCAN_ROWS, starts: DataFrame | None = None, modal: DataFrame | None = None) -> DataFrame:
    """(sheet, row, score, text_ratio) for the rows a header may sit in."""
    starts = _starts(cells, scan) if starts is None else starts
    modal = modal_shapes(cells, scan, starts) if modal is None else modal
    window = cells.where(F.col("row") <= scan).join(starts, "sheet").where((F.col("row") >= F.col("first_row")) & ~_blank(F.col("value")))
    pair = window.join(modal.withColumnRenamed("shape", "body_shape"), ["sheet", "col"], "left")
    differs = (X.value_shape(F.col("value")) != F.col("body_shape")).cast("int")
    scored = pair.groupBy("sheet", "row").agg(F.coalesce(F.avg(differs), F.lit(0.0)).alias("score"), F.avg(_texty(F.col("value")).cast("int")).alias("text_ratio"))
    every = starts.select("sheet", F.explode(F.sequence(F.col("first_row"), F.least(F.lit(scan), F.col("height")))).alias("row"))
    return every.join(scored, ["sheet", "row"], "left").select("sheet", "row", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("text_ratio", F.lit(0.0)).alias("text_ratio"))


def detect_header(cells: DataFrame, scan: int = SCAN_ROWS) -> DataFrame:
    """(sheet, header_from, header_to, data_start, score, confident): leading rows that read as labels."""
    # Both are a few rows per sheet and are read several times below.
    starts = cut_lineage(_starts(cells, scan))
    modal = cut_lineage(modal_shapes(cells, scan, starts))
    plain = modal.groupBy("sheet").agg(F.bool_and(F.col("shape").rlike("^[a ]*$")).alias("all_text"))
    rows = cut_lineage(header_scores(cells, scan, starts, modal).join(plain, "sheet", "left"))
    looks = (F.col("score") > 0.5) | (F.coalesce("all_text", F.lit(True)) & (F.col("text_ratio") >= TEXT_RATIO) & (F.col("score") > 0))
    marked = rows.withColumn("looks", looks)
    edges = marked.groupBy("sheet").agg(F.min("row").alias("header_from"), F.min(F.when(~F.col("looks"), F.col("row"))).alias("stop"), F.max("row").alias("last"))
    found = edges.withColumn("confident", F.col("stop").isNull() | (F.col("stop") > F.col("header_from"))).withColumn(
        "header_to", F.when(F.col("stop").isNull(), F.col("last")).otherwise(F.greatest(F.col("stop") - 1, F.col("header_from"))))
    best = marked.join(found.select("sheet", "header_from", "header_to"), "sheet").where(F.col("row").between(F.col("header_from"), F.col("header_to"))).groupBy("sheet").agg(F.max("score").alias("score"))
    return found.join(best, "sheet").select("sheet", "header_from", "header_to", (F.col("header_to") + 1).alias("data_start"), "score", "confident")


def flatten_header(cells: DataFrame, scan: int = SCAN_ROWS) -> DataFrame:
    """(sheet, col, name): the header rows of a column joined into one safe, unique name."""
    from tablesense.functions.naming import unique_names

    header = cut_lineage(detect_header(cells, scan))
    width = cells.groupBy("sheet").agg(F.max("col").alias("width"))
    part = cells.join(header, "sheet").where(F.col("row").between(F.col("header_from"), F.col("header_to")) & ~_blank(F.col("value")))
    named = part.select("sheet", "col", "row", X.safe_name(X.strip(F.col("value"))).alias("piece")).where("piece <> ''")
    joined = named.groupBy("sheet", "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "piece"))), lambda x: x["piece"])), "_").alias("label"))
    grid = width.select("sheet", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("col")).join(joined, ["sheet", "col"], "left")
    base = F.coalesce("label", F.concat(F.lit("col_"), F.col("col").cast("string")))
    return unique_names(grid.withColumn("_base", base), ["sheet"], "col", "_base", "name").select("sheet", "col", "name", F.col("label").isNull().alias("auto_named"))


def header_confidence(cells: DataFrame, scan: int = SCAN_ROWS) -> DataFrame:
    """(sheet, confidence): how sure the header is, less for stacked, unnamed or look-alike rows."""
    auto = flatten_header(cells, scan).groupBy("sheet").agg(F.count_if("auto_named").alias("unnamed"))
    c = F.col
    score = 0.55 + 0.45 * c("score") - F.when(c("header_to") > c("header_from"), 0.05).otherwise(0.0)
    score = score - F.least(F.lit(0.4), 0.1 * c("unnamed")) - F.when(~c("confident"), 0.25).otherwise(0.0)
    return detect_header(cells, scan).join(auto, "sheet").select("sheet", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(score, 3))).alias("confidence"))


def mixed_ratio(cells: DataFrame) -> DataFrame:
    """(sheet, col, mixed_ratio): share of filled cells outside the commonest kind.

    ``kind`` tags a typed cell as text, number, bool or date.
    """
    counted = cells.where(F.col("value").isNotNull()).groupBy("sheet", "col", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("sheet", "col").agg((1 - F.max("n") / F.sum("n")).alias("mixed_ratio"))
