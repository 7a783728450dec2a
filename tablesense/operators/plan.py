"""A cleaning plan proposed from value counts; every step is shown before it is applied."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablesense.functions import text as X
from tablesense.operators.clean import text_refs
from tablesense.operators.keys import KeyAnalysis, discover_keys
from tablesense.operators.profile import with_names
from tablesense.operators.steps import Step, sort_plan
from tablesense.operators.value_counts import ColumnRef, column_refs, non_null_counts, value_counts


def whitespace_offenders(counts: DataFrame) -> DataFrame:
    """(cid, stray): cells with blanks at either end."""
    v = F.col("value")
    return counts.where(X.strip(v) != v).groupBy("cid").agg(F.sum("n").alias("stray"))


def case_collisions(counts: DataFrame) -> DataFrame:
    """(cid, collisions, examples, casing): value groups that differ only by capitals.

    ``casing`` is the style most cells already follow: upper, then lower, then title.
    """
    v, n = F.col("v"), F.col("n")
    trimmed = counts.groupBy("cid", X.strip(F.col("value")).alias("v")).agg(F.sum("n").alias("n"))
    groups = trimmed.groupBy("cid", F.lower(v).alias("low")).agg(
        F.count(F.lit(1)).alias("spellings"), F.min("v").alias("a"), F.max("v").alias("b")).where("spellings > 1")
    worst = F.max_by(F.struct("a", "b"), F.struct(F.col("spellings"), F.col("low")))
    found = groups.groupBy("cid").agg(F.count(F.lit(1)).alias("collisions"), worst.alias("w"))
    styles = trimmed.join(F.broadcast(found.select("cid")), "cid", "left_semi").groupBy("cid").agg(
        *[F.coalesce(F.sum(F.when(v == X.recase(v, how), n)), F.lit(0)).alias(how) for how in ("upper", "lower", "title")])
    c = F.col
    best = F.when((c("upper") >= c("lower")) & (c("upper") >= c("title")), "upper").when(c("lower") >= c("title"), "lower").otherwise("title")
    return found.join(styles, "cid").select("cid", "collisions", F.array("w.a", "w.b").alias("examples"), best.alias("casing"))


def propose_plan(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, KeyAnalysis] | None = None,
    linked: list[tuple[str, str, str, str]] = (),
) -> list[Step]:
    """Drop empty columns, trim, merge casings, remove copies, add a counter, join split tables.

    ``linked`` are confirmed equivalent columns (left table, column, right table, column),
    strongest first.
    """
    refs = column_refs(tables)
    filled = non_null_counts(tables, refs)
    steps = [
        Step("drop_column", r.table, {"column": r.column}) for r in refs if filled[r.cid][0] > 0 and filled[r.cid][1] == 0]
    texts = [r for r in text_refs(tables)]
    if texts:
        counts = value_counts(tables, texts)
        by = {r.cid: r for r in texts}
        steps += [Step("strip_whitespace", by[r.cid].table, {"column": by[r.cid].column}) for r in whitespace_offenders(counts).collect()]
        steps += [
            Step("standardize_casing", by[r.cid].table, {"column": by[r.cid].column, "casing": r.casing})
            for r in case_collisions(counts).collect()]
    keys = keys or discover_keys(tables)
    for name, found in keys.items():
        if found.duplicate_rows:
            steps.append(Step("deduplicate", name, {}))
        if found.needs_synthetic_key:
            steps.append(Step("add_synthetic_key", name, {"column": "row_id"}))
    merged: set[frozenset[str]] = set()
    for lt, lc, rt, rc in linked:
        pair = frozenset((lt, rt))
        if pair in merged or lt not in tables or rt not in tables or set(tables[lt].columns) != set(tables[rt].columns):
            continue
        merged.add(pair)
        steps.append(Step("merge_sheets", lt, {"left_table": lt, "right_table": rt, "left_key": lc, "right_key": rc, "how": "left",
                                               "result_table": f"{lt}_with_{rt}"}))
    return sort_plan(steps)


def plan_table(spark: SparkSession, steps: list[Step]) -> DataFrame:
    rows = [(i, s.type, s.table, str(s.params.get("column", "")), str(s.params.get("casing", ""))) for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "position int, step string, table_name string, column_name string, detail string")
