"""The ten reviewed cleaning steps.  None of them writes a value into a blank cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablesense import values as V
from tablesense.functions import dates, text as X
from tablesense.operators.clean import rank_date_formats, text_refs
from tablesense.operators.ranks import number_rows
from tablesense.operators.value_counts import value_counts
from tablesense.session import cut_lineage


class StepError(ValueError):
    """A step that cannot be applied to the table it names."""


@dataclass(frozen=True)
class Step:
    type: str
    table: str
    params: Mapping[str, Any] = field(default_factory=dict)


def _has(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise StepError(f"no column {column!r}; available: {', '.join(df.columns)}")
    return column


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    _has(df, column)
    if new_name in df.columns and new_name != column:
        raise StepError(f"already has a column named {new_name!r}")
    return df.withColumnRenamed(column, new_name)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    _has(df, column)
    if len(df.columns) == 1:
        raise StepError("refusing to drop the last remaining column")
    return df.drop(column)


def column_formats(df: DataFrame, column: str) -> tuple[str, ...]:
    """A text column's date formats, best first: at most sixteen names."""
    refs = [r for r in text_refs({"t": df.select(column)})]
    if not refs:
        return V.DATE_FORMAT_NAMES
    rows = rank_date_formats(value_counts({"t": df.select(column)}, refs)).collect()
    return tuple(r.format for r in sorted(rows, key=lambda r: r.rank))


def standardised(df: DataFrame, column: str, how: str, date_pattern: str = "yyyy-MM-dd") -> Column:
    c = F.col(f"`{_has(df, column)}`")
    if how == "date":
        return dates.format_date(c.cast("string"), column_formats(df, column), date_pattern)
    if how not in ("upper", "lower", "title", "strip"):
        raise StepError(f"unknown format {how!r}")
    return X.recase(X.strip(c.cast("string")), how)


def recased(df: DataFrame, column: str, casing: str) -> Column:
    if casing not in ("upper", "lower", "title"):
        raise StepError(f"unknown casing {casing!r}")
    return X.recase(F.col(f"`{_has(df, column)}`").cast("string"), casing)


def trimmed(df: DataFrame, column: str, collapse_internal: bool = False) -> Column:
    c = X.strip(F.col(f"`{_has(df, column)}`").cast("string"))
    return X.collapse_spaces(c) if collapse_internal else c


def cast_value(df: DataFrame, column: str, to: str) -> Column:
    c = F.col(f"`{_has(df, column)}`")
    if to in ("numeric", "float", "int", "integer"):
        return X.to_plain_number(c)
    if to in ("datetime", "date"):
        return dates.parse_date(c.cast("string"), column_formats(df, column))
    if to in ("string", "text", "str"):
        return c.cast("string")
    if to in ("boolean", "bool"):
        return X.to_boolean(c, V.CAST_TRUE, V.CAST_FALSE)
    raise StepError(f"unsupported cast target {to!r}")


def cast_losses(df: DataFrame, column: str, to: str) -> DataFrame:
    """One row: cells read and values a cast would turn into blanks."""
    before = F.col(f"`{column}`")
    after = cast_value(df, column, to)
    return df.select(before.alias("b"), after.alias("a")).agg(
        F.lit(to).alias("target"), F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("lost"),
    )


def changed_cells(df: DataFrame, column: str, after: Column) -> DataFrame:
    """One row: rows, and cells whose value differs (two blanks are equal)."""
    return df.select(F.col(f"`{column}`").alias("b"), after.alias("a")).agg(
        F.count(F.lit(1)).alias("rows_"), F.count_if(~F.col("b").cast("string").eqNullSafe(F.col("a").cast("string"))).alias("cells_changed"))


def split_column(df: DataFrame, column: str, into: Sequence[str], delimiter: str | None = None, regex: str | None = None) -> DataFrame:
    """New columns from one text column; the last keeps whatever is left."""
    _has(df, column)
    if len(into) < 2 or not (delimiter or regex):
        raise StepError("needs at least two names and a delimiter or a pattern")
    if clash := [c for c in into if c in df.columns]:
        raise StepError(f"already has {clash}")
    pattern = regex or r"\Q" + delimiter + r"\E"
    parts = F.split(F.col(f"`{column}`").cast("string"), pattern, len(into))
    return df.select("*", *[X.strip(F.get(parts, F.lit(i))).alias(name) for i, name in enumerate(into)])


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", order: Sequence[str] | None = None) -> DataFrame:
    """Keep the first or last row of each group, or only the rows that never repeat.

    A grouped minimum instead of a window: each task sends one row per group, so a
    group holding a third of the table does not land in one task.
    """
    if not subset:
        if keep is not False and keep != "none":
            return df.dropDuplicates()
        subset = df.columns
    for c in subset:
        _has(df, c)
    order = list(order or df.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    at = F.struct(*[F.col(f"`{c}`") for c in order])
    by = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(subset)]
    if keep in (False, "none"):
        grouped = df.groupBy(*by).agg(F.any_value(row).alias("r"), F.count(F.lit(1)).alias("n")).where("n = 1")
    else:
        pick = F.min_by if keep == "first" else F.max_by
        grouped = df.groupBy(*by).agg(pick(row, at).alias("r"))
    return grouped.select("r.*")


def add_synthetic_key(df: DataFrame, order: Sequence[str], column: str = "row_id") -> DataFrame:
    if column in df.columns:
        raise StepError(f"already has a column named {column!r}")
    return number_rows(df, list(order), column)


def merge_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", right_name: str = "right") -> DataFrame:
    """Join on one key; overlapping names get ``_<right>``, blank keys match blank keys."""
    if how not in ("inner", "left", "right", "outer"):
        raise StepError(f"unsupported join type {how!r}")
    _has(left, left_key), _has(right, right_key)
    same = left_key == right_key
    renamed = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*[F.col(f"`{c}`").alias(a) for c, a in renamed.items()])
    joined = left.join(r, left[left_key].eqNullSafe(r[renamed[right_key]]), how)
    out = []
    for c in left.columns:
        value = left[c]
        if same and c == left_key:
            value = F.coalesce(left[c], F.col(renamed[c]))
        out.append(value.alias(c))
    for c, alias in renamed.items():
        if same and c == right_key:
            continue
        out.append(F.col(alias).alias(f"{c}_{right_name}" if c in left.columns else c))
    return joined.select(*out)


def unmatched_left(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: left rows with no partner, counted on grouped keys so no key is hot."""
    keys = right.select(F.col(right_key).alias("k")).distinct()
    counted = left.groupBy(F.col(left_key).alias("lk")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(keys, F.col("lk").eqNullSafe(F.col("k")), "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched_rows"))


def apply_step(tables: dict[str, DataFrame], step: Step, orders: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The dataset after one step.  Plans stay lazy; nothing runs here but a format ranking."""
    p = dict(step.params)
    if step.type in V.FORBIDDEN_STEPS:
        raise StepError(f"{step.type}: a blank means 'not known' and is never filled in")
    if step.table not in tables and step.type != "merge_sheets":
        raise StepError(f"unknown table {step.table!r}")
    if step.type == "merge_sheets":
        left = p.get("left_table", step.table)
        for name in (left, p["right_table"]):
            if name not in tables:
                raise StepError(f"unknown table {name!r}")
        result = p.get("result_table", f"{left}_{p['right_table']}")
        merged = merge_tables(tables[left], tables[p["right_table"]], p["left_key"], p["right_key"],
                              p.get("how", "left"), p["right_table"])
        return {**tables, result: merged}
    df = tables[step.table]
    order = (orders or {}).get(step.table, df.columns)
    if step.type == "rename_column":
        after = rename_column(df, p["column"], p["new_name"])
    elif step.type == "drop_column":
        after = drop_column(df, p["column"])
    elif step.type == "split_column":
        after = split_column(df, p["column"], p["into"], p.get("delimiter"), p.get("regex"))
    elif step.type == "deduplicate":
        after = deduplicate(df, p.get("subset"), p.get("keep", "first"), order)
    elif step.type == "add_synthetic_key":
        after = add_synthetic_key(df, order, p.get("column", "row_id"))
    elif step.type in ("standardize_format", "standardize_casing", "strip_whitespace", "type_cast"):
        after = df.withColumn(p["column"], changed_value(df, step))
    else:
        raise StepError(f"unknown step {step.type!r}")
    return {**tables, step.table: after}


def changed_value(df: DataFrame, step: Step) -> Column:
    """The new value of the one column a value step rewrites."""
    p = dict(step.params)
    return {
        "standardize_format": lambda: standardised(df, p["column"], p.get("format", "strip"), p.get("date_format", "yyyy-MM-dd")),
        "standardize_casing": lambda: recased(df, p["column"], p.get("casing", "lower")),
        "strip_whitespace": lambda: trimmed(df, p["column"], p.get("collapse_internal", False)),
        "type_cast": lambda: cast_value(df, p["column"], p["to"]),
    }[step.type]()


def sort_plan(steps: Sequence[Step]) -> list[Step]:
    """Structure first, then values, then rows, then joins."""
    rank = {t: i for i, t in enumerate(V.STEP_ORDER)}
    return sorted(steps, key=lambda s: (rank.get(s.type, 99), s.table))


def merge_plans(first: Sequence[Step], second: Sequence[Step]) -> list[Step]:
    seen, out = set(), []
    for step in [*first, *second]:
        mark = (step.type, step.table, repr(sorted(step.params.items(), key=str)))
        if mark not in seen:
            seen.add(mark)
            out.append(step)
    return sort_plan(out)


def run_plan(tables: Mapping[str, DataFrame], steps: Sequence[Step], orders: Mapping[str, Sequence[str]] | None = None) -> tuple[dict[str, DataFrame], list[tuple[Step, str]]]:
    """Fold the plan over lazy tables; a step that fails leaves its table as it was."""
    from pyspark.errors import AnalysisException

    current, failed = dict(tables), []
    for step in sort_plan(steps):
        try:
            current = apply_step(current, step, orders)
        except (StepError, AnalysisException, KeyError) as exc:
            failed.append((step, str(exc)))
    return current, failed


VALUE_STEPS = ("standardize_format", "standardize_casing", "strip_whitespace", "type_cast")
OUTCOME = "place int, step string, table_name string, column_name string, note string"


def _differs(before: Column, after: Column) -> Column:
    return ~before.cast("string").eqNullSafe(after.cast("string"))


def step_outcomes(
    spark: SparkSession, tables: Mapping[str, DataFrame], steps: Sequence[Step], orders: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """What each step of a plan does to the table it gets, in the order in which they run.

    (place, step, table_name, column_name, rows_before, rows_after, rows_removed, cells_changed, cells_blanked, note): a cell has
    changed if its value differs as text (two blanks are equal) and is blanked if a value became a blank.  A step
    that cannot run has a note and no counts, and its table goes on as it was.  Cells are compared inside their row, so a
    value step takes one scan and no shuffle; all steps are counted by one query.
    """
    from pyspark.errors import AnalysisException

    current, notes, counts = dict(tables), [], []
    zero = F.lit(0).cast("bigint")
    for place, step in enumerate(sort_plan(steps)):
        p, note = dict(step.params), None
        try:
            after = apply_step(current, step, orders)
        except (StepError, AnalysisException, KeyError) as exc:
            notes.append((place, step.type, step.table, p.get("column"), f"not applied: {type(exc).__name__}"))
            continue
        if step.type in VALUE_STEPS:
            old, new = F.col(f"`{p['column']}`"), changed_value(current[step.table], step)
            both = current[step.table].select(old.alias("b"), new.alias("a"))
            counts.append(both.agg(
                F.count(F.lit(1)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), F.count_if(_differs(F.col("b"), F.col("a"))).alias("cells_changed"),
                F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("cells_blanked")).select(F.lit(place).alias("place"), "*"))
        else:
            left = p.get("left_table", step.table)
            result = p.get("result_table", f"{left}_{p.get('right_table')}") if step.type == "merge_sheets" else step.table
            note = {"rename_column": f"now {p.get('new_name')}", "merge_sheets": f"joined into {result}"}.get(step.type)
            for df, sides in ((current[left], (F.count(F.lit(1)), zero)), (after[result], (zero, F.count(F.lit(1))))):
                counts.append(df.agg(*[(x if x is not zero else F.max(zero)).alias(c) for x, c in zip(sides, ("rows_before", "rows_after"))]).select(
                    F.lit(place).alias("place"), F.coalesce("rows_before", zero).alias("rows_before"), F.coalesce("rows_after", zero).alias("rows_after"),
                    zero.alias("cells_changed"), zero.alias("cells_blanked")))
        notes.append((place, step.type, step.table, p.get("column"), note))
        current = after
    ran = spark.createDataFrame(notes, OUTCOME)
    numbers = ["rows_before", "rows_after", "cells_changed", "cells_blanked"]
    if not counts:
        return ran.select("*", *[F.lit(None).cast("bigint").alias(c) for c in (*numbers, "rows_removed")])
    summed = reduce(DataFrame.unionAll, counts).groupBy("place").agg(*[F.sum(c).alias(c) for c in numbers])
    return ran.join(F.broadcast(summed), "place", "left").withColumn("rows_removed", F.greatest(F.col("rows_before") - F.col("rows_after"), zero))


def step_preview(df: DataFrame, step: Step, order: Sequence[str], limit: int = 10) -> DataFrame:
    """(position, row_key, column_name, before, after): the first rows, by ``order``, that a step would change.

    For a value step the changed column's text before and after; for a de-duplication the rows that go, ``before``
    being the columns that were compared and ``after`` null.  Every task keeps ``limit`` rows before
    anything is shuffled, and the rows that stay are found by the same grouped minimum that removes the others.
    """
    p = dict(step.params)
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order])
    at = [F.col(f"`{c}`") for c in order]
    if step.type in VALUE_STEPS:
        old, new = F.col(f"`{p['column']}`"), changed_value(df, step)
        rows = df.select(F.struct(*at).alias("at"), key.alias("row_key"), F.lit(p["column"]).alias("column_name"),
                         old.cast("string").alias("before"), new.cast("string").alias("after")).where(_differs(F.col("before"), F.col("after")))
    elif step.type == "deduplicate":
        subset = list(p.get("subset") or df.columns)
        # a row's identity is written down once, so that it is the same on both sides and after a lost executor
        marked = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
        kept = deduplicate(marked, subset, p.get("keep", "first"), [*order, "__row"]).select("__row")
        compared = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in subset])
        rows = marked.join(kept, "__row", "left_anti").select(
            F.struct(*at, F.col("__row")).alias("at"), key.alias("row_key"), F.lit(None).cast("string").alias("column_name"),
            compared.alias("before"), F.lit(None).cast("string").alias("after"))
    else:
        raise StepError(f"{step.type} changes no rows: nothing to preview")
    first = rows.orderBy("at").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("at")).alias("position"), "row_key", "column_name", "before", "after")
