"""Single-column functional dependencies inside a table."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablesense import values as V
from tablesense.operators.value_counts import ColumnEvidence, gather_evidence
from tablesense.session import in_pieces

#: Rows drawn to refute pairs, how many times as many the second time, and determinants taken at a time.
SAMPLE_ROWS, GROW, WIDE = 20_000, 8, 12
#: Rows of a table that one task groups when pairs are counted in full: its memory does not grow with the table.
PIECE = 500_000
SCHEMA = (
    "table_name string, determinant string, dependent string, witness_groups bigint, "
    "consistent_witnesses bigint, total_groups bigint, rows_considered bigint"
)


def witness_counts(df: DataFrame, table: str, wanted: Mapping[str, Sequence[str]], one_in: int = 1) -> DataFrame:
    """All wanted determinant → dependent pairs of one table, counted in groups of the determinants' values.

    A row is copied once per determinant with the 64-bit digests of that determinant's own dependents, in
    its own order; determinants with about as many dependents are taken WIDE at a time, so no copy is
    wider than its dependents ask for.  A group agrees on a dependent exactly when its smallest and largest digest are
    the same, so no distinct sets are built, every aggregate is a fixed-width number
    combined map-side, and a hot determinant value is one row per map task.

    With ``one_in`` a determinant only looks at the rows of one in so many of its values, picked by a hash.
    """
    by_width = sorted((a for a in wanted if wanted[a]), key=lambda a: -len(wanted[a]))
    return reduce(DataFrame.unionAll, [
        _chunk_counts(df, table, {a: wanted[a] for a in by_width[i: i + WIDE]}, one_in) for i in range(0, len(by_width), WIDE)])


def _chunk_counts(df: DataFrame, table: str, wanted: Mapping[str, Sequence[str]], one_in: int) -> DataFrame:
    def digest(name: str, *salt: Column) -> Column:
        c = F.col(f"`{name}`")
        return F.when(c.isNotNull(), F.xxhash64(*salt, c))

    if one_in > 1:
        df = df.where(reduce(Column.__or__, [F.pmod(digest(a), F.lit(one_in)) == 0 for a in wanted]))
    width = max(map(len, wanted.values()))
    blank = F.lit(None).cast("bigint")
    copies = []
    for i, (a, dependents) in enumerate(wanted.items()):
        slots = [digest(b) for b in dependents] + [blank] * (width - len(dependents))
        copy = F.struct(F.lit(i).alias("det"), digest(a).alias("g1"), digest(a, F.lit(7919)).alias("g2"), *[x.alias(f"b{j}") for j, x in enumerate(slots)])
        picked = F.col(f"`{a}`").isNotNull() & (F.pmod(digest(a), F.lit(one_in)) == 0)
        copies.append(F.when(picked, copy))
    rows = df.select(F.inline(F.array_compact(F.array(*copies))))
    aggs = []
    for j in range(width):
        aggs += [F.count(f"b{j}").alias(f"n{j}"), F.min(f"b{j}").alias(f"lo{j}"), F.max(f"b{j}").alias(f"hi{j}")]
    grouped = rows.groupBy("det", "g1", "g2").agg(*aggs)
    c = F.col
    per = grouped.select("det", F.inline(F.array(*[
        F.struct(F.lit(j).alias("slot"), c(f"n{j}").alias("n"), (c(f"lo{j}") == c(f"hi{j}")).alias("same")) for j in range(width)])))
    names = F.array(*[F.array(*[F.lit(b) for b in bs]) for bs in wanted.values()])
    lefts = F.array(*[F.lit(a) for a in wanted])
    return (
        per.groupBy("det", "slot").agg(
            F.count_if(c("n") > 1).alias("witness_groups"), F.count_if((c("n") > 1) & c("same")).alias("consistent_witnesses"),
            F.count_if(c("n") > 0).alias("total_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_considered"))
        .select(F.lit(table).alias("table_name"), F.get(lefts, c("det")).alias("determinant"), F.get(F.get(names, c("det")), c("slot")).alias("dependent"),
                "witness_groups", "consistent_witnesses", "total_groups", "rows_considered")
        .where("dependent IS NOT NULL")
    )


def _pairs(evidence: ColumnEvidence, table: str, keys: Sequence[str]) -> tuple[list[str], dict[str, int]]:
    rows = evidence.rows(table)
    usable = [
        r for r in evidence.refs
        if r.table == table and not r.fractional and evidence.distinct_raw(r) >= 2
    ]
    left = {
        r.column: evidence.distinct_raw(r) for r in usable
        if r.column not in keys and evidence.distinct_raw(r) / rows <= V.FD_MAX_UNIQUE
    }
    return [r.column for r in usable], left


def dependencies(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None,
    evidence: ColumnEvidence | None = None, threshold: float = V.FD_APPROXIMATE, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Exact and approximate dependencies, counted over whole tables.

    On large tables two rounds first remove pairs that *cannot* hold: a group that disagrees among some
    rows disagrees in the table, and a table has at most min(distinct, rows / 2) groups that repeat.  The first
    round draws rows, which refutes pairs of determinants with many rows a value; the second draws values, GROW
    times as many rows, for those with few.  Each round carries only the pairs still alive; what is left is counted in full.
    """
    evidence = evidence or gather_evidence(tables)
    keys = keys or {}
    todo: dict[str, dict[str, list[str]]] = {}
    for table, df in tables.items():
        usable, left = _pairs(evidence, table, keys.get(table, ())) if evidence.rows(table) >= V.FD_MIN_ROWS else ([], {})
        wanted = {a: [b for b in usable if b != a] for a in left if len(usable) > 1}
        if wanted:
            todo[table] = wanted
    distinct = {(r.table, r.column): evidence.distinct_raw(r) for r in evidence.refs}
    for looked_at, by_value in ((sample_rows, False), (sample_rows * GROW, True)):
        trial = []
        for table, wanted in todo.items():
            rows = evidence.rows(table)
            if rows > looked_at and any(wanted.values()):
                df = tables[table] if by_value else tables[table].sample(fraction=looked_at / rows, seed=20240501)
                trial.append(witness_counts(df, table, wanted, rows // looked_at if by_value else 1))
        for r in reduce(DataFrame.unionAll, trial).collect() if trial else ():  # one row for each pair of columns
            most = min(distinct[(r.table_name, r.determinant)], evidence.rows(r.table_name) // 2)
            if r.witness_groups - r.consistent_witnesses > (1 - threshold) * most:
                todo[r.table_name][r.determinant].remove(r.dependent)
    left = {t: kept for t, wanted in todo.items() if (kept := {a: bs for a, bs in wanted.items() if bs})}
    if not left:
        counted = spark.createDataFrame([], SCHEMA)
    else:
        counted = reduce(DataFrame.unionAll, [witness_counts(in_pieces(_narrow(tables[t], wanted), PIECE, evidence.rows(t)), t, wanted) for t, wanted in left.items()])
    score = F.col("consistent_witnesses") / F.col("witness_groups")
    return (
        counted.where(
            (F.col("rows_considered") >= V.FD_MIN_ROWS) & (F.col("total_groups") >= 2)
            & (F.col("witness_groups") >= V.FD_MIN_WITNESSES)
        )
        .withColumn("score", score).where(F.col("score") >= threshold)
        .withColumn("exact", F.col("consistent_witnesses") == F.col("witness_groups"))
    )


def _narrow(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """The columns that some pair needs."""
    used = {c for a, bs in wanted.items() for c in (a, *bs)}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in used])


def dependency_evidence(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Per determinant value: rows, distinct dependents, and the value when it is the only one.

    Pairs are counted before they are regrouped, so no value's rows meet in one task.
    """
    a, b = F.col(f"`{determinant}`"), F.col(f"`{dependent}`")
    pairs = df.where(a.isNotNull() & b.isNotNull()).groupBy(a.alias("value"), b.alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("value").agg(
        F.sum("n").alias("rows_"), F.count(F.lit(1)).alias("distinct_values"), F.min("target").alias("target"))


def supporting(evidence: DataFrame, k: int = V.EVIDENCE_ROWS) -> DataFrame:
    return evidence.where("distinct_values = 1 AND rows_ > 1").orderBy(F.desc("rows_"), "value").limit(k)


def contradicting(evidence: DataFrame, k: int = V.EVIDENCE_ROWS) -> DataFrame:
    return evidence.where("distinct_values > 1").orderBy(F.desc("distinct_values"), "value").limit(k)


def violations(df: DataFrame, determinant: str, dependent: str, values: int = 5, targets: int = 5) -> DataFrame:
    """A few determinant values with more than one target, and a few of those targets."""
    a, b = F.col(f"`{determinant}`"), F.col(f"`{dependent}`")
    bad = dependency_evidence(df, determinant, dependent).where("distinct_values > 1")
    few = bad.orderBy("value").limit(values).select("value", "distinct_values")
    pairs = df.where(a.isNotNull() & b.isNotNull()).select(a.alias("value"), b.alias("target")).distinct()
    w = Window.partitionBy("value").orderBy("target")
    return (
        pairs.join(F.broadcast(few), "value").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= targets)
        .select("value", "target", "distinct_values")
    )


def longest_chains(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Longest path through each table's dependencies (table_name, chain), over *column names* of a schema."""
    rows = edges.select("table_name", "determinant", "dependent").distinct().collect()
    out = []
    for table in sorted({r.table_name for r in rows}):
        after: dict[str, set[str]] = {}
        for r in rows:
            if r.table_name == table:
                after.setdefault(r.determinant, set()).add(r.dependent)
                after.setdefault(r.dependent, set())
        out.append((table, longest_path(after)))
    return spark.createDataFrame(out, "table_name string, chain array<string>")


def longest_path(after: Mapping[str, set[str]]) -> list[str]:
    """The longest simple path along the edges ``after``; ties go to the first in order of the names.

    Between groups of columns that reach each other there are no cycles, so the best way on from a column is
    found group by group, the reached ones first.  Inside a group where every column leads to every other, all
    others are walked and the best exit comes last; in any other group the subset still to visit decides, which takes
    time exponential in the size of that one group.  Exact dependencies are closed, so their groups are of the first kind.
    """
    reach = {a: _reached(after, a) for a in after}
    group = {a: tuple(sorted({a} | {b for b in reach[a] if a in reach[b]})) for a in after}
    best: dict[str, list[str]] = {}

    def longer(paths: Iterable[list[str]]) -> list[str]:
        return min(paths, key=lambda path: (-len(path), path), default=[])

    for own in sorted(set(group.values()), key=lambda g: (len(reach[g[0]] | set(g)), g)):
        on = {a: longer(best[b] for b in after[a] if b not in own) for a in own}
        if all(set(own) - {a} <= after[a] for a in own):
            for a in own:
                others = [[b for b in own if b not in (a, last)] + [last, *on[last]] for last in own if last != a]
                best[a] = longer([[a, *on[a]], *([a, *rest] for rest in others)])
        else:
            @functools.lru_cache(maxsize=None)
            def way(a: str, left: frozenset) -> list[str]:
                return longer([[a, *on[a]], *([a, *way(b, left - {b})] for b in after[a] & left)])

            for a in own:
                best[a] = way(a, frozenset(own) - {a})
    return longer(best.values())


def _reached(after: Mapping[str, set[str]], start: str) -> set[str]:
    seen: set[str] = set()
    todo = [start]
    while todo:
        fresh = after[todo.pop()] - seen
        seen |= fresh
        todo.extend(fresh)
    return seen
