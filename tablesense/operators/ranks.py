"""Exact order statistics and row numbers without sorting a group in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.session import cut_lineage

BINS = 2048
#: A summary has this many steps; its points' ranks are wrong by no more than a share 1 / ACCURACY of the rows.
STEPS, ACCURACY = 500, 1_000
#: Up to so many distinct values inside all brackets are finished in the driver.
FEW = 200_000

#: filled, min, max and the points of ``summary`` of a group
Bounds = tuple[int, float, float, list[float]]


def summary(x: str = "x") -> Column:
    """Approximate values at STEPS + 1 even shares of a group: a sketch that tasks build and merge."""
    return F.percentile_approx(x, [i / STEPS for i in range(STEPS + 1)], ACCURACY)


def group_bounds(long: DataFrame) -> dict[str, Bounds]:
    """group -> (filled, min, max, summary) of ``long`` (group_id, x): one row per group, one scan."""
    rows = long.groupBy("group_id").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), summary().alias("points")).collect()
    return {r.group_id: (r.n, r.lo, r.hi, r.points) for r in rows if r.n}


def _bracket(k: int, n: int, lo: float, hi: float, points: list[float]) -> tuple[float, float]:
    """Values between which the 0-based rank ``k`` of ``n`` lies."""
    slack = n / ACCURACY + 1
    i, j = math.floor((k + 1 - slack) / n * STEPS), math.ceil((k + 1 + slack) / n * STEPS)
    return points[i] if i > 0 else lo, points[j] if j < STEPS else hi


def select_ranks(long: DataFrame, targets: list[tuple[str, int]], bounds: Mapping[str, Bounds] | None = None) -> dict[tuple[str, int], float]:
    """Exact value at each 0-based rank of each group of ``long`` (group_id, x).

    Two scans, whatever the values: ``group_bounds`` (which a caller may have made along with other aggregates)
    brackets every rank by two points of a sketch, less than a hundredth of the rows apart; the second scan counts
    the rows below each bracket and the values inside it.  Those counts are checkpointed, and the ranks
    are found among them: in the driver where they are at most FEW, else by ``_ranks_by_bins``.
    """
    bounds = bounds or group_bounds(long)
    wanted = {(g, k): _bracket(k, *bounds[g]) for g, k in targets if g in bounds}
    found = _within(long, wanted)
    # a rank outside its bracket would break the sketch's promise: looked for in the whole group all the same
    missed = {(g, k): bounds[g][1:3] for g, k in wanted.keys() - found.keys()}
    return {**found, **_within(long, missed)} if missed else found


def _within(long: DataFrame, wanted: Mapping[tuple[str, int], tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The ranks that lie between their two values."""
    if not wanted:
        return {}
    spans = sorted({(g, *pair) for (g, _), pair in wanted.items()})
    place = {span: i for i, span in enumerate(spans)}
    frame = long.sparkSession.createDataFrame([(i, *span) for i, span in enumerate(spans)], "span int, group_id string, lo double, hi double")
    # what is below a bracket is one row of it, without a value
    counted = cut_lineage(
        long.join(F.broadcast(frame), "group_id").where(F.col("x") <= F.col("hi"))
        .groupBy("span", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    totals = {r.span: (r.below, r.inside) for r in counted.groupBy("span").agg(
        F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)).alias("inside")).collect()}
    ranks = {}
    for (g, k), pair in wanted.items():
        span = place[(g, *pair)]
        below, inside = totals.get(span, (0, 0))
        if below <= k < below + inside:
            ranks[(g, k)] = (span, k - below)
    values = counted.where(F.col("x").isNotNull())
    some = values.limit(FEW + 1).collect()
    at = _ranks_by_bins(values, set(ranks.values())) if len(some) > FEW else _ranks_of_rows(some, set(ranks.values()))
    return {key: at[rank] for key, rank in ranks.items()}


def _ranks_of_rows(rows: list, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """(span, rank) -> value, of rows (span, x, n) that are all here."""
    ordered = sorted(rows, key=lambda r: (r.span, r.x))
    found, todo, span, upto = {}, sorted(wanted, reverse=True), None, 0
    for r in ordered:
        upto = r.n if r.span != span else upto + r.n
        span = r.span
        while todo and todo[-1][0] == span and todo[-1][1] < upto:
            found[todo.pop()] = r.x
    return found


def _ranks_by_bins(values: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """(span, rank) -> value, of ``values`` (span, x, n).

    Every pass counts 2 048 equal-width bins between known bounds and keeps, per rank, the one bin that holds
    it.  A bin with one distinct value ends the search, and so do at most FEW rows in all bins kept.  What reaches the driver is bins per rank and those rows, whatever the table.
    """
    finite = F.when(F.abs("x") < math.inf, F.col("x"))
    edges = {r.span: r for r in values.groupBy("span").agg(
        F.sum(F.when(F.col("x") == -math.inf, F.col("n")).otherwise(0)).alias("first"), F.sum(F.when(F.abs("x") < math.inf, F.col("n")).otherwise(0)).alias("inside"),
        F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()}
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int, float, float, int]] = {}
    for span, k in wanted:
        e = edges[span]
        if e.first <= k < e.first + e.inside:
            open_[(span, k)] = (span, e.lo, e.hi, k - e.first)
        else:
            found[(span, k)] = -math.inf if k < e.first else math.inf
    while True:
        for key, (_, lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            return found
        parts = sorted({part[:3] for part in open_.values()})
        frame = values.sparkSession.createDataFrame([(i, *part) for i, part in enumerate(parts)], "part int, span int, lo double, hi double")
        width = F.col("hi") - F.col("lo")  # beyond the range of a double, halves are compared
        share = F.when(width < math.inf, (F.col("x") - F.col("lo")) / width).otherwise(
            (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        bins = (
            values.join(F.broadcast(frame), "span")
            .where(F.col("x").between(F.col("lo"), F.col("hi")))
            .groupBy("part", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("rows_"))
            .collect()
        )
        by_part: dict[int, list] = {}
        for row in sorted(bins, key=lambda r: (r.part, r.bin)):
            by_part.setdefault(row.part, []).append(row)
        position = {part: i for i, part in enumerate(parts)}
        inside: dict[tuple[int, float, float], int] = {}
        for key, (span, lo, hi, rank) in list(open_.items()):
            for row in by_part[position[(span, lo, hi)]]:
                if rank < row.n:
                    open_[key] = (span, row.lo, row.hi, rank)
                    inside[open_[key][:3]] = row.rows_
                    break
                rank -= row.n
        if sum(inside.values()) <= FEW:
            kept = sorted(part for part in inside if part[1] < part[2])
            spans = values.sparkSession.createDataFrame([(i, *part) for i, part in enumerate(kept)], "part int, span int, lo double, hi double")
            rows = values.join(F.broadcast(spans), "span").where(F.col("x").between(F.col("lo"), F.col("hi"))).select(F.col("part").alias("span"), "x", "n").collect() if kept else []
            place = {part: i for i, part in enumerate(kept)}
            todo = {key: (place[part[:3]], part[3]) for key, part in open_.items() if part[:3] in place}
            at = _ranks_of_rows(rows, set(todo.values()))
            found.update({key: at[rank] for key, rank in todo.items()})
            found.update({key: part[1] for key, part in open_.items() if part[:3] not in place})
            return found


def exact_medians(long: DataFrame, bounds: Mapping[str, Bounds] | None = None) -> dict[str, float]:
    """Exact median per group of ``long`` (group_id, x)."""
    bounds = bounds or group_bounds(long)
    targets = [(g, k) for g, (n, *_) in bounds.items() for k in {(n - 1) // 2, n // 2}]
    at = select_ranks(long, targets, bounds)
    return {g: (at[(g, (n - 1) // 2)] + at[(g, n // 2)]) / 2 for g, (n, *_) in bounds.items()}


def medians_of_counts(values: DataFrame, filled: Mapping[int, int]) -> dict[int, float]:
    """Exact median per span of ``values`` (span, x, n), distinct values and how often they occur; ``filled`` sums n."""
    ranks = {(span, k) for span, n in filled.items() for k in ((n - 1) // 2, n // 2)}
    at = _ranks_by_bins(values, ranks) if ranks else {}
    return {span: (at[(span, (n - 1) // 2)] + at[(span, n // 2)]) / 2 for span, n in filled.items()}


def nearest_rank(n: int, q: float) -> int:
    """0-based rank of a percentile: half-even rounding of ``q * (n - 1)``."""
    return min(n - 1, int(round(q * (n - 1))))


def number_rows(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """1 … n in the order given, gap-free, with one range shuffle.

    The sorted table is checkpointed so that partition offsets and rows come from
    the same layout; one count per partition reaches the driver.
    """
    mask = (1 << 33) - 1
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row.part, total))
        total += row.n
    if not offsets:
        return placed.select(F.lit(0).cast("bigint").alias(name), *df.columns)
    frame = df.sparkSession.createDataFrame(offsets, "part bigint, offset bigint")
    return (
        placed.withColumn("part", part).join(F.broadcast(frame), "part")
        .select(
            (F.col("offset") + F.col("_at").bitwiseAND(F.lit(mask)) + 1).alias(name),
            *[F.col(f"`{c}`") for c in df.columns],
        )
    )


def spacing(df: DataFrame, column: str, buckets: int = 20_000) -> DataFrame:
    """Points, mean gap and population deviation between consecutive distinct seconds.

    Gaps are taken inside time buckets in parallel; only each bucket's first and
    last second (at most ``buckets`` rows, by construction) are ordered together.
    """
    from pyspark.sql import Window

    seconds = df.select(F.unix_timestamp(F.col(column)).alias("s")).where("s is not null").distinct()
    edge = seconds.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    width = 1 if edge.lo is None else max(1, math.ceil((edge.hi - edge.lo + 1) / buckets))
    base = edge.lo or 0
    marked = seconds.withColumn("b", F.floor((F.col("s") - base) / width))
    inside = Window.partitionBy("b").orderBy("s")
    per = (
        marked.withColumn("gap", F.col("s") - F.lag("s").over(inside))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"),
             F.sum(F.col("gap").cast("decimal(38,0)") * F.col("gap")).alias("sq"))
    )
    joined = per.withColumn(
        "gap", F.col("first_s") - F.lag("last_s").over(Window.orderBy("b"))
    )
    total = joined.agg(
        F.sum("n").alias("points"), F.min("first_s").alias("lo"), F.max("last_s").alias("hi"),
        (F.coalesce(F.sum("sq"), F.lit(0)) + F.coalesce(F.sum(F.col("gap").cast("decimal(38,0)") * F.col("gap")), F.lit(0)))
        .cast("double").alias("sq"),
    )
    gaps = F.col("points") - 1
    mean = (F.col("hi") - F.col("lo")) / gaps
    return (
        total.where(F.col("points") > 1)
        .select("points", mean.alias("mean_seconds"),
                F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / gaps - mean * mean)).alias("std_seconds"))
    )
