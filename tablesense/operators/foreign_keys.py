"""Which columns refer to which keys, scored from value overlap, reach and names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablesense import values as V
from tablesense.functions.text import normalise_name
from tablesense.functions.vectors import name_similarity
from tablesense.operators.value_counts import (
    ColumnEvidence, ColumnRef, column_refs, gather_evidence, has_bit, value_masks,
)

PAIR = ["from_table", "from_column", "to_table", "to_column"]


def referenceable(refs: Iterable[ColumnRef], filled: Mapping[int, tuple[int, int]], min_rows: int) -> list[ColumnRef]:
    """Columns that could hold a reference: whole-valued, not boolean, in a large enough table."""
    return [
        r for r in refs
        if not r.fractional and r.family != "boolean" and filled[r.cid][0] >= min_rows
    ]


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Score rows (…, matched, source_distinct, target_distinct, name_similarity)."""
    overlap = F.col("matched") / F.col("source_distinct")
    reach = F.col("matched") / F.col("target_distinct")
    base = V.OVERLAP_WEIGHT * overlap + V.REACH_WEIGHT * reach
    score = F.least(F.lit(1.0), base + V.NAME_BOOST * F.greatest(F.lit(0.0), F.col("name_similarity")))
    return (
        pairs.withColumn("ratio_overlap", overlap).withColumn("ratio_reach", reach).withColumn("score", score)
        .where((F.col("ratio_overlap") >= V.MIN_OVERLAP) & (F.col("ratio_reach") > V.MIN_REACH)
               & (F.col("score") >= V.FUZZY_FLOOR))
        .withColumn("origin", F.when(F.col("score") >= V.ACCEPT_SCORE, "detected").otherwise("fuzzy"))
    )


def best_per_column(candidates: DataFrame) -> DataFrame:
    """Highest score per source column; equal scores keep the earlier target."""
    w = Window.partitionBy("from_table", "from_column").orderBy(F.desc("score"), "target_order")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def candidate_pairs(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, str],
    evidence: ColumnEvidence, min_rows: int = V.FK_MIN_ROWS, claimed: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """Every (column, key column) of one family that shares a value, with its counts.

    At most columns × keys rows of counts; the values stayed on the executors.
    """
    order = {t: i for i, t in enumerate(tables)}
    usable = {r.cid: r for r in referenceable(evidence.refs, evidence.filled, min_rows)}
    taken = set(claimed)
    rows = []
    for (left, right), matched in sorted(evidence.shared.items()):
        a, b = usable.get(left), usable.get(right)
        if not a or not b or left == right or keys.get(b.table) != b.column:
            continue
        if evidence.distinct(a) >= 2 and (a.table, a.column) not in taken:
            rows.append((a.table, a.column, b.table, b.column, matched, evidence.distinct(a),
                         evidence.distinct(b), order[b.table]))
    return spark.createDataFrame(
        rows,
        "from_table string, from_column string, to_table string, to_column string, matched bigint, "
        "source_distinct bigint, target_distinct bigint, target_order int",
    )


def with_name_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "name_similarity",
        name_similarity(normalise_name(F.col("from_column")), normalise_name(F.col("to_column"))),
    )


def foreign_keys(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, str],
    declared: DataFrame | None = None, min_rows: int = V.FK_MIN_ROWS,
    evidence: ColumnEvidence | None = None,
) -> DataFrame:
    """Best single-column key per source column; declared references come first, unscored."""
    claimed = [(r.from_table, r.from_column) for r in declared.collect()] if declared is not None else []
    scored = best_per_column(
        score_candidates(with_name_similarity(candidate_pairs(spark, tables, keys, evidence or gather_evidence(tables), min_rows, claimed)))
    ).drop("target_order")
    if declared is None:
        return scored
    return declared_references(declared).unionByName(scored, allowMissingColumns=True)


def declared_references(declared: DataFrame) -> DataFrame:
    """References a source states about itself: taken as given, score 1."""
    return declared.select(
        *PAIR, F.lit(1.0).alias("score"), F.lit(1.0).alias("ratio_overlap"), F.lit(1.0).alias("ratio_reach"),
        F.lit(0.0).alias("name_similarity"), F.lit("declared").alias("origin"),
    )


def small_tables(counts: DataFrame, min_rows: int = V.FK_MIN_ROWS) -> DataFrame:
    return counts.where(F.col("row_count") < min_rows)


def orphan_samples(
    tables: Mapping[str, DataFrame], candidates: list[tuple[str, str, str, str]], k: int = 10
) -> DataFrame:
    """Smallest ``k`` unmatched values per candidate, all candidates in one pass.

    Each task keeps at most ``k`` values per candidate before anything is shuffled.
    """
    refs = {(r.table, r.column): r for r in column_refs(tables)}
    out = None
    for group in sorted({refs[(c[0], c[1])].family for c in candidates}):
        mine = [c for c in candidates if refs[(c[0], c[1])].family == group]
        used = sorted({x for c in mine for x in ((c[0], c[1]), (c[2], c[3]))})
        slot = {x: i for i, x in enumerate(used)}
        masks = value_masks(tables, [refs[x] for x in used], group)
        hits = F.array_compact(F.array(*[
            F.when(has_bit(slot[(a, b)]) & ~has_bit(slot[(c, d)]),
                   F.struct(F.lit(a).alias("from_table"), F.lit(b).alias("from_column"),
                            F.lit(c).alias("to_table"), F.lit(d).alias("to_column")))
            for a, b, c, d in mine
        ]))
        rows = masks.select(F.inline(hits), F.col("value").cast("string").alias("orphan"))
        w = Window.partitionBy(*PAIR).orderBy("orphan")
        part = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
        out = part if out is None else out.unionAll(part)
    return out
