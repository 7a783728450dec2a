"""Reproducible stratified samples, their complement, and run order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def quotas(df: DataFrame, strata: Sequence[str], size: int) -> DataFrame:
    """(strata, n, quota): proportional shares, the largest remainders rounded up.

    One row per stratum; the ranking of remainders is over strata, not rows.
    """
    counted = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("t")).first().t or 0
    if size >= total:
        return counted.withColumn("quota", F.col("n"))
    share = F.col("n") * size / F.lit(total)
    floored = counted.withColumn("_floor", F.floor(F.col("n") * size / total)).withColumn("_rest", share - F.floor(share))
    short = size - (floored.agg(F.sum("_floor").alias("s")).first().s or 0)
    w = Window.orderBy(F.desc("_rest"), *[F.desc(s) for s in strata])
    return floored.withColumn("_r", F.row_number().over(w)).select(
        *strata, "n", (F.col("_floor") + F.when(F.col("_r") <= short, 1).otherwise(0)).alias("quota"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows, stratum by stratum, the same for the same key and seed.

    Rows are ordered by a hash of their key; each task keeps no more than the
    sample size per stratum before the shuffle.
    """
    plan = quotas(df, strata, size)
    most = plan.agg(F.max("quota").alias("q")).first().q or 0
    draw = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    w = Window.partitionBy(*strata).orderBy("_draw", *key)
    ranked = df.withColumn("_draw", draw).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return ranked.join(F.broadcast(plan.select(*strata, "quota")), list(strata)).where(F.col("_r") <= F.col("quota")).drop("_draw", "_r", "quota")


def sample_by_band(df: DataFrame, band: str, strata: Sequence[str], key: Sequence[str], per_band: dict[str, int], seed: int = 0) -> DataFrame:
    """A fixed number per band (say, difficulty), spread over strata in proportion."""
    out = None
    for name, size in per_band.items():
        part = df.where(F.col(band) == name)
        held = part.count()
        if held < size:
            raise ValueError(f"only {held} rows in {name!r}, {size} requested")
        chosen = stratified_sample(part, strata, key, size, seed)
        out = chosen if out is None else out.unionByName(chosen)
    return out


def rest_of(df: DataFrame, asked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Everything not yet asked."""
    return df.join(asked.select(*key), list(key), "left_anti")


def run_order(databases: Sequence[str], bands: Sequence[str], db: str, band: str, position: str) -> list[Column]:
    """Sort keys: listed databases first, then by name; easy bands first; then incoming order."""
    def place(column: str, names: Sequence[str]) -> Column:
        out = F.lit(len(names))
        for i, n in enumerate(names):
            out = F.when(F.col(column) == n, i).otherwise(out)
        return out

    listed = F.col(db).isin(*databases) if databases else F.lit(False)
    return [place(db, databases), F.when(listed, "").otherwise(F.col(db)), place(band, bands), F.col(position)]
