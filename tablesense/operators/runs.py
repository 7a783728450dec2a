"""Metrics over run records: accuracy, intervals, latency, paired and selective comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense import values as V
from tablesense.functions.stats import mcnemar_p, wilson
from tablesense.operators.ranks import group_bounds, nearest_rank, select_ranks

METRICS = ("strict", "normalised", "relaxed")


def verdicts(records: DataFrame, cap: int | None = None) -> DataFrame:
    """The three verdicts, optionally re-read under another cap on surplus columns."""
    relaxed = F.coalesce("relaxed", F.lit(False))
    if cap is not None:
        relaxed = F.coalesce("relaxed_match", F.lit(False)) & (F.col("extra_columns") <= cap)
    return (
        records.withColumn("strict", F.coalesce("strict", F.lit(False))).withColumn("normalised", F.coalesce("normalised", F.lit(False)))
        .withColumn("relaxed", F.coalesce(relaxed, F.lit(False)) | F.coalesce("normalised", F.lit(False)))
    )


def run_metrics(records: DataFrame, cap: int | None = None) -> DataFrame:
    """Per arm, and per arm × difficulty and arm × database: counts and rates.

    Grouping sets over pre-aggregable sums: one shuffle of a few rows per task.
    """
    v = verdicts(records, cap)
    aggs = [
        F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(m) for m in METRICS], F.count_if(F.col("outcome") == "answered").alias("answered"),
        F.count_if((F.col("outcome") == "answered") & F.col("relaxed")).alias("correct_when_answered"), F.count_if("first_attempt_ok").alias("first_attempt"),
        F.count_if(F.col("predicted_sql").isNotNull() & F.col("predicted_error").isNull()).alias("valid_sql"),
        F.sum("n_attempts").alias("attempts"), F.sum("total_tokens").alias("tokens"), F.avg("elapsed_seconds").alias("mean_seconds"),
    ]
    sets = v.groupingSets([("arm",), ("arm", "difficulty"), ("arm", "db_id")], "arm", "difficulty", "db_id").agg(*aggs, F.grouping_id().alias("_g"))
    low, high = wilson(F.col("relaxed"), F.col("n"))
    return sets.withColumn("slice", F.when(F.col("_g") == 3, "arm").when(F.col("_g") == 1, "difficulty").otherwise("database")).drop("_g").withColumn(
        "accuracy", F.col("relaxed") / F.col("n")).withColumn("low", low).withColumn("high", high)


def latency(spark: SparkSession, records: DataFrame, q: float = 0.9) -> DataFrame:
    """Exact median and nearest-rank percentile of seconds per arm, without sorting an arm."""
    long = records.where(F.col("elapsed_seconds").isNotNull()).select(F.col("arm").alias("group_id"), F.col("elapsed_seconds").cast("double").alias("x"))
    bounds = group_bounds(long)
    counts = {g: n for g, (n, *_) in bounds.items()}
    ranks = {g: ((n - 1) // 2, n // 2, nearest_rank(n, q)) for g, n in counts.items()}
    at = select_ranks(long, [(g, k) for g, three in ranks.items() for k in set(three)], bounds)
    return spark.createDataFrame(
        [(g, counts[g], (at[(g, a)] + at[(g, b)]) / 2, at[(g, c)]) for g, (a, b, c) in ranks.items()], "arm string, n bigint, median_seconds double, p90_seconds double")


def paired(raw: DataFrame, semantic: DataFrame, metric: str = "relaxed", by: list[str] = (), key: tuple[str, ...] = ("db_id", "question_id")) -> DataFrame:
    """Both right, one right, neither, and the paired p-value, overall or per slice of ``by``."""
    a = raw.select(*key, *by, F.col(metric).alias("a"))
    b = semantic.select(*key, F.col(metric).alias("b"))
    joined = a.join(b, list(key))
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") & F.col("b")).alias("both_correct"), F.count_if(~F.col("a") & F.col("b")).alias("semantic_only"),
        F.count_if(F.col("a") & ~F.col("b")).alias("raw_only"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))
    return out.withColumn("mcnemar_p", mcnemar_p(F.col("semantic_only"), F.col("raw_only"))).withColumn(
        "semantic_minus_raw", (F.col("semantic_only") - F.col("raw_only")) / F.col("n"))


def selective(records: DataFrame, cuts: tuple[float, ...] = V.CONFIDENCE_CUTS) -> DataFrame:
    """Coverage and accuracy of what is kept at each confidence cut; one conditional aggregate."""
    kept = lambda t: (F.col("outcome") == "answered") & (F.col("confidence") >= t)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(cuts):
        aggs += [F.count_if(kept(t)).alias(f"k{i}"), F.count_if(kept(t) & F.col("relaxed")).alias(f"c{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("min_confidence"), F.col(f"k{i}").alias("kept"), F.col(f"c{i}").alias("correct")) for i, t in enumerate(cuts)])
    return records.agg(*aggs).select("n", F.inline(rows)).select(
        "min_confidence", "n", "kept", "correct", (F.col("kept") / F.col("n")).alias("coverage"), F.when(F.col("kept") > 0, F.col("correct") / F.col("kept")).alias("accuracy"))


def store_buckets(records: DataFrame) -> DataFrame:
    """Accuracy by how many examples had been saved: 0, 1-5, 6-20, 21+."""
    n = F.col("examples_in_store")
    bucket = F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").otherwise("21+")
    return records.groupBy(bucket.alias("examples")).agg(F.count(F.lit(1)).alias("n"), F.count_if("relaxed").alias("correct"))


def retrieval_recall(gold: DataFrame, sent: DataFrame, question: list[str], name: str) -> DataFrame:
    """Share of each question's needed names that were sent."""
    wanted, given = gold.select(*question, name).distinct(), sent.select(*question, name).distinct().withColumn("_sent", F.lit(True))
    return wanted.join(given, [*question, name], "left").groupBy(*question).agg(
        F.count(F.lit(1)).alias("needed"), F.count_if(F.col("_sent").isNotNull()).alias("sent")).withColumn("recall", F.col("sent") / F.col("needed"))


def touches_drift(gold: DataFrame, drifted: DataFrame, question: list[str], name: str) -> DataFrame:
    """Questions that read at least one changed column."""
    return gold.join(drifted.select(name).distinct(), name, "left_semi").select(*question).distinct()


def metric_slices(
    records: DataFrame, recalls: DataFrame, changed: DataFrame, question: list[str], cuts: tuple[float, ...] = V.RECALL_CUTS, cap: int | None = None,
) -> DataFrame:
    """(slice, arm, changed, min_recall, n, the verdicts, answered, accuracy): how runs fare where retrieval did well, and on changed columns.

    ``recalls`` is (question, recall) as ``retrieval_recall`` gives it, ``changed`` the questions of ``touches_drift``.
    A record counts at every cut that its recall reaches, so its highest cut is what it is grouped by: one
    shuffle of grouping sets, whose few rows are then summed from cut to cut.  Records of questions without a known recall
    are in the slices "all" and "changed" only; a slice without records has no row.
    """
    cuts = tuple(sorted(cuts))
    reached = sum((F.when(F.col("recall") >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    v = (
        verdicts(records, cap).join(recalls.groupBy(*question).agg(F.max("recall").alias("recall")), question, "left")
        .join(changed.select(*question).distinct().withColumn("changed", F.lit(True)), question, "left")
        .withColumn("changed", F.coalesce("changed", F.lit(False))).withColumn("reached", reached))
    sums = ["n", *METRICS, "answered"]
    sets = v.groupingSets([("arm",), ("arm", "changed"), ("arm", "reached"), ("arm", "changed", "reached")], "arm", "changed", "reached").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(m) for m in METRICS], F.count_if(F.col("outcome") == "answered").alias("answered"), F.grouping_id().alias("_g"))
    by_recall = F.col("_g").bitwiseAND(F.lit(1)) == 0
    of = F.when(by_recall, F.slice(F.array(*map(F.lit, cuts)), F.lit(1), F.col("reached"))).otherwise(F.array(F.lit(None).cast("double")))
    name = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "changed").when(F.col("_g") == 2, "recall").otherwise("changed, recall")
    out = sets.select("arm", "changed", name.alias("slice"), F.explode(of).alias("min_recall"), *sums)
    return out.groupBy("slice", "arm", "changed", "min_recall").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("accuracy", F.col("relaxed") / F.col("n"))
