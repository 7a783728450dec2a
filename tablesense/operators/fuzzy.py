"""Approximate matches of unmatched values to real keys (ratio of 90 or more)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesense import values as V
from tablesense.functions.ratios import indel_similarity
from tablesense.session import cut_lineage

#: Longer values are blocked by intact chunks, shorter ones by deletion variants.
SHORT = 24


def _edits(total: Column) -> Column:
    """Most insertions plus deletions a pair of this total length may differ by."""
    return F.floor(total * (100 - V.FUZZY_RATIO) / 100 + 1e-9).cast("int")


def _delete_one(variants: Column) -> Column:
    """Every text with one more character removed."""
    return F.array_distinct(F.flatten(F.transform(
        variants,
        lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
            lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))),
        ),
    )))


def _variants(df: DataFrame, depth: int) -> DataFrame:
    """(value, deleted, variant digest) with up to ``depth`` characters removed."""
    current = df
    for k in range(1, depth + 1):
        current = current.withColumn(f"_v{k}", _delete_one(F.col(f"_v{k - 1}") if k > 1 else F.array("value")))

    def digests(texts: Column, k: int) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(k).alias("deleted"), F.xxhash64(t).alias("variant")))

    sets = [digests(F.array("value"), 0)]
    for k in range(1, depth + 1):
        some = F.when(F.length("value") > k, F.col(f"_v{k}")).otherwise(F.array().cast("array<string>"))
        sets.append(digests(some, k))
    return current.select("value", F.inline(F.concat(*sets)))


def _short_pairs(orphans: DataFrame, keys: DataFrame, depth: int) -> DataFrame:
    """Pairs of short values that become equal after a few deletions on either side.

    Two strings at insertion/deletion distance d share the text left after deleting
    a characters of one and b of the other, a + b = d, so this equality join is
    exact; only genuine near matches meet, whatever prefixes the values share.
    """
    left = _variants(orphans, depth).select(
        F.col("value").alias("orphan"), F.col("deleted").alias("a"), "variant")
    right = _variants(keys, depth).select(F.col("value").alias("key"), F.col("deleted").alias("b"), "variant")
    total = F.length("orphan") + F.length("key")
    return (
        left.join(right, "variant")
        .where((F.col("a") - F.col("b") == F.length("orphan") - F.length("key")) & (F.col("a") + F.col("b") <= _edits(total)))
        .select("orphan", "key")
    )


def _long_pairs(orphans: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs of long values that share one intact chunk at nearly the same place.

    An orphan is cut into one chunk more than the edits a partner may need, so one
    chunk survives unchanged, displaced by no more than the edits.
    """
    most = _edits(F.length("value") * 20 / 9)  # partners are at most 11/9 as long
    size = F.greatest(F.lit(1), F.floor(F.length("value") / (most + 1)).cast("int"))
    chunks = orphans.withColumn("most", most).withColumn("size", size).select(
        F.col("value").alias("orphan"), "most", "size",
        F.explode(F.sequence(F.lit(0), F.col("most"))).alias("i"),
    ).select("orphan", "most", "size", (F.col("i") * F.col("size")).alias("at"),
             F.col("orphan").substr(F.col("i") * F.col("size") + 1, F.col("size")).alias("chunk"))
    sizes = [r.size for r in chunks.select("size").distinct().collect()]
    if not sizes:
        return orphans.select(F.col("value").alias("orphan"), F.col("value").alias("key")).limit(0)
    pieces = keys.select(F.col("value").alias("key"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where(
        F.length("key") >= F.col("size")
    ).select("key", "size", F.explode(F.sequence(F.lit(0), F.length("key") - F.col("size"))).alias("from"))
    pieces = pieces.select("key", "size", "from", F.col("key").substr(F.col("from") + 1, F.col("size")).alias("chunk"))
    gap = F.abs(F.length("orphan") - F.length("key"))
    return (
        chunks.join(pieces, ["chunk", "size"])
        .where((F.abs(F.col("from") - F.col("at")) <= F.col("most")) & (gap <= _edits(F.length("orphan") + F.length("key"))))
        .select("orphan", "key").distinct()
    )


def fuzzy_matches(orphans: DataFrame, keys: DataFrame, column: str = "value") -> DataFrame:
    """(orphan, key, ratio) for every pair of ratio >= 90; both sides read whole."""
    o = orphans.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    k = keys.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    longest = o.agg(F.max(F.when(F.length("value") <= SHORT, F.length("value"))).alias("n"), F.max(F.length("value")).alias("all")).first()
    parts = []
    if longest.n is not None:
        reach = int(longest.n * 11 / 9) + 1
        depth = int((longest.n + reach) * (100 - V.FUZZY_RATIO) / 100)
        parts.append(_short_pairs(o.where(F.length("value") <= SHORT), k.where(F.length("value") <= reach), depth))
    if longest["all"] is not None and longest["all"] > SHORT:
        parts.append(_long_pairs(o.where(F.length("value") > SHORT), k.where(F.length("value") > SHORT * 9 // 11)))
    if not parts:
        return o.select(F.col("value").alias("orphan"), F.col("value").alias("key"), F.lit(0.0).alias("ratio")).limit(0)
    pairs = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return (
        pairs.distinct().withColumn("ratio", indel_similarity(F.col("orphan"), F.col("key")))
        .where(F.col("ratio") >= V.FUZZY_RATIO)
    )


def _deleted(df: DataFrame, count: int) -> DataFrame:
    """(value, rest): every text left when exactly ``count`` characters of a value are taken out."""
    rests = F.array("value")
    for _ in range(count):
        rests = _delete_one(rests)
    return df.where(F.length("value") >= count).select("value", F.explode(rests).alias("rest"))


def _short_best(orphans: DataFrame, keys: DataFrame) -> DataFrame:
    """(orphan, distance, key): the best key of each short value, distance by distance.

    What is left of a pair when a characters of one and b of the other are taken out is the same text for a + b =
    their insertion/deletion distance and for no smaller sum, so the sum at which two values first meet is their
    distance.  Up to SHORT characters a smaller distance always means a higher ratio, so values that found a
    key look no further: a round joins only those still alone, and keeps one key of each by an aggregate that is
    combined before the shuffle (the longest, whose ratio is higher, then the first by its text).
    """
    none = orphans.select(F.col("value").alias("orphan"), F.lit(0).alias("distance"), F.col("value").alias("key")).limit(0)
    found, left = [], orphans
    longest = orphans.agg(F.max(F.length("value"))).first()[0]
    if longest is None:
        return none
    most = next(d for d in range(longest, -1, -1) if 100 * d <= (100 - V.FUZZY_RATIO) * (2 * longest + d))
    for distance in range(most + 1):
        met = []
        for a in range(distance + 1):
            b = distance - a
            # a key is as long as a value still alone, less what that one loses, plus what the key does
            lengths = left.select((F.length("value") - a + b).alias("n")).distinct()  # at most SHORT rows
            fitting = keys.join(F.broadcast(lengths), F.length("value") == F.col("n"), "left_semi")
            o, k = _deleted(left, a).withColumnRenamed("value", "orphan"), _deleted(fitting, b).withColumnRenamed("value", "key")
            met.append(o.join(k, "rest").select("orphan", "key"))
        total = F.length("orphan") + F.length("key")
        near = reduce(DataFrame.unionAll, met).where(100 * distance <= (100 - V.FUZZY_RATIO) * total)
        best = cut_lineage(
            near.groupBy("orphan").agg(F.min(F.struct((-F.length("key")).alias("shorter"), "key")).alias("best"))
            .select("orphan", F.lit(distance).alias("distance"), "best.key"))
        found.append(best)
        left = cut_lineage(left.join(best.select(F.col("orphan").alias("value")), "value", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionAll, found, none)


def best_matches(orphans: DataFrame, keys: DataFrame, column: str = "value") -> DataFrame:
    """(orphan, key, ratio): for every distinct orphan with a key of ratio >= 90, the best one (ties: the first by its text).

    The output is one row per orphan, however many keys are alike.  Values of up to SHORT characters get their
    distance from the join itself; longer ones are met by an intact chunk and compared.  Nulls are no values.
    """
    o, k = (d.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct() for d in (orphans, keys))
    total = F.length("orphan") + F.length("key")
    short = _short_best(cut_lineage(o.where(F.length("value") <= SHORT)), k).select(
        "orphan", "key", F.when(total == 0, 100.0).otherwise(100 * (1 - F.col("distance") / total)).alias("ratio"))
    long = o.where(F.length("value") > SHORT)
    if long.isEmpty():
        return short
    pairs = _long_pairs(long, k.where(F.length("value") > SHORT * 9 // 11)).withColumn("ratio", indel_similarity(F.col("orphan"), F.col("key")))
    best = F.min(F.struct((-F.col("ratio")).alias("less"), "key")).alias("best")
    return short.unionAll(
        pairs.where(F.col("ratio") >= V.FUZZY_RATIO).groupBy("orphan").agg(best).select("orphan", "best.key", (-F.col("best.less")).alias("ratio")))


def recovered(orphans: DataFrame, keys: DataFrame, column: str = "value") -> DataFrame:
    """One row: distinct orphans, and how many are near matches of a real key."""
    hits = best_matches(orphans, keys, column).select(F.col("orphan").alias("_o"))
    every = orphans.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    joined = every.join(hits, F.col("value") == F.col("_o"), "left")
    return joined.agg(F.count(F.lit(1)).alias("orphans"), F.count("_o").alias("recovered"))


def recovered_references(spark: SparkSession, tables: Mapping[str, DataFrame], candidates: DataFrame) -> DataFrame:
    """(from, to, orphans, recovered, example) of the candidates found in the fuzzy band: how many of the values that match
    nothing are near matches of a real key.  Evidence for a reader: no candidate's score or status changes.
    """
    from tablesense.operators.foreign_keys import PAIR
    from tablesense.operators.value_counts import cell_text

    parts = []
    for r in candidates.where("origin = 'fuzzy'").select(*PAIR).collect():  # a catalogue
        child, parent = (
            tables[t].select(cell_text(F.col(f"`{c}`"), tables[t].schema[c].dataType).alias("value")).where("value IS NOT NULL").distinct()
            for t, c in ((r.from_table, r.from_column), (r.to_table, r.to_column)))
        orphans = cut_lineage(child.join(parent, "value", "left_anti"))
        hits = best_matches(orphans, parent)
        parts.append(
            orphans.join(hits.select(F.col("orphan").alias("value"), "key"), "value", "left")
            .agg(F.count(F.lit(1)).alias("orphans"), F.count("key").alias("recovered"),
                 F.min(F.when(F.col("key").isNotNull(), F.concat_ws(" ~ ", "value", "key"))).alias("example"))
            .select(*[F.lit(r[c]).alias(c) for c in PAIR], "orphans", "recovered", "example"))
    empty = ", ".join(f"{c} string" for c in PAIR) + ", orphans bigint, recovered bigint, example string"
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], empty)
