"""Sharding by proportional stratified interleaving: every shard holds the sources in the corpus's mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import settle

#: What a row takes beside its text.
ROW_BYTES = 16


def interleave(
    docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str = "source", buckets: int = 1024,
) -> DataFrame:
    """Shard and slot of every row: seeded shuffle within each stratum, fractional rank, equal cuts.

    Row r of the n rows of its stratum, in the order of ``md5(seed:id)``, gets the fractional rank
    (2r - 1) / 2n.  All rows in the order of that rank are cut into ``shards`` runs whose lengths
    differ by one at most, so every run holds each stratum of n rows in proportion to within 1 + S n / N rows (of N rows, S strata).

    Returns (id_col, size, text_crc32, stratum, shard, slot): ``size`` is the UTF-8 bytes of the text and ROW_BYTES,
    ``text_crc32`` the unsigned crc32 of them, ``slot`` the gapless place in the shard from 0.

    Ranks are counted in two steps, so that no stratum is sorted in one task: rows are counted per
    bucket, running totals of these counts give each bucket's first rank, and row numbers are made
    within a bucket only.  ``buckets`` bounds the totals of a stratum; at 10 billion rows and a
    source of a third of them a bucket of the default holds about three million short rows.

    Defined cases: null text is empty; null stratum is a stratum of its own; null id hashes as an
    empty string; equal hashes are ordered by id, crc32 and size, and rows equal in all of
    these are interchangeable; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    rows = settle(
        docs.select(
            F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.col(f"`{stratum_col}`").alias("stratum"), mixed.alias("mixed"),
        ).withColumn("bucket", F.floor(F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")),
        "shard-rows",
    )
    ahead = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("stratum")))
        .select(F.col("stratum").alias("of"), F.col("bucket").alias("at"), "before", "total")
    )
    within = Window.partitionBy("stratum", "bucket").orderBy("mixed", "id", "crc", "size")
    ranked = settle(
        rows.withColumn("r", F.row_number().over(within))
        .join(counts, F.col("stratum").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
        .select("id", "size", "crc", "stratum", "mixed", ((2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("total"))).alias("rank"))
        .withColumn("cell", F.floor(F.col("rank") * buckets).cast("int")),
        "fractional-ranks",
    )
    cells = (
        ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
        .select(F.col("cell").alias("at"), "before", "total")
    )
    place = Window.partitionBy("cell").orderBy("rank", "mixed", "stratum", "id", "crc", "size")
    placed = (
        ranked.withColumn("r", F.row_number().over(place)).join(F.broadcast(cells), F.col("cell") == F.col("at"))
        .withColumn("place", F.col("before") + F.col("r") - 1)
        .withColumn("shard", F.expr(f"place * {shards} div total"))
    )
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "stratum",
        F.col("shard").cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write ``docs``, all columns, to ``path``/shard=N, rows of a shard in slot order within each file.

    A shard may be written by several tasks, as AQE or the range partitioning decide; files of a
    shard then hold consecutive slots.  A row finds its place by id, size and crc32 of its text and, where rows agree
    in these, by their order, so every row is written once.

    Defined cases: null ids and texts and repeated rows are written as they are; columns of ``docs`` named shard or
    slot come back as ``own_shard`` and ``own_slot``; an empty table writes no rows.
    """
    names = {c: f"own_{c}" if c in ("shard", "slot") else c for c in docs.columns}
    same = ["id", "size", "crc"]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("at"))
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = docs.select(
        row.alias("row"), F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(F.to_json(row)).alias("at")).withColumn("nth", nth)
    places = interleave(docs, shards, id_col=id_col, text_col=text_col, **options).select(
        F.col(id_col).alias("id"), "size", F.col("text_crc32").alias("crc"), "shard", "slot", F.struct("shard", "slot").alias("at")).withColumn("nth", nth)
    placed = rows.join(places, [rows[c].eqNullSafe(places[c]) for c in (*same, "nth")]).select("row.*", "shard", "slot")
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
