"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablesense.llm import tokens
from tablesense.llm.common import settle

#: Sizes (1 to 4 bytes) of the four ids that a control byte describes, two bits each, lowest first.
SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
TOTALS = SIZES.sum(axis=1)
OFFSETS = np.cumsum(SIZES, axis=1) - SIZES


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype(np.uint32)
    sizes = 1 + (ranks >> 8 > 0).astype(np.int64) + (ranks >> 16 > 0) + (ranks >> 24 > 0)
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for byte in range(4):
        here = sizes > byte if byte else slice(None)
        if byte and not here.any():
            break
        data[starts[here] + byte] = (ranks[here] >> np.uint32(8 * byte)).astype(np.uint8)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = sizes - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: each control byte looks up its four sizes and places at once."""
    codes = np.frombuffer(control, np.uint8)
    starts = np.cumsum(TOTALS[codes]) - TOTALS[codes]
    places = (starts[:, None] + OFFSETS[codes]).ravel()[:n]
    sizes = SIZES[codes].ravel()[:n]
    body = np.frombuffer(data, np.uint8)
    out = body[places].astype(np.uint32)
    for byte in range(1, 4):
        here = np.flatnonzero(sizes > byte)
        if not len(here):
            break
        out[here] |= body[places[here] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def write_token_files(
    docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    block_ids: int = 1 << 18,
) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending ``id_col`` order below ``path``.

    ``path``/blocks holds one row for each block of whole documents: (part, block, start, ids, docs,
    counts, control, data), ``part`` ascending with the ids, ``start`` the ids of the part before the block,
    ``docs`` and ``counts`` its documents and their numbers of ids.  ``control`` and ``data`` are the ids'
    ranks by frequency over the corpus, coded in one to four bytes.  ``path``/ranks lists the ids by rank; it
    is as long as the vocabulary at most, which bounds what the driver and the workers hold.

    Texts are encoded once, in the tasks that read them, which also count; the ids (not the
    texts) are then range-partitioned.  Null or empty text is the end id alone; rows with the same id all
    appear, in an order fixed by their ids' bytes; null ids come first; a text of any length is one
    document of one block; an empty table gives a file without blocks.
    """
    spark, name = docs.sparkSession, vocabulary or tokens.vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, id_type = tokens.encoder(name), np.zeros(1 << 16, np.int64), None
        fields = ["key", "n", "ids", "seen"]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            id_type = keys.type
            for a, b in tokens.slices(texts):
                ids, sizes = encoder.encode(texts[a:b])
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, np.uint32(end_id))
                seen = np.bincount(ids, minlength=len(counts))
                seen[:len(counts)] += counts
                counts, ends = seen, ends + np.arange(1, b - a + 1)
                wide = ids.astype("<u2") if len(counts) <= 1 << 16 else ids.astype("<u4")
                width = wide.itemsize
                places = pa.array(np.concatenate([[0], ends]) * width, pa.int64())
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, places.buffers()[1], pa.py_buffer(wide.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    keys.slice(a, b - a), pa.array(sizes + 1, pa.int64()), body.cast(pa.binary()), pa.nulls(b - a, pa.binary())], names=fields)
        if id_type is not None:
            here = np.flatnonzero(counts)
            seen = np.stack([here, counts[here]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen], pa.binary())], names=fields)

    encoded = settle(
        docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        .mapInArrow(encode, f"key {kind}, n long, ids binary, seen binary"), "token-ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen in batch.column(0).to_pylist():
                ids, n = np.frombuffer(seen, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    ranks = settle(
        encoded.where("seen is not null").select("seen").mapInArrow(counted, "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1), "token-ranks")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    order = np.array([r.id for r in ranks.orderBy("rank").select("id").collect()], np.int64)  # at most the vocabulary
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, filled, held, keys, sizes = TaskContext.get().partitionId(), 0, 0, 0, [], [], []
        id_type = None

        def full() -> pa.RecordBatch:
            ids = np.concatenate(held)
            control, data = pack_ranks(rank_of[ids])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([keys], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], names=["part", "block", "start", "ids", "docs", "counts", "control", "data"])

        for batch in batches:
            id_type = batch.column(0).type
            for key, n, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys.append(key)
                sizes.append(n)
                held.append(np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4"))
                filled += n
                if filled >= block_ids:
                    yield full()
                    block, start, filled, held, keys, sizes = block + 1, start + filled, 0, [], [], []
        if keys:
            yield full()

    (encoded.where("seen is null").drop("seen")
     .repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("ids"))
     .mapInArrow(blocks, f"part long, block long, start long, ids long, docs array<{kind}>, counts array<long>, control binary, data binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of token files: (id_col, start, n_tokens, ids), ``ids`` little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before it; it needs a running total over parts only.
    """
    found = spark.read.parquet(f"{path}/blocks")
    order = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()]  # at most the vocabulary
    id_of = np.array(order or [0], np.uint32)
    kind = found.schema["docs"].dataType.elementType.simpleString()
    bases = (
        found.groupBy("part").agg(F.sum("ids").alias("n"))
        .select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack_ranks(row["control"], row["data"], row["ids"])].astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                places = pa.array(np.concatenate([[0], ends]) * 4, pa.int64())
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, places.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(counts), pa.int64()), pa.array(row["docs"], batch.schema.field("docs").type.value_type),
                    pa.array(row["start"] + ends - counts), pa.array(counts), body.cast(pa.binary())], names=["part", "key", "start", "n", "ids"])

    rows = found.mapInArrow(decode, f"part long, key {kind}, start long, n long, ids binary")
    return rows.join(F.broadcast(bases), F.col("part") == F.col("of")).select(
        F.col("key").alias(id_col), (F.col("start") + F.col("base")).alias("start"), F.col("n").alias("n_tokens"), "ids")
