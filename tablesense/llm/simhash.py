"""SimHash near-duplicates: every fingerprint meets its neighbours at the variants within half the radius."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import LOWER, UPPER, broadcast_counted, settle
from tablesense.llm.components import connected_components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles hashed at once, so that a text of any length needs bounded memory beside its words.
CHUNK = 1 << 16
#: A fingerprint of more documents than this, and than this share of all, is joined apart from the others.
HEAVY_ROWS, HEAVY_SHARE = 10_000, 10_000


def fingerprint(body: bytes, size: int = 3, seed: int = 42) -> int:
    """64 bits of a text, each set if it is set in over half the XXH64 of its ``size``-word shingles; 0 without words."""
    words = body.translate(_LOWER).split()
    n = max(1, len(words) - size + 1) if words else 0
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + size - 1]
        line, ends = b" ".join(part), list(itertools.accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        hashes = [xxhash.xxh64_intdigest(line[a:b - 1], seed) for a, b in zip(starts, ends[min(size, len(part)) - 1:])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id_col, fp) for every row of ``docs``: the fingerprint of its whole text as a signed 64-bit number.

    A-Z count as a-z, words are runs of anything but blanks, and shingles count as often as they occur; a text
    of fewer words is one shingle, and null, empty and blank texts have fingerprint 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(body.as_py(), size) for body in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    return (
        docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"))
        .mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", id_col))


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in itertools.combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``prints`` that connect all within ``radius`` bits.

    Each fingerprint is sent to all variants within half the radius.  Two fingerprints at most ``radius`` apart
    have a variant in common, and those at one variant are at most ``radius`` apart, so each is linked with the
    next one there only: what hangs together stays so, without all pairs.  A variant is within reach of
    65 fingerprints (2 081 at radius 4), so no variant is crowded, however many documents share a
    fingerprint.  Links met at several variants come once, and each is verified by its bits.
    """
    assert radius in (0, 2, 4), "an even radius: its half is the ball's"
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    at = Window.partitionBy("variant").orderBy("fp")
    return (
        prints.select("fp", F.explode(masks).alias("mask"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
        .select(F.lag("fp").over(at).alias("a"), F.col("fp").alias("b"))
        .where("a is not null").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct())


def simhash_groups(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row: near-duplicates by linked fingerprints.

    Rows are linked if their fingerprints differ in at most ``radius`` (0, 2 or 4) bits; ``component_id`` is the smallest id
    that can be reached, the row's own included; ``fingerprint`` is 16 lower-case hex digits.

    Texts are read once; fingerprints are written, grouped before they are sent anywhere, and labelled in
    Spark jobs.  Fingerprints of very many documents are joined back by a broadcast of at most 10 000 rows
    (each holds over a 10 000th of all documents), the others by a shuffle.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; repeated
    rows and ids come back as often as they came; rows with one id and different texts are rows of their own;
    null ids are kept, and are no component's name unless it has no other; a text of any length is read whole; an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    prints = settle(fingerprints(docs, id_col, text_col, size).select(F.col(f"`{id_col}`").alias("key"), "fp"), "fingerprints")
    firsts = settle(prints.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    linked = connected_components(near_fingerprints(firsts, radius)).select(F.col("node").alias("fp"), "component")
    named = linked.join(firsts.select("fp", "first"), "fp")
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    named = named.join(names, "component").select("fp", "name")
    labels = settle(firsts.join(broadcast_counted(named), "fp", "left").select("fp", F.when(F.col("name").isNull(), F.col("first")).otherwise(F.col("name")).alias("label"), "n"), "labels")

    total = labels.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > max(HEAVY_ROWS, total // HEAVY_SHARE)
    hot, rest = (labels.where(c).select("fp", "label") for c in (heavy, ~heavy))
    out = prints.join(F.broadcast(hot), "fp").unionByName(prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp"))
    return out.select(
        F.col("key").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("label").alias("component_id"))
