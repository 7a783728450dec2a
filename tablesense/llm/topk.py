"""Exact top-k search by inner product: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.llm.common import parallelism

#: Most candidates and queries that meet in one task, dimensions accumulated at a time, queries at a time.
CANDIDATES, QUERIES, WIDTH, BATCH = 65_536, 8_192, 16, 128
#: Share of survivors below which pairs are listed one by one.
SPARSE = 0.1


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double; null for a vector that is null or has a null or non-finite component."""
    whole = F.transform(vector, lambda x: F.floor(scale * x.cast("double")))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, whole)


def search_block(ids: np.ndarray, columns: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, score) of the ``k`` best of one block of candidates for each query.

    ``columns`` holds one row for each dimension.  A pair's products are summed a block of dimensions at
    a time; what the rest can add is at most the product of both vectors' remaining norms.  Pairs that
    cannot reach the k-th best score known are compacted away.
    """
    d, n = columns.shape
    most = float(np.abs(columns).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # sums are exact
    order = np.argsort(-(columns.astype(float) ** 2).sum(axis=1), kind="stable")
    own, theirs = columns[order].astype(kind), queries[:, order].astype(kind)
    blocks = [slice(a, min(a + WIDTH, d)) for a in range(0, d, WIDTH)]

    def left(x: np.ndarray, axis: int) -> list[np.ndarray]:
        """Norms of what follows each block, rounded up."""
        mass = x.astype(float) ** 2
        parts = [mass.take(range(b.start, b.stop), axis).sum(axis=axis) for b in blocks]
        return [np.sqrt(sum(parts[i + 1:], np.zeros_like(parts[0]))) * (1 + 1e-9) for i in range(len(blocks))]

    own_left, theirs_left = (left(own, 0), left(theirs, 1)) if blocks else ([], [])
    at_q, at_c, scores = [], [], []
    for first in range(0, len(queries), BATCH):
        some = slice(first, min(first + BATCH, len(queries)))
        acc = np.zeros((some.stop - first, n), kind)
        sought = np.full(len(acc), -np.inf)
        other = query_ids[some][:, None] != ids
        pairs = None
        for i, b in enumerate(blocks):
            if pairs is None:
                acc += theirs[some, b] @ own[b]
                slack = np.outer(theirs_left[i][some], own_left[i])
                if n > k:
                    low = np.where(other, acc - slack, -np.inf)
                    sought = np.maximum(sought, np.partition(low, n - k, axis=1)[:, n - k])
                alive = other & (acc + slack >= sought[:, None] - 1e-3)
                if alive.mean() <= SPARSE or i == len(blocks) - 1:
                    pairs = np.nonzero(alive)
                    sums = acc[pairs]
            else:
                q, c = pairs
                sums = sums + np.einsum("ij,ji->i", theirs[first + q, b], own[b][:, c])
                alive = sums + theirs_left[i][first + q] * own_left[i][c] >= sought[q] - 1e-3
                pairs, sums = (q[alive], c[alive]), sums[alive]
        if pairs is None:  # vectors without components
            pairs = np.nonzero(other)
            sums = acc[pairs]
        q, c = pairs
        best = np.lexsort((ids[c], -sums.astype(np.int64), q))
        q, c, sums = q[best], c[best], sums[best]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        at_q.append(first + q[rank < k])
        at_c.append(c[rank < k])
        scores.append(sums[rank < k])
    if not at_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at_q), ids[np.concatenate(at_c)], np.concatenate(scores).astype(np.int64)


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` best rows for each row whose id is divisible by ``every``.

    Vectors are quantised to floor(``scale`` * x); the score is their integer inner product; ties go to the
    smaller id.  All rows but the query's own are candidates.  Queries and candidates are dealt into blocks,
    every block of queries meets every block of candidates in a task that holds just these two, and
    the blocks' best are ranked per query; nothing is sampled, so the answer is exact.

    Defined cases: null vectors and those with null or non-finite components take no part, nor do null
    ids; vectors meet only vectors of the same length, empty ones with score 0; rows repeated in full
    count once, rows of one id with different vectors are each candidates and queries, never for their own
    id, and a query keeps its ``k`` best over its vectors; fewer candidates than ``k`` give fewer
    rows; an empty table gives none; other columns are ignored.
    """
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"))
        .where("id is not null and v is not null").distinct().withColumn("dims", F.size("v")))
    n, m = (x or 0 for x in rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first())
    spread = min(parallelism(vectors.sparkSession), -(-n // 2048))
    across, down = max(1, spread, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.select("id", "v", "dims", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    candidates = dealt(rows, "block", across, "batch", down)
    queries = dealt(rows.where(F.col("id") % every == 0), "batch", down, "block", across)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> np.ndarray:
            values = t.column("v").combine_chunks()
            return values.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64)

        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids, query_ids = (t.column("id").to_numpy() for t in (left, right))
        q, c, s = search_block(ids, np.ascontiguousarray(matrix(left).T), query_ids, matrix(right), k)
        return pa.table([pa.array(query_ids[q]), pa.array(c), pa.array(s)], names=names)

    cell = ["dims", "block", "batch"]
    best = candidates.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = best.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
