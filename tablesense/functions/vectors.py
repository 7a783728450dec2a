"""Cosine similarity and hashed character-trigram vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesense import values as V
from tablesense.functions.text import let, strip
from tablesense.session import in_pieces

#: Rows whose grams one task sums.
PIECE = 20_000


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, or 0 for a missing, empty or zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def grams(text: Column) -> Column:
    """Trigrams of the padded text, then each whole word marked at both ends."""
    padded = F.concat(F.lit("  "), strip(F.lower(text)), F.lit("  "))
    tri = let(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))
    ))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.concat(tri, F.transform(words, lambda w: F.concat(F.lit("__"), w, F.lit("__"))))


def gram_bucket(gram: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def gram_sign(gram: Column) -> Column:
    odd = F.conv(F.substring(F.md5(gram.cast("binary")), 9, 2), 16, 10).cast("int") % 2
    return F.when(odd == 1, F.lit(-1)).otherwise(F.lit(1))


def trigram_weights(df: DataFrame, keys: list[str], text: str, dim: int = V.VECTOR_DIM) -> DataFrame:
    """Sparse vectors: one row per (keys, bucket) with its signed count.

    Grams are exploded and summed map-side, so a long text is spread over rows
    instead of becoming one large array.  Rows are dealt PIECE to a task, which bounds the sums a task holds
    (``dim`` a row at most) however large the table.
    """
    df = in_pieces(df.select(*dict.fromkeys([*keys, text])), PIECE)
    g = F.explode(grams(F.col(text)))
    return (
        df.select(*keys, g.alias("gram"))
        .select(*keys, gram_bucket(F.col("gram"), dim).alias("bucket"), gram_sign(F.col("gram")).alias("s"))
        .groupBy(*keys, "bucket").agg(F.sum("s").alias("weight"))
        .where(F.col("weight") != 0)
    )


def dense_vector(text: Column, dim: int = V.VECTOR_DIM) -> Column:
    """L2-normalised dense vector of a short text (names, descriptions, questions)."""
    parts = F.transform(
        grams(text), lambda g: F.struct(gram_bucket(g, dim).alias("b"), gram_sign(g).alias("s"))
    )
    zero = F.array_repeat(F.lit(0), dim)
    sums = F.aggregate(
        parts, zero,
        lambda acc, p: F.concat(
            F.slice(acc, F.lit(1), p["b"]),
            F.array(F.element_at(acc, p["b"] + 1) + p["s"]),
            F.slice(acc, p["b"] + 2, F.lit(dim) - p["b"] - 1),
        ),
    )

    def scaled(weights: Column) -> Column:
        norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(
            weights, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))

    return F.when(text.isNotNull(), let(sums, scaled))


def name_similarity(left: Column, right: Column, dim: int = V.VECTOR_DIM) -> Column:
    """Cosine of two names' gram vectors, from the grams themselves (no dense array)."""
    def sparse(text: Column) -> Column:
        return F.transform(grams(text), lambda g: F.struct(gram_bucket(g, dim).alias("b"), gram_sign(g).alias("s")))

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(
            a, F.lit(0),
            lambda acc, x: acc + F.aggregate(
                b, F.lit(0), lambda s, y: s + F.when(x["b"] == y["b"], x["s"] * y["s"]).otherwise(0)
            ),
        )

    def similarity(both: Column) -> Column:
        a, b = both["a"], both["b"]
        norms = F.sqrt(product(a, a).cast("double") * product(b, b).cast("double"))
        return F.coalesce(F.when(norms > 0, product(a, b) / norms), F.lit(0.0))

    return let(F.struct(sparse(left).alias("a"), sparse(right).alias("b")), similarity)
