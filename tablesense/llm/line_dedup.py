"""Line de-duplication: a line that several documents hold stays in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablesense.llm.common import BLANKS, lower_ascii, settle


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2,
) -> DataFrame:
    """``docs`` with lines held by ``min_docs`` documents or more removed from all but the first.

    Texts are split at ``\\n``.  A line's key is the line without blanks at both ends and with
    A-Z lower-cased; keys below ``min_chars`` code points are never dropped.  Of a key found in
    ``min_docs`` documents or more, the document with the smallest id keeps all its lines.

    Returns every row and column of ``docs`` with ``text_col`` rewritten, and ``n_lines`` (before
    dropping) and ``n_dropped``; columns of these two names in ``docs`` are replaced.

    Defined cases: a null or empty text is one empty line and comes back as an empty text; a row
    whose id is null counts for no key and keeps its lines; rows with the same id are one document
    when documents are counted, and rows repeated in full all come back; an empty table gives
    an empty table.  Only line hashes (128 bits) are shuffled to decide; the text moves once, to
    meet the decisions on its own document.
    """
    spare = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in spare]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
    ).withColumn("print", F.xxhash64("body"))

    key = lower_ascii(F.trim("line", F.lit(BLANKS)))
    lines = settle(
        rows.where(F.col("id").isNotNull())
        .select("id", "print", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("id", "print", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "print", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "line-hashes",
    )
    repeated = F.min("id") < F.max("id") if min_docs == 2 else F.count_distinct("id") >= min_docs
    first = settle(
        lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), repeated.alias("repeated"))
        .where("repeated").drop("repeated"),
        "repeated-lines",
    )
    dropped = (
        lines.join(first, ["h1", "h2"]).where("id > first")
        .groupBy("id", "print").agg(F.collect_set("pos").alias("gone"))
    )
    split = F.split("body", "\n", -1)
    kept = F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i)), "\n"
    )
    met = (
        rows.join(dropped, ["id", "print"], "left").withColumn("lines", split)
        .select("row", F.size("lines").cast("long").alias("n_lines"),
                F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("kept"))
    )
    return met.select(
        *[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in spare], "n_lines", "n_dropped"
    )
