"""Benchmark decontamination by winnowing: shared k-gram fingerprints, extended to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesense.llm.common import broadcast_counted, lower_ascii, settle

#: Words are runs of digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _grams(span: int, k: int) -> Column:
    """Hash of each ``k``-gram of ``hashed``; ``span`` keeps the classes of windows apart."""
    return F.when(F.size("hashed") >= span, F.transform(
        F.sequence(F.lit(0), F.size("hashed") - k),
        lambda i: F.xxhash64(F.lit(span), *[F.get("hashed", i + j) for j in range(k)]),
    )).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: str, width: int) -> Column:
    """The smallest hash of every run of ``width`` hashes, each value once."""
    if width == 1:
        return F.array_distinct(grams)
    return F.array_distinct(F.when(F.size(grams) >= width, F.transform(
        F.sequence(F.lit(1), F.size(grams) - width + 1), lambda i: F.array_min(F.slice(grams, i, width)),
    )).otherwise(F.array().cast("array<bigint>")))


def fingerprints(df: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Add ``prints``: the fingerprints of ``words``, for each (span, k).

    Of any ``span`` consecutive words the smallest of their span - k + 1 hashes is kept, so two
    texts that share ``span`` words in a row share a fingerprint.
    """
    df = df.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    for span, k in spans:
        df = df.withColumn(f"grams{span}", _grams(span, k))
    kept = [_winnowed(f"grams{span}", span - k + 1) for span, k in spans]
    return df.withColumn("prints", F.concat(*kept) if len(kept) > 1 else kept[0])


def _stretch(span: int, k: int) -> Column:
    """Windows of ``span`` words that hold a matched k-gram: (start from 0, words joined by blanks)."""
    grams = f"grams{span}"
    near = F.filter(
        F.transform(grams, lambda g, i: F.when(F.array_contains("matched", g), i)), lambda i: i.isNotNull(),
    )
    starts = F.array_distinct(F.flatten(F.transform(near, lambda p: F.sequence(
        F.greatest(p - (span - k), F.lit(0)), F.least(p, F.size("words") - span)))))
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.lit(span).alias("span"), F.array_join(F.slice("words", s + 1, span), " ").alias("window")))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Which words of ``docs`` lie in windows of ``window`` consecutive words of a benchmark item.

    An item of fewer words, but not none, is one window.  Returns one row for each row of ``docs``:
    id_col, ``print`` (xxhash64 of the text, to join on), ``n_words``, ``n_hit`` (words inside any
    occurrence of a window) and ``items`` (sorted ids, as strings, of the items whose windows occur).

    Documents and items are reduced to winnowed fingerprints.  Documents that share one with the
    benchmark are read again: each matched k-gram is extended to the windows around it, which are
    compared with the benchmark's windows as text, so a hash collision costs time only.  Each length of
    short items is a class of its own with k at most that length.  Only fingerprints of 8 bytes and
    windows around matches are ever exploded; item lists are grouped per window before the join, so
    a passage that many documents share gives a row per document and window.

    Defined cases: null or empty texts have no words and hit nothing; null ids are kept as one
    id; repeated rows are worked on once and come back as often as they came; items without words or with a null id match nothing;
    an empty benchmark matches nothing; other columns are ignored.
    """
    items = settle(
        benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(F.coalesce(F.col(f"`{item_text_col}`"), F.lit(""))).alias("words"))
        .where("item is not null and size(words) > 0"), "benchmark-words",
    )
    short = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())
    spans = [(n, min(k, n)) for n in short] or [(window, k)]
    wanted = broadcast_counted(settle(
        fingerprints(items, spans).select(F.explode("prints").alias("fp")).distinct(), "benchmark-prints"))
    windows = broadcast_counted(settle(
        items.select("item", F.explode(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))),
            lambda s: F.array_join(F.slice("words", s + 1, window), " "))).alias("window"))
        .groupBy("window").agg(F.collect_set("item").alias("items")), "benchmark-windows"))

    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("print"), body.alias("body"))
    found = settle(
        fingerprints(rows.select("id", "print", words_of(F.col("body")).alias("words")), spans)
        .select("id", "print", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("prints").alias("at", "fp"))
        .join(wanted.select(F.col("fp").alias("wanted")), F.col("fp") == F.col("wanted"), "left")
        .groupBy("id", "print", "n_words")
        .agg(F.collect_set("wanted").alias("matched"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("copies")), "document-prints",
    )
    near = settle(found.where("size(matched) > 0").select(F.col("id").alias("near_id"), F.col("print").alias("near_print"), "matched"), "matched-documents")
    again = (
        rows.join(near, F.col("id").eqNullSafe(F.col("near_id")) & (F.col("print") == F.col("near_print")))
        .dropDuplicates(["id", "print"])
        .select("id", "print", "matched", words_of(F.col("body")).alias("words"))
    )
    again = fingerprints(again, spans)
    stretch = F.flatten(F.array(*[_stretch(*s) for s in spans]))
    hits = (
        again.select("id", "print", F.explode(stretch).alias("at")).select("id", "print", "at.*")
        .join(windows, "window")
        .groupBy("id", "print").agg(F.collect_set(F.struct("start", "span")).alias("at"), F.collect_set("items").alias("items"))
        .select(
            F.col("id").alias("hit_id"), F.col("print").alias("hit_print"),
            F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["start"], a["start"] + a["span"] - 1))))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("print") == F.col("hit_print")), "left").select(
        F.col("id").alias(id_col), "print", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` lies in a benchmark window."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the contaminated documents.

    Defined cases: null or empty texts stay; null ids are judged by their own texts; rows repeated in full all stay or
    all go; an empty table or benchmark drops nothing.
    """
    gone = settle(
        find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where(is_contaminated())
        .select(F.col(id_col).alias("__id"), F.col("print").alias("__print")), "contaminated")
    same = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))) == gone["__print"]
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["__id"]) & same, "left_anti")
