"""Finding the tables, columns, rules and saved examples a question needs."""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablesense import values as V
from tablesense.functions import text as X
from tablesense.functions.vectors import cosine
from tablesense.session import cut_lineage


def terms_of(spark: SparkSession, question: str) -> list[str]:
    """The terms of one question: a handful of words, evaluated on one literal row."""
    return spark.range(1).select(X.question_terms(F.lit(question)).alias("t")).first().t


def lexical_score(texts: DataFrame, text: Column, terms: list[str]) -> Column:
    """Share of a question's terms a text contains, rarer terms counting more.

    Document frequencies come from one narrow aggregate over the texts (one count
    per term); the score is then a projection, with no join and no shuffle.
    """
    if not terms:
        return F.lit(0.0)
    row = texts.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(text.contains(t)).alias(f"t{i}") for i, t in enumerate(terms)]
    ).first()
    weights = [F.log(F.lit(1.0 + row["n"] / (1 + row[f"t{i}"]))) for i in range(len(terms))]
    hit = reduce(Column.__add__, [F.when(text.contains(t), w).otherwise(0.0) for t, w in zip(terms, weights)])
    return hit / reduce(Column.__add__, weights)


#: Names are broadcast up to so many and so many bytes; beyond, runs are sifted by so many digests of names first.
FEW_NAMES, FEW_BYTES, SIEVE = 200_000, 32 * 1024 * 1024, 1 << 20


def columns_named_in(texts: DataFrame, keys: list[str], text: str, names: DataFrame, name: str, few: int = FEW_NAMES) -> DataFrame:
    """(keys, name) for each name a text calls by name, spacing and case aside.

    Names are a catalogue, however large the tables they were read from: their number and bytes are
    counted, not estimated.  Beyond ``few``, runs are no longer than the longest name and of a name's digest (at most SIEVE
    digests are broadcast) before they are shuffled.
    """
    wanted = cut_lineage(names.select(name, X.squeezed_name(F.col(name)).alias("run")).where(
        F.length("run") >= V.MIN_NAMED_LENGTH
    ).distinct())
    runs = texts.select(*keys, F.explode(X.name_runs(F.col(text))).alias("run"))
    held = wanted.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("run") + F.octet_length(F.col(name).cast("string"))).alias("bytes"),
        F.max(F.length("run")).alias("longest")).first()
    if held.n <= few and (held.bytes or 0) <= FEW_BYTES:
        return runs.join(F.broadcast(wanted), "run").select(*keys, name).distinct()
    sieve = wanted.select(_sieved(F.col("run")).alias("_s")).distinct()
    sifted = runs.where(F.length("run") <= held.longest).join(F.broadcast(sieve), _sieved(F.col("run")) == F.col("_s"), "left_semi")
    return sifted.join(wanted, "run").select(*keys, name).distinct()


def _sieved(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(SIEVE)).cast("int")


#: Question vectors scored per scan of the rows.
QUERY_BATCH = 128


def nearest(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, k: int) -> DataFrame:
    """The ``k`` rows nearest each query vector by cosine, ties by id.

    Queries are questions, not data: they become literals, ``QUERY_BATCH`` per scan of
    the rows, so nothing is cross-joined or shuffled before every task has kept its
    best ``k`` per query.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).toLocalIterator()
    kind = queries.schema[query_id].dataType
    none = rows.limit(0).select(F.lit(None).cast(kind).alias("query_id"), F.col(row_id), F.lit(None).cast("double").alias("similarity"))
    parts = [none]
    while some := list(islice(asked, QUERY_BATCH)):
        literals = F.array(*[
            F.struct(F.lit(r.q).cast(kind).alias("query_id"), F.array(*[F.lit(float(x)) for x in r.v]).alias("_q")) for r in some])
        parts.append(rows.select(F.col(row_id), F.col(vector).alias("_v"), F.inline(literals)).select(
            "query_id", row_id, cosine(F.col("_q"), F.col("_v")).alias("similarity")))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), row_id)
    scored = reduce(DataFrame.unionAll, parts)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_to_vector(rows: DataFrame, vector: list[float], row_id: str, column: str, k: int) -> DataFrame:
    """Top ``k`` for one question vector given as a literal: no join at all."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return (
        rows.select(row_id, cosine(F.col(column), q).alias("similarity"))
        .orderBy(F.desc("similarity"), row_id).limit(k)
    )


def select_tables(scored: DataFrame, max_tables: int = V.MAX_TABLES) -> DataFrame:
    """Best tables by score; all of them as soon as one has no vector to rank by.

    ``scored`` has one row per table (table_name, score, ranked).
    """
    everything = Window.partitionBy()
    by_score = Window.orderBy(F.desc("score"), "table_name")
    return (
        scored.withColumn("_all_ranked", F.min(F.col("ranked").cast("int")).over(everything))
        .withColumn("rank", F.row_number().over(by_score))
        .where((F.col("_all_ranked") == 0) | (F.col("rank") <= max_tables)).drop("_all_ranked")
    )


def expand_by_references(selected: DataFrame, references: DataFrame) -> DataFrame:
    """The selected tables and every table one confirmed reference away, either way."""
    tables = selected.select("table_name").distinct()
    out = references.join(tables, F.col("from_table") == F.col("table_name"), "left_semi").select("to_table")
    back = references.join(tables, F.col("to_table") == F.col("table_name"), "left_semi").select("from_table")
    return tables.union(out).union(back).distinct()


def select_columns(
    columns: DataFrame, vector: Column, terms: list[str], forced: list[str] = (), max_ranked: int = V.MAX_COLUMNS
) -> DataFrame:
    """Keys, references and named columns, plus the best of the rest by similarity.

    ``columns`` is the metadata table: table_name, column_name, semantic_description,
    embedding, is_primary_key, is_foreign_key.
    """
    kept = (
        F.col("is_primary_key") | F.col("is_foreign_key") | F.lower("column_name").isin(*forced)
        if forced else F.col("is_primary_key") | F.col("is_foreign_key")
    )
    text = F.lower(F.concat_ws(" ", "column_name", "semantic_description"))
    rest = columns.where(~kept)
    score = cosine(F.col("embedding"), vector) + V.LEXICAL_WEIGHT * lexical_score(rest, text, terms)
    best = rest.withColumn("score", score).orderBy(F.desc("score"), "table_name", "column_name").limit(max_ranked)
    return columns.where(kept).withColumn("score", F.lit(None).cast("double")).unionByName(best)


def schema_context(columns: DataFrame) -> DataFrame:
    """One row per table with its selected columns nested; vectors are left out."""
    reference = F.when(
        F.col("is_foreign_key") & F.col("references_table").isNotNull(),
        F.concat_ws(".", "references_table", "references_column"),
    )
    item = F.struct(
        "position", F.col("column_name").alias("name"), F.col("sql_type").alias("type"),
        F.col("taxonomy_label").alias("taxonomy"), "is_primary_key", "is_foreign_key",
        reference.alias("references"), "is_additive", F.bround("null_ratio", 4).alias("null_ratio"), "sample_values",
    )
    return columns.groupBy("table_name", "table_type").agg(F.array_sort(F.collect_list(item)).alias("columns"))


def rank_examples(examples: DataFrame, similarity: Column, question: str) -> DataFrame:
    """Saved examples, the same question first, then by similarity."""
    same = X.normalise_question(F.col("question")) == X.normalise_question(F.lit(question))
    return examples.withColumn("same_question", same).withColumn("similarity", similarity)


def worth_showing(ranked: DataFrame, k: int = V.MAX_EXAMPLES, floor: float = V.MIN_EXAMPLE_SIMILARITY) -> DataFrame:
    top = ranked.orderBy(F.desc("same_question"), F.desc("similarity"), "question").limit(k)
    return top.where(F.col("same_question") | (F.col("similarity") >= floor))


def keep_latest(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per key; tasks drop the rest before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def recent_turns(turns: DataFrame, conversation: str, turn: str, n: int) -> DataFrame:
    """The last ``n`` turns of every conversation, numbered oldest first."""
    last = keep_latest(turns, [conversation], [F.desc(turn)], n)
    w = Window.partitionBy(conversation).orderBy(turn)
    return last.withColumn("position", F.row_number().over(w))
