"""Queries over text cells, names and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense import values as V
from tablesense.catalogue import query
from tablesense.catalogue import schema as S
from tablesense.functions import dates, naming, text as X, vectors
from tablesense.operators import retrieve
from tablesense.session import load_table, load_tables

NULLS = S.in_list(V.NULL_TOKENS)

# --- blanks -------------------------------------------------------------------
MARKED = (
    "CASE WHEN doc_id % 10 = 0 THEN ' N/A ' WHEN doc_id % 10 = 1 THEN '—' "
    "WHEN doc_id % 10 = 2 THEN 'Unknown' WHEN doc_id % 10 = 3 THEN '  ' ELSE text END"
)


@query("null_markers", f"""
SELECT source, count(*) AS cells,
       count(*) FILTER (WHERE lower({S.strip('cell')}) IN {NULLS}) AS markers
FROM (SELECT source, {MARKED} AS cell FROM documents) GROUP BY source""")
def null_markers(spark, path):
    docs = load_tables(spark, path, ["documents"])["documents"]
    return (
        docs.select("source", F.expr(MARKED).alias("cell"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("cells"), F.count_if(X.is_null_token(F.col("cell"))).alias("markers"))
    )


PADDED_TEXT = (
    "CASE WHEN doc_id % 10 = 0 THEN ' n/a ' WHEN doc_id % 3 = 0 THEN '  ' || source || ' ' ELSE source END"
)


@query("normalised_cells", f"""
SELECT doc_id, CASE WHEN lower({S.strip('cell')}) IN {NULLS} THEN NULL ELSE {S.strip('cell')} END AS value
FROM (SELECT doc_id, {PADDED_TEXT} AS cell FROM documents)""")
def normalised_cells(spark, path):
    docs = load_tables(spark, path, ["documents"])["documents"]
    return docs.select("doc_id", X.normalise_text(F.expr(PADDED_TEXT)).alias("value"))


ZIPPED = "CASE WHEN c_custkey % 3 = 0 THEN '0' || CAST(c_custkey AS STRING) ELSE CAST(c_custkey AS STRING) END"


@query("zero_padded_share", f"""
SELECT c_mktsegment, count(*) AS cells, count(*) FILTER (WHERE regexp_matches(code, '^0[0-9]+$')) AS padded,
       count(*) FILTER (WHERE regexp_matches(code, '^0[0-9]+$')) > 0.1 * count(*) AS keep_as_text
FROM (SELECT c_mktsegment, {ZIPPED} AS code FROM customer) GROUP BY c_mktsegment""")
def zero_padded_share(spark, path):
    df = load_tables(spark, path, ["customer"])["customer"]
    padded = F.count_if(X.is_zero_padded(F.col("code")))
    return (
        df.select("c_mktsegment", F.expr(ZIPPED).alias("code")).groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("cells"), padded.alias("padded"),
             (padded > V.ZERO_PADDED_SHARE * F.count(F.lit(1))).alias("keep_as_text"))
    )


# --- numbers ------------------------------------------------------------------
def money(divide: str) -> str:
    """Order totals as people write them; ``divide`` is the engine's integer division."""
    plain = f"CAST(c {divide} 100 AS STRING) || '.' || lpad(CAST(c % 100 AS STRING), 2, '0')"
    comma = (
        f"CASE WHEN c >= 100000 THEN CAST(c {divide} 100000 AS STRING) || ',' || "
        f"lpad(CAST((c {divide} 100) % 1000 AS STRING), 3, '0') ELSE CAST(c {divide} 100 AS STRING) END"
        f" || '.' || lpad(CAST(c % 100 AS STRING), 2, '0')"
    )
    return (
        f"CASE o_orderkey % 6 WHEN 0 THEN '$' || {comma} WHEN 1 THEN '৳ ' || {comma} "
        f"WHEN 2 THEN '(' || {comma} || ')' WHEN 3 THEN {plain} WHEN 4 THEN 'Tk ' || {plain} "
        f"ELSE 'about ' || {plain} END"
    )


CENTS = "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders"


@query("currency_parsed", f"""
WITH t AS (SELECT o_orderkey, {money('//')} AS text FROM ({CENTS})),
s AS (SELECT *, replace(text, ' ', '') AS k,
             CASE WHEN contains(text, '৳') THEN '৳' WHEN contains(text, '$') THEN '$'
                  WHEN contains(text, 'Tk') THEN 'Tk' END AS symbol FROM t),
b AS (SELECT *, regexp_replace(regexp_replace(replace(replace(replace(k, '৳', ''), '$', ''), 'Tk', ''),
        '^\\((.*)\\)$', '-\\1'), '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g') AS bare FROM s)
SELECT o_orderkey, text, symbol,
       CASE WHEN regexp_matches(bare, '^[+-]?[0-9]+\\.?[0-9]*$') THEN try_cast(bare AS DOUBLE) END AS number
FROM b""")
def currency_parsed(spark, path):
    load_tables(spark, path, ["orders"])["orders"].createOrReplaceTempView("ts_orders")
    df = spark.sql(f"SELECT o_orderkey, {money('div')} AS text FROM ({CENTS.replace('FROM orders', 'FROM ts_orders')})")
    t = F.col("text")
    return df.select("o_orderkey", "text", X.currency_symbol(t).alias("symbol"), X.to_number(t).alias("number"))


@query("percent_parsed", """
SELECT text, CASE WHEN regexp_matches(text, '%$') THEN CAST(replace(text, '%', '') AS DOUBLE) / 100.0 END AS fraction,
       count(*) AS n
FROM (SELECT CASE WHEN l_linenumber = 7 THEN CAST(p AS VARCHAR) || ' of 100' ELSE CAST(p AS VARCHAR) || '%' END AS text
      FROM (SELECT l_linenumber, CAST(round(l_discount * 100) AS INT) AS p FROM lineitem)) GROUP BY text""")
def percent_parsed(spark, path):
    df = load_tables(spark, path, ["lineitem"])["lineitem"]
    p = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    cell = F.when(F.col("l_linenumber") == 7, F.concat(p, F.lit(" of 100"))).otherwise(F.concat(p, F.lit("%")))
    return (
        df.select(cell.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        .select("text", X.parse_percent(F.col("text")).alias("fraction"), "n")
    )


@query("numbers_parsed", """
SELECT kind, count(*) AS cells, count(*) FILTER (WHERE ok) AS parsed, round(sum(CASE WHEN ok THEN CAST(replace(text, '_', '') AS DOUBLE) END), 2) AS total
FROM (SELECT *, regexp_matches(text, '^[+-]?([0-9]+(_[0-9]+)*\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AS ok FROM (
  SELECT l_linenumber AS kind, CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS VARCHAR) || 'd'
    WHEN 2 THEN '1_' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') WHEN 3 THEN CAST(l_partkey AS VARCHAR) || 'e2'
    WHEN 4 THEN '+' || CAST(l_partkey AS VARCHAR) WHEN 5 THEN '0x1F' WHEN 6 THEN '.5' ELSE CAST(l_partkey AS VARCHAR) END AS text
  FROM lineitem)) GROUP BY kind""")
def numbers_parsed(spark, path):
    df = load_tables(spark, path, ["lineitem"])["lineitem"]
    k, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    cell = (
        F.when(k == 1, F.concat(p, F.lit("d"))).when(k == 2, F.concat(F.lit("1_"), F.lpad(p, 6, "0")))
        .when(k == 3, F.concat(p, F.lit("e2"))).when(k == 4, F.concat(F.lit("+"), p))
        .when(k == 5, F.lit("0x1F")).when(k == 6, F.lit(".5")).otherwise(p)
    )
    number = X.to_number(F.col("text"))
    return (
        df.select(k.alias("kind"), cell.alias("text")).groupBy("kind")
        .agg(F.count(F.lit(1)).alias("cells"), F.count(number).alias("parsed"), F.round(F.sum(number), 2).alias("total"))
    )


# --- dates --------------------------------------------------------------------
SPELLINGS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yy", "yyyy/MM/dd")
STRFTIME = ("%Y-%m-%d", "%d/%m/%Y", "%d %b %Y", "%b %d, %Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%y", "%Y/%m/%d")
SPELL_SQL = "CASE o_orderkey % 8 " + " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(STRFTIME)
) + " ELSE 'week ' || CAST(o_orderkey % 52 AS VARCHAR) END"
LONG_FORMATS = "[" + ", ".join(S.quote(f) for f in V.DATE_FORMAT_NAMES if "%y" not in f) + "]"
SHORT_FORMATS = "[" + ", ".join(S.quote(f) for f in V.DATE_FORMAT_NAMES if "%y" in f) + "]"
#: DuckDB's %Y also takes two digits, so the two kinds are told apart first.
PARSE_SQL = (
    f"CASE WHEN regexp_matches(text, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2}}$') THEN try_strptime(text, {SHORT_FORMATS}) "
    f"ELSE try_strptime(text, {LONG_FORMATS}) END"
)


def respelled(df):
    cell = F.concat(F.lit("week "), (F.col("o_orderkey") % 52).cast("string"))
    for i, pattern in enumerate(SPELLINGS):
        cell = F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", pattern)).otherwise(cell)
    return df.select("o_orderkey", cell.alias("text"))


@query("dates_parsed", f"""
SELECT o_orderkey, text, strftime({PARSE_SQL}, '%Y-%m-%d %H:%M:%S') AS parsed
FROM (SELECT o_orderkey, {SPELL_SQL} AS text FROM orders)""")
def dates_parsed(spark, path):
    df = respelled(load_tables(spark, path, ["orders"])["orders"])
    return df.select(
        "o_orderkey", "text", F.date_format(dates.parse_date(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query("two_digit_years", """
SELECT text, strftime(try_strptime(text, '%d/%m/%y'), '%Y-%m-%d') AS parsed, n FROM (
  SELECT strftime(o_orderdate, '%d/%m/') || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS text, count(*) AS n
  FROM orders GROUP BY 1)""")
def two_digit_years(spark, path):
    df = load_tables(spark, path, ["orders"])["orders"]
    cell = F.concat(F.date_format("o_orderdate", "dd/MM/"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return (
        df.groupBy(cell.alias("text")).agg(F.count(F.lit(1)).alias("n"))
        .select("text", dates.format_date(F.col("text"), ("%d/%m/%y",)).alias("parsed"), "n")
    )


FORMAT_HITS = S.union(
    f"SELECT column_name, {i} AS pos, {S.quote(f)} AS fmt, count(*) AS hits FROM cells WHERE try_strptime(text, {S.quote(f)}) IS NOT NULL "
    f"AND regexp_matches(text, '\\d{{4}}') = {'true' if '%Y' in f else 'false'} GROUP BY column_name"
    for i, f in enumerate(V.DATE_FORMAT_NAMES)
)


@query("date_formats_ranked", f"""
WITH cells AS (
  SELECT DISTINCT 'us' AS column_name, strftime(o_orderdate, '%m/%d/%Y') AS text FROM orders
  UNION ALL SELECT DISTINCT 'mixed', CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders
  UNION ALL SELECT DISTINCT 'short', strftime(l_shipdate, '%d-%m-%y') FROM lineitem),
hits AS ({FORMAT_HITS})
SELECT column_name, fmt AS format, hits, row_number() OVER (PARTITION BY column_name ORDER BY hits DESC, pos) AS rank FROM hits""")
def date_formats_ranked(spark, path):
    from tablesense.operators.clean import rank_date_formats
    from tablesense.operators.value_counts import value_counts, column_refs

    t = load_tables(spark, path, ["orders", "lineitem"])
    cells = {
        "orders": t["orders"].select(
            F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"),
            F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed"),
        ),
        "lineitem": t["lineitem"].select(F.date_format("l_shipdate", "dd-MM-yy").alias("short")),
    }
    refs = column_refs(cells)
    ranked = rank_date_formats(value_counts(cells, refs))
    names = F.array(*[F.lit(r.column) for r in refs])
    return ranked.select(F.element_at(names, F.col("cid") + 1).alias("column_name"), "format", "hits", "rank")


@query("dates_as_text", """
SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%d.%m.%Y') AS text FROM lineitem""")
def dates_as_text(spark, path):
    df = load_tables(spark, path, ["lineitem"])["lineitem"]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "dd.MM.yyyy").alias("text"))


# --- casing, splitting, casting -----------------------------------------------
TITLE = "array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ')"


@query("casing_standardised", f"""
SELECT p_partkey, upper(p_name) AS upper_name, lower(p_brand) AS lower_brand, {TITLE} || ' O''Neil-Mc' AS title_name,
       trim(p_type) || ' ' || trim(p_type) AS spaced FROM part""")
def casing_standardised(spark, path):
    df = load_tables(spark, path, ["part"])["part"]
    return df.select(
        "p_partkey", X.recase(F.col("p_name"), "upper").alias("upper_name"),
        X.recase(F.col("p_brand"), "lower").alias("lower_brand"),
        X.recase(F.concat("p_name", F.lit(" o'nEIL-mC")), "title").alias("title_name"),
        X.collapse_spaces(X.strip(F.concat(F.lit("\t "), "p_type", F.lit("  \n "), "p_type", F.lit(" ")))).alias("spaced"),
    )


@query("column_split", """
SELECT p_partkey, trim(string_split(p_name, ' ')[1]) AS first_word,
       CASE WHEN contains(p_name, ' ') THEN trim(substring(p_name, strpos(p_name, ' ') + 1)) END AS rest FROM part""")
def column_split(spark, path):
    from tablesense.operators.steps import split_column

    df = load_tables(spark, path, ["part"])["part"].select("p_partkey", "p_name")
    return split_column(df, "p_name", ["first_word", "rest"], delimiter=" ").drop("p_name")


@query("cast_losses", """
SELECT 'numeric' AS target, count(*) AS cells, count(*) FILTER (WHERE cell IS NOT NULL AND NOT regexp_matches(cell, '^[0-9]+$')) AS lost
FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN source ELSE CAST(n_chars AS VARCHAR) END AS cell FROM documents)
UNION ALL
SELECT 'boolean', count(*), count(*) FILTER (WHERE cell = 'perhaps')
FROM (SELECT CASE quality WHEN 1 THEN 'Yes' ELSE CASE WHEN doc_id % 2 = 0 THEN 'off' ELSE 'perhaps' END END AS cell FROM labels)
UNION ALL
SELECT 'datetime', count(*), count(*) FILTER (WHERE o_orderkey % 8 = 7) FROM orders""")
def cast_losses(spark, path):
    from tablesense.operators.steps import cast_losses as losses

    t = load_tables(spark, path, ["documents", "labels", "orders"])
    numeric = t["documents"].select(
        F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string")).alias("cell"))
    boolean = t["labels"].select(F.when(F.col("quality") == 1, "Yes").otherwise(
        F.when(F.col("doc_id") % 2 == 0, "off").otherwise("perhaps")).alias("cell"))
    when = respelled(t["orders"]).select(F.col("text").alias("cell"))
    return (
        losses(numeric, "cell", "numeric").unionAll(losses(boolean, "cell", "boolean"))
        .unionAll(losses(when, "cell", "datetime"))
    )


# --- names --------------------------------------------------------------------
LABEL = "p_name || ' (' || p_brand || ') / ' || CAST(p_size AS STRING) || '% & ' || p_type"


@query("safe_names", """
WITH t AS (SELECT p_partkey, p_name || ' (' || p_brand || ') / ' || CAST(p_size AS VARCHAR) || '% & ' || p_type AS label FROM part)
SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(
  replace(replace(replace(label, '%', ' pct '), '&', ' and '), '#', ' no '), '[^0-9a-zA-Z_]+', '_', 'g'), '_{2,}', '_', 'g'), '_')) AS name FROM t""")
def safe_names(spark, path):
    df = load_tables(spark, path, ["part"])["part"]
    return df.select("p_partkey", X.safe_name(F.expr(LABEL)).alias("name"))


@query("sql_identifiers", f"""
SELECT p_partkey, CASE WHEN base IN {S.in_list(V.RESERVED_WORDS)} AND p_size % 4 <> 3 THEN base || '_col' ELSE base END AS name FROM (
 SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'order' WHEN 1 THEN 'c_' || p_size || '_' || replace(p_name, ' ', '_')
   WHEN 2 THEN 'prenom_' || replace(p_name, ' ', '_') ELSE 'column' END AS base FROM part)""")
def sql_identifiers(spark, path):
    df = load_tables(spark, path, ["part"])["part"]
    label = F.expr(
        "CASE p_size % 4 WHEN 0 THEN ' ORDER ' WHEN 1 THEN CAST(p_size AS STRING) || ' ' || p_name "
        "WHEN 2 THEN 'Prénom: ' || p_name ELSE '???' END"
    )
    return df.select("p_partkey", X.sql_identifier(label).alias("name"))


@query("unique_names", """
SELECT p_partkey, p_name || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS name FROM (
 SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_type, p_size, p_name ORDER BY p_partkey) AS r FROM part)""")
def unique_names(spark, path):
    df = load_tables(spark, path, ["part"])["part"]
    return naming.unique_names(df, ["p_brand", "p_type", "p_size"], "p_partkey", "p_name", "name").select("p_partkey", "name")


@query("names_normalised", f"""
SELECT name, {S.normal_name('name')} AS normal, n FROM (
 SELECT 'cust' || replace(p_brand, '#', '') || 'ID_' || replace(p_name, ' ', '') || '-qty' AS name, count(*) AS n FROM part GROUP BY 1)""")
def names_normalised(spark, path):
    df = load_tables(spark, path, ["part"])["part"]
    name = F.expr("'cust' || replace(p_brand, '#', '') || 'ID_' || replace(p_name, ' ', '') || '-qty'")
    return (
        df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .select("name", X.normalise_name(F.col("name")).alias("normal"), "n")
    )


# --- vectors ------------------------------------------------------------------
@query("trigram_vectors", f"""
SELECT c_custkey, bucket, sum(sgn)::BIGINT AS weight FROM (
 SELECT c_custkey, {S.bucket('g', 384)} AS bucket, {S.sign('g')} AS sgn
 FROM (SELECT c_custkey, unnest({S.grams("(c_name || ' ' || c_mktsegment)")}) AS g FROM customer))
GROUP BY c_custkey, bucket HAVING sum(sgn) <> 0""")
def trigram_vectors(spark, path):
    df = load_tables(spark, path, ["customer"])["customer"]
    df = df.select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("label"))
    return vectors.trigram_weights(df, ["c_custkey"], "label")


@query("cosine_by_label", """
WITH c AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
q AS (SELECT e.label, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN c USING (vec_id))
SELECT e.vec_id, q.label AS to_label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS similarity
FROM embeddings e JOIN q ON e.label = q.label""")
def cosine_by_label(spark, path):
    df = load_tables(spark, path, ["embeddings"])["embeddings"]
    first = df.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return df.join(F.broadcast(first), "label").select(
        "vec_id", F.col("label").alias("to_label"),
        F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"),
    )


# --- questions ----------------------------------------------------------------
def stem_sql(w: str) -> str:
    cases = " ".join(
        f"WHEN ends_with({w}, '{s}') AND length({w}) >= {4 + len(s)} THEN substring({w}, 1, length({w}) - {len(s)})"
        for s in V.STEM_SUFFIXES
    )
    return f"CASE {cases} ELSE {w} END"


def terms_sql(text: str) -> str:
    return (
        f"list_distinct([{stem_sql('w')} FOR w IN regexp_extract_all(lower({text}), '[a-z0-9]+') "
        f"IF length(w) >= 3 AND w NOT IN {S.in_list(V.STOPWORDS)}])"
    )


@query("question_terms", f"""
SELECT conv_id, turn, array_to_string(list_sort({terms_sql('text')}), ' ') AS terms FROM conversations""")
def question_terms(spark, path):
    df = load_tables(spark, path, ["conversations"])["conversations"]
    return df.select("conv_id", "turn", F.array_join(F.array_sort(X.question_terms(F.col("text"))), " ").alias("terms"))


@query("question_fingerprints", """
SELECT fingerprint, count(*) AS asked FROM (
  SELECT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS fingerprint FROM conversations) GROUP BY 1""")
def question_fingerprints(spark, path):
    df = load_tables(spark, path, ["conversations"])["conversations"]
    return df.groupBy(X.normalise_question(F.col("text")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("asked"))


QUESTION = "Which nations mention eaux, tion and thing again?"


@query("lexical_scores", f"""
WITH q AS (SELECT unnest({terms_sql(S.quote(QUESTION))}) AS term),
t AS (SELECT doc_id, lower(text) AS body FROM documents),
hit AS (SELECT doc_id, term FROM t, q WHERE contains(body, term)),
w AS (SELECT q.term, ln(1 + (SELECT count(*) FROM t) / (1 + count(hit.term))) AS weight FROM q LEFT JOIN hit ON q.term = hit.term GROUP BY q.term)
SELECT t.doc_id, round(coalesce(s.score, 0) / (SELECT sum(weight) FROM w), 6) AS score
FROM t LEFT JOIN (SELECT doc_id, sum(weight) AS score FROM hit JOIN w USING (term) GROUP BY doc_id) s ON t.doc_id = s.doc_id""")
def lexical_scores(spark, path):
    texts = load_tables(spark, path, ["documents"])["documents"].select("doc_id", F.lower("text").alias("body"))
    terms = retrieve.terms_of(spark, QUESTION)
    return texts.select("doc_id", F.round(retrieve.lexical_score(texts, F.col("body"), terms), 6).alias("score"))


@query("columns_named_in_text", """
WITH names AS (SELECT DISTINCT role AS name FROM conversations UNION SELECT DISTINCT source FROM documents
               UNION SELECT DISTINCT p_name FROM part),
t AS (SELECT conv_id, turn, string_split_regex(trim(regexp_replace(lower(text || ' see the ' || role || ' of SRC-' || CAST(conv_id % 20 AS VARCHAR)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM conversations),
runs AS (SELECT DISTINCT conv_id, turn, array_to_string(w[s:s + n - 1], '') AS run
         FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS s FROM t), range(1, 11) r(n) WHERE s + n - 1 <= len(w))
SELECT conv_id, turn, name FROM runs JOIN names ON run = regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g')
WHERE length(run) >= 3""")
def columns_named_in_text(spark, path):
    t = load_tables(spark, path, ["conversations", "documents", "part"])
    names = (
        t["conversations"].select(F.col("role").alias("name")).union(t["documents"].select("source"))
        .union(t["part"].select("p_name")).distinct()
    )
    texts = t["conversations"].withColumn(
        "text", F.concat("text", F.lit(" see the "), "role", F.lit(" of SRC-"), (F.col("conv_id") % 20).cast("string")))
    return retrieve.columns_named_in(texts, ["conv_id", "turn"], "text", names, "name")


@query("texts_renamed", """
SELECT doc_id, regexp_replace(regexp_replace(text, '\\b(the)\\b', 'def_article', 'gi'), '\\b(la)\\b', 'article_fr', 'gi') AS text
FROM documents""")
def texts_renamed(spark, path):
    df = load_tables(spark, path, ["documents"])["documents"]
    return df.select("doc_id", X.rename_words(F.col("text"), {"the": "def_article", "la": "article_fr"}).alias("text"))


# --- shapes and display -------------------------------------------------------
@query("value_shapes", """
SELECT shape, count(*) AS n FROM (
 SELECT substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(cell), '\\s+', ' ', 'g'),
   '\\p{L}+', 'a', 'g'), '\\p{Nd}+', '9', 'g'), '9([.,]9)+', '9', 'g'), 1, 24) AS shape
 FROM (SELECT p_name || ' ' || p_brand || '-' || CAST(p_size AS VARCHAR) || ',000.50' AS cell FROM part
       UNION ALL SELECT c_name FROM customer UNION ALL SELECT url FROM pages)) GROUP BY shape""")
def value_shapes(spark, path):
    t = load_tables(spark, path, ["part", "customer", "pages"])
    cells = (
        t["part"].select(F.expr("p_name || ' ' || p_brand || '-' || CAST(p_size AS STRING) || ',000.50'").alias("cell"))
        .unionAll(t["customer"].select("c_name")).unionAll(t["pages"].select("url"))
    )
    return cells.groupBy(X.value_shape(F.col("cell")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("json_safe_numbers", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity
FROM lineitem""")
def json_safe_numbers(spark, path):
    df = load_tables(spark, path, ["lineitem"])["lineitem"]
    x = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", X.bounded_json_number(x).alias("quantity"))
