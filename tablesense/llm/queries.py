"""The registered queries of this package, each with the SQL that states its answer where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from tablesense.llm import decontamination, language, line_dedup, near_dedup, packing, periodic, pii, sharding, simhash, spelling, token_files, topk, toxicity
from tablesense.llm.common import documents, reach_workers, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return topk.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM v),
best AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score
         FROM cell a JOIN cell b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM best
QUALIFY rank <= 20
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s.getField("kind").isin("email", "ip", "card", "phone"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(documents(spark, sf_dir))
    found = language.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    return found.select("page_id", "declared", "host", "language", "posterior", "rejected")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH line AS (
  SELECT doc_id, pos, t AS line, translate(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
many AS (SELECT k, min(doc_id) AS first FROM line WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM line LEFT JOIN many USING (k) GROUP BY doc_id
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The unsigned CRC-32 of a blob, a byte at a time over a table made by its rule (reflected polynomial 0xEDB88320).
CRC_MACRO = """
steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8],
            lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)
"""
OP8_SQL = f"""
WITH {CRC_MACRO},
body AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, source, strlen(text) AS size,
            [4294967295] || list_transform(range(strlen(text)), lambda i: ('0x' || h[2*i+1:2*i+2])::INT::BIGINT) AS b FROM body),
rows AS (SELECT doc_id, source, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS crc,
                md5('17:' || coalesce(doc_id::VARCHAR, '')) AS mixed FROM bytes, steps),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY mixed, doc_id, crc, size) - 1)
                     / (2 * count(*) OVER (PARTITION BY source)) AS rank FROM rows),
placed AS (SELECT *, row_number() OVER (ORDER BY rank, mixed, source NULLS FIRST, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * 40 // total AS shard FROM placed)
SELECT doc_id, size + 16 AS size, crc AS text_crc32, 'rows' AS law, shard, place - (shard * total + 39) // 40 AS slot,
       NULL::INT AS grown_shard FROM cut
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.is_contaminated().alias("contaminated"))


OP9_SQL = r"""
WITH item AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
len_of AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, len_of WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, s, item FROM spot JOIN win USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic.find_runs(docs.withColumn("text", periodic.with_planted_repeats(F.col("text"), F.col("doc_id"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.word_runs(documents(spark, sf_dir))
    words = runs.select(spelling.with_letters_lost(F.col("word"), F.col("key")).alias("word"))
    return spelling.spelling_variants(spelling.vocabulary(words))


OP12_SQL = f"""
WITH RECURSIVE {CRC_MACRO},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
        FROM documents),
many AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS seed FROM run WHERE length(run) >= 5 GROUP BY ALL),
mixed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(strlen(seed)), lambda i: ('0x' || hex(encode(seed))[2*i+1:2*i+2])::INT::BIGINT),
                        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM many, steps),
vocab AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
                 sum(n)::BIGINT AS n FROM mixed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pair AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT cut.word, vocab.word FROM cut JOIN vocab ON rest = vocab.word
         UNION SELECT vocab.word, cut.word FROM cut JOIN vocab ON rest = vocab.word),
best AS (SELECT pair.word, count(*) AS n_near, max(v.n) AS top, min(struct_pack(less := -v.n, near := near)).near AS near
         FROM pair JOIN vocab v ON near = v.word GROUP BY pair.word),
own AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN near END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
        FROM vocab LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, form AS next FROM own
        UNION ALL SELECT way.word, own.word, own.form FROM way JOIN own ON way.next = own.word)
SELECT own.*, root FROM own JOIN way ON own.word = way.word AND way.next IS NULL
"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_top_k": op1_top_k,
    "op2_near_dedup": op2_near_dedup,
    "op3_packing": op3_packing,
    "op4_personal_data": op4_personal_data,
    "op5_token_files": op5_token_files,
    "op6_language": op6_language,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_simhash": op13_simhash,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op1_top_k": OP1_SQL, "op7_line_dedup": OP7_SQL, "op8_sharding": OP8_SQL, "op9_decontamination": OP9_SQL, "op12_spelling_variants": OP12_SQL}
