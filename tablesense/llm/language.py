"""Language of texts by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesense.llm import tokens
from tablesense.llm.common import broadcast_counted, giving_back, settle

#: Hashed byte trigrams of the text model, and the share of their evidence that counts (neighbours overlap).
CODES, TEMPER = 1 << 15, 0.2
#: Pseudo-counts that draw a host to its suffix, a suffix to the corpus, a declaration to no information.
HOST, SUFFIX, DECLARED = 5.0, 50.0, 1.0

#: Parts in which a language's texts are picked.
PARTS = 64

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class TextModel:
    """``table[l, code]``: log probability of a trigram in language ``languages[l]``; at least one language."""

    languages: list[str]
    table: np.ndarray

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the sums of its trigrams' log probabilities in each language, and how many trigrams it has."""
        codes, counts = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        some = counts > 0
        starts = (np.cumsum(counts) - counts)[some]
        if len(starts):
            for i, row in enumerate(self.table):
                out[some, i] = np.add.reduceat(row[codes], starts)
        return out, counts


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes around each letter, in a row, and how many each text has; lower case, all else a blank."""
    bodies = [b" " + t.lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _LETTER[data]
    data = np.where(letter, data, 32).astype(np.uint32)
    middle = letter[1:-1]
    codes = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    counts = np.add.reduceat(letter, np.cumsum(lengths) - lengths, dtype=np.int64)
    return codes[middle], counts


def train(
    docs: DataFrame, text_col: str = "text", language_col: str = "lang", per_language: int = 500, max_bytes: int = 16_384,
) -> TextModel:
    """A text model from at most ``per_language`` texts (of at most ``max_bytes``) of each declared language.

    The texts are picked by a hash of themselves, copies counting once, and only hashes are sorted to pick.  The
    driver holds a row of CODES numbers for each language, and one part of the texts at a time.  The languages' own frequencies are left to the priors, which
    read all rows.

    Defined cases: rows without text or without a declared language teach nothing; equal texts of one language count
    once; texts over ``max_bytes`` are not picked, and a language that has no others keeps a flat row; without
    any language the only one is ``und``; an empty table gives that model; other columns are ignored.
    """
    known = docs.select(
        primary(F.col(f"`{language_col}`")).alias("language"), F.col(f"`{text_col}`").alias("text"),
        F.octet_length(F.col(f"`{text_col}`")).alias("n"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    known = known.where("language <> '' and n > 0")
    languages = sorted(r.language for r in known.select("language").distinct().collect())
    some = known.where(F.col("n") <= max_bytes)
    # a language may hold a third of all rows: its first hashes are found part by part, then among the parts' first
    part = F.pmod("h", F.lit(PARTS))
    among, first = (F.row_number().over(Window.partitionBy("language", *by).orderBy("h")) for by in ([part], []))
    firsts = some.select("language", "h").distinct().withColumn("r", among).where(F.col("r") <= per_language)
    picked = settle(firsts.withColumn("r", first).where(F.col("r") <= per_language).select("language", "h"), "training-texts")
    texts = some.join(broadcast_counted(picked), ["language", "h"]).groupBy("language", "h").agg(F.min("text").alias("text"))
    table = np.full((max(1, len(languages)), CODES), 0.5)
    place = {language: i for i, language in enumerate(languages)}
    for r in texts.toLocalIterator():
        table[place[r.language]] += np.bincount(trigrams([r.text])[0], minlength=CODES)
    return TextModel(languages or ["und"], np.log(table / table.sum(axis=1, keepdims=True)))


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag in lower case; empty for none."""
    return F.coalesce(F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,8})(?![A-Za-z])", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.coalesce(F.regexp_extract(host, r"\.([^.]+)\.?$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """What the document element declares."""
    return primary(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([^\"'\s>]+)", 1))


def markup_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags are blanks."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def identify(
    rows: DataFrame, model: TextModel, id_col: str, text: Column, declared: Column, host: Column, suffix: Column, least: float = 0.5,
) -> DataFrame:
    """(id_col, print, declared, host, language, posterior, rejected) of every row.

    The posterior of a language is the product of the text's likelihood (tempered), the probability of
    the declared language given it, and the prior of the host.  That prior is the host's share of the language
    without the row's own vote, drawn to the suffix's share, which is drawn to the corpus's.
    Votes are the text's own posteriors, summed over all rows per host, suffix and declaration in grouped
    aggregations.  ``language`` is the likeliest, ties to the first by name; ``rejected`` marks rows whose text
    has no letters or whose posterior is below ``least``.  ``print`` is xxhash64 of the text.

    Defined cases: null or empty text has no letters, its language comes from declaration and host
    alone, and it is rejected; a null or unknown declaration or host is a value of its own; null
    ids are kept; repeated rows are each a vote and a result; an empty table gives no rows.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    n = len(model.languages)
    texts = rows.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(declared, F.lit("")).alias("declared"),
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix")).withColumn("print", F.xxhash64("text"))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(1).to_pylist()
            for a, b in tokens.slices(body):
                found, counts = model.log_likelihoods(body[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(batch.column(i).slice(a, b - a) for i in range(2, 6)), pa.array(counts),
                     pa.array((TEMPER * (found - found.max(axis=1, keepdims=True))).tolist(), pa.list_(pa.float64()))],
                    names=["id", "declared", "host", "suffix", "print", "letters", "likelihood"])

    scored = settle(texts.mapInArrow(run, f"id {kind}, declared string, host string, suffix string, print long, letters long, likelihood array<double>"), "text-likelihoods")
    weights = F.transform("likelihood", F.exp)
    voted = (
        scored.withColumn("weights", weights).withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
        .withColumn("vote", F.when(F.col("letters") > 0, F.transform("weights", lambda w: w / F.col("total"))).otherwise(F.array_repeat(F.lit(0.0), n)))
        .drop("weights", "total"))

    def votes(*by: str) -> DataFrame:
        # rounded, so that the order of the sums does not show
        return voted.groupBy(*by).agg(F.array(*[F.round(F.sum(F.get("vote", i)), 6) for i in range(n)]).alias("n"))

    per_suffix = settle(votes("suffix"), "suffix-votes")
    overall = settle(per_suffix.agg(F.array(*[F.sum(F.get("n", i)) for i in range(n)]).alias("all")), "votes")

    def share(own: str, parent: Column, weight: float) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda x, p: (x + weight * p) / (total + weight))

    per_suffix = per_suffix.join(F.broadcast(overall)).select(
        F.col("suffix").alias("s"), F.col("n").alias("suffix_n"),
        share("all", F.array_repeat(F.lit(1.0 / n), n), float(n)).alias("corpus"))  # one row: the corpus
    per_host = settle(votes("host"), "host-votes").select(F.col("host").alias("h"), F.col("n").alias("host_n"))
    per_tag = settle(votes("declared"), "declared-votes").select(F.col("declared").alias("d"), F.col("n").alias("tag_n"))
    # P(declared | language) up to a factor common to all declarations of the row
    told = F.zip_with("tag_less", "corpus_less", lambda x, c: (x + DECLARED / n) / (c + DECLARED))

    def less(name: str) -> Column:
        return F.zip_with(name, "vote", lambda x, v: F.greatest(x - v, F.lit(0.0)))

    joined = (
        voted.join(broadcast_counted(per_suffix), F.col("suffix") == F.col("s"))
        .join(broadcast_counted(per_host), F.col("host") == F.col("h"))
        .join(broadcast_counted(per_tag), F.col("declared") == F.col("d"))
        .join(F.broadcast(overall))
        .withColumn("corpus_less", less("all")).withColumn("tag_less", less("tag_n")).withColumn("suffix_less", less("suffix_n")).withColumn("host_less", less("host_n"))
        .withColumn("of_suffix", share("suffix_less", F.col("corpus"), SUFFIX))
        .withColumn("of_host", share("host_less", F.col("of_suffix"), HOST))
        .withColumn("told", told)
        .withColumn("score", F.zip_with(F.transform("likelihood", F.exp), F.zip_with("of_host", "told", lambda a, b: a * b), lambda a, b: a * b)))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_max("score")
    posterior = best / F.aggregate("score", F.lit(0.0), lambda a, x: a + x)
    return joined.select(
        F.col("id").alias(id_col), "print", "declared", "host", F.get(names, F.array_position("score", best).cast("int") - 1).alias("language"),
        posterior.alias("posterior"), ((F.col("letters") == 0) | (posterior < least)).alias("rejected"))


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` for raw pages: markup text and declaration, host and suffix of the address."""
    host = host_of(F.col(f"`{url_col}`"))
    return identify(pages, model, id_col, markup_text(F.col(f"`{html_col}`")), markup_language(F.col(f"`{html_col}`")), host, suffix_of(host))


def drop_rejected(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``docs``, all columns, without the documents that ``identify`` rejects.

    Defined cases: null, empty and blank texts have no letters and are rejected; null ids are judged by their own
    texts; rows repeated in full all stay or all go; a text of any length is read whole; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = identify(docs, model, id_col, text, primary(F.col(f"`{declared_col}`")), F.col(f"`{host_col}`"), F.lit(""))
    gone = settle(found.where("rejected").select(F.col(id_col).alias("__id"), F.col("print").alias("__print")), "rejected")
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["__id"]) & (F.xxhash64(text) == gone["__print"]), "left_anti")
