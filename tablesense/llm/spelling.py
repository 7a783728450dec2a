"""Spelling variants: words one edit apart, found in a bidirectional FM-index, and the form that each belongs to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablesense.llm.common import broadcast_counted, lower_ascii, settle
from tablesense.llm.fm_index import BidirectionalIndex

#: Letters (delimiters included) of the words that one task indexes, and that one half word may bring to it.
SHARD = 1 << 19


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, word) for every maximal run of letters a-z, A-Z and U+00C0 to U+00FF of the whole texts, A-Z as a-z."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"([A-Za-zÀ-ÿ]+)"))
    return docs.select(F.col(f"`{id_col}`").alias("key"), F.explode(runs).alias("word")).withColumn("word", lower_ascii(F.col("word")))


def with_letters_lost(word: Column, key: Column) -> Column:
    """Words as they are, but without one letter where 97 divides h, the unsigned CRC-32 of ``key:word``.

    The letter at h % length (from 0) goes.  A null key counts as the empty text.
    """
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of at least ``min_length`` code points with at least ``min_count`` rows."""
    return (
        words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count))


def _halves(words: DataFrame) -> DataFrame:
    """(back, half, asks, word, n): the half words under which each word can be met, and whether it asks there.

    A query of m letters asks by its first floor(m / 2) letters, and (``back``, its word reversed) by its last
    ceil(m / 2).  Partners have m - 1 to m + 1 letters, so a word of L letters is held under its first
    floor((L - 1) / 2) letters and one more, and under its last ceil((L - 1) / 2) and one more; its own query is among these.
    """
    size = F.char_length("word")
    below, own = F.floor((size - 1) / 2).cast("int"), F.floor(size / 2).cast("int")
    below_back, own_back = F.ceil((size - 1) / 2).cast("int"), F.ceil(size / 2).cast("int")

    def at(back: bool, of: Column, n: Column, asks: Column) -> Column:
        return F.struct(F.lit(back).alias("back"), F.substr(of, F.lit(1), n).alias("half"), (n == asks).alias("asks"))

    back = F.reverse("word")
    met = F.array(
        at(False, F.col("word"), below, own), at(False, F.col("word"), below + 1, own),
        at(True, back, below_back, own_back), at(True, back, below_back + 1, own_back))
    return words.select("word", "n", F.explode(met).alias("at")).select("at.*", "word", "n")


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, near, near_n): all pairs, in both directions, of distinct words (word, n) one edit apart.

    An edit leaves a word's first or second half as it is.  Words are dealt by their halves, so that partners meet;
    each task indexes the words dealt to it and searches for each by the half that is
    exact, extending across the other with one error (``BidirectionalIndex``).  A half word whose words
    hold more than ``shard`` letters is dealt to several tasks, and its queries to all of these: a
    search costs the same however many words an index holds, and no pairs are listed but those found.
    A pair that both schemes find comes once.
    """
    met = settle(_halves(words), "halves")
    letters = F.sum(F.char_length("word") + 1)
    total = met.agg(letters).first()[0] or 0
    shards = max(1, -(-total // shard))
    # at most total / shard half words are that frequent, so this side is as small as the number of tasks
    crowded = met.groupBy("back", "half").agg(letters.alias("held")).where(F.col("held") > shard)
    crowded = crowded.select("back", "half", F.ceil(F.col("held") / shard).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    dealt = (
        met.join(broadcast_counted(settle(crowded, "crowded")), ["back", "half"], "left")
        .select("*", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))).alias("part"), own.alias("own"))
        .select(
            "back", F.pmod(F.xxhash64("back", "half", "part"), F.lit(shards)).cast("int").alias("shard"),
            "word", "n", "asks", (F.col("part") == F.col("own")).alias("held")))

    def search(table: pa.Table) -> pa.Table:
        back = table.column("back")[0].as_py()
        names, counts, asks, held = (table.column(c).to_pylist() for c in ("word", "n", "asks", "held"))
        count = dict(zip(names, counts))
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        words, queries = (sorted({turn(w) for w, x in zip(names, flags) if x}) for flags in (held, asks))
        pairs = []
        if words and queries:
            # a letter of a query that no word here holds may be its error
            index = BidirectionalIndex(words, "".join(set().union(*queries)))
            asked, found = index.one_edit_after(queries, [-(-len(q) // 2) if back else len(q) // 2 for q in queries])
            pairs = [(turn(queries[a]), turn(index.words[b])) for a, b in zip(asked.tolist(), found.tolist())]
        return pa.table({
            "word": pa.array([a for a, _ in pairs], pa.string()), "n": pa.array([count[a] for a, _ in pairs], pa.int64()),
            "near": pa.array([b for _, b in pairs], pa.string()), "near_n": pa.array([count[b] for _, b in pairs], pa.int64())})

    return dealt.groupBy("back", "shard").applyInArrow(search, "word string, n bigint, near string, near_n bigint").distinct()


def spelling_variants(words: DataFrame, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (distinct ``word`` with its count ``n``).

    ``n_near`` counts the words one inserted, deleted or replaced code point away.  ``form`` is the commonest of
    these (ties: smallest in code-point order) if its count ``form_n`` is at least ``ratio`` times the word's.  ``root`` is
    where the forms lead, the word itself if it has none; counts rise along them, so they end.

    Defined cases: a null word goes; without near words ``n_near`` is 0 and the form null; a word of any
    length is indexed whole; an empty table gives no rows; other columns are ignored.
    """
    words = settle(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = (
        near_words(words, shard).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
                F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n")))
    near = settle(near, "near-words")
    roots = settle(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    rising = not roots.isEmpty()
    while rising:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = settle(roots.join(broadcast_counted(up), "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("rose")), "roots")
        rising = not jumped.where("rose").isEmpty()
        roots = jumped.select("word", "root")
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
