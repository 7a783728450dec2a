"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesense.llm import tokens, words
from tablesense.llm.common import are_few, broadcast_counted, giving_back, settle
from tablesense.llm.components import connected_components

#: Hashes of a signature, orders of the forest and hashes by which an order sorts.
HASHES, ORDERS, KEY = 48, 16, 12
#: Least common prefix of candidates, and the prefixes at which crowded regions are looked at again.
DEPTHS = (2, 4, 8)
#: A region of more documents is crowded; a document then meets so many neighbours after it.
CROWD, REACH = 32, 4
#: So many of KEY hashes make it likely that documents of a crowded region link.
ALIKE = 8
#: Partners of a document that are compared in one block.
BLOCK = 64
#: Shingles are ordered by how many of them fall into one of so many buckets of hashes (a power of two).
BUCKETS = 1 << 18
#: Bits of a bitmap for each shingle of its set, at least.
BITS = 4
#: Lists of nothing but ids are broadcast up to so many rows.
IDS = 2_000_000


#: An odd factor for each hash of the signature.
FACTORS = words.mix(np.arange(1001, 1001 + HASHES, dtype=words.U)) | words.U(1)


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    return words.shingle_sets(*words.word_hashes([t.encode() for t in texts]), size)


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 32-bit signature of each non-empty set: for each of HASHES functions, its smallest value, mixed."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), HASHES), ">u4")
    for i, factor in enumerate(FACTORS):
        out[:, i] = words.mix(np.minimum.reduceat(sets * factor, starts) ^ words.U(i)) >> words.U(32)
    return out


def _sketch(size: int):
    """(id, text, print) to (id, print, n, d1, d2, signature): set size, 128-bit digest of the set, signature."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                sets, counts = shingles(texts[a:b], size)
                some = counts > 0
                starts = (np.cumsum(counts) - counts)[some]
                digests = np.zeros((2, b - a), words.U)
                body = [None] * (b - a)
                if some.any():
                    for i in range(2):
                        digests[i, some] = np.add.reduceat(words.mix(sets + words.U(7 + i)), starts)
                    for at, sign in zip(np.flatnonzero(some), signatures(sets, counts)):
                        body[at] = sign.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts, pa.int64()),
                    *(pa.array(d.view(np.int64)) for d in digests), pa.array(body, pa.binary())], names=["id", "print", "n", "d1", "d2", "signature"])

    return run


def _runs(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of rows that share their first ``depth`` values (column 0 is the order)."""
    change = np.flatnonzero((keys[1:, :depth + 1] != keys[:-1, :depth + 1]).any(axis=1)) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])


def _candidates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in sorted rows (order, hashes...) whose documents are to be compared, and whether their region is crowded."""
    left, right = [], []
    starts, ends = _runs(keys, DEPTHS[0])
    size = np.repeat(ends - starts, ends - starts)
    end = np.repeat(ends, ends - starts)
    at = np.arange(len(keys))
    for j in range(1, CROWD):
        near = at + j < end
        if j > REACH:
            near &= size <= CROWD
        left.append(at[near])
        right.append(at[near] + j)
    for depth in DEPTHS:
        for a, b in zip(*(x.tolist() for x in _runs(keys, depth))):
            if b - a <= CROWD:
                continue
            agree = np.zeros(b - a, np.int64)
            for c in range(depth + 1, keys.shape[1]):
                _, of, n = np.unique(keys[a:b, c], return_inverse=True, return_counts=True)
                agree += n[of] == n.max()
            centre = a + int(agree.argmax())
            left.append(np.full(b - a, centre))
            right.append(np.arange(a, b))
    left, right = np.concatenate(left), np.concatenate(right)
    return left, right, size[left] > CROWD


def _neighbours(edges: bool):
    """Sorted (tree, key, rep, n) to candidate pairs (a, b), sets of fitting size only.

    With ``edges``, the rows at both ends of each partition come back too, as (tree, key, rep, n), to be
    compared across partitions.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "tree", "key", "rep", "n"]
        carry: list = []
        first = True

        def border(rows: list) -> pa.RecordBatch:
            tree, key, rep, n = zip(*rows)
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(tree, pa.int32()), pa.array(key, pa.binary()), pa.array(rep, pa.int64()), pa.array(n, pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = carry + list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            if first and edges:
                yield border(rows[:CROWD])
            first = False
            keys = np.empty((len(rows), KEY + 1), np.int64)
            keys[:, 0] = [r[0] for r in rows]
            keys[:, 1:] = np.frombuffer(b"".join(r[1] for r in rows), ">u4").reshape(-1, KEY)
            rep = np.array([r[2] for r in rows], np.int64)
            n = np.array([r[3] for r in rows], np.int64)
            x, y, full = _candidates(keys)
            fit = (rep[x] != rep[y]) & (100 * np.minimum(n[x], n[y]) >= 75 * np.maximum(n[x], n[y]))
            # _unmet finds every link of a crowd; only what is likely to link is compared before
            fit[full] &= (keys[x[full], 1:] == keys[y[full], 1:]).sum(axis=1) >= ALIKE
            pairs = np.unique(np.stack([np.minimum(rep[x], rep[y])[fit], np.maximum(rep[x], rep[y])[fit]]), axis=1)
            if pairs.shape[1]:
                m = pairs.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
            # the last rows and the centre of the region they are in go on to the next batch
            last = _runs(keys, DEPTHS[0])[0][-1]
            tail = rows[max(last, len(rows) - CROWD):]
            crowd = [rows[i] for i in np.unique(x[(x >= last) & (y == len(rows) - 1)])][:len(DEPTHS) + 2]
            carry = [r for r in crowd if r not in tail] + tail
        if edges and carry:
            yield border(carry)

    return run


PAIRS = "a long, b long, tree int, key binary, rep long, n long"


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of (rep, n, signature) that stand together in an order of the forest.

    Order t starts a third of the way between orders' hashes: its key is the signature from hash
    3t on, cyclically.  All orders are sorted at once by range, so a region of any size is spread over
    tasks by its deeper hashes and, last, by id.
    """
    step = HASHES // ORDERS
    twice = F.concat("signature", "signature")
    rows = reps.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda t: F.struct(
            t.cast("int").alias("tree"), F.substring(twice, t * (4 * step) + 1, F.lit(4 * KEY)).alias("key")))).alias("of"), "rep", "n",
    ).select("of.tree", "of.key", "rep", "n")
    order = ["tree", "key", "rep"]
    found = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(True), PAIRS), "forest")
    # a few rows for each partition, whatever their number
    across = (
        found.where("a is null").select("tree", "key", "rep", "n").distinct()
        .coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours(False), PAIRS))
    return found.where("a is not null").select("a", "b").unionByName(across.where("a is not null").select("a", "b")).distinct()


PAIR = "a long, b long, link boolean"


def _compare(share: int):
    """(block, role, id, set), a block's centre first (a row for each of its texts), to pairs (a, b, link) of the centre."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, centre, own = None, None, []
        for batch in batches:
            out = []
            for key, role, rep, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = np.frombuffer(body, words.U)
                if role == 0:
                    block, centre, own = key, rep, (own if key == block else []) + [found]
                    continue
                assert key == block
                link = False
                for mine in own:
                    both = np.concatenate([mine, found])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    link |= 100 * shared >= share * (len(both) - shared)
                out.append((min(centre, rep), max(centre, rep), link))
            a, b, link = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(link, pa.bool_())], names=["a", "b", "link"])

    return run


def _sets(size: int):
    """(id, text) to (id, body): the set of the text."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                sets, counts = shingles(texts[a:b], size)
                ends = np.cumsum(counts).tolist()
                body = [sets[e - n:e].tobytes() for e, n in zip(ends, counts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(body, pa.binary())], names=["id", "body"])

    return run


def _bits(size: int):
    """(id, text) to (id, body): the size of the text's set (8 bytes) and a bitmap of its hashes' last bits, BITS or more a shingle."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                sets, counts = shingles(texts[a:b], size)
                body, at = [], 0
                for n in counts.tolist():
                    held = np.zeros(1 << max(6, (BITS * n - 1).bit_length()), np.uint8)
                    held[(sets[at:at + n] & words.U(len(held) - 1)).astype(np.int64)] = 1
                    body.append(n.to_bytes(8, "little") + np.packbits(held).tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(body, pa.binary())], names=["id", "body"])

    return run


def _most_shared(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
    """So many shingles at most are in two sets of ``n`` and ``m`` with bitmaps ``x`` and ``y``: a bit that only one set has is a shingle the other lacks."""
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _screen(share: int):
    """(block, role, id, bitmap), as ``_compare`` takes them, to the pairs (a, b) of the centre whose bitmaps allow a link."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, centre, own = None, None, []
        for batch in batches:
            out = []
            for key, role, rep, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = int.from_bytes(body[:8], "little"), np.frombuffer(body, np.uint64, offset=8)
                if role == 0:
                    block, centre, own = key, rep, (own if key == block else []) + [found]
                    continue
                assert key == block
                if any(100 * (most := _most_shared(*found, m, bits)) >= share * (found[0] + m - most) for m, bits in own):
                    out.append((min(centre, rep), max(centre, rep)))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _blocks(pairs: DataFrame, few: bool = False) -> DataFrame:
    """(rep, block, role): each pair in a block of the busier of its two documents (role 0), about BLOCK partners in one."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    busy = broadcast_counted(settle(ends.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "centres", few))
    for c in "ab":
        pairs = pairs.join(busy.select(F.col("rep").alias(c), F.col("m").alias(f"m_{c}")), c, "left").withColumn(f"m_{c}", F.coalesce(f"m_{c}", F.lit(1)))
    turned = F.col("m_b") > F.col("m_a")
    dealt = pairs.select(
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other"), F.greatest("m_a", "m_b").alias("m"))
    dealt = dealt.select("centre", "other", F.struct("centre", F.pmod(F.xxhash64("other"), F.ceil(F.col("m") / BLOCK).cast("long")).alias("salt")).alias("block"))
    ends = F.array(F.struct(F.col("centre").alias("rep"), "block", F.lit(0).alias("role")), F.struct(F.col("other").alias("rep"), "block", F.lit(1).alias("role")))
    return dealt.select(F.explode(ends).alias("end")).select("end.*").distinct()


def _side_by_side(docs: DataFrame, pairs: DataFrame, body) -> DataFrame:
    """(block, role, id, body) of all documents of ``pairs``, dealt by block, a block's centre first.  ``docs`` is (id, text)."""
    few = are_few(pairs)
    members = settle(_blocks(pairs, few), "members", few)
    needed = broadcast_counted(settle(members.select("rep").distinct(), "needed", few), IDS)
    bodies = docs.join(needed, F.col("id") == F.col("rep")).select("id", "text").mapInArrow(body, "id long, body binary")
    return (
        bodies.join(broadcast_counted(members), F.col("id") == F.col("rep")).select("block", "role", "id", "body")
        .repartition("block").sortWithinPartitions("block", "role"))


def screened(docs: DataFrame, pairs: DataFrame, size: int, share: int) -> DataFrame:
    """The ``pairs`` (a, b) without those that cannot link by the bitmaps of their sets, which are an eighth as long or less; no link is lost."""
    return settle(_side_by_side(docs, pairs, _bits(size)).mapInArrow(_screen(share), "a long, b long").distinct(), "screened", are_few(pairs))


def compared(docs: DataFrame, pairs: DataFrame, size: int, share: int) -> DataFrame:
    """The ``pairs`` (a, b) by their full sets; ``link``: 100 * intersection >= share * union.  ``docs`` is (id, text)."""
    return settle(_side_by_side(docs, pairs, _sets(size)).mapInArrow(_compare(share), PAIR), "compared")


def crowded(reps: DataFrame) -> DataFrame:
    """(rep) of the sets that stand in a region of more than CROWD in at least one order; regions are told apart by 64-bit hashes."""
    step, depth = HASHES // ORDERS, DEPTHS[0]
    twice = F.concat("signature", "signature")
    places = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda t: F.xxhash64(
        t, F.substring(twice, t * (4 * step) + 1, F.lit(4 * depth))))).alias("region"))
    full = settle(places.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("region"), "regions")
    return settle(places.join(broadcast_counted(full), "region").select("rep").distinct(), "crowded")


def _bucket_counts(size: int):
    """(id, text) to (bucket, n): how many shingles of the batch fall into each bucket."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                held += np.bincount(_bucket(shingles(texts[a:b], size)[0]), minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], names=["bucket", "n"])

    return run


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found & words.U(BUCKETS - 1)).astype(np.int64)


def _prefixes(size: int, share: int, often):
    """(id, text) to (rep, n, at, h): the shingles of each set that a link's first common shingle can be, with their places."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                sets, counts = shingles(texts[a:b], size)
                owner = np.repeat(np.arange(b - a), counts)
                order = np.lexsort((sets, often.value[_bucket(sets)], owner))
                n = counts[owner]
                at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                kept = 100 * (n - at) >= share * n
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a:b][owner[kept]], pa.int64()), pa.array(n[kept], pa.int64()), pa.array(at[kept], pa.int64()),
                    pa.array(sets[order][kept].view(np.int64))], names=["rep", "n", "at", "h"])

    return run


def _groups_joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) with the groups, or nodes without one, at both ends of each link (a, b) made one."""
    for c in "ab":
        links = links.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group")), c, "left").withColumn(f"{c}_group", F.coalesce(f"{c}_group", c))
    joined = connected_components(links.select(F.col("a_group").alias("a"), F.col("b_group").alias("b")))
    every = groups.unionByName(joined.select("node", F.col("node").alias("component")).join(groups.select("node"), "node", "left_anti"))
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
    return every.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component"))


def _joined_by(docs: DataFrame, groups: DataFrame, pairs: DataFrame | None, size: int, share: int, name: str) -> DataFrame:
    """``groups`` joined by those of the ``pairs`` (a, b) that are links."""
    if pairs is None or pairs.isEmpty():
        return groups
    return settle(_groups_joined(groups, compared(docs, pairs, size, share).where("link").select("a", "b")), name, are_few(groups) and are_few(pairs))


def _finish(docs: DataFrame, reps: DataFrame, pairs: DataFrame, groups: DataFrame, size: int, share: int) -> DataFrame:
    """``groups`` joined by all links between documents of crowded regions, where not every pair was a candidate."""
    return _joined_by(docs, groups, _unmet(docs, reps, pairs, groups, size, share), size, share, "groups")


def _unmet(docs: DataFrame, reps: DataFrame, pairs: DataFrame, groups: DataFrame, size: int, share: int) -> DataFrame | None:
    """Pairs (a, b) of documents of crowded regions that may link, are in different groups and not among ``pairs``.

    An exact join on prefixes.  With the shingles of every set in one common order, the first one that a link's
    documents share stands so early in both that what follows can still be enough: with n shingles, it has at
    most (1 - share) n before it, and in the smaller set at most (1 - 2 share / (1 + share)) n.  Documents
    of different groups that share such a shingle are compared, where their places and sizes allow a link.
    Any order is exact; rare shingles come first, so that what a crowd has in common is seldom in a prefix.
    For each shingle, the members of the group that has it most often are never paired with each other.
    """
    some = crowded(reps)
    if some.isEmpty():
        return None
    texts = docs.join(broadcast_counted(some), F.col("id") == F.col("rep")).select("id", "text")
    counts = texts.mapInArrow(_bucket_counts(size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    label = groups.select(F.col("node").alias("rep"), "component")
    found = settle(
        texts.mapInArrow(_prefixes(size, share, docs.sparkSession.sparkContext.broadcast(often)), "rep long, n long, at long, h long"), "prefixes")
    found = found.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    most = (
        found.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1"))
    found = settle(found.join(most.select("h", "most"), "h"), "shared-prefixes")
    n, at = F.col("n"), F.col("at")
    small = found.where((100 + share) * (n - at) >= 2 * share * n).select(
        "h", "most", F.col("rep").alias("x"), n.alias("n_x"), at.alias("at_x"), F.col("component").alias("x_group"))
    large = found.select("h", F.col("rep").alias("y"), n.alias("n_y"), at.alias("at_y"), F.col("component").alias("y_group"), (F.col("component") == F.col("most")).alias("y_most"))
    met = [
        left.join(right, (left.h == right.h) & (F.col("x_group") != F.col("y_group")) & (F.col("n_x") <= F.col("n_y")) & (100 * F.col("n_x") >= share * F.col("n_y"))
                  & ((100 + share) * F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= share * (F.col("n_x") + F.col("n_y"))))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        for left, right in ((small.where("x_group <> most"), large), (small.where("x_group = most"), large.where("not y_most")))]
    return settle(met[0].unionByName(met[1]).distinct().join(pairs, ["a", "b"], "left_anti"), "candidates")


def _first_links(docs: DataFrame, pairs: DataFrame, size: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Groups (node, component) by the links of each document to the smallest of its partners in ``pairs``, and the
    other pairs that may link and whose ends are in different groups; what is left out cannot change any group."""
    pairs = screened(docs, pairs, size, share)
    few = are_few(pairs)
    first = settle(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs", few)
    groups = settle(connected_components(compared(docs, first, size, share).where("link").select("a", "b")), "groups", few)
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for c in "ab":
        rest = rest.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group")), c, "left")
    return groups, settle(rest.where(~F.coalesce(F.col("a_group") == F.col("b_group"), F.lit(False))).select("a", "b"), "rest", few)


def near_duplicates(
    docs: DataFrame, size: int = 5, share: int = 75, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, print, n_shingles, component_id, kept) of every row: groups of documents linked by similar shingle sets.

    ``print`` is the xxhash64 of the text, which tells the texts of a repeated id apart.

    Words are runs without blanks, A-Z lower-cased; a document's set is its distinct ``size``-word shingles
    (all its words, if fewer).  Documents are linked if 100 * intersection >= ``share`` * union;
    ``component_id`` is the smallest id that links reach, ``kept`` whether it is the document's own.

    Equal sets are folded into one representative before anything else, so copies cost one row each.
    Representatives are sorted in ORDERS orders of their signatures; neighbours that share at least two
    hashes are candidates, all of them in a region of up to CROWD.  A crowded region is entered deeper:
    each document meets its next REACH neighbours, which share the longest prefix, and the most central
    document of its region at each of the DEPTHS, the one whose other hashes agree with most; of these,
    only pairs with at least ALIKE equal hashes are candidates.
    Bitmaps of the sets tell candidates that cannot link, whatever else is in the sets; the others are
    confirmed on their full sets of 64-bit shingle hashes, recomputed from the texts: each document with the
    smallest of its candidates first, then all candidates whose ends those links left in different groups.

    Last, an exact join finds all links between documents of crowded regions that are still in different
    groups (see ``_unmet``).

    A pair of similarity s misses all regions with probability (1 - s^2)^ORDERS at most: 2e-6 at 0.75.
    Links between documents that are in one group anyway are not compared; the answer is groups, not links.

    Defined cases: null or empty texts have no shingles and are linked with nothing; a null id has a
    null component and is kept; rows with the same id and text share one answer (if an id has
    several texts, a link of any of them joins that id); an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sketch = settle(
        rows.withColumn("print", F.xxhash64("text")).mapInArrow(_sketch(size), "id long, print long, n long, d1 long, d2 long, signature binary"), "sketches")
    reps = settle(
        sketch.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")), "sets")
    pairs = settle(candidate_pairs(reps), "candidates")
    groups, rest = _first_links(rows, pairs, size, share)
    # what these links join, the exact join does not meet: in a crowd it makes a row for each pair of groups and shingle
    groups = _joined_by(rows, groups, rest, size, share, "groups")
    groups = _finish(rows, reps, pairs, groups, size, share)
    classes = settle(
        reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("component", "rep").alias("component")), "classes")
    out = (
        sketch.select("id", "print", "n", "d1", "d2")
        .join(classes, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") > 0), "left")
        .select(F.col("id").alias(id_col), "print", F.col("n").alias("n_shingles"),
                F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with the document of the smallest id of each group.

    Defined cases: rows repeated in full all stay or all go; of the texts of one id only those go that are copies of
    a smaller id's; null ids, null, empty and blank texts stay; an empty table gives no rows.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = settle(found.where("not kept").select(F.col(id_col).alias("__id"), F.col("print").alias("__print")).distinct(), "near-duplicates")
    same = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))) == gone["__print"]
    return docs.join(gone, (docs[f"`{id_col}`"] == gone["__id"]) & same, "left_anti")
