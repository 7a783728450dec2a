"""Families of one template: crowds whose members are too far from each other to link, with true pairs among them."""

import random

import numpy as np

from tablesense.llm import near_dedup


def test_pairs_in_a_family_without_links_to_a_centre(spark):
    """Members are 0.66 alike (156 of 236), two of a pair 0.81 (175 of 217): no centre and few neighbours lead from one to the other."""
    rnd = random.Random(11)
    shared = [f"b{i}" for i in range(160)]
    texts = []
    for k in range(500):
        own = [f"o{k}x{i}" for i in range(40)]
        texts.append(shared + own)
        if k % 2 == 0:
            twin = own[:19] + [f"t{k}x{i}" for i in range(21)]
            texts.append(shared + twin)
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    sets = {i: {tuple(t[j:j + 5]) for j in range(len(t) - 4)} for i, t in zip(ids, texts)}
    want, holder = {i: i for i in ids}, {}
    for i in ids:
        for s in sets[i]:
            holder.setdefault(s, []).append(i)
    for a in ids:
        for b in {i for s in sets[a] if len(holder[s]) == 2 for i in holder[s]} - {a}:
            n = len(sets[a] & sets[b])
            assert 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)
            want[a] = min(a, b)
    assert sum(k != v for k, v in want.items()) == 250
    alone = [i for i in ids if want[i] == i][:40]
    assert all(100 * (n := len(sets[a] & sets[b])) < 75 * (len(sets[a]) + len(sets[b]) - n) for a in alone for b in alone if a < b)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == want


def test_a_group_of_several_centres(spark):
    """A chain of links 1 - 2 - 3 - 4, all compared but 3 with 4: 4 is near both 1 and 2, but only 3 leads it to them."""
    texts = {k: " ".join(f"w{i}" for i in range(12 * k, 12 * k + 100)) for k in range(1, 5)} | {k: f"alone{k} text{k}" for k in range(10, 50)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    reps = spark.createDataFrame([(k, len(t.split()), bytes(4 * near_dedup.HASHES)) for k, t in texts.items()], "rep long, n long, signature binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)], "a long, b long")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    got = near_dedup._finish(docs, reps, pairs, groups, 1, 75)
    assert {r.node: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_the_busier_document_is_the_centre(spark):
    """A document of the largest id, paired with all others, is the centre of blocks of a bounded size."""
    n = 2000
    pairs = spark.createDataFrame([(i, n) for i in range(n)] + [(0, 1)], "a long, b long")
    rows = near_dedup._blocks(pairs).collect()
    centres = [r for r in rows if r.role == 0]
    assert sorted({r.rep for r in centres}) == [0, n] and len(centres) <= 1 + n // near_dedup.BLOCK + 1
    sizes = {}
    for r in rows:
        sizes[r.block] = sizes.get(r.block, 0) + r.role
    assert sum(sizes.values()) == n + 1 and max(sizes.values()) <= 2 * near_dedup.BLOCK


def test_bitmaps_never_hide_a_link(spark):
    """The bound is no less than what is shared, for sets of any two sizes; a pair far from a link is dropped, a link stays."""
    rnd = np.random.default_rng(5)
    for n, m, both in [(1, 1, 1), (1, 1, 0), (0, 5, 0), (30, 40, 30), (400, 500, 385), (500, 500, 300), (700, 520, 519), (3000, 2300, 2290)]:
        x = rnd.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[:both], rnd.integers(0, 2**63, m - both, dtype=np.uint64)])
        maps = []
        for found in (x, y):
            held = np.zeros(1 << max(6, (near_dedup.BITS * len(found) - 1).bit_length()), np.uint8)
            held[(found & np.uint64(len(held) - 1)).astype(int)] = 1
            maps += [len(found), np.packbits(held).view(np.uint64)]
        assert both <= near_dedup._most_shared(*maps) == near_dedup._most_shared(*maps[2:], *maps[:2]) <= min(n, m)
    base = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:280])), (3, " ".join(base[:230])), (4, " ".join(base[:200])), (4, " ".join(base))], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "a long, b long")
    got = {(r.a, r.b) for r in near_dedup.screened(docs, pairs, 1, 75).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3)}
    apart = spark.createDataFrame([(5, " ".join(base)), (6, " ".join(base[:150] + [f"v{i}" for i in range(150)]))], "id long, text string")
    assert near_dedup.screened(apart, spark.createDataFrame([(5, 6)], "a long, b long"), 1, 75).count() == 0


def test_comparisons_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Families of 30 near copies, below the size of a crowd, and one of 300: a few full comparisons a document, not all pairs."""
    rnd = random.Random(7)
    rows = []
    for family, n in [(f, 30) for f in range(10)] + [(10, 300)]:
        base = [f"f{family}w{i}" for i in range(150)]
        for k in range(n):
            i = rnd.randrange(150)
            rows.append((len(rows), " ".join(base[:i] + [f"f{family}c{k}"] + base[i + 1:])))
    sizes, compared = [], near_dedup.compared

    def counted(docs, pairs, *args):
        sizes.append(pairs.count())
        return compared(docs, pairs, *args)

    monkeypatch.setattr(near_dedup, "compared", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: min(k // 30 * 30, 300) for k, _ in rows}
    assert sum(sizes) <= 2 * len(rows)


def test_links_left_from_first_comparisons_join_groups_before_the_exact_join(spark, monkeypatch):
    """The exact join makes rows for documents of different groups only, so it is to meet groups that all links known so far have joined."""
    text = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text + ["x"])), (3, "on its own")], "doc_id long, text string")
    none, rest = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([(1, 2)], "a long, b long")
    met, exact = [], near_dedup._unmet
    monkeypatch.setattr(near_dedup, "_first_links", lambda *args: (none, rest))
    monkeypatch.setattr(near_dedup, "_unmet", lambda docs, reps, pairs, groups, *more: met.append(groups.collect()) or exact(docs, reps, pairs, groups, *more))
    got = near_dedup.near_duplicates(docs).collect()
    assert [{r.node: r.component for r in x} for x in met] == [{1: 1, 2: 1}]
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_blocks_join_each_end_of_a_pair_once(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    blocks = near_dedup._blocks(pairs)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    assert blocks.count() == len({(r.rep, r.block, r.role) for r in blocks.collect()}) == 100
