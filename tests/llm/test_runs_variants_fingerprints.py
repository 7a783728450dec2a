"""Periodic runs, spelling variants and fingerprints: against brute force over whole tables, and in their defined cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablesense.llm import periodic, queries, simhash, spelling
from tablesense.llm.fm_index import BidirectionalIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, runs int, word string, fp string, key int, label string"
EXTRA = (1, "w", "f", 2, "l")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def texts(spark, data):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def all_runs(words):
    """Every maximal run by comparing all words a period apart, for every period."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        j = 0
        while j + q < len(words):
            a = j
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - a >= max(24, 3 * q) and not any(q % p == 0 and s <= a and j + q <= s + m for s, m, p in found):
                found.append((a, j + q - a, q))
            j += 1
    return sorted(found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs_of_all_documents(spark, data, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, data).collect()}
    n_runs = 0
    for key, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = zlib.crc32(str(key).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        n_runs += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        assert got[key] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(words, runs)))
    assert len(got) == len(texts) and n_runs > 5


def test_runs_at_every_scale():
    rng = random.Random(5)
    for k in (1, 2, 3, 40, 900) * 20:
        many = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.randrange(k) for _ in range(rng.choice([0, 1, 23, 24, 25, 60, 333, 700]))]
            for _ in range(rng.randint(0, 4) if words else 0):
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 2))
                for i in range(a + p, a + rng.randint(0, len(words) - a)):
                    words[i] = words[i - p]
            many.append(words)
        want, at = [], 0
        for words in many:
            want += [(at + s, at + s + m, q) for s, m, q in all_runs(words)]
            at += len(words)
        ids = np.array([w for words in many for w in words], np.int64)
        assert [tuple(r) for r in periodic.periodic_runs(ids, np.array(list(map(len, many)))).tolist()] == sorted(want)


def test_runs_in_defined_cases(spark, none):
    loop = "one two three  Three\n" * 9
    rows = [(1, loop), (1, loop), (None, loop), (3, None), (4, ""), (5, " \n\t"), (6, "a b " * 11 + "a"), (7, LONG), (8, LONG + " " + " ".join(["x"] * 20_000))]
    out = periodic.find_runs(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS))
    assert out.columns == ["doc_id", "runs", "n_runs", "best", "collapsed"]
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r.doc_id].append((r.n_runs, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed))
    whole = (1, [(0, 36, 4)], (0, 36, 4), "one two three Three")
    assert by[1] == [whole] * 2 and by[None] == [whole]
    assert by[3] == by[4] == by[5] == [(0, [], None, "")]
    assert by[6] == [(0, [], None, ("a b " * 11 + "a"))]
    assert by[7] == [(0, [], None, LONG)] and by[8] == [(1, [(30_000, 20_000, 1)], (30_000, 20_000, 1), LONG + " x")]
    assert periodic.find_runs(none).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(counts, ratio=2):
    """(word, n, n_near, form, form_n, root) by comparing all words."""
    form, near = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if found and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, near[w], form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def test_index_finds_all_words_one_edit_away():
    rng = random.Random(3)
    for letters in ("a", "ab", "abc", "abcdefghijklmnopqrstuvwxyzéÿ") * 8:
        words = sorted({"".join(rng.choices(letters, k=rng.choice([1, 2, 4, 5, 6, 7, 13, 30]))) for _ in range(rng.choice([1, 3, 60, 150]))})
        index, halves = BidirectionalIndex(words), [len(w) // 2 for w in words]
        asked, found = index.one_edit_after(words, halves)
        assert {(words[a], index.words[b]) for a, b in zip(asked, found)} == {
            (q, v) for q in words for v in words if q != v and one_edit(q, v) and v.startswith(q[:len(q) // 2])}


@pytest.mark.parametrize("shard", [40, 1 << 19])
def test_variants_by_all_pairs(spark, shard):
    rng = random.Random(8)
    counts = {"".join(rng.choices("abé", k=rng.randint(5, 8))): rng.choice([1, 2, 3, 4, 9, 40]) for _ in range(150)}
    counts |= {f"prefix{a}{b}shared": 3 + a for a in range(8) for b in "xyz"} | {"w" * 3_000: 5, "w" * 3_001: 11}
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 7, "x")], "word string, n int, root string")
    assert sorted(tuple(r) for r in spelling.spelling_variants(words, shard=shard).collect()) == groups(counts)


def test_variants_in_defined_cases(spark, none):
    rows = [(1, "Nation nation NATION natoin naton naton naton " + LONG), (2, None), (None, "nation"), (2, ""), (3, "été été ÉTÉ x1y"), (3, "été été ÉTÉ x1y")]
    runs = spelling.word_runs(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS))
    assert runs.where("word = 'nation'").count() == 4 and runs.where("key is null").count() == 1
    assert {(r.word, r.n) for r in spelling.vocabulary(runs, 3).where("word not like 'word%'").collect()} == {("nation", 4), ("naton", 3), ("été", 4)}
    assert spelling.spelling_variants(spelling.vocabulary(spelling.word_runs(none))).count() == 0
    lost = spelling.with_letters_lost(F.col("word"), F.col("key"))
    for r in runs.withColumn("lost", lost).distinct().collect():
        h = zlib.crc32(f"{'' if r.key is None else r.key}:{r.word}".encode())
        at = h % len(r.word)
        assert r.lost == (r.word[:at] + r.word[at + 1:] if h % 97 == 0 else r.word)


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=2):
    """The smallest id in reach of each row, by comparing all fingerprints."""
    distinct = sorted(set(p for _, p in prints))
    up = {p: p for p in distinct}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    first = {}
    for key, p in prints:
        if key is not None:
            first[find(p)] = min(first.get(find(p), key), key)
    return sorted(((key, f"{p:016x}", first.get(find(p))) for key, p in prints), key=repr)


def test_fingerprints_of_all_documents(spark, data, texts):
    got = sorted((tuple(r) for r in queries.op13_simhash(spark, data).collect()), key=repr)
    assert got == linked([(k, print_of(t)) for k, t in texts])
    assert any(k != c for k, _, c in got)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_within_the_radius(spark, radius):
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
    signed = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash.near_fingerprints(signed, radius).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= radius for r in links) and len({tuple(r) for r in links}) == len(links)
    up = {p: p for p in prints}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for r in links:
        up[find(r.a % (1 << 64))] = find(r.b % (1 << 64))
    assert all(find(a) == find(b) for a in prints for b in prints if (a ^ b).bit_count() <= radius)


def test_fingerprints_in_defined_cases(spark, none, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY_ROWS", 2)
    rows = [(5, "A b c d"), (4, "a  B c\nd"), (4, "a  B c\nd"), (3, None), (9, ""), (8, " \n"), (None, "a b c d"), (None, "all alone here"), (1, "x"), (1, LONG), (2, LONG.upper())]
    out = simhash.simhash_groups(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == linked([(k, print_of(t or "")) for k, t in rows])
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.fingerprint(LONG.encode()) == print_of(LONG)
