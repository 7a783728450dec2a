"""Maximal periodic runs of words: block convolution at dyadic scales, then extension of the distances found."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablesense.llm.tokens import slices

#: The field of the number transform: 11 * 2^21 + 1 is prime, so it has roots of unity of every order 2^k used here,
#: and 64 products of balanced residues sum below 2^53, where doubles are exact integers.
PRIME = 11 * (1 << 21) + 1
#: Length of a block that is matched: the scale, up to this many words.
BLOCK = 32
#: Rows (block and window) that are transformed at once.
TILE = 4096
SHORTEST, REPEATS = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _balanced(x: np.ndarray) -> np.ndarray:
    """Integers modulo the prime, as doubles of least absolute value."""
    return x - np.rint(x / PRIME) * PRIME


@functools.lru_cache(maxsize=None)
def _transforms(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of the number transform of size 2 * block: of a reversed pattern, of a window, and back.

    A window's product with the pattern is a cyclic correlation; its first ``block`` places do not wrap round,
    so the way back leads to those only.
    """
    size = 2 * block
    root = next(r for g in range(2, 100) if pow(r := pow(g, (PRIME - 1) // size, PRIME), block, PRIME) == PRIME - 1)
    power = np.array([pow(root, k, PRIME) for k in range(size)], float)
    jk = np.outer(np.arange(size), np.arange(size))
    there, back = _balanced(power[jk % size]), _balanced(power[-jk % size])
    scaled = _balanced(back[:, :block] * float(pow(size, PRIME - 2, PRIME) - PRIME))
    return back[:block], there, scaled


def _zero_mismatches(x: np.ndarray, energy: np.ndarray, at: np.ndarray, window: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Which (row, offset) have sum over t < block of (x[at+t] - x[window+offset+t])^2 = 0 modulo the prime.

    The square is expanded: two running sums of squares and one correlation, computed by the number transform.
    A true zero is never missed; a chance zero is told apart by the comparison of the words that follows.
    """
    pattern, there, back = _transforms(block)
    t = np.arange(2 * block)
    owner, row = np.unique(at, return_inverse=True)
    heads = _balanced(x[owner[:, None] + t[:block]] @ pattern)
    cross = _balanced(_balanced(_balanced(x[window[:, None] + t] @ there) * heads[row]) @ back)
    starts = window[:, None] + t[:block]
    squares = energy[starts + block] - energy[starts] + (energy[at + block] - energy[at])[:, None]
    return np.nonzero(_balanced(_balanced(squares) - 2 * cross) == 0)


def _stretch(ids: np.ndarray, low: int, high: int, i: int, d: int) -> tuple[int, int]:
    """The longest [a, e) within [low, high) around i where all words d apart are identical."""
    a, step = i, 16
    while a > low:
        back = max(low, a - step)
        differ = np.flatnonzero(ids[back:a] != ids[back + d:a + d])
        if len(differ):
            a = back + int(differ[-1]) + 1
            break
        a, step = back, 2 * step
    e, step = i, 16
    while e + d < high:
        ahead = min(high - d, e + step)
        differ = np.flatnonzero(ids[e:ahead] != ids[e + d:ahead + d])
        if len(differ):
            e += int(differ[0])
            break
        e, step = ahead, 2 * step
    return a, e + d


def _seeds(ids: np.ndarray, x: np.ndarray, energy: np.ndarray, starts: np.ndarray, ends: np.ndarray, scale: int) -> np.ndarray:
    """(place, distance) rows of blocks that occur again ``scale`` to twice ``scale`` words later (from 1 at the first)."""
    block, first = min(scale, BLOCK), scale == 8
    offsets = np.arange(0 if first else scale, 2 * scale, block)
    long = ends - starts >= max(SHORTEST, REPEATS * scale if not first else 0)
    low, high = -(-starts[long] // scale), (ends[long] - block - (1 if first else scale)) // scale
    n = np.maximum(high - low + 1, 0)
    place = (np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())) * scale
    limit = np.repeat(ends[long], n)
    out = []
    for r in range(0, len(place) * len(offsets), TILE):
        rows = np.arange(r, min(r + TILE, len(place) * len(offsets)))
        own, off = rows // len(offsets), offsets[rows % len(offsets)]
        fits = place[own] + off + block <= limit[own]
        own, off = own[fits], off[fits]
        row, extra = _zero_mismatches(x, energy, place[own], place[own] + off, block)
        i, d, high_of = place[own][row], off[row] + extra, limit[own][row]
        keep = (d > 0) & (i + d + block <= high_of)
        i, d = i[keep], d[keep]
        t = np.arange(block)
        keep = (ids[i[:, None] + t] == ids[(i + d)[:, None] + t]).all(axis=1)
        out.append(np.stack([i[keep], d[keep]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _probed(ids: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The seeds that may lie in a run: words d apart agree on the d places after the block's start or on those before."""
    if not len(seeds):
        return seeds
    i, d = seeds.T
    own = np.searchsorted(ends, i, side="right")
    share = (np.arange(16) * d[:, None]) // 16
    sides = []
    for base in (i, i - d):
        at = base[:, None] + share
        inside = (base >= starts[own]) & (base + 2 * d <= ends[own])
        at = np.where(inside[:, None], at, 0)
        sides.append(inside & (ids[at] == ids[np.minimum(at + d[:, None], len(ids) - 1)]).all(axis=1))
    return seeds[sides[0] | sides[1]]


def periodic_runs(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All runs of several texts in a row: (start, end, period), sorted; ``ids`` number the words.

    A run of period q with at least 3 q (and 24) words holds, at the scale B with B <= q < 2 B (the first scale, 8,
    also serves smaller q), a block of B words that starts at a multiple of B and occurs again q words later.  So every run is
    seeded; its distance is extended to both sides by comparing words.  Distances rise, and a seed inside a
    known run whose period divides its distance is that run again: what is left has its smallest period.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.random.default_rng(7).integers(-(PRIME // 2), PRIME // 2, int(ids.max()) + 1 if len(ids) else 0)
    x = np.concatenate([place[ids], np.zeros(2 * BLOCK)]).astype(float)
    energy = np.concatenate([[0.0], np.cumsum(_balanced(x * x))])
    runs: list[tuple[int, int, int]] = []
    scale = 8
    while len(counts) and max(SHORTEST, REPEATS * scale) <= counts.max():
        seeds = _probed(ids, _seeds(ids, x, energy, starts, ends, scale), starts, ends)
        seeds = seeds[np.argsort(seeds[:, 0], kind="stable")]
        i, d = seeds.T
        alive = np.ones(len(i), bool)

        def cover(a: int, e: int, q: int) -> None:
            here = slice(*np.searchsorted(i, (a, e)))
            alive[here] &= (d[here] % q != 0) | (i[here] + d[here] > e)

        if len(i):
            for run in runs:
                cover(*run)
        for n in np.argsort(d, kind="stable").tolist():
            if not alive[n]:
                continue
            own = int(np.searchsorted(ends, i[n], side="right"))
            a, e = _stretch(ids, int(starts[own]), int(ends[own]), int(i[n]), int(d[n]))
            q = int(d[n])
            here = slice(*np.searchsorted(i, (a, e - q)))
            alive[here] &= d[here] != q
            if e - a >= max(SHORTEST, REPEATS * q):
                runs.append((a, e, q))
                cover(a, e, q)
        scale *= 2
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of every whole text: (id_col, runs, n_runs, best, collapsed).

    Words are runs of anything but blanks, compared as they are.  ``runs`` lists (start, length, period) by
    start, then period, counted in words: maximal stretches of at least 24 words and three periods whose words
    one smallest period apart are identical.  ``best`` is the run of greatest length over period (ties:
    smallest start, then period).  ``collapsed`` is the text without what a run holds after its first period,
    its words joined by one space.

    Each text is searched by itself in the task that reads it (``periodic_runs``): nothing is shuffled and a
    lost worker searches its part again.  Time grows as words times the number of scales.

    Defined cases: null, empty or blank text has no runs, a null ``best`` and the empty ``collapsed``;
    null ids and repeated rows are kept, one row each; a text of any length is searched whole; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                words = [t.split() for t in texts[a:b]]
                counts = np.fromiter(map(len, words), np.int64, b - a)
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(counts.sum()))
                found = periodic_runs(ids, counts)
                ends = np.cumsum(counts)
                owner = np.searchsorted(ends, found[:, 0], side="right").tolist()
                of: list[list[dict]] = [[] for _ in words]
                for own, (start, end, q) in zip(owner, found.tolist()):
                    of[own].append({"start": start - int(ends[own] - counts[own]), "length": end - start, "period": q})
                best, collapsed = [], []
                for ws, rs in zip(words, of):
                    best.append(min(rs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if rs else None)
                    if rs:
                        edge = np.zeros(len(ws) + 1, np.int64)
                        for r in rs:
                            edge[r["start"] + r["period"]] += 1
                            edge[r["start"] + r["length"]] -= 1
                        ws = [ws[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(ws))
                yield pa.RecordBatch.from_arrays([
                    keys.slice(a, b - a), pa.array(of, pa.list_(run_type)), pa.array([len(r) for r in of], pa.int64()), pa.array(best, run_type),
                    pa.array(collapsed, pa.binary())], names=["key", "runs", "n_runs", "best", "body"])

    found = (
        docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"))
        .mapInArrow(run, f"key {kind}, runs array<{RUN}>, n_runs bigint, best {RUN}, body binary"))
    return found.select(F.col("key").alias(id_col), "runs", "n_runs", "best", F.decode("body", "UTF-8").alias("collapsed"))


def with_planted_repeats(text: Column, key: Column) -> Column:
    """The texts of a fixed tenth of the keys with their words from one place on repeated with a period.

    With h the unsigned CRC-32 of the key as text and g = floor(h / 10): if 10 divides h and the text has n > 0
    words, word i >= a is the original word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Other texts, also those of null keys, stay as they are.
    """
    h = F.crc32(key.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))

    def planted(w: Column) -> Column:
        # the words and their number are bound once, by a list of one, so that they are not computed for each word
        g, n = F.floor(h / 10), F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    repeated = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(text)), F.lit(0))
    return F.when(h % 10 == 0, repeated).otherwise(text)
