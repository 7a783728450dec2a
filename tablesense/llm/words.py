"""Words and shingles of whole texts as 64-bit hashes, computed over a batch's bytes at once."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: An odd number and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A number for each byte value, A-Z as a-z; the blanks' are never summed into a word.
BYTES = mix(np.arange(1, 257, dtype=U))
BYTES[65:91] = BYTES[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... in 64-bit arithmetic."""
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (run of bytes that are no blanks, A-Z lower-cased), and how many each text has.

    A word's hash is a polynomial of its bytes, taken from running sums over the whole batch.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(lengths + 1)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, U), counts
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[data] * powers(BASE, len(data)), out=sums[1:])
    # a sum over i of byte[i] * base^i, brought back to the word's own first place
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(U)), counts


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in a row, and how many each text has.

    A text of fewer than ``size`` words, but not none, has one shingle: all its words.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    short = (counts > 0) & (counts < size)
    n = np.where(short, 1, np.maximum(counts - size + 1, 0))
    owner = np.repeat(np.arange(len(counts)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner]
    padded = np.concatenate([words, np.zeros(size, U)])
    weights = mix(np.arange(101, 101 + size, dtype=U)) | U(1)
    hashed = np.zeros(len(place), U)
    whole = np.minimum(counts, size)[owner]
    for j in range(size):
        term = mix(padded[place + j] + U(j)) * weights[j]
        hashed += np.where(j < whole, term, U(0)) if short.any() else term
    hashed = mix(hashed + whole.astype(U))
    bounds = np.cumsum(n)
    for a, b in zip((bounds - n).tolist(), bounds.tolist()):
        hashed[a:b].sort()
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[fresh], np.bincount(owner[fresh], minlength=len(counts))
