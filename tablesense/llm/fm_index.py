"""A bidirectional FM-index over delimited words, and the search for words one edit apart."""

from __future__ import annotations

import numpy as np

STEP = 32
PLACES = np.arange(STEP, dtype=np.uint8)
#: Queries that are searched at once.
BATCH = 20_000
#: Up to this many rotations, an interval's symbols are read one by one, beyond it each symbol is tried.
FEW = 8


def _symbols(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """The words' code points in a row, numbered from 1 in code-point order."""
    return np.searchsorted(alphabet, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)) + 1


class Rotations:
    """Ranks over the sorted rotations of the cyclic text ``$word$word...``; it extends patterns to the left.

    ``words`` are distinct and sorted, ``$`` is symbol 0.  Rotations with the same text up to their next ``$`` are in
    the order of the words that follow, so sorting needs no look beyond a word.  The rotations that start with ``$``
    come first, in the order of the words: the place of ``$word$`` is the word's number.
    """

    def __init__(self, words: list[str], alphabet: np.ndarray) -> None:
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends, n = np.cumsum(lens), int(lens.sum())
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends - lens] = False
        text[inner] = _symbols(words, alphabet)
        own = np.repeat(np.arange(len(words)), lens)
        # symbols up to and with the next '$'; a rotation at '$' itself runs to the '$' after its word
        left = ends[own] - np.arange(n) + 1
        left[~inner] = lens + 1
        bits = max(1, int(len(alphabet)).bit_length())
        width = 62 // bits
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = key << bits
            here = np.flatnonzero(left > k)
            key[here] |= text[(here + k) % n]
        rank = np.unique(key, return_inverse=True)[1]
        while width < left.max():
            second = np.where(left > width, rank[(np.arange(n) + width) % n] + 1, 0)
            rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1]
            width *= 2
        following = np.where(inner, (own + 1) % len(words), own)
        order = np.argsort(rank * len(words) + following)
        self.size, self.sigma = n, len(alphabet) + 1
        blocks = n // STEP + 1
        kind = np.uint8 if self.sigma < 255 else np.int32
        padded = np.zeros(blocks * STEP, kind)
        padded[:n] = text[order - 1]
        self.last = padded
        self.rows = padded.reshape(blocks, STEP)
        seen = np.bincount(np.arange(n) // STEP * self.sigma + padded[:n], minlength=blocks * self.sigma).reshape(blocks, self.sigma)
        before = np.zeros((blocks, self.sigma + 1), np.int64)
        np.cumsum(np.cumsum(seen, axis=0) - seen, axis=1, out=before[:, 1:])
        self.before = before.astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(padded[:n], minlength=self.sigma))])

    def counts(self, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the last symbols before place ``at`` are smaller than ``c``, and how many are ``c``."""
        block, sought = at // STEP, c.astype(self.last.dtype)[:, None]
        rows, counted = self.rows[block], PLACES < (at % STEP).astype(np.uint8)[:, None]
        smaller = self.before[block, c]
        return (
            smaller + np.count_nonzero((rows < sought) & counted, axis=1),
            self.before[block, c + 1] - smaller + np.count_nonzero((rows == sought) & counted, axis=1))

    def extend(self, low: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the pattern with ``c`` before it: its place here, its size, its distance in the other index."""
        smaller, equal = self.counts(low, c)
        smaller_end, equal_end = self.counts(low + size, c)
        return self.first[c] + equal, equal_end - equal, smaller_end - smaller

    def children(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of all letters before the intervals' rotations."""
        few = np.flatnonzero(size <= FEW)
        t = np.arange(FEW)
        inside = t < size[few, None]
        owner = np.broadcast_to(few[:, None], inside.shape)[inside]
        found = [owner * self.sigma + self.last[(low[few, None] + t)[inside]]]
        many = np.flatnonzero(size > FEW)
        ends = [((at := (low + more * size)[many]) // STEP, self.rows[at // STEP], PLACES < (at % STEP).astype(np.uint8)[:, None]) for more in (0, 1)]
        for c in range(1, self.sigma) if len(many) else ():
            n = [self.before[block, c + 1] - self.before[block, c] + np.count_nonzero((rows == c) & counted, axis=1) for block, rows, counted in ends]
            found.append(many[n[0] < n[1]] * self.sigma + c)
        pairs = np.unique(np.concatenate(found))
        pairs = pairs[pairs % self.sigma > 0]
        return pairs // self.sigma, pairs % self.sigma


class BidirectionalIndex:
    """Both directions over the same words: a pattern's intervals are kept in step while it grows to either side.

    ``more`` are letters of queries that no word holds.
    """

    def __init__(self, words: list[str], more: str = "") -> None:
        self.alphabet = np.unique(np.frombuffer("".join([more, *words]).encode("utf-32-le"), np.uint32))
        self.leftward = Rotations(sorted(words), self.alphabet)
        #: words in the order of their reversals: the numbers that a search to the right ends with
        self.words = [w[::-1] for w in sorted(w[::-1] for w in words)]
        self.rightward = Rotations([w[::-1] for w in self.words], self.alphabet)

    def one_edit_after(self, queries: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of words one edit away that begin with the query's first ``halves`` letters.

        The search scheme: the first half is matched exactly from its end to the delimiter before the word, then
        the pattern grows to the right across the second half and the delimiter after it, with one error: a
        letter replaced, left out or put in.  Letters of queries are in the index's alphabet.
        """
        order = np.argsort([len(q) for q in queries], kind="stable")
        found = [self._search([queries[k] for k in order[a:a + BATCH]], np.array(halves)[order[a:a + BATCH]]) for a in range(0, len(order), BATCH)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([order[asked] * len(self.words) + word for asked, word in found]))
        return pairs // len(self.words), pairs % len(self.words)

    def _search(self, queries: list[str], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, queries), np.int64, len(queries))
        letters = np.zeros((len(queries), int(lens.max()) + 2), np.int64)  # '$' after each word
        letters[np.arange(letters.shape[1]) < lens[:, None]] = _symbols(queries, self.alphabet)

        # the exact half, from its last letter to the '$' before its first
        low, other = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        size = np.full(len(queries), self.leftward.size)
        for k in range(int(half.max()), -1, -1):
            on = np.flatnonzero((half >= k) & (size > 0))
            c = letters[on, k - 1] if k else np.zeros(len(on), np.int64)
            low[on], size[on], shift = self.leftward.extend(low[on], size[on], c)
            other[on] += shift

        # then to the right: ``exact`` states have no error yet, ``erred`` states have theirs
        index = self.rightward
        asked, low, size = np.arange(len(queries)), other, size
        done: list[tuple[np.ndarray, np.ndarray]] = []
        e_asked, e_low, e_size = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(int(half.min()), int(lens.max()) + 1):
            at = k >= half[asked]
            on = np.flatnonzero(at & (k <= lens[asked]) & (size > 0))
            # one letter more than the query has, or another one in the place of its own
            node, c = index.children(low[on], size[on])
            node = on[node]
            new = c != letters[asked[node], k]
            node, c = node[new], c[new]
            c_low, c_size, _ = index.extend(low[node], size[node], c)
            e_asked, e_low, e_size = np.concatenate([e_asked, asked[node]]), np.concatenate([e_low, c_low]), np.concatenate([e_size, c_size])
            # the erred go on exactly; those at the end of their query need the delimiter
            e_low, e_size, _ = index.extend(e_low, e_size, letters[e_asked, k])
            alive = e_size > 0
            e_asked, e_low, e_size = e_asked[alive], e_low[alive], e_size[alive]
            over = k == lens[e_asked]
            done.append((e_asked[over], e_low[over]))
            e_asked, e_low, e_size = e_asked[~over], e_low[~over], e_size[~over]
            # replaced letters and left out ones have used up the query's letter
            inner = k < lens[asked[node]]
            skip = on[k < lens[asked[on]]]
            e_asked = np.concatenate([e_asked, asked[node][inner], asked[skip]])
            e_low = np.concatenate([e_low, c_low[inner], low[skip]])
            e_size = np.concatenate([e_size, c_size[inner], size[skip]])
            # and the exact ones take theirs
            low[on], size[on], _ = index.extend(low[on], size[on], letters[asked[on], k])
        return np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
