"""Token ids of whole texts by a public tokenizer, with a bounded cache of the pieces between blanks."""

from __future__ import annotations

import array
import functools
import itertools
import json
import os

import numpy as np

#: The vocabulary file; its folder is a property of the installation, never copied here.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed values of byte-level BPE: printable bytes stand for themselves, the n-th other byte for code point 256 + n.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Marks that are one unit of the vocabulary's pattern where they stand together after a word.
MARKS = ".,;:!?#$%&*()[]{}-_+=/~^@"


#: Fixed value: what the short cuts below hold for. A vocabulary with other rules is encoded by the library alone.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


#: A-Z as a-z and line feeds as blanks; letters of ASCII; the second bytes of the letters U+00C0 to U+00FF.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91], PLAIN[10] = PLAIN[97:123], 32
IS_LETTER, IS_MARK, IS_SECOND = (np.zeros(256, bool) for _ in range(3))
IS_LETTER[97:123] = True
IS_MARK[list(MARKS.encode())] = True
IS_SECOND[128:192] = True
IS_SECOND[[0x97, 0xB7]] = False


class IdStore:
    """Token ids of numbered pieces, in one array."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def add(self, pieces: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.number), len(pieces)
        while at + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.starts[at:at + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at:at + n] = sizes
        self.used += len(flat)
        self.number.update(zip(pieces, range(at, at + n)))

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The pieces' numbers, -1 for unknown ones."""
        return np.fromiter(map(self.number.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces in a row, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)], sizes


class Encoder:
    """Ids of texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    Under ``RULES`` white space is dropped, A-Z count as a-z, and the pattern never matches across a blank or from
    a letter to a mark, nor do the normalisers change anything across these, so a text's ids are those of its
    pieces between them.  Pieces of Latin-1 letters, which the normalisers only lower-case, go straight to the
    library's BPE model, all others through the whole library.

    Pieces are kept in two generations: when the younger holds ``most`` it becomes the older one, and what is met
    again moves over without being encoded again.  That bounds the memory of a worker and changes no id.  A
    vocabulary with other rules is encoded by the library, text by text.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"].lower().encode() for t in spec["added_tokens"]]
        # an added token must lie inside one piece: it holds no blank and no mark after a letter
        inside = (not IS_MARK[list(x)].any() and len(x.split()) == 1 for x in self.specials)
        self.by_pieces = all(spec[part] == rule for part, rule in RULES.items()) and spec["model"]["type"] == "BPE" and all(inside)
        self.known, self.older = IdStore(), IdStore()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        plain: list[bytes] = []
        other: list[bytes] = []
        # the ids go into one list of numbers: a list for each piece would be walked by every garbage collection
        flat, sizes = array.array("I"), array.array("q")
        tokenize = self.model.tokenize
        for piece in pieces:
            if piece.isalpha() and piece.islower():
                word = piece.decode()
            elif (word := piece.decode()).isalpha() and max(word := word.lower()) <= "\xff":
                word = word.encode().decode("latin-1").translate(BYTE_CHARS)
            else:
                other.append(piece)
                continue
            plain.append(piece)
            before = len(flat)
            flat.extend([t.id for t in tokenize(word)])
            sizes.append(len(flat) - before)
        for ids in self._library([p.decode() for p in other]) if other else ():
            flat.extend(ids)
            sizes.append(len(ids))
        self.known.add(plain + other, np.array(flat, np.uint32), np.array(sizes, np.int64))

    def _pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The texts' pieces in a row, and how many each has."""
        bodies = [t.encode() for t in texts]
        raw = np.frombuffer(b" ".join(bodies), np.uint8)
        data = PLAIN[raw]
        if any(x in lowered for lowered in [data.tobytes()] for x in self.specials):
            # added tokens are found in the text as it stands: A-Z must stay
            data = np.where(raw == 10, np.uint8(32), raw)
        low = PLAIN[data]
        letter = IS_LETTER[low]
        letter[1:] |= IS_SECOND[low[1:]] & (low[:-1] == 0xC3)
        cuts = np.flatnonzero(letter[:-1] & IS_MARK[low[1:]]) + 1
        blanks = np.concatenate([np.flatnonzero(data == 32), cuts])
        blanks.sort()
        bounds = np.cumsum([len(b) + 1 for b in bodies])
        # a text's pieces are one more than its blanks; the blank between two texts belongs to neither
        counts = np.diff(np.searchsorted(blanks, bounds[:-1] - 1, side="right"), prepend=0, append=len(blanks) + 1)
        return np.insert(data, cuts, 32).tobytes().split(b" "), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.by_pieces or not texts:
            found = self._library(texts)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum())), counts
        pieces, counts = self._pieces(texts)
        numbers = self.known.find(pieces)
        gaps = np.flatnonzero(numbers < 0).tolist()
        if gaps:
            new = {pieces[n] for n in gaps}
            if len(self.known.number) + len(new) > self.most and self.known.number:
                self.older, self.known = self.known, IdStore()
                new, gaps = set(pieces), list(range(len(pieces)))
            again = list(new & self.older.number.keys())
            if again:
                self.known.add(again, *self.older.ids(self.older.find(again)))
                new -= self.older.number.keys()
            if new:
                self._learn(list(new))
            numbers[gaps] = self.known.find([pieces[n] for n in gaps])
        ids, sizes = self.known.ids(numbers)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)], prepend=0)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def slices(texts: list[str], chars: int = 1_000_000):
    """Runs of ``texts`` of about ``chars`` code points, a longer text being a run of its own: (from, to)."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
