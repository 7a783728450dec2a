"""Toxic spans and document scores by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablesense.llm import tokens
from tablesense.llm.common import settle

#: Words of a chain that are worked through at a time; a document is one chain whatever its length.
BLOCK = 64
#: Prefix lengths that are features of a word beside the word itself.
PREFIXES = (3, 4, 5, 6)
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def normal(piece: str) -> str:
    """A piece between blanks as a word: lower case, without what is no letter at its ends."""
    word = piece.lower()
    return word if word.isalpha() else _EDGES.sub("", word)


def features(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing may be learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")) % 3 == 1


@dataclass
class Tagger:
    """A chain with labels other (0) and toxic (1); only differences of their scores count.

    ``moves``: log weights of start to toxic, other to toxic, toxic to other and toxic to toxic, against
    start to other and other to other.  ``weights``: of features of toxic words.  ``fit``: the document score.
    """

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))
    fit: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word)) if word else self.bias

    def document_score(self, most: np.ndarray, mass: np.ndarray) -> np.ndarray:
        z = self.fit[0] + self.fit[1] * most + self.fit[2] * np.log1p(mass)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Blocks:
    """Chains of ``counts`` words each, cut into blocks of BLOCK words that stay linked.

    ``owner``: the chain of every block; ``first``: its first word (over all chains); ``lengths``: its words;
    ``place``: its place in its chain.
    """

    owner: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Blocks:
        n = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(counts)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        first = (np.cumsum(counts) - counts)[owner] + place * BLOCK
        return cls(owner, first, np.minimum(counts[owner] - place * BLOCK, BLOCK), place)

    def runs(self, least: int) -> Iterator[Blocks]:
        """The blocks in runs of whole chains, ``least`` blocks or more each, but for the last."""
        starts = np.append(np.flatnonzero(self.place == 0), len(self.place))
        a = 0
        for b in starts[1:].tolist():
            if b - a >= least or b == starts[-1]:
                yield Blocks(self.owner[a:b], self.first[a:b], self.lengths[a:b], self.place[a:b])
                a = b

    def grid(self, values: np.ndarray) -> np.ndarray:
        """One row of BLOCK values for each block."""
        places = self.first[:, None] + np.arange(BLOCK)
        return np.where(self.inside, np.append(values, 0)[np.minimum(places, len(values))], 0)

    @property
    def inside(self) -> np.ndarray:
        return np.arange(BLOCK) < self.lengths[:, None]


def _boundaries(emit: np.ndarray, blocks: Blocks, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages at the blocks' edges, (2, blocks) each: what comes before a block's first word, and what follows its last.

    A block is a product of 2 x 2 matrices; those of all blocks are multiplied out together, then passed along
    each chain, block by block, for all chains at a time.
    """
    start, enter, leave, stay = moves
    n = len(blocks.place)
    ahead, behind = np.empty((2, n)), np.ones((2, n))
    heads = np.flatnonzero(blocks.place == 0)
    ahead[:, heads] = np.array([[1.0], [start]])
    size = np.diff(np.append(heads, n))
    if not n or size.max() == 1:
        return ahead, behind
    last = np.zeros(n, bool)
    last[heads + size - 1] = True
    # columns: the images of "other" and "toxic"; the last block of a chain ends without a move
    image = np.zeros((2, 2, n))
    image[0, 0] = image[1, 1] = 1
    for t in range(BLOCK):
        toxic = emit[:, t] * image[1]
        moved = ~last if t + 1 == BLOCK else ~last | (t + 1 < blocks.lengths)
        image = np.where(moved, np.stack([image[0] + leave * toxic, enter * image[0] + stay * toxic]), np.stack([image[0], toxic]))
        image /= image.sum(axis=(0, 1))
    order = np.argsort(-size, kind="stable")
    heads, size = heads[order], size[order]
    longer = [int(np.searchsorted(-size, -k, side="left")) for k in range(int(size[0]))]  # chains of more than k blocks
    for k in range(1, int(size[0])):
        at = heads[:longer[k]] + k
        to = np.einsum("ijn,jn->in", image[:, :, at - 1], ahead[:, at - 1])
        ahead[:, at] = to / to.sum(axis=0)
    for k in range(int(size[0]) - 1, 0, -1):
        at = heads[:longer[k]] + k
        to = np.einsum("ijn,in->jn", image[:, :, at], np.where(last[at], 1.0, behind[:, at]))
        behind[:, at - 1] = to / to.sum(axis=0)
    return ahead, behind


def marginals(scores: np.ndarray, blocks: Blocks, moves: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """P(toxic) of every word, by forward-backward over whole chains; ``scores`` is (blocks, BLOCK), padded after their lengths.

    To ``used``, if given, the expected numbers of the four ``moves`` over all chains are added.
    """
    steps = start, enter, leave, stay = np.exp(np.clip(moves, -30, 30))
    emit = np.exp(np.clip(scores, -30, 30))
    n, width = scores.shape
    before, behind = _boundaries(emit, blocks, steps)
    ahead = np.empty((width, n, 2))
    other, toxic = before[0], before[1] * emit[:, 0]
    for t in range(width):
        if t:
            other, toxic = other + toxic * leave, (other * enter + toxic * stay) * emit[:, t]
        total = other + toxic
        other, toxic = other / total, toxic / total
        ahead[t, :, 0], ahead[t, :, 1] = other, toxic
    out = np.zeros((n, width))
    linked = np.append(blocks.place[1:] > 0, False)  # blocks that another one of their chain follows
    other = np.where(linked, behind[0] + enter * behind[1], 1.0)
    toxic = np.where(linked, leave * behind[0] + stay * behind[1], 1.0)
    if used is not None:
        ends = ahead[-1, :, 0], ahead[-1, :, 1]
        joint = np.stack([ends[0] * behind[0], ends[0] * enter * behind[1], ends[1] * leave * behind[0], ends[1] * stay * behind[1]])
        used[1:] += np.where(linked, joint[1:] / joint.sum(axis=0), 0).sum(axis=1)
    for t in range(width - 1, -1, -1):
        inside = t < blocks.lengths
        both = ahead[t, :, 0] * other, ahead[t, :, 1] * toxic
        out[:, t] = np.where(inside, both[1] / (both[0] + both[1]), 0)
        after = emit[:, t] * toxic
        if used is not None and t:
            # neighbours' joint probabilities: what leads to the one, the move, and what follows the other
            joint = np.stack([ahead[t - 1, :, 0] * other, ahead[t - 1, :, 0] * enter * after, ahead[t - 1, :, 1] * leave * other, ahead[t - 1, :, 1] * stay * after])
            used[1:] += np.where(inside, joint[1:] / joint.sum(axis=0), 0).sum(axis=1)
        other, toxic = other + enter * after, leave * other + stay * after
        total = other + toxic
        other, toxic = np.where(inside, other / total, 1.0), np.where(inside, toxic / total, 1.0)
    if used is not None:
        used[0] += out[blocks.place == 0, 0].sum()
    return out


def _seeds(docs: list[list[str]], toxic: np.ndarray, least: int, ratio: float) -> set[str]:
    """Words and prefixes that mark toxic documents: in ``least`` contexts or more there, hardly in others.

    Contexts are the two words on either side, one context from each document, so neither copies of a document nor
    a long document make a word count often.
    """
    often: Counter[str] = Counter()
    for doc, bad in zip(docs, toxic):
        if bad:
            often.update({f for word in doc if word for f in features(word)})
    contexts: dict[str, set] = {f: set() for f, n in often.items() if n >= least}
    clean: dict[str, int] = defaultdict(int)
    for doc, bad in zip(docs, toxic):
        if bad:
            first: dict[str, tuple] = {}
            for i, word in enumerate(doc):
                for f in features(word) if word else ():
                    if f in contexts and f not in first:
                        first[f] = (*doc[max(0, i - 2):i], "", *doc[i + 1:i + 3])
            for f, around in first.items():
                contexts[f].add(around)
    contexts = {f: c for f, c in contexts.items() if len(c) >= least}
    for doc, bad in zip(docs, toxic):
        if not bad:
            for f in {f for word in set(doc) if word for f in features(word)} & contexts.keys():
                clean[f] += 1
    share = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    return {f for f, c in contexts.items() if len(c) / share[0] >= ratio * (clean[f] + 0.05) / share[1] and clean[f] <= 0.002 * share[1]}


def train(texts: list[str], toxic: list[bool], rounds: int = 60, ratio: float = 20.0) -> Tagger:
    """Fit the chain to words labelled by ``_seeds`` in toxic documents, and the document score to the documents."""
    bad = np.array(toxic, bool)
    known: dict[str, str] = {}
    docs = [[known[p] if p in known else known.setdefault(p, normal(p)) for p in t.split()] for t in texts]
    known.clear()
    if not bad.any() or bad.all():
        return Tagger()
    seeds = _seeds(docs, bad, max(4, int(0.01 * bad.sum())), ratio)
    index: dict[str, int] = {}
    of = np.array([index.setdefault(w, len(index)) for doc in docs for w in doc], np.int64)
    vocabulary = list(index)
    marked = np.array([any(f in seeds for f in features(w)) if w else False for w in vocabulary], bool)
    counts = np.array([len(d) for d in docs], np.int64)
    labels = marked[of] & np.repeat(bad, counts)
    seen = {f for w, m in zip(vocabulary, marked) if m for f in features(w)}
    names = {f: i for i, f in enumerate(sorted(seen))}
    pairs = np.array([(i, names[f]) for i, w in enumerate(vocabulary) if w for f in features(w) if f in names], np.int64).reshape(-1, 2)
    runs = list(Blocks.of(counts).runs(4096))
    grids = [(run.grid(of).astype(np.int32), run.grid(labels).astype(bool), run.inside) for run in runs]
    model = Tagger()
    w, bias, moves = np.zeros(len(names)), -4.0, np.array([-1.0, -1.0, 0.0, 0.0])
    power = [np.full(len(names), 1e-6), 1e-6, np.full(4, 1e-6)]
    heads = (np.cumsum(counts) - counts)[counts > 0]
    joined = np.ones(len(labels), bool)
    joined[heads] = False
    was, now = labels[:-1][joined[1:]], labels[1:][joined[1:]]
    moved = np.array([labels[heads].sum(), (now & ~was).sum(), (was & ~now).sum(), (was & now).sum()])
    for _ in range(rounds):
        emission = bias + np.bincount(pairs[:, 0], w[pairs[:, 1]], len(vocabulary)) if len(pairs) else np.full(len(vocabulary), bias)
        expected, by_word, missing = np.zeros(4), np.zeros(len(vocabulary)), 0.0
        for run, (grid, gold, inside) in zip(runs, grids):
            p = marginals(np.where(inside, emission[grid], 0), run, moves, expected)
            rest = np.where(inside, gold - p, 0)
            by_word += np.bincount(grid.ravel(), rest.ravel(), len(vocabulary))
            missing += rest.sum()
        grads = [np.bincount(pairs[:, 1], by_word[pairs[:, 0]], len(names)) - 0.05 * w, missing, None]
        grads[2] = moved - expected - 0.05 * moves
        for i, g in enumerate(grads):
            power[i] = power[i] + g * g
        w = w + grads[0] / np.sqrt(power[0])
        bias = float(bias + grads[1] / np.sqrt(power[1]))
        moves = np.clip(moves + grads[2] / np.sqrt(power[2]), -8, 8)
    model.bias, model.moves = bias, moves
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
    emission = np.array([model.emission(x) for x in vocabulary])
    most, mass = np.zeros(len(docs)), np.zeros(len(docs))
    for run in runs:
        some = summed(marginals(run.grid(emission[of]), run, moves), run.owner, len(docs))
        most, mass = np.maximum(most, some[0]), mass + some[1]
    x = np.stack([np.ones(len(docs)), most, np.log1p(mass)], axis=1)
    fit = np.zeros(3)
    for _ in range(50):  # Newton steps with a weak prior
        y = 1 / (1 + np.exp(-np.clip(x @ fit, -40, 40)))
        hess = (x * (y * (1 - y))[:, None]).T @ x + 0.1 * np.eye(3)
        fit = fit + np.linalg.solve(hess, x.T @ (bad - y) - 0.1 * fit)
    model.fit = fit
    return model


def summed(p: np.ndarray, owner: np.ndarray, n: int, floor: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the largest marginal, and the sum of those of ``floor`` or more."""
    most, mass = np.zeros(n), np.zeros(n)
    np.maximum.at(most, owner, p.max(axis=1, initial=0))
    np.add.at(mass, owner, np.where(p >= floor, p, 0).sum(axis=1))
    return most, mass


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: dict[str, int], max_bytes: int, id_col: str, text_col: str, label_col: str,
) -> tuple[list[str], list[bool]]:
    """At most so many texts of each label (``per_class``), picked by a hash of their ids, for the driver to fit to.

    Only ids that have a text of at most ``max_bytes`` are picked from, so the sample is as large as those allow;
    an id with several such texts brings the first of them.
    """
    known = (
        labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & ~is_held_out(id_col))
        .groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.max(F.col(f"`{label_col}`").cast("int")) > 0).alias("bad")))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") <= max_bytes)
    known = settle(known.join(texts.select("id"), "id", "left_semi"), "labelled")
    some = [known.where(c).orderBy(F.xxhash64("id"), "id").limit(n) for c, n in per_class.items()]
    picked = some[0].unionByName(some[1])
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("bad").alias("bad")).collect()
    rows.sort(key=lambda r: r.id)
    return [r.text for r in rows], [r.bad for r in rows]


class Scorer:
    """Marginals of whole texts; the scores of pieces between blanks are remembered, up to ``most`` of them."""

    def __init__(self, model: Tagger, most: int = 400_000) -> None:
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest marginal, mass, marginals of all words in a row) of the texts."""
        split = [t.split() for t in texts]
        new = set().union(*split) - self.known.keys()
        if new and len(self.known) + len(new) > self.most:
            self.known = {}
            new = set().union(*split)
        self.known.update((p, self.model.emission(normal(p))) for p in new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.known.__getitem__
        scores = np.fromiter((get(p) for one in split for p in one), float, int(counts.sum()))
        blocks = Blocks.of(counts)
        if not len(blocks.owner):
            return np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(0)
        p = marginals(blocks.grid(scores), blocks, self.model.moves)
        return *summed(p, blocks.owner, len(texts)), p[blocks.inside]


def offending(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, mean marginal) of the runs of words whose marginal is ``least`` or more."""
    spans: list[list] = []
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if p[i] >= least:
            if spans and spans[-1][3] == i - 1:
                spans[-1] = [spans[-1][0], m.end(), spans[-1][2] + [p[i]], i]
            else:
                spans.append([m.start(), m.end(), [p[i]], i])
    return [(a, b, float(np.mean(x))) for a, b, x, _ in spans]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 1000, clean_share: int = 4, max_bytes: int = 32_768, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(id_col, score, spans) of every row: toxicity of the whole text and the offsets of its toxic runs.

    The chain is fitted in the driver to at most ``per_class`` toxic rows and ``clean_share`` times as many
    others, of texts of up to ``max_bytes`` (the documented bound of what the driver holds), never to
    held-out rows.  A word's
    features are the word and its prefixes; words are labelled in toxic documents where they, or
    a prefix, mark those documents in many different contexts.  Scoring reads every text whole: a document
    is one chain, forward-backward gives each word's marginal, and the
    largest marginal and their mass give the score.  ``spans`` are (start, end, score), code points.

    Defined cases: null and empty texts have no words and the score of that; rows without labels are
    scored alike; an id labelled twice is toxic if any label says so; null labels are not used; without
    both labels every score is that of a text without words; repeated rows are each scored; an empty
    table gives no rows; other columns are ignored.
    """
    model = train(*labelled_sample(docs, labels, {"bad": per_class, "not bad": clean_share * per_class}, max_bytes, id_col, text_col, label_col))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                most, mass, p = scorer(texts[a:b])
                ends = np.cumsum([len(t.split()) for t in texts[a:b]])
                found = [[] for _ in range(a, b)]
                for i in np.flatnonzero(most >= 0.5):
                    found[i] = [{"start": x, "end": y, "score": z} for x, y, z in offending(texts[a + i], p[(ends[i - 1] if i else 0):ends[i]])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(model.document_score(most, mass)), pa.array(found, pa.list_(span))],
                    names=[id_col, "score", "spans"])

    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, score double, spans array<struct<start:bigint,end:bigint,score:double>>")
