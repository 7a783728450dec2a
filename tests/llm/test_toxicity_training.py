"""The chain is fitted to all of its sample, by its own likelihood."""

import itertools
import math
import random

import numpy as np
import pytest

from tablesense.llm import toxicity


@pytest.mark.parametrize("block", [2, 3, 4, 64])
def test_marginals_and_expected_moves_against_enumeration(monkeypatch, block):
    """Chains of several blocks, some ending with a full one, some with one word."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rnd = np.random.default_rng(1)
    counts, moves = np.array([9, 0, 1, 8, 3, 4]), np.array([-0.5, -1.0, 0.3, 2.0])
    scores = 3 * rnd.normal(size=counts.sum())
    blocks, got = toxicity.Blocks.of(counts), np.zeros(4)
    p = toxicity.marginals(blocks.grid(scores), blocks, moves, got)[blocks.inside]
    want, at = np.zeros(4), 0
    for n in counts[counts > 0]:
        total, used, toxic = 0.0, np.zeros(4), np.zeros(n)
        for labels in itertools.product([0, 1], repeat=int(n)):
            steps = np.array([labels[0], *(sum((a, b) == m for a, b in zip(labels, labels[1:])) for m in ((0, 1), (1, 0), (1, 1)))])
            weight = np.exp(sum(scores[at + i] for i in range(n) if labels[i]) + steps @ moves)
            total, used, toxic = total + weight, used + weight * steps, toxic + weight * np.array(labels)
        assert np.allclose(p[at:at + n], toxic / total)
        want, at = want + used / total, at + n
    assert np.allclose(got, want)


def plain_marginals(scores, moves):
    """Forward-backward over one chain, word by word."""
    start, enter, leave, stay = (math.exp(m) for m in moves)
    emit = [math.exp(s) for s in scores]
    ahead, behind = [(1.0, start * emit[0])], [(1.0, 1.0)]
    for e in emit[1:]:
        o, t = ahead[-1]
        o, t = o + t * leave, (o * enter + t * stay) * e
        ahead.append((o / (o + t), t / (o + t)))
    for e in reversed(emit[1:]):
        o, t = behind[-1]
        o, t = o + enter * e * t, leave * o + stay * e * t
        behind.append((o / (o + t), t / (o + t)))
    both = [(a * c, b * d) for (a, b), (c, d) in zip(ahead, reversed(behind))]
    return [t / (o + t) for o, t in both]


def test_every_score_against_one_chain_a_document(spark):
    """A query's scores and spans, recomputed word by word; one text has 40,000 words and a span over a block's end."""
    data = "/root/testdata/sf0.01"  # the smallest with enough toxic rows to learn from
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels, {"bad": 1000, "not bad": 4000}, 32_768, "doc_id", "text", "toxic")
    model = toxicity.train(*sample)
    bad = max(model.weights, key=lambda f: (":" not in f) * model.weights[f])
    words = ["plain"] * 40_000
    words[62:67] = [bad] * 5
    more = spark.createDataFrame([(-1, " ".join(words)), (-2, None), (-3, " ")], "doc_id long, text string")
    whole = docs.unionByName(more)
    got = {r.doc_id: r for r in toxicity.score_toxicity(whole, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in whole.collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        p = plain_marginals([model.emission(toxicity.normal(w)) for w in text.split()], model.moves) if text.split() else []
        want = model.document_score(np.array([max(p, default=0.0)]), np.array([sum(x for x in p if x >= 0.2)]))[0]
        assert math.isclose(got[k].score, want, rel_tol=1e-6, abs_tol=1e-9), k
        assert {(s.start, s.end) for s in got[k].spans} == {(a, b) for a, b, _ in toxicity.offending(text, p)}
    assert [texts[-1][s.start:s.end].split() for s in got[-1].spans] == [[bad] * 5]


def test_all_chains_of_the_sample_are_fitted(monkeypatch):
    """2,000 texts of 700 words are 22,000 blocks."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices(["one", "two", "six", "ten"], k=350) + (["vile"] if i % 10 == 0 else []) + rnd.choices(["one", "two", "six", "ten"], k=349)) for i in range(2000)]
    seen, plain = [], toxicity.marginals

    def counted(scores, blocks, *rest):
        seen.append(len(blocks.owner) if len(rest) > 1 else 0)
        return plain(scores, blocks, *rest)

    monkeypatch.setattr(toxicity, "marginals", counted)
    toxicity.train(texts, [i % 10 == 0 for i in range(2000)], rounds=1)
    assert sum(seen) == sum(-(-len(t.split()) // toxicity.BLOCK) for t in texts) > 20_000
