"""Every declared language is learnt."""

import itertools
import math
import random
import re

import xxhash

from tablesense.llm import language, queries


def test_every_declared_language_is_learnt(spark):
    rnd = random.Random(4)
    tags = ["".join(p) for p in itertools.product("abcdefgh", repeat=2)][:60]
    lexicon = {t: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for t in tags}
    known = [(" ".join(rnd.choices(lexicon[t], k=30)), t) for i, t in enumerate(tags) for _ in range(2 if i < 50 else 1)]
    model = language.train(spark.createDataFrame(known, "text string, lang string"))
    assert model.languages == tags
    found = model.log_likelihoods([" ".join(lexicon[t]) for t in tags])[0].argmax(axis=1)
    assert [tags[i] for i in found] == tags


LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))


def plain_codes(text):
    """The hashed trigrams, byte by byte."""
    body = [b if b in LETTERS else 32 for b in b" " + text.lower().encode() + b" "]
    return [(((body[i - 1] << 16 | body[i] << 8 | body[i + 1]) * 2654435761) % 2**32) >> 17 for i in range(1, len(body) - 1) if body[i] in LETTERS]


def plain_table(docs, languages, most=500):
    """Log probabilities of trigrams from each language's first ``most`` texts by signed XXH64."""
    out = {}
    for tag in languages:
        texts = {t for t, lang in docs if t and lang == tag and len(t.encode()) <= 16_384}
        signed = {t: (lambda h: h - (h >> 63 << 64))(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in texts}
        counts = [0.5] * language.CODES
        for t in sorted(texts, key=signed.get)[:most]:
            for c in plain_codes(t):
                counts[c] += 1
        total = sum(counts)
        out[tag] = [math.log(c / total) for c in counts]
    return out


def test_every_posterior_recomputed(spark, data):
    """op6_language over all pages, in plain Python: likelihoods, votes without the row's own, host, suffix and declaration."""
    docs = [(r.text, (r.lang or "").lower()) for r in spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect()]
    tags = sorted({lang for t, lang in docs if lang and t})
    assert all(re.fullmatch("[a-z]{2,8}", x) for x in tags)
    table = plain_table(docs, tags)
    pages = []
    for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect():
        html = r.html or ""
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html)
        found = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})(?![A-Za-z])", html)
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", r.url or "")
        host = host[1].lower() if host else ""
        codes = plain_codes(text)
        sums = [sum(table[x][c] for c in codes) for x in tags]
        weights = [math.exp(language.TEMPER * (s - max(sums))) for s in sums]
        vote = [w / sum(weights) if codes else 0.0 for w in weights]
        suffix = host.rstrip(".").rpartition(".")
        pages.append((r.page_id, found[1].lower() if found else "", host, suffix[2] if suffix[1] else "", weights, vote, bool(codes)))

    def votes(place):
        sums = {}
        for page in pages:
            key = page[place] if place is not None else None
            sums[key] = [a + b for a, b in zip(sums.get(key, [0.0] * len(tags)), page[5])]
        return sums

    of_tag, of_host, of_suffix, (all_votes,) = votes(1), votes(2), votes(3), votes(None).values()
    n = len(tags)

    def drawn(own, parent, weight):
        return [(x + weight * p) / (sum(own) + weight) for x, p in zip(own, parent)]

    corpus = drawn(all_votes, [1 / n] * n, n)
    want = {}
    for k, tag, host, suffix, weights, vote, letters in pages:
        less = lambda sums: [max(a - b, 0.0) for a, b in zip(sums, vote)]
        prior = drawn(less(of_host[host]), drawn(less(of_suffix[suffix]), corpus, language.SUFFIX), language.HOST)
        told = [(x + language.DECLARED / n) / (c + language.DECLARED) for x, c in zip(less(of_tag[tag]), less(all_votes))]
        score = [a * b * c for a, b, c in zip(weights, prior, told)]
        want[k] = tag, host, tags[score.index(max(score))], max(score) / sum(score), letters
    got = queries.op6_language(spark, data).collect()
    assert len(got) == len(want)
    for r in got:
        tag, host, best, posterior, letters = want[r.page_id]
        assert (r.declared, r.host, r.language) == (tag, host, best), r.page_id
        assert math.isclose(r.posterior, posterior, rel_tol=1e-3, abs_tol=1e-6), r.page_id
        assert r.rejected == (not letters or posterior < 0.5)
