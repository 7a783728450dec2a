"""The registered queries over whole tables, against SQL or brute force."""

import collections
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from harness import compare
from tablesense.llm import pii, queries, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, data):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def ids_of(texts):
    whole = tokens.Encoder(tokens.vocabulary_path()).tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)
    return {k: e.ids for (k, _), e in zip(texts, whole)}


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert {int(re.match(r"op(\d+)", k)[1]) for k in queries.QUERIES if k != "pipeline"} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, duck, data):
    assert compare(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name]) is None


def exact_groups(sets, share=75):
    """Smallest reachable id by links of all pairs that share a shingle."""
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = collections.defaultdict(list)
    for k, s in sets.items():
        for h in s:
            by[h].append(k)
    shared = collections.Counter((a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark, data, texts):
    sets = {k: shingle_set(t) for k, t in texts}
    want = exact_groups(sets)
    got = queries.op2_near_dedup(spark, data).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(k, len(s), want[k], want[k] == k) for k, s in sorted(sets.items())]


def test_packing(spark, data, texts, ids_of):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op3_packing(spark, data).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, _ in texts:
        ids, at = np.array([*ids_of[k], 2], "<u4"), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for rows in sequences.values():
        fill = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == fill
            fill += r.length
        assert fill <= 4096
        total += fill
        padding += 0 if fill & (fill - 1) == 0 else 4096 - fill
    assert padding <= 0.01 * total


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "phone" and not 10 <= len(digits) <= 15) or (
                    kind == "card" and not (14 <= len(digits) <= 19 and doubled % 10 == 0)):
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_personal_data(spark, data, texts):
    got = {r.doc_id: r for r in queries.op4_personal_data(spark, data).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        want = base_spans(t)
        assert [s for s in pii.find_spans(t) if s[2] in BASE] == want
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(s[2] == x for s in want) for x in BASE)
        assert got[k].spans == ",".join(f"{x}:{a}:{b}" for a, b, x in pii.find_spans(t))


def test_token_files(spark, data, texts, ids_of):
    want, start = [], 0
    for k, _ in texts:
        ids = np.array([*ids_of[k], 1], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op5_token_files(spark, data).collect()) == want


def test_languages_of_pages(spark, data):
    rows = queries.op6_language(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count()
    assert sum(r.declared == r.language for r in rows) >= 0.98 * len(rows)
    assert not any(r.rejected for r in rows)


def test_toxicity_on_held_out_rows(spark, data):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    bad, fine = ([r.score for r in held if toxic[r.doc_id] == x] for x in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in fine]) >= 0.85
    assert np.mean([s >= 0.7 for s in fine]) <= 0.1


def test_pipeline(spark, data, texts):
    import corpus_pipeline as pipeline
    from tablesense.llm.common import documents, settle

    docs = documents(spark, data)
    columns = docs.columns
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, data), "stage")
        assert docs.columns == columns
        seen.append((name, {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()}))
    (_, all_in, identified), (_, _, lines), (_, near_in, near), (_, marked_in, clean) = seen
    assert {k for k in all_in if re.search("[A-Za-z]{3}", all_in[k])} <= identified.keys()
    assert lines.keys() == identified.keys() and any(lines[k] != identified[k] for k in lines)
    want = exact_groups({k: shingle_set(t) for k, t in near_in.items()})
    assert near.keys() == {k for k, c in want.items() if k == c}
    gone = marked_in.keys() - clean.keys()
    assert gone and all(clean[k] == marked_in[k] for k in clean)
    packed = pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == clean.keys()
