"""The pipeline against a plain version of each stage, on its own input."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tickloom.llm import nbsvm, queries
from tickloom.llm.common import stage

from .conftest import SF
from .test_simhash import groups, plain


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after each stage."""
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for _, fn in P.STAGES:
        out.append(stage(fn(spark, out[-1], SF)))
    return [d.collect() for d in out]


def test_names_and_columns(spark, steps):
    assert len(P.STAGES) == 5
    for rows in steps[:5]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality(spark, steps):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    good = {r.doc_id for r in nbsvm.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in steps[1]} == good
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean & good) >= 0.97 * len(clean)


def test_near_dedup(steps):
    comp = groups([(r.doc_id, plain(r.text)) for r in steps[1]])
    assert sorted(r.doc_id for r in steps[2]) == sorted(set(comp.values()))
    assert {(r.doc_id, r.text) for r in steps[2]} <= {(r.doc_id, r.text) for r in steps[1]}


def test_substring_dedup(steps):
    """No window of 60 words lies in two texts; texts without shared windows of 8 stay."""
    before, after = {r.doc_id: r for r in steps[2]}, {r.doc_id: r for r in steps[3]}
    assert set(before) == set(after)

    def windows(text, n):
        w = (text or "").split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    seen, owner = {}, {}
    for k in sorted(after):
        for x in windows(after[k].text, 60):
            assert len(set(x)) < 10 or seen.setdefault(x, k) == k
        for x in windows(before[k].text, 8):
            owner.setdefault(x, set()).add(k)
    for k, r in before.items():
        assert after[k].n_chars == len(after[k].text or "")
        w = windows(r.text, 8)
        if all(owner[x] == {k} for x in w) and len(w) == max(0, len((r.text or "").split()) - 7):
            assert after[k].text == r.text


def test_mixing(steps):
    before = {r.doc_id: r for r in steps[3]}
    times = {}
    for r in steps[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == before[r.doc_id].text
    assert max(times.values()) <= 3
    words = {k: len((r.text or "").encode().split()) for k, r in before.items()}
    total = sum(words[k] * n for k, n in times.items())
    assert abs(total - sum(words.values())) <= 0.1 * sum(words.values())


def test_packing(steps):
    tok = Tokenizer.from_file(queries.tokenizer())
    want = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in steps[4])
    assert sum(r.length for r in steps[5]) == want
    ends = {}
    for r in steps[5]:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert sum(n < 2048 for n in ends.values()) <= 1 and max(ends.values()) <= 2048


def test_run(spark, steps):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, steps[5]))
