from __future__ import annotations

import zlib

import numpy as np

from tickloom.llm import nbsvm

SF = "/root/testdata/sf0.01"


def test_dual_descent_against_gradient():
    """The dual solution reaches the primal optimum that subgradient steps approach."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    ratio, each, c = rng.normal(size=12), np.array([1 / np.sqrt(len(r)) for r in rows]), np.full(40, 0.7)
    x = np.zeros((40, 12))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] * each[i]
    loss = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    w = nbsvm.dual_descent(rows, y, ratio, each, c, 3000, 1)
    v, best = np.zeros(12), np.inf
    for t in range(1, 20000):
        v = v - (v - ((c * y * (y * (x @ v) < 1))[:, None] * x).sum(0)) / t
        best = min(best, loss(v))
    assert loss(w) <= best + 2e-3


def test_features_by_hand():
    seen = np.zeros(nbsvm.FIELDS, bool)
    whole = nbsvm.features(b"ab cd", seen)
    assert not seen.any() and 0 in whole
    assert set(nbsvm.features(b"", seen)) == {0} == set(nbsvm.features(None, seen))
    a, b = nbsvm.features(b"xx  one two", seen), nbsvm.features(b"one two yy", seen)
    assert len(set(a) & set(b)) > 8  # a word and a pair have the same slots at any place
    assert 1 in nbsvm.features(b"a a b", seen) and 2 not in nbsvm.features(b"a a b a", seen)
    assert 3 in nbsvm.features(b"go go go go go", seen)
    for s in (whole, np.arange(0, nbsvm.FIELDS, 3)):
        assert np.array_equal(nbsvm.unpacked(nbsvm.packed(s)), s)
    assert len(nbsvm.packed(np.arange(nbsvm.FIELDS))) == nbsvm.PACKED


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in nbsvm.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    test = [k for k in truth if got[k].held_out]
    assert np.mean([got[k].predicted == truth[k] for k in test]) >= 0.95
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality")
    other = {r.doc_id: r.score for r in nbsvm.classify(docs, flipped).collect()}
    assert all(abs(other[k] - got[k].score) < 1e-12 for k in got)  # held-out labels do not matter


def test_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (8, 0), (1, 0), (6, 1), (6, 1)], "doc_id long, quality int")
    out = nbsvm.classify(odd, labels).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4)}) == 1
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.classify(odd, nobody).collect()} == {0.5}
    assert nbsvm.classify(none, labels).count() == 0
    assert nbsvm.accepted(odd, labels).columns == odd.columns
