"""Stretch counts, order statistics and sliding ranks against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ordered as O
from tickloom.functions.wavelet import Wavelet, sliding_ranks


@pytest.mark.parametrize(("n", "m"), [(1, 1), (50, 3), (300, 1000)])
def test_counts_and_kth(n, m):
    r = np.random.default_rng(n)
    q = r.integers(0, m, n)
    w = Wavelet(q)
    lo = r.integers(0, n, 200)
    hi = np.minimum(n, lo + r.integers(1, n + 1, 200))
    v, k = r.integers(0, m + 5, 200), r.integers(0, hi - lo)
    below, ties = w.count(lo, hi, v)
    kth = w.kth(lo, hi, k)
    for i in range(200):
        part = q[lo[i] : hi[i]]
        assert (below[i], ties[i]) == ((part < v[i]).sum(), (part == v[i]).sum())
        assert kth[i] == np.sort(part)[k[i]]


def plain_ranks(x, n):
    out = []
    for i in range(len(x)):
        part = x[max(0, i - n + 1) : i + 1]
        known = int((~np.isnan(part)).sum())
        out.append((int((part < x[i]).sum()), int((part == x[i]).sum()), known) if x[i] == x[i] else (0, 0, known))
    return out


def test_sliding_ranks_with_ties_and_gaps():
    r = np.random.default_rng(2)
    x = r.normal(size=300).round(1)
    x[r.random(300) < 0.2] = np.nan
    for n in (1, 20, 500):
        assert list(zip(*[v.tolist() for v in sliding_ranks(x, n)], strict=True)) == plain_ranks(x, n)
    assert [v.tolist() for v in sliding_ranks(np.full(3, np.nan), 2)] == [[0] * 3] * 3


def test_ranks_across_chunks(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(t), float(v) if v == v else None) for k, n in (("hot", 700), ("b", 40), ("c", 1)) for t, v in enumerate(
        np.where(r.random(n) < 0.1, np.nan, r.normal(size=n).round(1)))]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    s = O.Ordered(("k",), ("t",), span=7)
    cols = {"a": (F.col("x"), 30), "b": (-F.col("x"), 5)}
    for d in (O.sliding_ranks(df, s, cols, chunk_rows=50), O.sliding_ranks(df, O.WEEKLY.by("k").__class__(("k",), ("t",), step=7), cols)):
        got = d.orderBy("k", "t").collect()
        assert len(got) == len(rows)
        for k in ("hot", "b", "c"):
            x = np.array([np.nan if v is None else v for kk, _, v in rows if kk == k])
            mine = [g for g in got if g["k"] == k]
            assert [tuple(g["a"]) for g in mine] == plain_ranks(x, 30)
            assert [tuple(g["b"]) for g in mine] == plain_ranks(-x, 5)


def test_scans_hold_no_loop_over_rows():
    """A long cell is composed in passes over whole arrays."""
    import time

    n = 400_000
    r = np.random.default_rng(1)
    a, b = r.uniform(0, 1, n), r.normal(size=n)
    start = time.perf_counter()
    q, p = O.compose_affine(a, b)
    O.compose_maps(r.integers(0, 4, (n, 4)))
    O._ewm_cell(np.where(r.random(n) < 0.1, np.nan, b), 0.9)
    assert time.perf_counter() - start < 10
    y = 0.0
    for i in range(2000):
        y = a[i] * y + b[i]
        assert abs(p[i] - y) < 1e-9 * (1 + abs(y))
    assert q[0] == a[0]
