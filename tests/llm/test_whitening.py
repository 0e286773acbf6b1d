"""Whitening against a dense eigensolver and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tickloom.llm import queries, whitening
from tickloom.llm.whitening import Spectrum, add_row, combine, rank_one, secular_roots

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, part int, d string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, 2, "d", "c") for i, v in rows], SCHEMA)


def plain(vectors: list[list[float]], top: int = 8):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (y @ q)[:, :top], e[:top], e / e.sum()


def compare(rows, vectors):
    n, deviation, scores, e, share = plain(vectors)
    k = scores.shape[1]
    real = [j for j in range(k) if e[j] > 1e-10 * e.sum()]
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
    assert len(rows) == n * k
    signs = [0] * k
    for i in range(n):
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        for j, r in enumerate(mine):
            assert r["n"] == n and r["deviation"] == deviation[i]
            assert r["identity_error"] is None and not real or r["identity_error"] < 1e-8
            assert r["explained"] == pytest.approx(share[j], rel=1e-6, abs=1e-12)
            if j in real:
                want = scores[i, j] / math.sqrt(e[j])
                signs[j] = signs[j] or (math.copysign(1, want * r["whitened"]) if abs(want) > 1e-3 else 0)
                assert abs(r["whitened"] - (signs[j] or 1) * want) < 1e-6 * (1 + abs(want)) or not signs[j]
            else:
                assert r["whitened"] is None


def test_query_against_dense_solver(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_incremental_whitening"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = {r["vec_id"]: i for i, r in enumerate(table)}
    compare([r for r in _renumbered(rows, ids)], [r["embedding"] for r in table])


def _renumbered(rows, ids):
    return [{**r.asDict(), "vec_id": ids[r["vec_id"]]} for r in rows]


def test_odd_rows(spark):
    r = np.random.default_rng(2)
    good = [[float(np.float32(v)) for v in row] for row in r.normal(size=(90, 5))]
    good += [good[0]] * 40  # repeated rows
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1.0, 2.0], [1e30] * 5]
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(bad)]
    got = whitening.whiten(frame(spark, rows).repartition(7), fan=2).collect()
    compare([x.asDict() for x in got], good)


@pytest.mark.parametrize("vectors", [[[0.5, 0.25]], [[0.1, 0.2, 0.3]] * 9, [[float(i), 2.0 * i, 0.0] for i in range(20)]])
def test_components_without_variance(spark, vectors):
    got = whitening.whiten(frame(spark, list(enumerate(vectors)))).collect()
    n, deviation, scores, e, _ = plain(vectors)
    assert len(got) == n * len(e)
    for r in got:
        flat = e[r["component"] - 1] <= 1e-10 * e.sum()
        assert (r["whitened"] is None) == bool(flat) and r["deviation"] == deviation[r["vec_id"]]
        assert (r["explained"] is None) == (e.sum() == 0)


def test_nothing_remains(spark):
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(frame(spark, [(0, [1e12, 0.0]), (1, [-1e12, 0.0]), (2, [0.0, 1.0])])).collect()
    assert {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


def test_secular_roots_interlace_and_match():
    r = np.random.default_rng(4)
    for k in (1, 2, 3, 17, 64):
        poles = np.sort(r.uniform(-5, 5, k))
        z = r.normal(size=k) * 10.0 ** r.uniform(-6, 0, k)
        origin, x = secular_roots(poles, z, 2.5)
        got = poles[origin] + x
        assert (got >= poles).all() and (got[:-1] <= poles[1:]).all()
        np.testing.assert_allclose(np.sort(got), np.linalg.eigvalsh(np.diag(poles) + 2.5 * np.outer(z, z)), atol=1e-13 * 20)


def test_rank_one_updates_with_deflation():
    r = np.random.default_rng(5)
    values, basis, dense = np.zeros(9), np.eye(9), np.zeros((9, 9))
    for step in range(60):
        v = r.normal(size=9) if step % 3 else np.eye(9)[step % 9] * 4
        rho = float(10.0 ** r.uniform(-4, 2))
        values, basis = rank_one(values, basis, v, rho)
        dense += rho * np.outer(v, v)
        assert np.abs(basis @ np.diag(values) @ basis.T - dense).max() < 1e-13 * np.abs(dense).max() * 10
        assert np.abs(basis.T @ basis - np.eye(9)).max() < 1e-13 and (np.diff(values) >= 0).all()


def test_combined_spectra_equal_the_whole():
    x = np.random.default_rng(6).normal(size=(150, 12)) @ np.diag(np.logspace(-4, 2, 12))
    parts = []
    for a in range(0, 150, 37):
        s = Spectrum.empty(12)
        for y in x[a : a + 37]:
            s = add_row(s, y)
        parts.append(s)
    whole = Spectrum.empty(12)
    for s in parts:
        whole = combine(whole, s)
    c = x - x.mean(0)
    assert whole.n == 150
    np.testing.assert_allclose(whole.mean, x.mean(0), atol=1e-12)
    np.testing.assert_allclose(whole.basis @ np.diag(whole.values) @ whole.basis.T, c.T @ c, atol=1e-10 * np.abs(c.T @ c).max())
