"""Tiled pair operators and the unit-root test against numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tickloom.functions.ordered import Ordered
from tickloom.operators import pairs, spreads


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(11)
    base = r.normal(size=(90, 3))
    x = base @ r.normal(size=(3, 23)) + 0.7 * r.normal(size=(90, 23))
    x[:, 5] = 2.5  # flat
    x[r.random(x.shape) < 0.06] = np.nan
    rows = [(f"n{k:02d}", t, float(x[t, k])) for t in range(90) for k in range(23) if x[t, k] == x[t, k]]
    return spark.createDataFrame(rows, "symbol string, t long, v double"), x


def test_moments_and_correlations(panel):
    df, x = panel
    got = pairs.pair_moments(df, "symbol", "t", "v", block=4, span=16).withColumn("rho", pairs.pair_correlation()).collect()
    assert len(got) == 23 * 22 // 2
    for r in got:
        a, b = (x[:, int(r[c][1:])] for c in "ab")
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r["n"] == both.sum() and r["sxy"] == pytest.approx((a * b)[both].sum())
        if "n05" in (r["a"], r["b"]):
            assert r["rho"] is None
        else:
            assert r["rho"] == pytest.approx(np.corrcoef(a[both], b[both])[0, 1])


def test_rolling_correlation_across_tiles(panel):
    df, x = panel
    got = pairs.rolling_correlation(df, "symbol", "t", "v", 7, 0.6, block=5, span=13).collect()
    found = {(r["t"], *sorted((r["a"], r["b"]))): r["rho"] for r in got}
    assert len(found) == len(got)
    want = {}
    for t in range(6, 90):
        w = x[t - 6 : t + 1]
        for i in range(23):
            for j in range(i + 1, 23):
                if not np.isnan(w[:, [i, j]]).any() and min(w[:, i].std(), w[:, j].std()) >= 1e-12:
                    rho = np.corrcoef(w[:, i], w[:, j])[0, 1]
                    if abs(rho) >= 0.6:
                        want[(t, f"n{i:02d}", f"n{j:02d}")] = rho
    assert found.keys() == want.keys()
    assert max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_joint_tails(panel):
    df, x = panel
    got = {(r["a"], r["b"]): (r["n"], r["hits"]) for r in pairs.joint_below(df, "symbol", "t", "v", -0.5, block=4, span=50).collect()}
    for i in range(23):
        for j in range(23):
            low = (x[:, i] <= -0.5) & ~np.isnan(x[:, j])
            if i != j and low.any():
                assert got.pop((f"n{i:02d}", f"n{j:02d}")) == (low.sum(), (low & (x[:, j] <= -0.5)).sum())
    assert not got


def plain_adf(x, top=None):
    n = len(x)
    cap = top if top is not None else min(20, math.floor(12 * (n / 100) ** 0.25))
    y, v = np.diff(x), x[:-1]

    def fit(p, start):
        rows = np.arange(start, n - 1)
        z = np.column_stack([np.ones(len(rows)), v[rows] - v.mean(), *[y[rows - i] for i in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(z, y[rows], rcond=None)
        rss = ((y[rows] - z @ beta) ** 2).sum()
        se = math.sqrt(rss / (len(rows) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
        return beta[1] / se, beta[1], len(rows), len(rows) * math.log(rss / len(rows)) + z.shape[1] * math.log(len(rows))

    best = min(range(cap + 1), key=lambda p: (fit(p, cap)[3], p))
    return (*fit(best, best)[:3], best)


@pytest.mark.parametrize("top", [None, 0, 3])
def test_unit_root_of_several_lengths(spark, top):
    r = np.random.default_rng(5)
    data = {}
    for k, (n, phi) in {"a": (400, 0.9), "b": (61, 0.5), "c": (33, 1.0), "d": (900, 0.99)}.items():
        e, z = r.normal(size=n), np.zeros(n)
        for i in range(2, n):
            z[i] = phi * z[i - 1] + 0.4 * (z[i - 1] - z[i - 2]) + e[i]
        data[k] = z + 50
    pdf = pd.concat([pd.DataFrame({"spread": k, "t": np.arange(len(z)), "x": z}) for k, z in data.items()])
    s = Ordered(("spread",), ("t",), span=97)
    got = {r["spread"]: r for r in spreads.adf(spark.createDataFrame(pdf), s, "x", top).collect()}
    for k, z in data.items():
        t, b, n_obs, p = plain_adf(z, top)
        assert (got[k]["n_lags"], got[k]["n_obs"]) == (p, n_obs)
        assert got[k]["t_stat"] == pytest.approx(t, rel=1e-7) and got[k]["b"] == pytest.approx(b, rel=1e-7)
