"""The cell-wise paths against plain pandas, with one key holding most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ordered as O

S = O.Ordered(("k",), ("t",), span=7)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    parts = []
    for key, n in (("hot", 400), ("b", 60), ("c", 5)):
        t = np.sort(rng.choice(np.arange(1000), n, replace=False))
        x = rng.normal(size=n).round(3)
        x[rng.random(n) < 0.2] = np.nan
        parts.append(pd.DataFrame({"k": key, "t": t, "x": x, "f": rng.random(n) < 0.1}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df.withColumn("t", F.col("t").cast("long")).cache(), pdf


def got(df, *cols):
    p = df.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    return [p[c].to_numpy(float) for c in cols]


def want(pdf, fn):
    p = pdf.sort_values(["k", "t"])
    return np.concatenate([np.asarray(fn(g), float) for _, g in p.groupby("k")])


def same(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_rolling_halo(data):
    df, pdf = data

    def stage(w):
        f = w.rowsBetween(-9, 0)
        return {"m": F.avg("x").over(f), "nx": F.lead("t", 3).over(w), "pv": F.lag("t", 9).over(w)}

    d = O.rolling(df, S, stage, back=9, ahead=3, chunk_rows=16)
    m, nx, pv = got(d, "m", "nx", "pv")
    same(m, want(pdf, lambda g: g.x.rolling(10, min_periods=1).mean()))
    same(nx, want(pdf, lambda g: g.t.shift(-3)))
    same(pv, want(pdf, lambda g: g.t.shift(9)))
    assert d.count() == len(pdf)


def test_running(data):
    df, pdf = data
    d = O.running(
        df, S, {"s": ("sum", F.col("x")), "l": ("last", F.col("x")), "m": ("max", F.col("x"))}
    )
    s, last, m = got(d, "s", "l", "m")
    same(np.nan_to_num(s), want(pdf, lambda g: g.x.fillna(0).cumsum()))
    same(last, want(pdf, lambda g: g.x.ffill()))
    same(m, want(pdf, lambda g: g.x.cummax().ffill()))


def test_running_with_reset(data):
    df, pdf = data
    d = O.running(df, S, {"n": ("sum", F.lit(1)), "m": ("min", F.col("x"))}, reset=F.col("f"))

    def runs(g):
        return g.groupby(g.f.cumsum()).cumcount() + 1

    n, m = got(d, "n", "m")
    same(n, want(pdf, runs))
    same(m, want(pdf, lambda g: g.groupby(g.f.cumsum()).x.transform(lambda v: v.cummin().ffill())))


def test_equity(data):
    df, pdf = data
    d = O.equity(df.na.fill(0.0, ["x"]), S, {"x": ("e", "dd")})
    e, dd = got(d, "e", "dd")
    same(e, want(pdf, lambda g: g.x.fillna(0).cumsum()))
    same(dd, want(pdf, lambda g: g.x.fillna(0).cumsum() - g.x.fillna(0).cumsum().cummax()))


@pytest.mark.parametrize("min_obs", [1, 5])
def test_ewm_with_gaps(data, min_obs):
    df, pdf = data
    (y,) = got(O.ewm(df, S, F.col("x"), 0.3, "y", min_obs), "y")
    same(
        y, want(pdf, lambda g: g.x.ewm(alpha=0.3, adjust=False, min_periods=min_obs).mean())
    )


def test_affine(data):
    df, pdf = data
    d = O.row_index(df.na.fill(0.0, ["x"]), S, "i")
    a = F.when(F.col("i") == 1, 0.0).otherwise(0.9)
    (y,) = got(O.affine(d, S, a, F.col("x"), "y"), "y")

    def rec(g):
        v, out = 0.0, []
        for i, x in enumerate(g.x.fillna(0)):
            v = x if i == 0 else 0.9 * v + x
            out.append(v)
        return out

    same(y, want(pdf, rec))


def test_state_scan(data):
    df, pdf = data
    step = F.array(F.when(F.col("f"), 1).otherwise(0), F.when(F.col("x") > 1, 0).otherwise(1))
    (y,) = got(O.state_scan(df, S, step, "y"), "y")

    def rec(g):
        s, out = 0, []
        for f, x in zip(g.f, g.x, strict=True):
            s = (1 if f else 0) if s == 0 else (0 if x > 1 else 1)
            out.append(s)
        return out

    same(y, want(pdf, rec))


def test_ranks_and_quantiles(data):
    df, pdf = data
    d = df.withColumn("x", F.floor(F.col("x") * 10) / 10 + F.lit(0.0))
    p = pdf.assign(x=np.floor(pdf.x * 10) / 10 + 0.0)
    (r,) = got(O.average_rank(d, ["k"], "x", "r"), "r")
    same(r, want(p, lambda g: g.x.rank()))
    q = O.quantiles(d, ["k"], "x", {"a": 0.1, "b": 0.5}).toPandas().set_index("k")
    for k, g in p.groupby("k"):
        same(q.loc[k, ["a", "b"]].to_numpy(float), g.x.quantile([0.1, 0.5]).to_numpy())
    n = O.row_numbers(df.na.drop(), ["k"], "x", ["t"], "rn", "n").toPandas()
    for _, g in n.groupby("k"):
        assert sorted(g.rn) == list(range(1, len(g) + 1)) and (g.n == len(g)).all()


def test_short_series_take_plain_windows(data, spark):
    assert O.WEEKLY.short and O.DAILY.short and not O.BARS.short
    df, pdf = data
    week = O.Ordered(("k",), ("t",), step=7)
    d = O.running(df, week, {"n": ("sum", F.lit(1))}, reset=F.col("f"))
    same(got(d, "n")[0], want(pdf, lambda g: g.groupby(g.f.cumsum()).cumcount() + 1))
