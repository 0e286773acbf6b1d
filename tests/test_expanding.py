"""Expanding order statistics against pandas, one key holding most rows."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.expanding import expanding_quantile
from tickloom.functions.ordered import Ordered
from tickloom.operators import regime

S = Ordered(("k",), ("t",), span=5000)


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def series(kind, n, seed):
    r = np.random.default_rng(seed)
    x = {"noise": r.normal(size=n), "drift": np.arange(n) + r.normal(size=n), "fall": -np.arange(float(n)),
         "ties": r.integers(0, 4, n).astype(float), "hot": np.where(r.random(n) < 0.7, 1.5, r.normal(size=n))}[kind]
    x[r.random(n) < 0.1] = np.nan
    return x


def earlier(x, p, least):
    out, held = [], []
    for v in x:
        m = len(held)
        at = p * (m - 1)
        ok = m >= least
        out.append(held[int(np.floor(at))] + (held[int(np.ceil(at))] - held[int(np.floor(at))]) * (at - np.floor(at)) if ok else np.nan)
        if v == v:
            bisect.insort(held, v)
    return out


@pytest.mark.parametrize("p", [0.5, 0.1])
def test_small_buckets_against_insertion(spark, p):
    parts = [pd.DataFrame({"k": k, "t": np.arange(n), "x": series(k, n, i)}) for i, (k, n) in enumerate(
        [("noise", 900), ("drift", 400), ("fall", 300), ("ties", 500), ("hot", 600)])]
    pdf = pd.concat([*parts, pd.DataFrame({"k": "one", "t": [0], "x": [1.0]}), pd.DataFrame({"k": "none", "t": [0, 1], "x": [np.nan] * 2})])
    got = expanding_quantile(frame(spark, pdf), S, "x", "q", p, 3, chunk=64).toPandas().sort_values(["k", "t"])
    assert len(got) == len(pdf)
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got[got.k == k].q.to_numpy(float), earlier(g.x.to_numpy(), p, 3), atol=1e-12)


def test_two_hundred_thousand_rows_of_one_key(spark):
    n = 200_000
    x = np.cumsum(np.random.default_rng(1).normal(size=n)).round(2)
    pdf = pd.DataFrame({"k": "hot", "t": np.arange(n), "x": x})
    got = regime.expanding_median(frame(spark, pdf), S, "x", "m").toPandas().sort_values("t")
    want = earlier(x, 0.5, 60)
    np.testing.assert_allclose(got.m.to_numpy(float), want, atol=1e-12)
    assert np.isnan(want[59]) and want[60] == np.median(x[:60])


def test_without_keys_and_empty(spark):
    s = Ordered((), ("t",), span=50)
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "t long, x double")
    got = [r["q"] for r in expanding_quantile(df, s, "x", "q", 0.5, 5, chunk=32).orderBy("t").collect()]
    np.testing.assert_allclose(np.array(got, float), earlier(np.arange(200.0) % 7, 0.5, 5))
    assert expanding_quantile(df.where("t < 0"), s, "x", "q").count() == 0
