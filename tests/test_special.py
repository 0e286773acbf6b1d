"""Tail expressions against the standard library, without Python in the plan."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions import special
from tickloom.operators import inference


def column(spark, values, fn):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], "i int, x double")
    out = df.select("i", fn(F.col("x")).alias("y"))
    assert "Python" not in out._jdf.queryExecution().toString()
    return [r["y"] for r in out.orderBy("i").collect()]


def test_erfc_and_cdf(spark):
    x = np.concatenate([np.linspace(-30, 30, 6001), [0.0, 0.46875, -0.46875, 4.0, 4.0000001, 26.5, 1e-300]])
    got = column(spark, x, special.erfc)
    for a, b in zip(got, x, strict=True):
        want = math.erfc(b)
        assert abs(a - want) < 1e-14 * (1 + want)
        if want > 1e-280:
            assert abs(a / want - 1) < 1e-12
    got = column(spark, x, special.norm_cdf)
    assert max(abs(a - 0.5 * math.erfc(-b / math.sqrt(2))) for a, b in zip(got, x, strict=True)) < 1e-14


def test_quantile(spark):
    p = np.concatenate([np.linspace(0.0005, 0.9995, 1999), 10.0 ** -np.arange(1, 300, 7), 1 - 10.0 ** -np.arange(1, 15)])
    got = column(spark, p, special.norm_ppf)
    nd = NormalDist()
    assert max(abs(a - nd.inv_cdf(b)) / max(1, abs(a)) for a, b in zip(got, p, strict=True)) < 1e-13
    assert column(spark, [0.0, 1.0, -1.0, 2.0, None, float("nan")], special.norm_ppf) == [None] * 6


def test_chi_square_tail(spark):
    x = [0.0, 1e-9, 0.1, 1.0, 3.84, 10.0, 55.5, 300.0]
    for k in (1, 2, 3, 4, 7, 10, 31):
        got = column(spark, x, lambda c, k=k: special.chi2_sf(c, F.lit(float(k))))
        for a, v in zip(got, x, strict=True):
            grid = np.linspace(0, 1, 200_001)[1:] if v else None  # density integrated up to v, u = v g^2
            if v and v < 60:
                u = v * grid**2
                log_density = (k / 2 - 1) * np.log(u) - u / 2 - k / 2 * math.log(2) - math.lgamma(k / 2)
                y = np.exp(log_density) * 2 * v * grid
                y0 = math.exp(-math.lgamma(0.5) - 0.5 * math.log(2)) * 2 * math.sqrt(v) if k == 1 else 0.0
                below = np.trapezoid(np.concatenate([[y0], y]), np.concatenate([[0.0], grid]))
                assert abs(a - (1 - below)) < 1e-8
            assert v or a == 1.0
    assert column(spark, [-1.0, None, float("nan")], lambda c: special.chi2_sf(c, F.lit(2.0))) == [None] * 3
    assert abs(column(spark, [3.841458820694124], lambda c: special.chi2_sf(c, F.lit(1.0)))[0] - 0.05) < 1e-14
    assert abs(column(spark, [16.918977604620448], lambda c: special.chi2_sf(c, F.lit(9.0)))[0] - 0.05) < 1e-14


def test_two_sided(spark):
    assert abs(column(spark, [-1.959963984540054], special.two_sided)[0] - 0.05) < 1e-14
    assert inference.two_sided is special.two_sided


def test_log_gamma(spark):
    x = [1.0, 1.5, 2.0, 3.0, 10.0, 171.5, 1e4, 1e9, 1e15]
    got = column(spark, [*x, 0.5, None], special.log_gamma)
    assert got[-2:] == [None, None]
    for a, v in zip(got, x, strict=False):
        assert abs(a - math.lgamma(v)) < 1e-12 * (1 + abs(math.lgamma(v)))
