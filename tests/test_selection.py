"""Selection by counting against sorted arrays: ties, extremes, hot keys."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import selection


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    made = {
        "normal": r.normal(size=3000),
        "heavy": r.standard_cauchy(500) * 1e6,
        "ties": np.where(r.random(2000) < 0.8, 7.0, r.normal(size=2000)),
        "span": np.concatenate([10.0 ** r.uniform(-300, 300, 60), -(10.0 ** r.uniform(-300, 300, 60))]),
        "flat": np.full(40, -2.5),
        "one": np.array([3.0]),
    }
    rows = [(k, float(v)) for k, x in made.items() for v in x] + [("normal", None), ("none", None), ("normal", float("nan"))]
    return spark.createDataFrame(rows, "k string, y double"), {k: np.sort(x) for k, x in made.items()}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.97, 1.0])
def test_ranks(data, share):
    df, made = data
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)))
    got = {r["k"]: r for r in selection.select_rank(df, ["k"], "y", rank, {"half": F.col("n") / 2}).collect()}
    assert got.keys() == made.keys()
    for k, x in made.items():
        r = got[k]
        want = x[max(1, int(np.ceil(len(x) * share))) - 1]
        assert r["value"] == want and r["n"] == len(x) and r["half"] == len(x) / 2
        assert r["below"] == (x < want).sum() and r["below"] < r["rank"]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_largest_and_smallest(data, k):
    df, made = data
    for order in (-1, 1):
        got = selection.largest(df, ["k"], "y", k, order).collect()
        for name, x in made.items():
            mine = sorted((r["rank"], r["y"]) for r in got if r["k"] == name)
            want = (x[::-1] if order < 0 else x)[:k]
            assert [v for _, v in mine] == want.tolist() and [i for i, _ in mine] == list(range(1, len(want) + 1))


def test_without_keys_and_without_rows(spark, data):
    df, _ = data
    all_y = np.sort([r["y"] for r in df.where("y is not null and not isnan(y)").collect()])
    assert selection.select_rank(df, [], "y", F.lit(100)).first()["value"] == all_y[99]
    assert [r["y"] for r in selection.largest(df, [], "y", 3).orderBy("rank").collect()] == all_y[::-1][:3].tolist()
    assert selection.select_rank(df.where("k = 'none'"), ["k"], "y", F.lit(1)).collect() == []
    assert selection.largest(df.where("k = 'none'"), ["k"], "y", 2).collect() == []
