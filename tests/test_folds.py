"""Models from running sums against numpy on copied folds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.ordered import WEEKLY, Ordered
from tickloom.operators import folds as FO
from tickloom.plans import folds as plans
from tickloom.sources.tables import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weekly(spark):
    p = plans.panel(Tables(spark, SF)).cache()
    pdf = p.toPandas().sort_values(["datetime", "symbol"]).reset_index(drop=True)
    pdf["i"] = pdf["datetime"].rank(method="dense").astype(int) - 1
    return p, pdf


def numpy_folds(pdf, offset=0):
    n, k = pdf["i"].max() + 1, 0
    while offset + k * 26 + 182 <= n:
        a = offset + k * 26
        yield k, pdf[(pdf.i >= a) & (pdf.i < a + 156)], pdf[(pdf.i >= a + 156) & (pdf.i < a + 182)]
        k += 1


def numpy_predictions(train, test, xs):
    m, s = train[xs].mean(), train[xs].std()
    z = np.column_stack([np.ones(len(train)), (train[xs] - m) / s])
    beta = np.linalg.lstsq(z, train["y"].to_numpy(), rcond=None)[0]
    return np.column_stack([np.ones(len(test)), (test[xs] - m) / s]) @ beta


def test_predictions_of_overlapping_folds_and_offsets(weekly):
    p, pdf = weekly
    sums, folds = plans.fold_sums(p, offsets=(0, 7, 14, 21))
    got = sums.predictions(folds, "y", ("offset", "fold")).select("offset", "fold", "datetime", "symbol", "pred").toPandas()
    for off in (0, 7, 14, 21):
        for k, train, test in numpy_folds(pdf, off):
            mine = got[(got.offset == off) & (got.fold == k)].sort_values(["datetime", "symbol"])
            np.testing.assert_allclose(mine.pred, numpy_predictions(train, test, ["x1", "x2", "x3"]), atol=1e-8)
    assert len(got) == sum(len(t) for off in (0, 7, 14, 21) for _, _, t in numpy_folds(pdf, off))


def test_feature_subsets(weekly):
    p, pdf = weekly
    sums, folds = plans.fold_sums(p)
    sets = FO.feature_subsets(["x1", "x2", "x3"], 2)
    got = sums.predictions(folds, "y", subsets=sets).select("subset", "fold", "datetime", "symbol", "pred").toPandas()
    for name, xs in sets.items():
        for k, train, test in numpy_folds(pdf):
            mine = got[(got.subset == name) & (got.fold == k)].sort_values(["datetime", "symbol"])
            np.testing.assert_allclose(mine.pred, numpy_predictions(train, test, xs), atol=1e-8)


def test_logistic_model_is_stationary(weekly, spark):
    _, pdf = weekly
    got = plans.fold_logistic_model(Tables(spark, SF)).toPandas()
    total = 0
    for k, train, test in numpy_folds(pdf):
        xs = ["x1", "x2", "x3"]
        m, s = train[xs].mean(), train[xs].std()
        z = np.column_stack([np.ones(len(train)), (train[xs] - m) / s])
        won, b, ridge = (train.y > 0).to_numpy(float), np.zeros(4), np.diag([0, 0.01, 0.01, 0.01])
        for _ in range(4000):  # plain gradient steps
            prob = 1 / (1 + np.exp(-z @ b))
            b -= 1.5 * (z.T @ (prob - won) / len(won) + ridge @ b)
        want = 1 / (1 + np.exp(-np.column_stack([np.ones(len(test)), (test[xs] - m) / s]) @ b))
        mine = got[got.fold == k].sort_values(["datetime", "symbol"])
        np.testing.assert_allclose(mine.prob, want, atol=2e-6)
        total += len(mine)
    assert total == len(got)



def test_running_sums_have_one_row_per_timestamp(weekly):
    p, _ = weekly
    sums, folds = plans.fold_sums(p)
    assert sums.sums.count() == p.select("datetime").distinct().count()
    plan = sums.models(folds, "y")._jdf.queryExecution().sparkPlan().toString()
    assert "InMemoryTableScan" not in plan  # the rows were read when the sums were made


def test_constant_features_and_short_folds(spark):
    rows = spark.createDataFrame([("a", i, float(i % 5), 3.0, float(i)) for i in range(40)], "symbol string, t long, u double, c double, y double")
    sums = FO.FoldSums(rows, Ordered(("symbol",), ("t",)), ["u", "c"], ["y"])
    folds = FO.bar_folds(sums.bars, 10, 5)
    m = {r["fold"]: r for r in sums.models(folds, "y").collect()}
    assert len(m) == 6 and all(r["scales"][1] == 1.0 and r["weights"][1] == 0.0 for r in m.values())
    one = rows.where("t >= 5 and t < 15").agg(F.regr_slope("y", "u"), F.stddev_samp("u")).first()
    assert m[1]["weights"][0] == pytest.approx(one[0] * one[1])
    assert m[0]["means"] == pytest.approx([2.0, 3.0])


def test_walk_forward_backtest_values(weekly, spark):
    """Net metrics of one offset by a plain loop over bars."""
    p, pdf = weekly
    got = {r["offset"]: r for r in plans.walk_forward_backtest(Tables(spark, SF)).collect()}
    parts = []
    for _, train, test in numpy_folds(pdf, 7):
        parts.append(test.assign(pred=numpy_predictions(train, test, ["x1", "x2", "x3"])))
    import pandas as pd

    d, last, nets = pd.concat(parts), {}, []
    for _, bar in d.groupby("datetime", sort=True):
        bar = bar.sort_values(["pred", "symbol"])
        k = max(1, int(len(bar) * 0.2))
        w = pd.Series(0.0, index=bar.symbol)
        w.iloc[-k:] = 0.5 / k
        w.iloc[:k] = -0.5 / k
        w = w.clip(-0.25, 0.25)
        turnover = sum(abs(w[x] - last.get(x, 0.0)) for x in w.index)
        last.update(w.to_dict())
        nets.append(float((w.to_numpy() * bar.fwd_return_1.to_numpy()).sum() + np.log(1 - 0.0005 * turnover)))
    r = got[7]
    assert r["total_log_return_net"] == pytest.approx(sum(nets), abs=2e-6)
    assert r["sharpe_net"] == pytest.approx(np.mean(nets) / np.std(nets, ddof=1) * np.sqrt(52), abs=2e-5)
    assert r["lo"] < np.mean(nets) < r["hi"]
