"""Operators without a SQL twin, against hand-made values and numpy."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ordered as O
from tickloom.functions import special
from tickloom.operators import align, folds, inference, pnl, regime, spreads, vol, xs
from tickloom.sources import ingest

W = O.Ordered(("symbol",), ("date",), step=1)


def panel(spark, n=300, seed=1, names=("a", "b")):
    rng = np.random.default_rng(seed)
    out = []
    for s in names:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        out.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "date": pd.date_range("2020-01-01", periods=n).date,
                    "close": c,
                    "high": c * (1 + rng.random(n) * 0.02),
                    "low": c * (1 - rng.random(n) * 0.02),
                }
            )
        )
    pdf = pd.concat(out, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def test_kline_files_with_and_without_header(spark, tmp_path):
    row = "1577836800000,1,2,0.5,1.5,10,1577840399999,15,7,4,6,0\n"
    head = "open_time,open,high,low,close,volume,close_time,qv,count,tb,tbq,ignore\n"
    (tmp_path / "a.csv").write_text(head + row)
    (tmp_path / "b.csv").write_text(row.replace("1577836800000", "1577840400000"))
    d = ingest.read_klines(spark, str(tmp_path)).orderBy("datetime").collect()
    assert [r.datetime for r in d] == [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 1)]
    assert d[0]["count"] == 7 and d[0].taker_buy_volume == 4.0


def test_trades_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,10.0,2.0,20.0,1577836800123,true\n2,11.0,1.0,11.0,1577923200000,false\n")
    t = ingest.read_trades(spark, str(tmp_path / "t.csv")).withColumn("symbol", F.lit("X"))
    ingest.write_trades(t, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("date = '2020-01-02'").count() == 1 and back.count() == 2


def test_funding_json(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"symbol":"X","fundingTime":1577836800000,"fundingRate":"0.0001"}\n' * 2)
    d = ingest.read_funding(spark, str(tmp_path)).collect()
    assert len(d) == 1 and d[0].funding_rate == 0.0001


def test_lines_that_do_not_fit_are_kept_with_a_reason(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "id,price,qty,quoteQty,time,isBuyerMaker\n1,10.0,2.0,20.0,1577836800123,true\n2,oops,2.0,20.0,1577836800124,true\n"
        "3,1.0,2.0\n4,,2.0,20.0,1577836800125,false\nid,price,qty,quoteQty,time,isBuyerMaker\n"
    )
    judged = ingest.judged_trades(spark, str(tmp_path))
    assert [r.id for r in ingest.good(judged).collect()] == [1]
    refused = sorted((r.line, r.reason, r.file.rsplit("/", 1)[-1]) for r in ingest.rejects(judged).collect())
    assert refused == [
        ("2,oops,2.0,20.0,1577836800124,true", "does not fit the schema", "t.csv"),
        ("3,1.0,2.0", "has fields: 3", "t.csv"),
        ("4,,2.0,20.0,1577836800125,false", "no price", "t.csv"),
    ]
    (tmp_path / "f.json").write_text('{"symbol":"X","fundingTime":1,"fundingRate":"0.1"}\n{"symbol":"X"\n{"symbol":"Y","fundingTime":2,"fundingRate":"x"}\n')
    judged = ingest.judged_funding(spark, str(tmp_path / "f.json"))
    assert sorted(r.reason for r in ingest.rejects(judged).collect()) == ["does not fit the schema", "no number in fundingRate"]


def test_pruned_scan_opens_only_the_days_asked_for(spark, tmp_path):
    rows = [(i, 1.0 * i, 1.0, dt.datetime(2020, 1, 1 + i % 3), "AB"[i % 2]) for i in range(12)]
    trades = spark.createDataFrame(rows, "id long, price double, qty double, datetime timestamp, symbol string")
    ingest.write_trades(trades, str(tmp_path / "s"))
    d = ingest.scan_trades(spark, str(tmp_path / "s"), "2020-01-02", "2020-01-03", ["A"])
    assert {(r.symbol, r.datetime.day) for r in d.collect()} == {("A", 2), ("A", 3)} and d.count() == 4
    plan = d._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan and "DataFilters: []" in plan


def test_holdout_guard(spark):
    df, _ = panel(spark, 5)
    with pytest.raises(ingest.HoldoutError):
        ingest.universe_panel(df, 2, "2020-01-01", "2021-01-01", holdout="2020-06-01")


def test_asof_counts_an_equal_stamp_and_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", dt.date(2020, 1, d)) for d in (1, 3, 5)], "k string, date date")
    right = spark.createDataFrame(
        [("a", dt.date(2020, 1, 3), 1.0), ("a", dt.date(2020, 1, 4), 2.0)], "k string, date date, v double"
    )
    d = align.asof_join(left, right, ["k"], "date", ["v"], span=2).orderBy("date").collect()
    assert [r.v for r in d] == [None, 1.0, 2.0]


def test_publication_lag_skips_weekends(spark):
    target = spark.createDataFrame([(dt.date(2020, 1, d),) for d in range(3, 10)], "date date")
    src = spark.createDataFrame([(dt.date(2020, 1, 3), 1.0)], "date date, v double")  # a Friday
    d = align.align_to_target(target, src, "v", 1, 2).orderBy("date").collect()
    assert [r.v for r in d] == [None, None, None, 1.0, 1.0, 1.0, None]


def test_directional_movement_matches_pandas(spark):
    df, pdf = panel(spark)
    got = regime.dmi(df, W).toPandas().sort_values(["symbol", "date"])
    for s, g in pdf.groupby("symbol"):
        up, down = g.high.diff(), -g.low.diff()
        p = up.where((up > down) & (up > 0), 0.0)
        m = down.where((down > up) & (down > 0), 0.0)
        pc = g.close.shift()
        tr = pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)
        e = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        pdi, mdi = 100 * e(p) / e(tr), 100 * e(m) / e(tr)
        adx = e(100 * (pdi - mdi).abs() / (pdi + mdi))
        np.testing.assert_allclose(got[got.symbol == s].adx.to_numpy(float), adx.to_numpy(), rtol=1e-9)


def loop_labels(score, bands, margin, dwell):
    inst = lambda v: next(b.label for b in bands if (b.lower is None or v >= b.lower) and (b.upper is None or v < b.upper))
    by = {b.label: b for b in bands}
    cur = pend = None
    k, out = 0, []
    for v in score:
        if v is None or math.isnan(v):
            out.append(None)
            continue
        now = inst(v)
        if cur is None:
            cur = now
        else:
            b = by[cur]
            lo = -math.inf if b.lower is None else b.lower - margin
            hi = math.inf if b.upper is None else b.upper + margin
            if now == cur or lo <= v < hi:
                pend, k = None, 0
            else:
                k = k + 1 if now == pend else 1
                pend = now
                if k >= dwell:
                    cur, pend, k = now, None, 0
        out.append(cur)
    return out


@pytest.mark.parametrize("step", [1, None])
def test_hysteresis_against_a_loop(spark, step):
    rng = np.random.default_rng(5)
    x = np.clip(np.cumsum(rng.normal(0, 0.15, 400)) % 2 - 1, -1, 1)
    x[rng.random(400) < 0.1] = np.nan
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("2020-01-01", periods=400).date, "score": x})
    df = spark.createDataFrame(pdf).withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    s = O.Ordered(("symbol",), ("date",), span=30, step=step)
    got = regime.hysteresis_labels(df, s, "score", regime.VOLATILITY.bands, 0.1, 3, "label")
    got = got.toPandas().sort_values("date").label
    want = loop_labels(x, regime.VOLATILITY.bands, 0.1, 3)
    assert [g if isinstance(g, str) else None for g in got] == want


def test_markov_power(spark):
    labels = list("aababbabbbaabab")
    df = spark.createDataFrame(
        [("s", dt.date(2020, 1, i + 1), v) for i, v in enumerate(labels)], "symbol string, date date, label string"
    )
    got = regime.markov_forecast(df, W, "label", ["a", "b"], 3, 2).orderBy("date").collect()[-1]
    c = np.zeros((2, 2))
    for u, v in zip(labels, labels[1:], strict=False):
        c["ab".index(u), "ab".index(v)] += 1
    p = np.linalg.matrix_power(c / c.sum(axis=1, keepdims=True), 3)
    np.testing.assert_allclose([got.p_a, got.p_b], p["ab".index(labels[-1])])


def test_special_functions(spark):
    d = spark.createDataFrame([(0.0, 2.0), (1.96, 3.0), (3.841459, 1.0)], "x double, k double")
    r = d.select(special.norm_cdf(F.col("x")).alias("n"), special.chi2_sf(F.col("x"), F.col("k")).alias("c")).collect()
    assert r[0].n == 0.5 and abs(r[1].n - 0.9750021) < 1e-6
    assert abs(r[2].c - 0.05) < 1e-6 and abs(r[1].c - 0.580750) < 1e-5


def test_deflated_sharpe_falls_with_trials(spark):
    df, _ = panel(spark)
    d = O.rolling(df, W, lambda w: {"r": F.log(F.col("close") / F.lag("close").over(w)) + 0.002}, 1)
    one = inference.deflated_sharpe(d, "r", "symbol", 1).select("symbol", "prob").toPandas()
    many = inference.deflated_sharpe(d, "r", "symbol", 100).select("symbol", "prob").toPandas()
    assert (many.set_index("symbol").prob < one.set_index("symbol").prob).all()


def test_normal_crps_matches_integral(spark):
    d = spark.createDataFrame([(0.7,)], "x double")
    got = d.select(vol.normal_crps(F.col("x"), F.lit(0.1), F.lit(1.3)).alias("c")).first().c
    g = np.linspace(-15, 15, 300001)
    cdf = np.array([0.5 * math.erfc(-(v - 0.1) / 1.3 / math.sqrt(2)) for v in g[::50]])
    want = np.trapezoid((cdf - (g[::50] >= 0.7)) ** 2, g[::50])
    assert abs(got - want) < 1e-3


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    df, _ = panel(spark)
    d = O.rolling(df, W, lambda w: {"r": F.log(F.col("close") / F.lag("close").over(w))}, 1)
    a = inference.block_bootstrap_ci(d, W, "r", 200, 5, 1).orderBy("symbol").collect()
    b = inference.block_bootstrap_ci(d, W, "r", 200, 5, 1).orderBy("symbol").collect()
    assert a == b
    m = {r.symbol: r.m for r in d.groupBy("symbol").agg(F.avg("r").alias("m")).collect()}
    assert all(r.lo < m[r.symbol] < r.hi for r in a)


def test_adf_separates_noise_from_a_walk(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=400)
    pdf = pd.DataFrame(
        {
            "spread": ["noise"] * 400 + ["walk"] * 400,
            "date": list(pd.date_range("2020-01-01", periods=400).date) * 2,
            "value": np.concatenate([e, np.cumsum(e)]),
        }
    )
    r = spreads.adf(spark.createDataFrame(pdf), spreads.SPREAD, "value", 4).toPandas().set_index("spread")
    assert r.loc["noise", "stationary_1pct"] and not r.loc["walk", "stationary_5pct"]
    n = pdf[pdf.spread == "walk"].value.to_numpy()
    p = int(r.loc["walk", "n_lags"])
    y, v = np.diff(n), n[:-1]
    x = np.column_stack([np.ones(len(y) - p), v[p:], *[y[p - i : len(y) - i] for i in range(1, p + 1)]])
    coef, *_ = np.linalg.lstsq(x, y[p:], rcond=None)
    res = y[p:] - x @ coef
    se = math.sqrt(res @ res / (len(res) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert abs(coef[1] / se - r.loc["walk", "t_stat"]) < 1e-6


def test_linear_fold_model_matches_lstsq(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ np.array([2.0, -1.0]) + rng.normal(0, 0.1, 200)
    pdf = pd.DataFrame({"fold": 0, "side": ["train"] * 150 + ["test"] * 50, "a": x[:, 0], "b": x[:, 1], "y": y})
    m = folds.solve_linear(spark.createDataFrame(pdf), ["a", "b"], "y").first()
    c, *_ = np.linalg.lstsq(np.column_stack([np.ones(150), x[:150]]), y[:150], rcond=None)
    np.testing.assert_allclose([m.bias, *m.weights], c, rtol=1e-8)


def test_band_zero_equals_plain_weights(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{i}", dt.datetime(2020, 1, 1) + dt.timedelta(days=7 * j), float(rng.normal())) for i in range(10) for j in range(12)]
    df = spark.createDataFrame(rows, "symbol string, datetime timestamp, pred double")
    a = xs.dollar_neutral_weights(df, "pred").toPandas().sort_values(["datetime", "symbol"])
    b = xs.banded_weights(df, "pred", 0.0).toPandas().sort_values(["datetime", "symbol"])
    np.testing.assert_allclose(a.weight.to_numpy(), b.weight.to_numpy())
    assert abs(a.groupby("datetime").weight.sum()).max() < 1e-12


def test_costs_by_hand(spark):
    rows = [("a", dt.date(2020, 1, i + 1), p, 0.0) for i, p in enumerate([0.0, 1.0, 1.0, -1.0])]
    df = spark.createDataFrame(rows, "symbol string, date date, position double, trade_log_return double")
    d = pnl.add_trading_costs(df, W, 0.001, 0.0).orderBy("date").collect()
    assert [r.turnover for r in d] == [0.0, 1.0, 0.0, 2.0]
    assert d[0].cost_log_return == 0.0 and abs(d[3].cost_log_return - math.log(0.998)) < 1e-15


def test_log_har_and_mixture_run(spark):
    df, _ = panel(spark)
    d = O.rolling(df, W, lambda w: {"r": F.log(F.col("close") / F.lag("close").over(w))}, 1)
    d = d.withColumn("rv", F.col("r") * F.col("r"))
    h = vol.log_har_forecast(d, W, "rv", 20, 60, 60)
    assert h.where("fc_log_har > 0").count() > 100
    table, rows = vol.mixture(d, "r", 2)
    t = table.orderBy("component").collect()
    assert t[0].variance <= t[1].variance and abs(sum(x.weight for x in t) - 1) < 1e-6
    assert rows.where("abs(p_0 + p_1 - 1) > 1e-9").count() == 0
