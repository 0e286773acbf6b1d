"""Scores and labels of whole configurations against a loop in pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tickloom.functions.ordered import WEEKLY, Ordered
from tickloom.operators import regime
from tickloom.plans import regime as plans
from tickloom.sources.tables import Tables

SF = "/root/testdata/sf0.01"


def scaled(ind, x: pd.Series) -> np.ndarray:
    if ind.scaling == "zscore":
        sd = x.rolling(ind.window).std()
        y = np.tanh((x - x.rolling(ind.window).mean()) / sd.where(sd != 0) / ind.scale)
    elif ind.scaling == "percentile":
        full = x.rolling(ind.window, min_periods=ind.window)
        y = 2 * full.apply(lambda w: np.mean(w <= w[-1]), raw=True) - 1
    elif ind.scaling == "linear":
        y = ((x - ind.center) / ind.half_range).clip(-1, 1)
    else:
        y = x.clip(-1, 1)
    return (y * ind.direction).to_numpy(float)


def scores(dim, g: pd.DataFrame) -> np.ndarray:
    parts = [(i.weight, scaled(i, g[i.name].astype(float))) for i in dim.indicators]
    have = sum(w * ~np.isnan(v) for w, v in parts)
    total = sum(w * np.nan_to_num(v) for w, v in parts)
    ok = have >= dim.coverage * sum(w for w, _ in parts)
    raw = np.where(ok, total / np.where(have > 0, have, 1), np.nan)
    return pd.Series(raw).ewm(alpha=2 / (dim.span + 1), adjust=False, ignore_na=False).mean().to_numpy()


def labels(dim, score: np.ndarray) -> list[str | None]:
    out, current, pending, count = [], None, None, 0

    def holds(b, v, m=0.0):
        return (b.lower is None or v >= b.lower - m) and (b.upper is None or v < b.upper + m)

    for v in score:
        if math.isnan(v):
            out.append(None)
            continue
        now = next(b for b in dim.bands if holds(b, v))
        if current is None:
            current = now
        elif now is current or holds(current, v, dim.margin):
            pending, count = None, 0
        else:
            count = count + 1 if now is pending else 1
            pending = now
            if count >= dim.dwell:
                current, pending, count = now, None, 0
        out.append(current.label)
    return out


def compare(df, s: Ordered, dims):
    t = s.order[0]
    pdf = df.toPandas().sort_values([*s.keys, t])
    got = regime.detect(df, s, dims).toPandas()
    dims = [d for d in dims if all(i.name in pdf.columns for i in d.indicators)]
    assert set(got["dimension"]) == {d.key for d in dims} and len(got) == len(pdf) * len(dims)
    known = changes = 0
    for key, g in pdf.groupby(list(s.keys)):
        for dim in dims:
            mine = got[got["dimension"] == dim.key]
            for k, v in zip(s.keys, key, strict=True):
                mine = mine[mine[k] == v]
            mine = mine.sort_values(t)
            want = scores(dim, g)
            np.testing.assert_allclose(mine["score"].to_numpy(float), want, atol=1e-9)
            # labels on the engine's own scores, so that a last digit at a band's edge decides nothing
            assert [x if isinstance(x, str) else None for x in mine["label"]] == labels(dim, mine["score"].to_numpy(float))
            known += int((~np.isnan(want)).sum())
            changes += int((mine["label"] != mine["label"].shift()).sum())
    assert known > len(pdf) / 10 and changes > 10


def test_price_dimensions(spark):
    t = Tables(spark, SF)
    d = regime.indicator_columns(plans.px(t), WEEKLY).where("symbol in ('NATION_1', 'NATION_2', 'NATION_3')").cache()
    compare(d, WEEKLY, regime.COMMODITY)
    compare(d, WEEKLY, regime.EQUITY)


def test_curve_dimensions(spark):
    from tickloom.operators import curves

    compare(plans.curve_indicators(Tables(spark, SF)).cache(), curves.PRODUCT, regime.COMMODITY)


def test_macro_dimensions(spark):
    d = plans.macro_indicators(Tables(spark, SF)).where("symbol in ('NATION_1', 'NATION_4')").cache()
    compare(d, plans.DWEEK, regime.MACRO)


@pytest.mark.parametrize("dwell", [1, 3])
def test_hysteresis_on_a_walk(spark, dwell):
    r = np.random.default_rng(dwell)
    dim = regime.Dimension("d", regime.three_bands("a", "b", "c", -0.3, 0.3), (), dwell=dwell)
    x = np.where(r.random(600) < 0.05, np.nan, np.clip(np.cumsum(r.normal(size=600)) / 8, -1, 1))
    df = spark.createDataFrame([(int(i), None if v != v else float(v)) for i, v in enumerate(x)], "t long, score double")
    s = Ordered((), ("t",), span=64)
    got = regime.hysteresis_labels(df, s, "score", dim.bands, dim.margin, dwell, "label").orderBy("t").collect()
    assert [g["label"] for g in got] == labels(dim, x)
