"""Regime indicators, scores, labels, forecasts and their evaluation
(inventory 2.L and 2.M)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expanding import expanding_quantile
from ..functions.exprs import (
    clip,
    log_return,
    ratio,
    roll,
    roll_mean,
    roll_std,
    roll_sum,
    zscore,
)
from ..functions.ordered import (
    Ordered,
    ewm,
    ewms,
    quantiles,
    rolling,
    row_index,
    running,
    sliding_ranks,
    state_scan,
)
from ..session import materialize
from .align import carry_fair_value
from .curves import runs

YEAR = math.sqrt(252.0)
# Storage per month and financing rate.
STORAGE, FINANCING = 0.45, 0.05


# ---- indicators ------------------------------------------------------------


def percentile_rank(rank: Column | str, least: int = 60) -> Column:
    """Share of the trailing values that are at most the current one, from its
    ``sliding_ranks``."""
    r = F.col(rank) if isinstance(rank, str) else rank
    share = (r["below"] + r["ties"]) / r["known"]
    return F.when((r["ties"] > 0) & (r["known"] >= least), share)


def price_moves(w) -> dict[str, Column]:
    """Log return, change, true range and directional moves of a bar."""
    prev = F.lag("close").over(w)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    tr = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return {
        "_r": log_return(w),
        "_d": F.col("close") - prev,
        "_prev": prev,
        "_tr": tr,
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    }


def atr(df: DataFrame, s: Ordered, n: int = 14, out: str = "atr") -> DataFrame:
    """Wilder-smoothed true range."""
    d = rolling(df, s, lambda w: {"_tr": price_moves(w)["_tr"]}, back=1)
    return ewm(d, s, F.col("_tr"), 1.0 / n, out, n).drop("_tr")


def dmi(df: DataFrame, s: Ordered, n: int = 14) -> DataFrame:
    """plus_di, minus_di and adx."""
    d = rolling(
        df, s, lambda w: {k: price_moves(w)[k] for k in ("_tr", "_pdm", "_mdm")}, back=1
    )
    d = ewms(d, s, {f"{c}_s": (F.col(c), 1.0 / n, n) for c in ("_tr", "_pdm", "_mdm")})
    d = d.withColumns(
        {"plus_di": 100 * ratio("_pdm_s", "_tr_s"), "minus_di": 100 * ratio("_mdm_s", "_tr_s")}
    )
    dx = 100 * ratio(
        F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")
    )
    d = ewm(d.withColumn("_dx", dx), s, F.col("_dx"), 1.0 / n, "adx", n)
    return d.select(*df.columns, "plus_di", "minus_di", "adx")


def efficiency_ratio(w, n: int = 20) -> Column:
    """|change over n| / sum of |changes|, from the column _d."""
    move = F.abs(F.col("close") - F.lag("close", n).over(w))
    return clip(ratio(move, roll_sum(F.abs("_d"), w, n)), 0.0, 1.0)


def rolling_autocorr(w, lagged: str, n: int) -> Column:
    f = w.rowsBetween(-(n - 1), 0)
    ok = F.count(F.when(F.col("_r").isNotNull() & F.col(lagged).isNotNull(), 1)).over(f) == n
    return F.when(ok, F.corr("_r", lagged).over(f))


def half_life(w, n: int = 252) -> Column:
    """-ln 2 / b of the change on the level over the last n rows, b < 0."""
    f = w.rowsBetween(-(n - 2), 0)
    b = F.when(F.count("_prev").over(f) == n - 1, F.regr_slope("_d", "_prev").over(f))
    return F.when(b < 0, -math.log(2.0) / b)


def indicator_columns(df: DataFrame, s: Ordered, adx: bool = True) -> DataFrame:
    """All price indicators at their default windows, as columns named
    <dimension>_<indicator>."""
    d = rolling(df, s, price_moves, back=1)
    if adx:
        wilder = {"_tr_s": "_tr", "_p_s": "_pdm", "_m_s": "_mdm"}
        d = ewms(d, s, {out: (F.col(c), 1.0 / 14, 14) for out, c in wilder.items()})
        pdi, mdi = 100 * ratio("_p_s", "_tr_s"), 100 * ratio("_m_s", "_tr_s")
        d = d.withColumns({"_sgn": F.signum(pdi - mdi), "_dx": 100 * ratio(F.abs(pdi - mdi), pdi + mdi)})
        d = ewm(d, s, F.col("_dx"), 1.0 / 14, "_adx", 14)
        d = d.withColumn("trend_adx", F.col("_adx") * F.col("_sgn"))
        d = d.withColumn("_atr_rel", ratio("_tr_s", "close"))

    def first(w):
        sma = {n: roll_mean("close", w, n) for n in (20, 50, 100, 200)}
        return {
            "_sma100": sma[100],
            "trend_price_vs_ma": ratio(F.col("close") - sma[200], sma[200]),
            "trend_nday_log_return": log_return(w, "close", 60),
            "trend_efficiency": efficiency_ratio(w) * F.signum(F.col("close") - F.lag("close", 20).over(w)),
            "trend_ma_separation": ratio(sma[50] - sma[200], sma[200]),
            "_rv20": roll_std("_r", w, 20) * YEAR,
            "_bb": 4 * ratio(roll_std("close", w, 20), sma[20]),
            "_q5": roll_sum("_r", w, 5),
            "_v1": roll(F.var_samp, "_r", w, 252),
            "_rl": F.lag("_r").over(w),
            "mr_half_life": half_life(w),
            "_z60": ratio(
                F.col("close") - roll_mean("close", w, 60, 30), roll_std("close", w, 60, 30)
            ),
        }

    def second(w):
        vr = ratio(roll(F.var_samp, "_q5", w, 252), 5 * F.col("_v1"))
        slope = ratio(F.col("_sma100") - F.lag("_sma100", 20).over(w), 20 * F.col("_sma100"))
        return {
            "trend_ma_slope": slope,
            "trend_variance_ratio": vr - 1,
            "vol_of_vol": roll_std("_rv20", w, 60),
            "mr_autocorr": -rolling_autocorr(w, "_rl", 60),
            "mr_variance_ratio": 1 - vr,
            "mr_zscore_extremity": F.abs(F.lag("_z60").over(w)),
        }

    d = rolling(d, s, [first, second], back=520)
    ranked = {"vol_realized_percentile": "_rv20", "vol_bollinger_percentile": "_bb"}
    if adx:
        ranked["vol_atr_percentile"] = "_atr_rel"
    d = sliding_ranks(d, s, {name: (F.col(c), 252) for name, c in ranked.items()})
    d = d.withColumns({name: 2 * percentile_rank(name) - 1 for name in ranked})
    return d.select(*[c for c in d.columns if not c.startswith("_")])


def curve_indicators(w) -> dict[str, Column]:
    """Term-structure and carry indicators from close_f1..3, dte_f1..2, close."""
    gap = F.nullif(F.col("dte_f2") - F.col("dte_f1"), F.lit(0))
    ann = (ratio("close_f1", "close_f2") - 1) * F.try_divide(F.lit(365.0), gap)
    spread = F.col("close_f1") - F.col("close_f2")
    return {
        "ts_curve_slope": -ratio(F.col("close_f3") - F.col("close_f1"), "close_f1"),
        "ts_calendar_spread_z": zscore(spread, w, 252),
        "ts_ann_roll_yield": ann,
        "ts_roll_yield": ratio(spread, "close_f2"),
        "ts_excess_spread": spread - carry_fair_value(F.col("close_f2"), STORAGE, F.lit(FINANCING)),
        "carry_ann_roll_yield": ann,
        "carry_vol_scaled": ratio(ann, roll_std("_r", w, 20) * YEAR),
    }


def macro_indicators(df: DataFrame, macro: DataFrame, s: Ordered, cols: Mapping[str, str],
                     deltas: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Macro columns on the bar calendar, null when absent, and differences."""
    d = df.join(macro, "date", "left")
    made = {out: F.col(c) for out, c in cols.items()}

    def stage(w):
        return {out: F.col(c) - F.lag(c, n).over(w) for out, (c, n) in deltas.items()}

    d = d.withColumns(made)
    back = max((n for _, n in deltas.values()), default=0)
    return rolling(d, s, stage, back=back)


def filled_level(df: DataFrame, s: Ordered, c: str, n: int = 252, out: str = "vol_vix_level"):
    """A macro column carried forward, as 2 * percentile rank - 1."""
    d = running(df, s, {"_fill": ("last", F.col(c))})
    d = sliding_ranks(d, s, {out: (F.col("_fill"), n)})
    return d.withColumn(out, 2 * percentile_rank(out) - 1).drop("_fill")


# ---- scores and labels -------------------------------------------------------


@dataclass(frozen=True)
class Band:
    label: str
    lower: float | None
    upper: float | None


@dataclass(frozen=True)
class Indicator:
    name: str
    weight: float
    scaling: str = "zscore"
    window: int = 252
    scale: float = 2.0
    center: float = 0.0
    half_range: float = 1.0
    direction: float = 1.0


@dataclass(frozen=True)
class Dimension:
    key: str
    bands: tuple[Band, ...]
    indicators: tuple[Indicator, ...]
    margin: float = 0.1
    dwell: int = 5
    span: int = 5
    coverage: float = 0.5
    extra: dict = field(default_factory=dict)


def three_bands(low: str, mid: str, high: str, a: float, b: float) -> tuple[Band, ...]:
    return (Band(low, None, a), Band(mid, a, b), Band(high, b, None))


# Indicator weights, scalings and label bands of each asset class.
TREND_INDICATORS = (
    Indicator("trend_price_vs_ma", 0.25),
    Indicator("trend_ma_slope", 0.20),
    Indicator("trend_nday_log_return", 0.20),
    Indicator("trend_adx", 0.20, "linear", half_range=50.0),
    Indicator("trend_efficiency", 0.15, "raw"),
)
TREND = Dimension("trend", three_bands("bear", "sideways", "bull", -0.3, 0.3), TREND_INDICATORS)
EQUITY_TREND = Dimension("trend", three_bands("bear", "sideways", "bull", -0.25, 0.3), TREND_INDICATORS)


def volatility_bands(high: float) -> tuple[Band, ...]:
    return (
        Band("low", None, -0.5),
        Band("normal", -0.5, high),
        Band("high", high, 0.75),
        Band("extreme", 0.75, None),
    )


VOLATILITY = Dimension(
    "volatility",
    volatility_bands(0.3),
    (
        Indicator("vol_atr_percentile", 0.4, "raw"),
        Indicator("vol_realized_percentile", 0.4, "raw"),
        Indicator("vol_of_vol", 0.2, "percentile"),
    ),
)
EQUITY_VOLATILITY = Dimension(
    "volatility",
    volatility_bands(0.2),
    (
        Indicator("vol_atr_percentile", 0.30, "raw"),
        Indicator("vol_realized_percentile", 0.30, "raw"),
        Indicator("vol_of_vol", 0.15, "percentile"),
        Indicator("vol_vix_level", 0.25, "raw"),
    ),
)
REVERSION_BANDS = three_bands("trending", "neutral", "mean_reverting", -0.2, 0.2)
MEAN_REVERSION = Dimension(
    "mean_reversion",
    REVERSION_BANDS,
    (
        Indicator("mr_autocorr", 0.35),
        Indicator("mr_variance_ratio", 0.35),
        Indicator("mr_half_life", 0.30, "linear", center=16.5, half_range=30.0, direction=-1.0),
    ),
)
EQUITY_REVERSION = Dimension(
    "mean_reversion", REVERSION_BANDS, (Indicator("mr_autocorr", 0.5), Indicator("mr_variance_ratio", 0.5))
)
TERM_STRUCTURE = Dimension(
    "term_structure",
    three_bands("contango", "flat", "backwardation", -0.15, 0.15),
    (
        Indicator("ts_curve_slope", 0.30, "linear", half_range=0.10),
        Indicator("ts_calendar_spread_z", 0.20, "raw"),
        Indicator("ts_ann_roll_yield", 0.30, "linear", half_range=0.25),
        Indicator("ts_excess_spread", 0.20),
    ),
)
CARRY = Dimension(
    "carry",
    three_bands("negative", "neutral", "positive", -0.2, 0.2),
    (
        Indicator("carry_ann_roll_yield", 0.60, "linear", half_range=0.25),
        Indicator("carry_vol_scaled", 0.40, "linear", half_range=1.0),
    ),
)
RISK = Dimension(
    "risk",
    three_bands("risk_off", "neutral", "risk_on", -0.3, 0.3),
    (
        Indicator("macro_vix", 0.25, "percentile", direction=-1.0),
        Indicator("macro_hy_oas", 0.15, direction=-1.0),
        Indicator("macro_hy_oas_delta", 0.15, direction=-1.0),
        Indicator("macro_yield_curve", 0.25, "linear", center=1.5, half_range=4.0),
        Indicator("macro_fed_funds_delta", 0.10, direction=-1.0),
        Indicator("macro_cot_noncomm", 0.10),
    ),
)
YIELD_CURVE = Dimension(
    "yield_curve",
    three_bands("inverted", "flat", "steep", -0.25, 0.25),
    (
        Indicator("macro_yield_curve", 0.50, "linear", half_range=2.0),
        Indicator("macro_yield_curve_3m10y", 0.50, "linear", half_range=2.0),
    ),
)
CREDIT = Dimension(
    "credit",
    three_bands("wide", "neutral", "tight", -0.3, 0.3),
    (Indicator("macro_hy_oas", 0.50, direction=-1.0), Indicator("macro_ig_oas", 0.50, direction=-1.0)),
)
COMMODITY = (TREND, VOLATILITY, MEAN_REVERSION, TERM_STRUCTURE, CARRY)
EQUITY = (EQUITY_TREND, EQUITY_VOLATILITY, EQUITY_REVERSION)
FX = (TREND, VOLATILITY, MEAN_REVERSION)
MACRO = (RISK, YIELD_CURVE, CREDIT)
CONFIGURATIONS = {"commodity": COMMODITY, "equity": EQUITY, "fx": FX, "macro": MACRO}


def squash(z: Column, scale: float = 2.0) -> Column:
    return F.tanh(z / scale)


def linear_score(x: Column, center: float, half_range: float) -> Column:
    return clip((x - center) / half_range, -1.0, 1.0)


def scaled(ind: Indicator, w) -> Column:
    """The indicator's score in [-1, 1], direction applied; a percentile reads the
    sliding rank ``_rank_<name>``."""
    x = F.col(ind.name)
    if ind.scaling == "zscore":
        y = squash(zscore(x, w, ind.window), ind.scale)
    elif ind.scaling == "percentile":
        y = 2 * percentile_rank(f"_rank_{ind.name}", ind.window) - 1
    elif ind.scaling == "linear":
        y = linear_score(x, ind.center, ind.half_range)
    else:
        y = clip(x, -1.0, 1.0)
    return y * ind.direction


def combine(parts: Mapping[str, Column], weights: Mapping[str, float], coverage: float) -> Column:
    """Weighted mean over the known parts, null under the coverage."""
    zero = F.lit(0.0)
    have, total = zero, zero
    for n, c in parts.items():
        have = have + F.when(c.isNotNull(), weights[n]).otherwise(0.0)
        total = total + F.coalesce(c * weights[n], zero)
    return F.when(have >= coverage * sum(weights.values()), F.try_divide(total, have))


def smooth(df: DataFrame, s: Ordered, c: str, span: int, out: str) -> DataFrame:
    """Recursive EMA; a null score repeats the last value."""
    return ewm(df, s, F.col(c), 2.0 / (span + 1.0), out)


def band_index(x: Column, bands: Sequence[Band]) -> Column:
    """1-based band of a value; bands are half-open and exhaustive."""
    out = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bands, 1))):
        inside = x.isNotNull()
        if b.lower is not None:
            inside = inside & (x >= b.lower)
        if b.upper is not None:
            inside = inside & (x < b.upper)
        out = F.when(inside, i).otherwise(out)
    return out


def instant_label(x: Column, bands: Sequence[Band]) -> Column:
    name = F.element_at(F.array(*[F.lit(b.label) for b in bands]), band_index(x, bands))
    return F.when(x.isNotNull(), name)


def _outside(x: Column, b: Band, margin: float) -> Column:
    out = F.lit(False)
    if b.lower is not None:
        out = out | (x < b.lower - margin)
    if b.upper is not None:
        out = out | (x >= b.upper + margin)
    return out


def hysteresis_labels(
    df: DataFrame, s: Ordered, score: str, bands: Sequence[Band], margin: float, dwell: int, out: str
) -> DataFrame:
    """Labels that change only after ``dwell`` rows in a row lie in one new band
    and outside the current band widened by ``margin``. Null scores give null.

    A run that leaves a label can only start after the label was taken, so each
    row's move depends on the last ``dwell`` rows alone: state 0 is unlabelled,
    state i the i-th band.
    """
    known = df.where(F.col(score).isNotNull())
    x = F.col(score)
    cols = {"_b": band_index(x, bands)} | {
        f"_out{i}": _outside(x, b, margin).cast("int") for i, b in enumerate(bands, 1)
    }
    d = known.withColumns(cols)

    def step(w):
        f = w.rowsBetween(-(dwell - 1), 0)
        same = (F.count("_b").over(f) == dwell) & (F.min("_b").over(f) == F.max("_b").over(f))
        made = {"_step0": F.col("_b")}
        for i in range(1, len(bands) + 1):
            go = same & (F.min(f"_out{i}").over(f) == 1) & (F.col("_b") != i)
            made[f"_step{i}"] = F.when(go, F.col("_b")).otherwise(i)
        return made

    d = rolling(d, s, step, back=dwell)
    d = state_scan(d, s, F.array(*[F.col(f"_step{i}") for i in range(len(bands) + 1)]), "_state")
    name = F.element_at(F.array(*[F.lit(b.label) for b in bands]), F.col("_state"))
    done = d.select(*df.columns, name.alias(out))
    rest = df.where(F.col(score).isNull()).withColumn(out, F.lit(None).cast("string"))
    return done.unionByName(rest)


def contributions(df: DataFrame, s: Ordered, dims: Sequence[Dimension]) -> DataFrame:
    """Scaled indicators as columns sc_<name>, one window pass for all."""
    inds = {i.name: i for d in dims for i in d.indicators}
    back = max(i.window for i in inds.values())
    ranked = {f"_rank_{n}": (F.col(n), i.window) for n, i in inds.items() if i.scaling == "percentile"}
    d = sliding_ranks(df, s, ranked) if ranked else df
    d = rolling(d, s, lambda w: {f"sc_{n}": scaled(i, w) for n, i in inds.items()}, back=back)
    return d.drop(*ranked)


def detect(df: DataFrame, s: Ordered, dims: Sequence[Dimension] = COMMODITY, shift: int = 0) -> DataFrame:
    """Long (keys, time, dimension, score, label). ``df`` carries the indicator
    columns; a dimension whose indicators are absent is skipped. ``shift`` moves scores
    and labels that many rows later."""
    dims = [d for d in dims if all(i.name in df.columns for i in d.indicators)]
    c = contributions(df, s, dims)
    cells = []
    for dim in dims:
        parts = {i.name: F.col(f"sc_{i.name}") for i in dim.indicators}
        raw = combine(parts, {i.name: i.weight for i in dim.indicators}, dim.coverage)
        cells.append(F.struct(F.lit(dim.key).alias("dimension"), raw.alias("_raw")))
    long = c.select(*s.keys, *s.order, F.explode(F.array(*cells)).alias("_c"))
    long = materialize(long.select(*s.keys, *s.order, "_c.*"))
    by = s.by(*s.keys, "dimension")
    out = None
    for dim in dims:
        d = smooth(long.where(F.col("dimension") == dim.key), by, "_raw", dim.span, "score")
        d = hysteresis_labels(d.drop("_raw"), by, "score", dim.bands, dim.margin, dim.dwell, "label")
        out = d if out is None else out.unionByName(d)
    if out is not None and shift:
        moved = lambda w: {f"_{c}": F.lag(c, shift).over(w) for c in ("score", "label")}
        out = rolling(out, by, moved, back=shift)
        out = out.withColumns({"score": F.col("_score"), "label": F.col("_label")}).drop("_score", "_label")
    return out


def composite_label(labels: DataFrame, keys: Sequence[str], dims: Sequence[str], sep: str = "|"):
    """Labels of all dimensions in one text, null when one is missing."""
    wide = labels.groupBy(*keys).agg(
        *[F.max(F.when(F.col("dimension") == d, F.col("label"))).alias(f"_{d}") for d in dims]
    )
    parts = []
    for i, d in enumerate(dims):
        parts += ([F.lit(sep)] if i else []) + [F.col(f"_{d}")]
    return wide.select(*keys, F.concat(*parts).alias("composite"))


def latest(labels: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    d = labels.where(F.col("label").isNotNull())
    return d.groupBy(*keys).agg(
        F.max_by("label", time).alias("label"), F.max_by("score", time).alias("score"),
        F.max(time).alias("as_of"),
    )


def aggregate_scores(
    scores: DataFrame, members: DataFrame, by: Sequence[str], coverage: float = 0.5,
    method: str = "mean", value: str = "score",
) -> DataFrame:
    """Basket score: weighted mean renormalized over the present symbols, or the
    median; null under the coverage. ``members``: basket, symbol, weight."""
    d = scores.join(members, "symbol")
    size = members.groupBy("basket").agg(
        F.sum("weight").alias("_w"), F.count(F.lit(1)).cast("double").alias("_n")
    )
    known = F.col(value).isNotNull()
    g = d.groupBy("basket", *by).agg(
        F.sum(F.when(known, F.col("weight"))).alias("_have"),
        F.sum(F.col("weight") * F.col(value)).alias("_sum"),
        F.count(value).alias("_cnt"),
    ).join(size, "basket")
    if method == "median":
        q = quantiles(d, ["basket", *by], value, {"_med": 0.5})
        g = g.join(q, ["basket", *by], "left")
        score = F.when(F.col("_cnt") / F.col("_n") >= coverage, F.col("_med"))
    else:
        score = F.when(F.col("_have") / F.col("_w") >= coverage, ratio("_sum", "_have"))
    return g.select("basket", *by, score.alias(value))


# ---- transitions and forecasts ----------------------------------------------


def spell_statistics(df: DataFrame, s: Ordered, label: str) -> DataFrame:
    r = materialize(runs(df, s, label))
    q = quantiles(r, [*s.keys, "state"], "length", {"median": 0.5})
    g = r.groupBy(*s.keys, "state").agg(
        F.count(F.lit(1)).alias("n_spells"), F.avg("length").alias("mean"), F.max("length").alias("max")
    )
    return g.join(q, [*s.keys, "state"])


def occupancy(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    d = df.where(F.col(label).isNotNull())
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    g = d.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n")).join(n, list(keys))
    return g.select(*keys, label, ratio("_n", "_t").alias("share"))


def remaining_duration(matrix: DataFrame) -> DataFrame:
    """1 / (1 - p_ii) from the long transition table (src, dst, share)."""
    keys = [c for c in matrix.columns if c not in ("src", "dst", "n", "share")]
    d = matrix.groupBy(*keys, "src").agg(
        F.coalesce(F.max(F.when(F.col("src") == F.col("dst"), F.col("share"))), F.lit(0.0)).alias("_p")
    )
    return d.select(*keys, "src", F.try_divide(F.lit(1.0), 1 - F.col("_p")).alias("expected_remaining"))


def h_step(matrix: DataFrame, keys: Sequence[str], h: int) -> DataFrame:
    """h-step transition probabilities: matrix product as join and sum."""
    p = matrix.select(*keys, "src", "dst", "share")
    out = p
    for _ in range(h - 1):
        nxt = p.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("_d"), F.col("share").alias("_q"))
        out = out.join(nxt, [*keys, "dst"]).groupBy(*keys, "src", F.col("_d").alias("_to"))
        out = out.agg(F.sum(F.col("share") * F.col("_q")).alias("share")).withColumnRenamed("_to", "dst")
    return out.select(*keys, "src", "dst", "share")


def label_stability(df: DataFrame, s: Ordered, label: str) -> DataFrame:
    d = rolling(
        df.where(F.col(label).isNotNull()),
        s,
        lambda w: {"_f": (F.col(label) != F.lag(label).over(w)).cast("int")},
        back=1,
    )
    tot = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_t"))
    g = d.groupBy(*s.keys).agg(
        F.coalesce(F.sum("_f"), F.lit(0)).alias("_flips"), F.count(F.lit(1)).alias("_n")
    ).join(tot, list(s.keys))
    return g.select(
        *s.keys,
        (F.col("_flips") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("flip_rate"),
        (F.col("_n") / (F.col("_flips") + 1)).alias("avg_duration"),
        (F.col("_n") / F.col("_t")).alias("pct_time_labeled"),
    )


def quality_gate(stab: DataFrame, occ: DataFrame, keys: Sequence[str], max_share: float,
                 max_flip: float, min_cover: float) -> DataFrame:
    """Series that break an occupancy, flip-rate or coverage threshold."""
    top = occ.groupBy(*keys).agg(F.max("share").alias("max_share"))
    d = stab.join(top, list(keys))
    bad = (
        (F.col("max_share") > max_share)
        | (F.col("flip_rate") > max_flip)
        | (F.col("pct_time_labeled") < min_cover)
    )
    return d.withColumn("disqualified", bad)


def state_counts(df: DataFrame, s: Ordered, label: str, states: Sequence[str]) -> DataFrame:
    """Running counts of labels and of consecutive label pairs up to each row."""
    d = rolling(df, s, lambda w: {"_was": F.lag(label).over(w)}, back=1)
    cols = {"seen": ("sum", F.when(F.col(label).isNotNull(), 1).otherwise(0).cast("long"))}
    for i, a in enumerate(states):
        cols[f"n_{i}"] = ("sum", F.when(F.col(label) == a, 1).otherwise(0).cast("long"))
        for j, b in enumerate(states):
            hit = (F.col("_was") == a) & (F.col(label) == b)
            cols[f"c_{i}_{j}"] = ("sum", F.when(hit, 1).otherwise(0).cast("long"))
    return running(d, s, cols).drop("_was")


def markov_forecast(
    df: DataFrame, s: Ordered, label: str, states: Sequence[str], h: int = 1, least: int = 252
) -> DataFrame:
    """p_<state> at t + h from the transitions seen up to t."""
    k = len(states)
    d = state_counts(df, s, label, states)
    ok = (F.col("seen") >= least) & F.col(label).isin(list(states))
    if h == 1:
        out = []
        for j, st in enumerate(states):
            p = F.lit(None).cast("double")
            for i, a in enumerate(states):
                tot = F.lit(0)
                for m in range(k):
                    tot = tot + F.col(f"c_{i}_{m}")
                row = F.coalesce(ratio(F.col(f"c_{i}_{j}"), tot), F.lit(0.0))
                p = F.when(F.col(label) == a, row).otherwise(p)
            out.append(F.when(ok, p).alias(f"p_{st}"))
        return d.select(*df.columns, *out)
    names = [f"c_{i}_{j}" for i in range(k) for j in range(k)]
    keep = list(df.columns)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    schema = ", ".join([*fields, *[f"p_{st} double" for st in states]])
    order = list(states)

    def power(parts):
        for pdf in parts:
            c = pdf[names].to_numpy(float).reshape(-1, k, k)
            tot = c.sum(axis=2, keepdims=True)
            p = np.divide(c, tot, out=np.zeros_like(c), where=tot > 0)
            q = np.linalg.matrix_power(p, h) if len(p) else p
            at = pdf[label].map({x: i for i, x in enumerate(order)})
            good = (pdf["_ok"].fillna(False).astype(bool) & at.notna()).to_numpy()
            res = np.full((len(pdf), k), np.nan)
            rows = np.flatnonzero(good)
            res[rows] = q[rows, at.to_numpy()[rows].astype(int)]
            made = pd.DataFrame(res, columns=[f"p_{x}" for x in order], index=pdf.index)
            yield pd.concat([pdf[keep], made], axis=1)

    d = d.withColumn("_ok", ok).select(*keep, *names, "_ok").mapInPandas(power, schema)
    fix = {f"p_{x}": F.when(~F.isnan(f"p_{x}"), F.col(f"p_{x}")) for x in states}
    return d.withColumns(fix)


def prior_forecast(df: DataFrame, s: Ordered, label: str, states: Sequence[str], least: int = 252):
    """Class shares over the labels seen up to t."""
    d = state_counts(df, s, label, states)
    tot = F.lit(0)
    for i in range(len(states)):
        tot = tot + F.col(f"n_{i}")
    ok = (F.col("seen") >= least) & F.col(label).isNotNull()
    out = [F.when(ok, ratio(F.col(f"n_{i}"), tot)).alias(f"p_{st}") for i, st in enumerate(states)]
    return d.select(*df.columns, *out)


def blend(df: DataFrame, label: str, states: Sequence[str], alpha: float) -> DataFrame:
    """(1 - alpha) one-hot + alpha Markov, on columns p_<state>."""
    out = {
        f"b_{st}": (1 - alpha) * (F.col(label) == st).cast("double") + alpha * F.col(f"p_{st}")
        for st in states
    }
    return df.withColumns(out)


def argmax_state(states: Sequence[str], prefix: str = "p_") -> Column:
    best = F.greatest(*[F.col(f"{prefix}{st}") for st in states])
    out = F.lit(None).cast("string")
    for st in reversed(states):
        out = F.when(F.col(f"{prefix}{st}") == best, st).otherwise(out)
    return out


# ---- evaluation --------------------------------------------------------------


def hit_rate(df: DataFrame, keys: Sequence[str], pred: str, target: str) -> DataFrame:
    d = df.dropna(subset=[pred, target])
    return d.groupBy(*keys).agg(
        F.avg((F.col(pred) == F.col(target)).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion(df: DataFrame, keys: Sequence[str], pred: str, target: str) -> DataFrame:
    return df.dropna(subset=[pred, target]).groupBy(*keys, pred, target).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_stats(df: DataFrame, keys: Sequence[str], pred: str, target: str, states: Sequence[str]):
    """Precision, recall and support of each class."""
    d = df.dropna(subset=[pred, target])
    cells = F.explode(F.array(*[F.lit(x) for x in states])).alias("cls")
    d = d.select(*keys, pred, target, cells)
    p, t = F.col(pred) == F.col("cls"), F.col(target) == F.col("cls")
    g = d.groupBy(*keys, "cls").agg(
        F.count_if(p & t).alias("_tp"), F.count_if(p).alias("_p"), F.count_if(t).alias("support")
    )
    return g.select(
        *keys, "cls", ratio("_tp", "_p").alias("precision"), ratio("_tp", "support").alias("recall"), "support"
    )


def balanced_accuracy(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stats.where(F.col("support") > 0).groupBy(*keys).agg(
        F.avg("recall").alias("balanced_accuracy")
    )


def transition_recall(df: DataFrame, keys: Sequence[str], pred: str, target: str, current: str):
    d = df.dropna(subset=[pred, target, current]).where(F.col(target) != F.col(current))
    return d.groupBy(*keys).agg(
        F.avg((F.col(pred) == F.col(target)).cast("double")).alias("transition_recall"),
        F.count(F.lit(1)).alias("n_transitions"),
    )


def brier(df: DataFrame, keys: Sequence[str], states: Sequence[str], target: str, prefix: str = "p_"):
    d = df.where(F.col(target).isNotNull() & F.col(f"{prefix}{states[0]}").isNotNull())
    b = F.lit(0.0)
    for st in states:
        b = b + F.pow(F.col(f"{prefix}{st}") - (F.col(target) == st).cast("double"), 2)
    return d.groupBy(*keys).agg(F.avg(b).alias("brier"))


def subsampled_ic(df: DataFrame, s: Ordered, score: str, fwd: str, step: int) -> DataFrame:
    """Spearman on every step-th complete row, three or more."""
    from .inference import spearman

    d = row_index(df.dropna(subset=[score, fwd]), s, "_i")
    d = d.where((F.col("_i") - 1) % step == 0)
    return spearman(d, s.keys, score, fwd, 3)


def episode_lead_lag(labels: DataFrame, episodes: DataFrame, s: Ordered, lead_rows: int = 21):
    """Rows from the onset of an episode to the first expected label within
    [start - lead rows, end]. ``episodes``: keys, name, start, end, expected.

    Only the label changes of the expected kind and the row positions of the
    dates matter, so both sides meet by equi join on the days of the window.
    """
    keys = list(s.keys)
    d = row_index(labels, s, "_i")
    t = s.order[0]
    days = F.explode(F.sequence(F.date_sub("start", lead_rows * 8), F.col("end")))
    e = episodes.select(*keys, "name", "start", "end", "expected", days.alias(t))
    j = d.join(e, [*keys, t])
    onset = F.min(F.when(F.col(t) >= F.col("start"), F.col("_i")))
    on = j.groupBy(*keys, "name").agg(onset.alias("_on"))
    j = j.join(on, [*keys, "name"])
    ok = (F.col("_i") >= F.col("_on") - lead_rows) & (F.col("label") == F.col("expected"))
    return j.groupBy(*keys, "name").agg(F.min(F.when(ok, F.col("_i") - F.col("_on"))).alias("lead_lag"))


def episode_scores(labels: DataFrame, episodes: DataFrame, s: Ordered) -> DataFrame:
    """Share of the labelled rows of each episode that carry the expected label."""
    t = s.order[0]
    days = F.explode(F.sequence("start", "end"))
    e = episodes.select(*s.keys, "name", "expected", days.alias(t))
    j = labels.where(F.col("label").isNotNull()).join(e, [*s.keys, t])
    return j.groupBy(*s.keys, "name").agg(
        F.avg((F.col("label") == F.col("expected")).cast("double")).alias("share_expected"),
        F.count(F.lit(1)).alias("n"),
    )


def tercile_target(df: DataFrame, keys: Sequence[str], x: str, out: str = "high") -> DataFrame:
    """True in the top third of the whole sample of a key."""
    q = quantiles(df, keys, x, {"_q": 2 / 3})
    d = df.join(q, list(keys))
    return d.withColumn(out, F.when(F.col(x).isNotNull(), F.col(x) >= F.col("_q"))).drop("_q")


def expanding_median(df: DataFrame, s: Ordered, x: str, out: str, least: int = 60) -> DataFrame:
    """Median of the strictly earlier known values, carried over gaps, for series of any
    length."""
    return expanding_quantile(df, s, x, out, 0.5, least)


def forward_drawdown(df: DataFrame, s: Ordered, c: str, h: int, out: str) -> DataFrame:
    """Deepest fall from the running high over the next h rows."""
    def stage(w):
        f = w.rowsBetween(0, h)
        vals = F.collect_list(F.col(c)).over(f)  # h + 1 values
        walk = F.aggregate(
            vals,
            F.struct(F.lit(0.0).alias("dd"), F.lit(0.0).alias("hi")),
            lambda a, v: F.struct(
                F.least(a["dd"], v / F.greatest(a["hi"], v) - 1).alias("dd"),
                F.greatest(a["hi"], v).alias("hi"),
            ),
            lambda a: a["dd"],
        )
        return {out: F.when(F.count(F.lit(1)).over(f) == h + 1, walk)}

    return rolling(df, s, stage, back=0, ahead=h)


def top_bottom_spread(
    df: DataFrame, time: str, score: str, fwd: str, k: int = 2, least: int = 4, names: int | None = None
) -> DataFrame:
    """Mean forward value of the k best minus the k worst names per date."""
    from ..functions.ordered import row_numbers

    d = df.dropna(subset=[score, fwd])
    d = row_numbers(d, [time], score, ["symbol"], "_rn", "_n", names=names)
    d = d.where(F.col("_n") >= least)
    top, low = F.col("_rn") > F.col("_n") - k, F.col("_rn") <= k
    return d.groupBy(time).agg(
        (F.avg(F.when(top, F.col(fwd))) - F.avg(F.when(low, F.col(fwd)))).alias("spread"),
        F.max("_n").alias("n"),
    )
