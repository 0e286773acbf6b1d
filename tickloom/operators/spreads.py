"""Mean-reversion analytics and entry signals (inventory 2.N)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import log_return, ratio, roll, roll_mean, roll_median, roll_std, safe_log
from ..functions.ordered import Ordered, quantiles, rolling, row_index, running, sliding_ranks
from ..session import materialize
from .align import carry_fair_value, carry_ratio

SPREAD = Ordered(("spread",), ("date",), step=1)
ADF_1, ADF_5, ADF_10 = -3.43, -2.86, -2.57


def _ar1_fit(n: Column, mx: Column, my: Column, sxx: Column, sxy: Column, syy: Column):
    """Slope, intercept, slope t, half-life and verdict from centred sums."""
    beta = F.try_divide(sxy, sxx)
    rss = F.greatest(syy - beta * sxy, F.lit(0.0))
    se = F.sqrt(F.try_divide(rss, (n - 2) * sxx))
    t = F.when(se > 0, beta / se)
    hl = F.when((beta > -1) & (beta < 0), -math.log(2.0) / F.log(1 + beta))
    return {
        "alpha": my - beta * mx,
        "beta": beta,
        "t_stat": t,
        "n_obs": n,
        "half_life": hl,
        "mean_reverting": F.coalesce((beta < 0) & (F.abs(t) > 2.0), F.lit(False)),
    }


def ar1(df: DataFrame, s: Ordered, x: str, least: int = 3) -> DataFrame:
    """Change on the lagged level, per series: one lag and one aggregate."""
    d = df.where(F.col(x).isNotNull())
    d = rolling(d, s, lambda w: {"_lag": F.lag(x).over(w)}, back=1)
    d = d.where(F.col("_lag").isNotNull()).withColumn("_d", F.col(x) - F.col("_lag"))
    g = d.groupBy(*s.keys).agg(
        F.regr_count("_d", "_lag").alias("_n"),
        F.avg("_lag").alias("_mx"),
        F.avg("_d").alias("_my"),
        F.regr_sxx("_d", "_lag").alias("_sxx"),
        F.regr_sxy("_d", "_lag").alias("_sxy"),
        F.regr_syy("_d", "_lag").alias("_syy"),
    )
    made = _ar1_fit(*[F.col(c) for c in ("_n", "_mx", "_my", "_sxx", "_sxy", "_syy")])
    return g.where(F.col("_n") >= least - 1).select(*s.keys, *[c.alias(n) for n, c in made.items()])


def adf(df: DataFrame, s: Ordered, x: str, max_lag: int | None = None, least: int = 30) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag order by BIC.

    Sums of the level and the change with each lagged change are aggregated once per series,
    over the rows that all orders can use. Products of two lagged changes are the same sums
    shifted, so they and the rows that only smaller orders can use are corrections from the
    first and last rows of the series, at most as many as there are lags. One small solve per
    series follows.
    """
    top = 20 if max_lag is None else max_lag
    keys = list(s.keys)
    d = df.where(F.col(x).isNotNull())
    d = rolling(d, s, lambda w: {"_v": F.lag(x).over(w)}, back=1)
    d = d.withColumn("_y", F.col(x) - F.col("_v"))
    d = rolling(
        d, s, lambda w: {f"_g{i}": F.lag("_y", i).over(w) for i in range(1, top + 1)}, back=top
    )
    d = row_index(d, s, "_i")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mv"))
    d = d.join(n, keys).where(F.col("_n") >= least)
    auto = F.least(F.lit(20), F.floor(12 * F.pow(F.col("_n") / 100, 0.25)))
    cap = (auto if max_lag is None else F.lit(max_lag)).cast("long")
    # the level is centred for a well-conditioned solve; only the constant moves
    d = d.withColumns({"_vc": F.col("_v") - F.col("_mv"), "_cap": cap})
    common = F.col("_i") >= F.col("_cap") + 2
    edge = (F.col("_i") >= 2) & ((F.col("_i") <= F.col("_cap") + 1) | (F.col("_i") > F.col("_n") - F.col("_cap")))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(common, c)), F.lit(0.0))

    lags = [F.col("_y"), *[F.col(f"_g{i}") for i in range(1, top + 1)]]
    g = d.groupBy(*keys, "_n", "_cap").agg(
        total(F.lit(1.0)).alias("_s1"), total(F.col("_vc")).alias("_sv"), total(F.col("_y")).alias("_sy"),
        total(F.col("_vc") * F.col("_vc")).alias("_svv"),
        F.array(*[total(F.col("_vc") * c) for c in lags]).alias("_svy"),
        F.array(*[total(F.col("_y") * c) for c in lags]).alias("_syy"),
        F.collect_list(F.when(edge, F.struct("_i", "_y", "_vc"))).alias("_edge"),
    )
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in g.schema.fields if f.name in keys]
    schema = ", ".join([*fields, "p long", "t_stat double", "b double", "n_obs long", "bic double"])

    def gram(r: dict) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Products of (1, level, lags 1.., change) on the common rows, and the head rows."""
        last, c = int(r["_n"]), int(r["_cap"])
        at = {int(e["_i"]): (e["_y"], e["_vc"]) for e in r["_edge"]}
        y = {i: v[0] for i, v in at.items()}
        a = np.zeros((c + 3, c + 3))
        svy, syy = np.array(r["_svy"]), np.array(r["_syy"])
        order = [c + 2, *range(2, c + 2)]  # place of lag 0 (the change) and lags 1..c
        a[0, 0], a[0, 1], a[1, 1] = r["_s1"], r["_sv"], r["_svv"]
        for i in range(c + 1):
            head, tail = range(c + 2 - i, c + 2), range(last - i + 1, last + 1)
            a[0, order[i]] = r["_sy"] + sum(y[t] for t in head) - sum(y[t] for t in tail)
            a[1, order[i]] = svy[i]
            for j in range(i, c + 1):
                shift = sum(y[t] * y[t - j + i] for t in head) - sum(y[t] * y[t - j + i] for t in tail)
                u, v = sorted((order[i], order[j]))
                a[u, v] = syy[j - i] + shift
        a = np.triu(a) + np.triu(a, 1).T
        rows = {}
        for t in range(2, c + 2):
            back = [y.get(t - i, 0.0) if t - i >= 2 else 0.0 for i in range(1, c + 1)]
            rows[t] = np.array([1.0, at[t][1], *back, y[t]])
        return a, rows

    def fit(a: np.ndarray, use: list[int]) -> tuple[float, float, float, float]:
        n_obs, k = a[0, 0], len(use)
        if n_obs <= k + 1:
            return math.nan, math.nan, n_obs, math.nan
        inv = np.linalg.pinv(a[np.ix_(use, use)])
        coef = inv @ a[use, -1]
        rss = max(a[-1, -1] - coef @ a[use, -1], 1e-300)
        se = math.sqrt(rss / (n_obs - k) * inv[1, 1])
        bic = n_obs * math.log(rss / n_obs) + k * math.log(n_obs)
        return coef[1] / se if se > 0 else math.nan, coef[1], n_obs, bic

    def solve(parts):
        for pdf in parts:
            out = []
            for rec in pdf.to_dict("records"):
                if rec["_n"] < rec["_cap"] + 2:
                    continue
                a, head = gram(rec)
                for p in range(int(rec["_cap"]) + 1):
                    use = list(range(2 + p))
                    usable = a + sum((np.outer(v, v) for t, v in head.items() if t >= p + 2), np.zeros_like(a))
                    u, c = fit(usable, use), fit(a, use)  # the order is chosen on the common rows
                    out.append([*[rec[k] for k in keys], p, u[0], u[1], int(u[2]), c[3]])
            yield pd.DataFrame(out, columns=[*keys, "p", "t_stat", "b", "n_obs", "bic"])

    fits = g.mapInPandas(solve, schema)
    best = F.min_by(F.struct("t_stat", "b", "n_obs", F.col("p").alias("n_lags")), F.struct("bic", "p"))
    r = fits.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    return r.withColumns(
        {
            "stationary_5pct": F.col("t_stat") < ADF_5,
            "stationary_1pct": F.col("t_stat") < ADF_1,
        }
    )


def adf_pvalue(t: Column) -> Column:
    """Piecewise linear through the 1, 5 and 10 percent points."""
    low = (0.05 - 0.01) / (ADF_5 - ADF_1)
    high = (0.10 - 0.05) / (ADF_10 - ADF_5)
    return (
        F.when(t <= ADF_1, F.greatest(F.lit(1e-4), 0.01 + low * (t - ADF_1)))
        .when(t < ADF_5, 0.01 + low * (t - ADF_1))
        .when(t < ADF_10, 0.05 + high * (t - ADF_5))
        .otherwise(F.least(F.lit(1.0), 0.10 + high * (t - ADF_10)))
    )


def lagged_zscore(df: DataFrame, s: Ordered, x: str, n: int, out: str) -> DataFrame:
    """Full-window z-score of the row before."""
    z = lambda w: {"_z": ratio(F.col(x) - roll_mean(x, w, n), roll_std(x, w, n))}
    d = rolling(df, s, [z, lambda w: {out: F.lag("_z").over(w)}], back=n)
    return d.drop("_z")


def spread_atr(w, change: str, n: int) -> Column:
    return roll_std(change, w, n, shift=1)


def true_range(w) -> Column:
    prev = F.lag("close").over(w)
    tr = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return F.when(prev.isNotNull(), tr)


def simple_atr(df: DataFrame, s: Ordered, n: int, out: str) -> DataFrame:
    """Mean true range without the current row."""
    d = rolling(
        df, s, [lambda w: {"_tr": true_range(w)}, lambda w: {out: roll_mean("_tr", w, n, shift=1)}], n + 1
    )
    return d.drop("_tr")


def regime_label(value: Column, band: float) -> Column:
    return (
        F.when(value.isNull(), "unknown")
        .when(value > band, "backwardation")
        .when(value < -band, "contango")
        .otherwise("flat")
    )


def variance_ratio_test(df: DataFrame, s: Ordered, x: str, q: int) -> DataFrame:
    d = rolling(
        df.where(F.col(x).isNotNull()),
        s,
        lambda w: {"_a": F.col(x) - F.lag(x).over(w), "_b": F.col(x) - F.lag(x, q).over(w)},
        back=q,
    )
    g = d.groupBy(*s.keys).agg(
        F.count("_a").alias("n"), F.var_samp("_a").alias("_v1"), F.var_samp("_b").alias("_vq")
    )
    ok = F.col("n") >= 2 * q
    vr = F.when(ok, ratio(F.col("_vq") / q, "_v1"))
    se = F.sqrt(2.0 * (2 * q - 1) * (q - 1) / (3.0 * q * F.col("n")))
    return g.select(*s.keys, "n", vr.alias("vr"), ((vr - 1) / se).alias("z_stat"))


HURST_LAGS = 100  # upper end of the lags where a series is long enough


def hurst(df: DataFrame, s: Ordered, x: str, lo: int = 2, hi: int | None = None) -> DataFrame:
    """Half the slope of log var(lag k) on log k, k in [lo, hi).

    By default ``hi`` is a series' quarter length, 100 at most and lo + 1 at least.
    """
    n = F.count(x)
    upto = F.greatest(F.lit(lo + 1), F.least(F.lit(HURST_LAGS), F.floor(n / 4))) if hi is None else F.lit(hi)
    hi = HURST_LAGS if hi is None else hi
    d = rolling(
        df.where(F.col(x).isNotNull()),
        s,
        lambda w: {f"_k{k}": F.col(x) - F.lag(x, k).over(w) for k in range(lo, hi)},
        back=hi,
    )
    g = d.groupBy(*s.keys).agg(upto.alias("_hi"), *[F.var_pop(f"_k{k}").alias(f"_v{k}") for k in range(lo, hi)])
    cells = F.explode(
        F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"_v{k}").alias("v")) for k in range(lo, hi)])
    )
    t = g.select(*s.keys, "_hi", cells.alias("_c")).where("_c.k < _hi and _c.v > 0").select(*s.keys, "_c.k", "_c.v")
    t = t.groupBy(*s.keys).agg(
        F.regr_slope(F.log("v"), F.log("k")).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    return t.where(F.col("_n") >= 2).select(*s.keys, (F.col("_b") / 2).alias("hurst"))


def chunked(df: DataFrame, s: Ordered, x: str, window: int) -> DataFrame:
    """Full non-overlapping chunks of ``window`` known rows, numbered from 0."""
    d = row_index(df.where(F.col(x).isNotNull()), s, "_i")
    n = d.groupBy(*s.keys).agg(F.max("_i").alias("_n"))
    d = d.join(n, list(s.keys)).withColumn("chunk", F.floor((F.col("_i") - 1) / window))
    return d.where(F.col("chunk") < F.floor(F.col("_n") / window)).drop("_i", "_n")


def chunk_half_life(df: DataFrame, s: Ordered, x: str, window: int) -> DataFrame:
    d = ar1(chunked(df, s, x, window), s.by(*s.keys, "chunk"), x, 10)
    return d.select(*s.keys, "chunk", "half_life")


def chunk_adf(df: DataFrame, s: Ordered, x: str, window: int, max_lag: int) -> DataFrame:
    d = adf(chunked(df, s, x, window), s.by(*s.keys, "chunk"), x, max_lag, 60)
    return d.select(*s.keys, "chunk", "t_stat")


def stability(df: DataFrame, s: Ordered, x: str, parts: int = 4, lo: float = 3.0, hi: float = 60.0):
    """Sub-periods whose half-life lies in the band; stable when the whole
    sample does too and three or more parts do."""
    d = row_index(df.where(F.col(x).isNotNull()), s, "_i")
    n = d.groupBy(*s.keys).agg(F.max("_i").alias("_n"))
    d = materialize(d.join(n, list(s.keys)))
    width = F.floor(F.col("_n") / parts)
    sub = d.withColumn("chunk", F.floor((F.col("_i") - 1) / width))
    sub = sub.where((F.col("chunk") < parts) & (width >= 10))
    band = F.col("half_life").between(lo, hi)
    sub = ar1(sub, s.by(*s.keys, "chunk"), x, 10).groupBy(*s.keys).agg(
        F.count_if(band).alias("n_in_band"), F.count(F.lit(1)).alias("n_parts")
    )
    full = ar1(d, s, x, 30).select(
        *s.keys, F.col("half_life").alias("full_half_life"), F.coalesce(band, F.lit(False)).alias("full_in_band")
    )
    r = full.join(sub, list(s.keys), "left").na.fill(0, ["n_in_band", "n_parts"])
    return r.withColumn("stable", F.col("full_in_band") & (F.col("n_in_band") >= 3))


def stationarity_screen(
    df: DataFrame, s: Ordered, x: str, max_lag: int, hurst_hi: int | None = None
) -> DataFrame:
    """ADF, VR(5), VR(20), Hurst and stability together."""
    k = list(s.keys)
    a = adf(df, s, x, max_lag, 60).select(*k, F.col("t_stat").alias("adf_t"), F.col("stationary_5pct").alias("adf_pass"))
    v5 = variance_ratio_test(df, s, x, 5).select(*k, F.col("z_stat").alias("vr5_z"))
    v20 = variance_ratio_test(df, s, x, 20).select(*k, F.col("z_stat").alias("vr20_z"))
    h = hurst(df, s, x, 2, hurst_hi)
    st = stability(df, s, x).select(*k, "stable")
    d = df.select(*k).distinct()
    for p in (a, v5, v20, h, st):
        d = d.join(p, k, "left")
    ok = (
        F.col("adf_pass")
        & (F.col("vr5_z") < -1.645)
        & (F.col("vr20_z") < -1.645)
        & (F.col("hurst") < 0.5)
        & F.col("stable")
    )
    return d.withColumn("passes", F.coalesce(ok, F.lit(False)))


def leg_correlation(df: DataFrame, s: Ordered, a: str, b: str, n: int, out: str) -> DataFrame:
    """Rolling correlation of two legs' log returns over n known pairs."""
    d = rolling(df, s, lambda w: {"_ra": log_return(w, a), "_rb": log_return(w, b)}, back=1)
    both = F.col("_ra").isNotNull() & F.col("_rb").isNotNull()

    def rho(w):
        f = w.rowsBetween(-(n - 1), 0)
        return {out: F.when(F.count(F.when(both, 1)).over(f) == n, F.corr("_ra", "_rb").over(f))}

    return rolling(d, s, rho, back=n).drop("_ra", "_rb")


def ar1_by_state(df: DataFrame, s: Ordered, x: str, state: str, least: int = 60) -> DataFrame:
    """AR(1) over the rows of each state taken as one series, and pooled."""
    d = df.where(F.col(x).isNotNull())
    one = d.where(F.col(state).isNotNull()).withColumn("state", F.col(state))
    both = one.unionByName(d.withColumn("state", F.lit("_pooled")))
    return ar1(both, s.by(*s.keys, "state"), x, least)


def vol_by_state(df: DataFrame, keys: Sequence[str], r: str, state: str, least: int = 20) -> DataFrame:
    """Annualized population vol per state and pooled; ``rollup`` over states."""
    d = df.where(F.col(r).isNotNull() & F.col(state).isNotNull())
    g = d.rollup(*keys, state).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(r).alias("_s"))
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    v = F.when(F.col("n") >= least, F.col("_s") * math.sqrt(252.0))
    return g.select(*keys, F.coalesce(state, F.lit("_pooled")).alias("state"), "n", v.alias("vol"))


def suppression(df: DataFrame, s: Ordered, x: str, flag: str, vol_n: int = 20, pct_n: int = 252,
                roll_pct: float = 0.8, regime_pct: float = 0.95) -> DataFrame:
    """High-volatility and roll flags that shut entries. The percentile is
    (average rank - 1) / (n - 1) of the last value in its window."""
    def change(w):
        return {"_d": F.col(x) - F.lag(x).over(w)}

    def vol(w):
        return {"_v": roll_std("_d", w, vol_n, max(1, vol_n // 2))}

    d = rolling(df, s, [change, vol], back=vol_n + 1)
    d = sliding_ranks(d, s, {"_rank": (F.col("_v"), pct_n)})
    n = F.col("_rank.known")
    rank = F.col("_rank.below") + (F.col("_rank.ties") + 1) / 2.0
    ok = F.col("_v").isNotNull() & (n >= max(1, pct_n // 4)) & (n > 1)
    d = d.withColumn("vol_pct", F.when(ok, (rank - 1) / (n - 1)))
    off = F.lit(False)
    return d.withColumns(
        {
            "roll_suppress": F.coalesce(F.col(flag) & (F.col("vol_pct") > roll_pct), off),
            "regime_suppress": F.coalesce(F.col("vol_pct") > regime_pct, off),
        }
    ).drop("_d", "_v", "_rank")


def trade_history_features(
    trades: DataFrame, series: DataFrame, s: Ordered, x: str, window: int, q: int = 5
) -> DataFrame:
    """Per trade, statistics of the ``window`` rows before its entry: level
    percentile, change over five rows, half-life and variance ratio.

    Each history row is sent to the trades it precedes by equi join on its row
    number, so the work is trades times window.
    """
    k, t = list(s.keys), s.order[0]
    d = rolling(
        series.where(F.col(x).isNotNull()),
        s,
        lambda w: {
            "_lag": F.lag(x).over(w),
            "_l5": F.lag(x, q).over(w),
            "_last": F.lag(x).over(w),
            "_back": F.lag(x, q + 1).over(w),
        },
        back=q + 1,
    )
    d = materialize(row_index(d, s, "_i"))
    e = trades.select("trade_id", *k, t).join(
        d.select(*k, t, F.col("_i").alias("_e"), "_last", "_back"), [*k, t]
    )
    lo = F.greatest(F.col("_e") - window, F.lit(1))
    e = e.withColumn("_first", lo).where(F.col("_e") > 1)
    hist = e.select("trade_id", *k, "_e", "_first", "_last", "_back", F.explode(F.sequence(lo, F.col("_e") - 1)).alias("_i"))
    j = hist.join(d.select(*k, "_i", F.col(x).alias("_x"), "_lag", "_l5"), [*k, "_i"])
    in1, inq = F.col("_i") > F.col("_first"), F.col("_i") >= F.col("_first") + q
    dx, lag = F.when(in1, F.col("_x") - F.col("_lag")), F.when(in1, F.col("_lag"))
    g = j.groupBy("trade_id").agg(
        F.count(F.lit(1)).alias("n_hist"),
        F.avg((F.col("_x") <= F.col("_last")).cast("double")).alias("level_pctile"),
        F.max(F.col("_last") - F.col("_back")).alias("pre_move"),
        F.regr_slope(dx, lag).alias("_b"),
        F.var_samp(dx).alias("_v1"),
        F.var_samp(F.when(inq, F.col("_x") - F.col("_l5"))).alias("_vq"),
    )
    hl = F.when((F.col("_b") > -1) & (F.col("_b") < 0), -math.log(2.0) / F.log(1 + F.col("_b")))
    return g.select(
        "trade_id", "n_hist", "level_pctile", "pre_move", hl.alias("half_life"),
        ratio(F.col("_vq") / q, "_v1").alias("vr"),
    )


def vote_gate(refs: DataFrame, calendar: DataFrame, s: Ordered, fast: int, slow: int, least: int):
    """Dates on which enough reference series have fast SMA above slow SMA,
    both without the current row; a missing date is no vote."""
    def sma(w):
        return {"_f": roll_mean("close", w, fast, shift=1), "_s": roll_mean("close", w, slow, shift=1)}

    t = s.order[0]
    d = rolling(refs, s, sma, back=slow + 1)
    v = d.groupBy(t).agg(F.count_if(F.col("_f") > F.col("_s")).alias("votes"))
    v = calendar.join(v, t, "left").na.fill(0, ["votes"])
    return v.withColumn("gate", F.col("votes") >= least)


def breakout_entries(df: DataFrame, s: Ordered, run: int = 40, base: int = 10,
                     min_run: float = 0.25, max_range: float = 0.15) -> DataFrame:
    """Prior run, tight base, and a close above the base high of the row before."""
    def bases(w):
        hi, lo = roll(F.max, "high", w, base), roll(F.min, "low", w, base)
        return {
            "_hi": hi,
            "_rng": (hi - lo) / F.col("close"),
            "_run": ratio(F.lag("close", base).over(w), F.lag("close", base + run).over(w)) - 1,
        }

    def entry(w):
        e = (
            (F.col("close") > F.lag("_hi").over(w))
            & (F.lag("_rng").over(w) <= max_range)
            & (F.lag("_run").over(w) >= min_run)
        )
        return {"entry": F.coalesce(e, F.lit(False))}

    return rolling(df, s, [bases, entry], back=base + run + 1).drop("_hi", "_rng", "_run")


def bars_since(df: DataFrame, s: Ordered, flag: str, out: str) -> DataFrame:
    """Rows since the last flagged row, 0 on it; counts from 0 before any."""
    d = running(df, s, {"_n": ("sum", F.lit(1).cast("long"))}, reset=F.col(flag))
    return d.withColumn(out, F.col("_n") - 1).drop("_n")


def calibration_columns(df: DataFrame, s: Ordered, run: int = 40, base: int = 10, atr_n: int = 14,
                        vol_n: int = 20) -> DataFrame:
    """Base range and prior run in ATR units, and the volume ratio."""
    d = simple_atr(df, s, atr_n, "_atr")

    def bases(w):
        hi, lo = roll(F.max, "high", w, base), roll(F.min, "low", w, base)
        c0, a0 = F.lag("close", base).over(w), F.lag("_atr", base).over(w)
        ret = ratio(c0, F.lag("close", base + run).over(w)) - 1
        return {
            "base_high": hi,
            "base_low": lo,
            "base_range_atr": ratio(hi - lo, "_atr"),
            "prior_run_atr": ratio(ret, ratio(a0, c0)),
            "median_volume": roll_median("volume", w, vol_n, shift=1),
        }

    d = rolling(d, s, bases, back=base + run + vol_n)
    return d.withColumn("volume_ratio", ratio("volume", "median_volume")).drop("_atr")


def volume_breakouts(df: DataFrame, s: Ordered, run: int = 40, base: int = 10, min_run: float = 6.0,
                     max_range: float = 3.0, k: float = 1.5, vol_n: int = 20) -> DataFrame:
    """Long and short breakouts in ATR units, confirmed by volume, shut near
    rolls (column ``is_roll``)."""
    d = bars_since(calibration_columns(df, s, run, base, 14, vol_n), s, "is_roll", "_since")

    def entry(w):
        ok = F.lag("base_range_atr").over(w) <= max_range
        run1 = F.lag("prior_run_atr").over(w)
        vol = F.coalesce(F.col("volume") >= k * F.col("median_volume"), F.lit(False))
        vol = vol & (F.col("_since") > vol_n) & ~F.col("is_roll")
        up = (F.col("close") > F.lag("base_high").over(w)) & ok & (run1 >= min_run)
        down = (F.col("close") < F.lag("base_low").over(w)) & ok & (run1 <= -min_run)
        no = F.lit(False)
        return {
            "long_entry": F.coalesce(up & vol, no),
            "short_entry": F.coalesce(down & vol, no),
        }

    d = rolling(d, s, entry, back=1)
    return d.select(*df.columns, "long_entry", "short_entry")


def frozen_thresholds(d: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled percentiles: p30 of the base range, p70 of |prior run|, p75 of
    the volume ratio."""
    d = materialize(
        d.select(*keys, "base_range_atr", F.abs("prior_run_atr").alias("_run"), F.when(F.col("volume_ratio") > 0, F.col("volume_ratio")).alias("_vol"))
    )
    a = quantiles(d, keys, "base_range_atr", {"base_max_range": 0.30})
    b = quantiles(d, keys, "_run", {"prior_run_min": 0.70})
    c = quantiles(d, keys, "_vol", {"vol_k": 0.75})
    if keys:
        return a.join(b, list(keys)).join(c, list(keys))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def adjusted_ewm(df: DataFrame, s: Ordered, x: Column, span: int, out: str) -> DataFrame:
    """Exponential mean with full-history weights: the ratio of two recursive
    sums, of the values and of their weights."""
    from ..functions.ordered import affine

    keep = 1 - 2.0 / (span + 1.0)
    d = row_index(df.withColumn("_x", x), s, "_i")
    a = F.when(F.col("_i") == 1, 0.0).otherwise(keep)
    d = affine(d, s, a, F.coalesce("_x", F.lit(0.0)), "_num")
    d = affine(d, s, a, F.when(F.col("_x").isNull(), 0.0).otherwise(1.0), "_den")
    return d.withColumn(out, ratio("_num", "_den")).select(*[c for c in df.columns if c != out], out)


def trend_state(df: DataFrame, s: Ordered, fast: int = 32, slow: int = 96, roc: int = 48,
                span: int = 10, atr_n: int = 14) -> DataFrame:
    """ATR-normalized EMA spread and rate of change, averaged and smoothed; all
    inputs end at the row before."""
    d = df.withColumn("_lc", safe_log("close"))
    d = adjusted_ewm(d, s, F.col("_lc"), fast, "_ef")
    d = adjusted_ewm(d, s, F.col("_lc"), slow, "_es")
    d = simple_atr(d, s, atr_n, "_atr")
    frac = F.when(F.col("_atr") > 1e-12, ratio("_atr", "close"))

    def parts(w):
        return {
            "_t": ratio(F.lag("_ef").over(w) - F.lag("_es").over(w), frac),
            "_m": ratio(F.lag("_lc").over(w) - F.lag("_lc", roc + 1).over(w), frac),
        }

    d = rolling(d, s, parts, back=roc + 1)
    n = F.col("_t").isNotNull().cast("int") + F.col("_m").isNotNull().cast("int")
    both = F.coalesce("_t", F.lit(0.0)) + F.coalesce("_m", F.lit(0.0))
    raw = F.when(n > 0, both / n).otherwise(0.0)
    d = adjusted_ewm(d.withColumn("_raw", raw), s, F.col("_raw"), span, "_st")
    d = row_index(d, s, "_i")
    state = F.when(F.col("_i") > max(fast, slow, roc), F.col("_st"))
    return d.withColumn("state", state).select(*df.columns, "state")


def roc_entry(w, n: int, theta: float) -> Column:
    move = F.log(F.lag("close").over(w)) - F.log(F.lag("close", n + 1).over(w))
    return F.when(move > theta, 1.0).when(move < -theta, -1.0).otherwise(0.0)


def trailing_stop(df: DataFrame, s: Ordered, mult: float = 3.0, atr_n: int = 14) -> DataFrame:
    """Ratcheting stop while the position keeps its sign and ATR is known."""
    d = simple_atr(df, s, atr_n, "_atr")
    sign = F.signum("position").cast("int")
    live = F.when(F.col("_atr").isNotNull(), sign).otherwise(0)
    d = rolling(
        d.withColumn("_sg", F.coalesce(live, F.lit(0))),
        s,
        lambda w: {"_new": F.coalesce(F.col("_sg") != F.lag("_sg").over(w), F.lit(True))},
        back=1,
    )
    up = F.when(F.col("_sg") > 0, F.col("close") - mult * F.col("_atr"))
    down = F.when(F.col("_sg") < 0, F.col("close") + mult * F.col("_atr"))
    d = running(d, s, {"_u": ("max", up), "_l": ("min", down)}, reset=F.col("_new"))
    stop = F.when(F.col("_sg") > 0, F.col("_u")).when(F.col("_sg") < 0, F.col("_l"))
    return d.withColumn("stop", stop).select(*df.columns, "stop")


def stop_fill(df: DataFrame, optimistic: bool = False) -> DataFrame:
    """Exit flag and fill: the stop, or the open when the bar gapped through."""
    p, st = F.col("position"), F.col("stop")
    long = F.coalesce((p > 0) & (F.col("low") <= st), F.lit(False))
    short = F.coalesce((p < 0) & (F.col("high") >= st), F.lit(False))
    fill = F.when(long | short, st)
    if not optimistic:
        gap = (long & (F.col("open") <= st)) | (short & (F.col("open") >= st))
        fill = F.when(gap, F.col("open")).otherwise(fill)
    return df.withColumns({"stopped": long | short, "fill": fill})


def state_profile(df: DataFrame, s: Ordered, defs: Mapping[str, Column], x: str, r: str, rho: str):
    """AR(1), vol and mean leg correlation per state under several definitions."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(n).alias("definition"), c.alias("st")) for n, c in defs.items()])
    )
    d = df.select("*", cells.alias("_c")).select(*df.columns, "_c.definition", "_c.st")
    d = materialize(d)
    by = s.by(*s.keys, "definition")
    a = ar1_by_state(d, by, x, "st", 30).select(*by.keys, "state", "beta", "half_life")
    v = vol_by_state(d, by.keys, r, "st")
    c = d.where(F.col("st").isNotNull() & F.col(rho).isNotNull()).groupBy(*by.keys, F.col("st").alias("state"))
    c = c.agg(F.avg(rho).alias("mean_leg_corr"), F.count(F.lit(1)).alias("_n"))
    c = c.where(F.col("_n") >= 30).drop("_n")
    return v.join(a, [*by.keys, "state"], "left").join(c, [*by.keys, "state"], "left")


def reversion_probe(df: DataFrame, s: Ordered, x: str, flag: str) -> DataFrame:
    """AR(1) and z-score IC of each spread without its roll rows."""
    from .inference import zscore_ic

    # one evaluation for both: sums behind x may differ in their last bits when made anew
    d = materialize(df.where(~F.col(flag)).select(*s.keys, *s.order, x))
    a = ar1(d, s, x).select(*s.keys, "beta", "t_stat", "half_life", "mean_reverting")
    return a.join(zscore_ic(d, s, x), list(s.keys), "left")


def carry_columns(leg2: Column, value: Column, storage: float, rate: Column) -> dict[str, Column]:
    fv = carry_fair_value(leg2, storage, rate)
    return {"carry_fv": fv, "carry_ratio": carry_ratio(value, fv)}
