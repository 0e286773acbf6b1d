"""Volatility, tail risk and forecast scoring (inventory 2.K)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, roll, roll_mean, roll_std
from ..functions.ordered import (
    Ordered,
    affine,
    quantiles,
    rolling,
    row_index,
    row_numbers,
    running,
    value_ranks,
)
from ..functions.selection import largest, select_rank
from ..functions.special import chi2_sf, log_gamma, norm_cdf, norm_density, norm_quantile
from ..session import materialize
from .curves import runs
from .features import hash_int
from .pairs import joint_below

LOG_2PI = math.log(2 * math.pi)


def trailing_variance(w, r: str, n: int) -> Column:
    return roll(F.var_samp, r, w, n, n // 2 + 1, shift=1)


def ewma_variance(df: DataFrame, s: Ordered, r: str, lam: float, out: str, seed: int = 50):
    """lam * v + (1 - lam) * r[t-1]^2, started at the variance of the first
    ``seed`` squared returns."""
    sq = F.coalesce(F.col(r) * F.col(r), F.lit(0.0))
    d = row_index(df.withColumn("_sq", sq), s, "_i")
    first = d.where(F.col("_i") <= seed).groupBy(*s.keys).agg(F.var_pop("_sq").alias("_v0"))
    d = d.join(first, list(s.keys))
    d = rolling(d, s, lambda w: {"_prev": F.lag("_sq").over(w)}, back=1)
    a = F.when(F.col("_i") == 1, 0.0).otherwise(lam)
    b = F.when(F.col("_i") == 1, F.col("_v0")).otherwise((1 - lam) * F.col("_prev"))
    return affine(d, s, a, b, out).select(*df.columns, out)


def ewma_vol(df: DataFrame, s: Ordered, r: str, lam: float, out: str, seed: int = 20):
    """The same recursion from row ``seed`` on, as a volatility."""
    d = row_index(df.where(F.col(r).isNotNull()), s, "_i")
    first = d.where(F.col("_i") <= seed).groupBy(*s.keys).agg(F.var_pop(r).alias("_v0"))
    d = d.join(first, list(s.keys))
    d = rolling(d, s, lambda w: {"_prev": F.pow(F.lag(r).over(w), 2)}, back=1)
    i = F.col("_i")
    a = F.when(i > seed + 1, lam).when(i == seed + 1, 0.0)
    b = F.when(i > seed + 1, (1 - lam) * F.col("_prev")).when(i == seed + 1, F.col("_v0"))
    d = affine(d, s, a, b, out)
    v = F.when(i > seed, F.sqrt(F.greatest(F.col(out), F.lit(0.0))))
    return d.withColumn(out, v).select(*df.columns, out)


def garch_variance(
    df: DataFrame, s: Ordered, r: str, omega: float, alpha: float, beta: float, start: Column,
    out: str, gamma: float = 0.0,
) -> DataFrame:
    """Variance filter at given parameters; ``gamma`` adds the leverage term."""
    d = rolling(
        df.where(F.col(r).isNotNull()), s, lambda w: {"_prev": F.lag(r).over(w)}, back=1
    )
    p = F.col("_prev")
    shock = p * p * (F.lit(alpha) + F.when(p < 0, gamma).otherwise(0.0))
    a = F.when(p.isNull(), 0.0).otherwise(beta)
    b = F.when(p.isNull(), start).otherwise(omega + shock)
    return affine(d, s, a, b, out).select(*df.columns, out)


def har_features(w, rv: str, per_day: int = 1) -> dict[str, Column]:
    return {
        "rv_d": roll_mean(rv, w, per_day, 1, shift=1),
        "rv_w": roll_mean(rv, w, 5 * per_day, per_day, shift=1),
        "rv_m": roll_mean(rv, w, 22 * per_day, per_day, shift=1),
    }


def refit_forecast(
    df: DataFrame, s: Ordered, xs: Sequence[str], y: str, every: int, min_train: int, out: str
) -> DataFrame:
    """Least squares on all earlier rows, refitted every k rows, coefficients
    held between. Running Gram sums feed one small solve per refit row."""
    k = len(xs)
    one = ["_one", *xs, y]
    ok = F.col(y).isNotNull()
    for c in xs:
        ok = ok & F.col(c).isNotNull()
    d = df.withColumn("_one", F.lit(1.0)).withColumn("_ok", ok)
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    sums = {
        f"g_{i}_{j}": ("sum", F.when(F.col("_ok"), F.col(one[i]) * F.col(one[j]))) for i, j in pairs
    }
    d = row_index(d, s, "_i")
    d = running(d, s, sums, upto=-1)
    enough = (F.col("_i") - 1 >= min_train) & (F.coalesce("g_0_0", F.lit(0.0)) > k + 5)
    d = rolling(
        d.withColumn("_e", enough),
        s,
        lambda w: {"_was": F.coalesce(F.lag("_e").over(w), F.lit(False))},
        back=1,
    )
    fit = F.col("_e") & (((F.col("_i") - 1) % every == 0) | ~F.col("_was"))
    d = materialize(d.withColumn("_fit", fit))
    grams = d.where("_fit").select(*s.keys, *s.order, *sums)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in grams.schema.fields[: len(s.keys) + len(s.order)]]

    names, at = list(sums), [*s.keys, *s.order]

    def solve(parts):
        for pdf in parts:
            betas = []
            for row in pdf[names].to_numpy():
                g = np.empty((k + 2, k + 2))
                for (i, j), v in zip(pairs, row, strict=True):
                    g[i, j] = g[j, i] = v
                b, *_ = np.linalg.lstsq(g[: k + 1, : k + 1], g[: k + 1, k + 1], rcond=None)
                betas.append([float(v) for v in b])
            yield pdf[at].assign(_beta=pd.Series(betas, index=pdf.index))

    beta = grams.mapInPandas(solve, ", ".join([*fields, "_beta array<double>"]))
    d = d.drop(*sums).join(beta, [*s.keys, *s.order], "left")
    d = running(d, s, {"_b": ("last", F.col("_beta"))})
    pred = F.col("_b")[0]
    for i, c in enumerate(xs):
        pred = pred + F.col("_b")[i + 1] * F.col(c)
    return d.withColumn(out, pred).select(*df.columns, out)


def log_har_forecast(df: DataFrame, s: Ordered, rv: str, every: int, min_train: int, window: int):
    """HAR on log variance; exp(mu + residual variance / 2)."""
    d = df.withColumn("_lrv", F.when(F.col(rv) > 0, F.log(rv)))
    d = rolling(d, s, lambda w: har_features(w, "_lrv"), back=23)
    d = refit_forecast(d, s, ["rv_d", "rv_w", "rv_m"], "_lrv", every, min_train, "_mu")
    d = d.withColumn("_res", F.col("_lrv") - F.col("_mu"))
    d = rolling(
        d, s, lambda w: {"_s2": F.pow(roll_std("_res", w, window, window // 4, shift=1), 2)}, window + 1
    )
    return d.withColumn("fc_log_har", F.exp(F.col("_mu") + F.col("_s2") / 2)).select(*df.columns, "fc_log_har")


def activity_features(w, count: str, n: int) -> dict[str, Column]:
    sd = roll_std(count, w, n, n // 2, shift=1)
    m = roll_mean(count, w, n, n // 2, shift=1)
    return {"count_mean": m, "count_dispersion": ratio(sd * sd, m)}


def range_forecasts(w, n: int) -> dict[str, Column]:
    """Rolling range estimators without the current row, and Yang-Zhang."""
    k = 0.34 / (1.34 + (n + 1) / max(n - 1, 1))
    need = n // 2 + 1
    rs = roll_mean("rs_var", w, n, need, shift=1)
    vo = roll(F.var_samp, "gap_return", w, n, need, shift=1)
    vc = roll(F.var_samp, "intrabar_return", w, n, need, shift=1)
    return {
        "fc_parkinson": roll_mean("pk_var", w, n, need, shift=1),
        "fc_gk": roll_mean("gk_var", w, n, need, shift=1),
        "fc_rs": rs,
        "fc_yz": vo + k * vc + (1 - k) * rs,
    }


def qlike(actual: Column, forecast: Column) -> Column:
    q = F.try_divide(actual, forecast)
    return F.when(q > 0, q - F.log(q) - 1)


def qlike_mse(df: DataFrame, keys: Sequence[str], actual: str, forecast: str) -> DataFrame:
    """Mean QLIKE and MSE over separately masked rows (10 or more)."""
    a, f = F.col(actual), F.col(forecast)
    ok = (f > 0) & (a >= 0)
    g = df.groupBy(*keys).agg(
        F.count_if(ok).alias("n"),
        F.count_if(ok & (a > 0)).alias("n_qlike"),
        F.avg(F.when(ok & (a > 0), qlike(a, f))).alias("_q"),
        F.avg(F.when(ok, F.pow(a - f, 2))).alias("_m"),
    )
    return g.select(
        *keys,
        "n",
        "n_qlike",
        F.when((F.col("n") >= 10) & (F.col("n_qlike") >= 10), F.col("_q")).alias("qlike"),
        F.when(F.col("n") >= 10, F.col("_m")).alias("mse"),
    )


def _fit(family: str, n: Column, m: Column, v: Column, lo: Column, hi: Column) -> dict[str, Column]:
    """Closed-form parameters, null when the sample is degenerate."""
    if family == "normal":
        ok = (n >= 2) & (F.sqrt(v) > 1e-12)
        return {"loc": F.when(ok, m), "scale": F.when(ok, F.sqrt(v))}
    if family == "poisson":
        return {"mu": F.when(m > 0, m)}
    if family == "nbinom":
        p = F.try_divide(m, v)
        ok = (m > 0) & (v > m)
        return {"n": F.when(ok, F.try_divide(m * p, 1 - p)), "p": F.when(ok, p)}
    common = F.try_divide(m * (1 - m), v) - 1
    ok = (lo > 0) & (hi < 1) & (v > 1e-12) & (common > 0)
    return {"alpha": F.when(ok, m * common), "beta": F.when(ok, (1 - m) * common)}


def rolling_fit(w, c: str, family: str, window: int, min_obs: int | None = None):
    """Parameter columns of a closed-form family over the trailing window."""
    f = w.rowsBetween(-(window - 1), 0)
    n = F.count(c).over(f)
    full = n >= (min_obs or window)
    stats = [fn(c).over(f) for fn in (F.avg, F.var_pop, F.min, F.max)]
    made = _fit(family, n, *stats)
    return {f"{c}_{family}_{k}": F.when(full, v) for k, v in made.items()}


def fit_counts(df: DataFrame, s: Ordered, c: str, family: str, window: int) -> DataFrame:
    """Rows with too little history, degenerate windows, and fits."""
    d = rolling(
        df,
        s,
        lambda w: rolling_fit(w, c, family, window)
        | {"_n": F.count(c).over(w.rowsBetween(-(window - 1), 0))},
        back=window,
    )
    par = next(x for x in d.columns if x.startswith(f"{c}_{family}_"))
    return d.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_n") < window).alias("n_insufficient"),
        F.count_if((F.col("_n") >= window) & F.col(par).isNull()).alias("n_degenerate"),
        F.count(par).alias("n_fit"),
    )


def whole_fit(df: DataFrame, keys: Sequence[str], c: str, family: str) -> DataFrame:
    g = df.groupBy(*keys).agg(
        F.count(c).alias("_n"), F.avg(c).alias("_m"), F.var_pop(c).alias("_v"),
        F.min(c).alias("_lo"), F.max(c).alias("_hi"),
    )
    made = _fit(family, *[F.col(x) for x in ("_n", "_m", "_v", "_lo", "_hi")])
    return g.select(*keys, *[v.alias(f"{family}_{k}") for k, v in made.items()])


def normal_log_score(x: Column, mean: Column, var: Column) -> Column:
    return F.when(var > 0, -0.5 * (LOG_2PI + F.log(var) + F.pow(x - mean, 2) / var))


def poisson_log_score(x: Column, mu: Column) -> Column:
    """x log mu - mu - log x!; x is a count."""
    return F.when(mu > 0, x * F.log(mu) - mu - log_gamma(F.greatest(x, F.lit(0)) + 1))


def normal_crps(x: Column, mean: Column, sd: Column) -> Column:
    z = F.try_divide(x - mean, sd)
    pdf = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return F.when(sd > 0, sd * (z * (2 * norm_cdf(z) - 1) + 2 * pdf - 1 / math.sqrt(math.pi)))


def pit(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, norm_cdf(F.try_divide(x - mean, sd)))


def ks_uniform(df: DataFrame, keys: Sequence[str], u: str) -> DataFrame:
    """Greatest distance of the sorted values from the uniform law."""
    v = value_ranks(df.select(*keys, u), keys, u)
    tot = df.where(F.col(u).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    v = v.join(tot, list(keys))
    hi = F.col("_cum") / F.col("_t") - F.col(u)
    lo = F.col(u) - (F.col("_cum") - F.col("_n")) / F.col("_t")
    return v.groupBy(*keys).agg(F.max(F.greatest(hi, lo)).alias("ks_stat"), F.max("_t").alias("n"))


def exceeds(actual: Column, forecast: Column, side: str = "lower") -> Column:
    if side not in ("lower", "upper"):
        raise ValueError("side must be 'lower' or 'upper'")
    return actual < forecast if side == "lower" else actual > forecast


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def kupiec_lr(n: Column, x: Column, p: Column) -> Column:
    n, x = n.cast("double"), x.cast("double")
    q = x / n
    null = xlogy(x, p) + xlogy(n - x, 1 - p)
    alt = xlogy(x, q) + xlogy(n - x, 1 - q)
    return -2 * (null - alt)


def independence_lr(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    n00, n01, n10, n11 = [c.cast("double") for c in (n00, n01, n10, n11)]
    zero = F.lit(0.0)
    p01 = F.coalesce(F.try_divide(n01, n00 + n01), zero)
    p11 = F.coalesce(F.try_divide(n11, n10 + n11), zero)
    p = F.coalesce(F.try_divide(n01 + n11, n00 + n01 + n10 + n11), zero)
    null = xlogy(n01 + n11, p) + xlogy(n00 + n10, 1 - p)
    alt = xlogy(n01, p01) + xlogy(n00, 1 - p01) + xlogy(n11, p11) + xlogy(n10, 1 - p11)
    return -2 * (null - alt)


def coverage_tests(hits: DataFrame, s: Ordered, rate: str, hit: str = "hit") -> DataFrame:
    """Kupiec, independence and joint likelihood ratios per key. ``hits`` has a
    boolean ``hit`` and the expected ``rate`` of its key."""
    d = rolling(
        hits.where(F.col(hit).isNotNull()), s, lambda w: {"_p": F.lag(hit).over(w)}, back=1
    )
    now, was = F.col(hit), F.col("_p")
    g = d.groupBy(*s.keys).agg(
        F.max(rate).alias("expected_rate"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(now).alias("n_hits"),
        F.count_if(~was & ~now).alias("_00"),
        F.count_if(~was & now).alias("_01"),
        F.count_if(was & ~now).alias("_10"),
        F.count_if(was & now).alias("_11"),
    )
    uc = kupiec_lr(F.col("n"), F.col("n_hits"), F.col("expected_rate"))
    ind = independence_lr(*[F.col(c) for c in ("_00", "_01", "_10", "_11")])
    return g.select(
        *s.keys,
        "expected_rate",
        "n",
        "n_hits",
        (F.col("n_hits") / F.col("n")).alias("observed_rate"),
        uc.alias("lr_uc"),
        ind.alias("lr_ind"),
        (uc + ind).alias("lr_cc"),
    )


def with_coverage_pvalues(t: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    return t.withColumns(
        {
            "p_uc": chi2_sf(F.col("lr_uc"), one),
            "p_ind": chi2_sf(F.col("lr_ind"), one),
            "p_cc": F.exp(-F.col("lr_cc") / 2),
        }
    )


def coverage_grid(df: DataFrame, s: Ordered, actual: str, var: str, levels: Sequence[float]):
    """The tests at every normal quantile level, below 0.5 the lower side."""
    d = normal_var_grid(df, var, levels).where(F.col(actual).isNotNull() & F.col("quantile").isNotNull())
    low = F.col("level") < 0.5
    hit = F.when(low, F.col(actual) < F.col("quantile")).otherwise(F.col(actual) > F.col("quantile"))
    d = d.withColumns({"hit": hit, "_rate": F.when(low, F.col("level")).otherwise(1 - F.col("level"))})
    return coverage_tests(d, s.by(*s.keys, "level"), "_rate")


def kupiec_by_state(hits: DataFrame, state: str, rate: float, keys: Sequence[str] = (), least: int = 20):
    """Kupiec per state and pooled (state null in the rollup)."""
    g = (
        hits.where(F.col("hit").isNotNull() & F.col(state).isNotNull())
        .rollup(*keys, state)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hits"))
    )
    for k in keys:
        g = g.where(F.col(k).isNotNull())
    ok = (F.col("n") >= least) | F.col(state).isNull()
    return g.select(
        *keys,
        F.coalesce(state, F.lit("_pooled")).alias("state"),
        "n",
        F.when(ok, F.col("n_hits") / F.col("n")).alias("observed_rate"),
        F.when(ok, kupiec_lr(F.col("n"), F.col("n_hits"), F.lit(rate))).alias("lr_uc"),
    )


def normal_var_grid(df: DataFrame, var: str, levels: Sequence[float]) -> DataFrame:
    """sigma * z_q at each level, one row per level."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(q).alias("level"), F.lit(norm_quantile(q)).alias("z")) for q in levels])
    )
    d = df.select("*", cells.alias("_q")).select(*df.columns, "_q.level", "_q.z")
    sd = F.when(F.col(var) > 0, F.sqrt(var))
    return d.withColumn("quantile", sd * F.col("z")).drop("z")


def normal_es(sd: Column, q: float) -> Column:
    return -sd * (norm_density(norm_quantile(q)) / q)


def gpd_var_es(q: Column | float, xi: Column, beta: Column, u: Column, n: Column, k: Column):
    """Peaks-over-threshold quantile and shortfall as positive magnitudes."""
    r = (F.lit(q) if isinstance(q, float) else q) * n / k
    z = F.when(F.abs(xi) > 1e-8, u + beta / xi * (F.pow(r, -xi) - 1)).otherwise(u - beta * F.log(r))
    es = F.when(xi < 1, z / (1 - xi) + (beta - xi * u) / (1 - xi))
    return z, es


def gpd_tail(df: DataFrame, keys: Sequence[str], z: str, frac: float = 0.1,
             tail: str = "lower", least: int = 30) -> DataFrame:
    """Threshold at the top share of one tail and a moment fit of the excesses:
    xi = (1 - m^2/v)/2, beta = m (m^2/v + 1)/2."""
    y = -F.col(z) if tail == "lower" else F.col(z)
    d = materialize(df.where(F.col(z).isNotNull()).select(*keys, y.alias("_y")))
    k = F.floor(F.lit(frac) * F.col("n")).cast("long")
    u = select_rank(d, keys, "_y", F.col("n") - k, {"_kk": k})
    u = u.select(*keys, "n", "_kk", F.col("value").alias("u"))
    ex = d.join(u.select(*keys, "u"), list(keys)).withColumn("_x", F.col("_y") - F.col("u")).where(F.col("_x") > 0)
    g = ex.groupBy(*keys).agg(
        F.avg("_x").alias("_m"), F.var_samp("_x").alias("_v"), F.count(F.lit(1)).alias("n_exceed")
    )
    g = g.join(u, list(keys)).where((F.col("_kk") >= least) & (F.col("n_exceed") >= least))
    h = F.col("_m") * F.col("_m") / F.col("_v")
    return g.select(
        *keys, "n", "n_exceed", "u", (0.5 * (1 - h)).alias("xi"), (0.5 * F.col("_m") * (h + 1)).alias("beta")
    )


def gpd_forecasts(df: DataFrame, var: str, levels: Sequence[float], tail_share: float = 0.1):
    """Quantile and shortfall per level from carried tail parameters
    (lo_* and hi_* of xi, beta, u, n_exceed) and the variance forecast."""
    d = df.select("*", F.explode(F.array(*[F.lit(q) for q in levels])).alias("level"))
    low = F.col("level") < 0.5

    def par(name: str) -> Column:
        return F.when(low, F.col(f"lo_{name}")).otherwise(F.col(f"hi_{name}"))

    q = F.when(low, F.col("level")).otherwise(1 - F.col("level"))
    k = par("n_exceed").cast("double")
    z, es = gpd_var_es(q, par("xi"), par("beta"), par("u"), F.floor(k / tail_share), k)
    sign = F.when(low, -1.0).otherwise(1.0)
    sd = F.when(F.col(var) > 0, F.sqrt(var))
    return d.withColumns({"var_q": sign * sd * z, "es_q": sign * sd * es})


def acerbi_szekely(df: DataFrame, keys: Sequence[str], a: str, v: str, e: str, q: float) -> DataFrame:
    """Sum(hit * a / es) / (n q) - 1; positive means risk was understated."""
    d = df.dropna(subset=[a, v, e]).where(F.col(e) != 0)
    hit = F.col(a) < F.col(v)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("n_hits"),
        F.sum(F.when(hit, F.col(a) / F.col(e)).otherwise(0.0)).alias("_s"),
    )
    z = F.when(F.col("n_hits") > 0, F.col("_s") / (F.col("n") * q) - 1)
    return g.select(*keys, "n", "n_hits", z.alias("z"))


def hill_path(
    df: DataFrame, keys: Sequence[str], x: str, tail: str, k_min: int, k_max: int
) -> DataFrame:
    """Tail index for every k in a range from one running sum of logs over the k_max + 1
    values of the largest size."""
    side = F.col(x) > 0 if tail == "upper" else F.col(x) < 0
    top = largest(df.where(side).select(*keys, F.abs(x).alias("_y")), keys, "_y", k_max + 1)
    w = Window.partitionBy(*keys).orderBy("rank")  # k_max + 1 rows
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = top.withColumns({"_sum": F.sum(F.log("_y")).over(upto), "_thr": F.lead("_y").over(w)})
    d = d.where(F.col("_thr").isNotNull() & (F.col("rank") >= max(k_min, 10)))
    xi = F.col("_sum") / F.col("rank") - F.log("_thr")
    return d.select(*keys, F.col("rank").alias("k"), F.when(xi > 0, F.try_divide(F.lit(1.0), xi)).alias("alpha"))


def hill_estimate(df: DataFrame, keys: Sequence[str], x: str, tail: str, k: int):
    p = hill_path(df, keys, x, tail, k, k)
    return p.select(*keys, "k", "alpha")


def hill_plateau(path: DataFrame, keys: Sequence[str], window: int, tol: float) -> DataFrame:
    """Widest run of windows whose relative spread stays under the tolerance."""
    s = Ordered(tuple(keys), ("k",), span=4096)

    def spread(w):
        f = w.rowsBetween(0, window - 1)
        med = F.percentile("alpha", 0.5).over(f)
        score = F.when(
            (F.count("alpha").over(f) == window) & (med > 0),
            (F.max("alpha").over(f) - F.min("alpha").over(f)) / med,
        )
        return {"_k_end": F.max("k").over(f), "_ok": score < tol}

    d = rolling(path.where(F.col("alpha").isNotNull()), s, spread, back=0, ahead=window)
    d = d.where("_ok")
    d = rolling(d, s, lambda w: {"_new": F.coalesce(F.col("k") - F.lag("k").over(w) > 1, F.lit(True))}, 1)
    d = running(
        d,
        s,
        {"_start": ("first", F.col("k")), "_len": ("sum", F.lit(1).cast("long"))},
        reset=F.col("_new"),
    )
    best = F.max_by(F.struct(F.col("_start").alias("k_lo"), F.col("_k_end").alias("k_hi")), F.struct("_len", -F.col("_start")))
    g = d.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    inside = path.join(g, list(keys)).where(F.col("k").between(F.col("k_lo"), F.col("k_hi")))
    q = quantiles(inside, keys, "alpha", {"alpha_median": 0.5})
    m = inside.groupBy(*keys, "k_lo", "k_hi").agg(
        F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max")
    )
    return m.join(q, list(keys)).withColumn("k_chosen", F.floor((F.col("k_lo") + F.col("k_hi")) / 2))


def moment_block(df: DataFrame, keys: Sequence[str], r: str, per_year: int = 252) -> DataFrame:
    g = df.groupBy(*keys).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("sd"),
        F.skewness(r).alias("skew"),
        F.kurtosis(r).alias("excess_kurtosis"),
    )
    jb = F.col("n") / 6 * (F.pow("skew", 2) + F.pow("excess_kurtosis", 2) / 4)
    return g.select(
        "*",
        jb.alias("jarque_bera"),
        (F.col("mean") * per_year).alias("ann_mean"),
        (F.col("sd") * math.sqrt(per_year)).alias("ann_vol"),
    )


def waiting_times(df: DataFrame, s: Ordered, r: str, k: float) -> DataFrame:
    """Row gaps between the events |z| >= k of each series."""
    d = df.where(F.col(r).isNotNull())
    m = d.groupBy(*s.keys).agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"))
    d = row_index(d, s, "_i").join(m, list(s.keys))
    d = d.where(F.abs(ratio(F.col(r) - F.col("_m"), "_s")) >= k)
    d = rolling(d, s, lambda w: {"wait": F.col("_i") - F.lag("_i").over(w)}, back=1)
    return d.where(F.col("wait").isNotNull()).select(*s.keys, *s.order, "wait")


def sign_runs(df: DataFrame, s: Ordered, r: str) -> DataFrame:
    """Lengths of same-sign runs, zeros removed first."""
    d = df.where(F.col(r) != 0).withColumn("_sg", F.signum(r).cast("int"))
    return runs(d, s, "_sg").select(*s.keys, *s.order, F.col("state").alias("sign"), "length")


def violation_blocks(hits: DataFrame, s: Ordered, size: int) -> DataFrame:
    """Hits in each full block of ``size`` rows (four blocks or more)."""
    d = row_index(hits.where(F.col("hit").isNotNull()), s, "_i")
    d = d.withColumn("block", F.floor((F.col("_i") - 1) / size))
    g = d.groupBy(*s.keys, "block").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("hit").alias("n_hits")
    )
    g = g.where(F.col("_n") == size).drop("_n")
    tot = g.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_b")).where(F.col("_b") >= 4)
    return g.join(tot.drop("_b"), list(s.keys), "left_semi")


def violation_durations(hits: DataFrame, s: Ordered) -> DataFrame:
    """Rows between hits, less one; from the first hit on (three or more)."""
    d = row_index(hits.where(F.col("hit").isNotNull()), s, "_i").where("hit")
    d = rolling(d, s, lambda w: {"duration": F.col("_i") - F.lag("_i").over(w) - 1}, back=1)
    n = d.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 3)
    d = d.join(n.drop("_n"), list(s.keys), "left_semi").where(F.col("duration").isNotNull())
    return d.select(*s.keys, *s.order, "duration")


def poisson_fit(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Rate and log-likelihood of block counts."""
    m = df.groupBy(*keys).agg(F.avg(c).alias("mu"), F.count(F.lit(1)).alias("n"))
    m = m.where((F.col("n") >= 4) & (F.col("mu") > 0))
    d = df.join(m, list(keys))
    ll = F.sum(poisson_log_score(F.col(c), F.col("mu")))
    return d.groupBy(*keys, "mu", "n").agg(ll.alias("loglik"))


def geometric_fit(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """q = mean / (mean + 1) and its log-likelihood (ten or more durations)."""
    g = df.groupBy(*keys).agg(F.avg(c).alias("_m"), F.sum(c).alias("_s"), F.count(F.lit(1)).alias("n"))
    q = F.col("_m") / (F.col("_m") + 1)
    g = g.where((F.col("n") >= 10) & (F.col("_m") > 0)).withColumn("q", q)
    ll = F.col("n") * F.log(1 - F.col("q")) + F.col("_s") * F.log("q")
    return g.select(*keys, "q", "n", ll.alias("loglik"))


def duration_ks(lengths: DataFrame, keys: Sequence[str], c: str = "length") -> DataFrame:
    """KS distance of run lengths from a geometric law with their own mean."""
    m = lengths.groupBy(*keys).agg(F.avg(c).alias("mean_duration"), F.count(F.lit(1)).alias("n_runs"))
    v = value_ranks(lengths.select(*keys, c), keys, c).join(m, list(keys))
    p = 1 / F.col("mean_duration")
    cdf = 1 - F.pow(1 - p, F.col(c))
    below = 1 - F.pow(1 - p, F.col(c))
    hi = F.abs(F.col("_cum") / F.col("n_runs") - cdf)
    lo = F.abs(below - (F.col("_cum") - F.col("_n")) / F.col("n_runs"))
    return v.groupBy(*keys, "mean_duration", "n_runs").agg(F.max(F.greatest(hi, lo)).alias("ks_stat"))


def stats_by_state(df: DataFrame, s: Ordered, r: str, state: str, least: int = 10) -> DataFrame:
    """Moments and lag-1 autocorrelation of the rows of each state, taken as
    one series."""
    d = df.where(F.col(r).isNotNull() & F.col(state).isNotNull())
    by = s.by(*s.keys, state)
    d = rolling(d, by, lambda w: {"_p": F.lag(r).over(w)}, back=1)
    g = d.groupBy(*by.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_pop(r).alias("std"),
        F.skewness(r).alias("skew"),
        (F.kurtosis(r) + 3).alias("kurtosis"),
        F.corr("_p", r).alias("_ac"),
    )
    g = g.withColumn("autocorr_lag1", F.when(F.col("n") > 20, F.col("_ac"))).drop("_ac")
    return g.where(F.col("n") >= least)


def mixture(df: DataFrame, x: str, k: int, seed: int = 7):
    """Gaussian mixture over all rows; components ordered by variance. Returns
    the parameter table and the rows with their posteriors."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=[x], outputCol="_x").transform(df.where(F.col(x).isNotNull()))
    model = GaussianMixture(featuresCol="_x", k=k, seed=seed, maxIter=50).fit(d)
    pars = [
        (float(w), float(g.mean[0]), float(g.cov.toArray()[0][0]))
        for w, g in zip(model.weights, model.gaussians, strict=True)
    ]
    order = sorted(range(k), key=lambda i: pars[i][2])
    table = df.sparkSession.createDataFrame(
        [(j, *pars[i]) for j, i in enumerate(order)],
        "component int, weight double, mean double, variance double",
    )
    post = vector_to_array("probability")
    rows = model.transform(d).withColumn("_post", post)
    rows = rows.select(*df.columns, *[F.col("_post")[i].alias(f"p_{j}") for j, i in enumerate(order)])
    return table, rows


def carry_forward(df: DataFrame, s: Ordered, c: str, out: str) -> DataFrame:
    """Value of the latest refit at or before each row."""
    return running(df, s, {out: ("last", F.col(c))})


def pseudo_uniform(df: DataFrame, keys: Sequence[str], x: str, ties: Sequence[str], out: str):
    """(rank - 0.5) / n."""
    d = row_numbers(df.where(F.col(x).isNotNull()), keys, x, ties, "_rn", "_n")
    return d.withColumn(out, (F.col("_rn") - 0.5) / F.col("_n")).drop("_rn", "_n")


def tail_dependence(u: DataFrame, time: str, key: str, c: str, q: float) -> DataFrame:
    """P(U_b <= q given U_a <= q) for each ordered pair of keys."""
    at = row_index(u.select(time).distinct(), Ordered((), (time,)), "_i")
    d = u.join(at.select(time, (F.col("_i") - 1).alias("_i")), time)
    g = joint_below(d.where(F.col(c).isNotNull()), key, "_i", c, q)
    return g.select("a", "b", (F.col("hits") / F.col("n")).alias("tail_dependence"), F.col("n").cast("long").alias("n"))


def portfolio_var(
    returns: DataFrame, weights: DataFrame, s: Ordered, ret: str, n_boot: int, seed: int = 0
) -> DataFrame:
    """VaR and ES of a weighted portfolio at 1% and 5%, with a bootstrap over
    whole dates: per replicate the portfolio return of drawn dates."""
    t = s.order[0]
    p = returns.join(weights, list(s.keys)).groupBy(t).agg(F.sum(F.col(ret) * F.col("weight")).alias("p"))
    p = materialize(row_index(p.where(F.col("p").isNotNull()), s.by(), "_i"))
    n = p.agg(F.max("_i").alias("_n"))
    d = p.select("_i").crossJoin(F.broadcast(n))  # one row
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    pick = hash_int(F.lit(str(seed)), "rep", "_i") % F.col("_n") + 1
    d = d.select("rep", pick.alias("_i")).join(p, "_i")
    # a replicate has one row per date: bounded by the calendar
    g = d.groupBy("rep").agg(F.percentile("p", 0.01).alias("var_1"), F.percentile("p", 0.05).alias("var_5"))
    e = d.join(g, "rep").groupBy("rep", "var_1", "var_5").agg(
        F.avg(F.when(F.col("p") <= F.col("var_1"), F.col("p"))).alias("es_1"),
        F.avg(F.when(F.col("p") <= F.col("var_5"), F.col("p"))).alias("es_5"),
    )
    out = []
    for c in ("var_1", "es_1", "var_5", "es_5"):
        out += [F.avg(c).alias(c), F.percentile(c, 0.025).alias(f"{c}_lo"), F.percentile(c, 0.975).alias(f"{c}_hi")]
    return e.agg(*out)


def tail_by_state(df: DataFrame, keys: Sequence[str], r: str, state: str, k: int):
    """Lower and upper tail index and the 1% shortfall within each state."""
    by = [*keys, state]
    d = materialize(df.where(F.col(r).isNotNull() & F.col(state).isNotNull()).select(*by, r))
    lo = hill_estimate(d, by, r, "lower", k).select(*by, F.col("alpha").alias("alpha_lower"))
    hi = hill_estimate(d, by, r, "upper", k).select(*by, F.col("alpha").alias("alpha_upper"))
    cut = select_rank(d, by, r, F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.01))))
    under = d.join(cut.select(*by, F.col("value").alias("_u")), by).where(F.col(r) < F.col("_u"))
    under = under.groupBy(*by).agg(F.sum(r).alias("_under"))
    rest = (F.col("rank") - F.col("below")) * F.col("value")  # copies of the cut value
    es = cut.join(under, by, "left").select(*by, "n", ((F.coalesce("_under", F.lit(0.0)) + rest) / F.col("rank")).alias("es_1pct"))
    return es.join(lo, by, "left").join(hi, by, "left")


def dispersion(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.var_pop(c), F.avg(c)).alias("dispersion_index"))


def normalized_range(df: DataFrame, keys: Sequence[str], hl: str, r: str) -> DataFrame:
    """Mean log range over sigma against the Brownian 2 sqrt(2 / pi)."""
    m = df.groupBy(*keys).agg(ratio(F.avg(hl), F.stddev_pop(r)).alias("range_mean"))
    b = 2 * math.sqrt(2 / math.pi)
    return m.withColumn("excess_pct", (F.col("range_mean") / b - 1) * 100)


def density_scores(df: DataFrame, s: Ordered, actual: str, var: str) -> DataFrame:
    """Mean log score and CRPS of a normal forecast, and coverage at 5%."""
    d = df.where(F.col(actual).isNotNull() & (F.col(var) > 0))
    a, v = F.col(actual), F.col(var)
    g = d.withColumns(
        {"_ls": normal_log_score(a, F.lit(0.0), v), "_c": normal_crps(a, F.lit(0.0), F.sqrt(v))}
    ).groupBy(*s.keys).agg(F.avg("_ls").alias("log_score"), F.avg("_c").alias("crps"))
    hits = d.withColumns({"hit": a < F.sqrt(v) * norm_quantile(0.05), "_rate": F.lit(0.05)})
    return g.join(with_coverage_pvalues(coverage_tests(hits, s, "_rate")), list(s.keys))
