"""Queries over volatility and tail risk (inventory 2.K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import log_return
from ..functions.ordered import WEEKLY, rolling
from ..functions.special import norm_density, norm_quantile
from ..operators import bars as B
from ..operators import vol as V
from . import sqlgen as S
from .inference import returns_w, vols
from .registry import query, rounded, view

UP = "rows unbounded preceding"


def rec_sql(src: str) -> str:
    """y = a * y + b along each symbol of a source (symbol, datetime, a, b)."""
    return f"""with recursive z0 as ({src}), z as (select *, row_number() over (partition by symbol order by datetime) as i from z0),
y as (select symbol, datetime, i, cast(b as double) as v from z where i = 1 union all select z.symbol, z.datetime, z.i, z.a * y.v + z.b from y join z on z.symbol = y.symbol and z.i = y.i + 1)
"""


@query(
    "215",
    f"select symbol, datetime, round({S.roll('var_samp', 'log_return', 26, need=14, shift=1)}, 6) as fc from feat1",
)
def trailing_variance(t):
    d = rolling(returns_w(t), WEEKLY, lambda w: {"fc": V.trailing_variance(w, "log_return", 26)}, 27)
    return rounded(d.select("symbol", "datetime", "fc"))


EWMA_SRC = """select symbol, datetime, case when i = 1 then 0 else 0.94e0 end as a, case when i = 1 then v0 else 0.06e0 * lag(sq) over (partition by symbol order by datetime) end as b from (
select *, var_pop(case when i <= 50 then sq end) over (partition by symbol) as v0 from (select symbol, datetime, coalesce(log_return * log_return, 0) as sq, row_number() over (partition by symbol order by datetime) as i from feat1))"""


@query("216", rec_sql(EWMA_SRC) + "select symbol, datetime, round(v, 6) as fc from y")
def ewma_variance(t):
    d = V.ewma_variance(returns_w(t), WEEKLY, "log_return", 0.94, "fc")
    return rounded(d.select("symbol", "datetime", "fc"))


VOL_SRC = """select symbol, datetime, case when i > 21 then 0.94e0 else 0 end as a, case when i > 21 then 0.06e0 * pr * pr when i = 21 then v0 else 0 end as b from (
select *, var_pop(case when i <= 20 then r end) over (partition by symbol) as v0, lag(r) over (partition by symbol order by datetime) as pr from (
 select symbol, datetime, log_return as r, row_number() over (partition by symbol order by datetime) as i from feat1 where log_return is not null))"""


@query(
    "217",
    rec_sql(VOL_SRC) + "select symbol, datetime, round(case when i > 20 then sqrt(v) end, 6) as fc from y",
)
def ewma_vol(t):
    d = V.ewma_vol(returns_w(t), WEEKLY, "log_return", 0.94, "fc")
    return rounded(d.select("symbol", "datetime", "fc"))


def _garch(g: float) -> str:
    return f"""select symbol, datetime, case when p is null then 0 else 0.85e0 end as a, case when p is null then 0.3e0 else 0.01e0 + 0.08e0 * p * p + case when p < 0 then {g}e0 * p * p else 0 end end as b from (
 select symbol, datetime, lag(log_return) over (partition by symbol order by datetime) as p from feat1 where log_return is not null)"""


@query("268", rec_sql(_garch(0)) + "select symbol, datetime, round(v, 6) as sig2 from y")
def garch_filter(t):
    d = V.garch_variance(
        returns_w(t), WEEKLY, "log_return", 0.01, 0.08, 0.85, F.lit(0.3), "sig2"
    )
    return rounded(d.select("symbol", "datetime", "sig2"))


@query("269", rec_sql(_garch(0.05)) + "select symbol, datetime, round(v, 6) as sig2 from y")
def gjr_filter(t):
    d = V.garch_variance(
        returns_w(t), WEEKLY, "log_return", 0.01, 0.08, 0.85, F.lit(0.3), "sig2", 0.05
    )
    return rounded(d.select("symbol", "datetime", "sig2"))


@query(
    "218",
    f"""select symbol, datetime, round({S.mean("rv", 1, need=1, shift=1)}, 6) as rv_d, round({S.mean("rv", 5, need=1, shift=1)}, 6) as rv_w,
 round({S.mean("rv", 22, need=1, shift=1)}, 6) as rv_m from vols""",
)
def har_features(t):
    d = rolling(vols(t), WEEKLY, lambda w: V.har_features(w, "rv"), 23)
    return rounded(d.select("symbol", "datetime", "rv_d", "rv_w", "rv_m"))


@query(
    "220",
    f"""with a as (select symbol, datetime, rv, {S.mean("rv", 5, need=1, shift=1)} as x, row_number() over ({S.W}) - 1 as i from vols),
b as (select *, regr_slope(rv, x) over w as k, regr_intercept(rv, x) over w as c, count(case when rv is not null and x is not null then 1 end) over w as n
 from a window w as (partition by symbol order by datetime rows between unbounded preceding and 1 preceding)),
e as (select *, i >= 52 and n > 6 as ok, coalesce(lag(i >= 52 and n > 6) over ({S.W}), false) as was from b),
f as (select *, last_value(case when ok and (i % 13 = 0 or not was) then k end ignore nulls) over ({S.W}) as kk,
  last_value(case when ok and (i % 13 = 0 or not was) then c end ignore nulls) over ({S.W}) as cc from e)
select symbol, datetime, round(cc + kk * x, 6) as fc from f""",
)
def refit_forecast(t):
    d = rolling(vols(t), WEEKLY, lambda w: {"x": V.har_features(w, "rv")["rv_w"]}, 6)
    d = V.refit_forecast(d, WEEKLY, ["x"], "rv", 13, 52, "fc")
    return rounded(d.select("symbol", "datetime", "fc"))


@query("219")
def log_har_forecast(t):
    d = V.log_har_forecast(vols(t), WEEKLY, "rv", 26, 52, 52)
    return rounded(d.select("symbol", "datetime", "fc_log_har"))


@query("221")
def activity_forecast(t):
    d = vols(t).join(t.bars_w().select("symbol", "datetime", "count"), ["symbol", "datetime"])
    d = rolling(d, WEEKLY, lambda w: V.activity_features(w, "count", 26), 27)
    d = V.refit_forecast(d, WEEKLY, ["count_mean", "count_dispersion"], "rv", 26, 78, "fc")
    return rounded(d.select("symbol", "datetime", "fc"))


view(
    "anatomy",
    """select symbol, datetime, log_return, ln(high / low) as hl, ln(open / lag(close) over w) as gap, ln(close / open) as co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) as rs
from feat1 window w as (partition by symbol order by datetime)""",
)
_n = 26
_k = 0.34 / (1.34 + (_n + 1) / (_n - 1))
_rs, _vo, _vc = (
    S.mean("rs", _n, need=14, shift=1),
    S.roll("var_samp", "gap", _n, need=14, shift=1),
    S.roll("var_samp", "co", _n, need=14, shift=1),
)


@query(
    "222",
    f"""select symbol, datetime, round({S.mean("hl * hl / (4 * ln(2))", _n, need=14, shift=1)}, 6) as fc_parkinson,
 round({S.mean("0.5 * hl * hl - (2 * ln(2) - 1) * co * co", _n, need=14, shift=1)}, 6) as fc_gk, round({_rs}, 6) as fc_rs,
 round(({_vo}) + {_k} * ({_vc}) + (1 - {_k}) * ({_rs}), 6) as fc_yz from anatomy""",
)
def range_forecasts(t):
    b = t.bars_w().select(
        "symbol", "datetime", "open", "high", "low", "close", "volume", "taker_buy_volume"
    )
    d = rolling(B.asset_frame(b, None, WEEKLY), WEEKLY, lambda w: V.range_forecasts(w, 26), 27)
    return rounded(d.select("symbol", "datetime", "fc_parkinson", "fc_gk", "fc_rs", "fc_yz"))


@query(
    "223, 224",
    """select symbol, count(case when fc > 0 and rv >= 0 then 1 end) as n, count(case when fc > 0 and rv > 0 then 1 end) as n_qlike,
 round(avg(case when fc > 0 and rv > 0 then rv / fc - ln(rv / fc) - 1 end), 6) as qlike, round(avg(case when fc > 0 and rv >= 0 then (rv - fc) * (rv - fc) end), 6) as mse from vols group by 1""",
)
def qlike_and_mse(t):
    return rounded(V.qlike_mse(vols(t), ["symbol"], "rv", "fc"))


def _fr(c, n=52):
    return f"over ({S.W} rows between {n - 1} preceding and current row)"


FULL = f"count(log_return) {_fr('')} = 52"
FC = "symbol, datetime, log_return, count, taker_buy_ratio"


@query(
    "225, 226, 227, 228",
    f"""with a as (select {FC}, count(log_return) {_fr("")} as n, avg(log_return) {_fr("")} as m, stddev_pop(log_return) {_fr("")} as s,
 count(count) {_fr("")} as cn, avg(count) {_fr("")} as cm, var_pop(count) {_fr("")} as cv,
 count(taker_buy_ratio) {_fr("")} as tn, avg(taker_buy_ratio) {_fr("")} as tm, var_pop(taker_buy_ratio) {_fr("")} as tv, min(taker_buy_ratio) {_fr("")} as lo, max(taker_buy_ratio) {_fr("")} as hi from feat1)
select symbol, datetime, round(case when n >= 52 and s > 1e-12 then m end, 6) as log_return_normal_loc, round(case when n >= 52 and s > 1e-12 then s end, 6) as log_return_normal_scale,
 round(case when cn >= 52 and cm > 0 then cm end, 6) as count_poisson_mu,
 round(case when cn >= 52 and cm > 0 and cv > cm then cm * (cm / cv) / (1 - cm / cv) end, 4) as count_nbinom_n, round(case when cn >= 52 and cm > 0 and cv > cm then cm / cv end, 6) as count_nbinom_p,
 round(case when tn >= 52 and lo > 0 and hi < 1 and tv > 1e-12 and tm * (1 - tm) / tv - 1 > 0 then tm * (tm * (1 - tm) / tv - 1) end, 6) as taker_buy_ratio_beta_alpha,
 round(case when tn >= 52 and lo > 0 and hi < 1 and tv > 1e-12 and tm * (1 - tm) / tv - 1 > 0 then (1 - tm) * (tm * (1 - tm) / tv - 1) end, 6) as taker_buy_ratio_beta_beta from a""",
)
def rolling_fits(t):
    def base(w):
        from ..functions.exprs import ratio

        return {
            "log_return": log_return(w),
            "taker_buy_ratio": ratio("taker_buy_volume", "volume"),
        }

    def fits(w):
        return {
            **V.rolling_fit(w, "log_return", "normal", 52),
            **V.rolling_fit(w, "count", "poisson", 52),
            **V.rolling_fit(w, "count", "nbinom", 52),
            **V.rolling_fit(w, "taker_buy_ratio", "beta", 52),
        }

    d = rolling(t.bars_w(), WEEKLY, [base, fits], 53)
    keep = [c for c in d.columns if any(f"_{f}_" in c for f in ("normal", "poisson", "nbinom", "beta"))]
    d = d.select("symbol", "datetime", *keep)
    return rounded(d.withColumn("count_nbinom_n", F.round("count_nbinom_n", 4)))


@query(
    "229",
    f"""select symbol, count(*) as n_rows, count(case when n < 52 then 1 end) as n_insufficient, count(case when n >= 52 and not coalesce(v > m, false) then 1 end) as n_degenerate,
 count(case when n >= 52 and v > m then 1 end) as n_fit from (select symbol, count(count) {_fr("")} as n, avg(count) {_fr("")} as m, var_pop(count) {_fr("")} as v from feat1) group by 1""",
)
def fit_counts(t):
    return V.fit_counts(t.bars_w().select("symbol", "datetime", "count"), WEEKLY, "count", "nbinom", 52)


@query(
    "230",
    "select symbol, round(avg(log_return), 6) as normal_loc, round(stddev_pop(log_return), 6) as normal_scale from feat1 group by 1",
)
def whole_sample_fit(t):
    return rounded(V.whole_fit(returns_w(t), ["symbol"], "log_return", "normal"))


@query(
    "232",
    """select v.symbol, v.datetime, round(case when fc > 0 then -0.5 * (ln(2 * pi()) + ln(fc) + log_return * log_return / fc) end, 6) as log_score from vols v join feat1 f on v.symbol = f.symbol and v.datetime = f.datetime""",
)
def normal_log_score(t):
    d = vols(t).join(returns_w(t).drop("close"), ["symbol", "datetime"])
    sc = V.normal_log_score(F.col("log_return"), F.lit(0.0), F.col("fc"))
    return rounded(d.select("symbol", "datetime", sc.alias("log_score")))


VR = "from vols v join feat1 f on v.symbol = f.symbol and v.datetime = f.datetime"
LOG_SCORE = "-0.5 * (ln(2 * pi()) + ln(fc) + log_return * log_return / fc)"
CRPS = f"sqrt(fc) * (z * (2 * {S.cdf('z')} - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))"


@query(
    "231, 233, 234",
    f"""select symbol, datetime, round({LOG_SCORE}, 6) as log_score, round({CRPS}, 6) as crps, round({S.cdf("z")}, 6) as pit from (
 select v.symbol, v.datetime, log_return, case when fc > 0 then fc end as fc, case when fc > 0 then log_return / sqrt(fc) end as z {VR})""",
)
def normal_scores(t):
    d = vols(t).join(returns_w(t).drop("close"), ["symbol", "datetime"])
    r, sd = F.col("log_return"), F.sqrt("fc")
    return rounded(
        d.select(
            "symbol",
            "datetime",
            V.normal_log_score(r, F.lit(0.0), F.col("fc")).alias("log_score"),
            V.normal_crps(r, F.lit(0.0), sd).alias("crps"),
            V.pit(r, F.lit(0.0), sd).alias("pit"),
        )
    )


@query(
    "235",
    """with a as (select symbol, 1 - exp(-rv / fc) as u from vols where fc > 0 and rv is not null),
b as (select symbol, u, row_number() over (partition by symbol order by u) as i, count(*) over (partition by symbol) as n from a)
select symbol, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) as ks_stat, max(n) as n from b group by 1""",
)
def pit_ks_statistic(t):
    d = vols(t).where("fc > 0 and rv is not null")
    d = d.select("symbol", (1 - F.exp(-F.col("rv") / F.col("fc"))).alias("u"))
    return rounded(V.ks_uniform(d, ["symbol"], "u"))


Q05 = norm_quantile(0.05)
view(
    "hits",
    f"select v.symbol, v.datetime, log_return, fc, log_return < sqrt(fc) * ({Q05}) as hit from vols v join feat1 f on v.symbol = f.symbol and v.datetime = f.datetime where fc > 0 and log_return is not null",
)


def hits(t):
    d = vols(t).join(returns_w(t).drop("close"), ["symbol", "datetime"])
    d = d.where("fc > 0 and log_return is not null")
    hit = V.exceeds(F.col("log_return"), F.sqrt("fc") * Q05)
    return d.select("symbol", "datetime", "log_return", "fc", hit.alias("hit"))


@query("236", "select symbol, datetime, hit from hits")
def exceedances(t):
    return hits(t).select("symbol", "datetime", "hit")


def _xl(x: str, y: str) -> str:
    return f"case when {x} = 0 then 0 else {x} * ln({y}) end"


def cov_sql(src: str, keys: str, rate: str) -> str:
    """Coverage statistics of a source with hit and optional rate column."""
    return f"""select *, lr_uc + lr_ind as lr_cc from (select {keys}, p as expected_rate, n, x as n_hits, x / n as observed_rate,
 -2 * ({_xl("x", "p")} + {_xl("(n - x)", "(1 - p)")} - {_xl("x", "(x / n)")} - {_xl("(n - x)", "(1 - x / n)")}) as lr_uc,
 -2 * ({_xl("(a01 + a11)", "((a01 + a11) / (a00 + a01 + a10 + a11))")} + {_xl("(a00 + a10)", "(1 - (a01 + a11) / (a00 + a01 + a10 + a11))")}
  - {_xl("a01", "(a01 / (a00 + a01))")} - {_xl("a00", "(1 - a01 / (a00 + a01))")} - {_xl("a11", "(a11 / (a10 + a11))")} - {_xl("a10", "(1 - a11 / (a10 + a11))")}) as lr_ind
from (select {keys}, max({rate}) as p, count(*) as n, count(case when hit then 1 end) as x, count(case when not pv and not hit then 1 end) as a00, count(case when not pv and hit then 1 end) as a01,
 count(case when pv and not hit then 1 end) as a10, count(case when pv and hit then 1 end) as a11 from (select *, lag(hit) over (partition by {keys} order by datetime) as pv from {src}) group by {keys}))"""


COV = S.rnd("expected_rate observed_rate lr_uc lr_ind lr_cc")


@query("237, 238, 239", f"select symbol, n, n_hits, {COV} from ({cov_sql('hits', 'symbol', '0.05e0')})")
def coverage_tests(t):
    d = hits(t).withColumn("rate", F.lit(0.05))
    return rounded(V.coverage_tests(d, WEEKLY, "rate"))


P_COLS = f"round({S.chi2_tail('lr_uc', 1)}, 6) as p_uc, round({S.chi2_tail('lr_ind', 1)}, 6) as p_ind, round(exp(-lr_cc / 2), 6) as p_cc"


@query("237, 238, 239", f"select symbol, n, n_hits, {COV}, {P_COLS} from ({cov_sql('hits', 'symbol', '0.05e0')})")
def coverage_pvalues(t):
    d = hits(t).withColumn("rate", F.lit(0.05))
    return rounded(V.with_coverage_pvalues(V.coverage_tests(d, WEEKLY, "rate")))


LEVELS = (0.01, 0.05, 0.95, 0.99)
GRID = "(select symbol, datetime, q as level, case when q < 0.5 then q else 1 - q end as rate, case when q < 0.5 then log_return < sqrt(fc) * z else log_return > sqrt(fc) * z end as hit from (select *, unnest([{}]::double[]) as q, unnest([{}]::double[]) as z from hits))".format(
    ", ".join(map(str, LEVELS)), ", ".join(str(norm_quantile(q)) for q in LEVELS)
)


@query(
    "240, 242",
    f"select symbol, level, n, n_hits, {COV} from ({cov_sql(GRID, 'symbol, level', 'rate')})",
)
def coverage_grid(t):
    return rounded(V.coverage_grid(hits(t).drop("hit"), WEEKLY, "log_return", "fc", LEVELS))


@query(
    "242, 243",
    f"""select symbol, datetime, round(sqrt(fc) * ({norm_quantile(0.01)}), 6) as var_1, round(-sqrt(fc) * {norm_density(norm_quantile(0.01)) / 0.01}, 6) as es_1 from hits""",
)
def normal_var_es(t):
    d = V.normal_var_grid(hits(t), "fc", [0.01])
    return rounded(
        d.select(
            "symbol",
            "datetime",
            F.col("quantile").alias("var_1"),
            V.normal_es(F.sqrt("fc"), 0.01).alias("es_1"),
        )
    )


view(
    "hit_state",
    "select h.*, case when h.fc < 0.3 then 'calm' when h.fc < 0.6 then 'mid' else 'wild' end as st from hits h",
)


def hit_state(t):
    st = F.when(F.col("fc") < 0.3, "calm").when(F.col("fc") < 0.6, "mid").otherwise("wild")
    return hits(t).withColumn("st", st)


@query(
    "241",
    f"""with g as (select symbol, st, count(*) as n, count(case when hit then 1 end) as x from hit_state group by rollup (symbol, st) having symbol is not null)
select symbol, coalesce(st, '_pooled') as state, n, round(case when n >= 20 or st is null then x / n end, 6) as observed_rate,
 round(case when n >= 20 or st is null then -2 * ({_xl("x", "0.05e0")} + {_xl("(n - x)", "0.95e0")} - {_xl("x", "(x / n)")} - {_xl("(n - x)", "(1 - x / n)")}) end, 6) as lr_uc from g""",
)
def kupiec_by_state(t):
    return rounded(V.kupiec_by_state(hit_state(t), "st", 0.05, ["symbol"]))


@query(
    "246",
    f"""select symbol, count(*) as n, count(case when hit then 1 end) as n_hits, round(case when count(case when hit then 1 end) > 0 then sum(case when hit then log_return / (-sqrt(fc) * {norm_density(Q05) / 0.05}) else 0 end) / (count(*) * 0.05) - 1 end, 6) as z from hits group by 1""",
)
def acerbi_szekely(t):
    d = hits(t).withColumns(
        {"v": F.sqrt("fc") * Q05, "e": V.normal_es(F.sqrt("fc"), 0.05)}
    )
    return rounded(V.acerbi_szekely(d, ["symbol"], "log_return", "v", "e", 0.05))


view(
    "gpd_fit",
    """with a as (select symbol, -log_return as y, row_number() over (partition by symbol order by -log_return desc, datetime desc) as d, count(*) over (partition by symbol) as n from feat1 where log_return is not null),
u as (select symbol, max(case when d = floor(n * 0.1e0) + 1 then y end) as u, max(n) as n from a group by 1),
e as (select a.symbol, y - u as x from a join u on a.symbol = u.symbol where d <= floor(a.n * 0.1e0) and y > u)
select e.symbol, max(u.n) as n, count(*) as n_exceed, max(u.u) as u, 0.5 * (1 - avg(x) * avg(x) / var_samp(x)) as xi, 0.5 * avg(x) * (avg(x) * avg(x) / var_samp(x) + 1) as beta
from e join u on e.symbol = u.symbol group by 1 having count(*) >= 30""",
)


def gpd(t, tail="lower"):
    return V.gpd_tail(returns_w(t), ["symbol"], "log_return", 0.1, tail)


@query("245", f"select symbol, n, n_exceed, {S.rnd('u xi beta')} from gpd_fit")
def gpd_tail_fit(t):
    return rounded(gpd(t))


GZ = "case when abs(xi) > 1e-8 then u + beta / xi * (power(0.01 * n / n_exceed, -xi) - 1) else u - beta * ln(0.01 * n / n_exceed) end"


@query(
    "244",
    f"select symbol, round(z, 6) as var_1, round(case when xi < 1 then z / (1 - xi) + (beta - xi * u) / (1 - xi) end, 6) as es_1 from (select *, {GZ} as z from gpd_fit)",
)
def gpd_var_es(t):
    g = gpd(t)
    z, es = V.gpd_var_es(0.01, F.col("xi"), F.col("beta"), F.col("u"), F.col("n"), F.col("n_exceed"))
    return rounded(g.select("symbol", z.alias("var_1"), es.alias("es_1")))


@query(
    "262, 270, 271",
    """with r as (select h.symbol, h.datetime, h.fc, row_number() over (partition by h.symbol order by h.datetime) as i, g.xi, g.beta, g.u, g.n_exceed from hits h join gpd_fit g on h.symbol = g.symbol),
c as (select symbol, datetime, fc, last_value(case when i % 26 = 1 then xi end ignore nulls) over w as xi, last_value(case when i % 26 = 1 then beta end ignore nulls) over w as beta,
 last_value(case when i % 26 = 1 then u end ignore nulls) over w as u, last_value(case when i % 26 = 1 then n_exceed end ignore nulls) over w as k from r window w as (partition by symbol order by datetime)),
z as (select *, u + beta / xi * (power(q * floor(k / 0.1e0) / k, -xi) - 1) as z from (select *, unnest([0.01, 0.05]::double[]) as q from c))
select symbol, datetime, q as level, round(-sqrt(fc) * z, 6) as var_q, round(-sqrt(fc) * (case when xi < 1 then z / (1 - xi) + (beta - xi * u) / (1 - xi) end), 6) as es_q from z""",
)
def gpd_forecast_grid(t):
    d = V.row_index(hits(t), WEEKLY, "_i").join(gpd(t).drop("n"), "symbol")
    for c in ("xi", "beta", "u", "n_exceed"):
        d = d.withColumn(f"_{c}", F.when(F.col("_i") % 26 == 1, F.col(c)))
        d = V.carry_forward(d, WEEKLY, f"_{c}", f"lo_{c}").withColumn(f"hi_{c}", F.col(f"lo_{c}"))
    d = V.gpd_forecasts(d, "fc", [0.01, 0.05])
    return rounded(d.select("symbol", "datetime", "level", "var_q", "es_q"))


def hill_sql(src: str, part: str, lo: int, hi: int, sign: str) -> str:
    return f"""select {part}, k, case when s / k - ln(thr) > 0 then 1 / (s / k - ln(thr)) end as alpha from (
 select *, sum(ln(y)) over (partition by {part} order by y desc, datetime rows unbounded preceding) as s, lead(y) over (partition by {part} order by y desc, datetime) as thr,
  row_number() over (partition by {part} order by y desc, datetime) as k from (select *, abs(log_return) as y from {src} where log_return {sign} 0)) where k between {lo} and {hi} and thr is not null"""


@query("247", f"select symbol, k, round(alpha, 6) as alpha from ({hill_sql('feat1', 'symbol', 25, 25, '<')})")
def hill_estimator(t):
    return rounded(V.hill_estimate(returns_w(t), ["symbol"], "log_return", "lower", 25))


view("hillp", hill_sql("feat1", "symbol", 10, 80, ">"))


def hillp(t):
    return V.hill_path(returns_w(t), ["symbol"], "log_return", "upper", 10, 80)


@query("248", "select symbol, k, round(alpha, 6) as alpha from hillp")
def hill_path(t):
    return rounded(hillp(t))


@query(
    "249",
    """with a as (select symbol, k, max(k) over w as ke, case when count(alpha) over w = 12 and quantile_cont(alpha, 0.5) over w > 0 then (max(alpha) over w - min(alpha) over w) / quantile_cont(alpha, 0.5) over w end as sc
 from hillp window w as (partition by symbol order by k rows between current row and 11 following)),
b as (select *, case when k - lag(k) over (partition by symbol order by k) = 1 then 0 else 1 end as nw from a where sc < 0.12e0),
c as (select *, sum(nw) over (partition by symbol order by k) as g from b),
r as (select symbol, g, min(k) as k_lo, max(ke) as k_hi, count(*) as len from c group by 1, 2),
m as (select * from (select *, row_number() over (partition by symbol order by len desc, k_lo) as rn from r) where rn = 1)
select m.symbol, k_lo, k_hi, round(min(alpha), 6) as alpha_min, round(max(alpha), 6) as alpha_max, round(quantile_cont(alpha, 0.5), 6) as alpha_median, (k_lo + k_hi) // 2 as k_chosen
from m join hillp p on m.symbol = p.symbol and p.k between k_lo and k_hi group by m.symbol, k_lo, k_hi""",
)
def hill_plateau(t):
    return rounded(V.hill_plateau(hillp(t), ["symbol"], 12, 0.12))


@query(
    "250",
    """select *, round(n / 6 * (skew0 * skew0 + ek0 * ek0 / 4), 4) as jarque_bera from (select symbol, count(log_return) as n, round(avg(log_return), 6) as mean, round(stddev_pop(log_return), 6) as sd, round(avg(log_return) * 52, 6) as ann_mean,
 round(stddev_pop(log_return) * sqrt(52), 6) as ann_vol, round(sk, 6) as skew, sk as skew0, round(kurtosis_pop(log_return), 6) as excess_kurtosis, kurtosis_pop(log_return) as ek0 from (
 select *, avg(power(z, 3)) over (partition by symbol) as sk from (select symbol, log_return, (log_return - avg(log_return) over (partition by symbol)) / stddev_pop(log_return) over (partition by symbol) as z from feat1 where log_return is not null)) group by symbol, sk)""".replace(
        "select *, round(n / 6", "select * exclude (skew0, ek0), round(n / 6"
    ),
)
def moment_block(t):
    d = V.moment_block(returns_w(t), ["symbol"], "log_return", 52)
    return rounded(d.withColumn("jarque_bera", F.round("jarque_bera", 4)))


@query(
    "251",
    f"""select symbol, round(min(e - m), 6) as max_drawdown from (select *, max(e) over ({S.W} {UP}) as m from (select symbol, datetime, sum(log_return) over ({S.W} {UP}) as e from feat1 where log_return is not null)) group by 1""",
)
def max_drawdown(t):
    from ..functions.ordered import equity

    d = equity(returns_w(t).where("log_return is not null"), WEEKLY, {"log_return": ("e", "dd")})
    return rounded(d.groupBy("symbol").agg(F.min("dd").alias("max_drawdown")))


@query(
    "252",
    """with a as (select *, row_number() over (partition by symbol order by datetime) as i, (log_return - avg(log_return) over (partition by symbol)) / stddev_pop(log_return) over (partition by symbol) as z from feat1 where log_return is not null)
select symbol, datetime, w as wait from (select symbol, datetime, i - lag(i) over (partition by symbol order by datetime) as w from a where abs(z) >= 1.5) where w is not null""",
)
def waiting_times(t):
    return V.waiting_times(returns_w(t), WEEKLY, "log_return", 1.5)


@query(
    "253",
    """with a as (select symbol, datetime, cast(sign(log_return) as int) as s from feat1 where log_return <> 0),
b as (select *, sum(nw) over (partition by symbol order by datetime) as g from (select *, case when s = lag(s) over (partition by symbol order by datetime) then 0 else 1 end as nw from a))
select symbol, max(datetime) as datetime, min(s) as sign, count(*) as length from b group by symbol, g""",
)
def sign_runs(t):
    return V.sign_runs(returns_w(t), WEEKLY, "log_return")


@query(
    "254",
    """with a as (select symbol, hit, (row_number() over (partition by symbol order by datetime) - 1) // 26 as block from hits),
b as (select symbol, block, count(case when hit then 1 end) as n_hits, count(*) as n from a group by 1, 2 having count(*) = 26)
select symbol, block, n_hits from (select *, count(*) over (partition by symbol) as k from b) where k >= 4""",
)
def violation_blocks(t):
    return V.violation_blocks(hits(t), WEEKLY, 26)


DUR = """with a as (select symbol, datetime, hit, row_number() over (partition by symbol order by datetime) as i from hits),
d as (select *, i - lag(i) over (partition by symbol order by datetime) - 1 as duration, count(*) over (partition by symbol) as k from a where hit)"""


@query(
    "254",
    DUR + " select symbol, datetime, duration from d where k >= 3 and duration is not null",
)
def violation_durations(t):
    return V.violation_durations(hits(t), WEEKLY)


@query(
    "255",
    """with a as (select symbol, hit, (row_number() over (partition by symbol order by datetime) - 1) // 26 as block from hits),
b as (select symbol, block, count(case when hit then 1 end) as x from a group by 1, 2 having count(*) = 26),
m as (select symbol, avg(x) as mu, count(*) as n from b group by 1 having count(*) >= 4 and avg(x) > 0)
select b.symbol, round(mu, 6) as mu, n, round(sum(x * ln(mu) - mu - case when x > 1 then list_sum(list_transform(range(1, x + 1), lambda k: ln(k))) else 0 end), 6) as loglik from b join m on b.symbol = m.symbol group by b.symbol, mu, n""",
)
def poisson_count_fit(t):
    return rounded(V.poisson_fit(V.violation_blocks(hits(t), WEEKLY, 26), ["symbol"], "n_hits"))


@query(
    "256",
    DUR
    + """, f as (select symbol, avg(duration) as m, sum(duration) as s, count(*) as n from d where k >= 3 and duration is not null group by 1 having count(*) >= 10)
select symbol, round(m / (m + 1), 6) as q, n, round(n * ln(1 - m / (m + 1)) + s * ln(m / (m + 1)), 6) as loglik from f""",
)
def geometric_duration_fit(t):
    return rounded(V.geometric_fit(V.violation_durations(hits(t), WEEKLY), ["symbol"], "duration"))


@query(
    "257",
    """with a as (select symbol, datetime, cast(sign(log_return) as int) as s from feat1 where log_return <> 0),
b as (select *, sum(nw) over (partition by symbol order by datetime) as g from (select *, case when s = lag(s) over (partition by symbol order by datetime) then 0 else 1 end as nw from a)),
l as (select symbol, count(*) as x from b group by symbol, g),
m as (select symbol, avg(x) as d, count(*) as n from l group by 1),
v as (select symbol, x, c, sum(c) over (partition by symbol order by x) as cum from (select symbol, x, count(*) as c from l group by 1, 2)),
f as (select v.symbol, d, n, cum / n as hi, (cum - c) / n as lo, 1 - power(1 - 1 / d, x) as f from v join m on v.symbol = m.symbol)
select symbol, round(d, 6) as mean_duration, n as n_runs, round(max(greatest(abs(hi - f), abs(f - lo))), 6) as ks_stat from f group by symbol, d, n""",
)
def duration_ks(t):
    return rounded(V.duration_ks(V.sign_runs(returns_w(t), WEEKLY, "log_return"), ["symbol"]))


@query(
    "259",
    """with a as (select *, lag(log_return) over (partition by symbol, st order by datetime) as p, (log_return - avg(log_return) over (partition by symbol, st)) / nullif(stddev_pop(log_return) over (partition by symbol, st), 0) as z from hit_state)
select symbol, st, count(*) as n, round(avg(log_return), 6) as mean, round(stddev_pop(log_return), 6) as std, round(avg(power(z, 3)), 6) as skew, round(avg(power(z, 4)), 6) as kurtosis,
 round(case when count(*) > 20 then corr(p, log_return) end, 6) as autocorr_lag1 from a group by 1, 2 having count(*) >= 10""",
)
def stats_by_state(t):
    return rounded(V.stats_by_state(hit_state(t), WEEKLY, "log_return", "st"))


@query("260")
def gaussian_mixture(t):
    return rounded(V.mixture(returns_w(t), "log_return", 2)[0], 4)


@query("261")
def mixture_posterior(t):
    d = V.mixture(returns_w(t), "log_return", 2)[1]
    return rounded(d.select("symbol", "datetime", "p_0", "p_1"), 4)


view(
    "pu",
    "select symbol, datetime, (row_number() over (partition by symbol order by log_return, datetime) - 0.5) / count(*) over (partition by symbol) as u from feat1 where log_return is not null",
)


def pu(t):
    return V.pseudo_uniform(returns_w(t), ["symbol"], "log_return", ["datetime"], "u")


@query("263", "select symbol, datetime, round(u, 6) as u from pu")
def rank_transform(t):
    return rounded(pu(t).select("symbol", "datetime", "u"))


@query(
    "264",
    """select a.symbol as a, b.symbol as b, round(avg(case when b.u <= 0.1 then 1.0 else 0 end), 6) as tail_dependence, count(*) as n from pu a join pu b on a.datetime = b.datetime and a.symbol <> b.symbol where a.u <= 0.1 group by 1, 2""",
)
def tail_dependence(t):
    from ..session import materialize

    return rounded(V.tail_dependence(materialize(pu(t)), "datetime", "symbol", "u", 0.1))


@query("265")
def portfolio_var(t):
    w = t.read("nation").select(
        F.col("n_name").alias("symbol"), (0.02 + F.col("n_regionkey") * 0.01).alias("weight")
    )
    return rounded(V.portfolio_var(returns_w(t), w, WEEKLY, "log_return", 100))


HS = "(select h.symbol, h.st, h.datetime, h.log_return from hit_state h)"


@query(
    "267",
    f"""with e as (select symbol, st, n, avg(case when rn <= greatest(1, floor(n * 0.01e0)) then log_return end) as es from (
 select symbol, st, log_return, row_number() over (partition by symbol, st order by log_return, datetime) as rn, count(*) over (partition by symbol, st) as n from hit_state) group by 1, 2, 3),
lo as ({hill_sql(HS, "symbol, st", 15, 15, "<")}), hi as ({hill_sql(HS, "symbol, st", 15, 15, ">")})
select e.symbol, e.st, n, round(es, 6) as es_1pct, round(lo.alpha, 6) as alpha_lower, round(hi.alpha, 6) as alpha_upper from e
left join lo on e.symbol = lo.symbol and e.st = lo.st left join hi on e.symbol = hi.symbol and e.st = hi.st""",
)
def tail_by_state(t):
    return rounded(V.tail_by_state(hit_state(t), ["symbol"], "log_return", "st", 15))


@query(
    "272",
    f"""select s.symbol, round(log_score, 6) as log_score, round(crps, 6) as crps, n, n_hits, {COV}, {P_COLS} from (
 select symbol, avg({LOG_SCORE}) as log_score, avg({CRPS}) as crps from (select *, log_return / sqrt(fc) as z from hits) group by 1) s
 join ({cov_sql("hits", "symbol", "0.05e0")}) c on s.symbol = c.symbol""",
)
def density_scores(t):
    return rounded(V.density_scores(hits(t).drop("hit"), WEEKLY, "log_return", "fc"))


@query(
    "273, 274",
    """select symbol, round(var_pop(count) / avg(count), 6) as dispersion_index, round(avg(ln(high / low)) / stddev_pop(log_return), 6) as range_mean,
 round((avg(ln(high / low)) / stddev_pop(log_return) / (2 * sqrt(2 / pi())) - 1) * 100, 6) as excess_pct from feat1 group by 1""",
)
def dispersion_and_range(t):
    from ..functions.exprs import log_ratio

    b = t.bars_w().select("symbol", "datetime", "close", "high", "low", "count")
    d = rolling(b, WEEKLY, lambda w: {"log_return": log_return(w)}, 1)
    d = d.withColumn("hl", log_ratio("high", "low"))
    a = V.dispersion(d, ["symbol"], "count")
    return rounded(a.join(V.normalized_range(d, ["symbol"], "hl", "log_return"), "symbol"))


