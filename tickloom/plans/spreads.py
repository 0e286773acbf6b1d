"""Queries over mean reversion and entry signals (inventory 2.N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import log_return
from ..functions.ordered import WEEKLY, rolling
from ..operators import spreads as P
from . import sqlgen as S
from .registry import query, rounded, view

WS = "partition by spread order by date"


def sp(t):
    return t.spreads()


AR1 = """select {k}, count(*) as n_obs, avg(d) - regr_slope(d, l) * avg(l) as alpha, regr_slope(d, l) as beta,
 regr_slope(d, l) / nullif(sqrt(greatest(regr_syy(d, l) - regr_slope(d, l) * regr_sxy(d, l), 0) / nullif((count(*) - 2) * regr_sxx(d, l), 0)), 0) as t_stat from (
 select {k}, value - lag(value) over (partition by {k} order by date) as d, lag(value) over (partition by {k} order by date) as l from {src}) where l is not null group by {k}"""
HL = "case when beta > -1 and beta < 0 then -ln(2) / ln(1 + beta) end"
view("ar1_s", AR1.format(k="spread", src="spreads"))


@query(
    "372",
    f"select spread, n_obs, {S.rnd('alpha beta t_stat')}, round({HL}, 6) as half_life, coalesce(beta < 0 and abs(t_stat) > 2, false) as mean_reverting from ar1_s",
)
def ar1_differences(t):
    return rounded(P.ar1(sp(t), P.SPREAD, "value"))


@query(
    "373",
    "select spread, round(t_stat, 6) as t_stat, round(beta, 6) as b, n_obs, cast(0 as bigint) as n_lags, t_stat < -2.86 as stationary_5pct, t_stat < -3.43 as stationary_1pct from ar1_s",
)
def dickey_fuller(t):
    """The test without lagged changes."""
    return rounded(P.adf(sp(t), P.SPREAD, "value", 0))


@query("373")
def augmented_dickey_fuller(t):
    return rounded(P.adf(sp(t), P.SPREAD, "value", 8))


@query(
    "374",
    """select spread, round(case when t_stat <= -3.43 then greatest(1e-4, 0.01 + 0.04 / 0.57 * (t_stat + 3.43)) when t_stat < -2.86 then 0.01 + 0.04 / 0.57 * (t_stat + 3.43)
 when t_stat < -2.57 then 0.05 + 0.05 / 0.29 * (t_stat + 2.86) else least(1, 0.1 + 0.05 / 0.29 * (t_stat + 2.57)) end, 6) as pvalue from (select spread, t_stat / 4 as t_stat from ar1_s)""",
)
def adf_pvalues(t):
    d = P.ar1(sp(t), P.SPREAD, "value")
    return rounded(d.select("spread", P.adf_pvalue(F.col("t_stat") / 4).alias("pvalue")))


@query(
    "375",
    f"select spread, date, round(lag(z) over ({WS}), 6) as z from (select spread, date, {S.z('value', 60, WS)} as z from spreads)",
)
def strict_zscore(t):
    d = P.lagged_zscore(sp(t).select("spread", "date", "value"), P.SPREAD, "value", 60, "z")
    return rounded(d.drop("value"))


@query(
    "376",
    f"select spread, date, round({S.std('d', 14, WS, shift=1)}, 4) as atr from (select *, value - lag(value) over ({WS}) as d from spreads)",
)
def spread_atr(t):
    d = rolling(
        sp(t).select("spread", "date", "value"),
        P.SPREAD,
        [
            lambda w: {"_d": F.col("value") - F.lag("value").over(w)},
            lambda w: {"atr": P.spread_atr(w, "_d", 14)},
        ],
        16,
    )
    return rounded(d.select("spread", "date", "atr"), 4)


view(
    "tr_w",
    "select *, case when pv is not null then greatest(high - low, abs(high - pv), abs(low - pv)) end as tr from (select *, lag(close) over (partition by symbol order by datetime) as pv from bars_w)",
)
view("atr_w", f"select *, {S.mean('tr', 14, shift=1)} as atr, {S.mean('close', 10, shift=1)} as sma from tr_w")


@query("377, 378", "select symbol, datetime, round(atr, 4) as atr, round(sma, 4) as sma from atr_w")
def simple_atr_and_sma(t):
    from ..functions.exprs import roll_mean

    d = P.simple_atr(t.bars_w().select("symbol", "datetime", "high", "low", "close"), WEEKLY, 14, "atr")
    d = rolling(d, WEEKLY, lambda w: {"sma": roll_mean("close", w, 10, shift=1)}, 11)
    return rounded(d.select("symbol", "datetime", "atr", "sma"), 4)


@query(
    "290, 379, 380, 381",
    f"""select spread, date, round(-(0.45 + 0.05 * leg2_price / 12), 9) as carry_fv, round(-value / nullif(-(0.45 + 0.05 * leg2_price / 12), 0), 6) as carry_ratio,
 case when value is null then 'unknown' when value > 200 then 'backwardation' when value < -200 then 'contango' else 'flat' end as label from spreads""",
)
def carry_and_label(t):
    made = P.carry_columns(F.col("leg2_price"), F.col("value"), 0.45, F.lit(0.05))
    return rounded(
        sp(t).select(
            "spread",
            "date",
            made["carry_fv"].alias("carry_fv"),
            made["carry_ratio"].alias("carry_ratio"),
            P.regime_label(F.col("value"), 200.0).alias("label"),
        ),
        carry_fv=9,
    )


def vr_sql(q: int) -> str:
    return f"""select spread, n, vr, (vr - 1) / sqrt(2.0 * {2 * q - 1} * {q - 1} / ({3 * q}.0 * n)) as z_stat from (select spread, count(a) as n, case when count(a) >= {2 * q} then var_samp(b) / {q} / nullif(var_samp(a), 0) end as vr from (
 select spread, value - lag(value) over ({WS}) as a, value - lag(value, {q}) over ({WS}) as b from spreads) group by 1)"""


view("vr5", vr_sql(5))
view("vr20", vr_sql(20))


@query("382", "select spread, n, round(vr, 6) as vr, round(z_stat, 6) as z_stat from vr5")
def variance_ratio_test(t):
    return rounded(P.variance_ratio_test(sp(t), P.SPREAD, "value", 5))


HURST = f"""with n as (select spread, greatest(3, least(100, count(value) // 4)) as hi from spreads group by 1),
r as (select spread, value, row_number() over ({WS}) as i from spreads where value is not null),
k as (select a.spread, a.i - b.i as k, var_pop(a.value - b.value) as v from r a join r b on a.spread = b.spread and b.i between a.i - 99 and a.i - 2 group by 1, 2)
select k.spread, regr_slope(ln(v), ln(k)) / 2 as hurst from k join n on k.spread = n.spread where k < hi and v > 0 group by 1"""
view("hurst_v", HURST)


@query("383", "select spread, round(hurst, 6) as hurst from hurst_v")
def hurst_exponent(t):
    return rounded(P.hurst(sp(t), P.SPREAD, "value"))


view(
    "chunks",
    f"select * from (select spread, date, value, (row_number() over ({WS}) - 1) // 60 as chunk, count(*) over (partition by spread) // 60 as nc from spreads) where chunk < nc",
)


@query(
    "384",
    f"select spread, chunk, round({HL}, 6) as half_life from ({AR1.format(k='spread, chunk', src='chunks')})",
)
def chunk_half_lives(t):
    return rounded(P.chunk_half_life(sp(t), P.SPREAD, "value", 60))


@query(
    "385",
    f"select spread, chunk, round(t_stat, 6) as t_stat from ({AR1.format(k='spread, chunk', src='chunks')})",
)
def chunk_dickey_fuller(t):
    return rounded(P.chunk_adf(sp(t), P.SPREAD, "value", 60, 0))


view(
    "stable_s",
    f"""select f.spread, full_half_life, full_in_band, coalesce(k, 0) as n_in_band, coalesce(np, 0) as n_parts, full_in_band and coalesce(k, 0) >= 3 as stable from (
 select spread, {HL} as full_half_life, coalesce({HL} between 0.3 and 60, false) as full_in_band from ar1_s) f left join (
 select spread, count(case when {HL} between 0.3 and 60 then 1 end) as k, count(*) as np from ({AR1.format(k="spread, chunk", src=f"(select * from (select spread, date, value, (row_number() over ({WS}) - 1) // (count(*) over (partition by spread) // 4) as chunk from spreads) where chunk < 4)")}) group by 1) s on f.spread = s.spread""",
)


@query(
    "386",
    "select spread, round(full_half_life, 6) as full_half_life, full_in_band, n_in_band, n_parts, stable from stable_s",
)
def half_life_stability(t):
    return rounded(P.stability(sp(t), P.SPREAD, "value", 4, 0.3, 60.0))


@query("387")
def stationarity_screen(t):
    return rounded(P.stationarity_screen(sp(t), P.SPREAD, "value", 5))


view(
    "legcorr",
    f"""select spread, date, value, roll_window_flag, r1, r2, case when count(case when r1 is not null and r2 is not null then 1 end) over ({WS} rows between 29 preceding and current row) = 30
 then corr(r1, r2) over ({WS} rows between 29 preceding and current row) end as rho from (select *, {S.lnr("leg1_price", f"lag(leg1_price) over ({WS})")} as r1, {S.lnr("leg2_price", f"lag(leg2_price) over ({WS})")} as r2 from spreads)""",
)


def legs(t):
    return P.leg_correlation(sp(t), P.SPREAD, "leg1_price", "leg2_price", 30, "rho")


@query("388", "select spread, date, round(rho, 6) as rho from legcorr")
def leg_correlation(t):
    return rounded(legs(t).select("spread", "date", "rho"))


STD = "case when value > 200 then 'backwardation' when value < -200 then 'contango' else 'flat' end"
POOL = f"(select spread, date, value, {STD} as state from spreads union all select spread, date, value, '_pooled' from spreads)"


@query(
    "389",
    f"select spread, state, n_obs, {S.rnd('alpha beta t_stat')}, round({HL}, 6) as half_life, coalesce(beta < 0 and abs(t_stat) > 2, false) as mean_reverting from ({AR1.format(k='spread, state', src=POOL)}) where n_obs >= 59",
)
def ar1_by_state(t):
    d = sp(t).select("spread", "date", "value").withColumn("st", P.regime_label(F.col("value"), 200.0))
    return rounded(P.ar1_by_state(d, P.SPREAD, "value", "st"))


@query(
    "390",
    f"select spread, coalesce(st, '_pooled') as state, count(*) as n, round(case when count(*) >= 20 then stddev_pop(r1) * sqrt(252) end, 6) as vol from (select *, {STD} as st from legcorr where r1 is not null) group by rollup (spread, st) having spread is not null",
)
def vol_by_state(t):
    d = rolling(sp(t), P.SPREAD, lambda w: {"r": log_return(w, "leg1_price")}, 1)
    d = d.withColumn("st", P.regime_label(F.col("value"), 200.0))
    return rounded(P.vol_by_state(d, ["spread"], "r", "st"))


PF = "over (partition by spread order by date rows between 59 preceding and current row)"


@query(
    "391",
    f"""with a as (select *, value - lag(value) over ({WS}) as d from spreads), b as (select *, {S.std("d", 20, WS, need=10)} as v from a),
c as (select *, list(v) filter (v is not null) {PF} as vs from b),
e as (select spread, date, roll_window_flag, case when v is not null and len(vs) >= 15 and len(vs) > 1 then (len(list_filter(vs, lambda y: y < v)) + (len(list_filter(vs, lambda y: y = v)) + 1) / 2.0 - 1) / (len(vs) - 1) end as p from c)
select spread, date, round(p, 6) as vol_pct, coalesce(roll_window_flag and p > 0.8, false) as roll_suppress, coalesce(p > 0.95, false) as regime_suppress from e""",
)
def suppression_masks(t):
    d = P.suppression(sp(t), P.SPREAD, "value", "roll_window_flag", 20, 60)
    return rounded(d.select("spread", "date", "vol_pct", "roll_suppress", "regime_suppress"))


@query(
    "392, 397",
    f"""with h as (select spread, date, value, row_number() over ({WS}) as i, lag(value) over ({WS}) as l, lag(value, 6) over ({WS}) as b6 from spreads),
e as (select o_orderkey as trade_id, h.* from orders o join h on cast(o_orderdate as date) = h.date and ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][o_custkey % 5 + 1] = h.spread where h.i > 1),
j as (select e.trade_id, e.i as ei, greatest(e.i - 60, 1) as f, e.l as last, e.b6, x.i, x.value as xv, x.l as xl, x5.value as x5 from e join h x on x.spread = e.spread and x.i >= greatest(e.i - 60, 1) and x.i < e.i
  left join h x5 on x5.spread = e.spread and x5.i = x.i - 5),
g as (select trade_id, count(*) as n_hist, avg(case when xv <= last then 1.0 else 0 end) as p, max(last - b6) as pm, regr_slope(case when i > f then xv - xl end, case when i > f then xl end) as beta,
  var_samp(case when i > f then xv - xl end) as v1, var_samp(case when i >= f + 5 then xv - x5 end) as vq from j group by 1)
select trade_id, n_hist, round(p, 6) as level_pctile, round(pm, 9) as pre_move, round({HL}, 6) as half_life, round(vq / 5 / nullif(v1, 0), 6) as vr from g""",
)
def trade_entry_features(t):
    names = F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
    tr = t.read("orders").select(
        F.col("o_orderkey").alias("trade_id"),
        F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int")).alias("spread"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    s = sp(t).select("spread", "date", "value")
    d = P.trade_history_features(tr, s, P.SPREAD, "value", 60)
    return rounded(d, pre_move=9)


@query(
    "393",
    f"""with a as (select symbol, datetime, {S.mean("close", 4, shift=1)} > {S.mean("close", 12, shift=1)} as v from bars_w),
g as (select datetime, count(case when v then 1 end) as k from a group by 1)
select c.datetime, coalesce(k, 0) as votes, coalesce(k, 0) >= 13 as gate from (select distinct datetime + interval 0 day as datetime from bars_w) c left join g on c.datetime = g.datetime""",
)
def vote_gate(t):
    b = t.bars_w().select("symbol", "datetime", "close")
    return P.vote_gate(b, b.select("datetime").distinct(), WEEKLY, 4, 12, 13)


@query(
    "394",
    f"""with a as (select *, {S.roll("max", "high", 4)} as hi, {S.roll("min", "low", 4)} as lo, lag(close, 4) over ({S.W}) / nullif(lag(close, 10) over ({S.W}), 0) - 1 as run from bars_w)
select symbol, datetime, coalesce(close > lag(hi) over ({S.W}) and lag((hi - lo) / close) over ({S.W}) <= 2.5 and lag(run) over ({S.W}) >= 0.05, false) as entry from a""",
)
def breakout_entries(t):
    d = P.breakout_entries(t.bars_w(), WEEKLY, 6, 4, 0.05, 2.5)
    return d.select("symbol", "datetime", "entry")


view(
    "calib",
    f"""select *, (hi - lo) / nullif(atr, 0) as base_range_atr, (lag(close, 4) over ({S.W}) / nullif(lag(close, 10) over ({S.W}), 0) - 1) / nullif(lag(atr, 4) over ({S.W}) / nullif(lag(close, 4) over ({S.W}), 0), 0) as prior_run_atr,
 volume / nullif(mv, 0) as volume_ratio, is_roll as roll from (select *, month(datetime) % 6 = 0 and day(datetime) <= 7 as is_roll, {S.roll("max", "high", 4)} as hi, {S.roll("min", "low", 4)} as lo, {S.med("volume", 8, shift=1)} as mv from atr_w)""",
)


def with_roll(t):
    m = (F.month("datetime") % 6 == 0) & (F.dayofmonth("datetime") <= 7)
    return t.bars_w().withColumn("is_roll", m)


@query(
    "395",
    f"""with a as (select *, sum(case when roll then 1 else 0 end) over ({S.W} rows unbounded preceding) as g from calib),
b as (select *, row_number() over (partition by symbol, g order by datetime) - 1 as since from a),
c as (select symbol, datetime, lag(base_range_atr) over ({S.W}) <= 4 as ok, lag(prior_run_atr) over ({S.W}) as run, coalesce(volume >= 1.1 * mv, false) and since > 8 and not roll as vol, close > lag(hi) over ({S.W}) as up, close < lag(lo) over ({S.W}) as dn from b)
select symbol, datetime, coalesce(up and ok and run >= 0.1, false) and vol as long_entry, coalesce(dn and ok and run <= -0.1, false) and vol as short_entry from c""",
)
def volume_breakouts(t):
    d = P.volume_breakouts(with_roll(t), WEEKLY, 6, 4, 0.1, 4.0, 1.1, 8)
    return d.select("symbol", "datetime", "long_entry", "short_entry")


@query(
    "396",
    f"""select symbol, datetime, row_number() over (partition by symbol, g order by datetime) - 1 as since from (select *, sum(case when roll then 1 else 0 end) over ({S.W} rows unbounded preceding) as g from calib)""",
)
def bars_since_roll(t):
    return P.bars_since(with_roll(t).select("symbol", "datetime", "is_roll"), WEEKLY, "is_roll", "since").drop("is_roll")


@query(
    "397",
    "select symbol, datetime, round(base_range_atr, 6) as base_range_atr, round(prior_run_atr, 6) as prior_run_atr, round(volume_ratio, 6) as volume_ratio from calib where datetime < timestamp '1998-01-01'",
)
def calibration_diagnostics(t):
    d = P.calibration_columns(t.bars_w(), WEEKLY, 6, 4, 14, 8)
    d = d.where(F.col("datetime") < F.lit("1998-01-01").cast("timestamp"))
    return rounded(d.select("symbol", "datetime", "base_range_atr", "prior_run_atr", "volume_ratio"))


@query(
    "398",
    "select round(quantile_cont(base_range_atr, 0.3), 6) as base_max_range, round(quantile_cont(abs(prior_run_atr), 0.7), 6) as prior_run_min, round(quantile_cont(case when volume_ratio > 0 then volume_ratio end, 0.75), 6) as vol_k from calib",
)
def frozen_thresholds(t):
    return rounded(P.frozen_thresholds(P.calibration_columns(t.bars_w(), WEEKLY, 6, 4, 14, 8)))


@query("399")
def trend_momentum_state(t):
    d = t.bars_w().select("symbol", "datetime", "high", "low", "close")
    return rounded(P.trend_state(d, WEEKLY).select("symbol", "datetime", "state"))


@query(
    "400",
    f"""select symbol, datetime, case when m > 0.1 then 1.0::double when m < -0.1 then -1.0::double else 0.0::double end as signal from (
 select symbol, datetime, ln(lag(close) over ({S.W})) - ln(lag(close, 5) over ({S.W})) as m from bars_w)""",
)
def roc_entries(t):
    b = t.bars_w().select("symbol", "datetime", "close")
    d = rolling(b, WEEKLY, lambda w: {"signal": P.roc_entry(w, 4, 0.1)}, 5)
    return d.drop("close")


STOP = f"""with a as (select *, case when r13 > 0.05 then 1.0 when r13 < -0.05 then -1.0 else 0.0 end as position from (select *, coalesce(ln(close / lag(close, 4) over ({S.W})), 0) as r13 from atr_w)),
b as (select *, case when atr is null then 0 else cast(position as int) end as sg from a),
c as (select *, sum(nw) over ({S.W} rows unbounded preceding) as g from (select *, case when sg = lag(sg) over ({S.W}) then 0 else 1 end as nw from b)),
d as (select *, case when sg > 0 then max(close - 0.5 * atr) over (partition by symbol, g order by datetime rows unbounded preceding) when sg < 0 then min(close + 0.5 * atr) over (partition by symbol, g order by datetime rows unbounded preceding) end as stop from c)"""


def stops(t):
    d = rolling(
        t.bars_w().select("symbol", "datetime", "open", "high", "low", "close"),
        WEEKLY,
        lambda w: {"_m": F.coalesce(log_return(w, "close", 4), F.lit(0.0))},
        4,
    )
    p = F.when(F.col("_m") > 0.05, 1.0).when(F.col("_m") < -0.05, -1.0).otherwise(0.0)
    return P.trailing_stop(d.withColumn("position", p).drop("_m"), WEEKLY, 0.5)


@query("401", STOP + " select symbol, datetime, round(stop, 4) as stop from d")
def trailing_stops(t):
    return rounded(stops(t).select("symbol", "datetime", "stop"), 4)


@query(
    "402",
    STOP
    + """ select symbol, datetime, coalesce((position > 0 and low <= stop) or (position < 0 and high >= stop), false) as stopped,
 round(case when (position > 0 and low <= stop and open <= stop) or (position < 0 and high >= stop and open >= stop) then open when (position > 0 and low <= stop) or (position < 0 and high >= stop) then stop end, 9) as fill from d""",
)
def stop_fills(t):
    return rounded(P.stop_fill(stops(t)).select("symbol", "datetime", "stopped", "fill"), 9)


DEF = f"select spread, date, value, r1, rho, unnest(['raw', 'band']) as definition, unnest([case when value > 0 then 'up' when value < 0 then 'down' end, {STD}]) as st from legcorr"


@query(
    "403",
    f"""with x as ({DEF}), p as (select spread, definition, date, value, st as state from x where st is not null union all select spread, definition, date, value, '_pooled' from x),
a as ({AR1.format(k="spread, definition, state", src="p")}),
v as (select spread, definition, coalesce(st, '_pooled') as state, count(*) as n, case when count(*) >= 20 then stddev_pop(r1) * sqrt(252) end as vol from x where r1 is not null and st is not null group by rollup (spread, definition, st) having spread is not null and definition is not null),
c as (select spread, definition, st as state, avg(rho) as m from x where st is not null and rho is not null group by 1, 2, 3 having count(*) >= 30)
select v.spread, v.definition, v.state, n, round(vol, 6) as vol, round(beta, 6) as beta, round({HL}, 6) as half_life, round(m, 6) as mean_leg_corr from v
left join (select * from a where n_obs >= 29) a on v.spread = a.spread and v.definition = a.definition and v.state = a.state left join c on v.spread = c.spread and v.definition = c.definition and v.state = c.state""",
)
def state_profiles(t):
    d = rolling(legs(t), P.SPREAD, lambda w: {"r1": log_return(w, "leg1_price")}, 1)
    defs = {
        "raw": F.when(F.col("value") > 0, "up").when(F.col("value") < 0, "down"),
        "band": P.regime_label(F.col("value"), 200.0),
    }
    d = d.select("spread", "date", "value", "r1", "rho")
    return rounded(P.state_profile(d, P.SPREAD, defs, "value", "r1", "rho"))


NR = "(select * from spreads where not roll_window_flag)"


@query(
    "404",
    f"""with a as ({AR1.format(k="spread", src=NR)}), z as (select spread, {S.z("value", 60, WS)} as z, lead(value, 5) over ({WS}) - value as f from {NR}),
k as (select spread, rank() over (partition by spread order by z) + (count(*) over (partition by spread, z) - 1) / 2.0 as rz, rank() over (partition by spread order by f) + (count(*) over (partition by spread, f) - 1) / 2.0 as rf from z where z is not null and f is not null),
i as (select spread, case when count(*) >= 30 then corr(rz, rf) end as ic, count(*) as n from k group by 1)
select a.spread, round(beta, 6) as beta, round(t_stat, 6) as t_stat, round({HL}, 6) as half_life, coalesce(beta < 0 and abs(t_stat) > 2, false) as mean_reverting, round(ic, 6) as ic, n from a left join i on a.spread = i.spread""",
)
def reversion_probe(t):
    return rounded(P.reversion_probe(sp(t), P.SPREAD, "value", "roll_window_flag"))


