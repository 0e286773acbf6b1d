"""Queries over weights and books (inventory 2.D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import log_return, ratio, roll_mean, roll_std
from ..functions.ordered import WEEKLY, rolling
from ..operators import features as X
from ..operators import xs
from . import sqlgen as S
from .features import caps
from .registry import query, rounded, view

view(
    "sig",
    """select symbol, datetime, close, volume, momentum_4 as pred, realized_vol_8 as size, fwd_return_1
from features_w""",
)


NAMES = 25  # rows of the nation table, which names the weekly symbols


def signals(t):
    """Weekly panel with a prediction, a size and the next return."""
    def base(w):
        return {
            "log_return": log_return(w),
            "pred": log_return(w, "close", 4),
            "fwd_return_1": X.forward_return(w),
        }

    b = t.bars_w().select("symbol", "datetime", "close", "volume")
    d = rolling(b, WEEKLY, [base, lambda w: {"size": roll_std("log_return", w, 8)}], 12, 1)
    return d.drop("log_return")


def legs_sql(src: str, long: str, short: str, size: str, cap: float, part: str = "datetime") -> str:
    return f"""select *, greatest(-{cap}, least({cap}, case
  when {short} and sum(case when {short} then {size} end) over (partition by {part}) > 0
    then -0.5 * {size} / sum(case when {short} then {size} end) over (partition by {part})
  when {long} and sum(case when {long} then {size} end) over (partition by {part}) > 0
    then 0.5 * {size} / sum(case when {long} then {size} end) over (partition by {part})
  else 0 end)) as weight from {src}"""


def dn_sql(src: str, size: str, cap: float = 0.25, part: str = "datetime", frac: str = "0.2e0") -> str:
    ranked = f"""(select *, rn > n - k as lng, rn <= k as sht from (select *, greatest(1, floor(n * {frac})) as k from (
 select *, row_number() over (partition by {part} order by pred, symbol) as rn,
  count(*) over (partition by {part}) as n from {src})))"""
    return legs_sql(ranked, "lng", "sht", size, cap, part)


view("weights_w", dn_sql("(select * from sig where pred is not null)", "1"))


def weights_w(t):
    return xs.dollar_neutral_weights(signals(t), "pred", names=NAMES)


@query("63", "select symbol, datetime, round(weight, 6) as weight from weights_w")
def dollar_neutral_weights(t):
    return rounded(weights_w(t))


@query(
    "54, 63",
    f"""with x as ({dn_sql("(select * from sig where pred is not null and size is not null)", "abs(size)", 0.1)})
select symbol, datetime, round(weight, 6) as weight from x""",
)
def sized_weights(t):
    return rounded(xs.dollar_neutral_weights(signals(t), "pred", size="size", cap=0.1, names=NAMES))


BAND = """with recursive a as (select *, rn > n - ke as li, rn <= ke as si, rn > n - kx as lk, rn <= kx as sk from (
 select *, greatest(1, floor(n * 0.2e0)) as ke, greatest(greatest(1, floor(n * 0.2e0)), floor(n * (0.2e0 + 0.1e0))) as kx from (
  select symbol, datetime, row_number() over (partition by datetime order by pred, symbol) as rn,
   count(*) over (partition by datetime) as n from sig where pred is not null))),
b as (select a.*, d.bar, row_number() over (partition by symbol order by a.datetime) as i from a
 join (select datetime, row_number() over (order by datetime) as bar from (select distinct datetime from a)) d
 on a.datetime = d.datetime),
st as (select symbol, i, bar, case when li then 1 when si then 2 else 0 end as leg from b where i = 1
 union all
 select b.symbol, b.i, b.bar, case when b.bar - st.bar > 1 or st.leg = 0 then case when li then 1 when si then 2 else 0 end
   when st.leg = 1 then case when lk then 1 when si then 2 else 0 end
   else case when sk then 2 when li then 1 else 0 end end
 from st join b on b.symbol = st.symbol and b.i = st.i + 1),
"""


@query(
    "64",
    BAND
    + f"""x as (select b.symbol, b.datetime, st.leg from b join st on b.symbol = st.symbol and b.i = st.i),
y as ({legs_sql("x", "leg = 1", "leg = 2", "1", 0.25)})
select symbol, datetime, round(weight, 6) as weight from y""",
)
def banded_weights(t):
    return rounded(xs.banded_weights(signals(t), "pred", 0.1, s=WEEKLY, names=NAMES))


@query(
    "65",
    """select symbol, datetime, round(round(w / 0.05e0) * 0.05e0, 6) + 0.0 as weight from (
select symbol, datetime, weight * 0.93e0 as w from weights_w)""",
)
def quantized_weights(t):
    w = weights_w(t).withColumn("weight", F.col("weight") * 0.93)
    return rounded(xs.quantize(w, 0.05))


@query(
    "66",
    """with a as (select *, dense_rank() over (order by datetime) - 1 as bar from weights_w)
select symbol, datetime, round(coalesce(last_value(case when bar % 4 = 0 then weight end ignore nulls)
  over (partition by symbol order by datetime), 0), 6) as weight from a""",
)
def throttled_weights(t):
    return rounded(xs.throttle(weights_w(t), 4, WEEKLY))


view(
    "var_w",
    f"select symbol, datetime, -2.326 * {S.std('log_return', 8)} as var_forecast, log_return from feat1",
)


def var_w(t):
    def second(w):
        return {"var_forecast": -2.326 * roll_std("log_return", w, 8)}

    b = t.bars_w().select("symbol", "datetime", "close")
    return rolling(b, WEEKLY, [lambda w: {"log_return": log_return(w)}, second], 9).drop("close")


NOW = "order by datetime"
view(
    "book_scale_w",
    f"""select datetime, case when ref is not null and m > 1.1 * ref then 0.0 else 1.0 end as book_scale from (
select *, {S.med("m", 60, NOW, 30, 1)} as ref from (
 select datetime, median(abs(var_forecast)) as m from var_w where var_forecast is not null group by 1))""",
)


@query(
    "67, 70",
    """select w.symbol, w.datetime, round(weight * cast(coalesce(book_scale, 1) as double), 6) + 0.0 as weight
from weights_w w left join book_scale_w b on w.datetime = b.datetime""",
)
def standdown_weights(t):
    v = var_w(t).where(F.col("var_forecast").isNotNull())
    return rounded(xs.apply_book_scale(weights_w(t), xs.book_standdown(v, 1.1, 60, s=WEEKLY)))


@query(
    "67",
    "select datetime, cast(book_scale as double) as book_scale from book_scale_w",
)
def book_standdown(t):
    return xs.book_standdown(var_w(t).where(F.col("var_forecast").isNotNull()), 1.1, 60, s=WEEKLY)


view(
    "tilt_w",
    f"""select symbol, datetime, greatest(0, least(1, ref / nullif(abs(var_forecast), 0))) as tilt0, ref, var_forecast from (
select *, {S.med("v", 60, S.W, 30, 1)} as ref from (select *, abs(var_forecast) as v from var_w))""",
)
TILT = "case when ref is not null and abs(var_forecast) > 0 then tilt0 end"


@query("68, 69", f"select symbol, datetime, round({TILT}, 6) as tilt from tilt_w")
def overlay_tilt(t):
    return rounded(xs.overlay_weight(var_w(t), 60, s=WEEKLY))


@query(
    "71",
    f"""select s.symbol, s.datetime, round(pred, 6) as pred, round(coalesce({TILT}, 1), 6) as tilt
from sig s left join tilt_w t on s.symbol = t.symbol and s.datetime = t.datetime""",
)
def tilted_panel(t):
    d = xs.apply_tilt(signals(t).select("symbol", "datetime", "pred"), xs.overlay_weight(var_w(t), 60, s=WEEKLY))
    return rounded(d)


view(
    "liq_w",
    f"""select symbol, datetime, {S.mean("log_return", 26)} / {S.std("log_return", 26)} as sharpe,
  {S.mean("volume * close", 26)} as dvol from feat1""",
)


def liquidity(t):
    def second(w):
        return {
            "sharpe": ratio(roll_mean("log_return", w, 26), roll_std("log_return", w, 26)),
            "dvol": roll_mean(F.col("volume") * F.col("close"), w, 26),
        }

    b = t.bars_w().select("symbol", "datetime", "close", "volume")
    d = rolling(b, WEEKLY, [lambda w: {"log_return": log_return(w)}, second], 27)
    return d.select("symbol", "datetime", "sharpe", "dvol")


@query(
    "72",
    """select symbol, datetime, ok and sharpe >= 0.02 as long_ok, ok and sharpe <= -0.03 as short_ok from (
select *, (rank() over (partition by datetime order by dvol desc) + (count(*) over (partition by datetime, dvol) - 1) / 2.0)
   / count(*) over (partition by datetime) <= 0.5 and sharpe is not null as ok from liq_w where dvol is not null and sharpe is not null)""",
)
def quality_liquidity(t):
    d = liquidity(t).dropna()
    d = xs.quality_liquidity(d, "sharpe", "dvol", 0.02, 0.03, 0.5)
    return d.select("symbol", "datetime", "long_ok", "short_ok")


view(
    "elig_w",
    """select b.symbol, b.datetime, coalesce(long_ok, false) as long_ok, coalesce(short_ok, false) as short_ok
from bars_w b left join (select b.symbol, datetime,
   row_number() over (partition by datetime order by market_cap desc, b.symbol desc) <= 3 as long_ok,
   row_number() over (partition by datetime order by market_cap, b.symbol) <= 4 as short_ok
 from bars_w b join caps c on b.symbol = c.symbol) e on b.symbol = e.symbol and b.datetime = e.datetime""",
)


def eligible(t):
    d = t.bars_w().select("symbol", "datetime").join(caps(t), "symbol", "left")
    return xs.cap_eligibility(d, "market_cap", 3, 4, NAMES)


@query("73", "select symbol, datetime, long_ok, short_ok from elig_w")
def cap_eligibility(t):
    return eligible(t).select("symbol", "datetime", "long_ok", "short_ok")


@query(
    "74",
    """with a as (select e.symbol, e.datetime, cast(case when long_ok and pred > 0 then 1 when short_ok and pred < 0 then -1 else 0 end as double) as p,
  coalesce(s.fwd_return_1, 0) as ret, 0.0001e0 as fc from elig_w e join sig s on e.symbol = s.symbol and e.datetime = s.datetime),
b as (select *, abs(p - coalesce(lag(p) over (partition by symbol order by datetime), 0)) as d from a),
g as (select datetime, coalesce(avg(case when p > 0 then ret + fc end) * 0.6, 0) as l,
  coalesce(avg(case when p < 0 then fc - ret end) * 0.4, 0) as s, sum(d) / (select count(distinct symbol) from a) as t from b group by 1)
select datetime, round(l, 6) as long_ret, round(s, 6) as short_ret, round(t, 6) as turnover,
  round(l + s, 6) as trade_log_return, round(l + s - 0.0005e0 * t, 6) as trade_log_return_net from g""",
)
def leg_book_returns(t):
    d = eligible(t).join(signals(t), ["symbol", "datetime"])
    p = F.when(F.col("long_ok") & (F.col("pred") > 0), 1.0)
    p = p.when(F.col("short_ok") & (F.col("pred") < 0), -1.0).otherwise(0.0)
    d = d.select(
        "symbol",
        "datetime",
        p.alias("leg_position"),
        F.coalesce("fwd_return_1", F.lit(0.0)).alias("ret"),
        F.lit(0.0001).alias("funding_cost"),
    )
    return rounded(xs.book_returns(d, 0.6, 0.4, 0.0005, WEEKLY))


PVS = {"AFRICA": (10.0, 8.0), "AMERICA": (5.0, 5.0), "ASIA": (2.0, 4.0), "EUROPE": (1.0, 1.0), "MIDDLE EAST": (3.0, 2.0)}
WS = "partition by spread order by date"


def _spread_sql(gate: bool) -> str:
    pv = " ".join(f"when '{k}' then {v[0]}" for k, v in PVS.items())
    pv2 = " ".join(f"when '{k}' then {v[1]}" for k, v in PVS.items())
    shut = "when r.regime is null or r.regime in ('flat', 'unconfirmed') then 0" if gate else ""
    join = "left join gate_s r on a.spread = r.spread and a.date = r.date" if gate else ""
    return f"""select *, pos0 * dv * pv / nullif(basis, 0) as gross_return, abs(position - pos0) * 15.0 / nullif(basis, 0) as cost_frac
from (select *, coalesce(lag(position) over ({WS}), 0) as pos0, value - lag(value) over ({WS}) as dv from (
 select a.*, case {shut} when z is null then 0 else -greatest(-2, least(2, z)) / 2 end as position from (
  select *, {S.z("value", 60, WS)} as z, abs(leg1_price) * pv + abs(leg2_price) * pv2 as basis from (
   select *, cast(case spread {pv} end as double) as pv, cast(case spread {pv2} end as double) as pv2
   from spreads where not roll_window_flag)) a {join}))"""


view("spread_pnl", _spread_sql(False))
view(
    "gate_s",
    """select product as spread, date, case when abs(close_f3 - close_f2) < 50 then 'flat' when close_f3 > close_f2 then 'contango'
  when close_f3 < close_f2 then 'backwardation' end as regime from curve""",
)
view("spread_pnl_gated", _spread_sql(True))
PNL = """select spread, date, round(position, 6) + 0.0 as position, round(gross_return, 6) + 0.0 as gross_return,
  round(cost_frac, 6) + 0.0 as cost_frac, round(gross_return - cost_frac, 6) + 0.0 as net_return
from {} where gross_return - cost_frac is not null"""


@query("75", PNL.format("spread_pnl"))
def spread_positions(t):
    return rounded(xs.spread_returns(t.spreads(), PVS, 15.0))


def gates(t):
    c = t.curve()
    gap = F.col("close_f3") - F.col("close_f2")
    lab = F.when(F.abs(gap) < 50, "flat").when(gap > 0, "contango").when(gap < 0, "backwardation")
    return c.select(F.col("product").alias("spread"), "date", lab.alias("regime"))


@query("76", PNL.format("spread_pnl_gated"))
def gated_spread_positions(t):
    return rounded(xs.spread_returns(t.spreads(), PVS, 15.0, gate=gates(t)))


@query(
    "77",
    f"""select date, round(avg(gross_return - cost_frac), 6) + 0.0 as book_return from (
select *, row_number() over ({WS}) as i from spread_pnl where gross_return - cost_frac is not null) where i > 20 group by 1""",
)
def spread_book(t):
    return rounded(xs.equal_weight_book(xs.spread_returns(t.spreads(), PVS, 15.0), 20))


@query(
    "78, 79",
    """select symbol, datetime, round(coalesce(greatest(-1, least(1, case when size > 1e-12 then 0.25 * pred / (size * size) end)), 0), 6) as kelly,
  round(case when adv > 1e-12 then 1 / (1 + 0.1 * sqrt(abs(pred) * 1e5 / adv)) else 0 end, 6) as impact from (
select *, coalesce(avg(volume * close) over (partition by symbol order by datetime rows between 7 preceding and current row), 0) as adv from sig)
where pred is not null and size is not null""",
)
def kelly_and_impact(t):
    adv = lambda w: {"adv": F.avg(F.col("volume") * F.col("close")).over(w.rowsBetween(-7, 0))}
    d = rolling(signals(t), WEEKLY, adv, 8).dropna(subset=["pred", "size"])
    return rounded(
        d.select(
            "symbol",
            "datetime",
            xs.fractional_kelly(F.col("pred"), F.col("size")).alias("kelly"),
            xs.sqrt_impact_discount(F.col("pred") * 1e5, F.col("adv")).alias("impact"),
        )
    )
