"""Queries over the feature library (inventory 2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ordered import WEEKLY, Ordered, rolling
from ..operators import features as X
from ..operators import xs
from . import sqlgen as S
from .registry import query, rounded, view

FLOW = ["order_flow_imbalance", "avg_trade_size", "count"]
Z_COLS = [f"{c}_z{n}" for c in FLOW for n in X.FLOW_WINDOWS]
MOM = [f"{k}_{n}" for k in ("momentum", "mean_reversion") for n in X.MOMENTUM_WINDOWS]
RV = [f"realized_vol_{n}" for n in X.VOL_WINDOWS]
CYC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
BASE = ["taker_buy_ratio", "order_flow_imbalance", "avg_trade_size", *CYC, "log_return", *MOM]
RAW = [*BASE, *Z_COLS, *RV, "vol_of_vol_96", "vol_regime"]

view(
    "feat1",
    f"""select *, taker_buy_volume / nullif(volume, 0) as taker_buy_ratio,
  2 * taker_buy_volume / nullif(volume, 0) - 1 as order_flow_imbalance, volume / count as avg_trade_size,
  sin(2 * pi() * hour(datetime) / 24) as hour_sin, cos(2 * pi() * hour(datetime) / 24) as hour_cos,
  sin(2 * pi() * isodow(datetime) / 7) as dow_sin, cos(2 * pi() * isodow(datetime) / 7) as dow_cos,
  ln(close / lag(close) over w) as log_return,
  {", ".join(f"ln(close / lag(close, {n}) over w) as momentum_{n}, -ln(close / lag(close, {n}) over w) as mean_reversion_{n}" for n in X.MOMENTUM_WINDOWS)},
  ln(lead(close) over w / close) as fwd_return_1
from bars_w window w as ({S.W})""",
)
view(
    "feat2",
    "select *, "
    + ", ".join(f"{S.z(c, n)} as {c}_z{n}" for c in FLOW for n in X.FLOW_WINDOWS)
    + ", "
    + ", ".join(f"{S.std('log_return', n)} as realized_vol_{n}" for n in X.VOL_WINDOWS)
    + " from feat1",
)
view(
    "features_w",
    f"""select *, {S.std("realized_vol_8", 96)} as vol_of_vol_96,
  realized_vol_8 / nullif(realized_vol_96, 0) as vol_regime from feat2""",
)


@query(
    "36, 37, 38, 39, 40, 41",
    f"select symbol, datetime, {S.rnd(['taker_buy_ratio', *FLOW[:2], *Z_COLS])} from features_w",
)
def order_flow_features(t):
    d = rolling(
        t.bars_w(), WEEKLY, [lambda w: X.flow_ratios(), X.flow_zscores], back=X.FLOW_WINDOWS[-1]
    )
    return rounded(d.select("symbol", "datetime", "taker_buy_ratio", *FLOW[:2], *Z_COLS))


@query(
    "42, 58",
    """select symbol, datetime, round(sin(2 * pi() * hour(datetime) / 24), 6) as hour_sin,
  round(cos(2 * pi() * hour(datetime) / 24), 6) as hour_cos,
  round(sin(2 * pi() * isodow(datetime) / 7), 6) as dow_sin,
  round(cos(2 * pi() * isodow(datetime) / 7), 6) as dow_cos from bars_1h""",
)
def seasonality_features(t):
    b = t.bars_1h()
    return rounded(
        b.select("symbol", "datetime", *[c.alias(n) for n, c in X.calendar_cycles().items()])
    ).withColumns({c: F.col(c) + F.lit(0.0) for c in CYC})


@query(
    "24, 43, 44",
    f"select symbol, datetime, {S.rnd(['log_return', *RV, 'vol_of_vol_96', 'vol_regime'])} from features_w",
)
def vol_features(t):
    from ..functions.exprs import log_return

    d = rolling(
        t.bars_w().select("symbol", "datetime", "close"),
        WEEKLY,
        [lambda w: {"log_return": log_return(w)}, X.realized_vols, X.vol_shape],
        back=1 + 2 * X.VOL_WINDOWS[-1],
    )
    return rounded(d.drop("close"))


@query("45, 46, 59", f"select symbol, datetime, {S.rnd(MOM)} from features_w")
def momentum_features(t):
    d = rolling(t.bars_w().select("symbol", "datetime", "close"), WEEKLY, X.momenta, back=12)
    return rounded(d.drop("close"))


view(
    "bars_funding",
    """select b.*, f.funding_rate from bars_w b asof left join funding f
  on b.symbol = f.symbol and b.datetime >= f.datetime""",
)


@query(
    "47, 80",
    f"""select symbol, datetime, round(funding_rate, 12) as funding_rate,
  round({S.z("funding_rate", 20)}, 6) as funding_rate_z20 from bars_funding""",
)
def funding_feature(t):
    d = X.add_funding(t.bars_w().select("symbol", "datetime"), t.funding(), WEEKLY)
    return rounded(d.select("symbol", "datetime", "funding_rate", "funding_rate_z20"), funding_rate=12)


@query(
    "36, 48", f"select symbol, datetime, {S.rnd([*RAW, 'fwd_return_1'])} from features_w"
)
def raw_feature_bundle(t):
    return rounded(X.raw_features(t.bars_w(), WEEKLY).select("symbol", "datetime", *RAW, "fwd_return_1"))


CS = ["momentum_4", "realized_vol_8"]


def _cs_sql(cols: list[str]) -> str:
    return ", ".join(
        f"round({c} - avg({c}) over (partition by datetime), 6) as {c}_cs_demean, "
        f"round(({c} - avg({c}) over (partition by datetime)) / "
        f"nullif(stddev_samp({c}) over (partition by datetime), 0), 6) as {c}_cs_z"
        for c in cols
    )


@query("49, 50, 51", f"select symbol, datetime, {_cs_sql(CS)} from features_w")
def cross_sectional_features(t):
    d = X.raw_features(t.bars_w(), WEEKLY).select("symbol", "datetime", *CS)
    return rounded(xs.cross_section(d, CS).drop(*CS))


NON_CYC = [c for c in RAW if c not in CYC]


@query(
    "52",
    f"select symbol, datetime, {S.rnd([*RAW, 'fwd_return_1'])}, {_cs_sql(NON_CYC)} from features_w",
)
def feature_panel(t):
    return rounded(
        X.feature_panel(t.bars_w(), NON_CYC, s=WEEKLY).drop(
            "open", "high", "low", "close", "volume", "count", "taker_buy_volume"
        )
    )


@query(
    "53, 54",
    """select symbol, datetime, round(fwd_return_1 / realized_vol_24, 6) as target_vol_norm,
  round(greatest(-1, least(1, momentum_4 / realized_vol_24)) * (0.02 / realized_vol_24), 6) as vol_targeted_size
from features_w where realized_vol_24 > 1e-12""",
)
def vol_targets(t):
    d = X.raw_features(t.bars_w(), WEEKLY).where(F.col("realized_vol_24") > 1e-12)
    pred = ratio("momentum_4", "realized_vol_24")
    return rounded(
        d.select(
            "symbol",
            "datetime",
            ratio("fwd_return_1", "realized_vol_24").alias("target_vol_norm"),
            xs.vol_targeted_size(pred, F.col("realized_vol_24"), 0.02).alias("vol_targeted_size"),
        )
    )


view(
    "caps",
    """select n_name as symbol, sum(s_acctbal) as market_cap from supplier join nation
  on s_nationkey = n_nationkey group by 1 having sum(s_acctbal) > 0""",
)


def caps(t):
    d = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    d = d.groupBy(F.col("n_name").alias("symbol")).agg(F.sum("s_acctbal").alias("market_cap"))
    return d.where("market_cap > 0")


view(
    "quality",
    f"""select x.*, coalesce(market_cap, 0) as market_cap from (
select *, {S.mean("log_return", 120, shift=1)} / greatest({S.std("log_return", 120, shift=1)}, 1e-9) * sqrt(365 * 4) as trailing_sharpe,
  {S.std("log_return", 20, shift=1)} as realized_vol_20 from feat1) x left join caps on x.symbol = caps.symbol
where realized_vol_20 > 1e-12""",
)


@query(
    "55",
    f"select symbol, datetime, {S.rnd('trailing_sharpe realized_vol_20')}, round(market_cap, 2) as market_cap from quality",
)
def quality_features(t):
    d = X.quality_features(t.bars_w().select("symbol", "datetime", "close"), caps(t), WEEKLY)
    d = d.select("symbol", "datetime", "trailing_sharpe", "realized_vol_20", "market_cap")
    return rounded(d, market_cap=2)


@query(
    "60",
    f"select symbol, datetime, round({S.roll('sum', 'log_return', 12)}, 6) as trend from feat1",
)
def trend_sum(t):
    d = X.trend_sum(t.bars_w().select("symbol", "datetime", "close"), 12, WEEKLY)
    return rounded(d.select("symbol", "datetime", "trend"))


WP = "partition by product order by date"


@query(
    "61, 62",
    f"""with a as (select *, {S.lnr("close_f1", f"lag(close_f1) over ({WP})")} as ret from curve),
b as (select *, -({S.lnr("close_f2", "close_f1")}) / 30 * 365.0 as carry_signal,
  {S.roll("sum", "ret", 4, WP)} as mom_4, {S.roll("sum", "ret", 13, WP)} as mom_13, {S.roll("sum", "ret", 26, WP)} as mom_26,
  lead(ret) over ({WP}) as fwd_return_1,
  case when count(*) over ({WP} rows between 1 following and 5 following) = 5
    then coalesce(sum(ret) over ({WP} rows between 1 following and 5 following), 0) end as fwd_return_h,
  {S.std("ret", 20, WP)} as sd from a)
select product, date, {S.rnd("carry_signal mom_4 mom_13 mom_26 fwd_return_1 fwd_return_h")},
  round(case when sd is not null then 1 / greatest(sd, 1e-6) end, 6) as inv_vol, round(list_avg([mom_4, mom_13, mom_26]), 6) as mom_blend from b""",
)
def carry_momentum_signals(t):
    from ..functions.exprs import log_return

    s = Ordered(("product",), ("date",), step=1)
    c = rolling(t.curve(), s, lambda w: {"ret": log_return(w, "close_f1")}, back=1)
    looks = {"mom_4": 4, "mom_13": 13, "mom_26": 26}
    d = X.product_signals(c, "ret", looks, 5, s)
    d = X.blended(d, "ret", list(looks), s)
    keep = ["carry_signal", *looks, "fwd_return_1", "fwd_return_h", "inv_vol", "mom_blend"]
    return rounded(d.select("product", "date", *keep))


view("baskets", "select n_name as symbol, r_name as basket from nation join region on n_regionkey = r_regionkey")


def baskets(t):
    d = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("basket"))


def _pct(part: str) -> str:
    return (
        f"case when momentum_4 is not null then (rank() over (partition by {part} order by momentum_4)"
        f" + (count(*) over (partition by {part}, momentum_4) - 1) / 2.0)"
        f" / count(momentum_4) over (partition by {part}) end"
    )


@query(
    "56, 164",
    f"""with a as (select f.symbol, cast(f.datetime as date) as date, b.basket, momentum_4,
  ln(lead(close, 4) over w / close) as fwd_return, sign(close - lag(close) over w) as realized_1d_sign,
  sign(ln(close / lag(close, 60) over w)) as trailing_60d_sign
  from features_w f join baskets b on f.symbol = b.symbol window w as (partition by f.symbol order by f.datetime)),
p as (select * from a where fwd_return is not null)
select p.symbol, p.date, p.basket, round(momentum_4, 6) as momentum_4, round(fwd_return, 6) as fwd_return,
  cast(realized_1d_sign as double) as realized_1d_sign, cast(trailing_60d_sign as double) as trailing_60d_sign, cast(sign(fwd_return) as int) as y,
  round({_pct("p.date")}, 6) as rank_panel_momentum_4, round({_pct("p.date, p.basket")}, 6) as rank_basket_momentum_4,
  round(sin(2 * pi() * (isodow(p.date) - 1) / 5), 6) as cal_dow_sin, round(cos(2 * pi() * (isodow(p.date) - 1) / 5), 6) as cal_dow_cos,
  round(sin(2 * pi() * month(p.date) / 12), 6) + 0.0 as cal_month_sin, round(cos(2 * pi() * month(p.date) / 12), 6) + 0.0 as cal_month_cos,
  round(close_f1 - close_f2, 7) as spread_12, round(close_f2 - close_f3, 7) as spread_23
from p left join curve c on c.product = p.basket and c.date = p.date""",
)
def pooled_panel(t):
    d = rolling(t.bars_w().select("symbol", "datetime", "close"), WEEKLY, X.momenta, back=12)
    d = d.join(baskets(t), "symbol").withColumn("date", F.to_date("datetime"))
    d = d.select("symbol", "date", "basket", "close", "momentum_4")
    d = X.pooled_panel(d, ["momentum_4"], "close", 4, t.curve()).drop("close")
    return rounded(d, spread_12=7, spread_23=7).withColumns(
        {c: F.col(c).cast("double") for c in ("realized_1d_sign", "trailing_60d_sign")}
    )


@query(
    "57",
    f"""with a as (select symbol, datetime, fwd_return_1, row_number() over ({S.W}) as i from feat1),
b as (select *, (i - 1) // 13 as b, (i - 1) % 13 as o from a),
k as (select symbol, b, count(*) as len, {S.hash_int("'7|' || symbol || '|' || b")} as h from b group by 1, 2),
e as (select *, sum(len) over (partition by symbol order by h, b rows unbounded preceding) - len as start from k),
m as (select b.symbol, e.start + b.o + 1 as i, b.fwd_return_1 as s from b join e on b.symbol = e.symbol and b.b = e.b)
select b.symbol, b.datetime, round(b.fwd_return_1, 6) as fwd_return_1, round(m.s, 6) as fwd_return_1_shuffled
from b join m on b.symbol = m.symbol and b.i = m.i""",
)
def block_shuffle(t):
    from ..functions.exprs import forward_return

    d = rolling(
        t.bars_w().select("symbol", "datetime", "close"),
        WEEKLY,
        lambda w: {"fwd_return_1": forward_return(w)},
        back=0,
        ahead=1,
    )
    return rounded(X.block_shuffle(d.drop("close"), ["fwd_return_1"], 13, 7, WEEKLY))


