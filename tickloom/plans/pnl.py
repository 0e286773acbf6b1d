"""Queries over costs, P&L and metrics (inventory 2.E join row and 2.F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import log_return
from ..functions.ordered import CALENDAR, WEEKLY, Ordered, rolling
from ..operators import folds as FO
from ..operators import pnl as P
from . import sqlgen as S
from .portfolio import NAMES, signals, var_w, weights_w
from .registry import query, rounded, view

ANN = 52.0**0.5
UP = "rows unbounded preceding"


def dd_sql(src: str, pairs: dict[str, tuple[str, str]], part: str, order: str) -> str:
    """Add running sums and drawdowns to a source."""
    p = f"partition by {part}" if part else ""
    eq = ", ".join(f"sum({r}) over ({p} order by {order} {UP}) as {e}" for r, (e, _) in pairs.items())
    dd = ", ".join(
        f"{e} - max({e}) over ({p} order by {order} {UP}) as {d}" for e, d in pairs.values()
    )
    return f"select *, {dd} from (select *, {eq} from {src})"


def metric_sql(ret: str, dd: str, ann: str, sfx: str = "") -> str:
    return f"""round(coalesce(sum({ret}), 0), 6) as total_log_return{sfx}, round(exp(coalesce(sum({ret}), 0)) - 1, 6) as compound_return{sfx},
  round(coalesce(stddev_samp({ret}), 0), 6) as std{sfx}, round(coalesce(avg({ret}) / nullif(stddev_samp({ret}), 0) * {ann}, 0), 6) as sharpe{sfx},
  round(coalesce(min({dd}), 0), 6) as max_drawdown{sfx}"""


COST_SQL = """round(avg(turnover), 6) as mean_turnover_per_bar, round(avg(turnover) * 52, 6) as turnover_per_year,
  round(-avg(cost_log_return) * 52, 6) as annual_fee_drag_log, round(exp(-avg(cost_log_return) * 52) - 1, 6) as annual_fee_drag_pct"""

view(
    "tf_sym",
    dd_sql(
        """(select symbol, datetime, pred, fwd_return_1, p as position, p * fwd_return_1 as trade_log_return,
 case when p <> 0 then sign(pred) = sign(fwd_return_1) end as is_won,
 abs(p - coalesce(lag(p) over (partition by symbol order by datetime), 0)) as turnover from (
  select *, cast(case when abs(pred) > 0.05 then sign(pred) else 0 end as double) as p from sig where pred is not null and fwd_return_1 is not null))""",
        {"trade_log_return": ("equity_curve", "drawdown_log_return")},
        "symbol",
        "datetime",
    ),
)
view(
    "tf_cost",
    dd_sql(
        """(select *, ln(1 - 0.0005e0 * turnover) as cost_log_return,
 trade_log_return + ln(1 - 0.0005e0 * turnover) as trade_log_return_net from tf_sym)""",
        {"trade_log_return_net": ("equity_curve_net", "drawdown_log_return_net")},
        "symbol",
        "datetime",
    ),
)


def trades_by_symbol(t):
    d = signals(t).select("symbol", "datetime", "pred", "fwd_return_1").dropna()
    return P.trade_frame(d, "pred", "fwd_return_1", WEEKLY, 0.05)


@query(
    "89",
    """select symbol, datetime, position, is_won, round(trade_log_return, 6) + 0.0 as trade_log_return,
  round(equity_curve, 6) + 0.0 as equity_curve, round(drawdown_log_return, 6) + 0.0 as drawdown_log_return from tf_sym""",
)
def trade_frame(t):
    return rounded(trades_by_symbol(t).drop("pred", "fwd_return_1"))


@query(
    "90",
    f"""select *, round(wr * aw + (1 - wr) * al, 6) as ev from (select symbol, count(*) as no_bars, count(case when position <> 0 then 1 end) as no_trades,
  round(count(case when position <> 0 then 1 end) / count(*), 6) as frac_time_in_market,
  round(coalesce(avg(cast(is_won as int)), 0), 6) as win_rate, round(coalesce(avg(case when is_won then trade_log_return end), 0), 6) as avg_win,
  round(coalesce(avg(case when not is_won then trade_log_return end), 0), 6) as avg_loss, coalesce(avg(cast(is_won as int)), 0) as wr,
  coalesce(avg(case when is_won then trade_log_return end), 0) as aw, coalesce(avg(case when not is_won then trade_log_return end), 0) as al,
  round(max(trade_log_return), 6) as best_trade, round(min(trade_log_return), 6) as worst_trade,
  round(min(equity_curve), 6) as equity_trough, round(max(equity_curve), 6) as equity_peak,
  {metric_sql("trade_log_return", "drawdown_log_return", "sqrt(52)")} from tf_sym group by 1)""".replace(
        "select *, round(wr", "select * exclude (wr, aw, al), round(wr"
    ),
)
def eval_metrics(t):
    return rounded(P.eval_metrics(trades_by_symbol(t), ["symbol"], ANN))


@query(
    "94",
    "select symbol, datetime, turnover, "
    + S.rnd("cost_log_return trade_log_return_net equity_curve_net drawdown_log_return_net").replace(", 6)", ", 6) + 0.0")
    + " from tf_cost",
)
def trading_costs(t):
    d = P.add_trading_costs(trades_by_symbol(t), WEEKLY, 0.0004)
    return rounded(
        d.select(
            "symbol", "datetime", "turnover", "cost_log_return", "trade_log_return_net",
            "equity_curve_net", "drawdown_log_return_net",
        )
    )


@query(
    "93",
    """select symbol, datetime, round(ln(1 - 0.0002e0 * turnover), 6) + 0.0 as tx_fee_log_maker, round(ln(1 - 0.0004e0 * turnover), 6) + 0.0 as tx_fee_log_taker,
  round(trade_log_return + ln(1 - 0.0002e0 * turnover), 6) + 0.0 as trade_log_return_net_maker,
  round(trade_log_return + ln(1 - 0.0004e0 * turnover), 6) + 0.0 as trade_log_return_net_taker,
  round(sum(trade_log_return + ln(1 - 0.0002e0 * turnover)) over w, 6) + 0.0 as equity_curve_net_maker,
  round(sum(trade_log_return + ln(1 - 0.0004e0 * turnover)) over w, 6) + 0.0 as equity_curve_net_taker
from tf_sym window w as (partition by symbol order by datetime rows unbounded preceding)""",
)
def turnover_fees(t):
    d = P.fees_log(trades_by_symbol(t), WEEKLY, {"maker": 0.0002, "taker": 0.0004})
    keep = [c for c in d.columns if c.endswith(("_maker", "_taker"))]
    return rounded(d.select("symbol", "datetime", *keep))


@query(
    "91, 92",
    """select symbol, datetime, round(open * volume * 0.0002e0 + close * volume * 0.0002e0, 9) as tx_fee_maker,
  round(open * volume * 0.0004e0 + close * volume * 0.0004e0, 9) as tx_fee_taker from bars_w""",
)
def flat_fees(t):
    d = t.bars_w().select(
        "symbol",
        "datetime",
        (F.col("open") * F.col("volume")).alias("entry_trade_value"),
        (F.col("close") * F.col("volume")).alias("exit_trade_value"),
    )
    d = P.flat_fees(d, {"maker": 0.0002, "taker": 0.0004})
    return rounded(d.drop("entry_trade_value", "exit_trade_value"), 9)


@query(
    "95, 96, 97",
    f"""select symbol, count(*) as no_bars, count(case when position <> 0 then 1 end) as no_trades,
  round(count(case when position <> 0 then 1 end) / count(*), 6) as frac_time_in_market,
  round(coalesce(avg(cast(is_won as int)), 0), 6) as win_rate, {metric_sql("trade_log_return", "drawdown_log_return", "sqrt(52)")},
  {metric_sql("trade_log_return_net", "drawdown_log_return_net", "sqrt(52)", "_net")}, {COST_SQL} from tf_cost group by 1""",
)
def stitched_metrics(t):
    d = P.add_trading_costs(trades_by_symbol(t), WEEKLY, 0.0004)
    return rounded(P.stitched_metrics(d, ["symbol"], ANN))


view(
    "bh",
    dd_sql(
        "(select symbol, datetime, coalesce(log_return, 0) as trade_log_return from feat1)",
        {"trade_log_return": ("equity_curve", "drawdown_log_return")},
        "symbol",
        "datetime",
    ),
)


@query(
    "98",
    f"select symbol, datetime, {S.rnd('trade_log_return equity_curve drawdown_log_return')} from bh",
)
def buy_and_hold(t):
    return rounded(P.buy_and_hold(t.bars_w(), WEEKLY))


@query(
    "96, 99, 100",
    f"""select symbol, cast(p as double) as position, count(*) as no_bars, {metric_sql("r", "dd", "sqrt(52)")} from (
{dd_sql("(select symbol, datetime, p, coalesce(log_return, 0) * p as r from feat1, (select unnest([-1, 0, 1]) as p))", {"r": ("eq", "dd")}, "symbol, p", "datetime")}) group by 1, 2""",
)
def constant_positions(t):
    d = P.buy_and_hold(t.bars_w(), WEEKLY).select("symbol", "datetime", "trade_log_return")
    d = d.withColumn("position", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))))
    d = d.withColumn("r", F.col("trade_log_return") * F.col("position"))
    s = Ordered(("symbol", "position"), ("datetime",), step=7)
    return rounded(P.series_metrics(d, s, "r", ANN))


@query(
    "101",
    f"""select symbol, seed, round(coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(52), 0), 6) as sharpe,
  round(sum(r), 6) as total_log_return from (
select symbol, cast(seed as int) as seed, coalesce(log_return, 0) * case when {S.hash_int("seed || '|' || symbol || '|' || cast(epoch(datetime) as bigint)")} % 2 = 0 then 1 else -1 end as r
from feat1, (select unnest(range(10)) as seed)) group by 1, 2""",
)
def random_positions(t):
    d = P.random_positions(t.bars_w(), WEEKLY, 10, ANN)
    return rounded(d.drop("compound_return"))


@query(
    "102", "select datetime, round(avg(fwd_return_1), 6) as trade_log_return from sig group by 1"
)
def equal_weight_basket(t):
    return rounded(P.equal_weight_basket(signals(t)))


view(
    "frame_w",
    """select a.datetime, a.trade_log_return, b.turnover from (
 select w.datetime, sum(weight * s.fwd_return_1) as trade_log_return from weights_w w join sig s
  on w.symbol = s.symbol and w.datetime = s.datetime group by 1) a
join (select datetime, sum(abs(weight - p)) as turnover from (
  select datetime, weight, coalesce(lag(weight) over (partition by symbol order by datetime), 0) as p from weights_w) group by 1) b
on a.datetime = b.datetime where a.trade_log_return is not null""",
)
view(
    "frame_cost",
    dd_sql(
        """(select *, ln(1 - 0.0005e0 * turnover) as cost_log_return, trade_log_return + ln(1 - 0.0005e0 * turnover) as trade_log_return_net from frame_w)""",
        {
            "trade_log_return": ("eq", "dd"),
            "trade_log_return_net": ("equity_curve_net", "drawdown_log_return_net"),
        },
        "",
        "datetime",
    ),
)


def frame_w(t):
    f = P.portfolio_frame(weights_w(t), signals(t), "fwd_return_1", s=WEEKLY)
    return f.where(F.col("trade_log_return").isNotNull())


@query(
    "86, 104",
    "select datetime, round(trade_log_return, 6) as trade_log_return, round(turnover, 6) as turnover from frame_w",
)
def portfolio_frame(t):
    return rounded(frame_w(t))


@query(
    "105",
    "select datetime, "
    + S.rnd("cost_log_return trade_log_return_net equity_curve_net drawdown_log_return_net").replace(", 6)", ", 6) + 0.0")
    + " from frame_cost",
)
def portfolio_costs(t):
    return rounded(P.portfolio_costs(frame_w(t), 0.0004, s=WEEKLY).drop("trade_log_return", "turnover"))


@query(
    "106",
    f"""select count(*) as no_bars, {metric_sql("trade_log_return", "dd", "sqrt(52)")},
{metric_sql("trade_log_return_net", "drawdown_log_return_net", "sqrt(52)", "_net")}, {COST_SQL} from frame_cost""",
)
def portfolio_metrics(t):
    return rounded(P.portfolio_metrics(frame_w(t), ANN, 0.0004, s=WEEKLY))


RAND = f"""(select symbol, datetime, seed, fwd_return_1, {S.hash_int("seed || '|' || symbol || '|' || cast(epoch(datetime) as bigint)")} as pred
 from sig, (select cast(unnest(range(3)) as int) as seed))"""
from .portfolio import dn_sql  # noqa: E402


@query(
    "103",
    f"""with w as ({dn_sql(RAND, "1", part="datetime, seed")}),
g as (select seed, datetime, sum(weight * fwd_return_1) as r from w group by 1, 2),
u as (select seed, datetime, sum(abs(weight - p)) as t from (select *, coalesce(lag(weight) over (partition by seed, symbol order by datetime), 0) as p from w) group by 1, 2),
n as (select g.seed, r + ln(1 - 0.0005e0 * t) as net from g join u on g.seed = u.seed and g.datetime = u.datetime)
select seed, round(coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(52), 0), 6) as sharpe, round(sum(net), 6) as total_log_return,
 round(exp(sum(net)) - 1, 6) as compound_return from n group by 1""",
)
def random_rankings(t):
    return rounded(P.random_rankings(signals(t), 3, ANN, 0.0004, s=WEEKLY, names=NAMES))


CODES = ["CL", "NG", "GC", "PL", "ZC"]
SPEC_SQL = "select r_name as product, ['CL', 'NG', 'GC', 'PL', 'ZC'][r_regionkey + 1] as code, [0.01, 0.001, 0.1, 0.1, 0.0025][r_regionkey + 1]::double as tick, [10, 10, 10, 5, 12.5][r_regionkey + 1]::double as tv, case when r_regionkey = 3 then 2 else 1 end as wide from region"
view("spec", SPEC_SQL)


def codes(t):
    arr = F.array(*[F.lit(c) for c in CODES])
    return t.read("region").select(
        F.col("r_name").alias("product"), F.element_at(arr, F.col("r_regionkey") + 1).alias("code")
    )


@query(
    "107, 108",
    """select c.product, date, contract_id, round(2.5 + tv * wide, 4) as round_turn,
  round((2.5 + tv * wide) / (abs(close) * tv / tick) * 1e6, 6) as per_notional_ppm from contract_bars c join spec s on c.product = s.product""",
)
def contract_costs(t):
    d = t.contract_bars().join(codes(t), "product")
    return d.select(
        "product",
        "date",
        "contract_id",
        F.round(P.round_turn_cost("code"), 4).alias("round_turn"),
        F.round(P.cost_per_notional("code", "close") * 1e6, 6).alias("per_notional_ppm"),
    )


@query(
    "109",
    """select spread, date, cast((select sum(2.5 + tv * wide) from spec) as double) as cost from spreads""",
)
def multi_leg_cost(t):
    d = t.spreads().select("spread", "date", F.array(*[F.lit(c) for c in CODES]).alias("legs"))
    return d.select("spread", "date", P.multi_leg_cost("legs").alias("cost"))



def _fspec(t):
    """A tick schedule for the weekly symbols: tick 0.01, tick value by name."""
    from .bars import NATIONS

    return {n: (0.01, 0.05 + i / 100, 2.5) for i, n in enumerate(NATIONS)}


FC_SQL = """select datetime, sum(d * (2.5 + tv) / (abs(close) * tv / 0.01e0)) as cost_frac from (
 select w.datetime, w.close, abs(weight - coalesce(lag(weight) over (partition by symbol order by datetime), 0)) as d,
  0.05e0 + cast(substr(symbol, 8) as int) / 100.0e0 as tv from weights_w w) group by 1"""
view("fut_costs", FC_SQL.replace("w.close", "close").replace("from weights_w w", "from (select x.*, b.close from weights_w x join bars_w b on x.symbol = b.symbol and x.datetime = b.datetime)").replace("w.datetime", "datetime"))


@query("110", "select datetime, round(cost_frac, 8) as cost_frac from fut_costs")
def futures_costs(t):
    c = P.futures_costs(weights_w(t), t.bars_w(), _fspec(t), s=WEEKLY)
    return rounded(c, 8)


@query(
    "111, 112",
    f"""with x as ({dd_sql('''(select f.*, ln(1 - coalesce(cost_frac, 0)) as cost_log_return, trade_log_return + ln(1 - coalesce(cost_frac, 0)) as net
 from frame_w f left join fut_costs c on f.datetime = c.datetime)''', {"trade_log_return": ("eq", "dd"), "net": ("eqn", "ddn")}, "", "datetime")})
select count(*) as no_bars, {metric_sql("trade_log_return", "dd", "sqrt(52)")}, {metric_sql("net", "ddn", "sqrt(52)", "_net")}, {COST_SQL}, true as cost_ok from x""",
)
def futures_metrics(t):
    costs = P.futures_costs(weights_w(t), t.bars_w(), _fspec(t), s=WEEKLY)
    return rounded(P.futures_metrics(frame_w(t), costs, ANN, WEEKLY))


FOLD_W = "select fold, b.datetime from (select distinct datetime, dense_rank() over (order by datetime) - 1 as i from sig) b join (select cast(f as int) as fold, 104 + 26 * f as a, 130 + 26 * f as z from (select unnest(range(100)) as f)) k on i >= a and i < z where z <= (select count(distinct datetime) from sig)"
view("test_folds", FOLD_W)


@query(
    "113",
    """select fold, round(coalesce(sum(net), 0) - coalesce(sum(b), 0), 6) as excess_return from test_folds f
left join (select datetime, avg(fwd_return_1) as b from sig group by 1) b on f.datetime = b.datetime
left join (select datetime, trade_log_return_net as net from frame_cost) n on f.datetime = n.datetime group by 1""",
)
def fold_excess_returns(t):
    sig = signals(t)
    fl = FO.panel_folds(sig.select("datetime"), WEEKLY, train=104, test=26)
    fl = fl.where(F.col("side") == "test").select("fold", "datetime")
    net = P.portfolio_costs(frame_w(t), 0.0004, s=WEEKLY).select("datetime", "trade_log_return_net")
    return rounded(P.fold_excess(net, sig, fl, "fwd_return_1"))


@query(
    "114",
    """select count(*) as n_total_rows, count(funding_rate_z20) as n_rows_with, round(count(funding_rate_z20) / count(*), 6) as frac_rows_with,
  count(distinct case when funding_rate_z20 is not null then symbol end) as n_symbols_with, count(distinct symbol) as n_symbols_total
from (select symbol, """
    + S.z("funding_rate", 20)
    + " as funding_rate_z20 from bars_funding)",
)
def feature_coverage(t):
    from ..operators import features as X

    d = X.add_funding(t.bars_w().select("symbol", "datetime"), t.funding(), WEEKLY)
    return rounded(P.feature_coverage(d, "funding_rate_z20"))


TRADES = """select o_orderkey as trade_id, cast(o_orderdate as date) as date, (o_totalprice - 150000) / 10000.0 as pnl, 1 + o_custkey % 5 as qty,
  o_totalprice / 50000.0 + 0.5 as atr, (o_custkey % 400) / 100.0 - 2 as entry_z, case o_orderstatus when 'F' then 'stop' when 'O' then 'zscore' else 'data_end' end as exit_reason,
  -(o_custkey % 97) / 10.0 as mae_atr, (o_orderkey % 89) / 10.0 as mfe_atr from orders"""
view("trade_log", "select *, pnl / nullif(qty * atr, 0) as pnl_atr, pnl / 1e6 as ret_eq from (" + TRADES + ")")


def trade_log(t):
    o = t.read("orders")
    reason = F.when(F.col("o_orderstatus") == "F", "stop").when(
        F.col("o_orderstatus") == "O", "zscore"
    )
    d = o.select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        ((F.col("o_totalprice") - 150000) / 10000.0).alias("pnl"),
        (1 + F.col("o_custkey") % 5).alias("qty"),
        (F.col("o_totalprice") / 50000.0 + 0.5).alias("atr"),
        ((F.col("o_custkey") % 400) / 100.0 - 2).alias("entry_z"),
        reason.otherwise("data_end").alias("exit_reason"),
        (-(F.col("o_custkey") % 97) / 10.0).alias("mae_atr"),
        ((F.col("o_orderkey") % 89) / 10.0).alias("mfe_atr"),
    )
    return d.withColumns(
        {
            "pnl_atr": P.pnl_atr(F.col("pnl"), F.col("qty"), F.col("atr")),
            "ret_eq": P.ret_eq(F.col("pnl"), F.lit(1e6)),
        }
    )


@query(
    "118, 119",
    "select trade_id, round(pnl_atr, 6) as pnl_atr, round(ret_eq, 9) as ret_eq from trade_log",
)
def trade_returns(t):
    d = trade_log(t).select("trade_id", "pnl_atr", "ret_eq")
    return d.select(
        "trade_id", F.round("pnl_atr", 6).alias("pnl_atr"), F.round("ret_eq", 9).alias("ret_eq")
    )


BOOK = """with e as (select date, 1e6 + sum(p) over (order by date rows unbounded preceding) as equity from (select date, sum(pnl) as p from trade_log group by 1)),
x as (select date, equity, equity / lag(equity) over (order by date) - 1 as r, equity / max(equity) over (order by date rows unbounded preceding) - 1 as dd from e),
m as (select avg(r) / stddev_pop(r) * sqrt(252) as sh, min(dd) as mdd, arg_max(equity, date) as fin from x)
select round(sh, 6) as sharpe, round(mdd, 6) as max_drawdown, round(s, 6) as fixed_notional_return, round(fin / 1e6 - 1, 6) as equity_path_return,
 round((fin / 1e6 - 1) / nullif(abs(mdd), 0), 6) as return_over_drawdown, n as n_trades, {cols}, round(fin, 6) as final_equity
from m, (select sum(ret_eq) as s, count(*) as n, count(case when exit_reason = 'stop' then 1 end) as ns, count(case when exit_reason = 'zscore' then 1 end) as nz from trade_log)"""


def book(t):
    day = trade_log(t).groupBy("date").agg(F.sum("pnl").alias("p"))
    from ..functions.ordered import running

    d = running(day, CALENDAR, {"c": ("sum", F.col("p"))})
    return d.select("date", (F.lit(1e6) + F.col("c")).alias("equity"))


@query("115", BOOK.format(cols="ns as n_stop_exits, n - ns as n_zscore_exits"))
def book_metrics(t):
    return rounded(P.book_metrics(book(t), trade_log(t), 1e6, ["stop"], "zscore"))


@query(
    "116",
    BOOK.format(cols="ns as n_stop_exits, nz as n_zscore_exits, n - ns - nz as n_data_end_exits"),
)
def breakout_book_metrics(t):
    return rounded(P.book_metrics(book(t), trade_log(t), 1e6, ["stop", "zscore"], "data_end"))


@query(
    "117",
    """with d as (select *, case when pnl_atr >= (select quantile_cont(pnl_atr, 0.5) from trade_log) then 'top' else 'worst' end as half from trade_log),
h as (select half, count(*) as n, quantile_cont(abs(entry_z), 0.5) as z, avg(case when exit_reason = 'stop' then 1.0 else 0 end) as f from d group by 1),
e as (select exit_reason, count(*) as n, avg(pnl_atr) as m, quantile_cont(mae_atr, 0.5) as a, quantile_cont(mfe_atr, 0.5) as b from trade_log group by 1)
select grp, stat, round(v, 6) + 0.0 as v from (
select half as grp, 'n' as stat, cast(n as double) as v from h union all select half, 'median_abs_entry_z', z from h union all select half, 'stop_fraction', f from h
union all select exit_reason, 'n', n from e union all select exit_reason, 'mean_pnl_atr', m from e union all select exit_reason, 'median_mae', a from e
union all select exit_reason, 'median_mfe', b from e
union all select 'all', 'loss_win_asymmetry', abs(max(case when exit_reason = 'stop' then m end) / max(case when exit_reason = 'zscore' then m end)) from e)""",
)
def trade_atlas(t):
    return rounded(P.trade_atlas(trade_log(t), "stop", "zscore"))


@query(
    "120",
    """with g as (select bps, avg(trade_log_return - bps / 1e4 * turnover) / stddev_pop(trade_log_return - bps / 1e4 * turnover) as s
 from (select abs(trade_log_return) + trade_log_return as trade_log_return, turnover from frame_w), (select unnest(range(0, 401)) * 100.0 as bps) group by 1)
select cast(case when max(case when bps = 0 then s end) > 0 then min(case when s <= 0 then bps end) end as double) as breakeven_bps from g""",
)
def breakeven_cost(t):
    f = frame_w(t).withColumn(
        "trade_log_return", F.abs("trade_log_return") + F.col("trade_log_return")
    )
    return P.breakeven_cost(f, "trade_log_return", "turnover", [i * 100.0 for i in range(401)])


@query(
    "121",
    f"""with m as (select f.symbol, f.log_return as y, b.m as x from feat1 f join (select datetime, avg(log_return) as m from feat1 group by 1) b
 on f.datetime = b.datetime where f.log_return is not null and b.m is not null)
select symbol, round(case when count(*) >= 30 then regr_slope(y, x) end, 6) as beta, round(case when count(*) >= 30 then regr_intercept(y, x) * 252 end, 6) as alpha_annualized,
 round(case when count(*) >= 30 then sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / count(*)) end, 6) as residual_std,
 round(case when count(*) >= 30 then coalesce((avg(y) - regr_intercept(y, x) - regr_slope(y, x) * avg(x))
   / nullif(sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / count(*)), 0), 0) * {ANN} end, 6) + 0.0 as information_ratio, count(*) as n_obs from m group by 1""",
)
def benchmark_neutrality(t):
    d = rolling(
        t.bars_w().select("symbol", "datetime", "close"),
        WEEKLY,
        lambda w: {"y": log_return(w)},
        back=1,
    )
    b = d.groupBy("datetime").agg(F.avg("y").alias("x"))
    return rounded(P.benchmark_neutrality(d.join(b, "datetime"), "y", "x", ANN, ["symbol"]))


@query(
    "122",
    """with m as (select symbol as config, cast(year(datetime) as int) as o, avg(trade_log_return_net) / nullif(stddev_samp(trade_log_return_net), 0) as s,
 avg(turnover) as t from tf_cost group by 1, 2)
select config, count(case when s > 0 and t < 0.6 then 1 end) as n_pass, count(*) as n_offsets, count(case when s > 0 and t < 0.6 then 1 end) >= 2 as fires from m group by 1""",
)
def passing_configs(t):
    d = P.add_trading_costs(trades_by_symbol(t), WEEKLY, 0.0004)
    m = d.groupBy(F.col("symbol").alias("config"), F.year("datetime").alias("offset")).agg(
        F.try_divide(F.avg("trade_log_return_net"), F.stddev_samp("trade_log_return_net")).alias("s"),
        F.avg("turnover").alias("t"),
    )
    return P.passing_configs(m, (F.col("s") > 0) & (F.col("t") < 0.6), 2)


@query(
    "123",
    f"""with a as (select symbol, datetime, coalesce(log_return, 0) as r, row_number() over (partition by symbol order by datetime) - 1 as i,
  count(*) over (partition by symbol) as n from feat1),
b as (select symbol, k * 13 as start_row, datetime, case when i = k * 13 then 0 else r end as r from a, (select unnest(range(60)) as k)
 where i >= k * 13 and i < k * 13 + 52 and k * 13 + 52 <= n)
select symbol, start_row, min(datetime) as window_start, {metric_sql("r", "dd", "sqrt(52)")} from ({dd_sql("b", {"r": ("eq", "dd")}, "symbol, start_row", "datetime")}) group by 1, 2""",
)
def rolling_buy_and_hold(t):
    return rounded(P.rolling_buy_and_hold(t.bars_w(), WEEKLY, 52, 13, ANN))


@query(
    "266",
    f"""with a as (select v.symbol, v.datetime, log_return, tilt0, ref, v.var_forecast from var_w v join (select symbol, datetime, tilt0, ref, var_forecast as vf from tilt_w) t
  on v.symbol = t.symbol and v.datetime = t.datetime),
b as (select symbol, datetime, lead(log_return) over (partition by symbol order by datetime) as ret, case when ref is not null and abs(var_forecast) > 0 then tilt0 end as w from a),
c as (select *, coalesce(w, 0) as p, abs(coalesce(w, 0) - coalesce(lag(coalesce(w, 0)) over (partition by symbol order by datetime), 0)) as t from b),
d as (select symbol, datetime, t, p * ret as g, ln(greatest(1 - 0.0005e0 * t, 1e-12)) as c from c where w is not null and ret is not null and datetime >= timestamp '1998-01-01'),
e as ({dd_sql("(select *, g + c as net from d)", {"g": ("eg", "dg"), "net": ("en", "dn")}, "symbol", "datetime")})
select symbol, count(*) as n_bars, {metric_sql("g", "dg", "sqrt(52)")}, {metric_sql("net", "dn", "sqrt(52)", "_net")},
 round(avg(t), 6) as mean_turnover_per_bar, round(-avg(c) * 52, 6) as annualized_fee_drag from e group by 1""",
)
def overlay_backtest(t):
    from ..operators import xs

    v = var_w(t)
    d = v.join(xs.overlay_weight(v, 60, s=WEEKLY), ["symbol", "datetime"])
    d = rolling(d, WEEKLY, lambda w: {"ret": F.lead("log_return").over(w)}, 0, 1)
    mask = (F.col("datetime") >= F.lit("1998-01-01").cast("timestamp")) & F.col("ret").isNotNull()
    return rounded(P.overlay_backtest(d, WEEKLY, "ret", "tilt", mask, 0.0005, ANN))


