"""Queries over folds, pooled models and the panel backtest (inventory 2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import forward_return, log_return, ratio, roll_std
from ..functions.ordered import WEEKLY, Ordered, rolling
from ..operators import folds as FO
from ..operators import inference as N
from ..operators import pnl as P
from ..operators import xs
from ..session import materialize
from . import sqlgen as S
from .pnl import ANN, COST_SQL, dd_sql, metric_sql
from .portfolio import NAMES, dn_sql
from .registry import query, rounded, view

LEN = "select symbol, count(*) as n from bars_w group by 1"


def lengths(t):
    return FO.series_lengths(t.bars_w(), ["symbol"])


def fold_sql(start: str, end: str, t0: str, t1: str) -> str:
    return f"""select symbol, cast(f as int) as fold, cast({start} as bigint) as train_start, cast({end} as bigint) as train_end,
 cast({t0} as bigint) as test_start, cast({t1} as bigint) as test_end from ({LEN}), (select unnest(range(200)) as f) where {t1} <= n"""


@query("144", fold_sql("7 + f * 26", "7 + f * 26 + 104", "7 + f * 26 + 107", "7 + f * 26 + 133"))
def rolling_folds(t):
    return FO.fold_table(lengths(t), 104, 26, None, "rolling", 3, 7)


@query("144", fold_sql("0", "f * 13 + 104", "f * 13 + 104", "f * 13 + 130"))
def anchored_folds(t):
    return FO.fold_table(lengths(t), 104, 26, 13, "anchored")


@query("146", fold_sql("0", "100 + f * 20", "100 + f * 20", "100 + f * 20 + 40"))
def expanding_folds(t):
    return FO.expanding_folds(lengths(t), 100, 40, 20)


@query("147", fold_sql("f * 40", "100 + f * 40 - 5", "100 + f * 40 + 5", "100 + f * 40 + 40"))
def purged_folds(t):
    return FO.purged(FO.expanding_folds(lengths(t), 100, 40, None, False), 5)


def side_sql(train: str, test: str, last: str) -> str:
    return f"""with b as (select datetime, row_number() over (order by datetime) - 1 as i from (select distinct datetime from bars_w)),
f as (select cast(f as int) as fold from (select unnest(range(200)) as f) where {last} <= (select count(*) from b)),
s as (select fold, 'train' as side, datetime from b, f where {train} union all select fold, 'test', datetime from b, f where {test})
select s.fold, s.side, count(*) as n_rows, count(distinct s.datetime) as n_bars, min(s.datetime) as first_ts, max(s.datetime) as last_ts
from s join bars_w w on s.datetime = w.datetime group by 1, 2"""


def _sides(t, **kw):
    b = t.bars_w().select("symbol", "datetime")
    d = FO.panel_folds(b, WEEKLY, **kw).join(b, "datetime")
    return d.groupBy("fold", "side").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("datetime").alias("n_bars"),
        F.min("datetime").alias("first_ts"),
        F.max("datetime").alias("last_ts"),
    )


@query(
    "145",
    side_sql(
        "i >= 7 + fold * 26 and i < 111 + fold * 26",
        "i >= 113 + fold * 26 and i < 139 + fold * 26",
        "139 + f * 26",
    ),
)
def panel_folds(t):
    return _sides(t, train=104, test=26, embargo=2, offset=7)


@query(
    "148",
    side_sql(
        "i >= fold * 26 and i < 104 + fold * 26 - 4",
        "i >= 104 + fold * 26 + 4 and i < 130 + fold * 26",
        "130 + f * 26",
    ),
)
def pooled_purged_folds(t):
    return _sides(t, train=104, test=26, horizon=4)


@query(
    "149",
    """select symbol, side, count(*) as n, min(datetime) as first_ts from (select *, case when row_number() over (partition by symbol order by datetime) <= floor(count(*) over (partition by symbol) * 0.8e0) then 'train' else 'test' end as side from bars_w) group by 1, 2""",
)
def ordered_split(t):
    d = FO.ordered_split(t.bars_w().select("symbol", "datetime"), WEEKLY, 0.2)
    return d.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_ts")
    )


view(
    "model_rows",
    """select k.fold, k.side, f.symbol, f.datetime, momentum_4 as x1, realized_vol_8 as x2, order_flow_imbalance as x3, fwd_return_1, fwd_return_1 / realized_vol_8 as y
from features_w f join (
 with b as (select datetime, row_number() over (order by datetime) - 1 as i from (select distinct datetime from features_w where momentum_4 is not null and realized_vol_8 > 1e-12 and fwd_return_1 is not null)),
 g as (select cast(unnest(range(50)) as int) as fold)
 select fold, 'train' as side, datetime from b, g where i >= fold * 26 and i < fold * 26 + 156 and fold * 26 + 182 <= (select count(*) from b)
 union all select fold, 'test', datetime from b, g where i >= fold * 26 + 156 and i < fold * 26 + 182 and fold * 26 + 182 <= (select count(*) from b)) k
on f.datetime = k.datetime where momentum_4 is not null and realized_vol_8 > 1e-12 and fwd_return_1 is not null""",
)


def panel(t):
    """Clean weekly panel: three features, the next return and its normalized form."""
    def base(w):
        return {
            "log_return": log_return(w),
            "x1": log_return(w, "close", 4),
            "x3": 2.0 * ratio("taker_buy_volume", "volume") - 1.0,
            "fwd_return_1": forward_return(w),
        }

    d = rolling(t.bars_w(), WEEKLY, [base, lambda w: {"x2": roll_std("log_return", w, 8)}], 12, 1)
    d = d.where((F.col("x2") > 1e-12) & F.col("x1").isNotNull() & F.col("fwd_return_1").isNotNull())
    d = d.withColumn("y", F.col("fwd_return_1") / F.col("x2"))
    return d.select("symbol", "datetime", "x1", "x2", "x3", "fwd_return_1", "y")


def fold_sums(rows, xs_=("x1", "x2", "x3"), targets=("y",), offsets=None):
    """Running sums over the timestamps of ``rows`` and the fold table of each offset."""
    sums = FO.FoldSums(rows, WEEKLY, list(xs_), list(targets))
    folds = None
    for off in offsets or (0,):
        f = FO.bar_folds(sums.bars, 156, 26, offset=off)
        f = f.withColumn("offset", F.lit(off)) if offsets else f
        folds = f if folds is None else folds.unionByName(f)
    return sums, folds


@query(
    "150",
    """with s as (select fold, avg(x1) as m1, stddev_samp(x1) as s1, avg(x2) as m2, stddev_samp(x2) as s2 from model_rows where side = 'train' group by 1)
select r.fold, side, symbol, datetime, round((x1 - m1) / case when s1 < 1e-12 then 1 else s1 end, 6) as x1, round((x2 - m2) / case when s2 < 1e-12 then 1 else s2 end, 6) as x2
from model_rows r join s on r.fold = s.fold""",
)
def fold_standardized(t):
    sums, folds = fold_sums(materialize(panel(t)), ("x1", "x2"))
    d = sums.scaled(folds)
    return rounded(d.select("fold", "side", "symbol", "datetime", "x1", "x2"))


view(
    "one_model",
    """with s as (select fold, avg(x1) as m, stddev_samp(x1) as s from model_rows where side = 'train' group by 1),
z as (select r.fold, side, symbol, datetime, (x1 - m) / s as x, y, fwd_return_1, x2 from model_rows r join s on r.fold = s.fold),
b as (select fold, regr_slope(y, x) as k, regr_intercept(y, x) as c from z where side = 'train' group by 1)
select z.fold, symbol, datetime, k, c as bias, c + k * x as pred, y, fwd_return_1, x2 from z join b on z.fold = b.fold where side = 'test'""",
)


def one_model(t, xs_=("x1",)):
    sums, folds = fold_sums(materialize(panel(t)), xs_)
    return sums.predictions(folds, "y")


@query(
    "151",
    "select fold, symbol, datetime, round(bias, 6) as bias, round(pred, 6) as pred from one_model",
)
def fold_linear_model(t):
    d = one_model(t).select("fold", "symbol", "datetime", "bias", "pred")
    return rounded(d)


@query(
    "153",
    """select fold, symbol, round(max(abs(pred - bias)), 6) as max_abs_signal, round(max(abs(bias)), 6) as abs_bias, max(abs(bias)) > max(abs(pred - bias)) as degenerate,
 round(avg(case when pred > 0 then 1.0 else 0 end), 6) as frac_long, round(avg(case when pred < 0 then 1.0 else 0 end), 6) as frac_short,
 round(avg(case when pred = 0 then 1.0 else 0 end), 6) as frac_flat, count(case when fl then 1 end) as sign_flips from (
 select *, sign(pred) <> sign(lag(pred) over (partition by fold, symbol order by datetime)) as fl from one_model) group by 1, 2""",
)
def degenerate_bets(t):
    s = Ordered(("fold", "symbol"), ("datetime",), step=7)
    d = FO.degenerate_bets(one_model(t).select("fold", "symbol", "datetime", "bias", "pred"), s, ["fold", "symbol"])
    return rounded(d)


view(
    "wf_trades",
    dd_sql(
        """(select *, r + ln(1 - 0.0005e0 * turnover) as net, ln(1 - 0.0005e0 * turnover) as cost_log_return from (
 select *, abs(p - coalesce(lag(p) over (partition by symbol order by datetime), 0)) as turnover, p * fwd_return_1 as r,
  case when p <> 0 then sign(pred) = sign(fwd_return_1) end as is_won from (select *, cast(sign(pred) as double) as p from one_model)))""",
        {"r": ("eq", "dd"), "net": ("eqn", "ddn")},
        "symbol",
        "datetime",
    ),
)


@query(
    "152",
    f"""select * exclude (compound_return, compound_return_net) from (select symbol, count(*) as no_bars, count(case when p <> 0 then 1 end) as no_trades, round(count(case when p <> 0 then 1 end) / count(*), 6) as frac_time_in_market,
 round(coalesce(avg(cast(is_won as int)), 0), 6) as win_rate, {metric_sql("r", "dd", "sqrt(52)")}, {metric_sql("net", "ddn", "sqrt(52)", "_net")}, {COST_SQL} from wf_trades group by 1)""",
)
def walk_forward_run(t):
    d = one_model(t).select("symbol", "datetime", "pred", "fwd_return_1")
    d = P.trade_frame(d, "pred", "fwd_return_1", WEEKLY)
    d = P.add_trading_costs(d, WEEKLY, 0.0004)
    m = P.stitched_metrics(d, ["symbol"], ANN)
    return rounded(m.drop("compound_return", "compound_return_net"))


def subset_sql() -> str:
    """Predictions of each feature set from sums of standardized features on the train side."""
    stats = ", ".join(f"avg({x}) as m{x}, stddev_samp({x}) as s{x}" for x in ("x1", "x2", "x3"))
    scaled = ", ".join(f"(r.{x} - m{x}) / s{x} as z{x}" for x in ("x1", "x2", "x3"))
    sums = ", ".join(
        [f"sum(z{a} * z{b}) as g{a}{b}" for a in ("x1", "x2", "x3") for b in ("x1", "x2", "x3") if a <= b]
        + [f"sum(z{x} * y) as h{x}" for x in ("x1", "x2", "x3")]
    )
    parts = []
    for a, b in (("x1", None), ("x2", None), ("x3", None), ("x1", "x2"), ("x1", "x3"), ("x2", "x3")):
        if b is None:
            name, pred = a, f"h{a} / g{a}{a} * z{a}"
        else:
            det = f"(g{a}{a} * g{b}{b} - g{a}{b} * g{a}{b})"
            name = f"{a}+{b}"
            pred = f"(h{a} * g{b}{b} - h{b} * g{a}{b}) / {det} * z{a} + (h{b} * g{a}{a} - h{a} * g{a}{b}) / {det} * z{b}"
        parts.append(f"select '{name}' as subset, symbol, datetime, fwd_return_1, my + {pred} as pred from t")
    return f"""(with st as (select fold, {stats} from model_rows where side = 'train' group by 1),
z as (select r.*, {scaled} from model_rows r join st on r.fold = st.fold),
g as (select fold, avg(y) as my, {sums} from z where side = 'train' group by 1),
t as (select * from z join g using (fold) where side = 'test') {" union all ".join(parts)})"""


view("subset_preds", f"select * from {subset_sql()}")


@query(
    "154",
    """with a as (select *, cast(sign(pred) as double) as p from subset_preds),
b as (select *, abs(p - coalesce(lag(p) over (partition by subset, symbol order by datetime), 0)) as turnover, p * fwd_return_1 as r from a),
c as (select *, r + ln(1 - 0.0005e0 * turnover) as net from b)
select subset, count(*) as no_bars, round(avg(r) / stddev_samp(r) * sqrt(52), 6) as sharpe, round(avg(net) / stddev_samp(net) * sqrt(52), 6) as sharpe_net,
 round(avg(case when p <> 0 then case when sign(pred) = sign(fwd_return_1) then 1.0 else 0 end end), 6) as win_rate from c group by 1""",
)
def feature_subsets(t):
    sums, folds = fold_sums(materialize(panel(t)))
    p = sums.predictions(folds, "y", subsets=FO.feature_subsets(sums.xs, 2))
    p = p.select("subset", "symbol", "datetime", "pred", "fwd_return_1")
    s = Ordered(("subset", "symbol"), ("datetime",), step=7)
    d = P.add_trading_costs(P.trade_frame(p, "pred", "fwd_return_1", s), s, 0.0004)
    m = P.stitched_metrics(d, ["subset"], ANN)
    return rounded(m.select("subset", "no_bars", "sharpe", "sharpe_net", "win_rate"))


@query("155")
def fold_logistic_model(t):
    rows = materialize(panel(t).withColumn("won", (F.col("y") > 0).cast("double")))
    sums, folds = fold_sums(rows, targets=("won",))
    d = FO.logistic_by_fold(sums, folds, "won", 0.01)
    return rounded(d.select("fold", "symbol", "datetime", F.col("won").cast("int").alias("won"), "prob"))


LADDER = """with d as (select r.fold, r.side, r.symbol, r.datetime, cast(sign(r.fwd_return_1) as int) as y, cast(sign(f.momentum_1) as int) as s1, cast(sign(f.momentum_12) as int) as s2,
  case when f.momentum_4 > 0.2 then 'bull' when f.momentum_4 < -0.2 then 'bear' when f.momentum_4 is not null then 'sideways' end as lab
 from model_rows r join features_w f on r.symbol = f.symbol and r.datetime = f.datetime where sign(r.fwd_return_1) <> 0),
m as (select fold, case when avg(case when y > 0 then 1.0 else 0 end) >= 0.5 then 1 else -1 end as m0a from d where side = 'train' group by 1),
p as (select d.*, m0a, coalesce(s1, 0) as m0b, coalesce(s2, 0) as m0c, case lab when 'bull' then 1 when 'bear' then -1 when 'sideways' then m0a end as m0d from d join m on d.fold = m.fold where side = 'test')"""


def ladder(t):
    def base(w):
        return {
            "s1": F.signum(log_return(w)).cast("int"),
            "s2": F.signum(log_return(w, "close", 12)).cast("int"),
        }

    b = rolling(t.bars_w().select("symbol", "datetime", "close"), WEEKLY, base, 12)
    p = materialize(panel(t))
    _, folds = fold_sums(p)  # over all timestamps of the panel
    d = p.join(b, ["symbol", "datetime"]).withColumn("y", F.signum("fwd_return_1").cast("int"))
    lab = F.when(F.col("x1") > 0.2, "bull").when(F.col("x1") < -0.2, "bear")
    d = d.withColumns({"lab": lab.otherwise("sideways"), "up": F.when(F.col("y") != 0, (F.col("y") > 0).cast("double"))})
    d = d.withColumn("known", F.col("up").isNotNull().cast("double"))
    sums = FO.FoldSums(materialize(d), WEEKLY, [], ["up", "known"])
    return FO.ladder_baselines(sums, folds, "up", "s1", "s2", "lab", "known").where("y <> 0")


@query("156", LADDER + " select fold, symbol, datetime, y, m0a, m0b, m0c, m0d from p")
def ladder_baselines(t):
    return ladder(t).select("fold", "symbol", "datetime", "y", "m0a", "m0b", "m0c", "m0d")


@query(
    "157",
    LADDER
    + """, l as (select fold, y, unnest(['m0a', 'm0b', 'm0c', 'm0d']) as model, unnest([m0a, m0b, m0c, m0d]) as v from p),
c as (select fold, model, y, avg(case when v = y then 1.0 else 0 end) as rec, count(*) as n, count(case when v = y then 1 end) as h from l group by 1, 2, 3)
select fold, model, round(avg(rec), 6) as balanced_accuracy, round(sum(h) / sum(n), 6) as accuracy, cast(sum(n) as bigint) as n from c group by 1, 2""",
)
def pooled_evaluation(t):
    return rounded(FO.balanced_accuracy(ladder(t), "y", ["m0a", "m0b", "m0c", "m0d"], ["fold"]))


GRID = [(a, b, c) for a in (2, 4) for b in (0.05, 0.2) for c in (0.5,)]
GRID_SQL = f"""with g as (select unnest(range({len(GRID)})) as gid, unnest({[g[0] for g in GRID]}) as l, unnest({[g[1] for g in GRID]}::double[]) as theta, unnest({[g[2] for g in GRID]}::double[]) as alpha),
b as (select symbol, datetime, close, date_trunc('year', datetime) as period, gid, l, theta, alpha from bars_w, g),
e0 as (select *, case when l = 2 then ln(lag(close, 1) over w) - ln(lag(close, 3) over w) else ln(lag(close, 1) over w) - ln(lag(close, 5) over w) end as roc,
  coalesce(ln(close / lag(close) over w), 0) as r from b window w as (partition by symbol, period, gid order by datetime)),
e1 as (select *, case when roc > theta then 1.0 when roc < -theta then -1.0 else 0.0 end as e from e0),
e2 as (select *, coalesce(lag(e) over (partition by symbol, period, gid order by datetime) * r, 0) as p from e1),
s as (select period, gid, l, theta, alpha, symbol, avg(p) as m, stddev_pop(p) as sd, count(*) as n from e2 group by 1, 2, 3, 4, 5, 6 having count(*) >= l + 10 and stddev_pop(p) > 1e-10),
sc as (select period, gid, l, theta, alpha, avg(m / sd) as score from s group by 1, 2, 3, 4, 5)"""


@query(
    "159",
    GRID_SQL
    + ' select cast(period as timestamp) as month, cast(gid as int) as gid, cast(l as int) as "L", theta, alpha, round(score, 6) as score from sc',
)
def grid_scores(t):
    return rounded(FO.month_scores(t.bars_w(), GRID, "year"))


@query(
    "158, 160",
    GRID_SQL
    + f""", p as (select period, lead(period) over (order by period) as nx from (select distinct period from b)),
best as (select period, arg_max(gid, (score, -gid)) as gid, max(score) as score from sc group by 1)
select cast(p.nx as timestamp) as applied_month, cast(coalesce(g.l, {GRID[0][0]}) as int) as "L", coalesce(g.theta, {GRID[0][1]})::double as theta, coalesce(g.alpha, {GRID[0][2]})::double as alpha, round(best.score, 6) as score
from p left join best on p.period = best.period left join g on best.gid = g.gid where p.nx is not null""",
)
def period_regrid(t):
    b = t.bars_w()
    scores = FO.month_scores(b, GRID, "year")
    months = b.select(F.date_trunc("year", "datetime").alias("month")).distinct()
    return rounded(FO.month_choice(scores, months, GRID[0]))


GRAPH = """with bars as (select datetime, row_number() over (order by datetime) as bar, lead(datetime) over (order by datetime) as nx from (select distinct datetime from feat1)),
r as (select symbol, f.datetime, bar, nx, log_return from feat1 f join bars b on f.datetime = b.datetime where log_return is not null),
p as (select a.symbol as a, b.symbol as b, a.datetime, a.bar, a.nx, a.log_return as x, b.log_return as y from r a join r b on a.datetime = b.datetime and a.symbol < b.symbol),
q as (select *, bar - lag(bar, 25) over w as gap, corr(x, y) over (partition by a, b order by datetime rows between 25 preceding and current row) as rho from p window w as (partition by a, b order by datetime)),
e as (select nx as datetime, a, b, rho from q where gap = 25 and abs(rho) >= 0.4 and nx is not null)"""


def graph(t):
    d = rolling(
        t.bars_w().select("symbol", "datetime", "close"),
        WEEKLY,
        lambda w: {"log_return": log_return(w)},
        1,
    )
    return FO.correlation_graph(d, 26, 0.4, WEEKLY), d


@query("161", GRAPH + " select datetime, a, b, round(rho, 6) as rho from e")
def correlation_graph(t):
    return rounded(graph(t)[0])


@query(
    "162",
    GRAPH
    + """, d as (select datetime, s, count(*) as deg from (select datetime, a as s from e union all select datetime, b from e) group by 1, 2),
n as (select f.datetime, f.symbol, coalesce(deg, 0) as deg from bars_w f left join d on f.datetime = d.datetime and f.symbol = d.s)
select round(avg(deg), 6) as mean_degree, count(*) as n, cast(quantile_cont(deg, 0.5) as double) as median_degree from n""",
)
def node_degrees(t):
    e, d = graph(t)
    return rounded(FO.node_degrees(e, d.select("datetime", "symbol")))


view(
    "pb_sig",
    """select symbol, datetime, (momentum_4 - avg(momentum_4) over (partition by datetime)) / nullif(stddev_samp(momentum_4) over (partition by datetime), 0) as pred,
  greatest(-1, least(1, momentum_4)) * 0.02 / realized_vol_8 as size, fwd_return_1 from features_w where realized_vol_8 > 1e-12 and momentum_4 is not null and fwd_return_1 is not null""",
)
view("pb_w", dn_sql("(select * from pb_sig where pred is not null)", "abs(size)"))


@query(
    "52, 54, 63, 86, 104, 105, 163",
    f"""with w as (select * from pb_w),
g as (select datetime, sum(weight * fwd_return_1) as trade_log_return from w group by 1),
u as (select datetime, sum(abs(weight - p)) as turnover from (select *, coalesce(lag(weight) over (partition by symbol order by datetime), 0) as p from w) group by 1),
c as (select g.datetime, trade_log_return, turnover, ln(1 - 0.0005e0 * turnover) as cost_log_return, trade_log_return + ln(1 - 0.0005e0 * turnover) as trade_log_return_net from g join u on g.datetime = u.datetime),
e as ({dd_sql("c", {"trade_log_return_net": ("equity_curve_net", "drawdown_log_return_net")}, "", "datetime")})
select datetime, {S.rnd("trade_log_return turnover cost_log_return trade_log_return_net equity_curve_net drawdown_log_return_net").replace(", 6)", ", 6) + 0.0")} from e""",
)
def panel_backtest(t):
    """Flagship: features, cross-sectional z, weights, P&L, costs, equity."""
    p = materialize(panel(t))
    d = xs.cross_section(p, ["x1"]).where(F.col("x1_cs_z").isNotNull())
    d = d.withColumn("size", xs.vol_targeted_size(F.col("x1"), F.col("x2"), 0.02))
    w = xs.dollar_neutral_weights(d, "x1_cs_z", size="size", names=NAMES)
    f = P.portfolio_frame(w, p, "fwd_return_1", s=WEEKLY)
    return rounded(P.portfolio_costs(f, 0.0004, s=WEEKLY))


@query("151, 152, 163")
def walk_forward_backtest(t):
    """Per origin offset: fold models, weights, costs, metrics and an interval."""
    p = materialize(panel(t))
    sums, folds = fold_sums(p, offsets=(0, 7, 14, 21))
    d = sums.predictions(folds, "y", ("offset", "fold")).select("offset", "datetime", "symbol", "pred")
    d = materialize(d)
    w = xs.dollar_neutral_weights(d, "pred", keys=("offset", "datetime"), names=NAMES)
    f = P.portfolio_frame(materialize(w), p, "fwd_return_1", ("offset",), WEEKLY)
    f = materialize(P.portfolio_costs(f, 0.0004, keys=("offset",), s=WEEKLY))
    s = Ordered(("offset",), ("datetime",), step=7)
    ci = N.block_bootstrap_ci(f, s, "trade_log_return_net", 200, 4)
    return rounded(P.frame_metrics(f, ANN, ("offset",), WEEKLY).join(ci, "offset"))


@query("124, 125")
def strategy_verdict(t):
    """Net Sharpe at every offset, excess interval, deflated Sharpe."""
    p = materialize(panel(t))
    bars = FO.row_index(p.select("datetime").distinct(), WEEKLY.by(), "_i")
    d = p.join(bars, "datetime").withColumn(
        "offset", F.explode(F.array(*[F.lit(k) for k in (0, 7, 14, 21)]))
    )
    d = materialize(d.where(F.col("_i") > F.col("offset")))
    w = xs.dollar_neutral_weights(d, "x1", keys=("offset", "datetime"), names=NAMES)
    f = P.portfolio_frame(w, p, "fwd_return_1", ("offset",), WEEKLY)
    f = materialize(P.portfolio_costs(f, 0.0004, keys=("offset",), s=WEEKLY))
    m = P.frame_metrics(f, ANN, ("offset",), WEEKLY)
    ok = m.agg(F.bool_and(F.col("sharpe_net") > 0).alias("positive_at_every_offset"))
    basket = P.equal_weight_basket(p).withColumnRenamed("trade_log_return", "_b")
    ex = f.where("offset = 0").join(basket, "datetime")
    ex = ex.select("datetime", (F.col("trade_log_return_net") - F.col("_b")).alias("excess"))
    ci = N.block_bootstrap_ci(ex, WEEKLY.by(), "excess", 200, 4)
    ds = N.deflated_sharpe(f.where("offset = 0"), "trade_log_return_net", "offset", 4)
    out = ok.crossJoin(F.broadcast(ci)).crossJoin(F.broadcast(ds.select("prob")))  # one row each
    fires = (
        F.col("positive_at_every_offset")
        & ((F.col("lo") > 0) | (F.col("hi") < 0))
        & (F.col("prob") > 0.95)
    )
    return rounded(out.withColumn("fires", fires))
