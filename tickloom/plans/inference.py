"""Queries over information coefficients and inference (inventory 2.I)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.exprs import log_return, roll_std
from ..functions.ordered import WEEKLY, Ordered, rolling
from ..functions.special import norm_quantile
from ..operators import features as X
from ..operators import inference as N
from . import sqlgen as S
from .pnl import frame_w, trade_log, trades_by_symbol
from .portfolio import NAMES, WS, signals
from .registry import query, r, rounded, view


def avg_rank_sql(c: str, part: str) -> str:
    return f"rank() over (partition by {part} order by {c}) + (count(*) over (partition by {part}, {c}) - 1) / 2.0"


def ic_sql(src: str, x: str, y: str, part: str, least: int = 5) -> str:
    return f"""select {part}, corr(rx, ry) as ic, count(*) as n from (
 select *, {avg_rank_sql(x, part)} as rx, {avg_rank_sql(y, part)} as ry from {src} where {x} is not null and {y} is not null)
 group by {part} having count(*) >= {least} and stddev_pop({x}) >= 1e-12 and stddev_pop({y}) >= 1e-12"""


def nw_sql(src: str, x: str, part: str, order: str, lag: str) -> str:
    """mean, n, t per part; ``lag`` may use n and the part's columns."""
    p = f"partition by {part}" if part else ""
    cols = f"{part}, " if part else ""
    names = [c.strip() for c in part.split(",")] if part else []
    same = " and ".join([*[f"a.{c} = b.{c}" for c in names], "b.pos < a.pos and b.pos >= a.pos - a.lag"])
    left = ", ".join(f"a.{c}" for c in names)
    on = " and ".join(f"g.{c} = k.{c}" for c in names) or "true"
    grp = f"group by {part}" if part else ""
    rows = f"""select {cols} {x} - avg({x}) over ({p}) as d, avg({x}) over ({p}) as m, count(*) over ({p}) as n,
  row_number() over ({p} order by {order}) as pos from {src} where {x} is not null"""
    return f"""select {", ".join(["g." + c for c in names] + ["g.n", "g.m as mean"])},
 g.m / nullif(sqrt(greatest(g.c0 / g.n + coalesce(k.c, 0) / g.n, 0) / g.n), 0) as tstat from (
 select {cols} max(n) as n, max(m) as m, sum(d * d) as c0 from ({rows}) {grp}) g left join (
 select {left + "," if left else ""} sum(2 * (1 - (a.pos - b.pos) / (a.lag + 1.0)) * a.d * b.d) as c
 from (select *, {lag} as lag from ({rows})) a join ({rows}) b on {same} {("group by " + left) if left else ""}) k on {on} where g.n >= 2"""


view("ic_w", ic_sql("sig", "pred", "fwd_return_1", "datetime"))


def ic_w(t):
    return N.cross_sectional_ic(signals(t), "pred", "fwd_return_1", names=NAMES)


@query("165", "select datetime, round(ic, 6) as ic, n from ic_w")
def cross_sectional_ic(t):
    return rounded(ic_w(t))


@query(
    "166, 167",
    f"select round(mean, 6) as mean, round(tstat, 6) as tstat, n from ({nw_sql('ic_w', 'ic', '', 'datetime', '4')})",
)
def ic_summary(t):
    return rounded(N.newey_west(ic_w(t), WEEKLY.by(), "ic", 4))


@query(
    "168",
    f"""with r as (select datetime, rank() over (order by pred) + (count(*) over (partition by pred) - 1) / 2.0 as rx,
   rank() over (order by fwd_return_1) + (count(*) over (partition by fwd_return_1) - 1) / 2.0 as ry
  from sig where pred is not null and fwd_return_1 is not null),
m as (select avg(rx) mx, stddev_pop(rx) sx, avg(ry) my, stddev_pop(ry) sy, corr(rx, ry) as c, count(*) as k from r),
p as (select datetime, avg((rx - mx) / sx * (ry - my) / sy) as v from r, m group by 1),
w as ({nw_sql("p", "v", "", "datetime", "4")})
select round(mean, 6) as panel_ic, round(tstat, 6) as clustered_nw_tstat, round(c * sqrt((k - 2) / greatest(1 - c * c, 1e-12)), 6) as naive_tstat,
  k as n_obs, n as n_timestamps from w, m""",
)
def panel_ic(t):
    return rounded(N.panel_ic(signals(t), "pred", "fwd_return_1", 4, WEEKLY))


@query(
    "169",
    f"select datetime, round(ic, 6) as ic, n, round({S.mean('ic', 30, 'order by datetime')}, 6) as rolling_mean_ic from ic_w",
)
def ic_rolling(t):
    return rounded(N.rolling_ic(ic_w(t), WEEKLY.by(), 30))


@query(
    "169",
    """select cast(year(datetime) as int) as year, round(avg(ic), 6) as mean_ic, count(*) as n_periods,
  (select round(avg(case when m > 0 then 1.0 else 0 end), 6) from (select avg(ic) as m from ic_w group by date_trunc('month', datetime))) as frac_positive_months
from ic_w group by 1""",
)
def ic_stability(t):
    ic = ic_w(t)
    return rounded(
        N.yearly_ic(ic, "datetime").crossJoin(F.broadcast(N.positive_months(ic, "datetime")))
    )


SCREEN = ["momentum_4", "mean_reversion_1", "realized_vol_8", "order_flow_imbalance", "avg_trade_size_z20", "vol_regime"]


def _lag_case() -> str:
    return "case feature " + " ".join(f"when '{f}' then {N.nw_lag(f, 1)}" for f in SCREEN) + " end"


@query(
    "140",
    f"""with l as (select datetime, fwd_return_1 as y, unnest({SCREEN}) as feature, unnest([{", ".join(SCREEN)}]) as v from features_w),
i as ({ic_sql("l", "v", "y", "feature, datetime")}),
w as ({nw_sql("i", "ic", "feature", "datetime", _lag_case())}),
pm as (select feature, avg(case when m > 0 then 1.0 else 0 end) as f from (select feature, avg(ic) as m from i group by feature, date_trunc('month', datetime)) group by 1),
py as (select feature, abs(avg(sign(m))) as s from (select feature, avg(ic) as m from i group by feature, year(datetime)) group by 1)
select w.feature, round(mean, 6) as mean_ic, round(tstat, 6) as nw_tstat, n as n_periods, round(f, 6) as frac_positive_months,
  round(s, 6) as yearly_sign_agreement, abs(mean) > 0.1 as suspicious from w join pm on w.feature = pm.feature join py on w.feature = py.feature""",
)
def ic_screen(t):
    d = X.raw_features(t.bars_w(), WEEKLY)
    return rounded(N.ic_screen(d, SCREEN, "fwd_return_1", WEEKLY, names=NAMES))


TRIALS = 25
EXPECTED_Z = (1 - N.EULER_GAMMA) * norm_quantile(1 - 1 / TRIALS) + N.EULER_GAMMA * norm_quantile(1 - 1 / (TRIALS * math.e))


@query(
    "170",
    f"""with m as (select symbol, avg(trade_log_return) as a, stddev_samp(trade_log_return) as s, stddev_pop(trade_log_return) as p, count(trade_log_return) as n_obs from tf_sym group by 1),
c as (select t.symbol, avg(power((trade_log_return - a) / nullif(p, 0), 3)) as skew, avg(power((trade_log_return - a) / nullif(p, 0), 4)) as kurt from tf_sym t join m on t.symbol = m.symbol group by 1),
d as (select m.symbol, a / nullif(s, 0) as sharpe, skew, kurt, n_obs from m join c on m.symbol = c.symbol where n_obs > 1),
e as (select *, sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n_obs - 1)) as sr_std from d),
f as (select *, sr_std * ({EXPECTED_Z!r}) as expected_max_sharpe from e),
g as (select *, (sharpe - expected_max_sharpe) / nullif(sr_std, 0) as z from f)
select symbol, n_obs, {S.rnd("sharpe skew kurt sr_std expected_max_sharpe")}, round(case when sr_std = 0 then 1 else {S.cdf("z")} end, 6) as prob from g""",
)
def deflated_sharpe(t):
    d = trades_by_symbol(t)
    return rounded(N.deflated_sharpe(d, "trade_log_return", "symbol", 25))


WB = "partition by symbol order by datetime"


def acf_sql(src: str, x: str, part: str, order: str, top: int) -> str:
    lags = ", ".join(
        f"sum(d * lg{k}) / nullif(sum(d * d), 0) as a{k}" for k in range(1, top + 1)
    )
    lg = ", ".join(f"lag(d, {k}) over (partition by {part} order by {order}) as lg{k}" for k in range(1, top + 1))
    return f"""select {part}, unnest(range(1, {top + 1})) as lag, unnest([{", ".join(f"a{k}" for k in range(1, top + 1))}]) as acf, n from (
 select {part}, {lags}, count(*) as n from (select *, {lg} from (select *, {x} - avg({x}) over (partition by {part}) as d from {src} where {x} is not null)) group by {part})"""


view("acf_w", acf_sql("feat1", "log_return", "symbol", "datetime", 20))


def returns_w(t):
    b = t.bars_w().select("symbol", "datetime", "close")
    return rolling(b, WEEKLY, lambda w: {"log_return": log_return(w)}, 1)


@query("186", "select symbol, cast(lag as int) as lag, round(acf, 6) as acf, n from acf_w")
def acf(t):
    return rounded(N.acf(returns_w(t), WEEKLY, "log_return", 20))


@query(
    "172",
    """select symbol, n, cast(greatest(1, least(coalesce(b, 20), n // 2)) as int) as block_length from (
select symbol, max(n) as n, min(case when lag < 20 and abs(acf) < 1.96 / sqrt(n) and abs(nx) < 1.96 / sqrt(n) then lag end) as b
from (select *, lead(acf) over (partition by symbol order by lag) as nx from acf_w) group by 1)""",
)
def auto_block_length(t):
    return N.auto_block_length(returns_w(t), WEEKLY, "log_return", 20)


def boot_sql(src: str, cols: list[str], part: str, order: str, reps: int, block: str, seed: int) -> str:
    """Sums of each circular block resample, expanded row by row."""
    pk = f"{part}, " if part else ""
    pj = f"and d.{part} = x.{part}" if part else ""
    text = f"'{seed}|' || " + (f"{part} || '|' || " if part else "") + "rep || '|' || b"
    p = f"partition by {part}" if part else ""
    keep = ", ".join(cols)
    notnull = " and ".join(f"{c} is not null" for c in cols)
    return f"""select {("d." + part + ", ") if part else ""}d.rep, max(d.n) as n, {", ".join(f"sum(x.{c}) as {c}" for c in cols)} from (
 select {pk}rep, n, (start + unnest(range(len))) % n as i from (
  select *, {S.hash_int(text)} % n as start, case when b = nb - 1 then n - b * bl else bl end as len from (
   select *, unnest(range(nb)) as b from (select *, unnest(range({reps})) as rep, cast(ceil(n / bl) as bigint) as nb from (
     select *, cast(least({block}, n) as bigint) as bl from (select {pk}count(*) as n from {src} where {notnull} {("group by " + part) if part else ""}))))) ) d
join (select {pk}{keep}, row_number() over ({p} order by {order}) - 1 as i from {src} where {notnull}) x on d.i = x.i {pj}
group by {("d." + part + ", ") if part else ""}d.rep"""


view("boot_ic", boot_sql("ic_w", ["ic"], "", "datetime", 200, "6", 3))


@query(
    "171, 173",
    """select round(quantile_cont(ic / n, 0.025), 6) as lo, round(quantile_cont(ic / n, 0.975), 6) as hi, count(*) as n_boot from boot_ic""",
)
def block_bootstrap_ci(t):
    return rounded(N.block_bootstrap_ci(ic_w(t), WEEKLY.by(), "ic", 200, 6, 3))


view("boot_sym", boot_sql("feat1", ["log_return"], "symbol", "datetime", 100, "1", 0))


@query(
    "171",
    """select symbol, round(quantile_cont(log_return / n, 0.025), 6) as lo, round(quantile_cont(log_return / n, 0.975), 6) as hi, count(*) as n_boot from boot_sym group by 1""",
)
def bootstrap_ci(t):
    return rounded(N.block_bootstrap_ci(returns_w(t), WEEKLY, "log_return", 100, 1, 0))


@query("172, 173")
def auto_block_bootstrap(t):
    return rounded(N.block_bootstrap_ci(returns_w(t), WEEKLY, "log_return", 100, None, 1))


@query(
    "174",
    """with o as (select avg(ic) as m from ic_w)
select round(m, 6) as mean, round(least(1, 2 * least(avg(case when ic / n - m <= m then 1.0 else 0 end), avg(case when ic / n - m >= m then 1.0 else 0 end))), 6) as pvalue
from boot_ic, o group by m""",
)
def block_bootstrap_pvalue(t):
    return rounded(N.block_bootstrap_pvalue(ic_w(t), WEEKLY.by(), "ic", 200, 6, 0.0, 3))


view(
    "blocks_ct",
    """select coalesce(a.b, z.b) as block, coalesce(c, 0) as c, coalesce(t, 0) as t from
 (select cast(date_trunc('quarter', date) as date) as b, sum(pnl_atr) as c from trade_log where exit_reason <> 'stop' group by 1) a
 full join (select cast(date_trunc('quarter', date) as date) as b, sum(pnl_atr) as t from trade_log where qty <= 3 group by 1) z on a.b = z.b""",
)
view("boot_ct", boot_sql("blocks_ct", ["c", "t"], "", "block", 300, "1", 5))


def _blocks(t):
    return trade_log(t).withColumn("block", N.calendar_blocks("date"))


@query(
    "175, 176",
    """select p.*, p.delta_lo > 0 or p.delta_hi < 0 as delta_excludes_zero from (
select round(quantile_cont(t - c, 0.025), 6) as delta_lo, round(quantile_cont(t - c, 0.975), 6) as delta_hi,
 round(quantile_cont(c, 0.025), 6) as control_lo, round(quantile_cont(c, 0.975), 6) as control_hi,
 (select round(sum(c), 6) from blocks_ct) as control_point, (select round(sum(t), 6) from blocks_ct) as treatment_point,
 (select round(sum(t - c), 6) from blocks_ct) as delta_point, (select count(*) from blocks_ct) as n_blocks from boot_ct) p""",
)
def paired_block_bootstrap(t):
    d = _blocks(t)
    return rounded(
        N.paired_block_bootstrap(
            d.where("exit_reason <> 'stop'"), d.where("qty <= 3"), "pnl_atr", 300, 5
        )
    )


view(
    "blocks_n",
    "select cast(date_trunc('quarter', date) as date) as block, sum(ret_eq) as v from trade_log group by 1",
)
view("boot_n", boot_sql("blocks_n", ["v"], "", "block", 300, "1", 0))


@query(
    "177",
    """select (select round(sum(v), 6) from blocks_n) as point, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi,
 round((quantile_cont(v, 0.975) - quantile_cont(v, 0.025)) / 2, 6) as half_width, (select count(*) from blocks_n) as n_blocks from boot_n""",
)
def noise_floor(t):
    return rounded(N.noise_floor(_blocks(t), "ret_eq", 300))


view(
    "acc_day",
    """select datetime, sum(case when y = 1 and p = y then 1.0 else 0 end) as cp, sum(case when y = 1 then 1.0 else 0 end) as np,
 sum(case when y = -1 and p = y then 1.0 else 0 end) as cn, sum(case when y = -1 then 1.0 else 0 end) as nn
from (select datetime, sign(pred) as p, sign(fwd_return_1) as y from sig where pred is not null and fwd_return_1 is not null) group by 1""",
)
view("boot_acc", boot_sql("acc_day", ["cp", "np", "cn", "nn"], "", "datetime", 200, "13", 0))


@query(
    "178",
    """select round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, count(v) as n_boot from (
select (cp / nullif(np, 0) + cn / nullif(nn, 0)) / 2 as v from boot_acc)""",
)
def date_block_accuracy(t):
    d = signals(t).select(
        "datetime", F.signum("pred").alias("p"), F.signum("fwd_return_1").alias("y")
    ).dropna()
    return rounded(N.date_bootstrap_accuracy(d, "y", "p", 13, 200, WEEKLY))


view(
    "diff_w",
    """select f.datetime, f.trade_log_return - b.m as diff from frame_w f join (select datetime, avg(fwd_return_1) as m from sig group by 1) b
on f.datetime = b.datetime where b.m is not null""",
)
view("boot_diff", boot_sql("diff_w", ["diff"], "", "datetime", 200, "4", 0))


@query(
    "179",
    """with o as (select avg(diff) as m from diff_w)
select round(m, 6) as mean, round(least(1, 2 * least(avg(case when diff / n - m <= m then 1.0 else 0 end), avg(case when diff / n - m >= m then 1.0 else 0 end))), 6) as pvalue,
 round(quantile_cont(diff / n, 0.025), 6) as lo, round(quantile_cont(diff / n, 0.975), 6) as hi, count(*) as n_boot from boot_diff, o group by m""",
)
def paired_difference(t):
    a = frame_w(t).select("datetime", F.col("trade_log_return").alias("v"))
    b = signals(t).groupBy("datetime").agg(F.avg("fwd_return_1").alias("v"))
    return rounded(N.paired_difference(a, b, "v", WEEKLY, 200, 4))


view(
    "pvals",
    """select symbol, case when n > 0 and symbol <> 'NATION_3' then exp(-0.5 * t * t) end as p from (
select symbol, count(log_return) as n, avg(log_return) / stddev_samp(log_return) * sqrt(count(log_return)) * 12 as t from feat1 group by 1)""",
)


@query(
    "180",
    """with k as (select symbol, row_number() over (order by p, symbol) as rank, row_number() over (order by p, symbol) / count(*) over () * 0.05 as thr, p from pvals where p is not null),
s as (select max(case when p <= thr then rank end) as ks from k)
select v.symbol, round(v.p, 6) as p, k.rank, round(thr, 6) as bh_threshold, coalesce(k.rank <= coalesce(ks, 0), false) as significant
from pvals v left join k on v.symbol = k.symbol, s""",
)
def benjamini_hochberg(t):
    g = returns_w(t).groupBy("symbol").agg(
        (
            F.avg("log_return") / F.stddev_samp("log_return") * F.sqrt(F.count("log_return")) * 12
        ).alias("t")
    )
    p = F.when(F.col("symbol") != "NATION_3", F.exp(-0.5 * F.col("t") * F.col("t")))
    return rounded(N.benjamini_hochberg(g.select("symbol", p.alias("p")), "p", "symbol"))


MODELS = """select symbol, datetime, unnest(['m4', 'm13', 'm26']) as model, unnest([
  abs(abs(log_return) - v4), abs(abs(log_return) - v13), abs(abs(log_return) - v26)]) as loss from (select *, """ + ", ".join(
    f"{S.roll('stddev_samp', 'log_return', k, shift=1)} as v{k}" for k in (4, 13, 26)
) + " from feat1)"
view("losses", MODELS)
view(
    "loss_pairs",
    """select a.symbol, a.datetime, a.model as a, b.model as b, a.loss as la, b.loss as lb, a.loss - b.loss as d0 from losses a join losses b
 on a.symbol = b.symbol and a.datetime = b.datetime and a.model < b.model where a.loss is not null and b.loss is not null""",
)


def losses(t):
    def stage(w):
        return {f"v{k}": roll_std("log_return", w, k, shift=1) for k in (4, 13, 26)}

    d = rolling(returns_w(t), WEEKLY, stage, 27)
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"m{k}").alias("model"),
                    F.abs(F.abs("log_return") - F.col(f"v{k}")).alias("loss"),
                )
                for k in (4, 13, 26)
            ]
        )
    )
    return d.select("symbol", "datetime", cells.alias("_c")).select("symbol", "datetime", "_c.*")


CUBE = "greatest(1, round(power(n, 1.0 / 3)))"
PAIRS = nw_sql("loss_pairs", "d0", "symbol, a, b", "datetime", CUBE)


@query(
    "181, 182",
    f"""select t.symbol, t.a, t.b, t.n, round(tstat, 6) as tstat, round(m.la, 6) as loss_a, round(m.lb, 6) as loss_b from ({PAIRS}) t
join (select symbol, a, b, avg(la) as la, avg(lb) as lb from loss_pairs group by 1, 2, 3) m on t.symbol = m.symbol and t.a = m.a and t.b = m.b where t.n >= 30""",
)
def all_pairs_comparison(t):
    return rounded(N.all_pairs(losses(t), WEEKLY))


@query(
    "183",
    f"""with pooled as ({nw_sql("(select a, b, datetime, avg(d0) as d0 from loss_pairs group by 1, 2, 3)", "d0", "a, b", "datetime", CUBE)}),
s as (select *, abs(tstat) > 1.96 as sg from pooled),
x as (select a as model, sg and tstat < 0 as w from s union all select b, sg and tstat > 0 from s)
select model, bool_and(w) as beats_all from x group by 1""",
)
def beats_all(t):
    mean = losses(t).groupBy("datetime", "model").agg(
        F.avg("loss").alias("loss"), F.count("loss").alias("c")
    )
    p = N.all_pairs(losses_pooled(t), WEEKLY.by())
    p = p.withColumn("significant", F.abs("tstat") > 1.96)
    return N.beats_all(p, mean.select("model").distinct())


def losses_pooled(t):
    """Mean loss per week and model over the symbols that have every model."""
    d = losses(t)
    ok = d.groupBy("symbol", "datetime").agg(F.count("loss").alias("c")).where("c = 3")
    d = d.join(ok.select("symbol", "datetime"), ["symbol", "datetime"], "left_semi")
    return d.groupBy("datetime", "model").agg(F.avg("loss").alias("loss"))


view(
    "vols",
    f"select symbol, datetime, log_return * log_return as rv, {S.mean('log_return * log_return', 13, shift=1)} as fc from feat1",
)


def vols(t):
    from ..functions.exprs import roll_mean

    sq = F.col("log_return") * F.col("log_return")
    d = rolling(returns_w(t), WEEKLY, lambda w: {"rv": sq, "fc": roll_mean(sq, w, 13, shift=1)}, 14)
    return d.select("symbol", "datetime", "rv", "fc")


@query(
    "184",
    """select symbol, round(case when count(*) >= 20 then regr_slope(rv, fc) end, 6) as slope, round(case when count(*) >= 20 then regr_intercept(rv, fc) end, 6) as intercept,
 round(case when count(*) >= 20 then regr_r2(rv, fc) end, 6) as r2, count(*) as n from vols where rv is not null and fc is not null group by 1""",
)
def mincer_zarnowitz(t):
    return rounded(N.mincer_zarnowitz(vols(t), ["symbol"], "rv", "fc"))


@query(
    "185",
    """with a as (select c_mktsegment as seg, case when o_orderstatus = 'F' then 1 else 0 end as y, round(o_totalprice, -3) as s
 from orders join customer on o_custkey = c_custkey),
k as (select *, rank() over (partition by seg order by s) + (count(*) over (partition by seg, s) - 1) / 2.0 as rk from a)
select seg, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as auc, cast(sum(y) as bigint) as n_pos, cast(sum(1 - y) as bigint) as n_neg from k group by 1""",
)
def roc_auc(t):
    d = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.select(
        F.col("c_mktsegment").alias("seg"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        F.round("o_totalprice", -3).alias("s"),
    )
    return rounded(N.roc_auc(d, ["seg"], "y", "s"))


@query(
    "187",
    """select symbol, n, round(n * (n + 2.0) * sum(acf * acf / (n - lag)), 6) as q_stat from acf_w where lag <= 10 group by 1, 2""",
)
def ljung_box(t):
    return rounded(N.ljung_box(returns_w(t), WEEKLY, "log_return", 10).drop("pvalue"))


@query(
    "187",
    f"""select symbol, n, round(q_stat, 6) as q_stat, round({S.chi2_tail("q_stat", 10)}, 6) as pvalue from (
 select symbol, n, n * (n + 2.0) * sum(acf * acf / (n - lag)) as q_stat from acf_w where lag <= 10 group by 1, 2)""",
)
def ljung_box_pvalue(t):
    return rounded(N.ljung_box(returns_w(t), WEEKLY, "log_return", 10))


@query("188")
def leverage_correlation(t):
    d = rolling(returns_w(t), WEEKLY, lambda w: {"vol": roll_std("log_return", w, 4)}, 5)
    return rounded(N.leverage_correlation(d, WEEKLY, "log_return", "vol", 100))


PAIRWISE = """with e as (select min(date) as a, max(date) as z from dclose),
cal as (select d, row_number() over (order by d) as i from (select cast(unnest(generate_series(a, z, interval 1 day)) as date) as d from e) where isodow(d) <= 5),
g as (select s.symbol, cal.d, i from (select distinct symbol from dclose) s, cal),
f as (select g.symbol, g.d, g.i, c.close from g asof left join dclose c on g.symbol = c.symbol and g.d >= c.date),
r as (select symbol, d, i, case when lead(close, {h}) over w / nullif(close, 0) > 0 then ln(lead(close, {h}) over w / close) end as f from f window w as (partition by symbol order by d)),
s as (select * from r where (i - 1) % {h} = 0 and f is not null),
p as (select x.symbol as a, y.symbol as b, corr(x.f, y.f) as rho, count(*) as n from s x join s y on x.d = y.d and x.symbol < y.symbol group by 1, 2)"""
view("dclose", "select symbol, cast(datetime as date) as date, close from bars_w")


def dclose(t):
    return t.bars_w().select("symbol", F.to_date("datetime").alias("date"), "close")


@query(
    "189",
    PAIRWISE.format(h=21)
    + " select round(avg(rho), 6) as rho_bar, count(rho) as n_pairs from p where n >= 10",
)
def mean_pairwise_correlation(t):
    return rounded(N.pairwise_correlation(dclose(t), 21))


Z = norm_quantile(1 - 0.05 / 34 / 2) + norm_quantile(0.8)


@query(
    "190, 191",
    PAIRWISE.format(h=21)
    + f""", m as (select avg(rho) as rho from p where n >= 10), c as (select count(*) as rows, count(distinct symbol) as k from dclose),
q as (select 21 as horizon, k as n_symbols, rows as raw_rows, rows / k / 21.0 as w, rho, (rows / k / 21.0) * k / (1 + (k - 1) * rho) as n_eff from m, c)
select horizon, n_symbols, raw_rows, round(w, 6) as windows_per_symbol, round(rho, 6) as rho_bar, round(n_eff, 4) as n_eff,
  round({Z} * sqrt(0.5 / n_eff), 6) as detectable_effect, n_eff < 200 as underpowered from q""",
)
def power_budget(t):
    c = dclose(t)
    n = c.agg(F.countDistinct("symbol").alias("n_symbols"), F.count(F.lit(1)).alias("raw_rows"))
    d = n.crossJoin(F.broadcast(N.pairwise_correlation(c, 21)))  # one row each
    w = F.col("raw_rows") / F.col("n_symbols") / 21.0
    d = d.withColumn("n_eff", N.kish_effective_n(w, F.col("n_symbols"), F.col("rho_bar")))
    return d.select(
        F.lit(21).alias("horizon"),
        "n_symbols",
        "raw_rows",
        r(w).alias("windows_per_symbol"),
        r("rho_bar").alias("rho_bar"),
        r("n_eff", 4).alias("n_eff"),
        r(F.lit(Z) * F.sqrt(0.5 / F.col("n_eff"))).alias("detectable_effect"),
        (F.col("n_eff") < 200).alias("underpowered"),
    )


@query(
    "192",
    """with a as (select symbol, cast(case when realized_vol_8 < 0.4 then 0 when realized_vol_8 < 0.6 then 1 else 2 end as int) as st,
  round(realized_vol_24, 2) as v, fwd_return_1 as r from features_w where realized_vol_8 is not null),
kv as (select *, count(*) over (partition by symbol, st) as c from a where v is not null),
rk as (select *, rank() over (partition by symbol order by v) + (count(*) over (partition by symbol, v) - 1) / 2.0 as rnk from kv where c >= 10),
ti as (select symbol, sum(k * k * k - k) as t from (select symbol, v, cast(count(*) as double) as k from rk group by 1, 2) group by 1),
g as (select symbol, st, sum(rnk) as s, count(*) as n from rk group by 1, 2),
h as (select symbol, sum(s * s / n) as q, cast(sum(n) as double) as nn, count(*) as k from g group by 1),
kr as (select *, count(*) over (partition by symbol, st) as c from a where r is not null),
fr as (select symbol, st, avg(r) as m, var_pop(r) as q, count(*) as n from kr where c >= 10 group by 1, 2),
ft as (select symbol, avg(r) as gm, count(*) as gn from kr where c >= 10 group by 1),
ff as (select fr.symbol, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum(n * q) / (max(gn) - count(*))) as f from fr join ft on fr.symbol = ft.symbol group by 1 having count(*) >= 2)
select h.symbol, round(case when k >= 2 then (12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - t / (nn * nn * nn - nn)) end, 6) as kruskal_h, round(f, 6) as anova_f
from h join ti on h.symbol = ti.symbol left join ff on h.symbol = ff.symbol""",
)
def state_conditional_tests(t):
    d = X.raw_features(t.bars_w(), WEEKLY).where("realized_vol_8 is not null")
    st = F.when(F.col("realized_vol_8") < 0.4, 0).when(F.col("realized_vol_8") < 0.6, 1).otherwise(2)
    d = d.select(
        "symbol",
        st.alias("st"),
        F.round("realized_vol_24", 2).alias("v"),
        F.col("fwd_return_1").alias("r"),
    )
    return rounded(N.state_tests(d, ["symbol"], "st", "v", "r"))


@query(
    "194",
    f"""with a as (select spread, {S.z("value", 60, WS)} as z, lead(value, 5) over ({WS}) - value as f from spreads),
b as (select * from a where z is not null and f is not null),
c as (select spread, {avg_rank_sql("z", "spread")} as rz, {avg_rank_sql("f", "spread")} as rf from b)
select spread, round(case when count(*) >= 30 then corr(rz, rf) end, 6) as ic, count(*) as n from c group by 1""",
)
def zscore_ic(t):
    s = Ordered(("spread",), ("date",), step=1)
    return rounded(N.zscore_ic(t.spreads().select("spread", "date", "value"), s, "value"))


@query(
    "195",
    """select f, cast(case when f like '%\\_z20' escape '\\' then 20 when f like '%\\_z60' escape '\\' then 60 when regexp_matches(f, '^(momentum|mean_reversion|realized_vol|vol_of_vol)_[0-9]+$') then cast(regexp_extract(f, '([0-9]+)$', 1) as int)
 when f = 'vol_regime' then 96 when f in ('hour_sin', 'hour_cos', 'dow_sin', 'dow_cos') then 6 else 1 end as int) as lag, n from (
select case l_linenumber when 1 then 'momentum_12' when 2 then 'avg_trade_size_z20' when 3 then 'vol_regime' when 4 then 'hour_sin' when 5 then 'realized_vol_96' when 6 then 'count_z60' else 'count' end as f, count(*) as n from lineitem group by 1)""",
)
def lag_lookup(t):
    names = ["momentum_12", "avg_trade_size_z20", "vol_regime", "hour_sin", "realized_vol_96", "count_z60"]
    f = F.lit("count")
    for i, n in reversed(list(enumerate(names, 1))):
        f = F.when(F.col("l_linenumber") == i, n).otherwise(f)
    d = t.read("lineitem").groupBy(f.alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("f", N.nw_lag_column(F.col("f"), 6).cast("int").alias("lag"), "n")


