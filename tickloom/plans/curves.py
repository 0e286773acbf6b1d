"""Queries over futures curves (inventory 2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import log_return, roll_std
from ..functions.ordered import rolling
from ..operators import curves as C
from ..operators import quality as Q
from . import sqlgen as S
from .pnl import codes
from .registry import query, rounded, view

WP = "partition by product order by date"

view(
    "liquid",
    "select product, contract_month from contract_px group by 1, 2 having sum(volume) >= 200",
)
SCHED = """select r.product, r.contract_month, last_trade_date, anchor_date, raw - case isodow(raw) when 6 then 1 when 7 then 2 else 0 end as roll_date
from (select *, coalesce(first_notice_date, last_trade_date) as anchor_date, coalesce(first_notice_date, last_trade_date) - {n} as raw from roll_calendar) r
semi join liquid l on r.product = l.product and r.contract_month = l.contract_month"""
view("sched", SCHED.format(n=5))


def liquid(t):
    return C.liquid_months(t.contract_px(), 200)


def schedule(t, days=5):
    return C.roll_schedule(t.roll_calendar(), days, liquid(t))


@query("197", "select product, contract_month from liquid")
def liquid_months(t):
    return liquid(t).select("product", "contract_month")


@query(
    "196", "select product, contract_month, last_trade_date, anchor_date, roll_date from sched"
)
def roll_schedule(t):
    return schedule(t)


def curve_sql(sched: str) -> str:
    return f"""with s as (select *, row_number() over (partition by product order by last_trade_date, contract_month) - 1 as seq from {sched} where roll_date is not null),
rolled as (select product, roll_date, max(seq) + 1 as idx from s group by 1, 2),
d as (select distinct p.product, p.date from contract_px p semi join {sched} k on p.product = k.product and p.contract_month = k.contract_month),
x as (select d.product, d.date, coalesce(r.idx, 0) as idx from d asof left join rolled r on d.product = r.product and d.date >= r.roll_date),
w as (select x.product, x.date, leg, s.contract_month, s.last_trade_date from (select *, unnest([1, 2, 3]) as leg from x) x join s on x.product = s.product and s.seq = x.idx + leg - 1),
p as (select w.*, c.close, c.open, c.high, c.low, c.volume from w left join contract_px c on w.product = c.product and w.date = c.date and w.contract_month = c.contract_month)
select product, date, {", ".join(f"max(case when leg = {k} then close end) as close_f{k}, max(case when leg = {k} and close is not null then cast(last_trade_date - date as int) end) as dte_f{k}, max(case when leg = {k} then contract_month end) as contract_month_f{k}" for k in (1, 2, 3))},
 max(case when leg = 1 then open end) as open, max(case when leg = 1 then high end) as high, max(case when leg = 1 then low end) as low, max(case when leg = 1 then volume end) as volume
from p group by 1, 2 having max(case when leg = 1 then contract_month end) is not null"""


view("ccurve", curve_sql("sched"))
LEGS = ", ".join(f"round(close_f{k}, 6) as close_f{k}, dte_f{k}, contract_month_f{k}" for k in (1, 2, 3))


@query("198", f"select product, date, {LEGS} from ccurve")
def continuous_curve(t):
    return rounded(C.continuous_curve(t.contract_px(), schedule(t), 3))


def conv_sql(src: str) -> str:
    return f"""select *, {S.lnr("close_backadj", f"lag(close_backadj) over ({WP})")} as log_return_backadj, {S.lnr("close_ratioadj", f"lag(close_ratioadj) over ({WP})")} as log_return_ratioadj from (
select *, close_f1 - sum(gap) over ({WP}) as close_backadj, close_f1 * exp(sum(lq) over ({WP})) as close_ratioadj from (
 select *, case when not is_roll then {S.lnr("close_f1", "prev")} end as log_return_unadj,
  case when is_roll and close_f1 is not null and prev is not null then close_f1 - prev else 0 end as gap,
  case when is_roll and close_f1 is not null and prev is not null then ln(prev / close_f1) else 0 end as lq from (
  select *, lag(close_f1) over ({WP}) as prev, coalesce(contract_month_f1 <> lag(contract_month_f1) over ({WP}), false) as is_roll from {src})))"""


view("conv", conv_sql("ccurve"))


@query(
    "200",
    f"select product, date, is_roll, {S.rnd('log_return_unadj close_backadj log_return_backadj close_ratioadj log_return_ratioadj')} from conv",
)
def return_conventions(t):
    d = C.return_conventions(C.continuous_curve(t.contract_px(), schedule(t), 1))
    return rounded(d.drop("close_f1", "dte_f1", "contract_month_f1"))


@query(
    "199",
    f"""with c as ({conv_sql("(select * from ccurve where close_f1 is not null)")})
select product, date, is_roll, volume, {S.rnd("close_backadj")}, round(open - (close_f1 - close_backadj), 6) as open_backadj,
 round(high - (close_f1 - close_backadj), 6) as high_backadj, round(low - (close_f1 - close_backadj), 6) as low_backadj from c""",
)
def continuous_ohlcv(t):
    d = C.continuous_ohlcv(t.contract_px(), schedule(t))
    keep = [f"{x}_backadj" for x in ("close", "open", "high", "low")]
    return rounded(d.select("product", "date", "is_roll", "volume", *keep))


def _sens(n: int) -> str:
    return f"""select {n} as days, product, count(log_return_unadj) as n, round(stddev_pop(log_return_unadj) * sqrt(252), 6) as ann_vol,
 round(kurtosis_pop(log_return_unadj), 6) as excess_kurtosis, count(case when is_roll then 1 end) as n_rolls
from ({conv_sql(f"({curve_sql(f'({SCHED.format(n=n)})')})")}) group by 2"""


@query("133", " union all ".join(_sens(n) for n in (3, 10)))
def roll_sensitivity(t):
    out = None
    for n in (3, 10):
        d = C.return_conventions(C.continuous_curve(t.contract_px(), schedule(t, n), 1))
        g = d.groupBy(F.lit(n).alias("days"), "product").agg(
            F.count("log_return_unadj").alias("n"),
            (F.stddev_pop("log_return_unadj") * C.ANNUAL).alias("ann_vol"),
            F.kurtosis("log_return_unadj").alias("excess_kurtosis"),
            F.count_if("is_roll").alias("n_rolls"),
        )
        out = g if out is None else out.unionByName(g)
    return rounded(out)


TICK = """select p.*, s.code || replace(contract_month, '-', '') as ticker from contract_px p join spec s on p.product = s.product
union all select p.*, s.code || '=F' as ticker from contract_px p join spec s on p.product = s.product where volume > 60"""
view("tickers", TICK)


def tickers(t):
    p = t.contract_px().join(codes(t), "product")
    a = p.withColumn("ticker", F.concat("code", F.replace("contract_month", F.lit("-"), F.lit(""))))
    b = p.where("volume > 60").withColumn("ticker", F.concat("code", F.lit("=F")))
    return a.unionByName(b).drop("code", "contract_month")


@query(
    "201",
    """select product, date, min(ticker) as ticker, arg_min(close, ticker) as close, arg_min(volume, ticker) as volume
from tickers where regexp_matches(ticker, '^[A-Z]+[0-9]{6}$') group by 1, 2""",
)
def front_by_ticker(t):
    d = C.front_by_ticker(tickers(t))
    return d.select("product", "date", "ticker", "close", "volume")


view(
    "tcurve",
    """select product, date, """
    + ", ".join(
        f"max(case when k = {k} then close end) as close_f{k}, max(case when k = {k} then cast(last_day(strptime(right(ticker, 6), '%Y%m')) - date as int) end) as dte_f{k}"
        for k in (1, 2, 3)
    )
    + """ from (select *, row_number() over (partition by product, date order by ticker) as k from tickers where regexp_matches(ticker, '^[A-Z]+[0-9]{6}$'))
group by 1, 2 having count(*) >= 2""",
)


def tcurve(t):
    return C.curve_by_ticker(tickers(t))


@query("202", "select product, date, close_f1, dte_f1, close_f2, dte_f2, close_f3, dte_f3 from tcurve")
def curve_by_ticker(t):
    return tcurve(t)


view(
    "states",
    """select product, date, slope, case when slope < 0 then 'backwardation' when slope > 0 then 'contango' end as state,
 case when abs(slope) < 2.0 then 'flat' when slope < 0 then 'backwardation' when slope > 0 then 'contango' end as banded from (
 select product, date, case when close_f2 > 0 and close_f1 > 0 then ln(close_f2 / close_f1) end / greatest(dte_f2 - dte_f1, 1) * 365.0 as slope from tcurve)""",
)


def states(t):
    d = tcurve(t).select("product", "date", C.roll_slope().alias("slope"))
    return d.select(
        "*",
        C.slope_state(F.col("slope")).alias("state"),
        C.slope_state(F.col("slope"), 2.0).alias("banded"),
    )


@query("203, 204", "select product, date, round(slope, 6) as slope, state, banded from states")
def curve_states(t):
    return rounded(states(t))


RUN = """select *, sum(nw) over (partition by product order by date) as g from (
 select product, date, state, case when state = lag(state) over (partition by product order by date) then 0 else 1 end as nw from states)"""
view("state_runs", RUN)


@query(
    "205",
    """select product, date, state, case when state is not null and row_number() over (partition by product, g order by date) >= 5 then state else 'unconfirmed' end as confirmed from state_runs""",
)
def persistent_states(t):
    d = states(t).select("product", "date", "state")
    return C.persistent_state(d, C.PRODUCT, "state", 5, "confirmed")


@query(
    "206",
    """select product, state, round(avg(n), 6) as mean_run, count(*) as n_runs from (select product, g, min(state) as state, count(*) as n from state_runs group by 1, 2) group by 1, 2""",
)
def state_run_lengths(t):
    return rounded(C.run_statistics(states(t), C.PRODUCT, "state"))


@query(
    "206, 258, 341",
    """with a as (select product, state as src, lead(state) over (partition by product order by date) as dst from states where state is not null),
b as (select product, src, dst, count(*) as n from a where dst is not null group by 1, 2, 3)
select product, src, dst, n, round(n / sum(n) over (partition by product, src), 6) as share from b""",
)
def state_transitions(t):
    return rounded(C.transitions(states(t), C.PRODUCT, "state"))


@query(
    "207",
    "select s.code, c.date, case s.code "
    + " ".join(
        f"when '{p}' then case month(c.date) "
        + " ".join(f"when {m} then '{n}'" for n, ms in w.items() for m in ms)
        + " else 'off_season' end"
        for p, w in C.SEASONAL_WINDOWS.items()
    )
    + " else 'na' end as label from tcurve c join spec s on c.product = s.product",
)
def seasonal_states(t):
    d = tcurve(t).join(codes(t), "product")
    return d.select(
        "code", "date", C.seasonal_state(F.col("code"), F.col("date")).alias("label")
    )


@query(
    "208",
    """select product, count(*) as n_obs, count(case when state = 'backwardation' then 1 end) as n_backwardation, count(case when state = 'contango' then 1 end) as n_contango,
 round(count(case when state = 'backwardation' then 1 end) / count(*), 6) as frac_backwardation, round(avg(slope), 6) as slope_mean, round(stddev_pop(slope), 6) as slope_std,
 round(quantile_cont(slope, 0.1), 6) as slope_p10, round(quantile_cont(slope, 0.5), 6) as slope_median, round(quantile_cont(slope, 0.9), 6) as slope_p90,
 arg_max(date, (slope, date)) as deepest_contango, arg_min(date, (slope, date)) as deepest_backwardation from states where slope is not null group by 1""",
)
def regime_atlas(t):
    return rounded(C.regime_atlas(states(t).where("slope is not null"), "state", "slope"))


@query(
    "208",
    """select product, cast(month(date) as int) as month, round(avg(case when state = 'backwardation' then 1.0 else 0 end), 6) as frac_backwardation, count(*) as n
from states where state is not null group by 1, 2 having count(*) >= 5""",
)
def state_by_month(t):
    return rounded(C.state_by_month(states(t), "state"))


@query(
    "209",
    """select l_orderkey, case when count(distinct l_returnflag) = 1 then 'calendar' else 'inter_commodity' end as kind from lineitem group by 1 having count(*) >= 2""",
)
def spread_taxonomy(t):
    d = t.read("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("legs"))
    d = d.where(F.size("legs") >= 2)  # the lines of one order are few
    return d.select("l_orderkey", C.taxonomy("legs").alias("kind"))


view(
    "tvol",
    f"select product, date, dte_f1, ret, {S.std('ret', 8, WP)} as vol from (select *, {S.lnr('close_f1', f'lag(close_f1) over ({WP})')} as ret from tcurve)",
)


def tvol(t):
    return rolling(
        tcurve(t).select("product", "date", "close_f1", "dte_f1"),
        C.PRODUCT,
        [
            lambda w: {"ret": log_return(w, "close_f1")},
            lambda w: {"vol": roll_std("ret", w, 8)},
        ],
        9,
    )


@query(
    "210",
    "select product, dte_lo, dte_hi, round(avg(vol), 6) as mean_vol, count(*) as n from (select *, case "
    + " ".join(
        f"when dte_f1 >= {a} and dte_f1 < {b} then {a}" for a, b in zip(C.DTE_EDGES, C.DTE_EDGES[1:], strict=False)
    )
    + " end as dte_lo, case "
    + " ".join(
        f"when dte_f1 >= {a} and dte_f1 < {b} then {b}" for a, b in zip(C.DTE_EDGES, C.DTE_EDGES[1:], strict=False)
    )
    + " end as dte_hi from tvol where vol is not null) where dte_lo is not null group by 1, 2, 3 having count(*) >= 5",
)
def vol_by_expiry(t):
    return rounded(C.vol_by_expiry(tvol(t), ["product"], "vol", "dte_f1"))


@query(
    "211",
    "select product, cast(month(date) as int) as month, round(avg(ret), 6) as mean_return, round(stddev_pop(ret), 6) as vol, count(*) as n from tvol where ret is not null group by 1, 2 having count(*) >= 5",
)
def month_statistics(t):
    return rounded(C.calendar_stats(tvol(t), ["product"], F.month("date").alias("month"), "ret"))


@query(
    "212",
    """select o_orderpriority, cast(isodow(o_orderdate) - 1 as int) as weekday, round(avg(o_totalprice / 1e5), 6) as mean_return, round(stddev_pop(o_totalprice / 1e5), 6) as vol, count(*) as n
from orders where isodow(o_orderdate) <= 5 group by 1, 2 having count(*) >= 5""",
)
def weekday_statistics(t):
    d = t.read("orders").where(F.weekday("o_orderdate") < 5)
    d = d.select(
        "o_orderpriority",
        F.weekday("o_orderdate").alias("weekday"),
        (F.col("o_totalprice") / 1e5).alias("ret"),
    )
    return rounded(C.calendar_stats(d, ["o_orderpriority"], F.col("weekday"), "ret"))


EVENTS = """select r_name as product, 'E' || k as name, date '1995-06-01' + cast(r_regionkey * 40 + k * 300 as int) as start, date '1995-06-01' + cast(r_regionkey * 40 + k * 300 + 45 as int) as "end"
from region, (select unnest(range(7)) as k)"""
view("named_events", EVENTS)


def events(t):
    d = t.read("region").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    off = F.col("r_regionkey") * 40 + F.col("k") * 300
    base = F.lit("1995-06-01").cast("date")
    return d.select(
        F.col("r_name").alias("product"),
        F.concat(F.lit("E"), F.col("k")).alias("name"),
        F.date_add(base, off.cast("int")).alias("start"),
        F.date_add(base, (off + 45).cast("int")).alias("end"),
    )


@query(
    "213",
    """select p.product, p.contract_month, e.name, p.s as a_start, e.start as b_start from (
 select product, contract_month, min(date) as s, max(date) as e from contract_px group by 1, 2) p join named_events e
on p.product = e.product and e.start <= p.e and e."end" >= p.s""",
)
def event_overlap(t):
    life = t.contract_px().groupBy("product", "contract_month")
    life = life.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return C.overlap_join(life, events(t), ["product"])


@query(
    "214",
    """select name, round(sum(p), 6) as portfolio_pnl, round(min(p), 6) as worst_day, count(*) as n_days from (
 select e.name, v.date, sum(v.ret * (0.1 + r_regionkey * 0.05)) as p from tvol v join named_events e on v.product = e.product and v.date between e.start and e."end"
 join region on r_name = v.product where v.ret is not null group by 1, 2) group by 1""",
)
def event_replay(t):
    w = t.read("region").select(
        F.col("r_name").alias("product"), (F.lit(0.1) + F.col("r_regionkey") * 0.05).alias("weight")
    )
    return rounded(C.event_replay(tvol(t), events(t), w, "ret"))


@query(
    "88",
    f"""with f as (select c.product, c.date, c.close_f1 as built, t.close_f1 as ref, r.ref as proxy from ccurve c join tcurve t on c.product = t.product and c.date = t.date
  left join ref_front r on c.product = r.product and c.date = r.date where c.close_f1 is not null),
a as (select product, count(*) as n_overlap, avg(case when abs(built - ref) <= 0.01 + 1e-9 then 1.0 else 0 end) as p from f group by 1),
q as (select product, {S.lnr("built", f"lag(built) over ({WP})")} as x, {S.lnr("proxy", f"lag(proxy) over ({WP})")} as y from f)
select a.product, n_overlap, round(p, 6) as pct_within, p >= 0.99 as passed, round(case when count(*) >= 30 then corr(x, y) end, 6) as proxy_corr
from a join q on a.product = q.product where x is not null and y is not null group by 1, 2, 3, 4, p""",
)
def three_way_reconciliation(t):
    from .quality import ref_front

    built = C.continuous_curve(t.contract_px(), schedule(t), 1).where("close_f1 is not null")
    built = built.select("product", "date", "close_f1")
    ref = tcurve(t).select("product", "date", "close_f1")
    a = Q.reconcile(built, ref, ["product"], "close_f1", Q.within_tick(0.01), 0.99)
    proxy = ref_front(t).withColumnRenamed("close_f1", "_p")
    d = built.join(ref.select("product", "date"), ["product", "date"], "left_semi")
    d = d.join(proxy, ["product", "date"], "left")
    d = rolling(
        d,
        C.PRODUCT,
        lambda w: {"_x": log_return(w, "close_f1"), "_y": log_return(w, "_p")},
        back=1,
    )
    g = d.dropna(subset=["_x", "_y"]).groupBy("product")
    g = g.agg(F.corr("_x", "_y").alias("_r"), F.count(F.lit(1)).alias("_n"))
    g = g.select("product", F.when(F.col("_n") >= 30, F.col("_r")).alias("proxy_corr"))
    return rounded(a.join(g, "product"))


