"""Queries over data quality (inventory 2.G) and alignment (2.E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import WEEKLY, Ordered, rolling
from ..operators import align as A
from ..operators import features as X
from ..operators import quality as Q
from . import sqlgen as S
from .bars import PRIO_COLS, PRIORITIES, positions
from .registry import query, rounded, view

PROD = Ordered(("product",), ("date",), step=1)
CON = Ordered(("product", "contract_id"), ("date",), step=1)
WP = "partition by product order by date"

view(
    "flagged",
    """select c.product, c.date, c.contract_id, c.close, c.volume,
  (n_days >= 10 and share > 0.4) or (bad and c.volume < 80) as contaminated from (
 select *, avg(cast(bad as int)) over (partition by product, contract_id) as share,
  count(*) over (partition by product, contract_id) as n_days from (
  select *, abs(close - anchor) / greatest(abs(anchor), 1e-9) > 0.8e0 as bad from (
   select *, first_value(close) over (partition by product, date order by volume desc, contract_id) as anchor from contract_bars))) c""",
)
FLAG = {"deviation": 0.8, "volume": 80, "junk_share": 0.4}


@query("126", "select product, date, contract_id, contaminated from flagged")
def contamination_flags(t):
    d = Q.flag_contaminated(t.contract_bars(), **FLAG)
    return d.select("product", "date", "contract_id", "contaminated")


@query(
    "127, 128",
    """with c as (select product, date, contract_id, volume from flagged where not contaminated and volume >= 60)
select product, date, contract_id, volume from (select *, count(*) over (partition by product, date) as n from c) where n >= 2""",
)
def hygiene_and_liquidity(t):
    d = Q.liquidity_screen(Q.hygiene_filter(t.contract_bars(), **FLAG), 60, 2)
    return d.select("product", "date", "contract_id", "volume")


@query(
    "129",
    """with l as (select product, count(*) as n from (select *, count(*) over (partition by product, date) as k from flagged where not contaminated and volume >= 60) where k >= 2 group by 1),
r as (select product, count(*) as n_raw, count(case when contaminated then 1 end) as n_flagged from flagged group by 1)
select r.product, n_raw, n_flagged, coalesce(n, 0) as n_liquid, round(n_flagged / n_raw, 6) as pct_flagged,
  round(1 - coalesce(n, 0) / nullif(n_raw - n_flagged, 0), 6) as pct_dropped from r left join l on r.product = l.product""",
)
def hygiene_stats(t):
    return rounded(Q.hygiene_stats(t.contract_bars(), 60, 2, **FLAG))


@query(
    "130",
    """with f as (select product, date, arg_max(close, (volume, -contract_id)) as close from contract_bars group by 1, 2),
x as (select product, ln(abs(close) + 1e-12) - lag(ln(abs(close) + 1e-12)) over (partition by product order by date) as r from f)
select product, round(kurtosis_pop(r), 6) as excess_kurtosis, round(stddev_pop(r) * sqrt(252), 6) as ann_vol, count(r) as n from x group by 1 having count(r) >= 30""",
)
def front_tail_stats(t):
    return rounded(Q.front_tail_stats(t.contract_bars(), PROD))


@query(
    "131",
    "select count(case when event_type = 'click' then 1 end) as n_click, count(case when event_type = 'view' then 1 end) as n_view, count(case when event_type = 'nope' then 1 end) as n_nope from events",
)
def alias_counts(t):
    return Q.code_counts(t.read("events"), "event_type", ["click", "view", "nope"])


@query(
    "132",
    """select l_returnflag, round(avg(l_extendedprice), 4) as mean, count(l_extendedprice) as n,
  case l_returnflag when 'R' then 'returned' when 'A' then 'accepted' else 'other' end as name from lineitem group by 1""",
)
def mean_by_code(t):
    d = Q.mean_by_code(
        t.read("lineitem"), "l_returnflag", "l_extendedprice", {"R": "returned", "A": "accepted"}
    )
    return rounded(d, 4)


@query(
    "134",
    """with a as (select symbol, datetime, round(count / 4.0) as c from bars_w),
b as (select *, case when c = lag(c) over (partition by symbol order by datetime) then 0 else 1 end as nw from a),
g as (select symbol, sum(nw) over (partition by symbol order by datetime) as g from b),
l as (select symbol, g, count(*) as len from g group by 1, 2)
select symbol, count(case when len >= 2 then 1 end) as n_runs, coalesce(max(case when len >= 2 then len end), 0) as max_run,
  cast(coalesce(sum(case when len >= 2 then len - 1 end), 0) as bigint) as n_stale from l group by 1""",
)
def stale_runs(t):
    d = t.bars_w().select("symbol", "datetime", F.round(F.col("count") / 4.0).alias("close"))
    return Q.stale_runs(d, WEEKLY)


REF = """select product, date, arg_max(close, (volume, -contract_id)) as ref from contract_bars group by 1, 2"""
view("ref_front", REF)


def ref_front(t):
    return t.contract_bars().groupBy("product", "date").agg(
        F.max_by("close", F.struct("volume", -F.col("contract_id"))).alias("close_f1")
    )


@query(
    "135",
    """select c.product, count(*) as n_overlap, round(avg(case when abs(close_f1 - ref) <= 50 + 1e-9 then 1.0 else 0 end), 6) as pct_within,
  avg(case when abs(close_f1 - ref) <= 50 + 1e-9 then 1.0 else 0 end) >= 0.99 as passed from curve c join ref_front r on c.product = r.product and c.date = r.date
where close_f1 is not null group by 1""",
)
def reconcile_curves(t):
    return rounded(
        Q.reconcile(t.curve(), ref_front(t), ["product"], "close_f1", Q.within_tick(50.0), 0.99)
    )


@query(
    "136",
    f"""with a as (select product, date, {S.std("close_f1", 20, WP)} as v from curve),
b as (select product, date, {S.std("ref", 20, WP)} as v from ref_front)
select a.product, count(*) as n_overlap, round(avg(case when abs(a.v - b.v) / greatest(abs(b.v), 1e-9) <= 0.15 then 1.0 else 0 end), 6) as pct_within,
  avg(case when abs(a.v - b.v) / greatest(abs(b.v), 1e-9) <= 0.15 then 1.0 else 0 end) >= 0.9 as passed
from a join b on a.product = b.product and a.date = b.date where a.v is not null and b.v is not null group by 1""",
)
def reconcile_vol(t):
    from ..functions.exprs import roll_std

    def vol(d):
        return rolling(
            d.select("product", "date", "close_f1"),
            PROD,
            lambda w: {"vol": roll_std("close_f1", w, 20)},
            20,
        )

    d = Q.reconcile(
        vol(t.curve()), vol(ref_front(t)), ["product"], "vol", Q.within_share(0.15), 0.9
    )
    return rounded(d)


@query(
    "137",
    f"""with a as (select product, date, {S.lnr("close_f1", f"lag(close_f1) over ({WP})")} as v from curve),
b as (select product, date, {S.lnr("ref", f"lag(ref) over ({WP})")} as v from ref_front)
select a.product, count(*) as n_overlap, round(case when count(*) >= 30 then corr(a.v, b.v) end, 6) as corr,
  coalesce(case when count(*) >= 30 then corr(a.v, b.v) end > 0.98, false) as passed
from a join b on a.product = b.product and a.date = b.date where a.v is not null and b.v is not null group by 1""",
)
def reconcile_returns(t):
    from ..functions.exprs import log_return

    def rets(d):
        return rolling(
            d.select("product", "date", "close_f1"),
            PROD,
            lambda w: {"ret": log_return(w, "close_f1")},
            1,
        )

    return rounded(Q.reconcile_returns(rets(t.curve()), rets(ref_front(t)), ["product"]))


@query(
    "138",
    """select symbol, count(*) as n from bars_w where symbol in (select symbol from bars_w group by 1
 having count(*) >= floor((select count(distinct datetime) from bars_w) * 0.98e0)) group by 1""",
)
def complete_symbols(t):
    d = Q.complete_symbols(t.bars_w().select("symbol", "datetime"))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("139", "select cast(unnest([1, 5, 21]) as int) as truncation, cast(0 as bigint) as n_changed")
def truncation_invariance(t):
    cols = ["momentum_4", "realized_vol_8", "order_flow_imbalance_z20", "vol_of_vol_96"]
    return Q.truncation_changes(
        t.bars_w(), lambda d: X.raw_features(d, WEEKLY), cols, [1, 5, 21], WEEKLY
    )


@query(
    "141",
    """with e as (select symbol, unnest(generate_series(min(datetime), max(datetime), interval 1 hour)) as h from bars_1h group by symbol),
m as (select e.symbol, count(*) as k from e anti join bars_1h b on e.symbol = b.symbol and e.h = b.datetime group by 1)
select b.symbol, n as n_bars, coalesce(k, 0) as n_missing, round(coalesce(k, 0) / (n + coalesce(k, 0)), 6) as share_missing
from (select symbol, count(*) as n from bars_1h group by 1) b left join m on b.symbol = m.symbol""",
)
def gap_detection(t):
    return rounded(Q.gap_summary(t.bars_1h().select("symbol", "datetime"), "1 hour"))


view(
    "bars_big",
    """select symbol, date_trunc('hour', ts) as datetime, max(price) as high, min(price) as low, arg_max(price, id) as close from trades where qty >= 20 group by 1, 2""",
)


def feeds(t):
    a = t.bars_1h().select("symbol", "datetime", "high", "low", "close")
    b = t.trades().where("qty >= 20").groupBy("symbol", F.date_trunc("hour", "ts").alias("datetime"))
    b = b.agg(
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "id")).alias("close"),
    )
    return Q.feed_differences(a, b, ["symbol", "datetime"], ["high", "low", "close"])


@query(
    "142",
    """with d as (select unnest(['high', 'low', 'close']) as field, unnest([abs(a.high - b.high), abs(a.low - b.low), abs(a.close - b.close)]) as diff,
  unnest([abs(a.high - b.high) / nullif(abs(b.high), 0), abs(a.low - b.low) / nullif(abs(b.low), 0), abs(a.close - b.close) / nullif(abs(b.close), 0)]) as rel
 from bars_1h a join bars_big b on a.symbol = b.symbol and a.datetime = b.datetime)
select field, round(max(diff), 6) as max_abs_diff, round(max(rel), 6) as max_rel_diff, count(*) as n, round(quantile_cont(rel, 0.5), 6) as median_rel_diff from d group by 1""",
)
def feed_reconciliation(t):
    return rounded(feeds(t)[0])


@query(
    "142",
    """select a.symbol, a.datetime, 'a' as side from bars_1h a anti join bars_big b on a.symbol = b.symbol and a.datetime = b.datetime
union all select b.symbol, b.datetime, 'b' from bars_big b anti join bars_1h a on a.symbol = b.symbol and a.datetime = b.datetime""",
)
def feed_one_sided(t):
    return feeds(t)[1]


@query(
    "143",
    """with i as (select distinct n_name as dimension, c_mktsegment || '/' || (c_custkey % 3) as indicator, 0.1e0 + c_custkey % 3 as weight, c_custkey % 37 as input
  from customer join nation on c_nationkey = n_nationkey),
tg as (select distinct r_name as target, s_suppkey % 37 as input from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select a.dimension, a.target, a.intersection, round(b.w, 6) as overlap_weight, true as disqualified from (
 select dimension, target, list_sort(list(distinct i.input)) as intersection from i join tg on i.input = tg.input group by 1, 2) a
join (select dimension, target, sum(weight) as w from (select distinct dimension, target, indicator, weight from i join tg on i.input = tg.input) group by 1, 2) b
on a.dimension = b.dimension and a.target = b.target""",
)
def input_overlap(t):
    n = t.read("nation")
    k = F.col("c_custkey") % 3
    ind = (
        t.read("customer")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("dimension"),
            F.concat_ws("/", "c_mktsegment", k).alias("indicator"),
            (k + 0.1).alias("weight"),
            (F.col("c_custkey") % 37).alias("input"),
        )
        .distinct()
    )
    tgt = (
        t.read("supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("target"), (F.col("s_suppkey") % 37).alias("input"))
        .distinct()
    )
    return rounded(Q.input_overlap(ind, tgt))


# ---- alignment -------------------------------------------------------------

BDAY = """cast(date_trunc('week', date) as date) + cast(((least(isodow(date) - 1, 4) + n) // 5) * 7 + (least(isodow(date) - 1, 4) + n) % 5 as int)"""


def pub_sql(src: str, lag: str) -> str:
    """Source rows moved to their public business day, last one kept."""
    return f"""select series, pub, arg_max(value, date) as value from (select *, {BDAY} as pub from (
 select *, case when isodow(date) >= 6 then greatest({lag}, 1) else {lag} end as n from {src} where value is not null)) group by 1, 2"""


view("macro_pub", pub_sql("macro_long", "3"))


@query(
    "82",
    """select d.symbol, d.date, d.series, round(case when d.date - m.pub <= 2 then m.value end, 9) as value from (
 select distinct symbol, cast(datetime as date) as date, s.series from bars_w, (select distinct series from macro_long) s) d
asof left join macro_pub m on d.series = m.series and d.date >= m.pub""",
)
def align_with_staleness(t):
    series = F.explode(F.array(*[F.lit(p) for p in PRIORITIES])).alias("series")
    target = t.bars_w().select("symbol", F.to_date("datetime").alias("date"), series)
    d = A.align_to_target(target, t.macro_long(), "value", 3, 2, ["series"])
    return rounded(d.select("symbol", "date", "series", "value"), 9)


LAGS = {"urgent": 1, "high": 5, "low": 0}
view(
    "macro_w3",
    """select date, max(case when series = '1-URGENT' then value end) as urgent, max(case when series = '2-HIGH' then value end) as high,
  max(case when series = '5-LOW' then value end) as low from macro_long group by 1""",
)


@query(
    "83",
    f"""with m as (select date, unnest(['urgent', 'high', 'low']) as series, unnest([urgent, high, low]) as value, unnest([1, 5, 0]) as lag from macro_w3),
p as ({pub_sql("m", "lag")}),
g as (select distinct date, s.series from contract_bars, (select unnest(['urgent', 'high', 'low']) as series) s),
j as (select g.date, g.series, case when g.date - p.pub <= 10 then p.value end as v from g asof left join p on g.series = p.series and g.date >= p.pub)
select date, round(max(case when series = 'urgent' then v end), 9) as urgent, round(max(case when series = 'high' then v end), 9) as high,
  round(max(case when series = 'low' then v end), 9) as low from j group by 1""",
)
def align_columns(t):
    from ..sources.ingest import widen

    wide = widen(t.macro_long(), ["1-URGENT", "2-HIGH", "5-LOW"], ["urgent", "high", "low"])
    target = t.contract_bars().select("date").distinct()
    return rounded(A.align_columns(target, wide, LAGS, 10), 9)


view(
    "cot",
    """select product, report_date, report_date + 3 as public_date, (noncomm_long - noncomm_short) / greatest(open_interest_all, 1) as net_frac from positions""",
)


@query(
    "84",
    "select product, report_date, public_date, round(net_frac, 6) as net_frac from cot",
)
def lagged_positioning(t):
    return rounded(A.lagged_positioning(positions(t)))


STATE = """select product, date, ln(close_f2 / close_f1) / 30 * 365 as slope, case when close_f2 < close_f1 then 'backwardation' when close_f2 > close_f1 then 'contango' end as state
from curve where close_f1 > 0 and close_f2 > 0"""
view("curve_state", STATE)


def curve_state(t):
    from ..functions.exprs import log_ratio

    c = t.curve()
    s = F.when(F.col("close_f2") < F.col("close_f1"), "backwardation").when(
        F.col("close_f2") > F.col("close_f1"), "contango"
    )
    slope = log_ratio("close_f2", "close_f1") / 30 * 365.0
    return c.select("product", "date", slope.alias("slope"), s.alias("state")).where(
        "slope is not null"
    )


@query(
    "81, 193",
    """with j as (select s.*, c.net_frac from curve_state s asof left join cot c on s.product = c.product and s.date >= c.public_date),
a as (select * from j where net_frac is not null and state is not null),
g as (select product, count(case when state = 'backwardation' then 1 end) as n_a, avg(case when state = 'backwardation' then net_frac end) as mean_a,
 stddev_pop(case when state = 'backwardation' then net_frac end) as std_a, var_samp(case when state = 'backwardation' then net_frac end) as va,
 count(case when state = 'contango' then 1 end) as n_b, avg(case when state = 'contango' then net_frac end) as mean_b,
 stddev_pop(case when state = 'contango' then net_frac end) as std_b, var_samp(case when state = 'contango' then net_frac end) as vb, corr(slope, net_frac) as c from a group by 1)
select product, n_a, round(mean_a, 6) as mean_a, round(std_a, 6) as std_a, n_b, round(mean_b, 6) as mean_b, round(std_b, 6) as std_b,
 round(c, 6) as slope_corr, round((mean_a - mean_b) / sqrt(va / n_a + vb / n_b), 6) as welch_t from g""",
)
def positioning_by_state(t):
    cot = A.lagged_positioning(positions(t))
    d = A.positioning_by_state(curve_state(t), cot, "state", "slope", "backwardation", "contango")
    return rounded(d)


@query(
    "85",
    """with m as (select date, lag(urgent, 1) over (order by date) as u, lag(high, 1) over (order by date) as h, lag(urgent - high, 1) over (order by date) as s from macro_w3),
q as (select quantile_cont(u, 0.333) as u1, quantile_cont(u, 0.667) as u2, quantile_cont(h, 0.333) as h1, quantile_cont(h, 0.667) as h2 from m)
select d.date, case when m.date is null then null when u < u1 then 'low_vol' when u < u2 then 'mid_vol' else 'high_vol' end as vol_regime,
  case when m.date is null then null when h < h1 then 'low_rate' when h < h2 then 'mid_rate' else 'high_rate' end as rate_regime,
  case when m.date is null then null when s < 0 then 'inverted' else 'normal' end as yield_curve_regime
from (select distinct date from contract_bars) d left join m on d.date = m.date, q""",
)
def lagged_macro_labels(t):
    from ..sources.ingest import widen

    wide = widen(t.macro_long(), PRIORITIES, PRIO_COLS)
    wide = wide.withColumn("slope", F.col("urgent") - F.col("high"))
    dates = t.contract_bars().select("date").distinct()
    return A.lagged_labels(wide, dates, {"urgent": "vol", "high": "rate"}, "slope", 1)


@query(
    "87",
    """with r as (select date, urgent / 10000 as rate from macro_w3),
j as (select s.spread, s.date, value, leg2_price, last_value(rate ignore nulls) over (partition by spread order by s.date) as rate from spreads s left join r on s.date = r.date),
f as (select *, -(5.0 + rate * leg2_price / 12) as fv from j)
select spread, date, round(rate, 9) as rate, round(fv, 6) as carry_fv, round(-value / nullif(fv, 0), 6) as carry_ratio,
 coalesce(-value / nullif(fv, 0) > 0 and -value / nullif(fv, 0) < 10, false) as mild from f""",
)
def fill_and_band(t):
    from ..sources.ingest import widen

    r = widen(t.macro_long(), ["1-URGENT"], ["rate"])
    r = r.withColumn("rate", F.col("rate") / 10000)
    s = t.spreads().select("spread", "date", "value", "leg2_price")
    d = A.fill_and_band(s, r, ["spread"], 5.0, 0.0, 10.0)
    return rounded(d.select("spread", "date", "rate", "carry_fv", "carry_ratio", "mild"), rate=9)


