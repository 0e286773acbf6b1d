"""Queries over scans, bars and projections (inventory 2.A and 2.B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import forward_return, log_return
from ..functions.ordered import DAILY, WEEKLY, rolling
from ..operators import bars as B
from ..session import scratch
from ..sources import ingest as I
from .registry import fine, query, r, rounded, view

NATIONS = [f"NATION_{i}" for i in range(25)]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIO_COLS = ["urgent", "high", "medium", "not_specified", "low"]


@query(
    "1",
    """select symbol, cast(datetime as date) as date, count(*) as n, round(sum(price * qty), 4) as notional,
  min(time_ms) as first_ms
from (select symbol, ts as datetime, epoch_us(ts) // 1000 as time_ms, price, qty from trades) group by 1, 2""",
)
def trade_archive_days(t):
    d = t.trades().withColumn("time_ms", F.unix_millis("ts"))
    d = d.withColumn("date", F.to_date(F.timestamp_millis("time_ms")))
    return d.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum(F.col("price") * F.col("qty")), 4).alias("notional"),
        F.min("time_ms").alias("first_ms"),
    )


def written(lines, *layout: str):
    """Write lines of text to the shared folder, one folder per value of ``layout``."""
    path = scratch(lines.sparkSession)
    lines.repartition(*layout).write.partitionBy(*layout).text(path)
    return path


@query(
    "1",
    """with a as (select symbol, ts, epoch_us(ts) // 1000 as ms, price, qty, id from trades)
select symbol, cast(make_timestamp(ms * 1000) as date) as date, count(*) as n, round(sum(price * qty), 4) as notional, min(ms) as first_ms,
 count(case when id % 97 = 0 then 1 end) as n_cut, count(case when id % 89 = 0 then 1 end) as n_unreadable
from a group by 1, 2""",
)
def trade_csv_ingest(t):
    """Trades written as CSV, with header, cut and unreadable lines among them, read with a
    fixed schema, stored by symbol and day, and scanned back; refused lines are counted."""
    d = t.trades().withColumn("ms", F.unix_millis("ts"))
    line = F.concat_ws(",", "id", "price", "qty", F.col("price") * F.col("qty"), "ms", "is_buyer_maker")
    cut = F.concat_ws(",", "id", "price", F.lit("cut"), "ms")
    bad = F.concat_ws(",", F.lit("x"), "price", "qty", "qty", "ms", F.lit("true"))
    lines = F.array(
        F.when(F.col("id") % 500 == 0, F.lit("id,price,qty,quoteQty,time,isBuyerMaker")), line,
        F.when(F.col("id") % 97 == 0, cut), F.when(F.col("id") % 89 == 0, bad),
    )
    day = F.to_date(F.timestamp_millis("ms")).alias("day")
    path = written(d.select("symbol", day, F.explode(F.array_compact(lines)).alias("value")), "symbol", "day")
    judged = I.judged_trades(d.sparkSession, path)
    store = scratch(d.sparkSession)
    I.write_trades(I.good(judged).drop("day"), store)
    trades = I.scan_trades(d.sparkSession, store, "1900-01-01", "2100-01-01")
    sums = trades.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.col("price") * F.col("qty")), 4).alias("notional"), F.min("time").alias("first_ms")
    )
    refused = judged.where(F.col(I.REASON).isNotNull())
    refused = refused.groupBy("symbol", F.col("day").alias("date")).agg(
        F.count_if(F.col(I.LINE).contains(",cut,")).alias("n_cut"), F.count_if(F.col(I.LINE).startswith("x,")).alias("n_unreadable")
    )
    return sums.join(refused, ["symbol", "date"], "left").na.fill(0, ["n_cut", "n_unreadable"])


@query(
    "2",
    """select symbol, datetime, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume, count, round(taker_buy_volume, 6) as taker_buy_volume from bars_w""",
)
def kline_csv_ingest(t):
    """Bars written as 12-column CSV, some symbols with a header line, some lines broken."""
    b = t.bars_w()
    ms = F.unix_millis("datetime")
    zero = F.lit(0)
    line = F.concat_ws(",", ms, "open", "high", "low", "close", "volume", ms + 604799999, zero, "count", "taker_buy_volume", zero, zero)
    starts = b.groupBy("symbol").agg(F.min("datetime").alias("_first"))
    first = F.col("datetime") == F.col("_first")
    lines = F.array(
        F.when(first & F.col("symbol").rlike("[02468]$"), F.lit(",".join(c.split()[0] for c in I.KLINE_SCHEMA.split(", ")))),
        line,
        F.when(F.month("datetime") == 7, F.concat(line, F.lit(",1,2"))),
    )
    path = written(b.join(starts, "symbol").select("symbol", F.explode(F.array_compact(lines)).alias("value")), "symbol")
    return rounded(I.read_klines(b.sparkSession, path))


@query("4", "select symbol, datetime, round(funding_rate, 12) as funding_rate, 2 as n_refused from funding")
def funding_json_ingest(t):
    """Rates written as JSON strings, every row twice, with two broken lines per row's day."""
    f = t.funding()
    row = F.struct("symbol", F.unix_millis("datetime").alias("fundingTime"), F.format_string("%.12f", "funding_rate").alias("fundingRate"))
    text = F.to_json(row)
    lines = F.array(text, text, F.regexp_replace(text, "}$", ""), F.regexp_replace(text, r'"fundingRate":"', '"fundingRate":"n/a '))
    path = written(f.select(F.to_date("datetime").alias("day"), F.explode(lines).alias("value")).withColumn("part", F.year("day")).drop("day"), "part")
    spark = f.sparkSession
    judged = I.judged_funding(spark, path)
    time = F.coalesce("datetime", F.timestamp_millis(F.regexp_extract(I.LINE, r'"fundingTime":(-?\d+)', 1).cast("long")))
    name = F.coalesce("symbol", F.regexp_extract(I.LINE, r'"symbol":"([^"]+)"', 1))
    refused = judged.where(F.col(I.REASON).isNotNull()).groupBy(name.alias("symbol"), time.alias("datetime"))
    refused = refused.agg(F.count(F.lit(1)).cast("int").alias("n_refused"))
    d = I.read_funding(spark, path).join(refused, ["symbol", "datetime"], "left")
    return d.select("symbol", "datetime", r(F.col("funding_rate"), 12).alias("funding_rate"), "n_refused")


@query(
    "3",
    """select distinct symbol, datetime, close from bars_w
where datetime between timestamp '1996-01-01' and timestamp '1997-12-31'""",
)
def range_scan_dedupe(t):
    b = t.bars_w().select("symbol", "datetime", "close")
    return I.range_scan(b.unionAll(b), "1996-01-01", "1997-12-31")


@query(
    "4",
    """select symbol, datetime, round(funding_rate, 12) as funding_rate from funding""",
)
def funding_ingest(t):
    """The rate goes through its string form, as in the source files."""
    f = t.funding().withColumn("fundingRate", F.format_string("%.12f", "funding_rate"))
    f = f.select(
        "symbol",
        F.timestamp_millis(F.unix_millis("datetime")).alias("datetime"),
        r(F.col("fundingRate").cast("double"), 12).alias("funding_rate"),
    )
    return f.dropDuplicates(["symbol", "datetime"])


@query(
    "5, 14",
    """select symbol, datetime, close from bars_w
where datetime between timestamp '1995-01-01' and timestamp '2000-12-31'
  and datetime in (select datetime from bars_w group by 1 having count(*) >= 24)""",
)
def universe_panel(t):
    b = t.bars_w().select("symbol", "datetime", "close")
    return I.universe_panel(b, 24, "1995-01-01", "2000-12-31", holdout="2001-01-01")


@query(
    "6",
    """select date, open, high, low, close, volume from daily where symbol = 'click'""",
)
def daily_scan(t):
    b = t.daily().select(
        "symbol", F.col("date").cast("timestamp").alias("timestamp"), F.lit("1d").alias("interval"),
        "open", "high", "low", "close", "volume",
    )
    return I.scan_daily(b, "click")


@query(
    "7",
    """select date, round(max(case when series = '1-URGENT' then value end), 9) as urgent,
  round(max(case when series = '2-HIGH' then value end), 9) as high,
  round(max(case when series = '3-MEDIUM' then value end), 9) as medium,
  round(max(case when series = '4-NOT SPECIFIED' then value end), 9) as not_specified,
  round(max(case when series = '5-LOW' then value end), 9) as low
from macro_long group by 1""",
)
def macro_wide(t):
    return rounded(I.widen(t.macro_long(), PRIORITIES, PRIO_COLS), 9)


POSITIONS = """select cast(date_trunc('week', o_orderdate) as date) as report_date, r_name as product,
  sum(case when o_orderpriority = '1-URGENT' then o_totalprice else 0 end) as noncomm_long,
  sum(case when o_orderpriority = '5-LOW' then o_totalprice else 0 end) as noncomm_short,
  sum(case when o_orderpriority = '2-HIGH' then o_totalprice else 0 end) as comm_long,
  sum(case when o_orderpriority = '3-MEDIUM' then o_totalprice else 0 end) as comm_short,
  sum(o_totalprice) as open_interest_all
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey group by 1, 2"""
view("positions", POSITIONS)


def positions(t):
    d = (
        t.read("orders")
        .join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )

    def part(p, name):
        hit = F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")).otherwise(0.0)
        return F.sum(hit).alias(name)

    return d.groupBy(
        F.date_trunc("week", "o_orderdate").cast("date").alias("report_date"),
        F.col("r_name").alias("product"),
    ).agg(
        part("1-URGENT", "noncomm_long"),
        part("5-LOW", "noncomm_short"),
        part("2-HIGH", "comm_long"),
        part("3-MEDIUM", "comm_short"),
        F.sum("o_totalprice").alias("open_interest_all"),
    )


@query(
    "8, 9",
    """select report_date, product, round(noncomm_long - noncomm_short, 2) as noncomm_net,
  round((noncomm_long - noncomm_short) / nullif(open_interest_all, 0), 6) as noncomm_net_frac,
  round(comm_long - comm_short, 2) as comm_net,
  round((comm_long - comm_short) / nullif(open_interest_all, 0), 6) as comm_net_frac
from positions""",
)
def net_positioning(t):
    d = I.net_positioning(positions(t), ["noncomm", "comm"])
    return d.select(
        "report_date",
        "product",
        *[r(f"{c}_net", 2).alias(f"{c}_net") for c in ("noncomm", "comm")],
        *[r(f"{c}_net_frac").alias(f"{c}_net_frac") for c in ("noncomm", "comm")],
    )


@query(
    "10",
    """select n.product as symbol, c.date, round(c.close_f1, 6) as close_f1, round(c.close_f2, 6) as close_f2,
  round(c.close_f3, 6) as close_f3, c.dte_f1, c.dte_f2, c.dte_f3
from (select r_name as product from region union all select 'NO_CURVE') n
left join curve c on n.product = c.product""",
)
def curve_scan(t):
    names = t.read("region").select(F.col("r_name").alias("product"))
    names = names.unionAll(names.limit(1).select(F.lit("NO_CURVE").alias("product")))
    d = names.join(t.curve(), "product", "left").withColumnRenamed("product", "symbol")
    return rounded(d)


@query(
    "11",
    """select symbol, datetime, d as dimension, floor(s * 1e9 + 0.5) / 1e9 as score, l as label from (
select symbol, datetime, 'range' as d, high - low as s, case when high > low then 'wide' end as l from bars_w
union all
select symbol, datetime, 'move', nullif(close - open, 0), case when close > open then 'up' when close < open then 'down' end
from bars_w) where s is not null or l is not null""",
)
def melt_sink(t):
    up = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down")
    d = t.bars_w().select(
        "symbol",
        "datetime",
        (F.col("high") - F.col("low")).alias("range_score"),
        F.when(F.col("high") > F.col("low"), "wide").alias("range_label"),
        F.nullif(F.col("close") - F.col("open"), F.lit(0.0)).alias("move_score"),
        up.alias("move_label"),
    )
    d = I.melt_scores(d, ["symbol", "datetime"], ["range", "move"])
    return rounded(d.withColumn("score", fine("score")), score=None)


@query(
    "12",
    "select symbol, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from trades group by 1",
)
def coverage_profile(t):
    return I.coverage_profile(t.trades(), "symbol", "ts")


@query(
    "13",
    """with a as (select symbol, datetime, round(close, 6) as close from bars_w),
b as (select symbol, datetime, case when symbol = 'NATION_3' then close + 1 else close end as close from a where not (symbol = 'NATION_5' and year(datetime) = 1996))
select count(*) as n_diff from ((from a except all from b) union all (from b except all from a))""",
)
def dataset_diff(t):
    b = rounded(t.bars_w().select("symbol", "datetime", "close"))
    changed = F.when(F.col("symbol") == "NATION_3", F.col("close") + 1).otherwise(F.col("close"))
    copy = b.where("not (symbol = 'NATION_5' and year(datetime) = 1996)").withColumn("close", changed)
    d = I.dataset_diff(b, copy)
    return d.agg(F.count(F.lit(1)).alias("n_diff"))


@query(
    "14",
    "select series, date, round(value, 9) as value from macro_long where date <= date '1998-06-30'",
)
def holdout_cut(t):
    return rounded(I.holdout_cut(t.macro_long(), "date", "1998-06-30"), 9)


@query(
    "15",
    """select symbol, time_bucket(interval '15 minutes', ts) as datetime, arg_min(price, id) as open,
  max(price) as high, min(price) as low, arg_max(price, id) as close, round(sum(qty), 6) as volume
from trades group by 1, 2""",
)
def tick_bars(t):
    return rounded(B.bucket(t.trades(), "15 minutes", B.ohlcv()))


@query(
    "16",
    """select symbol, time_bucket(interval '6 hours', ts) as datetime, round(sum(price * qty) / sum(qty), 6) as vwap,
  count(*) as n, round(avg(case when is_buyer_maker then 1.0 else 0.0 end), 6) as maker_share
from trades where qty > 0 group by 1, 2""",
)
def bucket_aggregates(t):
    aggs = [
        (F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("vwap"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("is_buyer_maker").cast("double")).alias("maker_share"),
    ]
    return rounded(B.bucket(t.trades().where("qty > 0"), "6 hours", aggs))


view(
    "intraday",
    """select *, hour(ts_local) as hour, minute(ts_local) as minute, isodow(ts_local) as weekday,
  cast(ts_local as date) as date_local from (
select symbol, datetime, close, (datetime at time zone 'UTC') at time zone 'America/New_York' as ts_local,
  case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as ret
from bars_1h window w as (partition by symbol order by datetime)) where ret is not null""",
)


def intraday(t):
    return B.local_bars(t.bars_1h().select("symbol", "datetime", "close"), "America/New_York")


@query(
    "17",
    """select symbol, datetime, ts_local, cast(hour as int) as hour, cast(minute as int) as minute,
  cast(weekday as int) as weekday, date_local, round(ret, 6) as ret from intraday""",
)
def intraday_local(t):
    return rounded(intraday(t).drop("close"))


@query(
    "18",
    """select symbol, cast(hour * 60 + minute as int) as minute_of_day, round(avg(abs(ret)), 6) as mean_abs_ret,
  count(*) as n from intraday group by 1, 2""",
)
def minute_profile(t):
    return rounded(B.minute_profile(intraday(t), ["symbol"]))


@query(
    "19",
    """select symbol, round(e, 6) as event_mean, round(o, 6) as other_mean, n as n_event_days, round(e / nullif(o, 0), 6) as ratio
from (select symbol, avg(case when weekday = 3 then abs(ret) end) as e,
   avg(case when weekday <> 3 then abs(ret) end) as o,
   count(distinct case when weekday = 3 then date_local end) as n
 from intraday where hour * 60 + minute between 540 and 660 group by 1)""",
)
def event_study(t):
    return rounded(B.event_study(intraday(t), 3, 600, 60, ["symbol"])[0])


@query(
    "19",
    """select symbol, cast(hour * 60 + minute - 600 as int) as minutes_from_event, round(avg(abs(ret)), 6) as mean_abs_ret
from intraday where weekday = 3 and hour * 60 + minute between 480 and 720 group by 1, 2""",
)
def event_path(t):
    return rounded(B.event_study(intraday(t), 3, 600, 120, ["symbol"])[1])


@query(
    "20",
    """with f as (select *, unnest([1, 5, 15, 30, 60]) as freq from trades),
b as (select symbol, freq, cast(ts as date) as d, (hour(ts) * 60 + minute(ts)) // freq * freq as bucket,
   arg_max(price, id) as close from f group by 1, 2, 3, 4),
x as (select *, case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as ret
  from b window w as (partition by symbol, freq, d order by bucket)),
v as (select symbol, freq, d, coalesce(sum(ret * ret), 0) as rv from x group by 1, 2, 3)
select symbol, freq, round(avg(rv), 6) as mean_daily_rv, count(*) as n_days from v group by 1, 2""",
)
def vol_signature(t):
    d = t.trades().select("symbol", "ts", "id", F.col("price").alias("close"))
    d = d.withColumn("date_local", F.to_date("ts"))
    return rounded(B.vol_signature(d, [1, 5, 15, 30, 60], ["symbol"], ts="ts", tie="id"))


view(
    "subbars",
    """select symbol, date_trunc('day', datetime) as datetime, coalesce(sum(lr * lr), 0) as rv_subbar,
  count(lr) as n_subbars from (
select symbol, datetime, case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as lr
from bars_1h window w as (partition by symbol order by datetime)) group by 1, 2""",
)


@query(
    "21",
    """select symbol, cast(datetime as timestamp) as datetime, round(rv_subbar, 6) as rv_subbar, n_subbars from subbars""",
)
def subbar_variance(t):
    return rounded(B.subbar_variance(t.bars_1h().select("symbol", "datetime", "close"), "day"))


@query(
    "22",
    """with b as (select symbol, cast(datetime as timestamp) as datetime, arg_min(open, h) as open, max(high) as high,
   min(low) as low, arg_max(close, h) as close, sum(volume) as volume, sum(taker_buy_volume) as tbv
  from (select *, date_trunc('day', datetime) as d, datetime as h from bars_1h) q(symbol, h0, open, high, low, close, volume, count, taker_buy_volume, datetime, h) group by 1, 2),
x as (select *, case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as log_return,
  case when open > 0 and lag(close) over w > 0 then ln(open / lag(close) over w) end as gap_return,
  case when close > 0 and open > 0 then ln(close / open) end as co,
  case when high > 0 and low > 0 then ln(high / low) end as hl,
  case when high > 0 and close > 0 then ln(high / close) end as hc,
  case when high > 0 and open > 0 then ln(high / open) end as ho,
  case when low > 0 and close > 0 then ln(low / close) end as lc,
  case when low > 0 and open > 0 then ln(low / open) end as lo
  from b window w as (partition by symbol order by datetime))
select x.symbol, x.datetime, round(log_return, 6) as log_return, round(gap_return, 6) as gap_return,
  round(co, 6) as intrabar_return, round(hl, 6) as hl_log,
  round((close - low) / nullif(high - low, 0), 6) as intrabar_close_pos,
  round(tbv / nullif(volume, 0), 6) as taker_buy_ratio, round(hl * hl / (4 * ln(2)), 6) as pk_var,
  round(0.5 * hl * hl - (2 * ln(2) - 1) * co * co, 6) as gk_var, round(hc * ho + lc * lo, 6) as rs_var,
  round(coalesce(rv_subbar, log_return * log_return), 6) as rv_target
from x left join subbars s on x.symbol = s.symbol and x.datetime = s.datetime""",
)
def asset_frame(t):
    h = t.bars_1h()
    day = h.groupBy("symbol", F.date_trunc("day", "datetime").alias("datetime")).agg(
        F.min_by("open", "datetime").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "datetime").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("taker_buy_volume").alias("taker_buy_volume"),
    )
    d = B.asset_frame(day, B.subbar_variance(h.select("symbol", "datetime", "close"), "day"))
    return rounded(
        d.drop("open", "high", "low", "close", "volume", "taker_buy_volume", "rv_subbar", "n_subbars")
    )


@query(
    "23, 24, 25, 27, 36",
    """select symbol, datetime, round(ln(close / lag(close) over w), 6) as log_return,
  round(ln(close / lag(close, 5) over w), 6) as close_log_return,
  round(ln(lead(close, 3) over w / close), 6) as fwd_return_3,
  lag(count, 1) over w as lag_1, lag(count, 2) over w as lag_2, lag(count, 3) over w as lag_3
from bars_w window w as (partition by symbol order by datetime)""",
)
def returns_and_lags(t):
    def stage(w):
        return {
            "log_return": log_return(w),
            "close_log_return": log_return(w, "close", 5),
            "fwd_return_3": forward_return(w, "close", 3),
            **B.lags("count", 3, 1, w),
        }

    d = rolling(t.bars_w().select("symbol", "datetime", "close", "count"), WEEKLY, stage, 5, 3)
    return rounded(d.drop("close", "count"))


@query(
    "26, 28",
    """with x as (select symbol, datetime, ln(close / lag(close, 2) over w) as r from bars_w
  window w as (partition by symbol order by datetime))
select symbol, datetime, round(r, 6) as close_log_return, round(lag(r, 2) over w, 6) as lag_1,
  round(lag(r, 4) over w, 6) as lag_2, round(lag(r, 6) over w, 6) as lag_3
from x window w as (partition by symbol order by datetime)""",
)
def return_with_lags(t):
    d = B.return_with_lags(t.bars_w().select("symbol", "datetime", "close"), "close", 2, 3, WEEKLY)
    return rounded(d.drop("close"))


@query(
    "29",
    """with x as (select symbol, datetime, ln(close / lag(close) over w) as r from bars_w
  window w as (partition by symbol order by datetime)),
y as (select symbol, r, lag(r, 1) over w as lag_1, lag(r, 2) over w as lag_2 from x
  window w as (partition by symbol order by datetime)),
z as (select * from y where r is not null and lag_1 is not null and lag_2 is not null),
l as (select symbol, unnest(['close_log_return', 'lag_1', 'lag_2']) as a, unnest([r, lag_1, lag_2]) as va, r, lag_1, lag_2 from z),
m as (select symbol, a, va, unnest(['close_log_return', 'lag_1', 'lag_2']) as b, unnest([r, lag_1, lag_2]) as vb from l)
select symbol, a, b, round(corr(va, vb), 6) as rho from m group by 1, 2, 3""",
)
def lag_correlations(t):
    d = B.return_with_lags(t.bars_w().select("symbol", "datetime", "close"), "close", 1, 2, WEEKLY)
    return rounded(B.correlation_long(d, ["close_log_return", "lag_1", "lag_2"], ["symbol"]))


@query(
    "30",
    """with x as (select symbol, datetime, ln(close / lag(close) over w) as log_return, ln(lead(close) over w / close) as fwd_ret
  from bars_w window w as (partition by symbol order by datetime)),
y as (select *, lag(log_return, 1) over w as lag_1, lag(log_return, 2) over w as lag_2, lag(log_return, 3) over w as lag_3,
   lag(log_return, 4) over w as lag_4, lag(log_return, 5) over w as lag_5 from x window w as (partition by symbol order by datetime))
select symbol, datetime, round(log_return, 6) as log_return, round(fwd_ret, 6) as fwd_ret, round(lag_1, 6) as lag_1,
 round(lag_2, 6) as lag_2, round(lag_3, 6) as lag_3, round(lag_4, 6) as lag_4, round(lag_5, 6) as lag_5
from y where log_return is not null and fwd_ret is not null and lag_5 is not null""",
)
def panel_lag_features(t):
    d = B.panel_lags(t.bars_w().select("symbol", "datetime", "close"), 5, WEEKLY)
    return rounded(d.drop("close"))


@query(
    "31",
    "select datetime, "
    + ", ".join(f"max(case when symbol = '{n}' then close end) as \"{n}\"" for n in NATIONS)
    + " from bars_w group by 1",
)
def panel_pivot(t):
    return B.pivot_feature(t.bars_w(), "close", NATIONS)


@query(
    "32",
    """select symbol, datetime, round(f, 6) as fwd_ret from (select symbol, datetime,
  ln(lead(close, 4) over w / close) as f, row_number() over w as i from bars_w
  window w as (partition by symbol order by datetime)) where (i - 1) % 4 = 0 and f is not null""",
)
def non_overlapping_forward(t):
    d = B.every_hth_forward_return(t.bars_w().select("symbol", "datetime", "close"), 4, s=WEEKLY)
    return rounded(d.drop("close"))


@query(
    "33, 34, 35",
    """with x as (select symbol, date, case when close > open then 'up' else 'down' end as label, close,
  case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as lr from daily
  window w as (partition by symbol order by date))
select symbol, date, label, lead(label, 5) over w as fwd_label,
  round(case when lead(close, 5) over w / nullif(close, 0) > 0 then ln(lead(close, 5) over w / close) end, 6) as fwd_log_return,
  round(case when count(lr) over f = 5 then stddev_samp(lr) over f end * sqrt(252), 6) as fwd_vol
from x window w as (partition by symbol order by date),
  f as (partition by symbol order by date rows between 1 following and 5 following)""",
)
def forward_targets(t):
    d = t.daily().withColumn(
        "label", F.when(F.col("close") > F.col("open"), "up").otherwise("down")
    )
    d = d.select("symbol", "date", "label", "close")
    return rounded(B.forward_targets(d, 5, "label", "close", True, DAILY).drop("close"))
