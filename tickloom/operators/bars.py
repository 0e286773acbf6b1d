"""Bars, resampling and time-series projections (inventory 2.B)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import forward_return, log_ratio, log_return, ratio, tick_key
from ..functions.ordered import BARS, Ordered, rolling, running

LN2 = math.log(2.0)


def bucket(df: DataFrame, interval: str, aggs: Sequence[Column], keys=("symbol",), ts="ts"):
    """Tumbling time buckets with caller-supplied aggregates; empty ones absent."""
    d = df.groupBy(*keys, F.window(ts, interval).alias("_w")).agg(*aggs)
    made = [c for c in d.columns if c not in (*keys, "_w")]
    return d.select(*keys, F.col("_w.start").alias("datetime"), *made)


def ohlcv(ts: str = "ts", tie: str = "id", price: str = "price", qty: str = "qty") -> list[Column]:
    """Aggregates that turn ticks into a bar."""
    key = tick_key(ts, tie)
    return [
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.sum(qty).alias("volume"),
    ]


def local_bars(bars: DataFrame, zone: str, s: Ordered = BARS) -> DataFrame:
    """Local clock fields (daylight saving aware) and the 1-bar log return."""
    d = bars.withColumn("ts_local", F.from_utc_timestamp("datetime", zone))
    d = d.select(
        "*",
        F.hour("ts_local").alias("hour"),
        F.minute("ts_local").alias("minute"),
        (F.weekday("ts_local") + 1).alias("weekday"),
        F.to_date("ts_local").alias("date_local"),
    )
    d = rolling(d, s, lambda w: {"ret": log_return(w)}, back=1)
    return d.where(F.col("ret").isNotNull())


def minute_profile(d: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute return and count per minute of the day."""
    m = (F.col("hour") * 60 + F.col("minute")).alias("minute_of_day")
    return d.groupBy(*keys, m).agg(
        F.avg(F.abs("ret")).alias("mean_abs_ret"), F.count(F.lit(1)).alias("n")
    )


def event_study(
    d: DataFrame, weekday: int, minute: int, window: int, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Activity round a scheduled weekday and time against other days.

    Returns the summary and the path by minutes from the event.
    """
    m = F.col("hour") * 60 + F.col("minute")
    near = d.where(m.between(minute - window, minute + window)).withColumn("_m", m - minute)
    hit = F.col("weekday") == weekday
    summary = near.groupBy(*keys).agg(
        F.avg(F.when(hit, F.abs("ret"))).alias("event_mean"),
        F.avg(F.when(~hit, F.abs("ret"))).alias("other_mean"),
        F.countDistinct(F.when(hit, F.col("date_local"))).alias("n_event_days"),
    )
    summary = summary.withColumn("ratio", ratio("event_mean", "other_mean"))
    path = (
        near.where(hit)
        .groupBy(*keys, F.col("_m").alias("minutes_from_event"))
        .agg(F.avg(F.abs("ret")).alias("mean_abs_ret"))
    )
    return summary, path


def vol_signature(
    d: DataFrame, freqs: Sequence[int], keys: Sequence[str], ts="ts_local", tie=None
) -> DataFrame:
    """Mean daily realized variance at several sampling steps (minutes)."""
    m = F.hour(ts) * 60 + F.minute(ts)
    f = d.select("*", F.explode(F.array(*[F.lit(x) for x in freqs])).alias("freq"))
    f = f.withColumn("bucket", F.floor(m / F.col("freq")) * F.col("freq"))
    last = tick_key(ts, tie) if tie else F.col(ts)
    b = f.groupBy(*keys, "freq", "date_local", "bucket").agg(F.max_by("close", last).alias("close"))
    # at most 1440 buckets per day: a bounded window group
    w = Window.partitionBy(*keys, "freq", "date_local").orderBy("bucket")
    b = b.withColumn("ret", log_ratio("close", F.lag("close").over(w)))
    day = b.groupBy(*keys, "freq", "date_local").agg(
        F.coalesce(F.sum(F.col("ret") * F.col("ret")), F.lit(0.0)).alias("rv")
    )
    return day.groupBy(*keys, "freq").agg(
        F.avg("rv").alias("mean_daily_rv"), F.count(F.lit(1)).alias("n_days")
    )


def subbar_variance(bars: DataFrame, unit: str, s: Ordered = BARS) -> DataFrame:
    """Sum of squared fine-bar log returns per coarse bucket, with the count."""
    d = rolling(bars, s, lambda w: {"_r": log_return(w)}, back=1)
    return d.groupBy(*s.keys, F.date_trunc(unit, "datetime").alias("datetime")).agg(
        F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0)).alias("rv_subbar"),
        F.count("_r").alias("n_subbars"),
    )


def range_variances() -> dict[str, Column]:
    """Per-bar variance terms from open, high, low and close."""
    hl, co = log_ratio("high", "low"), log_ratio("close", "open")
    return {
        "pk_var": hl * hl / (4.0 * LN2),
        "gk_var": 0.5 * hl * hl - (2.0 * LN2 - 1.0) * co * co,
        "rs_var": log_ratio("high", "close") * log_ratio("high", "open")
        + log_ratio("low", "close") * log_ratio("low", "open"),
    }


def asset_frame(bars: DataFrame, subbars: DataFrame | None, s: Ordered = BARS) -> DataFrame:
    """Returns, bar anatomy, range variances and the realized-variance target."""
    def stage(w):
        return {
            "log_return": log_return(w),
            "gap_return": log_ratio("open", F.lag("close").over(w)),
        }

    d = rolling(bars, s, stage, back=1).select(
        "*",
        log_ratio("close", "open").alias("intrabar_return"),
        log_ratio("high", "low").alias("hl_log"),
        ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias(
            "intrabar_close_pos"
        ),
        ratio("taker_buy_volume", "volume").alias("taker_buy_ratio"),
        *[c.alias(n) for n, c in range_variances().items()],
    )
    sq = F.col("log_return") * F.col("log_return")
    if subbars is None:
        return d.withColumn("rv_target", sq)
    d = d.join(subbars, [*s.keys, "datetime"], "left")
    return d.withColumn("rv_target", F.coalesce("rv_subbar", sq))


def lags(c: str, n: int, step: int = 1, w=None) -> dict[str, Column]:
    """lag_1 .. lag_n of a column at multiples of a step."""
    return {f"lag_{i}": F.lag(c, i * step).over(w) for i in range(1, n + 1)}


def return_with_lags(df: DataFrame, c: str, step: int, n: int, s: Ordered = BARS) -> DataFrame:
    """h-step log return of a column and its lags."""
    name = f"{c}_log_return"
    return rolling(
        df,
        s,
        [lambda w: {name: log_return(w, c, step)}, lambda w: lags(name, n, step, w)],
        back=step + n * step,
    )


def correlation_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson matrix in long form, rows with a null dropped, in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    agg = (
        df.dropna(subset=list(cols))
        .groupBy(*keys)
        .agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("rho"))
                for i, (a, b) in enumerate(pairs)
            ]
        )
    )
    return agg.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def panel_lags(panel: DataFrame, n: int, s: Ordered = BARS) -> DataFrame:
    """Log return, its lags, the next return; incomplete rows dropped."""
    d = rolling(
        panel,
        s,
        [
            lambda w: {"log_return": log_return(w), "fwd_ret": forward_return(w)},
            lambda w: lags("log_return", n, 1, w),
        ],
        back=n + 1,
        ahead=1,
    )
    return d.dropna(subset=["log_return", "fwd_ret", *[f"lag_{i}" for i in range(1, n + 1)]])


def pivot_feature(panel: DataFrame, c: str, symbols: Sequence[str]) -> DataFrame:
    """One column per symbol for one feature; the symbol list is given."""
    return panel.groupBy("datetime").pivot("symbol", list(symbols)).agg(F.first(c))


def every_hth_forward_return(df: DataFrame, h: int, c: str = "close", s: Ordered = BARS):
    """h-bar forward log return on rows 0, h, 2h, ... of each series."""
    d = running(df, s, {"_i": ("sum", F.lit(1).cast("long"))})
    d = rolling(d, s, lambda w: {"fwd_ret": forward_return(w, c, h)}, back=0, ahead=h)
    return d.where(((F.col("_i") - 1) % h == 0) & F.col("fwd_ret").isNotNull()).drop("_i")


def forward_targets(df: DataFrame, h: int, label: str, c: str, annualize: bool, s: Ordered):
    """Future label, future log return, future realized vol of daily returns."""
    def first(w):
        return {
            "fwd_label": F.lead(label, h).over(w),
            "fwd_log_return": forward_return(w, c, h),
            "_r": log_return(w, c),
        }

    def second(w):
        f = w.rowsBetween(1, h)
        vol = F.when(F.count("_r").over(f) == h, F.stddev_samp("_r").over(f))
        return {"fwd_vol": vol * math.sqrt(252.0) if annualize else vol}

    return rolling(df, s, [first, second], back=1, ahead=h).drop("_r")
