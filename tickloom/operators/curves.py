"""Futures curves, rolling, and seasonal statistics (inventory 2.J)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import log_ratio, ratio
from ..functions.ordered import Ordered, quantiles, rolling, running
from .align import asof_join

PRODUCT = Ordered(("product",), ("date",), step=1)

# Months of each seasonal state by product.
SEASONAL_WINDOWS = {
    "NG": {"heating_season": [11, 12, 1, 2, 3]},
    "ZC": {"planting": [4, 5], "growing": [6, 7, 8], "harvest": [9, 10, 11]},
    "ZW": {"planting": [9, 10], "growing": [3, 4, 5], "harvest": [6, 7]},
    "ZS": {"planting": [4, 5], "growing": [6, 7, 8], "harvest": [9, 10]},
    "ZL": {"planting": [4, 5], "growing": [6, 7, 8], "harvest": [9, 10]},
    "ZM": {"planting": [4, 5], "growing": [6, 7, 8], "harvest": [9, 10]},
    "KE": {"planting": [9, 10], "growing": [3, 4, 5], "harvest": [6, 7]},
}
DTE_EDGES = (0, 5, 10, 20, 30, 45, 60, 90, 120, 999)


def roll_schedule(calendar: DataFrame, days: int = 5, valid: DataFrame | None = None) -> DataFrame:
    """Roll date of each contract month: the anchor minus calendar days, moved
    back off weekends; only months in ``valid`` (product, contract_month)."""
    d = calendar
    if valid is not None:
        d = d.join(valid.select("product", "contract_month"), ["product", "contract_month"], "left_semi")
    anchor = F.coalesce("first_notice_date", "last_trade_date")
    raw = F.date_sub(anchor, days)
    wd = F.weekday(raw)
    back = F.when(wd == 5, 1).when(wd == 6, 2).otherwise(0)
    return d.select(
        "product",
        "contract_month",
        "last_trade_date",
        anchor.alias("anchor_date"),
        F.date_sub(raw, back).alias("roll_date"),
    )


def liquid_months(bars: DataFrame, min_total: float) -> DataFrame:
    """Contract months with enough volume over their life."""
    g = bars.groupBy("product", "contract_month").agg(F.sum("volume").alias("total_volume"))
    return g.where(F.col("total_volume") >= min_total)


def front_index(dates: DataFrame, schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schedule numbered in expiry order, and per date how many of its
    contracts have rolled. The schedule has one row per product and month."""
    w = Window.partitionBy("product").orderBy("last_trade_date", "contract_month")
    sched = schedule.where(F.col("roll_date").isNotNull())
    sched = sched.withColumn("seq", F.row_number().over(w) - 1)
    rolled = sched.groupBy("product", F.col("roll_date").alias("date")).agg(
        (F.max("seq") + 1).alias("_idx")
    )
    d = asof_join(dates, rolled, ["product"], "date", ["_idx"], span=512)
    return sched, d.withColumn("_idx", F.coalesce("_idx", F.lit(0)))


def continuous_curve(
    bars: DataFrame, schedule: DataFrame, legs: int = 3, extra: Sequence[str] = ()
) -> DataFrame:
    """Legs F1..Fn per date: close, days to expiry and month of each.

    ``bars``: product, date, contract_month, close. ``extra`` carries further
    columns of the front leg.
    """
    listed = bars.join(
        schedule.select("product", "contract_month"), ["product", "contract_month"], "left_semi"
    )
    sched, idx = front_index(listed.select("product", "date").distinct(), schedule)
    want = idx.withColumn("leg", F.explode(F.sequence(F.lit(1), F.lit(legs))))
    want = want.withColumn("seq", F.col("_idx") + F.col("leg") - 1)
    want = want.join(
        sched.select("product", "seq", "contract_month", "last_trade_date"), ["product", "seq"]
    )
    px = want.join(
        bars.select("product", "date", "contract_month", "close", *extra),
        ["product", "date", "contract_month"],
        "left",
    )
    aggs = []
    for k in range(1, legs + 1):
        hit = F.col("leg") == k
        dte = F.when(F.col("close").isNotNull(), F.datediff("last_trade_date", "date"))
        aggs += [
            F.max(F.when(hit, F.col("close"))).alias(f"close_f{k}"),
            F.max(F.when(hit, dte)).alias(f"dte_f{k}"),
            F.max(F.when(hit, F.col("contract_month"))).alias(f"contract_month_f{k}"),
        ]
    aggs += [F.max(F.when(F.col("leg") == 1, F.col(c))).alias(c) for c in extra]
    return px.groupBy("product", "date").agg(*aggs).where(F.col("contract_month_f1").isNotNull())


def return_conventions(curve: DataFrame, s: Ordered = PRODUCT) -> DataFrame:
    """Roll flag, unadjusted return (null at rolls), and additive and ratio
    adjusted closes with their returns. Offsets carry forward in time."""
    def marks(w):
        prev = F.lag("close_f1").over(w)
        roll = F.coalesce(
            F.col("contract_month_f1") != F.lag("contract_month_f1").over(w), F.lit(False)
        )
        both = roll & F.col("close_f1").isNotNull() & prev.isNotNull()
        q = F.when(both & (prev != 0), ratio(prev, "close_f1"))
        return {
            "is_roll": roll,
            "log_return_unadj": F.when(~roll, log_ratio("close_f1", prev)),
            "_gap": F.when(both, F.col("close_f1") - prev).otherwise(0.0),
            "_lq": F.coalesce(F.log(F.abs(q)), F.lit(0.0)),
            "_neg": F.when(q < 0, 1).otherwise(0),
        }

    d = rolling(curve, s, marks, back=1)
    d = running(
        d,
        s,
        {
            "_off": ("sum", F.col("_gap")),
            "_lr": ("sum", F.col("_lq")),
            "_flip": ("sum", F.col("_neg")),
        },
    )
    sign = F.when(F.col("_flip") % 2 == 1, -1.0).otherwise(1.0)
    d = d.withColumns(
        {
            "close_backadj": F.col("close_f1") - F.col("_off"),
            "close_ratioadj": F.col("close_f1") * F.exp("_lr") * sign,
        }
    )
    d = rolling(
        d,
        s,
        lambda w: {
            f"log_return_{k}": log_ratio(f"close_{k}", F.lag(f"close_{k}").over(w))
            for k in ("backadj", "ratioadj")
        },
        back=1,
    )
    return d.drop("_gap", "_lq", "_neg", "_off", "_lr", "_flip")


def continuous_ohlcv(bars: DataFrame, schedule: DataFrame, s: Ordered = PRODUCT) -> DataFrame:
    """Front leg with its open, high, low and volume, and back-adjusted prices."""
    c = continuous_curve(bars, schedule, 1, ("open", "high", "low", "volume"))
    d = return_conventions(c.where(F.col("close_f1").isNotNull()), s)
    off = F.col("close_f1") - F.col("close_backadj")
    return d.withColumns({f"{x}_backadj": F.col(x) - off for x in ("open", "high", "low")})


def front_by_ticker(bars: DataFrame) -> DataFrame:
    """Smallest well-formed ticker per date."""
    d = bars.where(F.col("ticker").rlike("^[A-Z]+[0-9]{6}$"))
    rest = [c for c in d.columns if c not in ("product", "date", "ticker")]
    best = F.min_by(F.struct(*rest), "ticker").alias("_b")
    g = d.groupBy("product", "date").agg(F.min("ticker").alias("ticker"), best)
    return g.select("product", "date", "ticker", "_b.*")


def curve_by_ticker(bars: DataFrame, legs: int = 3) -> DataFrame:
    """Legs by ticker order with days to month end; at least two legs.

    The contracts of one product and date are few, so the window is bounded.
    """
    d = bars.where(F.col("ticker").rlike("^[A-Z]+[0-9]{6}$"))
    w = Window.partitionBy("product", "date").orderBy("ticker")
    d = d.withColumn("_k", F.row_number().over(w))
    end = F.last_day(F.to_date(F.right("ticker", F.lit(6)), "yyyyMM"))
    d = d.withColumn("_dte", F.datediff(end, F.col("date")))
    aggs = []
    for k in range(1, legs + 1):
        aggs += [
            F.max(F.when(F.col("_k") == k, F.col("close"))).alias(f"close_f{k}"),
            F.max(F.when(F.col("_k") == k, F.col("_dte"))).alias(f"dte_f{k}"),
        ]
    g = d.groupBy("product", "date").agg(*aggs, F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") >= 2).drop("_n")


def roll_slope() -> Column:
    """Annualized log slope from F1 to F2."""
    gap = F.greatest(F.col("dte_f2") - F.col("dte_f1"), F.lit(1))
    return log_ratio("close_f2", "close_f1") / gap * 365.0


def slope_state(slope: Column, deadband: float = 0.0) -> Column:
    """backwardation, contango, flat inside the deadband, null on zero."""
    s = F.when(F.abs(slope) < deadband, "flat") if deadband else F.when(F.lit(False), "")
    return s.when(slope < 0, "backwardation").when(slope > 0, "contango")


def persistent_state(df: DataFrame, s: Ordered, state: str, n: int, out: str) -> DataFrame:
    """The state once it has held n rows in a row, else unconfirmed."""
    d = rolling(
        df,
        s,
        lambda w: {"_new": ~F.coalesce(F.col(state) == F.lag(state).over(w), F.lit(False))},
        back=1,
    )
    d = running(d, s, {"_len": ("sum", F.lit(1))}, reset=F.col("_new"))
    ok = F.col(state).isNotNull() & (F.col("_len") >= n)
    lab = F.when(ok, F.col(state)).otherwise("unconfirmed")
    return d.select(*df.columns, lab.alias(out))


def runs(df: DataFrame, s: Ordered, state: str) -> DataFrame:
    """One row per run of equal non-null states: state and length."""
    d = rolling(
        df.where(F.col(state).isNotNull()),
        s,
        lambda w: {
            "_new": ~F.coalesce(F.col(state) == F.lag(state).over(w), F.lit(False)),
            "_end": ~F.coalesce(F.col(state) == F.lead(state).over(w), F.lit(False)),
        },
        back=1,
        ahead=1,
    )
    d = running(d, s, {"length": ("sum", F.lit(1).cast("long"))}, reset=F.col("_new"))
    return d.where("_end").select(*s.keys, *s.order, F.col(state).alias("state"), "length")


def run_statistics(df: DataFrame, s: Ordered, state: str) -> DataFrame:
    return runs(df, s, state).groupBy(*s.keys, "state").agg(
        F.avg("length").alias("mean_run"), F.count(F.lit(1)).alias("n_runs")
    )


def transitions(df: DataFrame, s: Ordered, state: str) -> DataFrame:
    """Counts and row shares of state to next state, nulls removed first."""
    d = rolling(
        df.where(F.col(state).isNotNull()), s, lambda w: {"_to": F.lead(state).over(w)}, 0, 1
    )
    g = d.where(F.col("_to").isNotNull()).groupBy(*s.keys, F.col(state).alias("src"), F.col("_to").alias("dst"))
    g = g.agg(F.count(F.lit(1)).alias("n"))
    tot = g.groupBy(*s.keys, "src").agg(F.sum("n").alias("_t"))
    return g.join(tot, [*s.keys, "src"]).select(*s.keys, "src", "dst", "n", ratio("n", "_t").alias("share"))


def seasonal_state(product: Column, date: Column, windows: Mapping = SEASONAL_WINDOWS) -> Column:
    """Month label of a product, off_season outside, na without a calendar."""
    pairs = []
    for p, states in windows.items():
        for name, months in states.items():
            for m in months:
                pairs += [F.lit(f"{p}|{m}"), F.lit(name)]
    hit = F.try_element_at(F.create_map(*pairs), F.concat_ws("|", product, F.month(date)))
    known = product.isin(list(windows))
    return F.when(known, F.coalesce(hit, F.lit("off_season"))).otherwise("na")


def regime_atlas(df: DataFrame, state: str, slope: str) -> DataFrame:
    """State shares, slope statistics and the most extreme dates per product."""
    q = quantiles(
        df, ["product"], slope, {"slope_p10": 0.1, "slope_median": 0.5, "slope_p90": 0.9}
    )
    n = F.count(F.lit(1))
    key = F.struct(slope, "date")
    g = df.groupBy("product").agg(
        n.alias("n_obs"),
        F.count_if(F.col(state) == "backwardation").alias("n_backwardation"),
        F.count_if(F.col(state) == "contango").alias("n_contango"),
        (F.count_if(F.col(state) == "backwardation") / n).alias("frac_backwardation"),
        F.avg(slope).alias("slope_mean"),
        F.stddev_pop(slope).alias("slope_std"),
        F.max(F.when(F.col(slope).isNotNull(), key)).getField("date").alias("deepest_contango"),
        F.min(F.when(F.col(slope).isNotNull(), key)).getField("date").alias("deepest_backwardation"),
    )
    return g.join(q, "product")


def state_by_month(df: DataFrame, state: str, least: int = 5) -> DataFrame:
    d = df.where(F.col(state).isNotNull())
    g = d.groupBy("product", F.month("date").alias("month")).agg(
        F.avg((F.col(state) == "backwardation").cast("double")).alias("frac_backwardation"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.where(F.col("n") >= least)


def taxonomy(legs: str) -> Column:
    """calendar when all legs are one product, else inter_commodity."""
    return F.when(F.size(F.array_distinct(legs)) == 1, "calendar").otherwise("inter_commodity")


def vol_by_expiry(
    df: DataFrame, keys: Sequence[str], vol: str, dte: str, edges: Sequence[int] = DTE_EDGES
) -> DataFrame:
    """Mean volatility per fixed days-to-expiry bin with five rows or more."""
    lo = F.lit(None).cast("int")
    hi = lo
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        inside = (F.col(dte) >= a) & (F.col(dte) < b)
        lo, hi = F.when(inside, a).otherwise(lo), F.when(inside, b).otherwise(hi)
    d = df.where(F.col(vol).isNotNull()).withColumns({"dte_lo": lo, "dte_hi": hi})
    g = d.where(F.col("dte_lo").isNotNull()).groupBy(*keys, "dte_lo", "dte_hi")
    g = g.agg(F.avg(vol).alias("mean_vol"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= 5)


def calendar_stats(df: DataFrame, keys: Sequence[str], bucket: Column, ret: str) -> DataFrame:
    """Mean, population std and n of a return by month or weekday (n >= 5)."""
    g = df.where(F.col(ret).isNotNull()).groupBy(*keys, bucket)
    g = g.agg(
        F.avg(ret).alias("mean_return"), F.stddev_pop(ret).alias("vol"), F.count(F.lit(1)).alias("n")
    )
    return g.where(F.col("n") >= 5)


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int = 64) -> DataFrame:
    """Pairs of intervals that overlap. Both sides have (start, end) dates.

    Both are spread over the calendar buckets they touch and meet by equi join;
    a pair is kept in the first bucket they share, so it appears once.
    """
    def spread(df: DataFrame, tag: str) -> DataFrame:
        lo = F.floor(F.unix_date("start") / width)
        hi = F.floor(F.unix_date("end") / width)
        rest = [c for c in df.columns if c not in (*keys, "start", "end")]
        return df.select(
            *keys,
            F.col("start").alias(f"_s{tag}"),
            F.col("end").alias(f"_e{tag}"),
            lo.alias(f"_lo{tag}"),
            *rest,
            F.explode(F.sequence(lo, hi)).alias("_bucket"),
        )

    j = spread(a, "a").join(spread(b, "b"), [*keys, "_bucket"])
    first = F.col("_bucket") == F.greatest("_loa", "_lob")
    hit = (F.col("_sb") <= F.col("_ea")) & (F.col("_eb") >= F.col("_sa"))
    out = [c for c in (*a.columns, *b.columns) if c not in ("start", "end")]
    return j.where(first & hit).select(
        *dict.fromkeys(out), F.col("_sa").alias("a_start"), F.col("_sb").alias("b_start")
    )


def event_replay(
    returns: DataFrame, events: DataFrame, weights: DataFrame, ret: str
) -> DataFrame:
    """Weighted portfolio return over each event's window and its worst day.

    An event is spread to its days, which makes the range join an equi join.
    """
    days = events.select("name", "product", F.explode(F.sequence("start", "end")).alias("date"))
    d = returns.join(days, ["product", "date"]).join(weights, "product", "left")
    d = d.where(F.col(ret).isNotNull())
    day = d.groupBy("name", "date").agg(
        F.sum(F.col(ret) * F.coalesce("weight", F.lit(0.0))).alias("_p")
    )
    return day.groupBy("name").agg(
        F.sum("_p").alias("portfolio_pnl"), F.min("_p").alias("worst_day"), F.count("_p").alias("n_days")
    )


ANNUAL = math.sqrt(252.0)
