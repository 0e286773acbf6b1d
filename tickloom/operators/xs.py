"""Cross-sections, ranks and portfolio weights (inventory 2.C end and 2.D).

Statistics of a cross-section are aggregated first (partial sums before the
shuffle) and joined back, and ranks go through value cells, so one timestamp
may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, ratio, roll_median, roll_std, zscore
from ..functions.ordered import (
    BARS,
    CHUNK_ROWS,
    Ordered,
    average_rank,
    quantiles,
    rolling,
    row_index,
    row_numbers,
    running,
    state_scan,
)
from ..session import materialize


def cross_section(df: DataFrame, cols: Sequence[str], time: str = "datetime") -> DataFrame:
    """<c>_cs_demean and <c>_cs_z for each column over its timestamp."""
    stats = df.groupBy(time).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols],
    )
    d = df.join(stats, time)
    out = []
    for c in cols:
        dev = F.col(c) - F.col(f"_m_{c}")
        out += [dev.alias(f"{c}_cs_demean"), ratio(dev, f"_s_{c}").alias(f"{c}_cs_z")]
    return d.select(*df.columns, *out)


def percent_rank_by(df: DataFrame, keys: Sequence[str], c: str, out: str) -> DataFrame:
    """Average rank divided by the number of non-null values of the group."""
    d = average_rank(df, keys, c, "_rank")
    n = df.groupBy(*keys).agg(F.count(c).alias("_cnt"))
    return d.join(n, list(keys)).select(*df.columns, ratio("_rank", "_cnt").alias(out))


def _legs(
    d: DataFrame,
    time: str,
    long: Column,
    short: Column,
    size: Column,
    gross: float,
    cap: float,
    names: int | None,
) -> DataFrame:
    """Leg weights proportional to size, each leg summing to half the gross."""
    d = d.withColumn("_size", F.abs(size)).withColumn("_long", long).withColumn("_short", short)
    sums = {
        "_ls": F.sum(F.when(F.col("_long"), F.col("_size"))),
        "_ss": F.sum(F.when(F.col("_short"), F.col("_size"))),
    }
    if names is not None and names <= CHUNK_ROWS:
        group = Window.partitionBy(time)
        d = d.withColumns({n: c.over(group) for n, c in sums.items()})
    else:
        d = materialize(d)
        d = d.join(d.groupBy(time).agg(*[c.alias(n) for n, c in sums.items()]), time)
    w = (
        F.when(F.col("_short") & (F.col("_ss") > 0), -(gross / 2) * F.col("_size") / F.col("_ss"))
        .when(F.col("_long") & (F.col("_ls") > 0), (gross / 2) * F.col("_size") / F.col("_ls"))
        .otherwise(0.0)
    )
    return d.withColumn("weight", clip(w, -cap, cap))


def ranked(
    df: DataFrame, pred: str, keys: Sequence[str], names: int | None = None
) -> DataFrame:
    """Ascending position ``_rn`` by prediction then symbol, and group size ``_n``."""
    return row_numbers(df, keys, pred, ["symbol"], "_rn", "_n", names=names)


def dollar_neutral_weights(
    panel: DataFrame,
    pred: str,
    top_frac: float = 0.2,
    size: str | None = None,
    gross: float = 1.0,
    cap: float = 0.25,
    keys: Sequence[str] = ("datetime",),
    keep: Sequence[str] = (),
    names: int | None = None,
) -> DataFrame:
    """Top fraction long, bottom fraction short, the rest zero, per bar.

    ``names`` states the greatest number of symbols a bar can have, if known.
    """
    need = [*keys, "symbol", pred] + ([size] if size else [])
    d = panel.select(*dict.fromkeys([*need, *keep])).dropna(subset=need)
    d = ranked(d, pred, keys, names)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(top_frac)))
    d = d.withColumn("_k", k)
    if len(keys) > 1:
        d = d.withColumn("_bar", F.struct(*keys))
    time = "_bar" if len(keys) > 1 else keys[0]
    d = _legs(
        d,
        time,
        F.col("_rn") > F.col("_n") - F.col("_k"),
        F.col("_rn") <= F.col("_k"),
        F.col(size) if size else F.lit(1.0),
        gross,
        cap,
        names,
    )
    return d.select(*keys, "symbol", *keep, "weight")


def banded_weights(
    panel: DataFrame,
    pred: str,
    band: float,
    top_frac: float = 0.2,
    size: str | None = None,
    gross: float = 1.0,
    cap: float = 0.25,
    s: Ordered = BARS,
    names: int | None = None,
) -> DataFrame:
    """Enter a leg inside the entry zone, leave it outside the wider keep zone.

    States: 0 none, 1 long, 2 short. A bar without the symbol clears its state.
    """
    need = ["datetime", "symbol", pred] + ([size] if size else [])
    d = ranked(panel.select(*need).dropna(), pred, ["datetime"], names)
    ke = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(top_frac)))
    kx = F.greatest(ke, F.floor(F.col("_n") * F.lit(top_frac + band)))
    rn, n = F.col("_rn"), F.col("_n")
    long_in, short_in = rn > n - ke, rn <= ke
    long_keep, short_keep = rn > n - kx, rn <= kx
    bars = row_index(panel.select("datetime").distinct(), s.by(), "_bar")
    d = d.join(bars, "datetime")
    d = rolling(d, s, lambda w: {"_gap": F.col("_bar") - F.lag("_bar").over(w) > 1}, back=1)
    fresh = F.when(long_in, 1).when(short_in, 2).otherwise(0)
    from_long = F.when(long_keep, 1).when(short_in, 2).otherwise(0)
    from_short = F.when(short_keep, 2).when(long_in, 1).otherwise(0)
    gap = F.coalesce("_gap", F.lit(False))
    step = F.array(
        fresh, F.when(gap, fresh).otherwise(from_long), F.when(gap, fresh).otherwise(from_short)
    )
    d = state_scan(d, s, step, "_leg")
    d = _legs(
        d,
        "datetime",
        F.col("_leg") == 1,
        F.col("_leg") == 2,
        F.col(size) if size else F.lit(1.0),
        gross,
        cap,
        names,
    )
    return d.select("datetime", "symbol", "weight")


def quantize(weights: DataFrame, grid: float) -> DataFrame:
    """Weights rounded to the nearest multiple of the grid."""
    return weights.withColumn("weight", F.round(F.col("weight") / grid) * grid)


def throttle(weights: DataFrame, k: int, s: Ordered = BARS) -> DataFrame:
    """Rebalance on every k-th distinct time, hold between, zero before."""
    bars = row_index(weights.select("datetime").distinct(), s.by(), "_bar")
    d = weights.join(bars, "datetime")
    now = F.when((F.col("_bar") - 1) % k == 0, F.col("weight"))
    d = running(d, s, {"_held": ("last", now)})
    return d.withColumn("weight", F.coalesce("_held", F.lit(0.0))).select(*weights.columns)


def book_standdown(
    var: DataFrame, k: float, window: int = 250, col: str = "var_forecast", s: Ordered = BARS
) -> DataFrame:
    """Book scale 0 when the median |VaR| exceeds k times its trailing median."""
    m = quantiles(
        var.select("datetime", F.abs(col).alias("_v")), ["datetime"], "_v", {"_med": 0.5}
    )
    d = rolling(
        m,
        s.by(),
        lambda w: {"_ref": roll_median("_med", w, window, window // 2, shift=1)},
        back=window,
    )
    off = F.col("_ref").isNotNull() & (F.col("_med") > k * F.col("_ref"))
    return d.select("datetime", F.when(off, 0.0).otherwise(1.0).alias("book_scale"))


def overlay_weight(var: DataFrame, window: int = 250, col: str = "var_forecast", s: Ordered = BARS):
    """clip(trailing median |VaR| / |VaR|, 0, 1) per series."""
    d = rolling(
        var.withColumn("_v", F.abs(col)),
        s,
        lambda w: {"_ref": roll_median("_v", w, window, window // 2, shift=1)},
        back=window,
    )
    return d.select(*s.keys, *s.order, clip(ratio("_ref", "_v"), 0.0, 1.0).alias("tilt"))


def apply_book_scale(weights: DataFrame, scale: DataFrame) -> DataFrame:
    d = weights.join(scale, "datetime", "left")
    return d.withColumn(
        "weight", F.col("weight") * F.coalesce("book_scale", F.lit(1.0))
    ).select(*weights.columns)


def apply_tilt(panel: DataFrame, tilt: DataFrame) -> DataFrame:
    d = panel.join(tilt, ["datetime", "symbol"], "left")
    return d.withColumn("tilt", F.coalesce("tilt", F.lit(1.0)))


def quality_liquidity(
    df: DataFrame, sharpe: str, volume: str, long_min: float, short_min: float, frac: float
) -> DataFrame:
    """Per-leg eligibility: a Sharpe threshold and a liquidity rank share."""
    d = df.where(F.col(volume).isNotNull()).withColumn("_neg", -F.col(volume))
    d = average_rank(d, ["datetime"], "_neg", "_rank")
    n = d.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, "datetime")
    liquid = (F.col("_rank") / F.col("_n") <= frac) & F.col(sharpe).isNotNull()
    return d.select(
        *df.columns,
        (liquid & (F.col(sharpe) >= long_min)).alias("long_ok"),
        (liquid & (F.col(sharpe) <= -short_min)).alias("short_ok"),
    )


def cap_eligibility(
    df: DataFrame, cap: str, k_long: int, k_short: int, names: int | None = None
) -> DataFrame:
    """Top k_long and bottom k_short names by positive cap, per bar."""
    d = df.where(F.col(cap) > 0)
    up = row_numbers(d, ["datetime"], cap, ["symbol"], "_asc", "_n", names=names)
    d = up.withColumn("_desc", F.col("_n") - F.col("_asc") + 1)
    e = d.select(
        "datetime",
        "symbol",
        (F.col("_desc") <= k_long).alias("long_ok"),
        (F.col("_asc") <= k_short).alias("short_ok"),
    )
    return df.join(e, ["datetime", "symbol"], "left").na.fill(False, ["long_ok", "short_ok"])


def book_returns(
    sim: DataFrame, long_frac: float, short_frac: float, cost: float, s: Ordered = BARS
) -> DataFrame:
    """Equal-weight return per leg at its capital share, and net of turnover.

    ``sim``: datetime, symbol, leg_position (signed), ret, funding_cost.
    """
    first = rolling(
        sim.select("datetime", "symbol", "leg_position", "ret", "funding_cost"),
        s,
        lambda w: {
            "_d": F.abs(
                F.col("leg_position") - F.coalesce(F.lag("leg_position").over(w), F.lit(0.0))
            )
        },
        back=1,
    )
    up, down = F.col("leg_position") > 0, F.col("leg_position") < 0
    g = first.groupBy("datetime").agg(
        F.avg(F.when(up, F.col("ret") + F.col("funding_cost"))).alias("_l"),
        F.avg(F.when(down, -F.col("ret") + F.col("funding_cost"))).alias("_s"),
        F.sum("_d").alias("_turn"),
    )
    n = sim.agg(F.countDistinct("symbol").alias("_n"))
    g = g.crossJoin(F.broadcast(n))  # one row
    long = F.coalesce(F.col("_l") * long_frac, F.lit(0.0))
    short = F.coalesce(F.col("_s") * short_frac, F.lit(0.0))
    turn = F.col("_turn") / F.col("_n")
    return g.select(
        "datetime",
        long.alias("long_ret"),
        short.alias("short_ret"),
        turn.alias("turnover"),
        (long + short).alias("trade_log_return"),
        (long + short - cost * turn).alias("trade_log_return_net"),
    )


def spread_returns(
    spreads: DataFrame,
    point_values: Mapping[str, Sequence[float]],
    cost: float,
    window: int = 60,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Position -clip(z)/2 on a spread, next-row P&L over its capital basis.

    ``point_values`` holds the value of a point per leg. ``gate`` has (spread,
    date, regime): rows flat, unconfirmed or missing hold no position.
    """
    s = Ordered(("spread",), ("date",), step=1)
    pv = F.create_map(
        *[
            x
            for k, v in point_values.items()
            for x in (F.lit(k), F.array(*[F.lit(float(q)) for q in v]))
        ]
    )
    d = spreads.where(~F.col("roll_window_flag")).withColumn("_pv", F.try_element_at(pv, F.col("spread")))
    basis = F.aggregate(
        F.zip_with("leg_prices", "_pv", lambda p, v: F.abs(p) * v),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    d = d.withColumn("_basis", basis)
    pos = -clip(F.col("_z"), -2.0, 2.0) / 2
    if gate is not None:
        d = d.join(gate, ["spread", "date"], "left")
        shut = F.col("regime").isNull() | F.col("regime").isin("flat", "unconfirmed")
        pos = F.when(shut, 0.0).otherwise(pos)

    def pnl(w):
        prev = F.coalesce(F.lag("position").over(w), F.lit(0.0))
        move = F.col("value") - F.lag("value").over(w)
        return {
            "gross_return": ratio(prev * move * F.element_at("_pv", 1), "_basis"),
            "cost_frac": ratio(F.abs(F.col("position") - prev) * cost, "_basis"),
        }

    d = rolling(
        d,
        s,
        [
            lambda w: {"_z": zscore("value", w, window)},
            lambda w: {"position": F.coalesce(pos, F.lit(0.0))},
            pnl,
        ],
        back=window + 1,
    )
    net = F.col("gross_return") - F.col("cost_frac")
    d = d.select("spread", "date", "position", "gross_return", "cost_frac", net.alias("net_return"))
    return d.where(F.col("net_return").isNotNull())


def equal_weight_book(rets: DataFrame, skip: int = 0, col: str = "net_return") -> DataFrame:
    """Mean over the spreads present on each date, after dropping the first rows."""
    d = row_index(rets, Ordered(("spread",), ("date",), step=1), "_i").where(F.col("_i") > skip)
    return d.groupBy("date").agg(F.avg(col).alias("book_return"))


def fractional_kelly(edge: Column, vol: Column, fraction: float = 0.25) -> Column:
    raw = F.when(vol > 1e-12, fraction * edge / (vol * vol))
    return F.coalesce(clip(raw, -1.0, 1.0), F.lit(0.0))


def sqrt_impact_discount(notional: Column, adv: Column, c: float = 0.1) -> Column:
    """1 / (1 + c * sqrt(|notional| / ADV)); 0 when nothing trades."""
    return F.when(adv > 1e-12, 1.0 / (1.0 + c * F.sqrt(F.abs(notional) / adv))).otherwise(0.0)


def vol_targeted_size(pred: Column, vol: Column, target: float) -> Column:
    return clip(pred, -1.0, 1.0) * ratio(F.lit(target), vol)


def inverse_vol(c: str, w, n: int) -> Column:
    sd = roll_std(c, w, n)
    return F.when(sd.isNotNull(), 1.0 / F.greatest(sd, F.lit(1e-6)))
