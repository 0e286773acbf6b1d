"""As-of joins and slow-series alignment (inventory 2.E)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ordered import CALENDAR, Ordered, quantiles, rolling, running

SIDE = "_side"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    span: float = 64,
    stamp: str | None = None,
) -> DataFrame:
    """Backward as-of join: the latest right row at or before each left row.

    Both sides are stacked and the last right row is carried forward, so a hot
    key is cut by time and no row is multiplied. ``stamp`` adds the time of the
    right row used. A null right value counts as that row's value.
    """
    payload = F.struct(*[F.col(c) for c in left.columns if c not in (*keys, time)])
    value = F.struct(F.col(time).alias("_t"), *cols)
    stacked = left.select(
        *keys, time, F.lit(1).alias(SIDE), payload.alias("_l"), F.lit(None).alias("_r")
    ).unionByName(
        right.select(*keys, time, F.lit(0).alias(SIDE), F.lit(None).alias("_l"), value.alias("_r"))
    )
    s = Ordered(tuple(keys), (time, SIDE), span)
    d = running(stacked, s, {"_hit": ("last", F.col("_r"))}).where(F.col(SIDE) == 1)
    extra = [F.col("_hit._t").alias(stamp)] if stamp else []
    back = [F.col(c) if c in (*keys, time) else F.col(f"_l.{c}") for c in left.columns]
    return d.select(*back, *[F.col(f"_hit.{c}").alias(c) for c in cols], *extra)


def align_to_target(
    target: DataFrame,
    source: DataFrame,
    value: str,
    lag_days: int | Column,
    max_age: int | None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Publication lag in business days, forward fill onto target dates, null
    when the source is older than ``max_age`` calendar days.

    Target and source share ``keys`` and ``date``; the last source row wins
    when two land on one public date.
    """
    lag = F.lit(lag_days) if isinstance(lag_days, int) else lag_days
    src = source.where(F.col(value).isNotNull())
    pub = _shift_business(src, "date", lag)
    one = pub.groupBy(*keys, "_pub").agg(F.max_by(value, "date").alias(value))
    one = one.withColumnRenamed("_pub", "date")
    d = asof_join(target, one, keys, "date", [value], span=512, stamp="_known")
    if max_age is not None:
        fresh = F.datediff("date", "_known") <= max_age
        d = d.withColumn(value, F.when(fresh, F.col(value)))
    return d.drop("_known")


def _shift_business(df: DataFrame, date: str, lag: Column) -> DataFrame:
    """Business days after a date; a weekend date first rolls to Monday."""
    wd = F.weekday(date)
    steps = F.when(wd >= 5, F.greatest(lag, F.lit(1))).otherwise(lag)
    pos = F.least(wd, F.lit(4)) + steps
    days = (F.floor(pos / 5) * 7 + pos % 5).cast("int")
    return df.withColumn("_pub", F.date_add(F.date_sub(F.col(date), wd), days))


def align_columns(
    target: DataFrame, wide: DataFrame, lags: Mapping[str, int], max_age: int | None
) -> DataFrame:
    """Each column with its own lag; a null never blocks an older value."""
    long = wide.select(
        "date",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in lags])
        ).alias("_r"),
    ).select("date", "_r.series", "_r.value")
    lag_map = F.create_map(*[x for c, n in lags.items() for x in (F.lit(c), F.lit(n))])
    grid = target.select(
        "date", F.explode(F.array(*[F.lit(c) for c in lags])).alias("series")
    )
    d = align_to_target(
        grid, long, "value", F.element_at(lag_map, F.col("series")), max_age, ["series"]
    )
    return d.groupBy("date").agg(
        *[F.max(F.when(F.col("series") == c, F.col("value"))).alias(c) for c in lags]
    )


def lagged_positioning(df: DataFrame, lag_days: int = 3) -> DataFrame:
    """Net non-commercial share of open interest and the date it becomes public."""
    net = F.col("noncomm_long") - F.col("noncomm_short")
    return df.select(
        "product",
        "report_date",
        F.date_add("report_date", lag_days).alias("public_date"),
        (net / F.greatest(F.col("open_interest_all"), F.lit(1.0))).alias("net_frac"),
    )


def positioning_by_state(
    curve: DataFrame, cot: DataFrame, state: str, slope: str, a: str, b: str
) -> DataFrame:
    """Daily curve with the last public report, per product: mean and std of
    the position in states a and b, Welch t of a against b, and the correlation
    of position and slope."""
    pub = cot.select("product", F.col("public_date").alias("date"), "net_frac")
    d = asof_join(curve, pub, ["product"], "date", ["net_frac"], span=512)
    d = d.where(F.col("net_frac").isNotNull() & F.col(state).isNotNull())

    def of(s: str, fn, out: str) -> Column:
        return fn(F.when(F.col(state) == s, F.col("net_frac"))).alias(out)

    g = d.groupBy("product").agg(
        *[
            of(s, fn, f"{n}_{t}")
            for s, t in ((a, "a"), (b, "b"))
            for fn, n in (
                (F.count, "n"),
                (F.avg, "mean"),
                (F.stddev_pop, "std"),
                (F.var_samp, "_var"),
            )
        ],
        F.corr(slope, "net_frac").alias("slope_corr"),
    )
    t = welch(*[F.col(f"{n}_{s}") for s in "ab" for n in ("mean", "_var", "n")])
    return g.withColumn("welch_t", t).drop("_var_a", "_var_b")


def welch(a_mean: Column, a_var: Column, a_n: Column, b_mean: Column, b_var: Column, b_n: Column):
    """Two-sample t with unequal variances."""
    return ratio(a_mean - b_mean, F.sqrt(a_var / a_n + b_var / b_n))


def lagged_labels(
    macro: DataFrame, dates: DataFrame, terciles: Mapping[str, str], sign: str, lag: int
) -> DataFrame:
    """Row-lagged series: tercile labels (33.3 and 66.7 percentiles of the whole
    sample) for some, the sign for one. A null lagged value takes the last label.

    ``terciles`` maps a column to the suffix of its labels.
    """
    cols = [*terciles, sign]
    d = rolling(
        macro,
        CALENDAR,
        lambda w: {f"_{c}": F.lag(c, lag).over(w) for c in cols},
        back=lag,
    )
    out = []
    for c, name in terciles.items():
        q = quantiles(d, [], f"_{c}", {f"_{c}1": 0.333, f"_{c}2": 0.667})
        d = d.crossJoin(F.broadcast(q))  # one row
        v = F.col(f"_{c}")
        lab = F.when(v < F.col(f"_{c}1"), f"low_{name}").when(v < F.col(f"_{c}2"), f"mid_{name}")
        out.append(lab.otherwise(f"high_{name}").alias(f"{name}_regime"))
    curve = F.when(F.col(f"_{sign}") < 0, "inverted").otherwise("normal")
    d = d.select("date", *out, curve.alias("yield_curve_regime"))
    return dates.join(d, "date", "left")


def fill_and_band(
    df: DataFrame, rates: DataFrame, keys: Sequence[str], storage: float, lo: float, hi: float
) -> DataFrame:
    """Left join a rate by date, carry it forward, and test whether the carry
    ratio of the spread lies inside (lo, hi)."""
    d = df.join(rates, "date", "left")
    d = running(d, CALENDAR.by(*keys), {"rate": ("last", F.col("rate"))})
    d = d.withColumn("carry_fv", carry_fair_value(F.col("leg2_price"), storage, F.col("rate")))
    d = d.withColumn("carry_ratio", carry_ratio(F.col("value"), F.col("carry_fv")))
    mild = (F.col("carry_ratio") > lo) & (F.col("carry_ratio") < hi)
    return d.withColumn("mild", F.coalesce(mild, F.lit(False)))


def carry_fair_value(leg2: Column, storage: float, rate: Column) -> Column:
    """-(storage + rate * price / 12): cost of carrying the second leg a month."""
    return -(F.lit(storage) + rate * leg2 / 12)


def carry_ratio(value: Column, full_carry: Column) -> Column:
    """-value / full carry, null where full carry is 0."""
    return -ratio(value, full_carry)
