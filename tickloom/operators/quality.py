"""Data quality and reconciliation (inventory 2.G)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.ordered import BARS, Ordered, quantiles, rolling, running


def flag_contaminated(
    df: DataFrame,
    deviation: float = 0.3,
    volume: float = 50_000,
    junk_share: float = 0.5,
    min_days: int = 10,
) -> DataFrame:
    """Mark rows of junk contracts and thin one-off glitches.

    The anchor of a (product, date) is the close of its highest-volume contract.
    """
    anchor = df.groupBy("product", "date").agg(
        F.max_by("close", F.struct("volume", -F.col("contract_id"))).alias("_anchor")
    )
    d = df.join(anchor, ["product", "date"])
    dev = F.abs(F.col("close") - F.col("_anchor")) / F.greatest(F.abs("_anchor"), F.lit(1e-9))
    d = d.withColumn("_bad", dev > deviation)
    stats = d.groupBy("product", "contract_id").agg(
        F.avg(F.col("_bad").cast("double")).alias("_share"), F.count(F.lit(1)).alias("_days")
    )
    d = d.join(stats, ["product", "contract_id"])
    junk = (F.col("_days") >= min_days) & (F.col("_share") > junk_share)
    glitch = F.col("_bad") & (F.col("volume") < volume)
    return d.select(*df.columns, (junk | glitch).alias("contaminated"))


def hygiene_filter(df: DataFrame, **kw) -> DataFrame:
    return flag_contaminated(df, **kw).where(~F.col("contaminated")).drop("contaminated")


def liquidity_screen(df: DataFrame, min_volume: float = 50, min_active: int = 2) -> DataFrame:
    """Volume floor, then dates with enough surviving contracts."""
    d = df.where(F.col("volume") >= min_volume)
    n = d.groupBy("product", "date").agg(F.count(F.lit(1)).alias("_n"))
    n = n.where(F.col("_n") >= min_active).select("product", "date")
    return d.join(n, ["product", "date"], "left_semi")


def hygiene_stats(df: DataFrame, min_volume: float, min_active: int, **kw) -> DataFrame:
    """Raw, flagged and surviving counts per product."""
    f = flag_contaminated(df, **kw)
    raw = f.groupBy("product").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if("contaminated").alias("n_flagged")
    )
    left = liquidity_screen(f.where(~F.col("contaminated")), min_volume, min_active)
    left = left.groupBy("product").agg(F.count(F.lit(1)).alias("n_liquid"))
    d = raw.join(left, "product", "left").na.fill(0, ["n_liquid"])
    clean = F.col("n_raw") - F.col("n_flagged")
    return d.select(
        "*",
        ratio("n_flagged", "n_raw").alias("pct_flagged"),
        (1 - ratio("n_liquid", clean)).alias("pct_dropped"),
    )


def front_tail_stats(df: DataFrame, s: Ordered) -> DataFrame:
    """Max-volume close per date, log |close| returns, their kurtosis and vol."""
    front = df.groupBy("product", "date").agg(
        F.max_by("close", F.struct("volume", -F.col("contract_id"))).alias("close")
    )
    lv = F.log(F.abs("close") + 1e-12)
    d = rolling(front, s, lambda w: {"_r": lv - F.lag(lv).over(w)}, back=1)
    g = d.groupBy("product").agg(
        F.kurtosis("_r").alias("excess_kurtosis"),
        (F.stddev_pop("_r") * math.sqrt(252.0)).alias("ann_vol"),
        F.count("_r").alias("n"),
    )
    return g.where(F.col("n") >= 30)


def code_counts(df: DataFrame, code: str, aliases: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(code) == a).alias(f"n_{a}") for a in aliases])


def mean_by_code(df: DataFrame, code: str, value: str, names: dict[str, str]) -> DataFrame:
    """Group mean and count by a coded column, with the code's name."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    g = df.groupBy(code).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.withColumn("name", F.coalesce(F.try_element_at(m, F.col(code)), F.lit("other")))


def stale_runs(df: DataFrame, s: Ordered, c: str = "close") -> DataFrame:
    """Runs of identical values: how many, the longest, and the stale rows."""
    d = rolling(
        df,
        s,
        lambda w: {
            "_new": ~F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False)),
            "_end": ~F.coalesce(F.col(c) == F.lead(c).over(w), F.lit(False)),
        },
        back=1,
        ahead=1,
    )
    d = running(d, s, {"_len": ("sum", F.lit(1).cast("long"))}, reset=F.col("_new"))
    run = F.col("_end") & (F.col("_len") >= 2)
    return d.groupBy(*s.keys).agg(
        F.count_if(run).alias("n_runs"),
        F.coalesce(F.max(F.when(run, F.col("_len"))), F.lit(0)).alias("max_run"),
        F.coalesce(F.sum(F.when(run, F.col("_len") - 1)), F.lit(0)).alias("n_stale"),
    )


def reconcile(
    built: DataFrame, ref: DataFrame, keys: Sequence[str], c: str, within: Callable, need: float
) -> DataFrame:
    """Share of common rows that agree. ``within(a, b)`` is the row test."""
    d = built.select(*keys, "date", F.col(c).alias("_a")).join(
        ref.select(*keys, "date", F.col(c).alias("_b")), [*keys, "date"]
    )
    d = d.dropna(subset=["_a", "_b"])
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_overlap"),
        F.avg(within(F.col("_a"), F.col("_b")).cast("double")).alias("pct_within"),
    )
    return g.withColumn("passed", F.coalesce(F.col("pct_within") >= need, F.lit(False)))


def within_tick(tick: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.abs(a - b) <= tick + 1e-9


def within_share(tolerance: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) <= tolerance


def reconcile_returns(built: DataFrame, proxy: DataFrame, keys: Sequence[str], c: str = "ret"):
    """Correlation of the common rows, one per date, n >= 30, pass above 0.98."""
    a = built.groupBy(*keys, "date").agg(F.max(c).alias("_a"))
    b = proxy.groupBy(*keys, "date").agg(F.max(c).alias("_b"))
    d = a.join(b, [*keys, "date"]).dropna(subset=["_a", "_b"])
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_overlap"), F.corr("_a", "_b").alias("_rho")
    )
    rho = F.when(F.col("n_overlap") >= 30, F.col("_rho"))
    return g.select(
        *keys, "n_overlap", rho.alias("corr"), F.coalesce(rho > 0.98, F.lit(False)).alias("passed")
    )


def complete_symbols(panel: DataFrame, share: float = 0.98) -> DataFrame:
    """Rows of the symbols present on enough of the distinct timestamps."""
    total = panel.agg(F.floor(F.countDistinct("datetime") * F.lit(share)).alias("_need"))
    n = panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    keep = n.crossJoin(F.broadcast(total)).where(F.col("_n") >= F.col("_need"))  # one row
    return panel.join(keep.select("symbol"), "symbol", "left_semi")


def truncation_changes(
    df: DataFrame,
    feature: Callable[[DataFrame], DataFrame],
    cols: Sequence[str],
    cuts: Sequence[int],
    s: Ordered,
    digits: int = 9,
) -> DataFrame:
    """Per cut, rows whose features change when the last rows of each series
    are left out: 0 for a causal operator."""
    def keyed(d: DataFrame) -> DataFrame:
        return d.select(*s.keys, *s.order, *[F.round(c, digits).alias(c) for c in cols])

    back = running(df, s, {"_i": ("sum", F.lit(1).cast("long"))})
    n = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    back = back.join(n, list(s.keys)).withColumn("_left", F.col("_n") - F.col("_i"))
    whole = keyed(feature(df))
    parts = []
    for k in cuts:
        short = back.where(F.col("_left") >= k).select(*df.columns)
        diff = keyed(feature(short)).exceptAll(whole)
        parts.append(
            diff.agg(F.count(F.lit(1)).alias("n_changed")).select(
                F.lit(k).alias("truncation"), "n_changed"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gaps(bars: DataFrame, interval: str, s: Ordered = BARS) -> DataFrame:
    """Missing bars of each symbol between its first and last stamp."""
    t = s.order[0]
    ends = bars.groupBy(*s.keys).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    want = ends.select(
        *s.keys, F.explode(F.sequence("_a", "_z", F.expr(f"interval {interval}"))).alias(t)
    )
    return want.join(bars.select(*s.keys, t), [*s.keys, t], "left_anti")


def gap_summary(bars: DataFrame, interval: str, s: Ordered = BARS) -> DataFrame:
    miss = gaps(bars, interval, s).groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n_missing"))
    have = bars.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n_bars"))
    d = have.join(miss, list(s.keys), "left").na.fill(0, ["n_missing"])
    return d.withColumn(
        "share_missing", ratio("n_missing", F.col("n_missing") + F.col("n_bars"))
    )


def feed_differences(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Per column: largest absolute, median and largest relative difference of
    the common rows; and the rows found on one side only."""
    d = a.select(*keys, *cols).join(
        b.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols]), list(keys)
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("field"),
                    F.abs(F.col(c) - F.col(f"_{c}")).alias("diff"),
                    ratio(F.abs(F.col(c) - F.col(f"_{c}")), F.abs(F.col(f"_{c}"))).alias("rel"),
                )
                for c in cols
            ]
        )
    )
    long = d.select(cells.alias("_c")).select("_c.*")
    g = long.groupBy("field").agg(
        F.max("diff").alias("max_abs_diff"), F.max("rel").alias("max_rel_diff"),
        F.count(F.lit(1)).alias("n"),
    ).join(quantiles(long, ["field"], "rel", {"median_rel_diff": 0.5}), "field")
    only = (
        a.select(*keys)
        .join(b.select(*keys), list(keys), "left_anti")
        .withColumn("side", F.lit("a"))
        .unionByName(
            b.select(*keys).join(a.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("b"))
        )
    )
    return g, only


def input_overlap(indicators: DataFrame, targets: DataFrame) -> DataFrame:
    """Shared inputs of every (indicator set, target) pair.

    ``indicators``: dimension, indicator, weight, input; ``targets``: target,
    input. Overlap disqualifies; the weight of the touching indicators is given.
    """
    hit = indicators.join(targets, "input")
    inputs = hit.groupBy("dimension", "target").agg(
        F.sort_array(F.collect_set("input")).alias("intersection")
    )
    touching = hit.select("dimension", "target", "indicator", "weight").distinct()
    weight = touching.groupBy("dimension", "target").agg(F.sum("weight").alias("overlap_weight"))
    return inputs.join(weight, ["dimension", "target"]).withColumn("disqualified", F.lit(True))


