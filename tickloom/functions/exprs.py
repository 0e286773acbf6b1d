"""Small column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_log(x: Column | str) -> Column:
    """Natural log, null unless the argument is positive."""
    return F.when(col(x) > 0, F.log(col(x)))


def log_ratio(a: Column | str, b: Column | str) -> Column:
    return safe_log(ratio(a, b))


def tick_key(ts: str, tie: str) -> Column:
    """(time, tie) as one decimal, so that min_by and max_by over it aggregate
    by hash; a struct key would force a sort of all ticks before the shuffle."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(17,0)")
    return micros * F.expr("10000000000000000000BD") + F.col(tie).cast("decimal(19,0)")


def clip(x: Column | str, lo: float, hi: float) -> Column:
    c = col(x)
    return F.when(c.isNull(), None).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def log_return(w: WindowSpec, c: Column | str = "close", h: int = 1) -> Column:
    return log_ratio(c, F.lag(col(c), h).over(w))


def forward_return(w: WindowSpec, c: Column | str = "close", h: int = 1) -> Column:
    return log_ratio(F.lead(col(c), h).over(w), c)


def roll(
    fn, c: Column | str, w: WindowSpec, n: int, min_obs: int | None = None, shift: int = 0
) -> Column:
    """``fn`` over the last ``n`` rows (``shift`` = 1 leaves out the current
    one); null until ``min_obs`` (default all n) values are present."""
    f = w.rowsBetween(-(n - 1) - shift, -shift)
    need = n if min_obs is None else min_obs
    return F.when(F.count(col(c)).over(f) >= need, fn(col(c)).over(f))


def roll_mean(c, w, n, min_obs=None, shift=0):
    return roll(F.avg, c, w, n, min_obs, shift)


def roll_std(c, w, n, min_obs=None, shift=0):
    return roll(F.stddev_samp, c, w, n, min_obs, shift)


def roll_sum(c, w, n, min_obs=None, shift=0):
    return roll(F.sum, c, w, n, min_obs, shift)


def roll_median(c, w, n, min_obs=None, shift=0):
    return roll(lambda x: F.percentile(x, 0.5), c, w, n, min_obs, shift)


def zscore(c: Column | str, w: WindowSpec, n: int) -> Column:
    """(x - mean) / sample std over the last n rows, the current one included."""
    return ratio(col(c) - roll_mean(c, w, n), roll_std(c, w, n))


def mean_ignoring_nulls(*cols: Column | str) -> Column:
    """Row-wise mean of the non-null arguments."""
    vals = F.filter(F.array(*[col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.aggregate(
        vals, F.lit(0.0), lambda acc, x: acc + x, lambda acc: F.try_divide(acc, F.size(vals))
    )
