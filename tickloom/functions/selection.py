"""Exact order statistics by counting: nothing is sorted, written or gathered.

Each pass counts the values of a key in equal steps between two bounds and keeps the step
that holds the wanted rank; the least and largest value seen in it are the next bounds.
Counts merge before the shuffle, so a pass moves at most ``STEPS`` rows per key and task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

STEPS = 4096


def select_rank(df: DataFrame, keys: Sequence[str], y: str, rank: Column, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """The value of ascending rank ``rank`` (from 1, may read the count ``n``) per key.

    Returns keys, ``n``, ``rank``, ``value``, ``below`` (rows of smaller value) and the
    columns of ``carry``, which may read ``n``. Null and NaN values are left out; keys whose
    rank lies outside 1..n are too. ``df`` should be a stored table: passes read it again.
    """
    keys = list(keys)
    d = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y))).select(*keys, F.col(y).cast("double").alias("_y"))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    more = list(carry or {})
    extra = [c.alias(k) for k, c in (carry or {}).items()]
    state = n.select(*keys, "n", rank.cast("long").alias("rank"), *extra, "_lo", "_hi", F.lit(0).cast("long").alias("below"))
    state = materialize(state.where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n"))))
    done = None
    while True:
        ready = state.where("_lo = _hi").select(*keys, "n", "rank", *more, F.col("_lo").alias("value"), "below")
        done = ready if done is None else done.unionByName(ready)
        todo = state.where("_lo < _hi")
        if not todo.take(1):
            return done
        # Halves keep the width finite where bounds lie far apart.
        share = (F.col("_y") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        step = F.when(F.col("_y") >= F.col("_hi"), STEPS - 1).otherwise(F.least(F.lit(STEPS - 2), F.floor(share * (STEPS - 1)).cast("int")))
        bounds = todo.select(*keys, "_lo", "_hi")
        seen = d.join(bounds, keys) if keys else d.crossJoin(F.broadcast(bounds))  # one row
        seen = seen.where(F.col("_y").between(F.col("_lo"), F.col("_hi")))
        counts = seen.groupBy(*keys, step.alias("_s")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_y").alias("_a"), F.max("_y").alias("_z")
        )
        upto = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)  # STEPS rows at most
        counts = counts.withColumn("_upto", F.sum("_c").over(upto))
        cur = todo.drop("_lo", "_hi")
        both = counts.join(cur, keys) if keys else counts.crossJoin(F.broadcast(cur))  # one row
        want = F.col("rank") - F.col("below")
        both = both.where((F.col("_upto") >= want) & (F.col("_upto") - F.col("_c") < want))
        below = (F.col("below") + F.col("_upto") - F.col("_c")).alias("below")
        state = materialize(both.select(*keys, "n", "rank", *more, F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), below))


def largest(df: DataFrame, keys: Sequence[str], y: str, k: int, order: int = -1) -> DataFrame:
    """The k largest values per key with their ``rank`` from 1 (``order=1``: the smallest).

    A value that a third of the rows share counts as one row until the ranks are given out,
    so no more than k rows of a key ever meet.
    """
    keys = list(keys)
    d = df.select(*keys, (F.col(y) * order * -1).alias("_y")).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    d = materialize(d)  # read by every pass
    least = F.greatest(F.col("n") - (k - 1), F.lit(1))
    cut = materialize(select_rank(d, keys, "_y", least).select(*keys, "n", F.col("value").alias("_u")))
    above = d.join(cut, keys) if keys else d.crossJoin(F.broadcast(cut))  # one row
    above = above.where(F.col("_y") >= F.col("_u")).groupBy(*keys, "n", "_y").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_y")).rowsBetween(Window.unboundedPreceding, 0)  # k values at most
    above = above.withColumn("_last", F.sum("_c").over(w)).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    ranks = F.explode(F.sequence("_first", F.least("_last", F.lit(k).cast("long"))))
    return above.where(F.col("_first") <= k).select(*keys, "n", ranks.alias("rank"), (F.col("_y") * order * -1).alias(y))
