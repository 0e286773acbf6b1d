"""Order statistics of all earlier values of a series of any length.

Values are cut into buckets of about ``chunk`` by rank, positions into spans of ``chunk``.
Counts per span and bucket, summed over the spans before, tell in which bucket the wanted
rank lies and which of the bucket's values it is; a second pass answers that inside the
bucket. Both passes work on at most a few times ``chunk`` rows at a time, whatever the
series, its ties or its drift, and each answers its rows together (see ``wavelet``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordered import CHUNK_ROWS, Ordered, running, value_ranks
from .wavelet import Wavelet


def _locate(values: pd.DataFrame, base: pd.DataFrame, p: float) -> pd.DataFrame:
    """For each position of a span: the buckets of the two ranks around quantile ``p`` of the
    values before it, and the ranks inside them."""
    buckets = base["_b"].to_numpy()
    before = np.concatenate([[0], np.cumsum(base["_before"].to_numpy(np.int64))])
    m = values["_m"].to_numpy(np.int64)
    local = np.searchsorted(buckets, values["_b"].to_numpy()[values["_real"].to_numpy(bool)])
    w, hi = Wavelet(local), np.minimum(np.arange(len(m)), len(local))
    zero = np.zeros(len(m), np.int64)
    out = {"_m": m}
    at = p * (m - 1)
    for side, k in (("lo", np.floor(at)), ("hi", np.ceil(at))):
        k = np.maximum(k, 0).astype(np.int64)
        low, high = zero.copy(), np.full(len(m), len(buckets) - 1)
        while (low < high).any():
            mid = (low + high) // 2
            upto = before[mid + 1] + w.count(zero, hi, mid + 1)[0]
            low, high = np.where(upto > k, low, np.minimum(mid + 1, high)), np.where(upto > k, mid, high)
        out[f"_b_{side}"] = buckets[low]
        out[f"_k_{side}"] = k - before[low] - w.count(zero, hi, low)[0]
    return pd.DataFrame(out)


def _answer(wanted: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """The k-th smallest of a bucket's values at positions before m."""
    pos, x = values["_pos"].to_numpy(), values["_x"].to_numpy()
    known, code = np.unique(x, return_inverse=True)
    upto = np.searchsorted(pos, wanted["_m"].to_numpy())
    got = Wavelet(code).kth(np.zeros(len(upto), np.int64), upto, wanted["_k"].to_numpy(np.int64))
    return pd.DataFrame({"_m": wanted["_m"], "_side": wanted["_side"], "_v": known[got]})


def expanding_quantile(
    df: DataFrame, s: Ordered, x: str, out: str, p: float = 0.5, least: int = 1, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Interpolated quantile of the strictly earlier known values, carried over gaps; null
    before ``least`` of them. Null and NaN values count as unknown."""
    keys = list(s.keys)
    val = F.col(x).cast("double")
    known = val.isNotNull() & ~F.isnan(val)
    d = running(df, s, {"_m": ("sum", F.when(known, 1).otherwise(0).cast("long"))})
    d = materialize(d.withColumn("_m", F.col("_m") - F.when(known, 1).otherwise(0)))
    v = d.where(known).select(*keys, F.col("_m").alias("_pos"), (val + F.lit(0.0)).alias("_x"))
    ranks = value_ranks(v.select(*keys, "_x"), keys, "_x")
    start = F.col("_cum") - F.col("_n")
    heavy = F.when(F.col("_n") >= chunk, 1).otherwise(0)  # a value that fills a bucket alone
    ranks = materialize(ranks.withColumn("_b", (2 * F.floor(start / chunk) + heavy).cast("long")))
    span = F.floor(F.col("_pos") / chunk).cast("long").alias("_t")
    v = materialize(v.join(ranks.select(*keys, "_x", "_b"), [*keys, "_x"]).select(*keys, "_pos", "_x", "_b", span))

    # Counts of each bucket before each span, for every pair of a key's spans and buckets.
    cells = materialize(v.groupBy(*keys, "_t", "_b").agg(F.count(F.lit(1)).alias("_n")))
    total = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    spans = total.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_m") / chunk))).alias("_t"))
    some = cells.select(*keys, "_b").distinct()
    grid = spans.join(some, keys) if keys else spans.crossJoin(some)  # spans x buckets of one series
    w = Window.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    base = grid.join(cells, [*keys, "_t", "_b"], "left")
    base = base.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    base = base.select(*[F.col(c).alias(c) for c in (*keys, "_t", "_b", "_before")])  # columns of its own

    # One question per number of earlier values: at each known value, and after the last.
    ask = v.select(*keys, "_t", F.col("_pos").alias("_m"), "_b", F.lit(True).alias("_real"))
    after = total.select(*keys, F.floor(F.col("_m") / chunk).cast("long").alias("_t"), "_m", F.lit(-1).cast("long").alias("_b"), F.lit(False).alias("_real"))
    kinds = [f for f in v.schema.fields if f.name in keys]
    by = [*keys, "_t"]

    def keyed(names: list[str], made: pd.DataFrame, key: tuple) -> pd.DataFrame:
        for n, k in zip(names, key, strict=False):
            made[n] = k
        return made

    def locate(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("_m", kind="stable")
        made = _locate(a, b.sort_values("_b"), p) if len(a) and len(b) else pd.DataFrame(columns=["_m", "_b_lo", "_k_lo", "_b_hi", "_k_hi"])
        return keyed(keys, made, key)[[*keys, "_m", "_b_lo", "_k_lo", "_b_hi", "_k_hi"]]

    found = T.StructType(kinds + T._parse_datatype_string("_m long, _b_lo long, _k_lo long, _b_hi long, _k_hi long").fields)
    where = ask.unionByName(after).groupBy(*by).cogroup(base.groupBy(*by)).applyInPandas(locate, found)
    sides = F.array(*[F.struct(F.lit(n).alias("_side"), F.col(f"_b_{n}").alias("_b"), F.col(f"_k_{n}").alias("_k")) for n in ("lo", "hi")])
    need = where.where(F.col("_m") >= max(least, 1)).select(*keys, "_m", F.inline(sides))
    need = need.withColumn("_t", F.floor(F.col("_m") / chunk).cast("long"))

    edge = ranks.groupBy(*keys, "_b").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    need = materialize(need.join(edge, [*keys, "_b"]))
    plain = need.where("_low = _high").select(*keys, "_m", "_side", F.col("_low").alias("_v"))
    need = need.where("_low < _high").drop("_low", "_high")
    unit = [*keys, "_b", "_t"]
    units = need.select(*unit).distinct()
    held = v.drop("_t").join(units, [*keys, "_b"])
    held = held.select(*[F.col(c).alias(c) for c in held.columns])
    answers = T.StructType(kinds + T._parse_datatype_string("_m long, _side string, _v double").fields)

    def answer(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = _answer(a, b.sort_values("_pos")) if len(a) else pd.DataFrame(columns=["_m", "_side", "_v"])
        return keyed(keys, made, key)[[*keys, "_m", "_side", "_v"]]

    deep = need.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInPandas(answer, answers)
    both = plain.unionByName(deep).groupBy(*keys, "_m").agg(
        *[F.max(F.when(F.col("_side") == n, F.col("_v"))).alias(f"_{n}") for n in ("lo", "hi")]
    )
    at = F.lit(p) * (F.col("_m") - 1)
    both = both.select(*keys, "_m", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))).alias(out))
    return d.join(both, [*keys, "_m"], "left").select(*[c for c in df.columns if c != out], out)
