"""Work on all pairs of names of a panel, tile by tile.

Names are numbered and cut into blocks; a tile is a pair of blocks in a span of positions.
A row is sent once to each tile of its block, so the rows shuffled grow with rows x blocks
and not with the square of the names, and a tile works on dense matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordered import Ordered, row_index
from ..session import materialize

BLOCK = 64  # names of a block
SPAN = 1024  # positions of a tile

#: (values of the first block, values of the second, whether both are the same block) ->
#: columns of the result; values are (position, name) with NaN where there is no row.
Work = Callable[[np.ndarray, np.ndarray, bool], dict[str, np.ndarray]]


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """``df`` with the number ``_k`` of its name, the table of names, and their count."""
    cell = F.pmod(F.xxhash64(key), F.lit(256)).alias("_of")  # any order will do, so cells are hashes
    names = row_index(df.select(key, cell).distinct(), Ordered((), (key,), cell="_of"), "_k")
    names = materialize(names.select(key, (F.col("_k") - 1).alias("_k")))
    return df.join(names, key), names, names.count()


def tiled(
    df: DataFrame, key: str, pos: str, value: str, work: Work, schema: str, back: int = 0, block: int = BLOCK, span: int = SPAN
) -> DataFrame:
    """Run ``work`` on each tile; its columns ``a`` and ``b`` (numbers within the blocks) come
    back as names, ``at`` (number within the tile's positions) as a position in ``pos``.

    ``pos`` is a number from 0; ``back`` positions before a tile come with it, and results
    at those are dropped.
    """
    d, names, count = numbered(df.select(key, pos, F.col(value).cast("double").alias("_v")), key)
    blocks = max(1, -(-count // block))
    own, other = F.floor(F.col("_k") / block), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    d = d.select("_k", pos, "_v", own.alias("_own"), other.alias("_other"))
    cells = F.sequence(F.floor(F.col(pos) / span), F.floor((F.col(pos) + back) / span))
    d = d.select("_k", pos, "_v", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), F.explode(cells).alias("_q"))
    made = T._parse_datatype_string(schema).fields
    out = T.StructType([f for f in made if f.name not in ("a", "b", "at")])
    ids = ["_ka", "_kb"] + ([pos] if any(f.name == "at" for f in made) else [])
    out = T.StructType([*[T.StructField(c, T.LongType()) for c in ids], *out.fields])
    target = to_arrow_schema(out)

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        first, second, q = (int(k.as_py()) for k in key)
        k, p, v = (table.column(c).to_numpy() for c in ("_k", pos, "_v"))
        v = v.astype(float)
        start = q * span - back
        sides = []
        for b in (first, second):
            mine = k // block == b
            m = np.full((span + back, block), np.nan)
            m[p[mine] - start, k[mine] - b * block] = v[mine]
            sides.append(m)
        got = work(sides[0], sides[1], first == second)
        if "at" in got:
            keep = got["at"] >= back
            got = {n: x[keep] for n, x in got.items()}
        cols = {"_ka": got.pop("a") + first * block, "_kb": got.pop("b") + second * block}
        if "at" in got:
            cols[pos] = got.pop("at") + start
        cols |= got
        return pa.Table.from_arrays([pa.array(cols[f.name]).cast(f.type) for f in target], schema=target)

    res = d.groupBy("_a", "_b", "_q").applyInArrow(tile, out)
    for side in ("a", "b"):
        label = names.select(F.col("_k").alias(f"_k{side}"), F.col(key).alias(side))
        res = res.join(label, f"_k{side}")
    return res.drop("_ka", "_kb")


def _upper(n: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) with entries in ``n``, each unordered pair once."""
    return np.nonzero(np.triu(n, 1) if same else n)


def pair_moments(df: DataFrame, key: str, pos: str, value: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Per pair of names: joint count and sums ``n, sx, sy, sxx, syy, sxy``, names ``a`` and ``b``."""

    def work(x: np.ndarray, y: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x, y, mx, my = np.where(mx, x, 0), np.where(my, y, 0), mx.astype(float), my.astype(float)
        full = {"n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y}
        a, b = _upper(full["n"], same)
        return {"a": a, "b": b} | {n: m[a, b] for n, m in full.items()}

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = tiled(df, key, pos, value, work, "a long, b long, " + ", ".join(f"{n} double" for n in names), 0, block, span)
    return parts.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in names])


def pair_correlation() -> Column:
    """Pearson correlation from the sums of ``pair_moments``; null where one side is flat."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / n for c in "xy")
    some = (vx > 1e-14 * F.col("sxx")) & (vy > 1e-14 * F.col("syy"))
    return F.when(some, cov / F.sqrt(F.when(some, vx * vy)))


def joint_below(df: DataFrame, key: str, pos: str, value: str, q: float, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Per ordered pair: rows of both where a's value is at most ``q`` (``n``) and where b's is too (``hits``)."""

    def work(x: np.ndarray, y: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        with np.errstate(invalid="ignore"):
            low = [(m <= q).astype(float) for m in (x, y)]
        here = [(~np.isnan(m)).astype(float) for m in (x, y)]
        hits = low[0].T @ low[1]
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("a", "b", "flip", "n", "hits")}
        for flip, n, h in ((0, low[0].T @ here[1], hits), (1, here[0].T @ low[1], hits)):
            if same and flip:
                continue
            a, b = np.nonzero(n * (1 - np.eye(len(n))) if same else n)
            for c, v in (("a", a), ("b", b), ("flip", np.full(len(a), flip)), ("n", n[a, b]), ("hits", h[a, b])):
                out[c].append(v)
        return {c: np.concatenate(v) for c, v in out.items()}

    d = tiled(df, key, pos, value, work, "a long, b long, flip long, n double, hits double", 0, block, span)
    turn = F.col("flip") == 1
    d = d.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), "n", "hits")
    return d.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def rolling_correlation(
    df: DataFrame, key: str, pos: str, value: str, lookback: int, least: float, block: int = BLOCK, span: int = SPAN
) -> DataFrame:
    """Pairs and positions where the correlation of the last ``lookback`` positions, all of
    them known for both names, is at least ``least`` in size: (pos, a, b, rho), a < b."""

    def windowed(m: np.ndarray) -> np.ndarray:
        total = np.cumsum(m, axis=0)
        total[lookback:] = total[lookback:] - total[:-lookback]
        return total

    def work(x: np.ndarray, y: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("at", "a", "b", "rho")}
        moments = []
        for m in (x, y):
            known = ~np.isnan(m)
            some = known.sum(axis=0)
            m = np.where(known, m - np.where(some, np.nansum(m, axis=0) / np.maximum(some, 1), 0), 0)  # the origin is free
            mean, full = windowed(m) / lookback, windowed(known.astype(float)) == lookback
            var = windowed(m * m) / lookback - mean * mean
            moments.append((m, mean, var, full & (np.sqrt(np.maximum(var, 0)) >= 1e-12)))
        (mx, ex, vx, fx), (my, ey, vy, fy) = moments
        for i in range(mx.shape[1]):  # one name against a block
            if not fx[:, i].any():
                continue
            cov = windowed(mx[:, i : i + 1] * my) / lookback - ex[:, i : i + 1] * ey
            with np.errstate(all="ignore"):
                rho = cov / np.sqrt(vx[:, i : i + 1] * vy)
            hit = fx[:, i : i + 1] & fy & (np.abs(rho) >= least)
            if same:
                hit[:, : i + 1] = False
            t, j = np.nonzero(hit)
            for c, v in (("at", t), ("a", np.full(len(t), i)), ("b", j), ("rho", np.clip(rho[t, j], -1, 1))):
                out[c].append(v)
        return {c: np.concatenate(v) if v else np.zeros(0, float if c == "rho" else int) for c, v in out.items()}

    return tiled(df, key, pos, value, work, "at long, a long, b long, rho double", lookback - 1, block, max(span, lookback))
