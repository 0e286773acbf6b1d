"""Ordered work on series whose length has no bound.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole series in one task.
Here a series is cut into cells (a fixed span of its order column), the heavy
work runs per cell or per chunk of cells, and only a table with one row per
cell is ever ordered by key alone:

* ``rolling``   bounded frames: chunks of cells plus a halo of neighbour cells
* ``running``   unbounded frames: local frame + carry from the cells before
* ``equity``    running sum with its running maximum, in one pass
* ``affine``, ``ewm``, ``state_scan``  recursions, composed cell by cell
* ``sliding_ranks``  order statistics of bounded frames, per chunk
* ``average_rank``, ``quantiles``  sorted positions over pre-counted values
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from . import wavelet

CHUNK_ROWS = 65536
CENTURY_DAYS = 36525
VALUE_CELLS = 64


@dataclass(frozen=True)
class Ordered:
    """A keyed series: key columns, order columns, and the span of one cell.

    ``span`` counts days for date and timestamp columns and units for numbers.
    Choose it so that one cell of the densest series fits a task with ease.
    ``cell`` names an existing cell column that rises with the order.

    ``step`` states, in days, that a key has at most one row per calendar step
    (bars made by grouping on the step). It bounds a series by the calendar, not
    by the data: a century of weeks is 5,218 rows. Where that bound fits one
    chunk, plain windows are used and the cell tables are not needed.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    span: float = 64
    cell: str | None = None
    step: float | None = None

    @property
    def short(self) -> bool:
        return self.step is not None and CENTURY_DAYS / self.step <= CHUNK_ROWS

    def by(self, *keys: str) -> Ordered:
        return replace(self, keys=tuple(keys))


BARS = Ordered(("symbol",), ("datetime",))
WEEKLY = Ordered(("symbol",), ("datetime",), step=7)
DAILY = Ordered(("symbol",), ("date",), step=1)
CALENDAR = Ordered((), ("date",), step=1)

Stage = Callable[[WindowSpec], Mapping[str, Column]]


def with_cell(df: DataFrame, s: Ordered) -> DataFrame:
    if s.short:
        return df.withColumn("_cell", F.lit(0).cast("long"))
    if s.cell:
        return df.withColumn("_cell", F.col(s.cell))
    col = s.order[0]
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        pos = F.unix_date(col)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        pos = F.unix_seconds(F.col(col).cast("timestamp")) / F.lit(86400)
    else:
        pos = F.col(col)
    return df.withColumn("_cell", F.floor(pos / F.lit(s.span)).cast("long"))


def _by_key(s: Ordered) -> WindowSpec:
    return Window.partitionBy(*s.keys) if s.keys else Window.partitionBy(F.lit(0))


def _layout(cells: DataFrame, s: Ordered, back: int, ahead: int, chunk: int) -> DataFrame:
    """One row per cell: own chunk and the range of chunks that need its rows."""
    per_key = _by_key(s)
    w = per_key.orderBy("_cell")
    c = cells.withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_start", F.col("_end") - F.col("_n"))
    c = c.withColumn("_grp", F.floor(F.col("_start") / F.lit(chunk)))
    c = c.withColumn("_chunk", F.dense_rank().over(per_key.orderBy("_grp")))
    lo = hi = F.col("_chunk")
    if back > 0:
        c = c.withColumn(
            "_next", F.max("_chunk").over(per_key.orderBy("_start").rangeBetween(0, back - 1))
        )
        hi = F.greatest("_chunk", F.lead("_next").over(w))
    if ahead > 0:
        c = c.withColumn(
            "_prev", F.min("_chunk").over(per_key.orderBy("_end").rangeBetween(-(ahead - 1), 0))
        )
        lo = F.least("_chunk", F.lag("_prev").over(w))
    return c.select(*s.keys, "_cell", "_chunk", lo.alias("_lo"), hi.alias("_hi"))


def _staged(d: DataFrame, stages: Sequence[Stage], w: WindowSpec) -> tuple[DataFrame, list[str]]:
    names: list[str] = []
    for stage in stages:
        made = stage(w)
        keep = [c for c in d.columns if c not in made]
        d = d.select(*keep, *[c.alias(n) for n, c in made.items()])
        names = [c for c in names if c not in made] + list(made)
    return d, names


def rolling(
    df: DataFrame,
    s: Ordered,
    stages: Sequence[Stage] | Stage,
    back: int,
    ahead: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add window columns whose reach is ``back`` rows behind, ``ahead`` after.

    Each stage gets the chunk's window spec and returns name -> column; a stage
    may read the columns of the stages before it, and ``back``/``ahead`` are the
    sums over the stages. All stages share one shuffle and one sort.
    """
    if callable(stages):
        stages = [stages]
    if s.short and chunk_rows is None:
        d, _ = _staged(df, stages, _by_key(s).orderBy(*s.order))
        return d
    chunk = chunk_rows or max(CHUNK_ROWS, 8 * (back + ahead))
    d = with_cell(df, replace(s, step=None))
    layout = _layout(
        d.groupBy(*s.keys, "_cell").agg(F.count(F.lit(1)).alias("_n")), s, back, ahead, chunk
    )
    d = d.join(layout, [*s.keys, "_cell"])
    if back > 0 or ahead > 0:
        d = d.withColumn("_dest", F.explode(F.sequence("_lo", "_hi")))
    else:
        d = d.withColumn("_dest", F.col("_chunk"))
    w = Window.partitionBy(*s.keys, "_dest").orderBy(*s.order)
    d, made = _staged(d, stages, w)
    names = [c for c in df.columns if c not in made] + made
    return d.where(F.col("_dest") == F.col("_chunk")).select(*names)


_JOIN = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "first": lambda a, b: F.coalesce(a, b),
}


def _frame(kind: str, col: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    if kind == "first":
        return F.first(col, ignorenulls=True).over(w)
    return getattr(F, kind)(col).over(w)


def _running_short(
    df: DataFrame,
    s: Ordered,
    cols: Mapping[str, tuple[str, Column]],
    reset: Column | None,
    upto: int,
) -> DataFrame:
    w, d = _by_key(s).orderBy(*s.order), df
    if reset is not None:
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_seg", F.sum(F.when(reset, 1).otherwise(0)).over(so_far))
        w = Window.partitionBy(*s.keys, "_seg").orderBy(*s.order)
    f = w.rowsBetween(Window.unboundedPreceding, upto)
    out = [_frame(k, c, f).alias(n) for n, (k, c) in cols.items()]
    return d.select(*[c for c in df.columns if c not in cols], *out)


def running(
    df: DataFrame,
    s: Ordered,
    cols: Mapping[str, tuple[str, Column]],
    reset: Column | None = None,
    upto: int = 0,
) -> DataFrame:
    """Aggregates over all rows of the series so far.

    ``cols`` maps an output name to (kind, input), kind in sum, max, min, last,
    first; last and first skip nulls. ``reset`` starts a new segment at rows
    where it is true. ``upto=-1`` leaves out the current row (no reset then).
    """
    if s.short:
        return _running_short(df, s, cols, reset, upto)
    d = with_cell(df, s)
    for i, (_, col) in enumerate(cols.values()):
        d = d.withColumn(f"_in{i}", col)
    cell_w = Window.partitionBy(*s.keys, "_cell").orderBy(*s.order)
    kinds = [k for k, _ in cols.values()]
    if reset is None and not {"last", "first"} & set(kinds):
        tails = d.groupBy(*s.keys, "_cell").agg(
            *[getattr(F, k)(f"_in{i}").alias(f"_t{i}") for i, k in enumerate(kinds)]
        )
        tails = tails.withColumn("_ns", F.lit(0))
        seg_w = cell_w
    else:
        if reset is None:
            d = d.withColumn("_seg", F.lit(0))
            seg_w = cell_w
        else:
            d = d.withColumn(
                "_seg",
                F.sum(F.when(reset, 1).otherwise(0)).over(
                    cell_w.rowsBetween(Window.unboundedPreceding, 0)
                ),
            )
            seg_w = Window.partitionBy(*s.keys, "_cell", "_seg").orderBy(*s.order)
        full = seg_w.rowsBetween(Window.unboundedPreceding, 0)
        ends = d.select(
            *s.keys,
            "_cell",
            "_seg",
            F.lead(F.lit(1)).over(cell_w).alias("_more"),
            *[_frame(k, F.col(f"_in{i}"), full).alias(f"_t{i}") for i, k in enumerate(kinds)],
        )
        tails = ends.where(F.col("_more").isNull()).withColumnRenamed("_seg", "_ns")

    per_key = _by_key(s).orderBy("_cell")
    upward = per_key.rowsBetween(Window.unboundedPreceding, 0)
    if reset is None:
        carry = tails.select(
            *s.keys,
            "_cell",
            *[
                _frame(k, F.col(f"_t{i}"), per_key.rowsBetween(Window.unboundedPreceding, -1)).alias(
                    f"_c{i}"
                )
                for i, k in enumerate(kinds)
            ],
        )
    else:
        tails = tails.withColumn("_g", F.sum(F.when(F.col("_ns") > 0, 1).otherwise(0)).over(upward))
        in_g = (
            Window.partitionBy(*s.keys, "_g")
            .orderBy("_cell")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        tails = tails.select(
            *s.keys,
            "_cell",
            *[_frame(k, F.col(f"_t{i}"), in_g).alias(f"_t{i}") for i, k in enumerate(kinds)],
        )
        carry = tails.select(
            *s.keys,
            "_cell",
            *[F.lag(f"_t{i}").over(per_key).alias(f"_c{i}") for i in range(len(kinds))],
        )

    local = seg_w.rowsBetween(Window.unboundedPreceding, upto)
    for i, k in enumerate(kinds):
        d = d.withColumn(f"_l{i}", _frame(k, F.col(f"_in{i}"), local))
    d = d.join(carry, [*s.keys, "_cell"], "left")
    out = []
    for i, (name, (k, _)) in enumerate(cols.items()):
        both = _JOIN[k](F.col(f"_c{i}"), F.col(f"_l{i}"))
        if reset is not None:
            both = F.when(F.col("_seg") == 0, both).otherwise(F.col(f"_l{i}"))
        out.append(both.alias(name))
    return d.select(*[c for c in df.columns if c not in cols], *out)


def row_index(df: DataFrame, s: Ordered, out: str = "idx") -> DataFrame:
    """1-based position of the row in its series."""
    return running(df, s, {out: ("sum", F.lit(1).cast("long"))})


def equity(df: DataFrame, s: Ordered, rets: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Running sum and its distance below the running maximum.

    ``rets`` maps a return column to (equity name, drawdown name).
    """
    if s.short:
        w, d = _by_key(s).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0), df
        for r, (eq, _) in rets.items():
            d = d.withColumn(eq, F.sum(r).over(w))
        for eq, dd in rets.values():
            d = d.withColumn(dd, F.col(eq) - F.max(eq).over(w))
        made = [n for pair in rets.values() for n in pair]
        return d.select(*[c for c in df.columns if c not in made], *made)
    d = with_cell(df, s)
    w = Window.partitionBy(*s.keys, "_cell").orderBy(*s.order)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    for i, r in enumerate(rets):
        d = d.withColumn(f"_s{i}", F.sum(r).over(w))
    for i in range(len(rets)):
        d = d.withColumn(f"_m{i}", F.max(f"_s{i}").over(w))
    cells = d.groupBy(*s.keys, "_cell").agg(
        *[F.sum(r).alias(f"_t{i}") for i, r in enumerate(rets)],
        *[F.max(f"_s{i}").alias(f"_p{i}") for i in range(len(rets))],
    )
    before = _by_key(s).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    for i in range(len(rets)):
        cells = cells.withColumn(f"_cs{i}", F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0.0)))
    for i in range(len(rets)):
        cells = cells.withColumn(f"_cp{i}", F.max(F.col(f"_cs{i}") + F.col(f"_p{i}")).over(before))
    d = d.join(
        cells.select(
            *s.keys, "_cell", *[f"_c{a}{i}" for a in "sp" for i in range(len(rets))]
        ),
        [*s.keys, "_cell"],
    )
    out = []
    for i, (eq, dd) in enumerate(rets.values()):
        e = F.col(f"_cs{i}") + F.col(f"_s{i}")
        peak = F.greatest(F.col(f"_cp{i}"), F.col(f"_cs{i}") + F.col(f"_m{i}"))
        out += [e.alias(eq), (e - peak).alias(dd)]
    made = {n for pair in rets.values() for n in pair}
    return d.select(*[c for c in df.columns if c not in made], *out)


Arrays = dict[str, np.ndarray]


def _declared(table: pa.Table, target: pa.Schema) -> pa.Table:
    """The table with nested columns in the types that Spark expects (entries may be null)."""
    for i, (f, t) in enumerate(zip(table.schema, target, strict=True)):
        if pa.types.is_nested(f.type) and f.type != t.type:
            table = table.set_column(i, f.name, table.column(i).cast(t.type))
    return table


def _scan_cells(
    df: DataFrame, s: Ordered, inputs: Sequence[str], work: Callable[[Arrays], Arrays], extra: str
) -> DataFrame:
    """Run ``work`` on the ``inputs`` of each cell's rows in order; it returns the ``extra``
    columns. Other columns pass through as they are; a list column comes as a matrix."""
    order = [(c, "ascending") for c in s.order]
    d = with_cell(df, s)
    added = T._parse_datatype_string(extra).fields
    schema = T.StructType([f for f in d.schema.fields if f.name not in inputs] + list(added))

    def column(table: pa.Table, name: str) -> np.ndarray:
        c = table.column(name).combine_chunks()
        if pa.types.is_list(c.type):
            return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        return c.to_numpy(zero_copy_only=False)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        made = work({c: column(table, c) for c in inputs})
        table = table.drop_columns(inputs)
        for f in added:
            v = made[f.name]
            table = table.append_column(f.name, pa.array(list(v) if v.ndim == 2 else v))
        return _declared(table, target)

    target = to_arrow_schema(schema)
    return d.groupBy(*s.keys, "_cell").applyInArrow(one, schema)


def _scan_carry(
    cells: DataFrame, s: Ordered, fold: Callable[[pd.DataFrame], pd.DataFrame], extra: str
) -> DataFrame:
    """Fold the one-row-per-cell table along each key."""
    fields = [f for f in cells.schema.fields if f.name in (*s.keys, "_cell")]
    schema = T.StructType(fields + list(T._parse_datatype_string(extra).fields))
    names = [f.name for f in schema.fields]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values("_cell"))[names]

    if not s.keys:
        return cells.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(one, schema)
    return cells.groupBy(*s.keys).applyInPandas(one, schema)


def compose_affine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition of the maps y -> a_i y + b_i: factor and offset up to each i.

    After step s every entry holds the composition of the last 2**s maps, so a cell of n
    rows takes log2(n) passes over whole arrays.
    """
    a, b = a.copy(), b.copy()
    reach = 1
    while reach < len(a):
        old_a, old_b = a[:-reach].copy(), b[:-reach].copy()
        b[reach:] += a[reach:] * old_b
        a[reach:] *= old_a
        reach *= 2
    return a, b


def compose_maps(f: np.ndarray) -> np.ndarray:
    """Running composition of maps of 0..K-1, row i of ``f`` being the i-th map."""
    f = f.copy()
    reach = 1
    while reach < len(f):
        f[reach:] = np.take_along_axis(f[reach:], f[:-reach].copy(), axis=1)
        reach *= 2
    return f


def _last_row(n: int) -> np.ndarray:
    end = np.zeros(n, dtype=bool)
    end[-1] = True
    return end


def affine(df: DataFrame, s: Ordered, a: Column, b: Column, out: str) -> DataFrame:
    """y_t = a_t * y_(t-1) + b_t. Null a or b repeats y; a = 0 starts afresh."""

    def work(c: Arrays) -> Arrays:
        av, bv = c["_a"], c["_b"]
        skip = np.isnan(av) | np.isnan(bv)
        q, p = compose_affine(np.where(skip, 1.0, av), np.where(skip, 0.0, bv))
        return {"_p": p, "_q": q, "_last": _last_row(len(p))}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = compose_affine(pdf["_q"].to_numpy(float), pdf["_p"].to_numpy(float))
        y = np.where(q == 0, p, np.nan)  # nothing is known before a map that starts afresh
        return pdf.assign(_y=np.concatenate([[np.nan], y[:-1]]))

    d = df.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double"))
    d = _scan_cells(d, s, ["_a", "_b"], work, "_p double, _q double, _last boolean")
    if s.short:
        d = d.withColumn("_y", F.lit(float("nan")))
    else:
        ends = d.where("_last").select(*s.keys, "_cell", "_p", "_q")
        d = d.join(_scan_carry(ends, s, fold, "_y double"), [*s.keys, "_cell"])
    y0 = F.when(F.isnan("_y"), None).otherwise(F.col("_y"))
    y = F.when(F.col("_q") == 0, F.col("_p")).otherwise(F.col("_p") + F.col("_q") * y0)
    return d.select(*[c for c in df.columns if c != out], y.alias(out))


def _ewm_cell(xv: np.ndarray, keep: float) -> Arrays:
    """Per row: the mean as p + q * (first mean of the cell), values seen, rows since the last."""
    n, place, alpha = len(xv), np.arange(len(xv)), 1.0 - keep
    at = np.flatnonzero(~np.isnan(xv))
    q, p = np.ones(n), np.zeros(n)
    if len(at) > 1:  # the first known value's map depends on the carry and is left out
        old = keep ** np.diff(at).astype(float)
        q[at[1:]] = old / (old + alpha)
        p[at[1:]] = (1.0 - q[at[1:]]) * xv[at[1:]]
    q, p = compose_affine(q, p)
    known = np.zeros(n, dtype=np.int64)
    known[at] = 1
    last = np.maximum.accumulate(np.where(known > 0, place, -1))
    lead, first = (at[0] + 1, xv[at[0]]) if len(at) else (n, np.nan)
    return {
        "p": p, "q": q, "c": np.cumsum(known), "lead": np.full(n, lead), "first": np.full(n, first), "gap": place - last,
    }


def _ewm_fold(c: Arrays, keep: float) -> Arrays:
    """Per cell: the mean before it, its first mean, values before it."""
    pv, qv, lead, first, tail, cnt = (c[k] for k in ("p", "q", "lead", "first", "gap", "c"))
    n, has, alpha = len(pv), cnt > 0, 1.0 - keep
    seen = np.cumsum(cnt) - cnt
    base = np.cumsum(np.where(has, 0, tail))  # rows of cells without values
    reset = np.maximum.accumulate(np.where(has, np.arange(n), -1))
    gap = np.where(reset >= 0, np.where(has, tail, tail[reset] + base - base[reset]), base)
    before = np.concatenate([[0], gap[:-1]])
    fresh = has & (seen == 0)
    old = keep ** (before + lead).astype(float)
    a = np.where(fresh, 0.0, old / (old + alpha))
    b = np.where(fresh, first, (1.0 - a) * first)  # the cell's first mean: a * carry + b
    q, p = compose_affine(np.where(has, qv * a, 1.0), np.where(has, pv + qv * b, 0.0))
    carry = np.concatenate([[np.nan], np.where(np.cumsum(cnt) > 0, p, np.nan)[:-1]])
    start = np.where(fresh, first, np.where(has, a * np.where(fresh, 0.0, carry) + b, np.nan))
    return {"y": carry, "y1": start, "n0": seen}


def ewms(df: DataFrame, s: Ordered, cols: Mapping[str, tuple[Column, float, int]]) -> DataFrame:
    """Exponential means, recursive form, weights by absolute position, in one pass.

    ``cols`` maps an output name to (value, alpha, min_obs). A null row repeats the mean and
    lets the old weight decay once more. Null until ``min_obs`` values have been seen.
    """
    names = ("p", "q", "c", "lead", "first", "gap")
    kinds = ("double", "double", "long", "long", "double", "long")
    keeps = [1.0 - alpha for _, alpha, _ in cols.values()]
    k = range(len(cols))

    def work(c: Arrays) -> Arrays:
        made = [_ewm_cell(c[f"_x{i}"], keep) for i, keep in enumerate(keeps)]
        out = {f"_{n}{i}": m[n] for i, m in enumerate(made) for n in names}
        return out | {"_last": _last_row(len(c["_x0"]))}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        for i, keep in enumerate(keeps):
            made = _ewm_fold({n: pdf[f"_{n}{i}"].to_numpy() for n in names}, keep)
            pdf = pdf.assign(**{f"_{n}{i}": v for n, v in made.items()})
        return pdf

    d = df
    for i, (x, _, _) in enumerate(cols.values()):
        d = d.withColumn(f"_x{i}", x.cast("double"))
    extra = ", ".join([f"_{n}{i} {t}" for i in k for n, t in zip(names, kinds, strict=True)])
    d = _scan_cells(d, s, [f"_x{i}" for i in k], work, f"{extra}, _last boolean")
    if s.short:
        d = d.withColumns({f"_y{i}": F.lit(float("nan")) for i in k})
        d = d.withColumns({f"_y1{i}": F.col(f"_first{i}") for i in k} | {f"_n0{i}": F.lit(0) for i in k})
    else:
        ends = d.where("_last").select(*s.keys, "_cell", *[f"_{n}{i}" for i in k for n in names])
        carried = ", ".join([f"_y{i} double, _y1{i} double, _n0{i} long" for i in k])
        d = d.join(_scan_carry(ends, s, fold, carried), [*s.keys, "_cell"])
    made = []
    for i, (out, (_, _, least)) in enumerate(cols.items()):
        y = F.when(F.col(f"_c{i}") == 0, F.col(f"_y{i}")).otherwise(F.col(f"_p{i}") + F.col(f"_q{i}") * F.col(f"_y1{i}"))
        made.append(F.when(F.isnan(y) | (F.col(f"_c{i}") + F.col(f"_n0{i}") < least), None).otherwise(y).alias(out))
    return d.select(*[c for c in df.columns if c not in cols], *made)


def ewm(
    df: DataFrame, s: Ordered, x: Column, alpha: float, out: str, min_obs: int = 1
) -> DataFrame:
    """One exponential mean; see ``ewms``."""
    return ewms(df, s, {out: (x, alpha, min_obs)})


def state_scan(df: DataFrame, s: Ordered, step: Column, out: str) -> DataFrame:
    """Finite state machine: ``step`` is an array giving the next state of each
    state 0..K-1 at this row; the series starts in state 0."""

    def work(c: Arrays) -> Arrays:
        comp = compose_maps(c["_f"].astype(np.int32))
        return {"_comp": comp, "_last": _last_row(len(comp))}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        comp = compose_maps(np.stack(pdf["_comp"].to_numpy()).astype(np.int64))
        return pdf.assign(_s0=np.concatenate([[0], comp[:-1, 0]]))

    d = df.withColumn("_f", step.cast("array<int>"))
    d = _scan_cells(d, s, ["_f"], work, "_comp array<int>, _last boolean")
    if s.short:
        d = d.withColumn("_s0", F.lit(0))
    else:
        ends = d.where("_last").select(*s.keys, "_cell", "_comp")
        d = d.join(_scan_carry(ends, s, fold, "_s0 int"), [*s.keys, "_cell"])
    return d.select(
        *[c for c in df.columns if c != out], F.element_at("_comp", F.col("_s0") + 1).alias(out)
    )


def sliding_ranks(
    df: DataFrame, s: Ordered, cols: Mapping[str, tuple[Column, int]], chunk_rows: int | None = None
) -> DataFrame:
    """Add, per name, a struct (below, ties, known): how the row's value ranks among the
    last n values, its own included; ``cols`` maps the name to (value, n).

    All columns share one shuffle; a chunk's rows are ranked together at a cost of the
    logarithm of the chunk, whatever n is. Null values have no rank and are not counted.
    """
    back = max(n for _, n in cols.values())
    names = list(cols)
    d = df
    for i, (c, _) in enumerate(cols.values()):
        d = d.withColumn(f"_x{i}", c.cast("double"))
    if s.short and chunk_rows is None:
        d = d.withColumn("_dest", F.lit(0).cast("long")).withColumn("_chunk", F.col("_dest"))
    else:
        d = with_cell(d, replace(s, step=None))
        sizes = d.groupBy(*s.keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        d = d.join(_layout(sizes, s, back, 0, chunk_rows or max(CHUNK_ROWS, 8 * back)), [*s.keys, "_cell"])
        d = d.withColumn("_dest", F.explode(F.sequence("_lo", "_hi")))
    kind = T._parse_datatype_string("below long, ties long, known long")
    schema = T.StructType([*d.schema.fields, *[T.StructField(n, kind) for n in names]])
    windows = [n for _, n in cols.values()]
    order = [(c, "ascending") for c in s.order]

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for i, (name, n) in enumerate(zip(names, windows, strict=True)):
            x = table.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float)
            parts = [pa.array(v) for v in wavelet.sliding_ranks(x, n)]
            table = table.append_column(name, pa.StructArray.from_arrays(parts, ["below", "ties", "known"]))
        return _declared(table, target)

    target = to_arrow_schema(schema)

    d = d.groupBy(*s.keys, "_dest").applyInArrow(work, schema)
    kept = [c for c in df.columns if c not in cols]
    return d.where(F.col("_dest") == F.col("_chunk")).select(*kept, *names)


def _value_counts(
    df: DataFrame, keys: Sequence[str], value: str, cells: int, aggs: Sequence[Column] = ()
) -> tuple[DataFrame, Ordered]:
    """Distinct values per key with counts, cut into cells by shared quantiles.

    The cut points come from all keys together, so a key that holds a third of
    the rows is spread over its own share of the cells; equal values are one row.
    """
    d = df.where(F.col(value).isNotNull())
    vals = d.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    vals = materialize(vals)  # read for the cut points, the cell sums and the rows
    marks = [i / cells for i in range(1, cells)]
    cuts = vals.agg(F.percentile_approx(value, marks, 10 * cells).alias("_cuts"))
    vals = vals.crossJoin(F.broadcast(cuts))  # one row
    cell = F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")
    vals = vals.withColumn("_vcell", cell).drop("_cuts")
    return vals, Ordered(tuple(keys), (value,), cell="_vcell")


def value_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    aggs: Sequence[Column] = (),
    cells: int = VALUE_CELLS,
) -> DataFrame:
    """One row per (keys, value): ``_n`` ties, ``_cum`` rows at or below it."""
    vals, s = _value_counts(df, keys, value, cells, aggs)
    return running(vals, s, {"_cum": ("sum", F.col("_n"))}).drop("_vcell")


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, names: int | None = None
) -> DataFrame:
    """Rank with ties averaged, 1-based, ascending; null values rank null.

    ``names`` bounds the rows of a group, as in ``row_numbers``.
    """
    if names is not None and names <= CHUNK_ROWS:
        some = F.col(value).isNotNull()
        low = F.rank().over(Window.partitionBy(*keys, some).orderBy(value))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        return df.withColumn(out, F.when(some, low + (ties - 1) / 2.0))
    r = value_ranks(df.select(*keys, value), keys, value)
    r = r.select(*keys, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(r, [*keys, value], "left").select(*df.columns, out)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key, without holding a key in one task."""
    r = value_ranks(df.select(*keys, value), keys, value)
    tot = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_tot"))
    r = r.join(tot, list(keys)) if keys else r.crossJoin(F.broadcast(tot))  # one row
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_tot") - 1)
        aggs += [
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
        ]
    g = r.groupBy(*keys, "_tot").agg(*aggs) if keys else r.groupBy("_tot").agg(*aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_tot") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return g.select(*keys, *out)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ties: Sequence[str],
    out: str,
    total: str,
    cells: int = VALUE_CELLS,
    names: int | None = None,
) -> DataFrame:
    """Ascending 1-based position by (value, ties) within keys, and group size.

    ``ties`` must make the order total. Rows are cut into cells at shared value
    quantiles, as in ``value_ranks``. ``names`` states how many rows a group can
    have at most (the size of the symbol dimension); where one chunk holds that,
    a plain window ranks the group.
    """
    if names is not None and names <= CHUNK_ROWS:
        group = Window.partitionBy(*keys)
        return df.withColumn(
            out, F.row_number().over(group.orderBy(value, *ties)).cast("long")
        ).withColumn(total, F.count(F.lit(1)).over(group))
    df = materialize(df)  # read for the cut points, the cell sums, sizes and rows
    marks = [i / cells for i in range(1, cells)]
    cuts = df.agg(F.percentile_approx(value, marks, 10 * cells).alias("_cuts"))
    d = df.crossJoin(F.broadcast(cuts))  # one row
    d = d.withColumn(
        "_vcell", F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")
    ).drop("_cuts")
    s = Ordered(tuple(keys), (value, *ties), cell="_vcell")
    d = running(d, s, {out: ("sum", F.lit(1).cast("long"))}).drop("_vcell")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    return d.join(n, list(keys)) if keys else d.crossJoin(F.broadcast(n))  # one row
