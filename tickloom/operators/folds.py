"""Walk-forward folds and pooled models (inventory 2.H)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import log_return, ratio
from ..functions.ordered import BARS, Ordered, quantiles, rolling, row_index, running
from ..session import materialize
from .pairs import rolling_correlation


def fold_table(
    n: DataFrame,
    train: int,
    test: int,
    step: int | None = None,
    mode: str = "rolling",
    embargo: int = 0,
    offset: int = 0,
) -> DataFrame:
    """Half-open index ranges of each fold. ``n`` has one row per series with
    the column ``n``; a fold whose test range would overrun is left out.

    Modes: rolling (fixed train length), anchored (train starts at 0).
    """
    step = step or test
    last = F.floor((F.col("n") - offset - train - embargo - test) / step)
    d = n.where(last >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0), last)))
    end = offset + F.col("fold") * step + train
    start = F.lit(0) if mode == "anchored" else end - train
    return d.select(
        *[c for c in n.columns if c != "n"],
        F.col("fold").cast("int").alias("fold"),
        start.cast("long").alias("train_start"),
        end.cast("long").alias("train_end"),
        (end + embargo).cast("long").alias("test_start"),
        (end + embargo + test).cast("long").alias("test_end"),
    )


def expanding_folds(n: DataFrame, min_train: int, test: int, step: int | None = None,
                    expanding: bool = True) -> DataFrame:
    """Folds from a least train length on, growing or of fixed length."""
    step = step or test
    last = F.floor((F.col("n") - min_train - test) / step)
    d = n.where(last >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0), last)))
    end = min_train + F.col("fold") * step
    return d.select(
        *[c for c in n.columns if c != "n"],
        F.col("fold").cast("int").alias("fold"),
        (F.lit(0) if expanding else end - min_train).cast("long").alias("train_start"),
        end.cast("long").alias("train_end"),
        end.cast("long").alias("test_start"),
        (end + test).cast("long").alias("test_end"),
    )


def purged(folds: DataFrame, horizon: int) -> DataFrame:
    """Drop the last rows of train and the first of test; drop empty folds."""
    d = folds.withColumns(
        {
            "train_end": F.col("train_end") - horizon,
            "test_start": F.col("test_start") + horizon,
        }
    )
    return d.where((F.col("train_end") > F.col("train_start")) & (F.col("test_end") > F.col("test_start")))


def assign(times: DataFrame, folds: DataFrame, idx: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each fold with their side. ``folds`` is small next to ``times``:
    its ranges are spread to single positions, which turns the range join into
    an equi join."""
    sides = [
        folds.select(
            *keys,
            "fold",
            F.lit(side).alias("side"),
            F.explode(F.sequence(F.col(f"{side}_start"), F.col(f"{side}_end") - 1)).alias(idx),
        ).where(F.col(idx) >= 0)
        for side in ("train", "test")
    ]
    return times.join(sides[0].unionByName(sides[1]), [*keys, idx])


def panel_folds(
    times: DataFrame,
    s: Ordered = BARS,
    train: int = 365,
    test: int = 91,
    step: int | None = None,
    mode: str = "rolling",
    embargo: int = 0,
    offset: int = 0,
    horizon: int = 0,
) -> DataFrame:
    """Folds over the distinct timestamps of a panel: (fold, side, datetime).

    Joined back on the timestamp, every symbol of a bar lands on one side.
    """
    d = positions(times, s)
    f = bar_folds(d, train, test, step, mode, embargo, offset)
    if horizon:
        f = purged(f, horizon)
    return assign(d, f, "_i").select("fold", "side", s.order[0])


def positions(times: DataFrame, s: Ordered) -> DataFrame:
    """Each distinct timestamp with its position ``_i`` from 0."""
    t = s.order[0]
    return row_index(times.select(t).distinct(), s.by(), "_i").withColumn("_i", F.col("_i") - 1)


def bar_folds(bars: DataFrame, train: int, test: int, step: int | None = None, mode: str = "rolling",
              embargo: int = 0, offset: int = 0) -> DataFrame:
    """The fold table over all positions of ``bars``."""
    return fold_table(bars.agg(F.count(F.lit(1)).alias("n")), train, test, step, mode, embargo, offset)


class FoldSums:
    """Running sums of products of (1, features, targets) by timestamp.

    The rows are read once. The sums of any range of timestamps are the difference of two
    rows of the running table, so no row is copied into the folds that hold it, however
    many folds overlap. Features should lie within some 1e5 standard deviations of zero,
    as differences of running sums lose that much precision.
    """

    def __init__(self, rows: DataFrame, s: Ordered, xs: Sequence[str], targets: Sequence[str]) -> None:
        self.rows, self.s, self.t = rows, s, s.order[0]
        self.xs, self.targets = list(xs), list(targets)
        names = ["_one", *xs, *targets]
        k = len(xs) + 1
        self.pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names)) if i < k]
        d = rows.withColumn("_one", F.lit(1.0))
        made = [F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"g_{i}_{j}") for i, j in self.pairs]
        cells = d.groupBy(self.t).agg(*made)
        cols = {f"g_{i}_{j}": ("sum", F.col(f"g_{i}_{j}")) for i, j in self.pairs}
        made = running(cells, s.by(), {"_i": ("sum", F.lit(1).cast("long"))} | cols)
        self.sums = materialize(made.withColumn("_i", F.col("_i") - 1))  # one row per timestamp
        self.bars = self.sums.select(self.t, "_i")

    def of(self, folds: DataFrame, keys: Sequence[str] = ("fold",), side: str = "train") -> DataFrame:
        """One row per fold: the sums over its ``side``."""
        ends = F.array(
            F.struct((F.col(f"{side}_end") - 1).alias("_i"), F.lit(1.0).alias("_sign")),
            F.struct((F.col(f"{side}_start") - 1).alias("_i"), F.lit(-1.0).alias("_sign")),
        )
        d = folds.select(*keys, F.inline(ends)).where(F.col("_i") >= 0).join(self.sums, "_i")
        return d.groupBy(*keys).agg(*[F.sum(F.col("_sign") * F.col(f"g_{i}_{j}")).alias(f"g_{i}_{j}") for i, j in self.pairs])

    def models(self, folds: DataFrame, y: str, keys: Sequence[str] = ("fold",),
               subsets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """Least squares on the standardized features of the train side of each fold: ``bias``,
        ``weights``, and the ``means`` and ``scales`` of the features (a std under 1e-12
        counts as 1). ``subsets`` fits several feature sets from the same sums."""
        k, at = len(self.xs), 1 + len(self.xs) + self.targets.index(y)
        sets = {n: [1 + self.xs.index(c) for c in cols] for n, cols in (subsets or {"all": self.xs}).items()}
        sums = self.of(folds, keys)
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys]
        more = ["subset string", "bias double", "weights array<double>", "means array<double>", "scales array<double>"]

        def solve(parts):
            for pdf in parts:
                out = []
                for _, r in pdf.iterrows():
                    n = r["g_0_0"]
                    if not n > 0:
                        continue
                    m = np.array([r[f"g_0_{i}"] for i in range(1, k + 1)]) / n
                    c = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(1, k + 1)] for i in range(1, k + 1)])
                    c = c - n * np.outer(m, m)
                    scale = np.sqrt(np.maximum(np.diag(c), 0) / max(n - 1, 1))
                    scale = np.where((scale < 1e-12) | (n < 2), 1.0, scale)
                    g = c / np.outer(scale, scale)
                    v = (np.array([r[f"g_{i}_{at}"] for i in range(1, k + 1)]) - m * r[f"g_0_{at}"]) / scale
                    for name, use in sets.items():
                        use = np.array(use) - 1
                        w = np.zeros(k)
                        w[use] = np.linalg.lstsq(g[np.ix_(use, use)], v[use], rcond=None)[0]
                        out.append([*[r[x] for x in keys], name, r[f"g_0_{at}"] / n, w.tolist(), m.tolist(), scale.tolist()])
                yield pd.DataFrame(out, columns=[*keys, "subset", "bias", "weights", "means", "scales"])

        return sums.mapInPandas(solve, ", ".join([*fields, *more]))

    def test_rows(self, folds: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
        """The rows of the test ranges, with the keys of their folds."""
        spans = folds.select(*keys, F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("_i"))
        times = spans.join(self.bars, "_i").select(*keys, self.t)
        return self.rows.join(times, self.t)

    def predictions(self, folds: DataFrame, y: str, keys: Sequence[str] = ("fold",),
                    subsets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """The test rows with ``bias`` and ``pred`` of their fold's model."""
        d = self.test_rows(folds, keys).join(self.models(folds, y, keys, subsets), list(keys))
        dot = F.col("bias")
        for i, c in enumerate(self.xs):
            dot = dot + F.col("weights")[i] * (F.col(c) - F.col("means")[i]) / F.col("scales")[i]
        return d.withColumn("pred", dot).drop("weights", "means", "scales")

    def scaled(self, folds: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
        """All rows of both sides of each fold, features standardized by its train side.
        This table holds a row once per fold by definition."""
        d = self.rows.join(assign(self.bars, folds, "_i", ()).select(*keys, "side", self.t), self.t)
        d = d.join(self.models(folds, self.targets[0], keys).select(*keys, "means", "scales"), list(keys))
        made = {c: (F.col(c) - F.col("means")[i]) / F.col("scales")[i] for i, c in enumerate(self.xs)}
        return d.withColumns(made).drop("means", "scales")


def ordered_split(df: DataFrame, s: Ordered, test_size: float) -> DataFrame:
    """The last share of each series is the test side."""
    d = row_index(df, s, "_i")
    if s.keys:
        n = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
        d = d.join(n, list(s.keys))
    else:
        d = d.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    cut = F.floor(F.col("_n") * F.lit(1 - test_size))
    return d.select(*df.columns, F.when(F.col("_i") <= cut, "train").otherwise("test").alias("side"))


# For rows that are already dealt to folds, once per fold; ``FoldSums`` needs no copies.


def standardize(rows: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Both sides scaled by the train mean and sample std of their fold; a std
    under 1e-12 counts as 1."""
    train = F.col("side") == "train"
    stats = rows.groupBy(*keys).agg(
        *[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in cols],
        *[F.stddev_samp(F.when(train, F.col(c))).alias(f"_s_{c}") for c in cols],
    )
    d = rows.join(stats, list(keys))
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
        for c in cols
    }
    return d.withColumns(scaled).select(*rows.columns)


def _gram(rows: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str]) -> DataFrame:
    """Sums of all products of (1, x..., y) over the train rows, one row per key."""
    one = ["_one", *xs, y]
    d = rows.where(F.col("side") == "train").withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(one)) for j in range(i, len(one))]
    return d.groupBy(*keys).agg(
        *[F.sum(F.col(one[i]) * F.col(one[j])).alias(f"g_{i}_{j}") for i, j in pairs]
    )


def solve_linear(
    rows: DataFrame,
    xs: Sequence[str],
    y: str,
    keys: Sequence[str] = ("fold",),
    subsets: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Least squares per key from its Gram sums: one small solve per row.

    ``subsets`` fits several feature sets from the same sums; the result then
    carries the set's name in ``subset``. Unused features get weight 0.
    """
    k = len(xs)
    sets = subsets or {"all": list(xs)}
    gram = _gram(rows, xs, y, keys)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in gram.schema.fields if f.name in keys]
    schema = ", ".join([*fields, "subset string", "bias double", "weights array<double>"])

    def solve(parts):
        for pdf in parts:
            out = []
            for _, r in pdf.iterrows():
                g = np.empty((k + 2, k + 2))
                for i in range(k + 2):
                    for j in range(i, k + 2):
                        g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
                for name, cols in sets.items():
                    use = [0] + [1 + xs.index(c) for c in cols]
                    beta, *_ = np.linalg.lstsq(g[np.ix_(use, use)], g[use, k + 1], rcond=None)
                    w = [0.0] * k
                    for pos, b in zip(use[1:], beta[1:], strict=True):
                        w[pos - 1] = float(b)
                    out.append([*[r[c] for c in keys], name, float(beta[0]), w])
            yield pd.DataFrame(out, columns=[*keys, "subset", "bias", "weights"])

    return gram.mapInPandas(solve, schema)


def predict_linear(rows: DataFrame, model: DataFrame, xs: Sequence[str], keys=("fold",)):
    """Predictions on the test side."""
    d = rows.where(F.col("side") == "test").join(model, list(keys))
    dot = F.col("bias")
    for i, c in enumerate(xs):
        dot = dot + F.col("weights")[i] * F.col(c)
    return d.withColumn("pred", dot).drop("weights")


def feature_subsets(pool: Sequence[str], most: int) -> dict[str, list[str]]:
    """All combinations of one to ``most`` features."""
    return {
        "+".join(c): list(c) for k in range(1, most + 1) for c in combinations(pool, k)
    }


def degenerate_bets(preds: DataFrame, s: Ordered, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Does the bias outweigh every signal? Long, short and flat shares and
    sign flips of the test predictions. ``preds``: fold, bias, pred."""
    d = rolling(
        preds,
        s,
        lambda w: {"_flip": F.signum("pred") != F.signum(F.lag("pred").over(w))},
        back=1,
    )
    sig = F.col("pred") - F.col("bias")
    return d.groupBy(*keys).agg(
        F.max(F.abs(sig)).alias("max_abs_signal"),
        F.max(F.abs("bias")).alias("abs_bias"),
        (F.max(F.abs("bias")) > F.max(F.abs(sig))).alias("degenerate"),
        F.avg((F.col("pred") > 0).cast("double")).alias("frac_long"),
        F.avg((F.col("pred") < 0).cast("double")).alias("frac_short"),
        F.avg((F.col("pred") == 0).cast("double")).alias("frac_flat"),
        F.count_if("_flip").alias("sign_flips"),
    )


def month_scores(
    panel: DataFrame, grid: Sequence[tuple[int, float, float]], unit: str = "month"
) -> DataFrame:
    """Score of each grid point in each period: mean over symbols of the mean
    over the std of entry[t-1] * return[t] within the period.

    ``grid`` is small; a (symbol, period) group is bounded by the calendar.
    """
    d = panel.select("symbol", "datetime", "close", F.date_trunc(unit, "datetime").alias("month"))
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("gid"), F.lit(a).alias("L"), F.lit(b).alias("theta"),
                F.lit(c).alias("alpha"),
            )
            for i, (a, b, c) in enumerate(grid)
        ]
    )
    d = d.withColumn("_g", F.explode(points)).select("symbol", "datetime", "close", "month", "_g.*")
    w = Window.partitionBy("symbol", "month", "gid").orderBy("datetime")
    ls = sorted({g[0] for g in grid})

    def roc(k: int) -> Column:
        back = F.log(F.lag("close", 1).over(w)) - F.log(F.lag("close", k + 1).over(w))
        return F.when(F.col("L") == k, back)

    d = d.withColumn("_roc", F.coalesce(*[roc(k) for k in ls]))
    d = d.withColumn(
        "_e",
        F.when(F.col("_roc") > F.col("theta"), 1.0)
        .when(F.col("_roc") < -F.col("theta"), -1.0)
        .otherwise(0.0),
    )
    d = d.withColumn("_r", F.coalesce(log_return(w), F.lit(0.0)))
    d = d.withColumn("_pnl", F.coalesce(F.lag("_e").over(w) * F.col("_r"), F.lit(0.0)))
    g = d.groupBy("month", "gid", "L", "theta", "alpha", "symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_pnl").alias("_m"), F.stddev_pop("_pnl").alias("_s")
    )
    g = g.where((F.col("_n") >= F.col("L") + 10) & (F.col("_s") > 1e-10))
    return g.groupBy("month", "gid", "L", "theta", "alpha").agg(
        F.avg(F.col("_m") / F.col("_s")).alias("score")
    )


def month_choice(scores: DataFrame, months: DataFrame, first: tuple) -> DataFrame:
    """Best point of each month, applied to the next month; ties go to the
    first grid point, and a month without any score keeps the first point."""
    best = scores.groupBy("month").agg(
        F.max_by(F.struct("L", "theta", "alpha", "score"), F.struct("score", -F.col("gid"))).alias("_b")
    )
    w = Window.orderBy("month")  # one row per calendar month
    nxt = months.select("month", F.lead("month").over(w).alias("applied_month"))
    d = nxt.where(F.col("applied_month").isNotNull()).join(best, "month", "left")
    pick = [
        F.coalesce(F.col(f"_b.{n}"), F.lit(v)).alias(n)
        for n, v in zip(("L", "theta", "alpha"), first, strict=True)
    ]
    return d.select("applied_month", *pick, F.col("_b.score").alias("score"))


def correlation_graph(
    returns: DataFrame, lookback: int, threshold: float, s: Ordered = BARS, ret: str = "log_return"
) -> DataFrame:
    """Edges (datetime, a, b, rho) where the correlation over the ``lookback``
    bars before a bar reaches the threshold; both names must have every bar.

    A window that ends on bar t gives the edge of bar t + 1. Pairs are worked on in tiles
    of names and bars, see ``pairs``.
    """
    t = s.order[0]
    bars = positions(returns, s)
    bars = materialize(rolling(bars, s.by(), lambda w: {"_next": F.lead(t).over(w)}, 0, 1))
    d = returns.where(F.col(ret).isNotNull()).join(bars.select(t, "_i"), t)
    d = rolling_correlation(d, "symbol", "_i", ret, lookback, threshold)
    d = d.join(bars.where(F.col("_next").isNotNull()).select("_i", F.col("_next").alias(t)), "_i")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return d.select(t, low.alias("a"), high.alias("b"), "rho")


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean and median degree over dates and nodes; ``nodes`` lists them all."""
    ends = edges.select("datetime", F.col("a").alias("symbol")).unionByName(
        edges.select("datetime", F.col("b").alias("symbol"))
    )
    deg = ends.groupBy("datetime", "symbol").agg(F.count(F.lit(1)).alias("degree"))
    d = nodes.join(deg, ["datetime", "symbol"], "left").na.fill(0, ["degree"])
    d = d.withColumn("degree", F.col("degree").cast("double"))
    q = quantiles(d, [], "degree", {"median_degree": 0.5})
    m = d.agg(F.avg("degree").alias("mean_degree"), F.count(F.lit(1)).alias("n"))
    return m.crossJoin(F.broadcast(q))  # one row each


def logistic_by_fold(sums: FoldSums, folds: DataFrame, y: str, reg: float, rounds: int = 25, tol: float = 1e-9) -> DataFrame:
    """Test rows with ``prob`` of a ridge logistic model on standardized features.

    All folds take their Newton steps together: a round is one aggregate over the train
    rows, whose fold lists come from the timestamp, and the driver solves one small system
    per fold. The penalty is reg / 2 times the squared weights, on the mean loss.
    """
    xs, k, t = sums.xs, len(sums.xs), sums.t
    scale = {r["fold"]: (r["means"], r["scales"]) for r in sums.models(folds, sums.targets[0]).collect()}  # a row per fold
    beta = {f: np.zeros(k + 1) for f in scale}
    open_folds = set(beta)
    spread = folds.select("fold", F.explode(F.sequence("train_start", F.col("train_end") - 1)).alias("_i"))
    times = materialize(spread.join(sums.bars, "_i").select("fold", t))
    spark = sums.rows.sparkSession
    schema = "fold int, beta array<double>, means array<double>, scales array<double>"

    def with_margin(rows: DataFrame, which: Sequence[int]) -> tuple[DataFrame, list[Column]]:
        table = spark.createDataFrame([(f, beta[f].tolist(), *scale[f]) for f in which], schema)
        d = rows.join(F.broadcast(table), "fold")  # a row per fold
        z = [F.lit(1.0), *[(F.col(c) - F.col("means")[i]) / F.col("scales")[i] for i, c in enumerate(xs)]]
        d = d.withColumns({f"_z{i}": c for i, c in enumerate(z)})
        margin = F.lit(0.0)
        for i in range(k + 1):
            margin = margin + F.col("beta")[i] * F.col(f"_z{i}")
        return d.withColumn("prob", 1 / (1 + F.exp(-margin))), [F.col(f"_z{i}") for i in range(k + 1)]

    for _ in range(rounds):
        if not open_folds:
            break
        d, z = with_margin(sums.rows.join(times, t), sorted(open_folds))
        miss, w = F.col("prob") - F.col(y), F.col("prob") * (1 - F.col("prob"))
        aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(miss * z[i]).alias(f"g{i}") for i in range(k + 1)]]
        aggs += [F.sum(w * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
        for r in d.groupBy("fold").agg(*aggs).collect():  # a row per fold
            b, ridge = beta[r["fold"]], np.diag([0.0] + [reg] * k)
            g = np.array([r[f"g{i}"] for i in range(k + 1)]) / r["n"] + ridge @ b
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) / r["n"] + ridge
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            beta[r["fold"]] = b - step
            if np.abs(step).max() < tol:
                open_folds.discard(r["fold"])
    d, _ = with_margin(sums.test_rows(folds), sorted(beta))
    return d.select(*sums.rows.columns, "fold", "prob")


def ladder_baselines(sums: FoldSums, folds: DataFrame, up: str, one_day: str, sixty: str, label: str,
                     known: str) -> DataFrame:
    """Four baselines on the test side: train majority class, sign of the last
    day, sign of the trailing return (0 when unknown), and a bull / bear /
    sideways label, where sideways takes the majority class. ``up`` and ``known`` are targets of
    ``sums``: 1 in the rising class and else 0, and 1 in rows that have a class."""
    rising, all_rows = (F.col(f"g_0_{1 + len(sums.xs) + sums.targets.index(c)}") for c in (up, known))
    share = F.try_divide(rising, all_rows)
    maj = sums.of(folds).select("fold", F.when(share >= 0.5, 1).otherwise(-1).alias("m0a"))
    d = sums.test_rows(folds).join(maj, "fold")
    lab = F.col(label)
    return d.withColumns(
        {
            "m0b": F.coalesce(F.col(one_day), F.lit(0)).cast("int"),
            "m0c": F.coalesce(F.col(sixty), F.lit(0)).cast("int"),
            "m0d": F.when(lab == "bull", 1)
            .when(lab == "bear", -1)
            .when(lab == "sideways", F.col("m0a")),
        }
    )


def balanced_accuracy(preds: DataFrame, y: str, models: Sequence[str], keys: Sequence[str] = ()):
    """Mean recall over the classes with support, per model."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])
    )
    d = preds.select(*keys, F.col(y).alias("_y"), cells.alias("_c")).select(*keys, "_y", "_c.*")
    rec = d.groupBy(*keys, "model", "_y").agg(
        F.avg((F.col("p") == F.col("_y")).cast("double")).alias("_rec"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("p") == F.col("_y")).alias("_hit"),
    )
    return rec.groupBy(*keys, "model").agg(
        F.avg("_rec").alias("balanced_accuracy"),
        ratio(F.sum("_hit"), F.sum("_n")).alias("accuracy"),
        F.sum("_n").alias("n"),
    )


def series_lengths(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


