"""Costs, profit and loss, metrics and baselines (inventory 2.F)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import log_return, ratio
from ..functions.ordered import BARS, CALENDAR, Ordered, equity, quantiles, rolling, row_index
from .features import hash_int
from .xs import dollar_neutral_weights

# Exchange contract specifications (tick, tick value, commission).
CONTRACT_SPECS = {
    "CL": (0.01, 10.0, 2.50),
    "BZ": (0.01, 10.0, 2.50),
    "NG": (0.001, 10.0, 2.50),
    "HO": (0.0001, 4.20, 2.50),
    "RB": (0.0001, 4.20, 2.50),
    "GC": (0.10, 10.0, 2.50),
    "SI": (0.005, 25.0, 2.50),
    "PL": (0.10, 5.0, 2.50),
    "PA": (0.10, 10.0, 2.50),
    "ZC": (0.0025, 12.50, 2.50),
    "ZW": (0.0025, 12.50, 2.50),
    "KE": (0.0025, 12.50, 2.50),
    "ZS": (0.0025, 12.50, 2.50),
    "ZL": (0.0001, 6.0, 2.50),
    "ZM": (0.10, 10.0, 2.50),
    "ES": (0.25, 12.50, 2.50),
    "6A": (0.0001, 10.0, 2.50),
    "6B": (0.0001, 6.25, 2.50),
    "6C": (0.0001, 10.0, 2.50),
    "6E": (0.00005, 6.25, 2.50),
    "6J": (0.0000005, 6.25, 2.50),
    "6S": (0.0001, 12.50, 2.50),
}
THIN_PRODUCTS = ("PA", "PL", "KE")

def turnover(w, position: str = "position") -> Column:
    """|change of position|; the first row pays its whole position."""
    return F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0)))


def trade_frame(df: DataFrame, pred: str, y: str, s: Ordered, threshold: float = 0.0):
    """Position from the sign of the prediction outside a no-trade band."""
    live = F.abs(pred) > threshold
    d = df.withColumn("position", F.when(live, F.signum(pred)).otherwise(0.0))
    d = d.withColumn("is_won", F.when(live, F.signum(pred) == F.signum(y)))
    d = d.withColumn("trade_log_return", F.col("position") * F.col(y))
    return equity(d, s, {"trade_log_return": ("equity_curve", "drawdown_log_return")})


def add_trading_costs(trades: DataFrame, s: Ordered, fee: float, slippage: float = 1e-4):
    """Turnover cost as a log return, and the net return, equity and drawdown."""
    d = rolling(trades, s, lambda w: {"turnover": turnover(w)}, back=1)
    return net_of(d, s, F.lit(fee + slippage) * F.col("turnover"))


def net_of(d: DataFrame, s: Ordered, cost: Column) -> DataFrame:
    d = d.withColumn("cost_log_return", F.log(1 - cost))
    d = d.withColumn("trade_log_return_net", F.col("trade_log_return") + F.col("cost_log_return"))
    return equity(d, s, {"trade_log_return_net": ("equity_curve_net", "drawdown_log_return_net")})


def flat_fees(trades: DataFrame, fees: Mapping[str, float]) -> DataFrame:
    """fee * (entry value + exit value) for each named fee."""
    both = F.col("entry_trade_value") + F.col("exit_trade_value")
    return trades.withColumns({f"tx_fee_{n}": both * fee for n, fee in fees.items()})


def fees_log(trades: DataFrame, s: Ordered, fees: Mapping[str, float]) -> DataFrame:
    """Turnover fees as log returns and the net curve for each named fee."""
    d = rolling(trades, s, lambda w: {"_turn": turnover(w)}, back=1)
    for n, fee in fees.items():
        d = d.withColumn(f"tx_fee_log_{n}", F.log(1 - fee * F.col("_turn")))
        d = d.withColumn(
            f"trade_log_return_net_{n}", F.col("trade_log_return") + F.col(f"tx_fee_log_{n}")
        )
    d = equity(
        d,
        s,
        {f"trade_log_return_net_{n}": (f"equity_curve_net_{n}", f"_dd_{n}") for n in fees},
    )
    return d.drop("_turn", *[f"_dd_{n}" for n in fees])


def cost_summary(keys: Sequence[str], ann: float) -> list[Column]:
    per_year = ann * ann
    t = F.coalesce(F.avg("turnover"), F.lit(0.0))
    drag = -F.coalesce(F.avg("cost_log_return"), F.lit(0.0)) * per_year
    return [
        t.alias("mean_turnover_per_bar"),
        (t * per_year).alias("turnover_per_year"),
        drag.alias("annual_fee_drag_log"),
        F.expm1(drag).alias("annual_fee_drag_pct"),
    ]


def metric_cols(ret: str, drawdown: str, ann: float, suffix: str = "") -> list[Column]:
    """The summary of one return series as aggregates."""
    total = F.coalesce(F.sum(ret), F.lit(0.0))
    sd = F.coalesce(F.stddev_samp(ret), F.lit(0.0))
    sharpe = F.when(sd != 0, F.try_divide(F.avg(ret), sd) * ann).otherwise(0.0)
    return [
        total.alias(f"total_log_return{suffix}"),
        (F.exp(total) - 1).alias(f"compound_return{suffix}"),
        sd.alias(f"std{suffix}"),
        sharpe.alias(f"sharpe{suffix}"),
        F.coalesce(F.min(drawdown), F.lit(0.0)).alias(f"max_drawdown{suffix}"),
    ]


def series_metrics(df: DataFrame, s: Ordered, ret: str, ann: float) -> DataFrame:
    """n, total, compound, std, Sharpe and max drawdown per series."""
    d = equity(df, s, {ret: ("_eq", "_dd")})
    return d.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("no_bars"), *metric_cols(ret, "_dd", ann)
    )


def eval_metrics(trades: DataFrame, keys: Sequence[str], ann: float) -> DataFrame:
    """The summary of a trade frame."""
    r = F.col("trade_log_return")
    traded = F.col("position") != 0
    n = F.count(F.lit(1))
    nt = F.count(F.when(traded, 1))
    win = F.coalesce(F.avg(F.when(traded, F.col("is_won").cast("double"))), F.lit(0.0))
    avg_win = F.coalesce(F.avg(F.when(traded & F.col("is_won"), r)), F.lit(0.0))
    avg_loss = F.coalesce(F.avg(F.when(traded & ~F.col("is_won"), r)), F.lit(0.0))
    g = trades.groupBy(*keys).agg(
        n.alias("no_bars"),
        nt.alias("no_trades"),
        (nt / n).alias("frac_time_in_market"),
        win.alias("win_rate"),
        avg_win.alias("avg_win"),
        avg_loss.alias("avg_loss"),
        F.max(r).alias("best_trade"),
        F.min(r).alias("worst_trade"),
        F.min("equity_curve").alias("equity_trough"),
        F.max("equity_curve").alias("equity_peak"),
        *metric_cols("trade_log_return", "drawdown_log_return", ann),
    )
    ev = F.col("win_rate") * F.col("avg_win") + (1 - F.col("win_rate")) * F.col("avg_loss")
    return g.withColumn("ev", ev)


def stitched_metrics(costed: DataFrame, keys: Sequence[str], ann: float) -> DataFrame:
    """Gross and net metrics, win rate and cost summary of a costed trade frame."""
    traded = F.col("position") != 0
    n = F.count(F.lit(1))
    return costed.groupBy(*keys).agg(
        n.alias("no_bars"),
        F.count(F.when(traded, 1)).alias("no_trades"),
        (F.count(F.when(traded, 1)) / n).alias("frac_time_in_market"),
        F.coalesce(F.avg(F.when(traded, F.col("is_won").cast("double"))), F.lit(0.0)).alias(
            "win_rate"
        ),
        *metric_cols("trade_log_return", "drawdown_log_return", ann),
        *metric_cols("trade_log_return_net", "drawdown_log_return_net", ann, "_net"),
        *cost_summary(keys, ann),
    )


def buy_and_hold(df: DataFrame, s: Ordered, price: str = "close", position: float = 1.0):
    """Log return series of a constant position; the first row returns 0."""
    d = rolling(
        df.select(*s.keys, *s.order, price), s, lambda w: {"_r": log_return(w, price)}, back=1
    )
    r = F.coalesce("_r", F.lit(0.0)) * position
    d = d.select(*s.keys, *s.order, r.alias("trade_log_return"))
    return equity(d, s, {"trade_log_return": ("equity_curve", "drawdown_log_return")})


def random_positions(df: DataFrame, s: Ordered, seeds: int, ann: float, price: str = "close"):
    """Sharpe and return of coin-flip positions, one row per series and seed."""
    d = buy_and_hold(df, s, price).select(*s.keys, *s.order, "trade_log_return")
    d = d.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    stamp = F.unix_seconds(F.col(s.order[0]).cast("timestamp"))
    flip = F.when(hash_int("seed", *s.keys, stamp.cast("string")) % 2 == 0, 1.0).otherwise(-1.0)
    r = flip * F.col("trade_log_return")
    g = d.groupBy(*s.keys, "seed").agg(
        F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"), F.sum(r).alias("total_log_return")
    )
    return g.select(
        *s.keys,
        "seed",
        F.when(F.col("_s") != 0, F.try_divide("_m", "_s") * ann).otherwise(0.0).alias("sharpe"),
        "total_log_return",
        (F.exp("total_log_return") - 1).alias("compound_return"),
    )


def equal_weight_basket(panel: DataFrame, target: str = "fwd_return_1") -> DataFrame:
    return panel.groupBy("datetime").agg(F.avg(target).alias("trade_log_return"))


def portfolio_turnover(weights: DataFrame, keys: Sequence[str] = (), s: Ordered = BARS):
    """Sum over symbols of |change of weight| per bar."""
    d = rolling(weights, s.by(*keys, "symbol"), lambda w: {"_t": turnover(w, "weight")}, back=1)
    return d.groupBy(*keys, "datetime").agg(F.sum("_t").alias("turnover"))


def portfolio_frame(
    weights: DataFrame,
    returns: DataFrame,
    target: str,
    keys: Sequence[str] = (),
    s: Ordered = BARS,
) -> DataFrame:
    """One row per bar: weighted forward return and turnover."""
    r = returns.select("datetime", "symbol", target)
    gross = (
        weights.join(r, ["datetime", "symbol"])
        .groupBy(*keys, "datetime")
        .agg(F.sum(F.col("weight") * F.col(target)).alias("trade_log_return"))
    )
    return gross.join(portfolio_turnover(weights, keys, s), [*keys, "datetime"])


def portfolio_costs(
    frame: DataFrame, fee: float, slippage: float = 1e-4, keys=(), s: Ordered = BARS
) -> DataFrame:
    return net_of(frame, s.by(*keys), F.lit(fee + slippage) * F.col("turnover"))


def portfolio_metrics(
    frame: DataFrame, ann: float, fee: float, slippage: float = 1e-4, keys=(), s: Ordered = BARS
) -> DataFrame:
    """Gross and net metrics with the cost summary, one row per key."""
    d = portfolio_costs(frame, fee, slippage, keys, s)
    return frame_metrics(d, ann, keys, s)


def frame_metrics(costed: DataFrame, ann: float, keys=(), s: Ordered = BARS) -> DataFrame:
    d = equity(costed, s.by(*keys), {"trade_log_return": ("_eq", "_dd")})
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("no_bars"),
        *metric_cols("trade_log_return", "_dd", ann),
        *metric_cols("trade_log_return_net", "drawdown_log_return_net", ann, "_net"),
        *cost_summary(keys, ann),
    )
    return g


def random_rankings(
    panel: DataFrame,
    seeds: int,
    ann: float,
    fee: float,
    target: str = "fwd_return_1",
    s: Ordered = BARS,
    **kw,
) -> DataFrame:
    """The weights, turnover and cost path under random rankings, by seed."""
    d = panel.select("datetime", "symbol", target)
    d = d.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    stamp = F.unix_seconds("datetime").cast("string")
    d = d.withColumn("_pred", hash_int("seed", "symbol", stamp))
    w = dollar_neutral_weights(d, "_pred", keys=("seed", "datetime"), **kw)
    f = portfolio_frame(w, panel, target, ("seed",), s)
    m = portfolio_metrics(f, ann, fee, keys=("seed",), s=s)
    return m.select(
        "seed",
        F.col("sharpe_net").alias("sharpe"),
        F.col("total_log_return_net").alias("total_log_return"),
        F.col("compound_return_net").alias("compound_return"),
    )


def spec_columns(product: Column | str, specs: Mapping[str, tuple] = CONTRACT_SPECS):
    """Tick, tick value and commission looked up by product."""
    p = F.col(product) if isinstance(product, str) else product
    m = F.create_map(
        *[
            x
            for k, v in specs.items()
            for x in (F.lit(k), F.array(*[F.lit(float(q)) for q in v]))
        ]
    )
    spec = F.try_element_at(m, p)
    return [F.try_element_at(spec, F.lit(i)) for i in (1, 2, 3)]


def round_turn_cost(
    product: Column | str,
    ticks: float = 1.0,
    specs: Mapping[str, tuple] = CONTRACT_SPECS,
    thin: Sequence[str] = THIN_PRODUCTS,
) -> Column:
    """Commission plus slippage ticks; thin products pay double slippage."""
    p = F.col(product) if isinstance(product, str) else product
    _, value, commission = spec_columns(p, specs)
    wide = F.when(p.isin(list(thin)), 2.0).otherwise(1.0)
    return commission + value * ticks * wide


def cost_per_notional(
    product: Column | str,
    price: Column | str,
    ticks: float = 1.0,
    specs: Mapping[str, tuple] = CONTRACT_SPECS,
    thin: Sequence[str] = THIN_PRODUCTS,
) -> Column:
    """Round-turn cost as a share of contract notional, 0 without notional."""
    tick, value, _ = spec_columns(product, specs)
    c = F.col(price) if isinstance(price, str) else price
    notional = F.abs(c) * value / tick
    cost = round_turn_cost(product, ticks, specs, thin)
    return F.when(notional > 0, F.try_divide(cost, notional)).otherwise(0.0)


def multi_leg_cost(legs: str, specs: Mapping[str, tuple] = CONTRACT_SPECS, thin=THIN_PRODUCTS):
    """Sum of the round-turn costs of the products in an array column."""
    return F.aggregate(
        F.transform(legs, lambda p: round_turn_cost(p, 1.0, specs, thin)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def futures_costs(
    weights: DataFrame,
    prices: DataFrame,
    specs: Mapping[str, tuple],
    thin: Sequence[str] = (),
    s: Ordered = BARS,
) -> DataFrame:
    """Per-bar cost share: |change of weight| times the cost per notional."""
    d = rolling(weights, s, lambda w: {"_t": turnover(w, "weight")}, back=1)
    d = d.join(prices.select("datetime", "symbol", "close"), ["datetime", "symbol"])
    d = d.where(F.col("close").isNotNull())
    unit = cost_per_notional("symbol", "close", 1.0, specs, thin)
    return d.groupBy("datetime").agg(F.sum(F.col("_t") * unit).alias("cost_frac"))


def add_futures_costs(frame: DataFrame, costs: DataFrame, s: Ordered = BARS) -> DataFrame:
    d = frame.join(costs, "datetime", "left").na.fill(0.0, ["cost_frac"])
    return net_of(d, s.by(), F.col("cost_frac"))


def futures_metrics(frame: DataFrame, costs: DataFrame, ann: float, s: Ordered = BARS):
    """Metrics net of per-product costs, and whether net Sharpe <= gross."""
    m = frame_metrics(add_futures_costs(frame, costs, s), ann, (), s)
    return m.withColumn("cost_ok", F.col("sharpe_net") <= F.col("sharpe") + 1e-9)


def feature_coverage(panel: DataFrame, feature: str) -> DataFrame:
    """Rows and symbols with a value of the feature."""
    have = F.col(feature).isNotNull()
    return panel.agg(
        F.count(F.lit(1)).alias("n_total_rows"),
        F.count(feature).alias("n_rows_with"),
        (F.count(feature) / F.count(F.lit(1))).alias("frac_rows_with"),
        F.countDistinct(F.when(have, F.col("symbol"))).alias("n_symbols_with"),
        F.countDistinct("symbol").alias("n_symbols_total"),
    )


def book_metrics(
    book: DataFrame, trades: DataFrame, start_equity: float, reasons: Sequence[str], rest: str
) -> DataFrame:
    """Risk summary of an equity table (date, equity) and its trade table
    (ret_eq, exit_reason); exits outside ``reasons`` count as ``rest``."""
    s = CALENDAR
    d = rolling(
        book, s, lambda w: {"_r": ratio(F.col("equity"), F.lag("equity").over(w)) - 1}, back=1
    )
    from ..functions.ordered import running

    d = running(d, s, {"_peak": ("max", F.col("equity"))})
    e = d.agg(
        F.avg("_r").alias("_m"),
        F.stddev_pop("_r").alias("_s"),
        F.min(F.col("equity") / F.col("_peak") - 1).alias("max_drawdown"),
        F.max_by("equity", "date").alias("final_equity"),
    )
    named = [
        F.count(F.when(F.col("exit_reason") == x, 1)).alias(f"n_{x}_exits") for x in reasons
    ]
    t = trades.agg(
        F.sum("ret_eq").alias("fixed_notional_return"), F.count(F.lit(1)).alias("n_trades"), *named
    )
    other = F.col("n_trades")
    for x in reasons:
        other = other - F.col(f"n_{x}_exits")
    path = F.col("final_equity") / start_equity - 1
    return e.crossJoin(F.broadcast(t)).select(  # one row each
        F.when(F.col("_s") > 0, F.try_divide("_m", "_s") * (252.0**0.5)).alias("sharpe"),
        "max_drawdown",
        "fixed_notional_return",
        path.alias("equity_path_return"),
        ratio(path, F.abs("max_drawdown")).alias("return_over_drawdown"),
        "n_trades",
        *[f"n_{x}_exits" for x in reasons],
        other.alias(f"n_{rest}_exits"),
        "final_equity",
    )


def pnl_atr(pnl: Column, qty: Column, atr: Column) -> Column:
    return ratio(pnl, qty * atr)


def ret_eq(pnl: Column, equity_at_open: Column) -> Column:
    return ratio(pnl, equity_at_open)


def trade_atlas(trades: DataFrame, stop: str, target: str) -> DataFrame:
    """Median split by P&L per ATR: extremity and stop share of each half,
    excursion medians by outcome, exit profile and loss-to-win asymmetry."""
    med = quantiles(trades, [], "pnl_atr", {"_med": 0.5})
    d = trades.crossJoin(F.broadcast(med))  # one row
    d = d.withColumn("half", F.when(F.col("pnl_atr") >= F.col("_med"), "top").otherwise("worst"))
    d = d.withColumn("_z", F.abs("entry_z"))
    half = quantiles(d, ["half"], "_z", {"median_abs_entry_z": 0.5})
    frac = d.groupBy("half").agg(
        F.avg((F.col("exit_reason") == stop).cast("double")).alias("stop_fraction"),
        F.count(F.lit(1)).alias("n"),
    )
    parts = half.join(frac, "half")
    by = trades.groupBy("exit_reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pnl_atr").alias("mean_pnl_atr")
    )
    mae = quantiles(trades, ["exit_reason"], "mae_atr", {"median_mae": 0.5})
    mfe = quantiles(trades, ["exit_reason"], "mfe_atr", {"median_mfe": 0.5})
    by = by.join(mae, "exit_reason").join(mfe, "exit_reason")
    asym = by.agg(
        F.abs(
            ratio(
                F.max(F.when(F.col("exit_reason") == stop, F.col("mean_pnl_atr"))),
                F.max(F.when(F.col("exit_reason") == target, F.col("mean_pnl_atr"))),
            )
        ).alias("v")
    )

    def long(df: DataFrame, group: Column, cols: Sequence[str]) -> DataFrame:
        cells = F.explode(
            F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in cols])
        )
        return df.select(group.alias("grp"), cells.alias("_c")).select("grp", "_c.stat", "_c.v")

    return (
        long(parts, F.col("half"), ["n", "median_abs_entry_z", "stop_fraction"])
        .unionByName(
            long(by, F.col("exit_reason"), ["n", "mean_pnl_atr", "median_mae", "median_mfe"])
        )
        .unionByName(
            asym.select(F.lit("all").alias("grp"), F.lit("loss_win_asymmetry").alias("stat"), "v")
        )
    )


def breakeven_cost(frame: DataFrame, gross: str, turn: str, grid_bps: Sequence[float]) -> DataFrame:
    """First cost on the grid at which the mean net return is not positive."""
    d = frame.select(
        F.col(gross).alias("_g"),
        F.col(turn).alias("_t"),
        F.explode(F.array(*[F.lit(float(b)) for b in grid_bps])).alias("bps"),
    )
    net = F.col("_g") - F.col("bps") / 1e4 * F.col("_t")
    g = d.groupBy("bps").agg(F.avg(net).alias("_m"), F.stddev_pop(net).alias("_s"))
    sh = F.when(F.col("_s") > 1e-12, F.try_divide("_m", "_s"))
    g = g.withColumn("_sh", sh)
    base = F.max(F.when(F.col("bps") == 0, F.col("_sh")))
    first = F.min(F.when(F.col("_sh") <= 0, F.col("bps")))
    return g.agg(F.when(base > 0, first).alias("breakeven_bps"))


def benchmark_neutrality(df: DataFrame, y: str, x: str, ann: float, keys=()) -> DataFrame:
    """Beta, annualized alpha and information ratio of the residual (n >= 30)."""
    d = df.dropna(subset=[y, x])
    fit = d.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("beta"),
        F.regr_intercept(y, x).alias("_a"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.regr_avgx(y, x).alias("_mx"),
        F.regr_avgy(y, x).alias("_my"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    mean = F.col("_my") - F.col("_a") - F.col("beta") * F.col("_mx")  # of the residual
    sd = F.sqrt(F.greatest(F.col("_syy") - F.col("beta") * F.col("_sxy"), F.lit(0.0)) / F.col("n_obs"))
    ok = F.col("n_obs") >= 30
    return fit.select(
        *keys,
        F.when(ok, F.col("beta")).alias("beta"),
        F.when(ok, F.col("_a") * 252).alias("alpha_annualized"),
        F.when(ok, sd).alias("residual_std"),
        F.when(ok, F.coalesce(F.try_divide(mean, sd), F.lit(0.0)) * ann).alias("information_ratio"),
        "n_obs",
    )


def passing_configs(rows: DataFrame, cond: Column, k: int) -> DataFrame:
    """Configs that meet the condition at k or more offsets."""
    g = rows.groupBy("config").agg(
        F.count_if(cond).alias("n_pass"), F.count(F.lit(1)).alias("n_offsets")
    )
    return g.withColumn("fires", F.col("n_pass") >= k)


def rolling_buy_and_hold(df: DataFrame, s: Ordered, length: int, step: int, ann: float):
    """Buy-and-hold metrics of every full window of ``length`` rows, stepped.

    A row is sent to the windows that hold it, so groups have ``length`` rows.
    """
    d = rolling(df.select(*s.keys, *s.order, "close"), s, lambda w: {"_r": log_return(w)}, back=1)
    d = row_index(d, s, "_i")
    n = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    first = F.greatest(F.ceil((F.col("_i") - length) / step), F.lit(0))
    last = F.floor((F.col("_i") - 1) / step)
    d = d.join(n, list(s.keys))
    d = d.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    d = d.where(F.col("_k") * step + length <= F.col("_n"))
    r = F.when(F.col("_i") - 1 == F.col("_k") * step, 0.0).otherwise(F.coalesce("_r", F.lit(0.0)))
    d = d.withColumn("_r", r)
    w = Window.partitionBy(*s.keys, "_k").orderBy(*s.order)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_eq", F.sum("_r").over(w))
    d = d.withColumn("_dd", F.col("_eq") - F.max("_eq").over(w))
    return d.groupBy(*s.keys, (F.col("_k") * step).alias("start_row")).agg(
        F.min(s.order[0]).alias("window_start"), *metric_cols("_r", "_dd", ann)
    )


def fold_excess(net: DataFrame, panel: DataFrame, folds: DataFrame, target: str) -> DataFrame:
    """Per fold, the net strategy return minus the basket return.

    ``folds`` maps each test datetime to its fold.
    """
    basket = equal_weight_basket(panel, target).withColumnRenamed("trade_log_return", "_b")
    d = folds.join(basket, "datetime", "left").join(net, "datetime", "left")
    return d.groupBy("fold").agg(
        (
            F.coalesce(F.sum("trade_log_return_net"), F.lit(0.0))
            - F.coalesce(F.sum("_b"), F.lit(0.0))
        ).alias("excess_return")
    )


def overlay_backtest(df: DataFrame, s: Ordered, ret: str, weight: str, mask: Column, cost: float,
                     ann: float) -> DataFrame:
    """Weighted returns with turnover cost, gross and net metrics on a mask."""
    d = df.withColumn("position", F.coalesce(weight, F.lit(0.0)))
    d = rolling(d, s, lambda w: {"turnover": turnover(w)}, back=1)
    d = d.where(mask & F.col(weight).isNotNull())
    d = d.withColumn("_g", F.col("position") * F.col(ret))
    d = d.withColumn("_c", F.log(F.greatest(1 - cost * F.col("turnover"), F.lit(1e-12))))
    d = d.withColumn("_net", F.col("_g") + F.col("_c"))
    d = equity(d, s, {"_g": ("_eg", "_dg"), "_net": ("_en", "_dn")})
    return d.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        *metric_cols("_g", "_dg", ann),
        *metric_cols("_net", "_dn", ann, "_net"),
        F.avg("turnover").alias("mean_turnover_per_bar"),
        (-F.avg("_c") * ann * ann).alias("annualized_fee_drag"),
    )
