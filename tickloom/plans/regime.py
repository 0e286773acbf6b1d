"""Queries over regime indicators, labels and forecasts (inventory 2.L, 2.M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import log_return, ratio, roll_mean, roll_std, zscore
from ..functions.ordered import WEEKLY, Ordered, rolling, sliding_ranks
from ..operators import curves as C
from ..operators import regime as R
from ..session import materialize
from ..sources.ingest import widen
from . import sqlgen as S
from .curves import states
from .features import baskets
from .portfolio import NAMES
from .registry import query, rounded, view
from .vol import rec_sql

YR = "sqrt(252)"
UP = "rows unbounded preceding"


def px(t):
    return t.bars_w().select("symbol", "datetime", "high", "low", "close")


view(
    "mv",
    """select symbol, datetime, high, low, close, pv, close - pv as d, ln(close / pv) as r, greatest(high - low, coalesce(abs(high - pv), 0), coalesce(abs(low - pv), 0)) as tr
from (select *, lag(close) over (partition by symbol order by datetime) as pv from bars_w)""",
)
WILDER = "select symbol, datetime, case when row_number() over ({w}) = 1 then 0 else 13.0e0 / 14 end as a, case when row_number() over ({w}) = 1 then tr else tr / 14 end as b from mv".format(
    w=S.W
)


@query("277", rec_sql(WILDER) + "select symbol, datetime, round(case when i >= 14 then v end, 4) as atr from y")
def atr(t):
    d = R.atr(px(t), WEEKLY).select("symbol", "datetime", "atr")
    return rounded(d, 4)


DMI = f"""with recursive m as (select symbol, datetime, row_number() over ({S.W}) as i, tr, case when up > dn and up > 0 then up else 0.0 end as pdm, case when dn > up and dn > 0 then dn else 0.0 end as mdm from (
 select *, high - lag(high) over ({S.W}) as up, lag(low) over ({S.W}) - low as dn from mv)),
y as (select symbol, datetime, i, cast(tr as double) as t, cast(pdm as double) as p, cast(mdm as double) as q from m where i = 1
 union all select m.symbol, m.datetime, m.i, t + (m.tr - t) / 14, p + (m.pdm - p) / 14, q + (m.mdm - q) / 14 from y join m on m.symbol = y.symbol and m.i = y.i + 1),
d as (select symbol, datetime, i, case when i >= 14 then 100 * p / nullif(t, 0) end as pdi, case when i >= 14 then 100 * q / nullif(t, 0) end as mdi from y),
x as (select *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) as dx from d),
k as (select symbol, datetime, dx, i as row, row_number() over ({S.W}) as i from x where dx is not null),
e as (select symbol, datetime, row, i, dx as v from k where i = 1
 union all select k.symbol, k.datetime, k.row, k.i, e.v + (k.dx - e.v) * (1 / 14e0) / (pow(13 / 14e0, k.row - e.row) + 1 / 14e0) from e join k on k.symbol = e.symbol and k.i = e.i + 1)"""


@query(
    "278, 299, 303",
    DMI
    + """ select d.symbol, d.datetime, round(pdi, 6) as plus_di, round(mdi, 6) as minus_di, round(case when e.i >= 14 then v end, 6) as adx
 from d left join e on d.symbol = e.symbol and d.datetime = e.datetime""",
)
def directional_movement(t):
    d = R.dmi(px(t), WEEKLY)
    return rounded(d.select("symbol", "datetime", "plus_di", "minus_di", "adx"))


def pct_sql(c: str, n: int, least: int = 60, w: str = S.W) -> str:
    f = f"over ({w} rows between {n - 1} preceding and current row)"
    return f"case when {c} is not null and count({c}) {f} >= {least} then len(list_filter(list({c}) {f}, lambda v: v <= {c})) / count({c}) {f} end"


LW = f"over ({S.W} rows between {{}} preceding and current row)"
view(
    "ind1",
    f"""select *, {S.mean("close", 20)} as s20, {S.mean("close", 50)} as s50, {S.mean("close", 100)} as s100, {S.mean("close", 200)} as s200,
 {S.std("r", 20)} * {YR} as rv20, {S.std("close", 20)} as sd20, {S.roll("sum", "r", 5)} as q5, {S.roll("var_samp", "r", 252)} as v1, lag(r) over ({S.W}) as rl,
 abs(close - lag(close, 20) over ({S.W})) / nullif({S.roll("sum", "abs(d)", 20)}, 0) as er, sign(close - lag(close, 20) over ({S.W})) as ers, ln(close / lag(close, 60) over ({S.W})) as n60,
 case when count(pv) {LW.format(250)} = 251 then regr_slope(d, pv) {LW.format(250)} end as hb,
 (close - {S.mean("close", 60, need=30)}) / nullif({S.std("close", 60, need=30)}, 0) as z60 from mv""",
)
VR = f"({S.roll('var_samp', 'q5', 252)}) / nullif(5 * v1, 0)"
view(
    "ind2",
    f"""select symbol, datetime, (close - s200) / nullif(s200, 0) as trend_price_vs_ma, n60 as trend_nday_log_return, greatest(0, least(1, er)) * ers as trend_efficiency,
 (s50 - s200) / nullif(s200, 0) as trend_ma_separation, case when hb < 0 then -ln(2) / hb end as mr_half_life,
 (s100 - lag(s100, 20) over ({S.W})) / nullif(20 * s100, 0) as trend_ma_slope, {VR} - 1 as trend_variance_ratio, 1 - {VR} as mr_variance_ratio,
 2 * ({pct_sql("rv20", 252)}) - 1 as vol_realized_percentile, {S.std("rv20", 60)} as vol_of_vol, 2 * ({pct_sql("(4 * sd20 / s20)", 252)}) - 1 as vol_bollinger_percentile,
 -(case when count(case when r is not null and rl is not null then 1 end) {LW.format(59)} = 60 then corr(r, rl) {LW.format(59)} end) as mr_autocorr, abs(lag(z60) over ({S.W})) as mr_zscore_extremity from ind1""",
)
IND = [
    "trend_price_vs_ma", "trend_nday_log_return", "trend_efficiency", "trend_ma_separation", "mr_half_life", "trend_ma_slope",
    "trend_variance_ratio", "mr_variance_ratio", "vol_realized_percentile", "vol_of_vol", "vol_bollinger_percentile", "mr_autocorr", "mr_zscore_extremity",
]


@query(
    "275, 276, 279, 280, 281, 282, 283, 284, 285, 286, 287, 288, 289, 296, 297, 298, 300, 301, 302, 304, 305, 306, 308, 309, 310, 311",
    f"select symbol, datetime, {S.rnd([c for c in IND if c != 'mr_half_life'])}, round(mr_half_life, 4) as mr_half_life from ind2",
)
def price_indicators(t):
    d = R.indicator_columns(px(t), WEEKLY, adx=False).select("symbol", "datetime", *IND)
    return rounded(d.withColumn("mr_half_life", F.round("mr_half_life", 4)))


@query(
    "275, 276, 280, 284, 285, 286",
    f"""select symbol, datetime, round(s20, 4) as sma20, round(ln(close / lag(close, 10) over ({S.W})), 6) as ret10, round(rv20, 6) as rv20,
 round((s50 - lag(s50, 10) over ({S.W})) / nullif(10 * s50, 0), 6) as slope, round((s20 - s50) / nullif(s50, 0), 6) as sep, round(4 * sd20 / nullif(s20, 0), 6) as boll from ind1""",
)
def moving_averages(t):
    def first(w):
        return {
            "r": log_return(w),
            "sma20": roll_mean("close", w, 20),
            "s50": roll_mean("close", w, 50),
            "ret10": log_return(w, "close", 10),
            "sd": roll_std("close", w, 20),
        }

    def second(w):
        return {
            "rv20": roll_std("r", w, 20) * R.YEAR,
            "slope": ratio(F.col("s50") - F.lag("s50", 10).over(w), 10 * F.col("s50")),
            "sep": ratio(F.col("sma20") - F.col("s50"), "s50"),
            "boll": 4 * ratio("sd", "sma20"),
        }

    d = rolling(px(t), WEEKLY, [first, second], 80)
    d = d.withColumn("sma20", F.round("sma20", 4))
    return rounded(d.select("symbol", "datetime", "sma20", "ret10", "rv20", "slope", "sep", "boll"))


WP = "partition by product order by date"
view("curve_r", f"select *, {S.lnr('close_f1', f'lag(close_f1) over ({WP})')} as r from tcurve")
ANN = "(close_f1 / nullif(close_f2, 0) - 1) * 365.0 / nullif(dte_f2 - dte_f1, 0)"


@query(
    "290, 291, 292, 293, 294, 295, 312, 313, 314, 315, 316, 317",
    f"""select product, date, round(-(close_f3 - close_f1) / nullif(close_f1, 0), 6) as ts_curve_slope, round({S.z("(close_f1 - close_f2)", 252, WP)}, 6) as ts_calendar_spread_z,
 round({ANN}, 6) as ts_ann_roll_yield, round((close_f1 - close_f2) / nullif(close_f2, 0), 6) as ts_roll_yield, cast(cast(close_f1 - close_f2 + {R.STORAGE} + {R.FINANCING} * close_f2 / 12 as float) as double) as ts_excess_spread,
 round({ANN}, 6) as carry_ann_roll_yield, round({ANN} / nullif({S.std("r", 20, WP)} * {YR}, 0), 6) as carry_vol_scaled from curve_r""",
)
def curve_indicators(t):
    from .curves import tcurve

    d = rolling(
        tcurve(t),
        C.PRODUCT,
        [lambda w: {"_r": log_return(w, "close_f1")}, R.curve_indicators],
        260,
    )
    keep = [c for c in d.columns if c.startswith(("ts_", "carry_"))]
    d = d.withColumn("ts_excess_spread", F.col("ts_excess_spread").cast("float").cast("double"))
    return rounded(d.select("product", "date", *keep), ts_excess_spread=None)


MCOLS = {"macro_vix": "urgent", "macro_yield_curve": "high", "macro_yield_curve_3m10y": "medium", "macro_hy_oas": "not_specified", "macro_ig_oas": "low", "macro_cot_noncomm": "cot"}


def bars_date(t):
    return t.bars_w().select("symbol", F.to_date("datetime").alias("date"))


DWEEK = Ordered(("symbol",), ("date",), step=7)


def macro_daily(t):
    from .bars import PRIO_COLS, PRIORITIES

    m = widen(t.macro_long(), PRIORITIES, PRIO_COLS)
    return m.withColumn("cot", (F.col("urgent") - F.col("low")) / (F.col("urgent") + F.col("low")))


view(
    "macro_all",
    """select date, max(case when series = '1-URGENT' then value end) as urgent, max(case when series = '2-HIGH' then value end) as high, max(case when series = '3-MEDIUM' then value end) as medium,
 max(case when series = '4-NOT SPECIFIED' then value end) as not_specified, max(case when series = '5-LOW' then value end) as low from macro_long group by 1""",
)
view(
    "macro_bars",
    "select b.symbol, cast(b.datetime as date) as date, m.* exclude (date), (m.urgent - m.low) / (m.urgent + m.low) as cot from bars_w b left join macro_all m on cast(b.datetime as date) = m.date",
)
DW = "partition by symbol order by date"


@query(
    "318, 319, 320, 321, 322, 323, 324, 325",
    "select symbol, date, "
    + ", ".join(f"round({c}, 9) as {n}" for n, c in MCOLS.items())
    + f", round(not_specified - lag(not_specified, 13) over ({DW}), 9) as macro_hy_oas_delta, round(low - lag(low, 26) over ({DW}), 9) as macro_fed_funds_delta from macro_bars",
)
def macro_indicators(t):
    d = R.macro_indicators(
        bars_date(t),
        macro_daily(t),
        DWEEK,
        MCOLS,
        {"macro_hy_oas_delta": ("not_specified", 13), "macro_fed_funds_delta": ("low", 26)},
    )
    keep = [*MCOLS, "macro_hy_oas_delta", "macro_fed_funds_delta"]
    return rounded(d.select("symbol", "date", *keep), 9)


@query(
    "307",
    f"""select symbol, date, round(2 * ({pct_sql("fv", 60, 20, DW)}) - 1, 6) as vol_vix_level from (select symbol, date, last_value(urgent ignore nulls) over ({DW}) as fv from macro_bars)""",
)
def filled_macro_level(t):
    d = bars_date(t).join(macro_daily(t).select("date", "urgent"), "date", "left")
    from ..functions.ordered import running

    d = running(d, DWEEK, {"fv": ("last", F.col("urgent"))})
    d = sliding_ranks(d, DWEEK, {"rank": (F.col("fv"), 60)})
    d = d.withColumn("vol_vix_level", 2 * R.percentile_rank("rank", 20) - 1)
    return rounded(d.select("symbol", "date", "vol_vix_level"))


# ---- scores ------------------------------------------------------------------

view(
    "scored",
    f"""select symbol, datetime, z, pc, tanh(z / 2) as s1, 2 * pc - 1 as s2, case when r10 is not null then greatest(-1, least(1, (r10 - 0.0) / 0.8)) end as s3, r10 from (
 select symbol, datetime, {S.z("close", 26)} as z, {pct_sql("close", 26, 26)} as pc, ln(close / lag(close, 10) over ({S.W})) as r10 from bars_w)""",
)
MIXED = "case when case when s1 is null then 0 else 0.5 end + case when s2 is null then 0 else 0.2 end + case when s3 is null then 0 else 0.3 end >= 0.5 then (coalesce(s1 * 0.5, 0) + coalesce(s2 * 0.2, 0) + coalesce(s3 * 0.3, 0)) / nullif(case when s1 is null then 0 else 0.5 end + case when s2 is null then 0 else 0.2 end + case when s3 is null then 0 else 0.3 end, 0) end"
view("score_w", f"select *, {MIXED} as score from scored")


def score_w(t):
    def stage(w):
        z = zscore("close", w, 26)
        return {
            "z": z,
            "s1": R.squash(z),
            "r10": log_return(w, "close", 10),
        }

    d = rolling(px(t).drop("high", "low"), WEEKLY, stage, 26)
    d = sliding_ranks(d, WEEKLY, {"pc": (F.col("close"), 26)}).withColumn("pc", R.percentile_rank("pc", 26))
    d = d.withColumns({"s2": 2 * F.col("pc") - 1, "s3": R.linear_score(F.col("r10"), 0.0, 0.8)})
    parts = {c: F.col(c) for c in ("s1", "s2", "s3")}
    return d.withColumn("score", R.combine(parts, {"s1": 0.5, "s2": 0.2, "s3": 0.3}, 0.5))


@query(
    "326, 327, 328, 329, 330, 331, 349",
    f"select symbol, datetime, {S.rnd('z pc s1 s2 s3 score')} from score_w",
)
def scaled_scores(t):
    return rounded(score_w(t).select("symbol", "datetime", "z", "pc", "s1", "s2", "s3", "score"))


SMOOTH = """select symbol, datetime, case when row_number() over (partition by symbol order by datetime) = 1 then 0 else 1 - 2.0e0 / 6 end as a,
 case when row_number() over (partition by symbol order by datetime) = 1 then score else 2.0e0 / 6 * score end as b from score_w where score is not null"""


def smoothed(t):
    return R.smooth(score_w(t).select("symbol", "datetime", "score"), WEEKLY, "score", 5, "smooth")


@query(
    "332, 351",
    rec_sql(SMOOTH)
    + "select s.symbol, s.datetime, round(v, 6) as smooth from score_w s left join y on s.symbol = y.symbol and s.datetime = y.datetime",
)
def smoothed_scores(t):
    return rounded(smoothed(t).select("symbol", "datetime", "smooth"))


BANDS = R.three_bands("bear", "sideways", "bull", -0.25, 0.3)
INST = "case when score < -0.25 then 'bear' when score < 0.3 then 'sideways' when score >= 0.3 then 'bull' end"
view("lab", f"select symbol, datetime, score, {INST} as label from score_w")


def lab(t):
    d = score_w(t).select("symbol", "datetime", "score")
    return d.withColumn("label", R.instant_label(F.col("score"), BANDS))


@query("334", "select symbol, datetime, label from lab")
def instant_labels(t):
    return lab(t).select("symbol", "datetime", "label")


def hyst_sql(src: str) -> str:
    """Hysteresis by direct recursion over (symbol, datetime, score)."""
    keep = "(st.cur = 'bear' and k.score < -0.25 + 0.1) or (st.cur = 'sideways' and k.score >= -0.25 - 0.1 and k.score < 0.3 + 0.1) or (st.cur = 'bull' and k.score >= 0.3 - 0.1)"
    return f"""with recursive k as (select symbol, datetime, cast(score as double) as score, {INST} as inst, row_number() over (partition by symbol order by datetime) as i from {src} where score is not null),
st as (select symbol, datetime, i, inst as cur, cast(null as varchar) as pend, 0 as dw from k where i = 1
 union all select k.symbol, k.datetime, k.i,
  case when k.inst = st.cur or ({keep}) then st.cur when (case when k.inst = st.pend then st.dw + 1 else 1 end) >= 3 then k.inst else st.cur end,
  case when k.inst = st.cur or ({keep}) or (case when k.inst = st.pend then st.dw + 1 else 1 end) >= 3 then null else k.inst end,
  case when k.inst = st.cur or ({keep}) or (case when k.inst = st.pend then st.dw + 1 else 1 end) >= 3 then 0 when k.inst = st.pend then st.dw + 1 else 1 end
 from st join k on k.symbol = st.symbol and k.i = st.i + 1)
"""


def hyst(t):
    d = score_w(t).select("symbol", "datetime", "score")
    return R.hysteresis_labels(d, WEEKLY, "score", BANDS, 0.1, 3, "label")


@query(
    "333",
    hyst_sql("score_w")
    + "select s.symbol, s.datetime, st.cur as label from score_w s left join st on s.symbol = st.symbol and s.datetime = st.datetime",
)
def hysteresis_labels(t):
    return hyst(t).select("symbol", "datetime", "label")


@query("335")
def regime_detection(t):
    d = materialize(R.indicator_columns(px(t), WEEKLY))
    return rounded(R.detect(d, WEEKLY, R.COMMODITY))


@query("335")
def regime_detection_equity(t):
    """The equity set with the level of a macro series, one row later."""
    d = materialize(R.indicator_columns(px(t), WEEKLY))
    level = filled_macro_level(t).withColumn("datetime", F.col("date").cast("timestamp")).drop("date")
    return rounded(R.detect(d.join(level, ["symbol", "datetime"]), WEEKLY, R.EQUITY, shift=1))


@query("335")
def regime_detection_curve(t):
    return rounded(R.detect(materialize(curve_indicators(t)), C.PRODUCT, R.COMMODITY))


@query("335")
def regime_detection_macro(t):
    return rounded(R.detect(materialize(macro_indicators(t)), DWEEK, R.MACRO))


view(
    "lab2",
    """select symbol, datetime, 'trend' as dimension, score, label from lab union all
select symbol, datetime, 'level', s2, case when s2 < -0.25 then 'low' when s2 < 0.3 then 'mid' when s2 >= 0.3 then 'high' end from score_w""",
)


def lab2(t):
    d = score_w(t)
    low = R.three_bands("low", "mid", "high", -0.25, 0.3)
    cells = F.explode(
        F.array(
            F.struct(
                F.lit("trend").alias("dimension"),
                F.col("score").alias("score"),
                R.instant_label(F.col("score"), BANDS).alias("label"),
            ),
            F.struct(
                F.lit("level").alias("dimension"),
                F.col("s2").alias("score"),
                R.instant_label(F.col("s2"), low).alias("label"),
            ),
        )
    )
    return d.select("symbol", "datetime", cells.alias("_c")).select("symbol", "datetime", "_c.*")


@query(
    "336",
    """select symbol, datetime, max(case when dimension = 'trend' then label end) || '|' || max(case when dimension = 'level' then label end) as composite from lab2 group by 1, 2""",
)
def composite_labels(t):
    return R.composite_label(lab2(t), ["symbol", "datetime"], ["trend", "level"])


@query(
    "337",
    """select symbol, dimension, arg_max(label, datetime) as label, round(arg_max(score, datetime), 6) as score, max(datetime) as as_of from lab2 where label is not null group by 1, 2""",
)
def latest_labels(t):
    return rounded(R.latest(lab2(t), ["symbol", "dimension"], "datetime"))


view("members", "select symbol, basket, 1.0 + cast(substr(symbol, 8) as int) % 3 as weight from baskets")
AGG = """select basket, datetime, dimension, case when have / w >= 0.5 then sm / nullif(have, 0) end as score from (
 select m.basket, datetime, dimension, sum(case when score is not null then weight end) as have, sum(weight * score) as sm from lab2 l join members m on l.symbol = m.symbol group by 1, 2, 3) a
join (select basket as b, sum(weight) as w from members group by 1) on a.basket = b"""
view("basket_scores_v", AGG)


def members(t):
    n = F.substring("symbol", 8, 2).cast("int")
    return baskets(t).select("symbol", "basket", (1.0 + n % 3).alias("weight"))


def basket_scores_df(t):
    return R.aggregate_scores(lab2(t), members(t), ["datetime", "dimension"])


@query("338, 350", "select basket, datetime, dimension, round(score, 6) as score from basket_scores_v")
def basket_scores(t):
    return rounded(basket_scores_df(t))


@query(
    "338",
    """select a.basket, datetime, dimension, round(case when cnt / n >= 0.5 then med end, 6) as score from (
 select m.basket, datetime, dimension, count(score) as cnt, quantile_cont(score, 0.5) as med from lab2 l join members m on l.symbol = m.symbol group by 1, 2, 3) a
join (select basket, count(*) as n from members group by 1) z on a.basket = z.basket""",
)
def basket_median_scores(t):
    return rounded(
        R.aggregate_scores(lab2(t), members(t), ["datetime", "dimension"], method="median")
    )


@query(
    "339, 340",
    hyst_sql("(select basket as symbol, datetime, score from basket_scores_v where dimension = 'trend')")
    + "select b.basket, b.datetime, round(b.score, 6) as score, st.cur as label from basket_scores_v b left join st on b.basket = st.symbol and b.datetime = st.datetime where b.dimension = 'trend'",
)
def basket_labels(t):
    d = materialize(basket_scores_df(t).where("dimension = 'trend'").drop("dimension"))
    s = Ordered(("basket",), ("datetime",), step=7)
    return rounded(R.hysteresis_labels(d, s, "score", BANDS, 0.1, 3, "label"))


view(
    "lab_runs",
    """select *, sum(nw) over (partition by symbol order by datetime) as g from (select symbol, datetime, label, case when label = lag(label) over (partition by symbol order by datetime) then 0 else 1 end as nw from lab where label is not null)""",
)


@query(
    "342",
    """select symbol, state, count(*) as n_spells, round(avg(n), 6) as mean, max(n) as max, cast(quantile_cont(n, 0.5) as double) as median from (
 select symbol, g, min(label) as state, count(*) as n from lab_runs group by 1, 2) group by 1, 2""",
)
def spell_statistics(t):
    return rounded(R.spell_statistics(lab(t), WEEKLY, "label"))


@query(
    "343",
    """select symbol, label, round(count(*) / sum(count(*)) over (partition by symbol), 6) as share from lab where label is not null group by 1, 2""",
)
def occupancy(t):
    return rounded(R.occupancy(lab(t), ["symbol"], "label"))


view(
    "tm",
    """select symbol, src, dst, n, n / sum(n) over (partition by symbol, src) as share from (
 select symbol, label as src, nx as dst, count(*) as n from (select symbol, label, lead(label) over (partition by symbol order by datetime) as nx from lab where label is not null) where nx is not null group by 1, 2, 3)""",
)


def tm(t):
    return materialize(C.transitions(lab(t), WEEKLY, "label"))


@query("341", "select symbol, src, dst, n, round(share, 6) as share from tm")
def transition_matrix(t):
    return rounded(C.transitions(lab(t), WEEKLY, "label"))


@query(
    "344",
    "select symbol, src, round(1 / nullif(1 - coalesce(max(case when src = dst then share end), 0), 0), 6) as expected_remaining from tm group by 1, 2",
)
def remaining_duration(t):
    return rounded(R.remaining_duration(tm(t)))


@query(
    "345",
    """with p2 as (select a.symbol, a.src, b.dst, sum(a.share * b.share) as share from tm a join tm b on a.symbol = b.symbol and a.dst = b.src group by 1, 2, 3)
select a.symbol, a.src, b.dst, round(sum(a.share * b.share), 6) as share from p2 a join tm b on a.symbol = b.symbol and a.dst = b.src group by 1, 2, 3""",
)
def h_step_forecast(t):
    return rounded(R.h_step(tm(t), ["symbol"], 3))


view(
    "stab",
    """select l.symbol, flips / greatest(n - 1, 1) as flip_rate, n / (flips + 1) as avg_duration, n / tot as pct_time_labeled from (
 select symbol, sum(nw) - 1 as flips, count(*) as n from lab_runs group by 1) l join (select symbol, count(*) as tot from lab group by 1) t on l.symbol = t.symbol""",
)


@query("346, 347", f"select symbol, {S.rnd('flip_rate avg_duration pct_time_labeled')} from stab")
def label_stability(t):
    return rounded(R.label_stability(lab(t), WEEKLY, "label"))


@query(
    "348",
    f"""select s.symbol, {S.rnd("flip_rate avg_duration pct_time_labeled")}, round(m, 6) as max_share, m > 0.42 or flip_rate > 0.3 or pct_time_labeled < 0.9 as disqualified
from stab s join (select symbol, max(c) as m from (select symbol, count(*) / sum(count(*)) over (partition by symbol) as c from lab where label is not null group by symbol, label) group by 1) o on s.symbol = o.symbol""",
)
def quality_gate(t):
    d = lab(t)
    return rounded(
        R.quality_gate(
            R.label_stability(d, WEEKLY, "label"),
            R.occupancy(d, ["symbol"], "label"),
            ["symbol"],
            0.42,
            0.3,
            0.9,
        )
    )


STATES = ["bear", "sideways", "bull"]
PAIRS = ", ".join(
    f"sum(case when pv = '{a}' and label = '{b}' then 1 else 0 end) over ({S.W} {UP}) as c_{i}_{j}"
    for i, a in enumerate(STATES)
    for j, b in enumerate(STATES)
)
view(
    "mk0",
    f"""select symbol, datetime, label, sum(case when label is not null then 1 else 0 end) over ({S.W} {UP}) as seen, {PAIRS},
 {", ".join(f"sum(case when label = '{a}' then 1 else 0 end) over ({S.W} {UP}) as n_{i}" for i, a in enumerate(STATES))}
from (select *, lag(label) over ({S.W}) as pv from lab)""",
)
MKP = ", ".join(
    f"case when seen >= 60 and label is not null then case label "
    + " ".join(f"when '{a}' then coalesce(c_{i}_{j} / nullif(c_{i}_0 + c_{i}_1 + c_{i}_2, 0), 0)" for i, a in enumerate(STATES))
    + f" end end as p_{b}"
    for j, b in enumerate(STATES)
)
view("mk", f"select symbol, datetime, label, {MKP} from mk0")
PS = [f"p_{s}" for s in STATES]


def mk(t):
    return R.markov_forecast(lab(t).drop("score"), WEEKLY, "label", STATES, 1, 60)


@query("353", f"select symbol, datetime, {S.rnd(PS)} from mk")
def markov_forecast(t):
    return rounded(mk(t).select("symbol", "datetime", *PS))


def markov_sql(h: int) -> str:
    """The row of the label of the h-th power of the transition matrix so far."""
    n = range(len(STATES))
    q = ", ".join(f"coalesce(c_{i}_{j} / nullif(c_{i}_0 + c_{i}_1 + c_{i}_2, 0), 0) as q_{i}_{j}" for i in n for j in n)
    d = f"select symbol, datetime, label, seen, {q}, " + ", ".join(f"case when label = '{a}' then 1.0 else 0.0 end as v0_{i}" for i, a in enumerate(STATES)) + " from mk0"
    for k in range(h):
        step = ", ".join(" + ".join(f"v{k}_{i} * q_{i}_{j}" for i in n) + f" as v{k + 1}_{j}" for j in n)
        d = f"select *, {step} from ({d})"
    out = ", ".join(f"round(case when seen >= 60 and label is not null then v{h}_{j} end, 6) as p_{b}" for j, b in enumerate(STATES))
    return f"select symbol, datetime, {out} from ({d})"


@query("353", markov_sql(5))
def markov_forecast_h5(t):
    d = R.markov_forecast(lab(t).drop("score"), WEEKLY, "label", STATES, 5, 60)
    return rounded(d.select("symbol", "datetime", *PS))


@query(
    "354",
    "select symbol, datetime, "
    + ", ".join(f"round(case when seen >= 60 and label is not null then n_{i} / (n_0 + n_1 + n_2) end, 6) as p_{a}" for i, a in enumerate(STATES))
    + " from mk0",
)
def prior_forecast(t):
    d = R.prior_forecast(lab(t).drop("score"), WEEKLY, "label", STATES, 60)
    return rounded(d.select("symbol", "datetime", *PS))


@query(
    "352, 355",
    "select symbol, datetime, label as persistence, "
    + ", ".join(f"round(0.6 * case when label = '{a}' then 1 when label is not null then 0 end + 0.4 * p_{a}, 6) as b_{a}" for a in STATES)
    + " from mk",
)
def blended_forecast(t):
    d = R.blend(mk(t), "label", STATES, 0.4)
    return rounded(
        d.select("symbol", "datetime", F.col("label").alias("persistence"), *[f"b_{a}" for a in STATES])
    )


ARG = "case when p_bear >= greatest(p_sideways, p_bull) then 'bear' when p_sideways >= p_bull then 'sideways' when p_bull is not null then 'bull' end"
view(
    "ev",
    f"""select m.symbol, m.datetime, m.label as current, lead(m.label, 4) over (partition by m.symbol order by m.datetime) as target, {ARG} as pred, p_bear, p_sideways, p_bull, l.score,
 ln(lead(b.close, 4) over (partition by m.symbol order by m.datetime) / b.close) as fwd
from mk m join lab l on m.symbol = l.symbol and m.datetime = l.datetime join bars_w b on m.symbol = b.symbol and m.datetime = b.datetime""",
)


def ev(t):
    d = R.markov_forecast(lab(t), WEEKLY, "label", STATES, 1, 60)
    d = d.join(t.bars_w().select("symbol", "datetime", "close"), ["symbol", "datetime"])
    d = d.withColumn("pred", R.argmax_state(STATES)).withColumnRenamed("label", "current")

    def fwd(w):
        from ..functions.exprs import forward_return

        return {"target": F.lead("current", 4).over(w), "fwd": forward_return(w, "close", 4)}

    return rolling(d, WEEKLY, fwd, 0, 4)


@query(
    "356, 365",
    """select symbol, round(avg(case when pred = target then 1.0 else 0 end), 6) as hit_rate, count(*) as n from ev where pred is not null and target is not null group by 1""",
)
def hit_rate(t):
    return rounded(R.hit_rate(ev(t), ["symbol"], "pred", "target"))


@query(
    "357",
    "select symbol, pred, target, count(*) as n from ev where pred is not null and target is not null group by 1, 2, 3",
)
def confusion_matrix(t):
    return R.confusion(ev(t), ["symbol"], "pred", "target")


CLS = f"""select symbol, cls, count(case when pred = cls and target = cls then 1 end) / nullif(count(case when pred = cls then 1 end), 0) as precision,
 count(case when pred = cls and target = cls then 1 end) / nullif(count(case when target = cls then 1 end), 0) as recall, count(case when target = cls then 1 end) as support
from ev, (select unnest({STATES}) as cls) where pred is not null and target is not null group by 1, 2"""
view("cls", CLS)


@query(
    "358",
    "select symbol, cls, round(precision, 6) as precision, round(recall, 6) as recall, support from cls",
)
def class_statistics(t):
    return rounded(R.class_stats(ev(t), ["symbol"], "pred", "target", STATES))


@query(
    "359",
    "select symbol, round(avg(recall), 6) as balanced_accuracy from cls where support > 0 group by 1",
)
def balanced_accuracy(t):
    return rounded(
        R.balanced_accuracy(R.class_stats(ev(t), ["symbol"], "pred", "target", STATES), ["symbol"])
    )


BRIER = " + ".join(f"power(p_{a} - case when target = '{a}' then 1 else 0 end, 2)" for a in STATES)
BUNDLE = f"""select e.symbol, round(h.hr, 6) as hit_rate, h.n, round(ba, 6) as balanced_accuracy, round(tr, 6) as transition_recall, n_transitions, round(br, 6) as brier, round(ic, 6) as spearman from (select distinct symbol from ev) e
left join (select symbol, avg(case when pred = target then 1.0 else 0 end) as hr, count(*) as n from ev where pred is not null and target is not null group by 1) h on e.symbol = h.symbol
left join (select symbol, avg(recall) as ba from cls where support > 0 group by 1) b on e.symbol = b.symbol
left join (select symbol, avg(case when pred = target then 1.0 else 0 end) as tr, count(*) as n_transitions from ev where pred is not null and target is not null and current is not null and target <> current group by 1) r on e.symbol = r.symbol
left join (select symbol, avg({BRIER}) as br from ev where target is not null and p_bear is not null group by 1) q on e.symbol = q.symbol
left join (select symbol, case when count(*) >= 3 then corr(rs, rf) end as ic from (select symbol, rank() over (partition by symbol order by score) + (count(*) over (partition by symbol, score) - 1) / 2.0 as rs,
  rank() over (partition by symbol order by fwd) + (count(*) over (partition by symbol, fwd) - 1) / 2.0 as rf from (
   select * from (select *, row_number() over (partition by symbol order by datetime) as i from ev where score is not null and fwd is not null) where (i - 1) % 4 = 0)) group by 1) k on e.symbol = k.symbol"""


@query("360, 361, 362, 363", BUNDLE)
def forecast_bundle(t):
    e = materialize(ev(t))
    k = ["symbol"]
    out = e.select("symbol").distinct()
    cs = R.class_stats(e, k, "pred", "target", STATES)
    parts = [
        R.hit_rate(e, k, "pred", "target"),
        R.balanced_accuracy(cs, k),
        R.transition_recall(e, k, "pred", "target", "current"),
        R.brier(e, k, STATES, "target"),
        R.subsampled_ic(e, WEEKLY, "score", "fwd", 4).drop("n"),
    ]
    for p in parts:
        out = out.join(p, k, "left")
    return rounded(out)


@query(
    "364",
    """with l as (select symbol, datetime, target, unnest(['engine', 'lagged']) as model, unnest([pred, current]) as p from ev),
m as (select model, avg(case when p = target then 1.0 else 0 end) as acc, count(*) as n from l where p is not null and target is not null group by 1)
select model, round(acc, 6) as accuracy, n, round(acc - (select acc from m where model = 'lagged'), 6) as vs_best_baseline from m""",
)
def accuracy_vs_baselines(t):
    cells = F.explode(
        F.array(
            F.struct(F.lit("engine").alias("model"), F.col("pred").alias("p")),
            F.struct(F.lit("lagged").alias("model"), F.col("current").alias("p")),
        )
    )
    d = ev(t).select("target", cells.alias("_c")).select("target", "_c.*")
    m = d.dropna().groupBy("model").agg(
        F.avg((F.col("p") == F.col("target")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )
    base = m.where("model <> 'engine'").agg(F.max("accuracy").alias("_b"))
    m = m.crossJoin(F.broadcast(base))  # one row
    return rounded(
        m.select("model", "accuracy", "n", (F.col("accuracy") - F.col("_b")).alias("vs_best_baseline"))
    )


EPI = """select product, name, start, "end", case when k % 2 = 0 then 'backwardation' else 'contango' end as expected from (select *, cast(substr(name, 2) as int) as k from named_events)"""
view("episodes", EPI)


def episodes(t):
    from .curves import events

    k = F.substring("name", 2, 2).cast("int")
    e = F.when(k % 2 == 0, "backwardation").otherwise("contango")
    return events(t).withColumn("expected", e)


@query(
    "366",
    """with p as (select product, date, state as label, row_number() over (partition by product order by date) as i from states where state is not null),
o as (select e.*, (select min(i) from p where p.product = e.product and p.date >= e.start and p.date <= e."end") as on_i from episodes e)
select o.product, o.name, min(case when p.i >= on_i - 21 and label = expected then p.i - on_i end) as lead_lag from o join p on p.product = o.product and p.date between o.start - 168 and o."end" group by 1, 2""",
)
def episode_lead_lag(t):
    d = states(t).where("state is not null").select("product", "date", F.col("state").alias("label"))
    return R.episode_lead_lag(d, episodes(t), C.PRODUCT)


@query(
    "367",
    """select e.product, name, round(avg(case when state = expected then 1.0 else 0 end), 6) as share_expected, count(*) as n from states s join episodes e
on s.product = e.product and s.date between e.start and e."end" where state is not null group by 1, 2""",
)
def episode_scores(t):
    d = states(t).select("product", "date", F.col("state").alias("label"))
    return rounded(R.episode_scores(d, episodes(t), C.PRODUCT))


view(
    "mech",
    f"""select symbol, datetime, fv, case when fv is not null then fv >= quantile_cont(fv, 2.0 / 3) over (partition by symbol) end as high from (
 select symbol, datetime, case when count(log_return) over ({S.W} rows between 1 following and 8 following) = 8 then stddev_samp(log_return) over ({S.W} rows between 1 following and 8 following) end as fv from feat1)""",
)


@query(
    "368",
    """select m.symbol, round(avg(case when high = (s2 > 0) then 1.0 else 0 end), 6) as accuracy, count(*) as n from mech m join score_w s on m.symbol = s.symbol and m.datetime = s.datetime
where high is not null and s2 is not null group by 1""",
)
def mechanical_targets(t):
    d = score_w(t)

    def fwd(w):
        return {"_r": log_return(w)}

    def vol(w):
        f = w.rowsBetween(1, 8)
        return {"fv": F.when(F.count("_r").over(f) == 8, F.stddev_samp("_r").over(f))}

    d = rolling(d, WEEKLY, [fwd, vol], 1, 8)
    d = R.tercile_target(d, ["symbol"], "fv").dropna(subset=["high", "s2"])
    return rounded(
        d.groupBy("symbol").agg(
            F.avg((F.col("high") == (F.col("s2") > 0)).cast("double")).alias("accuracy"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query(
    "369",
    f"""select symbol, datetime, round(case when count(r10) over ({S.W} rows between unbounded preceding and 1 preceding) >= 60 then quantile_cont(r10, 0.5) over ({S.W} rows between unbounded preceding and 1 preceding) end, 6) as threshold from score_w""",
)
def expanding_median(t):
    d = R.expanding_median(score_w(t), WEEKLY, "r10", "threshold")
    return rounded(d.select("symbol", "datetime", "threshold"))


@query(
    "370",
    f"""with a as (select symbol, close, datetime, row_number() over ({S.W}) as i, count(*) over (partition by symbol) as n from bars_w),
p as (select a.symbol, a.datetime, a.i, a.n, b.i as j, b.close, max(b.close) over (partition by a.symbol, a.i order by b.i {UP}) as hi from a join a b on a.symbol = b.symbol and b.i between a.i and a.i + 12)
select symbol, datetime, round(case when i + 12 <= n then min(close / hi - 1) end, 6) + 0.0 as fwd_dd from p group by symbol, datetime, i, n""",
)
def forward_drawdown(t):
    d = R.forward_drawdown(px(t), WEEKLY, "close", 12, "fwd_dd")
    return rounded(d.select("symbol", "datetime", "fwd_dd"))


@query(
    "371",
    """with a as (select s.datetime, s.symbol, score, fwd, row_number() over (partition by s.datetime order by score, s.symbol) as rn, count(*) over (partition by s.datetime) as n from ev s where score is not null and fwd is not null)
select datetime, round(avg(case when rn > n - 2 then fwd end) - avg(case when rn <= 2 then fwd end), 6) as spread, max(n) as n from a where n >= 4 group by 1""",
)
def top_bottom_spread(t):
    return rounded(R.top_bottom_spread(ev(t), "datetime", "score", "fwd", names=NAMES))

