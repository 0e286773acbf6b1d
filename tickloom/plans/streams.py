"""Queries that drain a stream over the event files (inventory 2.O)."""

from __future__ import annotations

from ..session import configure, materialize, stored_at
from ..streaming import streams as T
from .registry import query, rounded
from .regime import BANDS, hyst_sql, score_w

BARS = """select symbol, datetime, open, high, low, close, round(volume, 6) as volume from ({}) where datetime + interval {} <= (select max(ts) from events) - interval 10 minute"""
AGG = "arg_min(price, id) as open, max(price) as high, min(price) as low, arg_max(price, id) as close, sum(qty) as volume"


def _trades(t):
    return T.trade_stream(configure(t.spark), f"{t.path}/event[s].parquet")


@query(
    "405",
    BARS.format(f"select symbol, date_trunc('hour', ts) as datetime, {AGG} from trades group by 1, 2", "1 hour"),
)
def streaming_bars(t):
    return rounded(T.drain(T.stream_bars(_trades(t), "1 hour")))


@query(
    "405",
    BARS.format(
        f"select symbol, w as datetime, {AGG} from (select *, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval 30 minute]) as w from trades) group by 1, 2",
        "1 hour",
    ),
)
def streaming_sliding_bars(t):
    return rounded(T.drain(T.stream_bars(_trades(t), "1 hour", slide="30 minutes")))


@query("406", "select symbol, id, ts, price from trades")
def streaming_dedupe(t):
    s = _trades(t)
    return T.drain(T.stream_dedupe(s.unionByName(s))).select("symbol", "id", "ts", "price")


@query(
    "407",
    hyst_sql("score_w")
    + "select s.symbol, s.datetime, st.cur as label from score_w s left join st on s.symbol = st.symbol and s.datetime = st.datetime",
)
def streaming_labels(t):
    d = materialize(score_w(t).select("symbol", "datetime", "score"))
    # Files of a stored table are in no order of time, so they make one batch.
    s = t.spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1 << 30).parquet(stored_at(d))
    return T.drain(T.stream_labels(s, BANDS, 0.1, 3, span_hours=24 * 366))  # weekly rows
