"""Streaming bars, dedupe and regime labels (inventory 2.O)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from ..operators.regime import Band
from ..session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all data at hand into parquet, and read it back."""
    spark = stream.sparkSession
    base = scratch(spark)
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def trade_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Trades of the event files as they arrive."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )


def stream_bars(
    trades: DataFrame, interval: str, late: str = "10 minutes", slide: str | None = None
) -> DataFrame:
    """OHLCV per tumbling or sliding window; trades past the watermark are
    dropped and a bar is emitted once its window has closed."""
    key = F.struct("ts", "id")
    win = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    d = trades.withWatermark("ts", late).groupBy(win, "symbol").agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("qty").alias("volume"),
    )
    return d.select(
        "symbol", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume"
    )


def stream_dedupe(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per trade id within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


class _Labeller(StatefulProcessor):
    """Rows wait in spans of time until the watermark has passed a span's last row; each span
    has one timer, at that row.

    Timers fire in the order of time, so rows that came out of order, in any batch, are
    labelled in order, and a call holds the rows of one span only.
    """

    def __init__(self, edges: Sequence[tuple[str, float, float]], margin: float, dwell: int, span_ms: int) -> None:
        self.edges, self.margin, self.dwell, self.span_ms = edges, margin, dwell, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "ms array<long>, score array<double>")
        self.label = handle.getValueState("label", "current int, pending int, dwell int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            ms = part["datetime"].to_numpy("datetime64[ms]").astype("int64")
            d = pd.DataFrame({"ms": ms, "score": part["score"].to_numpy(float), "span": ms // self.span_ms})
            for span, g in d[d["ms"] > mark].groupby("span"):  # others: their turn has passed
                at = (int(span),)
                held, scores = self.waiting.getValue(at) if self.waiting.containsKey(at) else ([], [])
                if len(held):
                    self.handle.deleteTimer(int(max(held)))
                held, scores = [*map(int, held), *g["ms"].tolist()], [*map(float, scores), *g["score"].tolist()]
                self.waiting.updateValue(at, (held, scores))
                self.handle.registerTimer(max(held))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() // self.span_ms,)
        rows = dict(zip(*self.waiting.getValue(at), strict=True))  # of two rows of one time the later one
        self.waiting.removeKey(at)
        state = self.label.get() if self.label.exists() else (-1, -1, 0)
        times, names = sorted(rows), []
        for t in times:
            if rows[t] == rows[t]:
                state = self._step(float(rows[t]), *state)
            names.append(self.edges[state[0]][0] if rows[t] == rows[t] else None)
        self.label.update(tuple(map(int, state)))
        yield pd.DataFrame({"symbol": key[0], "datetime": pd.to_datetime(times, unit="ms"), "label": names})

    def _step(self, v: float, current: int, pending: int, count: int) -> tuple[int, int, int]:
        now = next(i for i, (_, lo, hi) in enumerate(self.edges) if lo <= v < hi)
        if current < 0:
            return now, -1, 0
        _, lo, hi = self.edges[current]
        if now == current or lo - self.margin <= v < hi + self.margin:
            return current, -1, 0
        count = count + 1 if now == pending else 1
        return (now, -1, 0) if count >= self.dwell else (current, now, count)

    def close(self) -> None:
        pass


def stream_labels(
    scores: DataFrame, bands: Sequence[Band], margin: float, dwell: int, late: str = "0 seconds", span_hours: float = 24.0
) -> DataFrame:
    """Hysteresis labels whose state per series lives across micro-batches.

    ``scores``: symbol, datetime, score, in any order within ``late``. Rows are labelled a
    span of ``span_hours`` at a time, once the watermark has reached the last row that the
    span has; it bounds the rows that a call holds. A row that comes after the watermark has
    passed its time is dropped, and of two rows of one time the later one counts.
    Needs the RocksDB state store, which is set here.
    """
    edges = [
        (
            b.label,
            float("-inf") if b.lower is None else b.lower,
            float("inf") if b.upper is None else b.upper,
        )
        for b in bands
    ]
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return scores.withWatermark("datetime", late).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Labeller(edges, margin, dwell, int(span_hours * 3_600_000)),
        outputStructType="symbol string, datetime timestamp, label string",
        outputMode="Append",
        timeMode="EventTime",
    )
