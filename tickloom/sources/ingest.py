"""Typed scans, cleaning at the edge, and sinks (inventory 2.A)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ratio

# Fixed file layouts.
TRADE_SCHEMA = (
    "id long, price double, qty double, quoteQty double, time long, isBuyerMaker boolean"
)
KLINE_SCHEMA = (
    "open_time string, open double, high double, low double, close double, volume double, "
    "close_time long, quote_volume double, count long, taker_buy_volume double, "
    "taker_buy_quote_volume double, ignore double"
)
FUNDING_SCHEMA = "symbol string, fundingTime long, fundingRate string"


#: Added by the checked readers: the raw line and why it was refused (null for good rows).
LINE, REASON = "line", "reject_reason"
CORRUPT = "_corrupt_record"


def _judged(lines: DataFrame, parsed: Column, required: Sequence[str], header: str | None = None, fields: int | None = None) -> DataFrame:
    """Parse lines of text and mark those that do not fit the schema or lack a required
    value, with the file they came from; header lines, wherever they stand, are dropped.

    ``fields`` is the number of comma-separated fields, which the parser itself would pad or
    cut silently.
    """
    line = F.col("value")
    d = lines if header is None else lines.where(~F.trim(line).startswith(header))
    keys = [c for c in lines.columns if c != "value"]
    d = d.select(*keys, line.alias(LINE), F.col("_metadata.file_path").alias("file"), parsed.alias("_r"))
    missing = F.array_compact(F.array(*[F.when(F.col("_r")[c].isNull(), F.lit(c)) for c in required]))
    reason = F.when(F.col("_r")[CORRUPT].isNotNull(), F.lit("does not fit the schema"))
    if fields is not None:
        n = F.size(F.split(LINE, ","))
        reason = F.when(n != fields, F.concat(F.lit("has fields: "), n.cast("string"))).otherwise(reason)
    reason = F.coalesce(reason, F.when(F.size(missing) > 0, F.concat(F.lit("no "), F.array_join(missing, ", "))))
    return d.withColumn(REASON, reason).select(*keys, "_r.*", LINE, "file", REASON).drop(CORRUPT)


def good(judged: DataFrame) -> DataFrame:
    """The rows that passed, without the marks."""
    return judged.where(F.col(REASON).isNull()).drop(REASON, LINE, "file")


def rejects(judged: DataFrame) -> DataFrame:
    """What was refused: file, raw line, reason."""
    return judged.where(F.col(REASON).isNotNull()).select("file", LINE, F.col(REASON).alias("reason"))


def _csv(spark: SparkSession, path: str | Sequence[str], schema: str, required: Sequence[str], header: str) -> DataFrame:
    parsed = F.from_csv("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return _judged(spark.read.text(path), parsed, required, header, len(schema.split(", ")))


def judged_trades(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw trade CSV with a fixed schema, bad lines marked; epoch milliseconds become a
    timestamp. Files may carry a header line. A folder per symbol (symbol=...) adds a column."""
    raw = _csv(spark, path, TRADE_SCHEMA, ["id", "price", "qty", "time"], "id,")
    return raw.withColumn("datetime", F.timestamp_millis("time"))


def read_trades(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The good rows of ``judged_trades``."""
    return good(judged_trades(spark, path))


def write_trades(trades: DataFrame, path: str, parts: int = 16) -> None:
    """Parquet laid out by symbol and day, so range scans prune directories. A hot day is
    spread over ``parts`` files."""
    day = trades.withColumn("date", F.to_date("datetime"))
    day.repartition("symbol", "date", F.pmod(F.xxhash64("id"), F.lit(parts))).write.partitionBy(
        "symbol", "date"
    ).parquet(path)


def scan_trades(spark: SparkSession, path: str, start: str, end: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """Trades of an inclusive range of days; other days' and symbols' folders are not opened."""
    d = spark.read.parquet(path)
    d = d.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return d if symbols is None else d.where(F.col("symbol").isin(list(symbols)))


def judged_klines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Bar CSV whose files may or may not start with a header line, bad lines marked."""
    schema = KLINE_SCHEMA.replace("open_time string", "open_time long")
    raw = _csv(spark, path, schema, ["open_time", "close"], "open_time,")
    return raw.withColumn("datetime", F.timestamp_millis("open_time"))


def read_klines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The good bars, eight columns (and ``symbol`` where folders name it)."""
    d = good(judged_klines(spark, path))
    keys = [c for c in ("symbol",) if c in d.columns]
    return d.select(*keys, "datetime", "open", "high", "low", "close", "volume", "count", "taker_buy_volume")


def range_scan(bars: DataFrame, start: str, end: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Inclusive date range, one row per key and datetime."""
    t = F.col("datetime")
    d = bars.where((t >= F.lit(start).cast("timestamp")) & (t <= F.lit(end).cast("timestamp")))
    return d.dropDuplicates([*keys, "datetime"])


def judged_funding(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Funding JSON, one object a line, bad lines marked: the rate is a string in the source."""
    parsed = F.from_json("value", f"{FUNDING_SCHEMA}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    d = _judged(spark.read.text(path), parsed, ["symbol", "fundingTime", "fundingRate"])
    d = d.withColumns({"datetime": F.timestamp_millis("fundingTime"), "funding_rate": F.expr("try_cast(fundingRate as double)")})
    text = F.when(F.col("funding_rate").isNull(), F.lit("no number in fundingRate"))
    return d.withColumn(REASON, F.coalesce(REASON, text))


def read_funding(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The good rows, one per symbol and time."""
    d = good(judged_funding(spark, path)).select("symbol", "datetime", "funding_rate")
    return one_row_per_key(d, ["symbol", "datetime"], ["funding_rate"])


class HoldoutError(ValueError):
    """A scan reached past the frozen date."""


def universe_panel(
    bars: DataFrame,
    min_cross_section: int,
    start: str,
    end: str,
    holdout: str | None = None,
    allow_holdout: bool = False,
) -> DataFrame:
    """Bars of all symbols at the times when enough symbols trade."""
    if holdout is not None and not allow_holdout and end > holdout:
        raise HoldoutError(f"end {end} lies past the holdout date {holdout}")
    d = range_scan(bars, start, end)
    wide = d.groupBy("datetime").agg(F.count(F.lit(1)).alias("_n"))
    wide = wide.where(F.col("_n") >= min_cross_section).select("datetime")
    return d.join(wide, "datetime", "left_semi")


def scan_daily(bars: DataFrame, symbol: str, interval: str = "1d") -> DataFrame:
    """Daily bars of one symbol on a plain date."""
    return bars.where((F.col("symbol") == symbol) & (F.col("interval") == interval)).select(
        F.to_date("timestamp").alias("date"), "open", "high", "low", "close", "volume"
    )


def widen(long: DataFrame, series: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per date and one column per series of the long macro table."""
    out = [
        F.max(F.when(F.col("series") == s, F.col("value"))).alias(n)
        for s, n in zip(series, names or series, strict=True)
    ]
    return long.where(F.col("series").isin(list(series))).groupBy("date").agg(*out)


def net_positioning(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Long minus short per class, and its share of open interest."""
    out = []
    for c in classes:
        net = F.col(f"{c}_long") - F.col(f"{c}_short")
        out += [net.alias(f"{c}_net"), ratio(net, "open_interest_all").alias(f"{c}_net_frac")]
    return df.select("*", *out)


def melt_scores(wide: DataFrame, ids: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """<dim>_score / <dim>_label columns to rows; rows with neither are dropped."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(d).alias("dimension"),
                    F.col(f"{d}_score").alias("score"),
                    F.col(f"{d}_label").alias("label"),
                )
                for d in dims
            ]
        )
    )
    return wide.select(*ids, rows.alias("_r")).select(*ids, "_r.*").dropna(
        how="all", subset=["score", "label"]
    )


def coverage_profile(df: DataFrame, key: str, time: str) -> DataFrame:
    """Rows, first and last stamp per source."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    )


def dataset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, by content hash."""
    def hashed(df: DataFrame) -> DataFrame:
        return df.select(F.md5(F.to_json(F.struct(*sorted(df.columns)))).alias("row_hash"))

    ca = hashed(a).groupBy("row_hash").agg(F.count(F.lit(1)).alias("n_a"))
    cb = hashed(b).groupBy("row_hash").agg(F.count(F.lit(1)).alias("n_b"))
    d = ca.join(cb, "row_hash", "full").na.fill(0, ["n_a", "n_b"])
    return d.where(F.col("n_a") != F.col("n_b"))


def holdout_cut(df: DataFrame, time: str, last: str) -> DataFrame:
    """Rows up to and including a fixed date."""
    return df.where(F.col(time) <= F.lit(last).cast(df.schema[time].dataType))


def one_row_per_key(df: DataFrame, keys: Sequence[str], prefer: Sequence[str]) -> DataFrame:
    """Deterministic dedupe: the row with the greatest ``prefer`` values stays."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*prefer)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*")


