"""The given tables and the market-style tables that Spark derives from them.

``VIEWS`` holds the same derivations as SQL text for the result checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import tick_key
from ..session import configure


class Tables:
    """Lazy access to one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def trades(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("symbol"),
            "ts",
            F.col("event_id").alias("id"),
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("qty"),
            (F.col("user_id") % 2 == 1).alias("is_buyer_maker"),
        )

    def _lines(self) -> DataFrame:
        return (
            self.read("lineitem")
            .join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        )

    def bars_1h(self) -> DataFrame:
        t = self.trades()
        key = tick_key("ts", "id")
        return t.groupBy("symbol", F.date_trunc("hour", "ts").alias("datetime")).agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("qty").alias("volume"),
            F.count(F.lit(1)).alias("count"),
            F.sum(F.when(~F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0)).alias(
                "taker_buy_volume"
            ),
        )

    def _priced(self, lines: DataFrame, keys: list[Column]) -> DataFrame:
        """Open, high, low, close and volume of line prices by the given keys.

        First per ship date, where the rest of the order key fits one decimal,
        then over the dates: both steps aggregate by hash before the shuffle.
        """
        price = F.col("l_extendedprice") / F.col("l_quantity")
        key = F.expr(
            "cast(l_orderkey as decimal(15,0)) * 100000000000000000000000BD"
            " + cast(l_linenumber as decimal(2,0)) * 1000000000000000000000BD"
            " + cast(l_partkey as decimal(11,0)) * 10000000000BD"
            " + cast(l_suppkey as decimal(10,0))"
        )
        day = lines.groupBy(*keys, "l_shipdate").agg(
            F.min_by(price, key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, key).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.count(F.lit(1)).alias("count"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias(
                "taker_buy_volume"
            ),
        )
        made = ("l_shipdate", "open", "high", "low", "close", "volume", "count", "taker_buy_volume")
        return day.groupBy(*[c for c in day.columns if c not in made]).agg(
            F.min_by("open", "l_shipdate").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "l_shipdate").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("count").alias("count"),
            F.sum("taker_buy_volume").alias("taker_buy_volume"),
        )

    def bars_w(self) -> DataFrame:
        week = F.date_trunc("week", "l_shipdate").alias("datetime")
        return self._priced(self._lines(), [F.col("n_name").alias("symbol"), week])

    def funding(self) -> DataFrame:
        return (
            self.read("orders")
            .join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("symbol"), F.col("o_orderdate").alias("datetime"))
            .agg((F.avg("o_totalprice") / 1e6).alias("funding_rate"))
        )

    def macro_long(self) -> DataFrame:
        return (
            self.read("orders")
            .groupBy(
                F.col("o_orderpriority").alias("series"),
                F.col("o_orderdate").cast("date").alias("date"),
            )
            .agg((F.avg("o_totalprice") / 1000).alias("value"))
        )

    def contract_bars(self) -> DataFrame:
        return (
            self._lines()
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(
                F.col("r_name").alias("product"),
                F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
                F.col("l_linenumber").alias("contract_id"),
            )
            .agg(
                F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
                F.sum("l_quantity").alias("volume"),
            )
        )

    def curve(self) -> DataFrame:
        def leg(k: int) -> Column:
            return F.max(F.when(F.col("contract_id") == k, F.col("close"))).alias(f"close_f{k}")

        return (
            self.contract_bars()
            .groupBy("product", "date")
            .agg(leg(1), leg(2), leg(3))
            .select(
                "*", F.lit(30).alias("dte_f1"), F.lit(60).alias("dte_f2"), F.lit(90).alias("dte_f3")
            )
        )

    def spreads(self) -> DataFrame:
        return (
            self.curve()
            .where(F.col("close_f1").isNotNull() & F.col("close_f2").isNotNull())
            .select(
                F.col("product").alias("spread"),
                "date",
                (F.col("close_f1") - F.col("close_f2")).alias("value"),
                F.col("close_f1").alias("leg1_price"),
                F.col("close_f2").alias("leg2_price"),
                F.array("close_f1", "close_f2").alias("leg_prices"),
                (F.dayofmonth("date") <= 7).alias("roll_window_flag"),
            )
        )

    def roll_calendar(self) -> DataFrame:
        """Each product's contract months, from the first to the last in the contract table."""
        month = F.trunc(F.add_months("l_shipdate", F.col("l_linenumber")), "month")
        ends = self.read("lineitem").agg(F.min(month).alias("a"), F.max(month).alias("b"))
        months = F.explode(F.expr("sequence(a, b, interval 1 month)"))
        last = F.date_sub(F.last_day("m"), 10)
        return (
            self.read("region")
            .crossJoin(F.broadcast(ends))  # one row
            .select(F.col("r_name").alias("product"), months.alias("m"))
            .select(
                "product",
                F.date_format("m", "yyyy-MM").alias("contract_month"),
                last.alias("last_trade_date"),
            )
            .withColumn(
                "first_notice_date",
                F.when(F.month("last_trade_date") == 12, F.date_sub("last_trade_date", 2)),
            )
        )

    def contract_px(self) -> DataFrame:
        """Weekly prices by product and contract month (ship month + line)."""
        month = F.date_format(F.add_months("l_shipdate", F.col("l_linenumber")), "yyyy-MM")
        lines = self._lines().join(
            self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        keys = [
            F.col("r_name").alias("product"),
            F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
            month.alias("contract_month"),
        ]
        return self._priced(lines, keys).drop("count", "taker_buy_volume")

    def daily(self) -> DataFrame:
        """Daily bars of the hourly symbols, on a plain date."""
        t = self.trades()
        key = tick_key("ts", "id")
        return t.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("qty").alias("volume"),
        )


VIEWS = {
    "trades": """select event_type as symbol, ts, event_id as id, value as price,
       cast(json_extract(props, '$.k') as double) as qty, user_id % 2 = 1 as is_buyer_maker
from events""",
    "bars_1h": """select symbol, date_trunc('hour', ts) as datetime,
       arg_min(price, id) as open, max(price) as high, min(price) as low,
       arg_max(price, id) as close, sum(qty) as volume, count(*) as count,
       sum(case when not is_buyer_maker then qty else 0 end) as taker_buy_volume
from trades group by 1, 2""",
    "lines": """select *, l_extendedprice / l_quantity as price
from lineitem join supplier on l_suppkey = s_suppkey
              join nation on s_nationkey = n_nationkey""",
    "bars_w": """select n_name as symbol, cast(date_trunc('week', l_shipdate) as timestamp) as datetime,
       arg_min(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as open,
       max(price) as high, min(price) as low,
       arg_max(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as close,
       sum(l_quantity) as volume, count(*) as count,
       sum(case when l_returnflag = 'R' then l_quantity else 0 end) as taker_buy_volume
from lines group by 1, 2""",
    "funding": """select n_name as symbol, o_orderdate as datetime, avg(o_totalprice) / 1e6 as funding_rate
from orders join customer on o_custkey = c_custkey
            join nation on c_nationkey = n_nationkey group by 1, 2""",
    "macro_long": """select o_orderpriority as series, cast(o_orderdate as date) as date,
       avg(o_totalprice) / 1000 as value from orders group by 1, 2""",
    "contract_bars": """select r_name as product, cast(date_trunc('week', l_shipdate) as date) as date,
       l_linenumber as contract_id, avg(price) as close, sum(l_quantity) as volume
from lines join region on n_regionkey = r_regionkey group by 1, 2, 3""",
    "contract_px": """select r_name as product, cast(date_trunc('week', l_shipdate) as date) as date,
  strftime(l_shipdate + l_linenumber * interval 1 month, '%Y-%m') as contract_month,
  arg_min(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as open, max(price) as high, min(price) as low,
  arg_max(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) as close, sum(l_quantity) as volume
from lines join region on n_regionkey = r_regionkey group by 1, 2, 3""",
    "curve": """select product, date,
       max(case when contract_id = 1 then close end) as close_f1,
       max(case when contract_id = 2 then close end) as close_f2,
       max(case when contract_id = 3 then close end) as close_f3,
       30 as dte_f1, 60 as dte_f2, 90 as dte_f3
from contract_bars group by 1, 2""",
    "spreads": """select product as spread, date, close_f1 - close_f2 as value,
       close_f1 as leg1_price, close_f2 as leg2_price,
       [close_f1, close_f2] as leg_prices, day(date) <= 7 as roll_window_flag
from curve where close_f1 is not null and close_f2 is not null""",
    "roll_calendar": """select product, contract_month, last_trade_date,
       case when month(last_trade_date) = 12 then last_trade_date - 2 end as first_notice_date
from (select r_name as product, strftime(m, '%Y-%m') as contract_month,
             cast(last_day(m) - 10 as date) as last_trade_date
      from region, (select unnest(generate_series(min(mm), max(mm), interval 1 month)) as m
             from (select date_trunc('month', l_shipdate + l_linenumber * interval 1 month)::timestamp as mm from lineitem)))""",
    "daily": """select symbol, cast(ts as date) as date, arg_min(price, id) as open,
       max(price) as high, min(price) as low, arg_max(price, id) as close, sum(qty) as volume
from trades group by 1, 2""",
}
