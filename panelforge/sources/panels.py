"""Panel bindings: any table becomes a long panel (ts, asset, price)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    """A long table (ts, asset, price) with its assets in their fixed order; only complete timestamps."""

    rows: DataFrame
    assets: tuple[str, ...]

    @property
    def wide(self) -> DataFrame:
        """(ts, price array in asset order), one row per timestamp."""
        return wide(self.rows, self.assets)


def wide(rows: DataFrame, assets: tuple[str, ...]) -> DataFrame:
    """One row per timestamp at which every asset has a price. Conditional aggregates rather than a join per asset:
    one partial and one final aggregation, whatever the number of assets."""
    prices = [F.max(F.when(F.col("asset") == a, F.col("price"))) for a in assets]
    table = rows.groupBy("ts").agg(F.array(*prices).alias("price"))
    return table.where(~F.exists("price", lambda p: p.isNull()))


def clean(price: Column) -> Column:
    """Prices as numbers the logarithm takes: positive and finite, else null."""
    return F.when((price > 0) & ~F.isnan(price) & (price < float("inf")), price)


def bind(table: DataFrame, ts: Column, asset: Column, price: Column, assets: tuple[str, ...]) -> Panel:
    """A panel from a table: price is an aggregate expression per (ts, asset)."""
    rows = table.select("*", ts.alias("__ts"), asset.alias("__asset")).where(F.col("__asset").isin(*assets))
    rows = rows.groupBy(F.col("__ts").alias("ts"), F.col("__asset").alias("asset")).agg(clean(price).alias("price"))
    return Panel(rows.where(F.col("price").isNotNull()), assets)


def lineitem_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Three assets: the average unit price by return flag and ship date."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity")
    price = F.try_divide(F.round(F.sum("l_extendedprice"), 2), F.sum("l_quantity"))
    return bind(table, F.col("l_shipdate"), F.col("l_returnflag"), price, ("A", "N", "R"))


ORDER_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def orders_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Five assets: the average order value by priority and week."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderpriority", "o_totalprice")
    return bind(table, F.date_trunc("week", "o_orderdate"), F.col("o_orderpriority"), F.avg("o_totalprice"), ORDER_PRIORITIES)


def carried_forward(rows: DataFrame, unit: str = "day") -> DataFrame:
    """(ts, asset, price): an extension for sparse panels (nothing else imputes). Each asset keeps its last price at
    every timestamp of the table, from its first on. A segmented scan: the last price of every (asset, unit of time) is
    carried over units, one row each, and filled inside a unit; no window holds an asset's history."""
    rows = rows.select("ts", "asset", "price").withColumn("unit", F.date_trunc(unit, "ts"))
    stamps = rows.select("unit", "ts").distinct()
    rows = rows.where(F.col("price").isNotNull())
    ends = rows.groupBy("asset", "unit").agg(F.max_by("price", "ts").alias("last"), F.min("ts").alias("first_ts"))
    # every unit that holds a timestamp, for every asset from its first unit on
    begins = ends.groupBy("asset").agg(F.min("unit").alias("begin"), F.min("first_ts").alias("first_ts"))
    grid = stamps.select("unit").distinct().join(begins, F.col("unit") >= F.col("begin"))
    known = grid.join(ends.select("asset", "unit", "last"), ["asset", "unit"], "left")
    before = Window.partitionBy("asset").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("asset", "unit", "first_ts", F.last("last", ignorenulls=True).over(before).alias("carried"))
    filled = stamps.join(carried, "unit").where(F.col("ts") >= F.col("first_ts")).join(rows, ["unit", "ts", "asset"], "left")
    inside = Window.partitionBy("asset", "unit").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("ts", "asset", F.coalesce(F.last("price", ignorenulls=True).over(inside), "carried").alias("price"))


def event_buckets(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """(ts, asset, price): the average positive value by event type and time bucket."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value").where("value > 0")
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / (60 * minutes)) * 60 * minutes)
    return table.groupBy(bucket.alias("ts"), F.col("event_type").alias("asset")).agg(clean(F.avg("value")).alias("price"))
