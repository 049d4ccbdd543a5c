"""Derive the retail sources from an order star schema (orders, lines, parts, ...).

store = nation of the supplier, family = part type, sales = shipped quantity (returned
lines count as 0), promotion = lines with a discount of 5 % or more.  Every table is
derived by distributed joins and aggregations over the given Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.columns import daily_sequence, one_row
from shelfcast.functions.numbering import nested_row_number
from shelfcast.schemas import SALES_GRAIN

HORIZON = 16
ALL_STORES = 100


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def stores(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, folder, "region", "r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.substring(F.lit("ABCDE"), F.col("n_nationkey") % 5 + 1, F.lit(1)).alias("type"),
        (F.col("n_nationkey") % 7 + 1).alias("cluster"),
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity",
                   "l_discount", "l_returnflag", "l_shipdate")
    supplier = _table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    part = _table(spark, folder, "part", "p_partkey", "p_type")
    kept = F.when(F.col("l_returnflag") == "R", F.lit(0.0)).otherwise(F.col("l_quantity"))
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("l_shipdate").cast("date").alias("date"),
            (F.col("s_nationkey") + 1).alias("store_nbr"),
            F.col("p_type").alias("family"),
        )
        .agg(
            F.sum(kept).cast("double").alias("sales"),
            F.count_if(F.col("l_discount") >= 0.05).cast("int").alias("onpromotion"),
        )
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders", "o_custkey", "o_orderdate")
    customer = _table(spark, folder, "customer", "c_custkey", "c_nationkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderdate").cast("date").alias("date"),
                 (F.col("c_nationkey") + 1).alias("store_nbr"))
        .agg(F.count(F.lit(1)).cast("int").alias("transactions"))
    )


def oil(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return (
        _table(spark, folder, "orders", "o_totalprice", "o_orderdate")
        .filter(F.weekday(day) < 5)
        .groupBy(day.alias("date"))
        .agg(F.round(F.avg("o_totalprice") / 1000, 2).alias("dcoilwtico"))
    )


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Rule calendar for every year seen in the shipments."""
    seen = _table(spark, folder, "lineitem", "l_shipdate").select(
        F.year(F.col("l_shipdate").cast("date")).alias("y")).distinct()
    each_year = F.explode(one_row(seen.agg(F.collect_set("y").alias("ys")))["ys"]).alias("y")
    years = spark.range(1).select(each_year)
    regions = _table(spark, folder, "region", "r_regionkey", "r_name")
    nations = _table(spark, folder, "nation", "n_nationkey", "n_name")
    y = F.col("y")

    def event(frame: DataFrame, month: Column | int, day: int, kind: str, locale: str,
              place: Column, text: str, moved: Column | None = None) -> DataFrame:
        month = month if isinstance(month, Column) else F.lit(month)
        return frame.select(
            F.make_date(y, month, F.lit(day)).alias("date"),
            F.lit(kind).alias("type"), F.lit(locale).alias("locale"),
            place.alias("locale_name"), F.lit(text).alias("description"),
            (F.lit(False) if moved is None else moved).alias("transferred"),
        )

    everywhere, even = F.lit("All"), y % 2 == 0
    events = [
        event(years, 1, 1, "Holiday", "National", everywhere, "New Year"),
        event(years, 5, 1, "Holiday", "National", everywhere, "Labour Day", even),
        event(years.filter(even), 5, 2, "Transfer", "National", everywhere, "Labour Day moved"),
        event(years, 11, 24, "Event", "National", everywhere, "Sale Friday"),
        event(years, 12, 24, "Bridge", "National", everywhere, "Bridge day"),
        event(years, 12, 27, "Work Day", "National", everywhere, "Recovery day"),
        event(regions.select("*", each_year), F.col("r_regionkey") + 2, 15, "Additional", "Regional",
              F.col("r_name"), "Regional day"),
        event(nations.select("*", each_year), F.col("n_nationkey") % 12 + 1, 1, "Holiday", "Local",
              F.col("n_name"), "Founding day"),
    ]
    result = events[0]
    for extra in events[1:]:
        result = result.unionByName(extra)
    return result


def rollup(sales_table: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Dense series: sales per region and, over all regions, per family."""
    nation = _table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    sums = [F.sum("sales").alias("sales"), F.sum("onpromotion").cast("int").alias("onpromotion")]
    by_region = (
        sales_table.join(nation, F.col("store_nbr") == F.col("n_nationkey") + 1)
        .groupBy("date", (F.col("n_regionkey") + ALL_STORES + 1).alias("store_nbr"),
                 F.lit("ALL").alias("family"))
        .agg(*sums)
    )
    by_family = sales_table.groupBy("date", F.lit(ALL_STORES).alias("store_nbr"), "family").agg(*sums)
    return by_region.unionByName(by_family)


def rollup_stores(spark: SparkSession, folder: str) -> DataFrame:
    everywhere = F.lit("ALL")
    regions = _table(spark, folder, "region", "r_regionkey", "r_name").select(
        (F.col("r_regionkey") + ALL_STORES + 1).alias("store_nbr"), everywhere.alias("city"),
        F.col("r_name").alias("state"), F.lit("A").alias("type"), F.lit(1).alias("cluster"))
    total = spark.range(1).select(
        F.lit(ALL_STORES).alias("store_nbr"), everywhere.alias("city"),
        everywhere.alias("state"), F.lit("B").alias("type"), F.lit(2).alias("cluster"))
    return regions.unionByName(total)


def rollup_train_and_future(rolled: DataFrame, horizon: int = HORIZON) -> tuple[DataFrame, DataFrame]:
    """Split off the last ``horizon`` days; the future part carries no target."""
    numbered = nested_row_number(rolled, SALES_GRAIN, "id")
    last = one_row(rolled.agg(F.max("date").alias("last_date")))["last_date"]
    train = numbered.filter(F.datediff(last, "date") >= horizon)
    days = rolled.select("date").distinct()
    grid = (
        rolled.select("store_nbr", "family").distinct()
        .select("*", daily_sequence(F.date_sub(last, horizon - 1), last).alias("date"))
        .join(days, "date", "left_semi")
    )
    promoted = rolled.select(*SALES_GRAIN, "onpromotion")
    future = (
        grid.join(promoted, SALES_GRAIN, "left")
        .withColumn("onpromotion", F.coalesce("onpromotion", F.lit(0)))
    )
    future = nested_row_number(future, SALES_GRAIN, "id")
    return (
        train.select("id", *SALES_GRAIN, "sales", "onpromotion"),
        future.select("id", *SALES_GRAIN, "onpromotion"),
    )


def numbered_sales(sales_table: DataFrame) -> DataFrame:
    """Sales with a row id by date, store and family.

    ``sales_table`` is read several times: pass a stored table, not the join itself.
    """
    return nested_row_number(sales_table, SALES_GRAIN, "id").select("id", *SALES_GRAIN, "sales", "onpromotion")
