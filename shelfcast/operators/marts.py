"""Reporting marts over the star schema; facts are aggregated before they are joined."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import safe_ratio
from shelfcast.functions.quantiles import with_quantiles
from shelfcast.schemas import STORE_ATTRIBUTES

Tables = Mapping[str, DataFrame]
STORE_DAY_KEYS = ["date_key", "store_key"]
SEASON = ["year", "month", "day_of_week", "day_name", "is_weekend", "is_payday"]


def sales_by_store_day(t: Tables) -> DataFrame:
    return t["fact_daily_sales"].groupBy(*STORE_DAY_KEYS).agg(F.sum("sales").alias("total_sales"))


def transactions_by_store_day(t: Tables) -> DataFrame:
    return t["fact_store_transactions"].groupBy(*STORE_DAY_KEYS).agg(
        F.sum("transactions").alias("transactions"))


def daily_store_performance(t: Tables) -> DataFrame:
    """Store-day sales split by promotion, joined to the transactions of the same day."""
    promoted = F.col("is_promotion") == 1
    daily = t["fact_daily_sales"].groupBy(*STORE_DAY_KEYS).agg(
        F.sum("sales").alias("total_sales"),
        F.sum(F.when(promoted, F.col("sales")).otherwise(0.0)).alias("sales_on_promotion_active_rows"),
        F.sum(F.when(~promoted, F.col("sales")).otherwise(0.0)).alias("sales_on_nonpromotion_rows"),
        F.sum("onpromotion").alias("promoted_item_count"),
    )
    return (
        daily.join(t["fact_store_transactions"], STORE_DAY_KEYS, "left")
        .join(t["dim_date"].select("date_key", "full_date"), "date_key")
        .join(t["dim_store"], "store_key")
        .select(
            "full_date", "date_key", *STORE_ATTRIBUTES, "total_sales",
            "sales_on_promotion_active_rows", "sales_on_nonpromotion_rows", "promoted_item_count",
            safe_ratio("sales_on_promotion_active_rows", "total_sales")
            .alias("promotion_active_sales_share_proxy"),
            "transactions",
            safe_ratio("total_sales", "transactions").alias("sales_volume_per_transaction"),
        )
    )


def family_performance(t: Tables) -> DataFrame:
    """Year-month-family sales statistics with both promotion cohorts."""
    # Year and month come from the key itself, so the fact is not joined to the calendar.
    rows = t["fact_daily_sales"].select(
        F.floor(F.col("date_key") / 10000).cast("int").alias("year"),
        (F.floor(F.col("date_key") / 100) % 100).cast("int").alias("month"),
        "family_key", "sales", "is_promotion",
    )
    keys = ["year", "month", "family_key"]
    promoted = F.col("is_promotion") == 1
    summary = rows.groupBy(*keys).agg(
        F.sum("sales").alias("total_sales"),
        F.avg("sales").alias("average_sales"),
        F.stddev_samp("sales").alias("sales_std"),
        F.avg((F.col("sales") == 0).cast("double")).alias("zero_sales_rate"),
        F.avg(promoted.cast("double")).alias("promotion_rate"),
        F.avg(F.when(promoted, F.col("sales"))).alias("avg_sales_promo"),
        F.avg(F.when(~promoted, F.col("sales"))).alias("avg_sales_nonpromo"),
        F.count_if(promoted).alias("promo_observation_count"),
        F.count_if(~promoted).alias("nonpromo_observation_count"),
    )
    return with_quantiles(summary, rows, keys, {"median_sales": ("sales", 0.5)}).join(
        t["dim_family"], "family_key").select(
        "year", "month", "family", "total_sales", "average_sales", "median_sales", "sales_std",
        "zero_sales_rate", "promotion_rate", "avg_sales_promo", "avg_sales_nonpromo",
        "promo_observation_count", "nonpromo_observation_count",
        (safe_ratio(F.col("avg_sales_promo") - F.col("avg_sales_nonpromo"), "avg_sales_nonpromo")
         * 100).alias("promotion_uplift_proxy_pct"),
    )


def store_performance(t: Tables) -> DataFrame:
    """Store statistics over store-days."""
    stores = sales_by_store_day(t).groupBy("store_key").agg(
        F.sum("total_sales").alias("total_sales"),
        F.avg("total_sales").alias("average_daily_sales"),
        F.stddev_samp("total_sales").alias("sales_std"),
        F.count(F.lit(1)).alias("active_days"),
    )
    visits = t["fact_store_transactions"].groupBy("store_key").agg(
        F.sum("transactions").alias("total_transactions"))
    return stores.join(visits, "store_key", "left").join(t["dim_store"], "store_key").select(
        *STORE_ATTRIBUTES, "total_sales", "average_daily_sales", "sales_std", "active_days",
        "total_transactions",
        safe_ratio("total_sales", "total_transactions").alias("sales_volume_per_transaction"),
    )


def holiday_performance(t: Tables) -> DataFrame:
    """Holiday store-days with sales and transactions; unobserved measures stay missing."""
    return (
        t["bridge_store_holiday"]
        .join(sales_by_store_day(t), STORE_DAY_KEYS, "left")
        .join(transactions_by_store_day(t), STORE_DAY_KEYS, "left")
        .join(t["dim_date"].select("date_key", "full_date"), "date_key")
        .join(t["dim_store"].select("store_key", "store_nbr"), "store_key")
        .select("full_date", "store_nbr", "is_holiday", "is_work_day", "is_event", "holiday_count",
                "holiday_types", "total_sales", "transactions")
    )


def seasonality(t: Tables) -> DataFrame:
    """Daily totals by year, month, weekday, weekend and payday."""
    sales = t["fact_daily_sales"].groupBy("date_key").agg(F.sum("sales").alias("daily_sales"))
    visits = t["fact_store_transactions"].groupBy("date_key").agg(
        F.sum("transactions").alias("daily_transactions"))
    return (
        sales.join(visits, "date_key", "left").join(t["dim_date"], "date_key")
        .groupBy(*SEASON)
        .agg(
            F.sum("daily_sales").alias("total_sales"),
            F.avg("daily_sales").alias("average_daily_sales"),
            F.stddev_samp("daily_sales").alias("sales_std"),
            F.count(F.lit(1)).alias("active_days"),
            F.sum("daily_transactions").alias("total_transactions"),
        )
        .withColumn("sales_volume_per_transaction", safe_ratio("total_sales", "total_transactions"))
    )


MARTS = {
    "daily_store_performance": daily_store_performance,
    "family_performance": family_performance,
    "store_performance": store_performance,
    "holiday_performance": holiday_performance,
    "seasonality": seasonality,
}
MART_GRAINS = {
    "daily_store_performance": ["full_date", "store_nbr"],
    "family_performance": ["year", "month", "family"],
    "store_performance": ["store_nbr"],
    "holiday_performance": ["full_date", "store_nbr"],
    "seasonality": SEASON,
}


def build_marts(t: Tables) -> dict[str, DataFrame]:
    return {name: build(t) for name, build in MARTS.items()}
