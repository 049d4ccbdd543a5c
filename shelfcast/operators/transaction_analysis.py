"""Transactions against sales: robust outliers, store ranks and monthly change drivers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, flag, rank_desc, safe_corr, safe_ratio
from shelfcast.functions.quantiles import with_quantiles
from shelfcast.operators.trend import moving_average
from shelfcast.schemas import STORE_ATTRIBUTES

Tables = Mapping[str, DataFrame]
OUTLIER_LIMIT = 3.5
# Fixed value: scales the median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745
ROLLING_ROWS, ROLLING_MIN_ROWS = 28, 7


def store_day_frame(t: Tables, check: bool = True) -> DataFrame:
    """Transactions with the sales of the same store-day, null where there are none.

    ``check`` refuses tables in which a transaction row has no sales."""
    keys = ["date_key", "store_key"]
    sales = t["fact_daily_sales"].groupBy(*keys).agg(F.sum("sales").alias("total_sales"))
    visits = t["fact_store_transactions"]
    if check:
        lost = visits.join(sales, keys, "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"transactions without daily store sales: {[tuple(r) for r in lost]}")
    days = t["dim_date"].select("date_key", "full_date", "day_of_week", "day_name", "month", "month_name", "year")
    return (
        visits.join(sales, keys, "left").join(days, "date_key").join(t["dim_store"], "store_key")
        .withColumns({"sales_volume_per_transaction": safe_ratio("total_sales", "transactions"),
                      "zero_transaction_flag": flag(F.col("transactions") == 0)})
    )


def unmapped_store_days(frame: DataFrame) -> DataFrame:
    """How many transaction rows have no sales, and their transactions."""
    return frame.filter("total_sales IS NULL").agg(
        F.count(F.lit(1)).alias("store_days_without_sales"), F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions_without_sales"))


def add_outliers_and_trend(frame: DataFrame) -> DataFrame:
    """Modified z-score per store and a 28-row mean; each window is one store's calendar."""
    store = Window.partitionBy("store_nbr")
    recent = store.orderBy("full_date").rowsBetween(-(ROLLING_ROWS - 1), 0)
    deviation = F.col("transactions") - F.col("transaction_store_median")
    return (
        frame.withColumn("transaction_store_median", F.median("transactions").over(store))
        .withColumn("_deviation", F.abs(deviation))
        .withColumn("transaction_store_mad", F.median("_deviation").over(store))
        .withColumn("transaction_robust_z", safe_ratio(deviation * MAD_SCALE, "transaction_store_mad"))
        .withColumns({
            "unusual_transaction_day": flag(F.abs("transaction_robust_z") >= OUTLIER_LIMIT),
            "anomaly_rule": F.lit(f"absolute modified z-score >= {OUTLIER_LIMIT}; no rows removed"),
            "transactions_28_observation_rolling_average": F.when(
                F.count("transactions").over(recent) >= ROLLING_MIN_ROWS, F.avg("transactions").over(recent)),
        }).drop("_deviation")
    )


def store_summary(frame: DataFrame) -> DataFrame:
    """Store totals with the sales-transactions correlation and two ranks."""
    summary = frame.groupBy(*STORE_ATTRIBUTES).agg(
        F.sum("total_sales").alias("total_sales"), F.sum("transactions").alias("total_transactions"),
        F.avg("transactions").alias("average_daily_transactions"),
        F.median("transactions").alias("median_daily_transactions"),
        F.count(F.lit(1)).alias("transaction_observation_count"),
        F.sum("unusual_transaction_day").alias("unusual_transaction_days"),
        safe_corr("total_sales", "transactions").alias("sales_transactions_correlation"),
    ).withColumn("sales_volume_per_transaction", safe_ratio("total_sales", "total_transactions"))
    whole = Window.partitionBy(F.lit(0))
    return summary.withColumns({
        "rank_total_transactions": rank_desc(
            "total_transactions", whole.orderBy(F.col("total_transactions").desc_nulls_last())),
        "rank_sales_volume_per_transaction": rank_desc(
            "sales_volume_per_transaction", whole.orderBy(F.col("sales_volume_per_transaction").desc_nulls_last())),
    })


def monthly_driver(frame: DataFrame) -> DataFrame:
    """Split monthly sales change into transaction, volume and interaction effects."""
    monthly = frame.groupBy(F.date_format("full_date", "yyyy-MM").alias("year_month")).agg(
        F.sum("total_sales").alias("total_sales"), F.sum("transactions").alias("total_transactions"),
        F.count(F.lit(1)).alias("store_day_count"),
    ).withColumn("sales_volume_per_transaction", safe_ratio("total_sales", "total_transactions"))
    order = Window.partitionBy(F.lit(0)).orderBy("year_month")  # one row per month
    monthly = monthly.withColumns({f"previous_{c}": F.lag(c).over(order) for c in (
        "total_sales", "total_transactions", "sales_volume_per_transaction")})
    more_visits = F.col("total_transactions") - F.col("previous_total_transactions")
    more_volume = F.col("sales_volume_per_transaction") - F.col("previous_sales_volume_per_transaction")
    monthly = monthly.withColumns({
        "sales_change": F.col("total_sales") - F.col("previous_total_sales"),
        "transaction_effect": more_visits * F.col("previous_sales_volume_per_transaction"),
        "volume_per_transaction_effect": more_volume * F.col("previous_total_transactions"),
        "interaction_effect": more_visits * more_volume,
    })
    change = F.col("sales_change")
    volume_total = F.col("volume_per_transaction_effect") + F.col("interaction_effect")
    return monthly.withColumns({
        "sales_change_direction": choose([(change > 0, "Increase"), (change < 0, "Decrease")],
                                         "No change / first month"),
        "dominant_change_driver": choose([
            (change.isNull(), "Not available for first month"),
            (F.abs("transaction_effect") >= F.abs(volume_total), "Transactions")],
            "Sales volume per transaction"),
    })


def assert_driver_identity(drivers: DataFrame, tolerance: float = 1e-6) -> None:
    """The three effects must add up to the change."""
    parts = F.col("transaction_effect") + F.col("volume_per_transaction_effect") + F.col("interaction_effect")
    off = F.abs(F.col("sales_change") - parts) > tolerance * F.greatest(F.lit(1.0), F.abs("sales_change"))
    if drivers.filter(off).limit(1).count():
        raise AssertionError("monthly sales change does not equal the sum of its effects")


def driver_counts(drivers: DataFrame) -> DataFrame:
    return drivers.filter("sales_change_direction = 'Increase'").groupBy("dominant_change_driver").agg(
        F.count(F.lit(1)).alias("months"))


def daily_totals(frame: DataFrame) -> DataFrame:
    """System transactions per day with a 28-row mean."""
    daily = frame.groupBy("full_date").agg(F.sum("transactions").alias("total_transactions"),
                                           F.sum("total_sales").alias("total_sales"))
    return daily.withColumn("transactions_ma_28", moving_average("total_transactions", 28, [], "full_date"))


def overall_correlation(frame: DataFrame) -> DataFrame:
    return frame.agg(
        safe_corr("total_sales", "transactions").alias("sales_transactions_correlation"),
        F.sum("zero_transaction_flag").alias("zero_transaction_days"),
        F.sum("unusual_transaction_day").alias("unusual_transaction_days"),
        F.count(F.lit(1)).alias("store_days"))


def calendar_distributions(frame: DataFrame) -> DataFrame:
    """Transactions by weekday (quartiles) and by month (mean) in one long table."""
    rows = frame.select("transactions", F.inline(F.array(
        F.struct(F.lit("weekday").alias("view"), F.col("day_of_week").alias("group_number"),
                 F.col("day_name").alias("group_name")),
        F.struct(F.lit("month").alias("view"), F.col("month").alias("group_number"),
                 F.col("month_name").alias("group_name")))))
    keys = ["view", "group_number", "group_name"]
    summary = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("store_days"),
                                      F.avg("transactions").alias("average_transactions"))
    return with_quantiles(summary, rows, keys, {
        "q25": ("transactions", 0.25), "median": ("transactions", 0.5), "q75": ("transactions", 0.75)})
