"""System-level trend and seasonality on the full calendar.

The daily series has one row per calendar day, so its windows may run in one partition:
their size is the calendar, never the number of stores or families.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import flag, one_row, safe_ratio
from shelfcast.operators.audit import union_all

Tables = Mapping[str, DataFrame]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def moving_average(value: str, rows: int, keys: list[str], order: str) -> Column:
    """Trailing mean over calendar rows; missing days are skipped, not counted as zero."""
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.avg(value).over(window)


def daily_summary(t: Tables) -> DataFrame:
    observed = t["fact_daily_sales"].groupBy("date_key").agg(F.sum("sales").alias("total_sales"))
    return (
        t["dim_date"].join(observed, "date_key", "left")
        .withColumn("has_sales_observation", flag(F.col("total_sales").isNotNull()))
        .withColumn("sales_ma_7", moving_average("total_sales", 7, [], "full_date"))
        .withColumn("sales_ma_28", moving_average("total_sales", 28, [], "full_date"))
        .withColumnRenamed("full_date", "date")
    )


def _historical(daily: DataFrame) -> DataFrame:
    last = one_row(daily.filter("has_sales_observation = 1").agg(F.max("date").alias("d")))["d"]
    return daily.filter(F.col("date") <= last)


def weekly_summary(daily: DataFrame) -> DataFrame:
    """Monday to Sunday weeks up to the last observed day."""
    return (
        _historical(daily).groupBy(F.date_trunc("week", "date").cast("date").alias("week_start"))
        .agg(F.sum("total_sales").alias("total_sales"),
             F.sum("has_sales_observation").alias("observed_days"),
             F.count(F.lit(1)).alias("calendar_days"))
        .withColumn("missing_sales_dates", F.col("calendar_days") - F.col("observed_days"))
    )


def strict_growth(monthly: DataFrame, months: int, name: str) -> DataFrame:
    """Growth over the month ``months`` earlier; both months must be fully observed."""
    before = monthly.filter("is_complete_observation_month").select(
        F.add_months("month_start", months).alias("month_start"), F.col("total_sales").alias("_before"))
    growth = F.when(F.col("is_complete_observation_month"), safe_ratio("total_sales", "_before") - 1)
    return monthly.join(before, "month_start", "left").withColumn(name, growth).drop("_before")


def monthly_summary(daily: DataFrame) -> DataFrame:
    last = one_row(daily.filter("has_sales_observation = 1").agg(F.max("date").alias("d")))["d"]
    monthly = (
        _historical(daily)
        .groupBy(F.date_trunc("month", "date").cast("date").alias("month_start"),
                 "year", "month", "month_name")
        .agg(F.sum("total_sales").alias("total_sales"),
             F.sum("has_sales_observation").alias("observed_days"),
             F.count(F.lit(1)).alias("calendar_days"))
        .withColumn("missing_sales_dates", F.col("calendar_days") - F.col("observed_days"))
        .withColumn("is_complete_observation_month",
                    (F.col("missing_sales_dates") == 0) & (F.last_day("month_start") <= last))
    )
    grown = strict_growth(strict_growth(monthly, 1, "mom_growth"), 12, "yoy_growth")
    return grown.select(
        F.date_format("month_start", "yyyy-MM").alias("year_month"), "year", "month", "month_name",
        "total_sales", "observed_days", "calendar_days", "missing_sales_dates",
        "is_complete_observation_month", "mom_growth", "yoy_growth")


def weekday_month_summary(daily: DataFrame) -> DataFrame:
    return (
        daily.filter("has_sales_observation = 1")
        .groupBy("month", "month_name", "day_of_week", "day_name")
        .agg(F.avg("total_sales").alias("average_sales"), F.count(F.lit(1)).alias("observed_days"))
    )


def weekday_month_pivot(summary: DataFrame) -> DataFrame:
    """One row per month, one column per weekday."""
    return summary.groupBy("month", "month_name").pivot("day_name", DAY_NAMES).agg(
        F.first("average_sales"))


def seasonality_findings(daily: DataFrame, weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """One finding per row with its number and, where it applies, its period."""
    observed = daily.filter("has_sales_observation = 1")
    end = one_row(observed.agg(F.max("date").alias("d")))["d"]
    year_start = F.trunc(end, "year")
    current = F.col("date").between(year_start, end)
    previous = F.col("date").between(F.add_months(year_start, -12), F.add_months(end, -12))
    weekend, payday, sales = F.col("is_weekend") == 1, F.col("is_payday") == 1, F.col("total_sales")
    facts = observed.agg(
        F.min("date").alias("observed_start"), F.max("date").alias("observed_end"),
        F.count(F.lit(1)).cast("double").alias("observed_days"),
        F.max_by("total_sales", "date").alias("latest_daily_sales"),
        F.max_by("sales_ma_7", "date").alias("latest_ma_7"),
        F.max_by("sales_ma_28", "date").alias("latest_ma_28"),
        F.avg(F.when(weekend, sales)).alias("weekend_average"),
        F.avg(F.when(~weekend, sales)).alias("weekday_average"),
        F.avg(F.when(payday, sales)).alias("payday_average"),
        F.avg(F.when(~payday, sales)).alias("nonpayday_average"),
        F.sum(F.when(current, sales)).alias("year_to_date_sales"),
        F.sum(F.when(previous, sales)).alias("previous_year_to_date_sales"),
    ).withColumn("year_to_date_growth",
                 safe_ratio("year_to_date_sales", "previous_year_to_date_sales") - 1)
    end_text = F.col("observed_end").cast("string")
    numbers = ["observed_days", "latest_daily_sales", "latest_ma_7", "latest_ma_28", "weekend_average",
               "weekday_average", "payday_average", "nonpayday_average", "year_to_date_sales",
               "previous_year_to_date_sales", "year_to_date_growth"]
    rows = facts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("finding"), end_text.alias("period"), F.col(n).alias("value"))
        for n in numbers])))
    missing = _historical(daily).agg(
        F.count_if(F.col("has_sales_observation") == 0).cast("double").alias("value")).select(
        F.lit("missing_historical_dates").alias("finding"), F.lit(None).cast("string").alias("period"), "value")

    def peak(df: DataFrame, name: str, period: Column, value: str, by: Column) -> DataFrame:
        return df.filter(F.col(value).isNotNull()).agg(
            F.max_by(period.cast("string"), by).alias("period"), F.max_by(value, by).alias("value")
        ).select(F.lit(name).alias("finding"), "period", "value")

    return union_all([
        rows, missing,
        peak(weekly, "weekly_peak", F.col("week_start"), "total_sales",
             F.struct("total_sales", -F.unix_date("week_start"))),
        peak(monthly, "latest_month", F.col("year_month"), "total_sales", F.col("year_month")),
        peak(monthly, "latest_month_over_month", F.col("year_month"), "mom_growth", F.col("year_month")),
        peak(monthly, "latest_year_over_year", F.col("year_month"), "yoy_growth", F.col("year_month")),
    ])
