"""Holiday and event analysis on the complete store-day grid."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, flag, has_token, safe_ratio
from shelfcast.functions.quantiles import with_quantiles
from shelfcast.operators.audit import union_all
from shelfcast.schemas import HOLIDAY_FLAGS, HOLIDAY_TEXTS

Tables = Mapping[str, DataFrame]
BASELINE_LAGS = (7, 14, 21, 28)
MIN_EVENT_ROWS = 30
# Event category and the flag column that puts a row into it.
EVENT_CATEGORIES = {
    "National holiday": "is_national_holiday", "Regional holiday": "is_regional_holiday",
    "Local holiday": "is_local_holiday", "Holiday": "is_type_holiday", "Transfer": "is_transfer",
    "Additional": "is_additional", "Bridge": "is_bridge", "Event": "is_event", "Work Day": "is_work_day",
    "Payday + holiday": "is_payday_holiday",
}


def store_day_frame(t: Tables) -> DataFrame:
    """Every store-day with sales, holiday texts and flags; missing sales stay missing.

    The stored grid already carries the holiday mapping, so only sales are joined to it.
    """
    sales = t["fact_daily_sales"].groupBy("date_key", "store_key").agg(F.sum("sales").alias("actual_sales"))
    days = t["dim_date"].select("date_key", "full_date", "day_of_week", "day_name", "is_payday")
    frame = (
        t["dim_store_date"].select("date_key", "store_key", "holiday_count", *HOLIDAY_TEXTS, *HOLIDAY_FLAGS)
        .join(sales, ["date_key", "store_key"], "left").join(days, "date_key")
        .join(t["dim_store"].select("store_key", "store_nbr", "city", "state"), "store_key")
    )
    holiday = F.col("is_holiday") == 1
    mapped = F.col("holiday_count") > 0
    scopes = {f"is_{s.lower()}_holiday": flag(has_token("holiday_locales", s) & holiday)
              for s in ("National", "Regional", "Local")}
    kinds = {"is_type_holiday": "Holiday", "is_transfer": "Transfer", "is_additional": "Additional",
             "is_bridge": "Bridge"}
    return frame.withColumns({
        **scopes, **{c: flag(has_token("holiday_types", token)) for c, token in kinds.items()},
        "is_payday_holiday": flag((F.col("is_payday") == 1) & holiday),
        "has_holiday_mapping": flag(mapped), "is_special_day": flag(mapped),
        "sales_observation_status": F.when(F.col("actual_sales").isNull(), "left_only").otherwise("both"),
        "holiday_mapping_status": F.when(mapped, "both").otherwise("left_only"),
    })


def add_baselines(frame: DataFrame) -> DataFrame:
    """Mean of the same weekday in the four weeks before, only when all four were observed.

    The grid has one row per store and day, so a row offset is a calendar offset and each
    window partition is one store's calendar.
    """
    by_store = Window.partitionBy("store_key").orderBy("full_date")
    result = frame.withColumns({f"sales_lag_{n}d": F.lag("actual_sales", n).over(by_store) for n in BASELINE_LAGS}
                               | {f"special_day_lag_{n}d": F.lag("is_special_day", n).over(by_store)
                                  for n in BASELINE_LAGS})
    lags = [F.col(f"sales_lag_{n}d") for n in BASELINE_LAGS]
    special = [F.col(f"special_day_lag_{n}d") for n in BASELINE_LAGS]
    present = reduce(lambda a, b: a + b, [flag(c.isNotNull()) for c in lags])
    complete = F.col("baseline_observation_count") == len(lags)
    some_special = reduce(lambda a, b: a | b, [c.isNotNull() for c in special])
    count_special = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in special])
    result = result.withColumn("baseline_observation_count", present).withColumns({
        "baseline_sales": F.when(complete, reduce(lambda a, b: a + b, lags) / len(lags)),
        "baseline_special_day_count": F.when(some_special, count_special),
        "baseline_status": F.when(complete, "Complete four-week baseline").otherwise("Incomplete baseline retained"),
    })
    result = result.withColumn("difference", F.col("actual_sales") - F.col("baseline_sales")).withColumn(
        "difference_pct", safe_ratio("difference", "baseline_sales") * 100)
    ordinary = frame.filter("is_special_day = 0").groupBy("store_key", "day_of_week").agg(
        F.avg("actual_sales").alias("same_weekday_regular_average_sales"))
    return (
        result.join(ordinary, ["store_key", "day_of_week"], "left")
        .withColumn("same_weekday_regular_difference",
                    F.col("actual_sales") - F.col("same_weekday_regular_average_sales"))
        .withColumn("same_weekday_regular_difference_pct", safe_ratio(
            "same_weekday_regular_difference", "same_weekday_regular_average_sales") * 100)
    )


def add_windows_and_warnings(frame: DataFrame) -> DataFrame:
    """Before, during and after labels, and a warning for rarely observed events.

    Event counts are aggregated and joined back: the label of ordinary days would make a
    window partition as large as the table.
    """
    by_store = Window.partitionBy("store_key").orderBy("full_date")
    result = frame.withColumns({
        "is_day_before_holiday": F.coalesce(F.lead("is_holiday", 1).over(by_store), F.lit(0)),
        "is_day_after_holiday": F.coalesce(F.lag("is_holiday", 1).over(by_store), F.lit(0)),
        "event_label": F.when(F.col("holiday_descriptions") == "", "Regular day")
        .otherwise(F.col("holiday_descriptions")),
    }).withColumn("holiday_window", choose([
        (F.col("is_holiday") == 1, "During holiday"), (F.col("is_day_before_holiday") == 1, "Before holiday"),
        (F.col("is_day_after_holiday") == 1, "After holiday")], "Other day"))
    label = F.when(F.col("holiday_descriptions") == "", "Regular day").otherwise(F.col("holiday_descriptions"))
    counts = frame.groupBy(label.alias("event_label")).agg(F.count("actual_sales").alias("event_observation_count"))
    rare = (F.col("has_holiday_mapping") == 1) & (F.col("event_observation_count") < MIN_EVENT_ROWS)
    return result.join(counts, "event_label").withColumn(
        "small_event_warning", F.when(rare, "Event below minimum observation count").otherwise(""))


def holiday_frame(t: Tables) -> DataFrame:
    return add_windows_and_warnings(add_baselines(store_day_frame(t)))


def category_summary(frame: DataFrame) -> DataFrame:
    """Overlapping categories: a store-day counts in each category it belongs to."""
    labels = [F.when(F.col("is_special_day") == 0, F.lit("Regular day"))] + [
        F.when(F.col(c) == 1, F.lit(label)) for label, c in EVENT_CATEGORIES.items()]
    long = frame.select("actual_sales", "baseline_sales", "difference", "difference_pct", "is_payday",
                        F.explode(F.array_compact(F.array(*labels))).alias("event_category"))
    keys = ["event_category"]
    summary = long.groupBy(*keys).agg(
        F.count("actual_sales").alias("observation_count"), F.avg("actual_sales").alias("average_actual_sales"),
        F.stddev_samp("actual_sales").alias("actual_sales_std"),
        F.avg("baseline_sales").alias("average_baseline_sales"), F.avg("difference").alias("average_difference"),
        F.avg("difference_pct").alias("average_difference_pct"), F.sum("is_payday").alias("payday_observation_count"))
    return with_quantiles(summary, long, keys, {
        "median_actual_sales": ("actual_sales", 0.5), "median_difference": ("difference", 0.5),
        "median_difference_pct": ("difference_pct", 0.5), "q25_difference_pct": ("difference_pct", 0.25),
        "q75_difference_pct": ("difference_pct", 0.75),
    }).withColumn("small_sample_warning", F.when(
        F.col("observation_count") < MIN_EVENT_ROWS, "Category below minimum observation count").otherwise(""))


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def payday_holiday_groups(frame: DataFrame) -> DataFrame:
    group = choose([(F.col("is_payday_holiday") == 1, "Payday + holiday"), (F.col("is_holiday") == 1, "Holiday only"),
                    (F.col("is_payday") == 1, "Payday only")], "Neither").alias("payday_holiday_group")
    rows = frame.select(group, "difference_pct").filter("difference_pct IS NOT NULL")
    keys = ["payday_holiday_group"]
    summary = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"), F.avg("difference_pct").alias("average_difference_pct"))
    return with_quantiles(summary, rows, keys, {
        f"{name}_difference_pct": ("difference_pct", p) for name, p in QUARTILES.items()})


def log_sales_distributions(frame: DataFrame) -> DataFrame:
    """Quartiles of log1p sales by weekday and holiday status, and by holiday window."""
    status = F.when(F.col("is_holiday") == 1, "Holiday").otherwise("Regular")
    views = F.array(
        F.struct(F.lit("weekday").alias("view"), F.concat_ws(" / ", F.col("day_name"), status).alias("group_value")),
        F.struct(F.lit("holiday_window").alias("view"), F.col("holiday_window").alias("group_value")))
    rows = frame.filter("actual_sales IS NOT NULL").select(
        F.log1p("actual_sales").alias("log_sales"), F.inline(views))
    keys = ["view", "group_value"]
    summary = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("observation_count"),
                                      F.min("log_sales").alias("minimum"), F.max("log_sales").alias("maximum"))
    return with_quantiles(summary, rows, keys, {name: ("log_sales", p) for name, p in QUARTILES.items()})


def limit_counters(frame: DataFrame) -> DataFrame:
    counted = frame.agg(
        F.count_if(F.col("holiday_count") > 1).alias("multi_event_store_days"),
        F.count_if(F.col("baseline_observation_count") < 4).alias("incomplete_baselines"),
        F.count_if((F.col("has_holiday_mapping") == 1) & F.col("actual_sales").isNull())
        .alias("special_days_without_sales"))
    rare = frame.filter("small_event_warning <> ''").select("event_label").distinct().agg(
        F.count(F.lit(1)).alias("rarely_observed_events"))
    return union_all([
        df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in df.columns])))
        for df in (counted, rare)])
