"""Unusual sales days, per store and for the whole system, with their business context."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, flag, safe_ratio
from shelfcast.operators.audit import union_all

Tables = Mapping[str, DataFrame]
ROLLING_ROWS, ROLLING_MIN_ROWS, Z_LIMIT = 28, 14, 3.0
IQR_FENCE = 1.5
MATERIAL_PROMOTION_RATE = 0.25
ISSUE_Z_LIMIT = 6.0
STORE_LEVEL, SYSTEM_LEVEL = "store_day", "system_day"
OUTPUT = [
    "analysis_level", "date", "store_nbr", "actual_sales", "expected_sales", "difference", "z_score",
    "is_holiday", "is_event", "is_promotion", "promotion_rate", "material_promotion_context",
    "rolling_expected_sales", "rolling_sales_std", "rolling_z_anomaly", "weekday_median_sales",
    "weekday_q1_sales", "weekday_q3_sales", "weekday_iqr_sales", "weekday_iqr_score", "weekday_iqr_anomaly",
    "weekday_observation_count", "anomaly_method", "review_category", "review_guidance",
]


def store_daily(t: Tables) -> DataFrame:
    keys = ["date_key", "store_key"]
    daily = t["fact_daily_sales"].groupBy(*keys).agg(
        F.sum("sales").alias("actual_sales"), F.max("is_promotion").alias("is_promotion"),
        F.avg("is_promotion").alias("promotion_rate"))
    context = t["bridge_store_holiday"].select(*keys, "is_holiday", "is_event")
    return (
        daily.join(context, keys, "left")
        .join(t["dim_date"].select("date_key", "full_date", "day_of_week", "day_name"), "date_key")
        .join(t["dim_store"].select("store_key", "store_nbr"), "store_key")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("is_holiday", "is_event")})
    )


def system_daily(stores: DataFrame) -> DataFrame:
    return stores.groupBy("date_key", "full_date", "day_of_week", "day_name").agg(
        F.sum("actual_sales").alias("actual_sales"), F.max("is_holiday").alias("is_holiday"),
        F.max("is_event").alias("is_event"), F.max("is_promotion").alias("is_promotion"),
        F.avg("promotion_rate").alias("promotion_rate"),
    ).withColumn("store_nbr", F.lit(None).cast("int"))


def add_rolling_scores(frame: DataFrame) -> DataFrame:
    """Z-score against the 28 rows before; a window partition is one store's (or the system's) days."""
    before = Window.partitionBy("store_nbr").orderBy("full_date").rowsBetween(-ROLLING_ROWS, -1)
    enough = F.count("actual_sales").over(before) >= ROLLING_MIN_ROWS
    scored = frame.withColumns({
        "rolling_expected_sales": F.when(enough, F.avg("actual_sales").over(before)),
        "rolling_sales_std": F.when(enough, F.stddev_samp("actual_sales").over(before)),
    }).withColumn("z_score", safe_ratio(
        F.col("actual_sales") - F.col("rolling_expected_sales"), "rolling_sales_std"))
    return scored.withColumn("rolling_z_anomaly", flag(F.abs("z_score") >= Z_LIMIT))


def add_weekday_scores(frame: DataFrame) -> DataFrame:
    """Tukey fences of the same weekday; groups are bounded by the calendar."""
    keys = ["store_nbr", "day_of_week"]
    quartiles = F.percentile("actual_sales", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    peers = frame.groupBy(*keys).agg(quartiles.alias("_q"), F.count(F.lit(1)).alias("weekday_observation_count"))
    peers = peers.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_q")[0].alias("weekday_q1_sales"),
        F.col("_q")[1].alias("weekday_median_sales"), F.col("_q")[2].alias("weekday_q3_sales"),
        "weekday_observation_count")
    same = F.col("store_nbr").eqNullSafe(F.col("_store_nbr")) & (F.col("day_of_week") == F.col("_day_of_week"))
    joined = frame.join(peers, same).drop("_store_nbr", "_day_of_week")
    low, high = F.col("weekday_q1_sales"), F.col("weekday_q3_sales")
    sales, iqr = F.col("actual_sales"), F.col("weekday_iqr_sales")
    return joined.withColumn("weekday_iqr_sales", high - low).withColumns({
        "weekday_iqr_score": safe_ratio(sales - F.col("weekday_median_sales"), "weekday_iqr_sales"),
        "weekday_iqr_anomaly": flag((sales < low - iqr * IQR_FENCE) | (sales > high + iqr * IQR_FENCE)),
    })


def classify(frame: DataFrame, level: str) -> DataFrame:
    """Rows flagged by either method with method, review category and guidance."""
    by_z, by_iqr = F.col("rolling_z_anomaly") == 1, F.col("weekday_iqr_anomaly") == 1
    scored = add_weekday_scores(add_rolling_scores(frame)).filter(by_z | by_iqr)
    context = ((F.col("is_holiday") == 1) | (F.col("is_event") == 1)
               | (F.col("promotion_rate") >= MATERIAL_PROMOTION_RATE))
    issue = ~context & ((F.col("actual_sales") == 0) | (
        by_z & by_iqr & F.coalesce(F.abs("z_score") >= ISSUE_Z_LIMIT, F.lit(False))))
    event, suspect, rest = "Business event", "Potential data issue", "Unexplained anomaly"
    return scored.withColumns({
        "analysis_level": F.lit(level),
        "anomaly_method": choose([(by_z & by_iqr, "Rolling z-score + weekday IQR"), (by_z, "Rolling z-score")],
                                 "Weekday IQR"),
        "material_promotion_context": flag(F.col("promotion_rate") >= MATERIAL_PROMOTION_RATE),
        "review_category": choose([(context, event), (issue, suspect)], rest),
        "review_guidance": choose([
            (context, "Known business context overlaps the flag; review, do not treat as error"),
            (issue, "Extreme or zero value without mapped context; investigate source records")],
            "No mapped business context; investigate before drawing conclusions"),
        "expected_sales": F.coalesce("rolling_expected_sales", "weekday_median_sales"),
    }).withColumn("difference", F.col("actual_sales") - F.col("expected_sales")).withColumnRenamed(
        "full_date", "date").select(*OUTPUT)


def sales_anomalies(t: Tables) -> DataFrame:
    stores = store_daily(t)
    return union_all([classify(system_daily(stores), SYSTEM_LEVEL), classify(stores, STORE_LEVEL)])


def scored_days(t: Tables) -> DataFrame:
    """Both scores for every store-day, flagged or not."""
    return add_weekday_scores(add_rolling_scores(store_daily(t)))
