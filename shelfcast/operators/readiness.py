"""Forecast readiness of every store x family series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, flag, one_row, safe_ratio
from shelfcast.functions.quantiles import exact_quantiles
from shelfcast.schemas import STORE_ATTRIBUTES

Tables = Mapping[str, DataFrame]
SHORT_HISTORY_DAYS, MIN_ACTIVE_DAYS, READY_HISTORY_DAYS = 365, 90, 730
RISK_FLAGS = ["is_insufficient_history", "is_intermittent", "is_promotion_dependent", "is_high_volatility"]
CLASSES = ["Ready", "Ready with caution", "Intermittent demand", "Insufficient history", "High volatility",
           "Promotion dependent"]
ISSUE_CLASSES = ["Intermittent demand", "Insufficient history", "High volatility", "Promotion dependent"]
# Threshold name, metric and quantile over the eligible series.
THRESHOLDS = {
    "zero_sales_rate_median": ("zero_sales_rate", 0.5), "zero_sales_rate_q75": ("zero_sales_rate", 0.75),
    "cv_median": ("coefficient_of_variation", 0.5), "cv_q75": ("coefficient_of_variation", 0.75),
    "promotion_rate_q75": ("promotion_rate", 0.75), "missing_period_count_q75": ("missing_period_count", 0.75),
}


def series_metrics(t: Tables) -> DataFrame:
    """Metrics between a series' first and last positive sale, for the full series matrix.

    One shuffle of the fact by series serves both steps: the window that finds the active
    span and the aggregation inside it.
    """
    keys = ["store_key", "family_key"]
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    series = Window.partitionBy(*keys)
    sold = F.when(F.col("sales") > 0, F.col("_day"))
    spans = (
        t["fact_daily_sales"].select(*keys, "sales", "is_promotion", day.alias("_day"))
        .withColumn("history_start", F.min(sold).over(series))
        .withColumn("history_end", F.max(sold).over(series))
        .filter(F.col("_day").between(F.col("history_start"), F.col("history_end")))
    )
    # The grain is unique per day, so rows are days.
    metrics = spans.groupBy(*keys).agg(
        F.first("history_start").alias("history_start"), F.first("history_end").alias("history_end"),
        F.count_if(F.col("sales") > 0).alias("active_days"), F.count(F.lit(1)).alias("observed_period_count"),
        F.avg("sales").alias("average_sales"), F.stddev_samp("sales").alias("sales_std"),
        F.avg((F.col("sales") == 0).cast("double")).alias("zero_sales_rate"),
        F.avg("is_promotion").alias("promotion_rate"))
    # The family dimension is small by its key limit; each store row lists all families.
    families = one_row(t["dim_family"].agg(F.collect_list(F.struct("family_key", "family")).alias("f")))["f"]
    matrix = t["dim_store"].select("store_key", *STORE_ATTRIBUTES, F.inline(families))
    joined = matrix.join(metrics, keys, "left")
    active = F.col("history_start").isNotNull()

    def default(column: str, value: object) -> Column:
        return F.when(active, F.col(column)).otherwise(F.lit(value))

    return joined.withColumns({
        "history_length": F.when(active, F.datediff("history_end", "history_start") + 1).otherwise(0).cast("long"),
        "active_days": default("active_days", 0), "observed_period_count": default("observed_period_count", 0),
        "average_sales": default("average_sales", 0.0), "sales_std": default("sales_std", 0.0),
        "zero_sales_rate": default("zero_sales_rate", 1.0), "promotion_rate": default("promotion_rate", 0.0),
        "has_positive_sales": flag(active),
    }).withColumns({
        "missing_period_count": F.greatest(F.col("history_length") - F.col("observed_period_count"), F.lit(0)),
        "coefficient_of_variation": safe_ratio("sales_std", "average_sales"),
    })


def classify_series(metrics: DataFrame) -> DataFrame:
    """Independent risk flags, one class by priority, and the thresholds used."""
    short = (F.col("history_length") < SHORT_HISTORY_DAYS) | (F.col("active_days") < MIN_ACTIVE_DAYS)
    limits = one_row(exact_quantiles(metrics.filter(~short), [], THRESHOLDS))
    no = F.lit(False)
    limited = metrics.withColumns({name: limits[name] for name in THRESHOLDS})
    flagged = limited.withColumns({
        "is_insufficient_history": flag(short),
        "is_intermittent": flag(F.col("zero_sales_rate") >= F.col("zero_sales_rate_q75")),
        "is_promotion_dependent": flag(F.col("promotion_rate") >= F.col("promotion_rate_q75")),
        "is_high_volatility": flag(F.col("coefficient_of_variation") >= F.col("cv_q75")),
    })
    count = sum((F.col(c) for c in RISK_FLAGS[1:]), F.col(RISK_FLAGS[0]))
    good = ((F.col("history_length") >= READY_HISTORY_DAYS)
            & (F.col("zero_sales_rate") <= F.col("zero_sales_rate_median"))
            & (F.col("coefficient_of_variation") <= F.col("cv_median"))
            & (F.col("missing_period_count") <= F.col("missing_period_count_q75")))
    flagged = flagged.withColumn("risk_flag_count", count).withColumn(
        "is_ready", flag(F.coalesce(good, no) & (F.col("risk_flag_count") == 0)))
    rules = [
        ("is_insufficient_history", "Insufficient history",
         f"history_length < {SHORT_HISTORY_DAYS} or active_days < {MIN_ACTIVE_DAYS}"),
        ("is_intermittent", "Intermittent demand", "zero_sales_rate >= eligible-series Q75"),
        ("is_promotion_dependent", "Promotion dependent", "promotion_rate >= eligible-series Q75"),
        ("is_high_volatility", "High volatility", "coefficient_of_variation >= eligible-series Q75"),
        ("is_ready", "Ready", f"history_length >= {READY_HISTORY_DAYS}, zero-sales <= median, "
                              "CV <= median, and missing periods <= Q75"),
    ]
    return flagged.withColumns({
        "readiness_class": choose([(F.col(c) == 1, label) for c, label, _ in rules], "Ready with caution"),
        "classification_rule": choose([(F.col(c) == 1, text) for c, _, text in rules],
                                      "Sufficient history without an extreme Q75 risk flag"),
    })


def forecast_readiness(t: Tables) -> DataFrame:
    return classify_series(series_metrics(t)).select(
        "store_nbr", "family", "city", "state", "store_type", "cluster", "history_start", "history_end",
        "history_length", "active_days", "zero_sales_rate", "average_sales", "sales_std",
        "coefficient_of_variation", "promotion_rate", "observed_period_count", "missing_period_count",
        "has_positive_sales", *RISK_FLAGS, "is_ready", "risk_flag_count", "readiness_class",
        "classification_rule", *THRESHOLDS)


def overlap_summary(readiness: DataFrame, dimension: str) -> DataFrame:
    """Series with two or more risk flags by dimension."""
    flags = F.col("risk_flag_count")
    return readiness.groupBy(F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("group_value")).agg(
        F.count(F.lit(1)).alias("series_count"), F.count_if(flags >= 2).alias("overlapping_risk_series"),
        F.sum(flags).alias("total_risk_flags"), F.avg(flags).alias("average_risk_flags"),
        F.max(flags).alias("maximum_risk_flags"),
    ).withColumn("overlap_rate", safe_ratio("overlapping_risk_series", "series_count"))


def problem_summary(readiness: DataFrame, dimension: str) -> DataFrame:
    """Issue count, rate and most common issue; equal counts go to the first class name."""
    issue = F.col("readiness_class").isin(ISSUE_CLASSES)
    counts = readiness.groupBy(dimension, "readiness_class").agg(F.count(F.lit(1)).alias("_n"))
    best = F.struct(-F.col("_n"), F.col("readiness_class"))
    return counts.groupBy(F.lit(dimension).alias("dimension"), F.col(dimension).cast("string").alias("group_value")).agg(
        F.sum("_n").alias("series_count"),
        F.coalesce(F.sum(F.when(issue, F.col("_n"))), F.lit(0)).alias("issue_count"),
        F.min_by("readiness_class", F.when(issue, best)).alias("dominant_issue"),
    ).withColumn("issue_rate", safe_ratio("issue_count", "series_count"))


def distributions(readiness: DataFrame) -> DataFrame:
    """Class, flag and risk-count distributions in fixed order; empty categories count zero."""
    total = F.count(F.lit(1)).alias("_total")
    parts = [("class", c, F.count_if(F.col("readiness_class") == c)) for c in CLASSES]
    parts += [("flag", c, F.count_if(F.col(c) == 1)) for c in [*RISK_FLAGS, "is_ready"]]
    parts += [("risk_flag_count", str(n), F.count_if(F.col("risk_flag_count") == n)) for n in range(3)]
    parts.append(("risk_flag_count", "3+", F.count_if(F.col("risk_flag_count") >= 3)))
    one = readiness.agg(total, *[c.alias(f"_c{i}") for i, (_, _, c) in enumerate(parts)])
    return one.select("_total", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(view).alias("distribution"), F.lit(label).alias("category"),
                 F.col(f"_c{i}").alias("series_count"))
        for i, (view, label, _) in enumerate(parts)]))).select(
        "position", "distribution", "category", "series_count",
        (safe_ratio("series_count", "_total") * 100).alias("series_share_pct"))


def family_context(readiness: DataFrame, family_performance: DataFrame, n: int = 10) -> DataFrame:
    """The families with most issues beside their sales metrics."""
    worst = problem_summary(readiness, "family").withColumnRenamed("group_value", "family")
    return worst.orderBy(F.col("issue_count").desc(), F.col("issue_rate").desc(), "family").limit(n).join(
        family_performance.select("family", "zero_sales_rate", "coefficient_of_variation", "promotion_rate"), "family"
    ).select("family", "issue_count", "issue_rate", "dominant_issue", "zero_sales_rate",
             "coefficient_of_variation", "promotion_rate")


def store_context(readiness: DataFrame, store_performance: DataFrame, anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The stores with most issues beside their sales metrics and anomaly counts."""
    worst = problem_summary(readiness, "store_nbr").withColumn("store_nbr", F.col("group_value").cast("int"))
    flagged = anomalies.filter("analysis_level = 'store_day'").groupBy("store_nbr").agg(
        F.count(F.lit(1)).alias("_n"))
    return (
        worst.orderBy(F.col("issue_count").desc(), F.col("issue_rate").desc(), "store_nbr").limit(n)
        .join(store_performance.select("store_nbr", "average_daily_sales", "coefficient_of_variation"), "store_nbr")
        .join(flagged, "store_nbr", "left")
        .select("store_nbr", "issue_count", "issue_rate", "dominant_issue", "average_daily_sales",
                "coefficient_of_variation", F.coalesce("_n", F.lit(0)).alias("anomaly_count"))
    )


