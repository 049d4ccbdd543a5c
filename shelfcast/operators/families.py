"""Family performance and family-level forecast readiness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, flag, one_row, rank_desc, safe_ratio
from shelfcast.functions.quantiles import exact_quantiles, with_quantiles
from shelfcast.operators.audit import union_all

Tables = Mapping[str, DataFrame]
# Rank column per metric.
FAMILY_RANKS = {
    "total_sales": "rank_total_sales", "coefficient_of_variation": "rank_volatility",
    "zero_sales_rate": "rank_zero_sales_rate", "promotion_rate": "rank_promotion_rate",
}


def active_store_counts(t: Tables) -> DataFrame:
    """Stores with any positive sale per family, de-duplicated before they are counted."""
    sold = t["fact_daily_sales"].groupBy("family_key", "store_key").agg(
        F.max(flag(F.col("sales") > 0)).alias("_sold"))
    return sold.groupBy("family_key").agg(F.sum("_sold").alias("number_of_active_stores"))


def monthly_growth(t: Tables) -> DataFrame:
    """Median growth over the month before, per family."""
    month = F.floor(F.col("date_key") / 100).cast("int")
    monthly = t["fact_daily_sales"].groupBy("family_key", month.alias("_month")).agg(F.sum("sales").alias("_s"))
    before = F.lag("_s").over(Window.partitionBy("family_key").orderBy("_month"))
    growth = monthly.withColumn("_p", before).withColumn("_g", safe_ratio(F.col("_s") - F.col("_p"), "_p"))
    return growth.groupBy("family_key").agg(F.median("_g").alias("monthly_growth"))


def family_performance(t: Tables) -> DataFrame:
    fact = t["fact_daily_sales"]
    summary = fact.groupBy("family_key").agg(
        F.sum("sales").alias("total_sales"), F.avg("sales").alias("average_sales"),
        F.stddev_samp("sales").alias("sales_std"),
        F.avg((F.col("sales") == 0).cast("double")).alias("zero_sales_rate"),
        F.avg("is_promotion").alias("promotion_rate"),
    )
    summary = with_quantiles(summary, fact, ["family_key"], {"median_sales": ("sales", 0.5)})
    everything = one_row(fact.agg(F.sum("sales").alias("s")))["s"]
    joined = (
        summary.join(active_store_counts(t), "family_key").join(monthly_growth(t), "family_key")
        .join(t["dim_family"], "family_key")
        .withColumn("coefficient_of_variation", safe_ratio("sales_std", "average_sales"))
        .withColumn("sales_contribution_rate", safe_ratio(F.col("total_sales"), everything))
    )
    ranked = joined.withColumns({
        name: rank_desc(metric, Window.partitionBy(F.lit(0)).orderBy(F.col(metric).desc_nulls_last()))
        for metric, name in FAMILY_RANKS.items()})
    return ranked.select(
        "family", "total_sales", "average_sales", "median_sales", "sales_std", "coefficient_of_variation",
        "zero_sales_rate", "promotion_rate", "number_of_active_stores", "monthly_growth",
        "sales_contribution_rate", *FAMILY_RANKS.values())


def family_readiness(performance: DataFrame) -> DataFrame:
    """One segment per family; the first matching rule wins."""
    limits = one_row(performance.agg(
        F.median("total_sales").alias("volume_threshold_median"),
        F.median("coefficient_of_variation").alias("volatility_threshold_median"),
        F.percentile("zero_sales_rate", F.lit(0.75)).alias("intermittency_threshold_q75"),
        F.percentile("promotion_rate", F.lit(0.75)).alias("promotion_dependency_threshold_q75")))
    high = F.col("total_sales") >= F.col("volume_threshold_median")
    shaky = F.coalesce(F.col("coefficient_of_variation") > F.col("volatility_threshold_median"), F.lit(False))
    rules = [
        (F.col("promotion_rate") >= F.col("promotion_dependency_threshold_q75"),
         "Promotion dependent", "promotion_rate >= Q75"),
        (high & ~shaky, "High volume – stable", "total_sales >= median and CV <= median"),
        (high & shaky, "High volume – volatile", "total_sales >= median and CV > median"),
        (~high & (F.col("zero_sales_rate") >= F.col("intermittency_threshold_q75")),
         "Low volume – intermittent", "total_sales < median and zero_sales_rate >= Q75"),
    ]
    return performance.withColumns(limits).withColumns({
        "forecast_readiness": choose([(c, label) for c, label, _ in rules], "Low volume – stable"),
        "segmentation_rule": choose([(c, text) for c, _, text in rules],
                                    "total_sales < median and zero_sales_rate < Q75"),
    })


def top_families(performance: DataFrame, metrics: list[str], n: int = 15) -> DataFrame:
    """The ``n`` largest families per metric."""
    long = performance.select("family", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    best = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), "family")
    return long.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= n)


def family_findings(performance: DataFrame) -> DataFrame:
    leaders = [("largest_sales", "total_sales"), ("highest_volatility", "coefficient_of_variation"),
               ("highest_zero_sales_rate", "zero_sales_rate"), ("highest_promotion_rate", "promotion_rate")]
    return union_all([
        performance.filter(F.col(metric).isNotNull()).agg(
            F.min_by("family", F.struct(-F.col(metric), F.col("family"))).alias("family"),
            F.max(metric).alias("value")).select(F.lit(name).alias("finding"), "family", "value")
        for name, metric in leaders])


def capped_histogram(df: DataFrame, column: str, bins: int = 60, cap: float = 0.99) -> DataFrame:
    """Counts in equal-width bins after clipping at an exact upper quantile; the last bin is closed."""
    limit = one_row(exact_quantiles(df, [], {"cap": (column, cap)}))["cap"]
    low = one_row(df.agg(F.min(column).alias("low")))["low"]
    clipped = df.filter(F.col(column).isNotNull()).select(
        F.least(F.col(column), limit).alias("v"), low.alias("low"), limit.alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    position = F.coalesce(F.try_divide(F.col("v") - F.col("low"), width), F.lit(0.0))
    return (
        clipped.withColumn("bin", F.least(F.floor(position), F.lit(bins - 1)).cast("int"))
        .withColumn("bin_start", F.col("low") + F.col("bin") * width)
        .groupBy("bin", "bin_start").agg(F.count(F.lit(1)).alias("row_count"))
    )


def zero_and_promotion_shares(train: DataFrame) -> DataFrame:
    """Share of zero and positive rows, and of store-days with any promotion."""
    days = train.groupBy("date", "store_nbr").agg(F.max("is_promotion").alias("p"))
    return union_all([
        train.agg(F.avg((F.col("sales") == 0).cast("double")).alias("value")).select(
            F.lit("zero_sales_row_share").alias("measure"), "value"),
        train.agg(F.avg((F.col("sales") > 0).cast("double")).alias("value")).select(
            F.lit("positive_sales_row_share").alias("measure"), "value"),
        days.agg(F.avg("p").alias("value")).select(F.lit("promotion_store_day_share").alias("measure"), "value"),
    ])
