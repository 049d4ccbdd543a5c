"""Store performance: totals, volatility, growth windows, segments and ranks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, flag, one_row, rank_desc, safe_ratio
from shelfcast.operators.audit import union_all

Tables = Mapping[str, DataFrame]
WINDOW_DAYS = 90
TOP_N = 10
# Rank column per metric.
STORE_RANKS = {
    "average_daily_sales": "rank_average_daily_sales",
    "recent_90d_growth": "rank_recent_90d_growth",
    "coefficient_of_variation": "rank_volatility",
    "sales_volume_per_transaction": "rank_sales_volume_per_transaction",
}


def store_daily_sales(t: Tables) -> DataFrame:
    daily = t["fact_daily_sales"].groupBy("date_key", "store_key").agg(F.sum("sales").alias("daily_sales"))
    return daily.join(t["dim_date"].select("date_key", "full_date"), "date_key")


def first_and_last_rows_growth(daily: DataFrame, key: str = "store_key", days: int = WINDOW_DAYS) -> DataFrame:
    """Mean of the last against the first ``days`` observed rows; a store-day window each."""
    ordered = Window.partitionBy(key)
    numbered = daily.select(
        key, "daily_sales",
        F.row_number().over(ordered.orderBy("full_date")).alias("_up"),
        F.row_number().over(ordered.orderBy(F.col("full_date").desc())).alias("_down"))
    first, last = F.col("first_window_average_daily_sales"), F.col("last_window_average_daily_sales")
    return numbered.groupBy(key).agg(
        F.avg(F.when(F.col("_up") <= days, F.col("daily_sales"))).alias("first_window_average_daily_sales"),
        F.avg(F.when(F.col("_down") <= days, F.col("daily_sales"))).alias("last_window_average_daily_sales"),
    ).withColumn("first_vs_last_90d_growth_proxy", safe_ratio(last - first, first))


def growth_window_bounds(latest: Column, days: int = WINDOW_DAYS) -> dict[str, tuple[Column, Column]]:
    """Recent window, the window before it, and the recent one a year earlier."""
    start = F.date_sub(latest, days - 1)
    return {
        "recent_90d": (start, latest),
        "previous_90d": (F.date_sub(latest, 2 * days - 1), F.date_sub(latest, days)),
        "yoy_90d": (F.add_months(start, -12), F.add_months(latest, -12)),
    }


def recent_growth(daily: DataFrame, key: str = "store_key", days: int = WINDOW_DAYS) -> DataFrame:
    """All three windows in one pass over the store-days; missing days stay missing."""
    latest = one_row(daily.agg(F.max("full_date").alias("d")))["d"]
    bounds = growth_window_bounds(latest, days)
    sums, edges = [], {}
    for name, (a, z) in bounds.items():
        inside = F.col("full_date").between(a, z)
        sums.append(F.sum(F.when(inside, F.col("daily_sales"))).alias(f"{name}_sales"))
        sums.append(F.count_if(inside).alias(f"{name}_observed_days"))
        edges[f"{name}_start_date"], edges[f"{name}_end_date"] = a, z
    recent, previous, year = (F.col(f"{n}_sales") for n in ("recent_90d", "previous_90d", "yoy_90d"))
    return (
        daily.groupBy(key).agg(*sums)
        .withColumn("recent_90d_growth", safe_ratio(recent - previous, previous))
        .withColumn("has_yoy_comparison", flag(F.col("yoy_90d_observed_days") > 0))
        .withColumn("recent_90d_yoy_growth", safe_ratio(recent - year, year))
        .withColumns(edges)
    )


def store_performance(t: Tables) -> DataFrame:
    daily = store_daily_sales(t)
    sales = daily.groupBy("store_key").agg(
        F.sum("daily_sales").alias("total_sales"), F.avg("daily_sales").alias("average_daily_sales"),
        F.stddev_samp("daily_sales").alias("sales_std"), F.count(F.lit(1)).alias("active_days"),
    ).withColumn("coefficient_of_variation", safe_ratio("sales_std", "average_daily_sales"))
    visits = t["fact_store_transactions"].groupBy("store_key").agg(
        F.sum("transactions").alias("total_transactions"))
    joined = (
        t["dim_store"].join(sales, "store_key").join(visits, "store_key", "left")
        .join(first_and_last_rows_growth(daily), "store_key").join(recent_growth(daily), "store_key")
        .withColumn("sales_volume_per_transaction", safe_ratio("total_sales", "total_transactions"))
    )
    return rank_stores(segment_stores(joined)).drop("store_key")


def segment_stores(performance: DataFrame) -> DataFrame:
    """Volume at or above the median against volatility above the median."""
    # One row per store: a dimension-sized input, so the built-in median is enough.
    limits = one_row(performance.agg(
        F.median("average_daily_sales").alias("sales"), F.median("coefficient_of_variation").alias("cv")))
    high = F.coalesce(F.col("average_daily_sales") >= F.col("sales_threshold_median"), F.lit(False))
    shaky = F.coalesce(F.col("coefficient_of_variation") > F.col("volatility_threshold_median"), F.lit(False))
    return performance.withColumns({
        "sales_threshold_median": limits["sales"], "volatility_threshold_median": limits["cv"],
    }).withColumn("performance_segment", choose([
        (high & ~shaky, "High sales – stable"), (high & shaky, "High sales – volatile"),
        (~high & ~shaky, "Low sales – stable")], "Low sales – volatile"))


def rank_stores(performance: DataFrame, ranks: Mapping[str, str] = STORE_RANKS) -> DataFrame:
    """Dense dimension-sized ranks, largest first; missing metrics stay unranked."""
    return performance.withColumns({
        name: rank_desc(metric, Window.partitionBy(F.lit(0)).orderBy(F.col(metric).desc_nulls_last()))
        for metric, name in ranks.items()})


def top_and_bottom(performance: DataFrame, metric: str, key: str = "store_nbr", n: int = TOP_N) -> DataFrame:
    """Distinct best and worst rows of one metric; at most half of the rows on each side."""
    known = performance.filter(F.col(metric).isNotNull()).select(key, metric)
    whole = Window.partitionBy(F.lit(0))
    numbered = known.select(
        key, metric, F.count(F.lit(1)).over(whole).alias("_all"),
        F.row_number().over(whole.orderBy(metric, key)).alias("_up"))
    size = F.least(F.lit(n), F.floor(F.col("_all") / 2))
    group = F.when(F.col("_up") <= size, "Bottom").when(F.col("_up") > F.col("_all") - size, "Top")
    return numbered.withColumn("ranking_group", group).filter("ranking_group IS NOT NULL").select(
        F.lit(metric).alias("metric"), "ranking_group", key, F.col(metric).alias("value"))


def attribute_averages(performance: DataFrame, attributes: list[str], n: int = 15) -> DataFrame:
    """Mean of the store averages by attribute, the ``n`` largest per attribute."""
    long = performance.select("average_daily_sales", F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("attribute_value"))
        for a in attributes])))
    means = long.groupBy("attribute", "attribute_value").agg(F.avg("average_daily_sales").alias("average_sales"))
    best = Window.partitionBy("attribute").orderBy(F.col("average_sales").desc(), "attribute_value")
    return means.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= n)


def store_findings(performance: DataFrame) -> DataFrame:
    """Leaders and laggards, one per row; equal metrics go to the smaller store number."""
    wanted = [
        ("highest_average_daily_sales", "average_daily_sales", 1),
        ("fastest_growth", "recent_90d_growth", 1), ("slowest_growth", "recent_90d_growth", -1),
        ("highest_volatility", "coefficient_of_variation", 1),
        ("highest_volume_per_transaction", "sales_volume_per_transaction", 1),
    ]
    rows = []
    for name, metric, sign in wanted:
        order = F.struct(F.col(metric) * sign, -F.col("store_nbr"))
        rows.append(performance.filter(F.col(metric).isNotNull()).agg(
            F.max_by("store_nbr", order).alias("store_nbr"), F.max_by(metric, order).alias("value"),
        ).select(F.lit(name).alias("finding"), "store_nbr", "value"))
    rows.append(performance.agg(F.count_if(F.col("recent_90d_growth").isNull()).cast("double").alias("value"))
                .select(F.lit("undefined_growth_stores").alias("finding"),
                        F.lit(None).cast("int").alias("store_nbr"), "value"))
    return union_all(rows)


def segment_counts(df: DataFrame, segment: str) -> DataFrame:
    return df.groupBy(F.col(segment).alias("segment")).agg(F.count(F.lit(1)).alias("members"))


