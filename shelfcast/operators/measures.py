"""Dashboard measures as aggregations at any grouping of the star schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import one_row, safe_ratio
from shelfcast.operators.stores import growth_window_bounds

Tables = Mapping[str, DataFrame]


DIMENSIONS = {"dim_date": "date_key", "dim_store": "store_key", "dim_family": "family_key"}


def _dimensions(t: Tables, columns: set[str]) -> dict[str, list[str]]:
    """Dimensions that hold wanted columns, each with those columns; a fact's own key needs no dimension."""
    keys, found, left = set(DIMENSIONS.values()), {}, set(columns) - set(DIMENSIONS.values())
    for name in DIMENSIONS:
        own = [c for c in t[name].columns if c in left and c not in keys]
        if own:
            found[name], left = own, left - set(own)
    if left:
        raise ValueError(f"no dimension holds: {', '.join(sorted(left))}")
    return found


def star(t: Tables, columns: list[str]) -> DataFrame:
    """Sales fact joined to the dimensions that hold ``columns`` and to no other."""
    joined = t["fact_daily_sales"]
    for name, own in _dimensions(t, set(columns)).items():
        joined = joined.join(t[name].select(DIMENSIONS[name], *own), DIMENSIONS[name])
    return joined


def additive(t: Tables, group: list[str], sums: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Sums of the sales fact by attributes of its dimensions.

    The fact is aggregated to the keys of the dimensions that the grouping needs first, so a join carries at most one row per
    combination of keys; its attributes are then grouped again. ``where`` restricts the fact by its own columns.
    """
    wanted = _dimensions(t, set(group))
    keys = [k for name, k in DIMENSIONS.items() if name in wanted or k in group]
    fact = t["fact_daily_sales"] if where is None else t["fact_daily_sales"].filter(where)
    rows = fact.groupBy(*keys).agg(*[F.sum(v).alias(name) for name, v in sums.items()])
    for name, own in wanted.items():
        rows = rows.join(t[name].select(DIMENSIONS[name], *own), DIMENSIONS[name])
    return rows.groupBy(*group).agg(*[F.sum(name).alias(name) for name in sums])


def _date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def transaction_star(t: Tables, group: list[str]) -> DataFrame:
    """Transactions with store and date only: they cannot be filtered by family."""
    if "family" in group or "family_key" in group:
        raise ValueError("transactions have no family grain")
    return t["fact_store_transactions"].join(t["dim_date"], "date_key").join(t["dim_store"], "store_key")


def volume_over_time(t: Tables, group: list[str]) -> DataFrame:
    """Daily total with 7 and 28 day averages and growth over the same day a year before.

    Window partitions are one group's days; the year-before value is an equi-join.
    """
    daily = additive(t, [*group, "full_date"], {"total_sales": F.col("sales")})
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("full_date")
    before = daily.select(*group, F.col("full_date").alias("_year_ago"), F.col("total_sales").alias("_before"))
    aligned = daily.withColumn("_year_ago", F.add_months("full_date", -12))
    return aligned.join(before, [*group, "_year_ago"], "left").select(
        *group, "full_date", "total_sales",
        F.avg("total_sales").over(order.rowsBetween(-6, 0)).alias("sales_7d_moving_average"),
        F.avg("total_sales").over(order.rowsBetween(-27, 0)).alias("sales_28d_moving_average"),
        (safe_ratio(F.col("total_sales") - F.col("_before"), "_before") * 100).alias("yoy_growth_pct"))


def volume_and_coverage(t: Tables, group: list[str]) -> DataFrame:
    """Total, average per day, active stores and families, zero-sales rate; keys stand for stores and families."""
    sold = F.col("sales") > 0
    return star(t, group).groupBy(*group).agg(
        F.sum("sales").alias("total_sales_volume"), F.count_distinct("date_key").alias("_days"),
        F.count_distinct(F.when(sold, F.col("store_key"))).alias("active_stores"),
        F.count_distinct(F.when(sold, F.col("family_key"))).alias("active_families"),
        F.avg((F.col("sales") == 0).cast("double")).alias("zero_sales_observation_rate"),
    ).withColumn("average_daily_sales", safe_ratio("total_sales_volume", "_days")).drop("_days")


def transaction_measures(t: Tables, group: list[str]) -> DataFrame:
    visits = transaction_star(t, group).groupBy(*group).agg(
        F.sum("transactions").alias("total_transactions"), F.count_distinct("date_key").alias("_days"))
    sales = t["fact_daily_sales"].groupBy("date_key", "store_key").agg(F.sum("sales").alias("sales")).join(
        t["dim_date"], "date_key").join(t["dim_store"], "store_key").groupBy(*group).agg(
        F.sum("sales").alias("total_sales_volume"))
    return visits.join(sales, group, "left").select(
        *group, "total_transactions", safe_ratio("total_transactions", "_days").alias("average_daily_transactions"),
        safe_ratio("total_sales_volume", "total_transactions").alias("sales_volume_per_transaction"))


def store_momentum(t: Tables, group: list[str]) -> DataFrame:
    """Sales of the last 90 days against the 90 before; every group is listed, only the days of both windows are summed."""
    days = t["dim_date"].join(t["fact_daily_sales"].agg(F.max("date_key").alias("date_key")), "date_key")
    latest = one_row(days.agg(F.max("full_date").alias("d")))["d"]
    bounds = growth_window_bounds(latest)

    def key_bounds(name: str) -> list[Column]:
        return [_date_key(day) for day in bounds[name]]

    def total(name: str) -> Column:
        return F.when(F.col("date_key").between(*key_bounds(name)), F.col("sales"))

    recent, previous = F.col("recent_90d_sales"), F.col("previous_90d_sales")
    seen = additive(t, group, {"recent_90d_sales": total("recent_90d"), "previous_90d_sales": total("previous_90d")},
                    F.col("date_key") >= key_bounds("previous_90d")[0])
    everyone = star(t, group).select(*group).distinct()
    return everyone.join(seen, group, "left").withColumn("recent_90d_growth_pct", safe_ratio(recent - previous, previous) * 100)


def promotion_measures(t: Tables, group: list[str]) -> DataFrame:
    promoted = F.col("is_promotion") == 1
    a, b = safe_ratio("_a", "_na"), safe_ratio("_b", "_nb")
    sums = {"_p": F.col("is_promotion"), "_n": F.lit(1), "_a": F.when(promoted, F.col("sales")), "_na": F.when(promoted, 1),
            "_b": F.when(~promoted, F.col("sales")), "_nb": F.when(~promoted, 1)}
    return additive(t, group, sums).select(
        *group, safe_ratio("_p", "_n").alias("promotion_active_observation_rate"), F.col("_a").alias("promotion_active_sales_volume"),
        F.col("_b").alias("nonpromotion_sales_volume"), (safe_ratio(a - b, b) * 100).alias("promotion_difference_proxy_pct"))


def holiday_measures(t: Tables, group: list[str]) -> DataFrame:
    """Holiday against regular volume on the store-day grain."""
    keys = ["date_key", "store_key"]
    days = t["fact_daily_sales"].groupBy(*keys).agg(F.sum("sales").alias("sales")).join(
        t["dim_store_date"].select(*keys, "is_holiday"), keys).join(t["dim_store"], "store_key")
    holiday = F.col("is_holiday") == 1
    a, b = F.col("holiday_average_store_day"), F.col("regular_average_store_day")
    return days.groupBy(*group).agg(
        F.sum(F.when(holiday, F.col("sales"))).alias("holiday_sales_volume"),
        F.sum(F.when(~holiday, F.col("sales"))).alias("regular_sales_volume"),
        F.avg(F.when(holiday, F.col("sales"))).alias("holiday_average_store_day"),
        F.avg(F.when(~holiday, F.col("sales"))).alias("regular_average_store_day"),
    ).withColumn("holiday_difference_proxy_pct", safe_ratio(a - b, b) * 100)


def oil_measures(t: Tables) -> DataFrame:
    return t["fact_oil_price"].agg(
        F.max_by("oil_price", "date_key").alias("latest_oil_price"), F.avg("oil_price").alias("average_oil_price"),
        F.max_by("oil_change_1d", "date_key").alias("latest_oil_change_1d"),
        F.max_by("oil_change_7d", "date_key").alias("latest_oil_change_7d"),
        F.sum("oil_was_imputed").alias("imputed_oil_days"))


def readiness_measures(readiness: DataFrame, group: list[str]) -> DataFrame:
    return readiness.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_series"),
        F.count_if(F.col("readiness_class") == "Ready").alias("ready_series"),
        F.count_if(F.col("is_intermittent") == 1).alias("intermittent_series"),
        F.count_if(F.col("is_promotion_dependent") == 1).alias("promotion_dependent_series"),
        F.count_if(F.col("is_high_volatility") == 1).alias("high_volatility_series"),
    ).withColumn("ready_series_pct", safe_ratio("ready_series", "total_series") * 100)


def anomaly_measures(anomalies: DataFrame, group: list[str]) -> DataFrame:
    return anomalies.groupBy(*group).agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.sum("actual_sales").alias("actual_sales_volume"),
        F.sum("expected_sales").alias("expected_sales_volume"),
    ).withColumn("baseline_bias_pct", safe_ratio(
        F.col("actual_sales_volume") - F.col("expected_sales_volume"), "expected_sales_volume") * 100)
