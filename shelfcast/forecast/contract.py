"""What has to be forecast, which features may be used, and which days were never observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import date_key, daily_sequence, one_row
from shelfcast.operators.audit import assert_unique, require_columns, union_all
from shelfcast.schemas import SALES_GRAIN, SERIES


def forecast_contract(train: DataFrame, future: DataFrame) -> DataFrame:
    """One row: horizon, entity counts, expected predictions and three consistency tests."""
    if "sales" in future.columns:
        raise ValueError("sales must exist only in the training table")
    require_columns(future, ["id", *SALES_GRAIN], "future")
    series = one_row(train.select(*SERIES).distinct().agg(
        F.count(F.lit(1)).alias("series"), F.count_distinct("store_nbr").alias("stores"),
        F.count_distinct("family").alias("families")))
    past = one_row(train.agg(F.min("date").alias("a"), F.max("date").alias("z")))
    ahead = future.agg(F.min("date").alias("forecast_start"), F.max("date").alias("forecast_end"),
                       F.count(F.lit(1)).alias("future_rows"))
    days = one_row(future.select("date").distinct().agg(F.count(F.lit(1)).alias("n")))["n"]
    start, end = F.col("forecast_start"), F.col("forecast_end")
    return ahead.select(
        F.lit("sales").alias("forecast_target"), F.lit("store × family × day").alias("forecast_grain"),
        past["a"].alias("historical_start"), past["z"].alias("last_actual_date"), start, end,
        days.alias("forecast_horizon_days"), series["stores"].alias("store_count"),
        series["families"].alias("family_count"), series["series"].alias("series_count"), "future_rows",
    ).select(
        "*", (F.col("store_count") * F.col("family_count") * F.col("forecast_horizon_days")).alias("expected_predictions"),
        (start == F.date_add("last_actual_date", 1)).alias("starts_after_last_actual"),
        ((F.datediff(end, start) + 1) == F.col("forecast_horizon_days")).alias("horizon_is_contiguous"),
        (F.col("future_rows") == F.col("series_count") * F.col("forecast_horizon_days")).alias("every_series_covered"),
    )


def assert_contract(train: DataFrame, future: DataFrame, cross_product: bool = True) -> None:
    """Raise unless the future table is the complete horizon; ``cross_product`` also wants stores × families."""
    assert_unique(train, SALES_GRAIN, "train")
    assert_unique(future, SALES_GRAIN, "future")
    assert_unique(future, ["id"], "future")
    row = forecast_contract(train, future).first()
    if not row["starts_after_last_actual"]:
        raise ValueError("the forecast period must begin the day after the last actual date")
    if not row["horizon_is_contiguous"]:
        raise ValueError("forecast dates must form a continuous calendar")
    if not row["every_series_covered"]:
        raise ValueError("the future table must hold every series on every forecast day")
    if cross_product and row["future_rows"] != row["expected_predictions"]:
        raise ValueError("future rows must equal stores × families × horizon")


def feature_availability(train: DataFrame, future: DataFrame, stores: DataFrame, holidays: DataFrame,
                         oil: DataFrame, transactions: DataFrame) -> DataFrame:
    """Which feature groups are known over the horizon, decided from the sources' coverage."""
    bounds = one_row(future.agg(F.min("date").alias("a"), F.max("date").alias("z")))
    plan_gaps = one_row(future.agg(F.count_if(F.col("onpromotion").isNull()).alias("n")))["n"]
    unknown_stores = one_row(future.select("store_nbr").distinct().join(
        stores.select("store_nbr"), "store_nbr", "left_anti").agg(F.count(F.lit(1)).alias("n")))["n"]

    def last(df: DataFrame) -> Column:
        return one_row(df.agg(F.max("date").alias("d")))["d"]

    def yes_no(condition: Column, yes: str = "Yes", no: str = "No") -> Column:
        return F.when(condition, F.lit(yes)).otherwise(F.lit(no))

    stores_known, plan_known = unknown_stores == 0, plan_gaps == 0
    events_known, oil_known = last(holidays) >= bounds["z"], last(oil) >= bounds["z"]
    visits_known = last(transactions) >= bounds["a"]
    yes = F.lit("Yes")
    # Feature group, known over the horizon, allowed in a first model, leakage risk.
    rows = [
        ("Calendar", yes, yes, "Low"),
        ("Store metadata", yes_no(stores_known), yes_no(stores_known), "Low"),
        ("Family", yes, yes, "Low"),
        ("onpromotion", yes_no(plan_known), yes_no(plan_known), "Low for competition; deployment caveat"),
        ("Holiday / event", yes_no(events_known), yes_no(events_known), "Low to medium"),
        ("Oil", yes_no(oil_known, "Competition-known: Yes"), F.lit("Conditional"), "Medium to high"),
        ("Transactions", yes_no(visits_known), F.lit("Historical lags only"), "High for current-day values"),
        ("Historical sales lags", F.lit("At forecast origin only"), yes, "High if not shifted"),
        ("Observation status", F.lit("Known as no actual observation"), F.lit("Historical context only"), "Medium"),
        ("ForecastReadiness outputs", F.lit("Artifact exists"), F.lit("No"), "High in temporal backtests"),
        ("SalesAnomalies outputs", F.lit("Artifact exists"), F.lit("No"), "High in temporal backtests"),
    ]
    return train.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), yes.alias("available_historically"),
                 known.alias("available_for_horizon"), allowed.alias("allowed_in_initial_model"),
                 F.lit(risk).alias("leakage_risk"))
        for name, known, allowed, risk in rows])))


def missing_observations(train: DataFrame, grid: DataFrame, future: DataFrame) -> DataFrame:
    """Calendar days without any sale and store-days without observation, as counters."""
    past = one_row(train.agg(F.min("date").alias("a"), F.max("date").alias("z")))
    ahead = one_row(future.agg(F.min("date").alias("a"), F.max("date").alias("z")))
    calendar = train.sparkSession.range(1).select(daily_sequence(past["a"], past["z"]).alias("date"))
    silent = calendar.join(train.select("date").distinct(), "date", "left_anti").agg(
        F.count(F.lit(1)).alias("value")).select(F.lit("missing_calendar_dates").alias("counter"), "value")
    key, empty = F.col("date_key"), F.col("has_sales_observation") == 0
    in_past = key.between(date_key(past["a"]), date_key(past["z"]))
    in_future = key.between(date_key(ahead["a"]), date_key(ahead["z"]))
    counted = grid.agg(
        F.count_if(in_past).alias("historical_store_days"),
        F.count_if(in_past & empty).alias("historical_store_days_without_observation"),
        F.count_if(in_future).alias("forecast_store_days"),
        F.count_if(in_future & empty).alias("forecast_store_days_without_actual"))
    return union_all([silent, counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in counted.columns])))])
