"""Statistical baselines for all folds and series in one pass over the history.

The history is shuffled once by series.  One aggregation per (fold, series) keeps the few
numbers every baseline needs: last value, medians and the last 28 days.  Predictions are
then a projection over the generated forecast days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.metrics import error_metrics
from shelfcast.forecast.splits import FOLDS, HORIZON, fold_array
from shelfcast.functions.columns import daily_sequence, is_finite, one_row
from shelfcast.functions.quantiles import exact_quantiles
from shelfcast.operators.audit import assert_unique, require_columns
from shelfcast.schemas import SALES_GRAIN, SERIES

SEASONS = (7, 14, 28)
RECENT_DAYS = 28
MODELS = ["last_value_naive", "seasonal_naive_7d", "seasonal_naive_14d", "seasonal_naive_28d",
          "weekday_historical_median", "rolling_historical_median_28d"]


def check_history(history: DataFrame, cutoff: Column) -> None:
    require_columns(history, [*SALES_GRAIN, "sales"], "history")
    usable = history.filter(F.col("date") <= cutoff)
    row = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_finite("sales")).alias("bad")).first()
    if not row["n"]:
        raise ValueError("history contains no rows on or before the cutoff")
    if row["bad"]:
        raise ValueError("sales before the origin include values that are not numbers")
    assert_unique(usable, SALES_GRAIN, "history")


def series_profile(history: DataFrame, folds: Column, recent_days: int = RECENT_DAYS) -> DataFrame:
    """One row per fold and series, made only of rows up to the fold's cutoff.

    ``folds`` is an array of structs (fold, train_end, validation_start, validation_end).
    Repeating rows per fold happens after the shuffle, so the history moves once.
    """
    recent_days = max(recent_days, *SEASONS)
    rows = (
        history.select(*SALES_GRAIN, F.col("sales").cast("double").alias("sales"))
        .repartition(*SERIES).select("*", F.inline(folds))
    )
    known = F.col("date") <= F.col("train_end")
    y = F.when(known, F.col("sales"))
    age = F.datediff("train_end", "date")
    # Bounded: at most ``recent_days`` entries per series and fold.
    recent = F.collect_list(F.when(known & (age < recent_days), F.struct("date", "sales")))
    weekdays = F.array(*[F.percentile(F.when(F.weekday("date") == d, y), F.lit(0.5)) for d in range(7)])
    return rows.groupBy("fold", "train_end", "validation_start", "validation_end", *SERIES).agg(
        F.max_by(y, F.when(y.isNotNull(), F.col("date"))).alias("last_value"),
        F.percentile(y, F.lit(0.5)).alias("series_median"),
        weekdays.alias("weekday_medians"),
        F.map_from_entries(recent).alias("recent"),
    )


def recent_median(days: int) -> Column:
    """Median of the values at most ``days`` old, from the bounded recent map."""
    inside = F.filter(F.map_entries("recent"), lambda e: F.datediff(F.col("train_end"), e["key"]) < days)
    values = F.array_sort(F.transform(inside, lambda e: e["value"]))
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def global_medians(history: DataFrame, folds: Column) -> DataFrame:
    rows = history.select("date", F.col("sales").cast("double").alias("sales"), F.inline(folds)).filter(
        F.col("date") <= F.col("train_end"))
    return exact_quantiles(rows.select("fold", "sales"), ["fold"], {"global_median": ("sales", 0.5)})


def seasonal_reference(day: Column, cutoff: Column, season: int) -> Column:
    """Step back whole seasons until the reference lies on or before the cutoff."""
    steps = F.ceil(F.datediff(day, cutoff) / season)
    return F.date_sub(day, (steps * season).cast("int"))


def model_expressions(rolling_days: int = RECENT_DAYS) -> dict[str, Column]:
    day, cutoff = F.col("date"), F.col("train_end")
    expressions = {"last_value_naive": F.col("last_value")}
    for season in SEASONS:
        expressions[f"seasonal_naive_{season}d"] = F.try_element_at(
            F.col("recent"), seasonal_reference(day, cutoff, season))
    expressions["weekday_historical_median"] = F.get(F.col("weekday_medians"), F.weekday(day))
    expressions[f"rolling_historical_median_{rolling_days}d"] = recent_median(rolling_days)
    return expressions


def predict(history: DataFrame, folds: Column, models: list[str] | None = None,
            series: DataFrame | None = None, rolling_days: int = RECENT_DAYS) -> DataFrame:
    """Predictions of the named models for every fold, series and validation day.

    Missing values fall back to the series median, then to the fold's global median.
    """
    expressions = model_expressions(rolling_days)
    wanted = list(expressions) if models is None else models
    unknown = [m for m in wanted if m not in expressions]
    if unknown:
        raise ValueError(f"unsupported name of a baseline: {', '.join(unknown)}")
    profile = series_profile(history, folds, rolling_days)
    if series is not None:
        keys = series.select(*SERIES).distinct().select("*", F.inline(folds))
        profile = keys.join(profile.drop("train_end", "validation_start", "validation_end"),
                            ["fold", *SERIES], "left")
    medians = global_medians(history, folds)
    days = profile.select("*", daily_sequence(F.col("validation_start"), F.col("validation_end")).alias("date"))
    entries = F.array(*[F.struct(F.lit(m).alias("model"), expressions[m].alias("_p")) for m in wanted])
    long = days.select("fold", "train_end", "validation_start", "validation_end", "date", *SERIES,
                       "series_median", F.inline(entries)).join(medians, "fold", "left")
    fallback = F.coalesce("_p", "series_median", "global_median", F.lit(0.0))
    return long.select("model", "fold", "train_end", "validation_start", "validation_end", *SALES_GRAIN,
                       F.greatest(fallback, F.lit(0.0)).alias("prediction"))


def forecast_baseline(history: DataFrame, start: dt.date | str, end: dt.date | str, cutoff: dt.date | str,
                      model: str, series: DataFrame | None = None, rolling_days: int = RECENT_DAYS,
                      check: bool = True) -> DataFrame:
    """One named baseline for the days ``start`` to ``end`` after ``cutoff``."""
    origin, first, last = (F.lit(str(d)).cast("date") for d in (cutoff, start, end))
    if str(start) <= str(cutoff) or str(end) < str(start):
        raise ValueError("every forecast date must lie after the cutoff")
    if check:
        check_history(history, origin)
    one = F.array(F.struct(F.lit(1).alias("fold"), origin.alias("train_end"),
                           first.alias("validation_start"), last.alias("validation_end")))
    usable = history.filter(F.col("date") <= origin)
    return predict(usable, one, [model], series, rolling_days).select(*SALES_GRAIN, "prediction")


def backtest_predictions(history: DataFrame, horizon: int = HORIZON, folds: int = FOLDS,
                         models: list[str] | None = None, first_fold: int = 1) -> DataFrame:
    """Out-of-fold baseline predictions beside the actual sales of the same day."""
    last = one_row(history.agg(F.max("date").alias("d")))["d"]
    predictions = predict(history, fold_array(last, horizon, folds, first_fold), models)
    return predictions.join(history.select(*SALES_GRAIN, "sales"), SALES_GRAIN)


def backtest_scores(oof: DataFrame) -> DataFrame:
    return oof.groupBy("model", "fold", "train_end", "validation_start", "validation_end").agg(*error_metrics())
