"""Intermittent-demand forecasts: Croston, SBA and TSB as folds over each series' array."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.metrics import error_metrics
from shelfcast.forecast.splits import FOLDS, HORIZON, fold_array
from shelfcast.functions.columns import daily_sequence, one_row
from shelfcast.operators.audit import assert_unique, require_columns
from shelfcast.operators.cleaning import refuse
from shelfcast.schemas import SALES_GRAIN, SERIES

METHODS = ["croston", "sba", "tsb"]
SMOOTHING = 0.1
MIN_IMPROVEMENT = 0.001
CONTROL = "global_model_tuned"


def _smoothing(value: float, name: str) -> float:
    if not 0 < float(value) <= 1:
        raise ValueError(f"{name} must be in (0, 1]")
    return float(value)


def demand_level(values: Column, method: str, alpha: float = SMOOTHING, beta: float = SMOOTHING) -> Column:
    """Smoothed demand rate of a date-ordered array, one step per observation.

    The first positive value starts size, interval and probability; a series without one
    has level zero.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of: {', '.join(METHODS)}")
    a, b = _smoothing(alpha, "alpha"), _smoothing(beta, "beta")
    number = lambda x: F.lit(float(x)) if not isinstance(x, Column) else x.cast("double")

    def state(started, size, interval, chance, elapsed) -> Column:
        return F.struct(started.alias("started"), number(size).alias("size"), number(interval).alias("interval"),
                        number(chance).alias("chance"), number(elapsed).alias("elapsed"))

    def step(s: Column, y: Column) -> Column:
        elapsed = s["elapsed"] + 1
        hit = y > 0
        before = state(F.lit(False), 0, 0, 0, elapsed)
        first = state(F.lit(True), y, elapsed, F.lit(1.0) / elapsed, 0)
        later = state(
            F.lit(True), F.when(hit, s["size"] + (y - s["size"]) * a).otherwise(s["size"]),
            F.when(hit, s["interval"] + (elapsed - s["interval"]) * a).otherwise(s["interval"]),
            s["chance"] + (F.when(hit, 1.0).otherwise(0.0) - s["chance"]) * b,
            F.when(hit, 0.0).otherwise(elapsed))
        return F.when(s["started"], later).when(hit, first).otherwise(before)

    def finish(s: Column) -> Column:
        rate = F.try_divide(s["size"], s["interval"])
        value = {"croston": rate, "sba": rate * (1.0 - a / 2.0), "tsb": s["chance"] * s["size"]}[method]
        return F.when(s["started"], F.greatest(value, F.lit(0.0))).otherwise(F.lit(0.0))

    return F.aggregate(values, state(F.lit(False), 0, 0, 0, 0), step, finish)


def _levels(rows: DataFrame, keys: list[str], methods: list[str], alpha: float, beta: float) -> DataFrame:
    """One array per series: bounded by the calendar, never by the number of series."""
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "sales"))).alias("_h"))
    values = F.transform("_h", lambda e: e["sales"])
    return ordered.withColumn("_v", values).select(
        *keys, *[demand_level(F.col("_v"), m, alpha, beta).alias(m) for m in methods])


def forecast_intermittent(history: DataFrame, start: dt.date | str, end: dt.date | str, cutoff: dt.date | str,
                          method: str, series: DataFrame, alpha: float = SMOOTHING, beta: float = SMOOTHING,
                          check: bool = True) -> DataFrame:
    """Flat forecast per series; a series without history is forecast as zero."""
    if method not in METHODS:
        raise ValueError(f"method must be one of: {', '.join(METHODS)}")
    _smoothing(alpha, "alpha"), _smoothing(beta, "beta")
    require_columns(history, [*SALES_GRAIN, "sales"], "history")
    if str(start) <= str(cutoff) or str(end) < str(start):
        raise ValueError("forecast dates must lie after the cutoff")
    rows = history.filter(F.col("date") <= F.lit(str(cutoff)).cast("date"))
    if check:
        assert_unique(series, SERIES, "series")
        refuse(rows, {"sales must be present and not negative": F.col("sales").isNull() | (F.col("sales") < 0)}, "history")
        assert_unique(rows, SALES_GRAIN, "history")
    levels = _levels(rows, SERIES, [method], alpha, beta)
    days = daily_sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")).alias("date")
    return series.select(*SERIES).join(levels, SERIES, "left").select(
        *SERIES, days, F.coalesce(F.col(method), F.lit(0.0)).alias("prediction")).select(*SALES_GRAIN, "prediction")


def intermittent_backtest(train: DataFrame, series: DataFrame, horizon: int = HORIZON,
                          folds: int = FOLDS) -> DataFrame:
    """All methods and folds in one pass: the history is shuffled once by series."""
    last = one_row(train.agg(F.max("date").alias("d")))["d"]
    cohort = train.join(series.select(*SERIES).distinct(), SERIES, "left_semi")
    # The array is built once per series; every fold reads its own prefix.
    ordered = cohort.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("date", "sales"))).alias("_h"))
    per_fold = ordered.select(*SERIES, "_h", F.inline(fold_array(last, horizon, folds)))
    seen = F.filter("_h", lambda e: e["date"] <= F.col("train_end"))
    due = F.filter("_h", lambda e: e["date"].between(F.col("validation_start"), F.col("validation_end")))
    values = per_fold.withColumn("_v", F.transform(seen, lambda e: e["sales"])).withColumn("_due", due)
    levels = values.select("fold", *SERIES, "_due", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), demand_level(F.col("_v"), m).alias("prediction")) for m in METHODS])))
    return levels.select("model", "fold", *SERIES, "prediction", F.inline("_due"))


def score_cohort(oof: DataFrame, series: DataFrame, model: str) -> DataFrame:
    """Scores per fold of an existing forecast on the cohort."""
    return oof.join(series.select(*SERIES).distinct(), SERIES, "left_semi").groupBy("fold").agg(
        *error_metrics()).withColumn("model", F.lit(model)).select("model", "fold", "rmsle", "mae", "wape")


def intermittent_series(readiness: DataFrame) -> DataFrame:
    """Routing keys only; readiness statistics never become features."""
    return readiness.filter("readiness_class = 'Intermittent demand'").select(*SERIES)


def every_fold(scores: DataFrame, strategies: list[str], folds: int = FOLDS) -> DataFrame:
    """Scores with a row for every strategy and fold; errors are null where the cohort had nothing to score."""
    planned = scores.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("model")).select(
        "model", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    return planned.join(scores, ["model", "fold"], "full")


def summarize_routing(scores: DataFrame, control: str = CONTROL, folds: int = 4, check: bool = True) -> DataFrame:
    """Fold means per strategy and whether it improves enough on the control."""
    if check and scores.groupBy("model").agg(F.count_distinct("fold").alias("n")).filter(F.col("n") != folds).count():
        raise ValueError(f"every strategy must cover {folds} folds")
    means = scores.groupBy("model").agg(
        F.count_distinct("fold").alias("fold_count"), F.avg("rmsle").alias("rmsle_mean"),
        F.stddev_samp("rmsle").alias("rmsle_std"), F.avg("mae").alias("mae_mean"), F.avg("wape").alias("wape_mean"))
    base = one_row(means.filter(F.col("model") == control).select("rmsle_mean"))["rmsle_mean"]
    return means.withColumn("rmsle_improvement_vs_global", base - F.col("rmsle_mean")).withColumn(
        "routing_eligible", (F.col("model") != control) & (F.col("rmsle_improvement_vs_global") >= MIN_IMPROVEMENT))


def fold_wins(scores: DataFrame, control: str = CONTROL) -> DataFrame:
    """In how many folds each strategy beats the control."""
    base = scores.filter(F.col("model") == control).select("fold", F.col("rmsle").alias("_control"))
    return scores.filter(F.col("model") != control).join(base, "fold").groupBy("model").agg(
        F.count_if(F.col("rmsle") < F.col("_control")).alias("fold_wins"), F.count(F.lit(1)).alias("fold_count"))
