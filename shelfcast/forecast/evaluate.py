"""Scores, fold summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.forecast.metrics import error_metrics
from shelfcast.functions.columns import is_finite, one_row
from shelfcast.operators.audit import grain_counts
from shelfcast.schemas import SALES_GRAIN

METRICS = ["rmsle", "mae", "wape"]


def score_predictions(actual: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """One row of metrics; every actual row needs a prediction."""
    joined = actual.select(*SALES_GRAIN, "sales").join(
        predictions.select(*SALES_GRAIN, "prediction"), SALES_GRAIN, "left")
    if check and joined.filter(F.col("prediction").isNull()).limit(1).count():
        raise ValueError("predictions cover only part of the actual rows")
    return joined.agg(*error_metrics())


def summarize_scores(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation over the folds."""
    columns = []
    for metric in METRICS:
        columns += [F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std")]
    return scores.groupBy(*(keys or ["model"])).agg(F.count_distinct("fold").alias("fold_count"), *columns)


def score_contract(scores: DataFrame, folds: int = 4) -> DataFrame:
    """Per model: folds covered and metrics finite."""
    bad = F.lit(False)
    for metric in METRICS:
        bad = bad | ~is_finite(metric)
    return scores.groupBy("model").agg(
        F.count_distinct("fold").alias("fold_count"), F.count_if(bad).alias("non_finite_rows"),
    ).withColumn("passed", (F.col("fold_count") == folds) & (F.col("non_finite_rows") == 0))


def leaderboard(models: DataFrame, baselines: DataFrame) -> DataFrame:
    """Baselines and models ranked by error, models marked when they beat every baseline."""
    best = one_row(baselines.agg(F.min("rmsle_mean").alias("v")))["v"]
    table = baselines.withColumn("model_type", F.lit("baseline")).unionByName(
        models.withColumn("model_type", F.lit("machine_learning")), allowMissingColumns=True)
    order = Window.partitionBy(F.lit(0)).orderBy("rmsle_mean", "mae_mean", "model")  # one row per model
    return table.withColumns({
        "strongest_baseline_rmsle": best, "rmsle_rank": F.row_number().over(order),
    }).withColumn("beats_strongest_baseline", (F.col("model_type") == "machine_learning")
                  & (F.col("rmsle_mean") < F.col("strongest_baseline_rmsle")))


def compare_strategies(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Error of two strategies per fold and their difference."""
    return previous.select("fold", F.col("rmsle").alias("previous_rmsle")).join(
        current.select("fold", F.col("rmsle").alias("current_rmsle")), "fold",
    ).withColumn("current_minus_previous", F.col("current_rmsle") - F.col("previous_rmsle"))


def oof_contract(oof: DataFrame, expected_rows_per_fold: int | None = None) -> DataFrame:
    """Per fold: rows, duplicated grains, invalid predictions."""
    groups = grain_counts(oof, ["fold", *SALES_GRAIN]).groupBy("fold").agg(
        F.sum("row_count").alias("row_count"), F.count_if(F.col("row_count") > 1).alias("duplicate_grains"))
    bad = oof.groupBy("fold").agg(
        F.count_if(~is_finite("prediction") | (F.col("prediction") < 0)).alias("invalid_predictions"))
    passed = (F.col("duplicate_grains") == 0) & (F.col("invalid_predictions") == 0)
    if expected_rows_per_fold is not None:
        passed = passed & (F.col("row_count") == expected_rows_per_fold)
    return groups.join(bad, "fold").withColumn("passed", passed)
