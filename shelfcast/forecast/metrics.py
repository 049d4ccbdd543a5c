"""Forecast error measures as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import col, is_finite, safe_ratio


def rmsle(actual: str | Column = "sales", prediction: str | Column = "prediction") -> Column:
    """Root mean squared log error; negative predictions count as zero."""
    error = F.log1p(F.greatest(col(prediction), F.lit(0.0))) - F.log1p(col(actual))
    return F.sqrt(F.avg(error * error))


def mae(actual: str | Column = "sales", prediction: str | Column = "prediction") -> Column:
    return F.avg(F.abs(col(actual) - col(prediction)))


def wape(actual: str | Column = "sales", prediction: str | Column = "prediction") -> Column:
    """Absolute error over absolute volume; undefined without volume."""
    return safe_ratio(F.sum(F.abs(col(actual) - col(prediction))), F.sum(F.abs(col(actual))))


def pinball(actual: str | Column, prediction: str | Column, quantile: float) -> Column:
    if not 0 < quantile < 1:
        raise ValueError("quantile must lie between 0 and 1")
    error = col(actual) - col(prediction)
    return F.avg(F.greatest(error * quantile, error * (quantile - 1.0)))


def error_metrics() -> list[Column]:
    return [rmsle().alias("rmsle"), mae().alias("mae"), wape().alias("wape")]


def validate_pairs(df: DataFrame, actual: str = "sales", prediction: str = "prediction") -> None:
    """Pairs must exist, be finite, and actuals must not be negative."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(~is_finite(actual) | ~is_finite(prediction)).alias("bad"),
                 F.count_if(F.col(actual) < 0).alias("negative")).first()
    if not row["n"]:
        raise ValueError("actuals and predictions must not be empty")
    if row["bad"]:
        raise ValueError("actuals and predictions must be finite")
    if row["negative"]:
        raise ValueError("actuals must not be negative")


def score(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*error_metrics())
