"""Split-conformal prediction intervals on the log scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.metrics import mae, pinball, rmsle, wape
from shelfcast.functions.columns import is_finite
from shelfcast.functions.quantiles import value_at_place, with_quantiles
from shelfcast.operators.audit import require_columns
from shelfcast.schemas import SALES_GRAIN, SERIES

ALPHA = 0.2


def conformal_radius(pairs: DataFrame, keys: list[str], alpha: float = ALPHA, check: bool = True) -> DataFrame:
    """Absolute log residual at rank ceil((n+1)(1-alpha)) by key, taking the upper neighbour.

    The rank depends on the group size and is found by counting in buckets: no group is ever ordered as a whole, nothing
    is collected, and keys may be as many as series.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    if check:
        row = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(
            ~is_finite("sales") | ~is_finite("prediction") | (F.col("sales") < 0) | (F.col("prediction") < 0)
        ).alias("bad")).first()
        if not row["n"] or row["bad"]:
            raise ValueError("actuals and predictions must be finite and not negative")
    def place(n: Column) -> Column:
        rank = F.ceil((n + 1) * (1 - alpha))
        return F.when(rank < n, rank).otherwise(n - 1)

    return value_at_place(pairs, keys, F.abs(F.log1p("sales") - F.log1p("prediction")), place).select(
        *keys, F.col("_n").alias("calibration_observation_count"), F.col("_v").alias("calibration_log_radius"))


def prediction_intervals(points: DataFrame, radius: DataFrame | float, keys: list[str] | None = None) -> DataFrame:
    """P10, P50 and P90 around a point forecast, never negative and always ordered."""
    require_columns(points, [*SALES_GRAIN, "prediction"], "points")
    if isinstance(radius, DataFrame):
        frame = points.join(radius.select(*(keys or ["fold"]), "calibration_log_radius"), keys or ["fold"])
    else:
        if not (radius == radius and 0 <= radius < float("inf")):
            raise ValueError("the radius must be finite and not negative")
        frame = points.withColumn("calibration_log_radius", F.lit(float(radius)))
    middle, r = F.log1p("prediction"), F.col("calibration_log_radius")
    return frame.withColumns({
        "p10": F.greatest(F.expm1(middle - r), F.lit(0.0)), "p50": F.col("prediction"),
        "p90": F.greatest(F.expm1(middle + r), F.lit(0.0))}).drop("prediction")


def score_intervals(intervals: DataFrame, groups: list[str], alpha: float = ALPHA) -> DataFrame:
    """Coverage, tails, width, pinball losses and point errors per segment."""
    require_columns(intervals, ["sales", "p10", "p50", "p90", "fold", *SERIES, *groups], "intervals")
    width = F.col("p90") - F.col("p10")
    y = F.col("sales")
    losses = {name: pinball("sales", name, q) for name, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))}
    covered = F.avg(y.between(F.col("p10"), F.col("p90")).cast("double"))
    summary = intervals.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct(*SERIES).alias("series_count"),
        F.count_distinct(F.col("fold")).alias("fold_count"), covered.alias("empirical_coverage"),
        (covered - (1 - alpha)).alias("coverage_gap_vs_nominal"),
        F.avg((y < F.col("p10")).cast("double")).alias("lower_tail_rate"),
        F.avg((y > F.col("p90")).cast("double")).alias("upper_tail_rate"),
        F.avg(width).alias("mean_interval_width"), *[loss.alias(f"{n}_pinball_loss") for n, loss in losses.items()],
        ((losses["p10"] + losses["p50"] + losses["p90"]) / 3).alias("mean_pinball_loss"),
        rmsle("sales", "p50").alias("point_rmsle"), mae("sales", "p50").alias("point_mae"),
        wape("sales", "p50").alias("point_wape"))
    return with_quantiles(summary, intervals.withColumn("_w", width), groups, {"median_interval_width": ("_w", 0.5)})


def segment_scores(labeled: DataFrame) -> DataFrame:
    """Overall, by fold, by readiness class and for two risk cohorts, in one grouped pass.

    Each row names the segments it belongs to, so overlapping cohorts need no extra scans.
    """
    def segment(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("segment_type"), value.cast("string").alias("segment_value"))

    own = F.array_compact(F.array(
        segment("overall", F.lit("all")), segment("overall_fold", F.col("fold")),
        segment("readiness_class", F.col("readiness_class")),
        F.when(F.col("is_high_volatility") == 1, segment("risk_cohort", F.lit("high_volatility"))),
        F.when(F.col("is_intermittent") == 1, segment("risk_cohort", F.lit("intermittent")))))
    rows = labeled.select(*SALES_GRAIN, "fold", "sales", "p10", "p50", "p90", F.inline(own))
    return score_intervals(rows, ["segment_type", "segment_value"])


def calibrate_series(oof: DataFrame, folds: int = 4, alpha: float = ALPHA) -> DataFrame:
    """Radius of every series and fold, from the series' own forecasts in the horizon just before it."""
    earlier = oof.filter(F.col("fold") < folds).withColumn("fold", F.col("fold") + 1)
    return conformal_radius(earlier, ["fold", *SERIES], alpha)


def calibrate_folds(oof: DataFrame, folds: int = 4, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """Intervals per fold, calibrated on the horizon just before it.

    The forecast of fold k-1 starts exactly one horizon before fold k, so an out-of-fold
    table with one extra earlier fold holds every calibration forecast already.
    """
    earlier = oof.filter(F.col("fold") < folds).withColumn("fold", F.col("fold") + 1)
    radius = conformal_radius(earlier, ["fold"], alpha)
    spans = earlier.groupBy("fold").agg(F.min("date").alias("calibration_start"), F.max("date").alias("calibration_end"))
    calibration = radius.join(spans, "fold")
    points = oof.filter(F.col("fold") >= 1)
    return prediction_intervals(points, radius), calibration
