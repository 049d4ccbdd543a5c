"""Forecast errors by segment, after the predictions exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.metrics import mae, rmsle
from shelfcast.functions.columns import is_finite, safe_ratio
from shelfcast.functions.numbering import global_row_number
from shelfcast.operators.audit import assert_unique, require_columns
from shelfcast.schemas import SALES_GRAIN, SERIES

LABELS = ["readiness_class", "is_high_volatility", "is_intermittent", "is_promotion_dependent",
          "is_insufficient_history"]


def validate_oof(oof: DataFrame, folds: int = 4) -> None:
    require_columns(oof, [*SALES_GRAIN, "fold", "sales", "prediction"], "oof")
    assert_unique(oof, [*SALES_GRAIN, "fold"], "oof")
    bad = ~is_finite("sales") | ~is_finite("prediction") | (F.col("sales") < 0) | (F.col("prediction") < 0)
    row = oof.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"), F.count_if(bad).alias("bad")).first()
    if not row["n"] or row["folds"] != folds:
        raise ValueError(f"out-of-fold predictions must cover exactly {folds} folds")
    if row["bad"]:
        raise ValueError("actuals and predictions must be finite and not negative")


def score_segments(oof: DataFrame, groups: list[str]) -> DataFrame:
    """Counts and errors per segment; series are counted on their distinct keys."""
    if not groups:
        raise ValueError("at least one group column is needed")
    require_columns(oof, groups, "oof")
    gap = F.sum(F.abs(F.col("sales") - F.col("prediction")))
    return oof.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct(*SERIES).alias("series_count"),
        F.count_distinct("fold").alias("fold_count"), F.sum("sales").alias("actual_sales"),
        F.sum("prediction").alias("predicted_sales"), mae().alias("mae"), rmsle().alias("rmsle"),
        safe_ratio(gap, F.sum("sales")).alias("wape"))


def attach_labels(oof: DataFrame, readiness: DataFrame, check: bool = True) -> DataFrame:
    """Readiness labels joined after prediction; every series must have one."""
    require_columns(readiness, [*SERIES, *LABELS], "readiness")
    labels = readiness.select(*SERIES, *LABELS)
    if check:
        assert_unique(labels, SERIES, "readiness")
        if oof.select(*SERIES).distinct().join(labels.dropna(), SERIES, "left_anti").limit(1).count():
            raise ValueError("readiness labels must map every series")
    return oof.join(labels, SERIES, "left")


def score_flags(labeled: DataFrame) -> DataFrame:
    """Each overlapping flag against its complement, in one grouped pass."""
    flags = F.array(*[F.struct(F.lit(c).alias("risk_flag"), F.col(c).cast("int").alias("flag_active")) for c in LABELS[1:]])
    return score_segments(labeled.select(*SALES_GRAIN, "fold", "sales", "prediction", F.inline(flags)),
                          ["risk_flag", "flag_active"])


def segment_tables(labeled: DataFrame, segments: list[str]) -> DataFrame:
    """Several segmentations stacked, scored in one grouped pass."""
    own = F.array(*[F.struct(F.lit(name).alias("segment_type"), F.col(name).cast("string").alias("segment_value"))
                    for name in segments])
    rows = labeled.select(*SALES_GRAIN, "fold", "sales", "prediction", F.inline(own))
    return score_segments(rows, ["segment_type", "segment_value"])


def best_and_worst(scores: DataFrame, key: str, n: int = 10, metric: str = "rmsle") -> DataFrame:
    """The ``n`` smallest and largest segments by one metric; places come from sorted partitions, since segments may be series."""
    up = global_row_number(scores, [F.col(metric).asc(), F.col(key).asc()], "best_rank")
    both = global_row_number(up, [F.col(metric).desc(), F.col(key).asc()], "worst_rank")
    ranked = both.withColumns({c: F.col(c).cast("int") for c in ("best_rank", "worst_rank")})
    return ranked.filter((F.col("best_rank") <= n) | (F.col("worst_rank") <= n))
