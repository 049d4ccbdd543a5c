"""Final forecast: contract, model inputs, submission and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.contract import assert_contract
from shelfcast.forecast.backtest import Run, forecast_runs
from shelfcast.forecast.boosting import TreeParameters
from shelfcast.forecast.model import Wanted
from shelfcast.functions.columns import is_finite
from shelfcast.functions.numbering import global_row_number
from shelfcast.operators import features
from shelfcast.operators.audit import assert_unique, require_columns
from shelfcast.schemas import SALES_GRAIN, SERIES


def validate_future(future: DataFrame, train: DataFrame, cross_product: bool = True) -> None:
    """The future table must be the complete horizon of exactly the known series."""
    require_columns(future, ["id", *SALES_GRAIN, "onpromotion"], "future")
    if future.filter(F.col("id").isNull()).limit(1).count():
        raise ValueError("a future row has no id")
    assert_contract(train, future, cross_product)
    for columns in ([SERIES[0]], [SERIES[1]]):
        a, b = future.select(*columns).distinct(), train.select(*columns).distinct()
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
            raise ValueError(f"future {columns[0]} values do not match the history")


def final_inputs(train: DataFrame, future: DataFrame, stores: DataFrame, holidays: DataFrame,
                 check: bool = True) -> DataFrame:
    """Known and causal features over history and horizon; future targets are null."""
    ahead = future.withColumn("sales", F.lit(None).cast("double"))
    columns = ["id", *SALES_GRAIN, "sales", "onpromotion"]
    return features.training_frame(
        train.select(*columns).unionByName(ahead.select(*columns)), stores, holidays, check)


def create_submission(future: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """Predictions under the future rows' own ids; coverage must be exact both ways."""
    require_columns(future, ["id", *SALES_GRAIN], "future")
    require_columns(predictions, [*SALES_GRAIN, "prediction"], "predictions")
    if check:
        assert_unique(predictions, SALES_GRAIN, "predictions")
        a, b = future.select(*SALES_GRAIN), predictions.select(*SALES_GRAIN)
        if a.exceptAll(b).limit(1).count():
            raise ValueError("predictions cover only part of the future rows")
        if b.exceptAll(a).limit(1).count():
            raise ValueError("some predictions belong to no future row")
    return future.select("id", *SALES_GRAIN).join(
        predictions.select(*SALES_GRAIN, "prediction"), SALES_GRAIN, "left").select(
        "id", F.col("prediction").alias("sales"))


def submission_checks(submission: DataFrame, future: DataFrame) -> DataFrame:
    """Violations per submission rule in one row: ids, coverage and values."""
    joined = submission.select("id", "sales", F.lit(1).alias("_s")).join(
        future.select("id", F.lit(1).alias("_f")), "id", "full")
    value = F.col("sales")
    return joined.agg(
        F.count("_s").alias("submission_rows"), F.count("_f").alias("future_rows"),
        (F.count("_s") - F.count_distinct(F.when(F.col("_s") == 1, F.col("id")))).alias("duplicate_ids"),
        F.count_if(F.col("_s").isNull()).alias("missing_ids"), F.count_if(F.col("_f").isNull()).alias("unknown_ids"),
        F.count_if((F.col("_s") == 1) & ~is_finite(value)).alias("non_finite_sales"),
        F.count_if(value < 0).alias("negative_sales"))


def validate_submission(submission: DataFrame, future: DataFrame, train: DataFrame,
                        cross_product: bool = True) -> None:
    if submission.columns != ["id", "sales"]:
        raise ValueError("a submission has two columns, id and sales")
    validate_future(future, train, cross_product)
    row = submission_checks(submission, future).first().asDict()
    broken = [k for k, v in row.items() if not k.endswith("_rows") and v]
    if broken or row["submission_rows"] != row["future_rows"]:
        raise ValueError(f"invalid submission: {row}")


def ordered_id_hash(submission: DataFrame, order: list[str]) -> DataFrame:
    """Fingerprint of the ids in their order: hashes of (place, id) added up, so two ids that change places show.

    Places come from sorted partitions and one offset each; sums combine in any order, so no task sees the whole list.
    """
    placed = global_row_number(submission.select("id", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]),
                               [F.col(f"_o{i}") for i in range(len(order))], "_place")
    text = F.concat_ws(":", F.col("_place").cast("string"), F.col("id").cast("string"))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return placed.agg(F.count(F.lit(1)).alias("id_count"), F.sum(digest).cast("string").alias("id_fingerprint"))


def train_and_forecast(train: DataFrame, future: DataFrame, stores: DataFrame, holidays: DataFrame,
                       parameters: TreeParameters | None = None, columns: list[str] | None = None,
                       cross_product: bool = True) -> DataFrame:
    """Fit the chosen settings on the whole history, forecast the horizon and validate it."""
    validate_future(future, train, cross_product)
    frame = final_inputs(train, future, stores, holidays)
    origin = train.agg(F.max("date")).first()[0]
    end = future.agg(F.max("date")).first()[0]
    selected = tuple(features.model_columns(frame, columns))
    known = frame.drop(*features.LAG_FEATURES, *features.ROLLING_FEATURES)
    run = Run("final", 1, Wanted(origin, parameters or TreeParameters(), selected))
    predictions = forecast_runs(frame, known, [run], (end - origin).days)
    submission = create_submission(future, predictions)
    validate_submission(submission, future, train, cross_product)
    return submission
