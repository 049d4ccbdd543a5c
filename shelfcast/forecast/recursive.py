"""Multi-day forecasts that feed each day's prediction into the next day's features.

Every series is one row: an array with its last 364 days and an array with the known
attributes of the forecast days, both of fixed length.  One shuffle builds these rows;
after it each forecast day is a projection and a model call, so the horizon costs no
further shuffle.  The rows of several origins (folds) are built together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.model import predict_sales
from shelfcast.functions.columns import is_finite
from shelfcast.operators.audit import require_columns, union_all
from shelfcast.operators.features import LAGS, MEAN_WINDOWS, MEDIAN_WINDOWS, SPREAD_WINDOW
from shelfcast.schemas import SALES_GRAIN, SERIES
from shelfcast.session import cut_lineage

HISTORY_DAYS = max(LAGS)
PARALLEL_FOLDS = 4
Predictor = Callable[[object, DataFrame], DataFrame]


def assert_dense_calendar(frame: DataFrame) -> None:
    """Every series on every day between the bounds, once."""
    require_columns(frame, [*SALES_GRAIN, "sales"], "known frame")
    series = frame.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"),
        F.min("date").alias("a"), F.max("date").alias("z"))
    row = series.agg(
        F.count(F.lit(1)).alias("series"), F.min("a").alias("a0"), F.max("a").alias("a1"),
        F.min("z").alias("z0"), F.max("z").alias("z1"),
        F.count_if((F.col("n") != F.col("days")) | (F.datediff("z", "a") + 1 != F.col("n"))).alias("bad")).first()
    if not row["series"]:
        raise ValueError("the known frame must not be empty")
    if row["bad"] or row["a0"] != row["a1"] or row["z0"] != row["z1"]:
        raise ValueError("the known frame must be dense: every series once on every calendar day")


def _origins(origins: Mapping[int, dt.date]) -> Column:
    return F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(str(day)).cast("date").alias("origin"))
                     for fold, day in origins.items()])


def series_states(known: DataFrame, origins: Mapping[int, dt.date], horizon: int) -> DataFrame:
    """One row per fold and series: recent sales, newest last, and the known future days.

    Targets after an origin never enter its row.  Both arrays have a fixed length.
    """
    attributes = [c for c in known.columns if c not in (*SALES_GRAIN, "sales")]
    age = F.datediff("origin", "date")
    past = F.when(age.between(0, HISTORY_DAYS - 1), F.struct("date", F.col("sales").cast("double").alias("y")))
    future = F.when(age.between(-horizon, -1), F.struct("date", *attributes))
    rows = (
        known.select(*SALES_GRAIN, "sales", *attributes).repartition(*SERIES)
        .select("*", F.inline(_origins(origins)))
        .filter(age.between(-horizon, HISTORY_DAYS - 1))
    )
    states = rows.groupBy("fold", "origin", *SERIES).agg(
        F.transform(F.array_sort(F.collect_list(past)), lambda e: e["y"]).alias("_past"),
        F.array_sort(F.collect_list(future)).alias("_future"))
    # A dense frame gives one entry per day; a short history is padded in front with nulls.
    padding = F.array_repeat(F.lit(None).cast("double"), F.lit(HISTORY_DAYS) - F.size("_past"))
    return states.select("fold", "origin", *SERIES, F.concat(padding, "_past").alias("_history"), "_future")


def state_features() -> dict[str, Column]:
    """Lag and rolling features read from the history array, the training rules exactly."""
    history = F.col("_history")
    columns = {f"sales_lag_{n}": F.element_at(history, -n) for n in LAGS}

    def tail(n: int) -> Column:
        return F.slice(history, HISTORY_DAYS - n + 1, n)

    def whole(n: int, value: Column) -> Column:
        return F.when(F.forall(tail(n), lambda y: y.isNotNull()), value)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, y: a + y)

    def median(n: int) -> Column:
        ordered = F.array_sort(tail(n))
        return (F.element_at(ordered, (n + 1) // 2) + F.element_at(ordered, n // 2 + 1)) / 2

    for n in MEAN_WINDOWS:
        columns[f"rolling_mean_{n}"] = whole(n, total(tail(n)) / n)
    for n in MEDIAN_WINDOWS:
        columns[f"rolling_median_{n}"] = whole(n, median(n))
    n = SPREAD_WINDOW
    mean = total(tail(n)) / n
    squares = F.aggregate(tail(n), F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
    return columns | {
        "rolling_std_28": whole(n, F.sqrt(squares / (n - 1))),
        "rolling_min_28": whole(n, F.array_min(tail(n))), "rolling_max_28": whole(n, F.array_max(tail(n))),
        "rolling_zero_rate_28": whole(n, total(F.transform(tail(n), lambda y: (y == 0).cast("double"))) / n),
    }


def _one_day(states: DataFrame, model: object, predictor: Predictor,
             columns: Mapping[str, Column]) -> DataFrame:
    """Predict the first open day and push it into the history; partitions stay as they are.

    The day leaves the front of the open days, so every step is the same plan and its
    generated code is compiled once.
    """
    frame = states.select("*", F.element_at("_future", 1).alias("_day")).select(
        *states.columns, "_day.*").withColumns(columns)
    scored = predictor(model, frame)
    require_columns(scored, [*SALES_GRAIN, "prediction"], "prediction output")
    if "_history" not in scored.columns:  # a predictor may return only grain and prediction
        scored = frame.join(scored.select(*SALES_GRAIN, "prediction"), SALES_GRAIN, "left")
    value = F.array(F.col("prediction").cast("double"))
    kept = [c for c in states.columns if c not in ("_history", "_future", "_forecast")]
    return scored.select(*kept, F.concat(F.slice("_history", 2, HISTORY_DAYS - 1), value).alias("_history"),
                         F.slice("_future", 2, HISTORY_DAYS).alias("_future"), F.concat("_forecast", value).alias("_forecast"))


def forecast_folds(models: Mapping[int, object], known: DataFrame, origins: Mapping[int, dt.date],
                   horizon: int, predictor: Predictor = predict_sales, check: bool = True) -> DataFrame:
    """Recursive forecasts of several origins: fold, grain and prediction.

    The states of all folds come from one shuffle; then each fold walks through its days
    on its own, a few folds side by side.
    """
    if check:
        assert_dense_calendar(known)
        ends = known.agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
        if max(origins.values()) + dt.timedelta(days=horizon) > ends["z"] or min(origins.values()) < ends["a"]:
            raise ValueError("the known frame ends before the horizon does")
    states = cut_lineage(series_states(known, origins, horizon).withColumn(
        "_forecast", F.array().cast("array<double>")))

    columns = state_features()  # built once, used by every step

    def walk(fold: int) -> DataFrame:
        current = states if len(origins) == 1 else states.filter(F.col("fold") == fold)
        for _ in range(horizon):
            current = cut_lineage(_one_day(current, models[fold], predictor, columns))
        return current

    with ThreadPoolExecutor(max_workers=PARALLEL_FOLDS) as pool:
        finished = union_all(list(pool.map(walk, origins)))
    result = finished.select("fold", "origin", *SERIES, F.posexplode("_forecast").alias("_step", "prediction")).select(
        "fold", F.date_add("origin", F.col("_step") + 1).alias("date"), *SERIES, "prediction")
    if check:
        row = result.agg(F.count(F.lit(1)).alias("n"), F.count_if(
            ~is_finite("prediction") | (F.col("prediction") < 0)).alias("bad")).first()
        if row["n"] != states.count() * horizon:
            raise RuntimeError("the recursion lost or gained rows")
        if row["bad"]:
            raise RuntimeError("the predictor gave a value that is negative or not finite")
    return result


def recursive_forecast(model: object, known: DataFrame, origin: dt.date | str, start: dt.date | str,
                       end: dt.date | str, predictor: Predictor = predict_sales, check: bool = True) -> DataFrame:
    """Forecast the days ``start`` to ``end`` after ``origin``: grain and prediction."""
    first, begin, last = (dt.date.fromisoformat(str(d)) for d in (origin, start, end))
    if begin != first + dt.timedelta(days=1) or last < begin:
        raise ValueError("start must be the day after the origin and not lie after the end")
    horizon = (last - begin).days + 1
    return forecast_folds({1: model}, known, {1: first}, horizon, predictor, check).drop("fold")
