"""Recursion over the whole horizon in one pass.

A series is one row: an array with its last 364 days and an array with the known inputs of the forecast days, built for all
origins in one shuffle. A task walks its series through all days at once, every model of the origin on its own history, so neither
days nor models nor folds add a job or a checkpoint. Series of any number are spread over tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.recursive import HISTORY_DAYS, assert_dense_calendar
from shelfcast.functions.columns import is_finite
from shelfcast.operators.features import LAGS, MEAN_WINDOWS, MEDIAN_WINDOWS, SPREAD_WINDOW
from shelfcast.schemas import SALES_GRAIN, SERIES

#: Prediction of one day: model and inputs by name, one value per series.
DayPredictor = Callable[[object, Mapping[str, np.ndarray]], np.ndarray]


def model_prediction(model: object, inputs: Mapping[str, np.ndarray]) -> np.ndarray:
    return model.predict(inputs)


def history_inputs(history: np.ndarray) -> dict[str, np.ndarray]:
    """Lags and rolling statistics of the last days, newest last; missing unless the whole window was observed."""
    tail = lambda n: history[:, -n:]
    n = SPREAD_WINDOW
    out = {f"sales_lag_{k}": history[:, -k] for k in LAGS}
    out |= {f"rolling_mean_{k}": tail(k).mean(axis=1) for k in MEAN_WINDOWS}
    out |= {f"rolling_median_{k}": np.where(np.isnan(tail(k)).any(axis=1), np.nan, np.median(np.nan_to_num(tail(k)), axis=1)) for k in MEDIAN_WINDOWS}
    zero = np.where(np.isnan(tail(n)).any(axis=1), np.nan, (tail(n) == 0).mean(axis=1))
    return out | {"rolling_std_28": tail(n).std(axis=1, ddof=1), "rolling_min_28": tail(n).min(axis=1),
                  "rolling_max_28": tail(n).max(axis=1), "rolling_zero_rate_28": zero}


def series_states(known: DataFrame, inputs: list[str], origins: Mapping[int, dt.date], horizon: int) -> DataFrame:
    """(fold, series, past, ahead): sales of the last days and ``inputs`` of the horizon; no target after an origin is read."""
    folds = F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(day).alias("origin")) for fold, day in origins.items()])
    age = F.datediff("origin", "date")
    past = F.when(age.between(0, HISTORY_DAYS - 1), F.struct("date", F.col("sales").cast("double").alias("y")))
    ahead = F.when(age.between(-horizon, -1), F.struct("date", F.array(*[F.col(c).cast("double") for c in inputs]).alias("x")))
    rows = known.select(*SALES_GRAIN, "sales", *[c for c in inputs if c not in (*SALES_GRAIN, "sales")]).repartition(*SERIES) \
        .select("*", F.inline(folds)).filter(age.between(-horizon, HISTORY_DAYS - 1))
    states = rows.groupBy("fold", "origin", *SERIES).agg(
        F.transform(F.array_sort(F.collect_list(past)), lambda e: e["y"]).alias("past"),
        F.transform(F.array_sort(F.collect_list(ahead)), lambda e: e["x"]).alias("ahead"))
    missing = F.array_repeat(F.lit(None).cast("double"), F.lit(HISTORY_DAYS) - F.size("past"))
    return states.select("fold", "origin", *SERIES, F.concat(missing, "past").alias("past"), "ahead")


def walk(models: Mapping[int, Mapping[str, object]], known: DataFrame, inputs: list[str], origins: Mapping[int, dt.date], horizon: int,
         predictor: DayPredictor = model_prediction, suffix: str = "", missing: float = np.nan, check: bool = True) -> DataFrame:
    """(run, fold, grain, prediction) of every model of every fold over the horizon.

    ``inputs`` are the known numeric columns, ``suffix`` ends the names of the lags and rolling statistics, ``missing`` stands for an unknown one."""
    if check:
        assert_dense_calendar(known)
        ends = known.agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
        if max(origins.values()) + dt.timedelta(days=horizon) > ends["z"] or min(origins.values()) < ends["a"]:
            raise ValueError("the known frame ends before the horizon does")
    spark = known.sparkSession
    shared = spark.sparkContext.broadcast({fold: dict(x) for fold, x in models.items()})
    states = series_states(known, inputs, origins, horizon)
    kinds = {c: states.schema[c].dataType.simpleString() for c in SERIES}

    def forecast(model: object, past: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        history, out = past, np.empty((len(past), horizon))
        for day in range(horizon):
            own = {c + suffix: np.where(np.isnan(v), missing, v) for c, v in history_inputs(history).items()}
            out[:, day] = predictor(model, {c: ahead[:, day, i] for i, c in enumerate(inputs)} | own)
            history = np.concatenate([history[:, 1:], out[:, day:day + 1]], axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            past = batch["past"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, HISTORY_DAYS)
            ahead = batch["ahead"].flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, horizon, len(inputs))
            fold = batch["fold"].to_numpy()
            for number in np.unique(fold):
                rows = np.flatnonzero(fold == number)
                part = batch.take(pa.array(rows))
                for name, model in shared.value[int(number)].items():
                    values = forecast(model, past[rows], ahead[rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), part["fold"], part["origin"], *[part[c] for c in SERIES],
                         pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, horizon, dtype=np.int32)), pa.array(values.ravel()))],
                        ["run", "fold", "origin", *SERIES, "values"])

    found = states.mapInArrow(run, f"run string, fold int, origin date, {', '.join(f'{c} {k}' for c, k in kinds.items())}, values array<double>")
    result = found.select("run", "fold", "origin", *SERIES, F.posexplode("values").alias("step", "prediction")).select(
        "run", "fold", F.date_add("origin", F.col("step") + 1).alias("date"), *SERIES, "prediction")
    return result


def assert_predictions(predictions: DataFrame, rows: int) -> None:
    """As many rows as expected, every value finite and not negative; for stored predictions."""
    row = predictions.agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_finite("prediction") | (F.col("prediction") < 0)).alias("bad")).first()
    if row["n"] != rows:
        raise RuntimeError("the recursion lost or gained rows")
    if row["bad"]:
        raise RuntimeError("the predictor gave a value that is negative or not finite")
