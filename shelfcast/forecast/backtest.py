"""Global-model backtests: all fits in one job, all forecasts in one pass, what was scored is kept."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast.boosting import MISSING, table_version
from shelfcast.forecast.metrics import error_metrics
from shelfcast.forecast.model import INPUT, TreeParameters, Wanted, encoded, fit_models
from shelfcast.forecast.splits import FOLDS, HORIZON, fold_array
from shelfcast.forecast.walk import assert_predictions, walk
from shelfcast.operators.features import FEATURES, LAG_FEATURES, ROLLING_FEATURES
from shelfcast.schemas import SALES_GRAIN, SERIES
from shelfcast.session import cut_lineage
from shelfcast.sources.sinks import append_scores, missing_runs


def fold_origins(actual: DataFrame, horizon: int = HORIZON, folds: int = FOLDS,
                 first_fold: int = 1) -> dict[int, dt.date]:
    """Training end per fold: a handful of dates, needed to start the fits."""
    last = F.lit(str(actual.agg(F.max("date")).first()[0])).cast("date")
    rows = actual.sparkSession.range(1).select(F.inline(fold_array(last, horizon, folds, first_fold))).collect()
    return {row["fold"]: row["train_end"] for row in rows}


@dataclass(frozen=True)
class Run:
    """One experiment on one fold."""

    experiment: str
    fold: int
    model: Wanted

    def key(self, version: str) -> str:
        """Fingerprint of everything that the score depends on."""
        text = json.dumps([version, str(self.model.cutoff), self.model.parameters.as_row(), self.model.parameters.seed, self.model.features,
                           "two stages" if self.model.two_stage else "global"], sort_keys=True)
        return hashlib.sha256(f"{self.experiment} {self.fold} {text}".encode()).hexdigest()


def forecast_runs(training: DataFrame, known: DataFrame, runs: Sequence[Run], horizon: int = HORIZON) -> DataFrame:
    """(experiment, fold, grain, prediction) of every run, stored: one job of fits, one pass over the series."""
    models = fit_models(training, {f"{r.experiment}/{r.fold}": r.model for r in runs})
    by_fold: dict[int, dict[str, object]] = {}
    for r in runs:
        by_fold.setdefault(r.fold, {})[r.experiment] = models[f"{r.experiment}/{r.fold}"]
    origins = {r.fold: r.model.cutoff for r in runs}
    features = [c for c in dict.fromkeys(c for r in runs for c in r.model.features) if c not in (*LAG_FEATURES, *ROLLING_FEATURES)]
    indexer = next(iter(models.values())).indexer
    ready = encoded(known, indexer, features, *SALES_GRAIN, "sales")
    predictions = cut_lineage(walk(by_fold, ready, [f"{c}{INPUT}" for c in features], origins, horizon, suffix=INPUT, missing=MISSING))
    series = known.select(*SERIES).distinct().count()
    assert_predictions(predictions, len(runs) * series * horizon)
    return predictions.withColumnRenamed("run", "experiment")


def backtest_runs(training: DataFrame, known: DataFrame, actual: DataFrame, runs: Sequence[Run], horizon: int = HORIZON) -> DataFrame:
    """Out-of-fold rows (experiment, fold, grain, sales, prediction) of the days that were observed."""
    predictions = forecast_runs(training, known, runs, horizon)
    return predictions.join(actual.select(*SALES_GRAIN, F.col("sales").cast("double").alias("sales")), SALES_GRAIN).select(
        "experiment", "fold", *SALES_GRAIN, "sales", "prediction")


def planned_runs(experiment: str, origins: Mapping[int, dt.date], parameters: TreeParameters | None = None,
                 features: list[str] | None = None, two_stage: bool = False) -> list[Run]:
    """One configuration on every fold."""
    wanted = Wanted(dt.date.min, parameters or TreeParameters(), tuple(FEATURES if features is None else features), two_stage)
    return [Run(experiment, fold, replace(wanted, cutoff=day)) for fold, day in origins.items()]


def backtest(training: DataFrame, known: DataFrame, actual: DataFrame, origins: Mapping[int, dt.date],
             parameters: TreeParameters | None = None, features: list[str] | None = None,
             horizon: int = HORIZON, two_stage: bool = False) -> DataFrame:
    """Out-of-fold rows (fold, grain, sales, prediction) of one configuration."""
    runs = planned_runs("model", origins, parameters, features, two_stage)
    return backtest_runs(training, known, actual, runs, horizon).drop("experiment")


def fold_scores(oof: DataFrame, *labels: str) -> DataFrame:
    return oof.groupBy(*labels, "fold").agg(*error_metrics())


def run_experiments(training: DataFrame, known: DataFrame, actual: DataFrame, origins: Mapping[int, dt.date],
                    experiments: Mapping[str, tuple[TreeParameters, list[str]]], path: str) -> DataFrame:
    """Score every planned (experiment, fold) once; a rerun only does what is missing or was run with other settings, features or rows."""
    spark, version = known.sparkSession, table_version(training)
    runs = {}
    for name, (parameters, features) in experiments.items():
        wanted = Wanted(dt.date.min, parameters or TreeParameters(), tuple(FEATURES if features is None else features))
        for fold, day in origins.items():
            run = Run(name, fold, replace(wanted, cutoff=day))
            runs[run.key(version)] = run
    planned = spark.createDataFrame([(r.experiment, r.fold, key) for key, r in runs.items()], "experiment string, fold int, run_key string")
    todo = [runs[row["run_key"]] for row in missing_runs(spark, planned, path, ["run_key"]).collect()]
    if todo:
        scores = fold_scores(backtest_runs(training, known, actual, todo), "experiment")
        append_scores(scores.join(planned, ["experiment", "fold"]), path, ["experiment"])
    stored = spark.read.parquet(path).join(planned.select("run_key"), "run_key", "left_semi").dropDuplicates(["run_key"])
    return stored.select("experiment", "fold", "rmsle", "mae", "wape")
