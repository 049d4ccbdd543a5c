"""Registered queries with fitted models: no SQL twin can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast import backtest, evaluate, intermittent, intervals, model, segments, selection, submission
from shelfcast.functions.columns import rounded
from shelfcast.plans.forecast_queries import _labels, _scores
from shelfcast.plans.registry import query
from shelfcast.plans.workspace import Workspace
from shelfcast.schemas import SALES_GRAIN

#: Every registered model is fitted on the library's whole schedule.
FULL = model.TreeParameters()


def _choice(ws: Workspace, path: str) -> dict:
    """The configuration that the parameter search marked, saved below ``path`` and read back."""
    results = ws.stored("result_tuning", lambda: tuning_summary(ws))
    selection.save_selection(results, selection.NO_HOLIDAY, path)
    return selection.load_selection(ws.spark, path)


def _chosen_parameters(chosen: dict) -> model.TreeParameters:
    return model.TreeParameters(**{name: chosen[name] for name in FULL.as_row()})


def _oof(ws: Workspace) -> DataFrame:
    """Out-of-fold rows of the global model; fold 0 only calibrates intervals."""
    actual = ws.rollup()["train"]
    return ws.stored("result_model_oof", lambda: backtest.backtest(
        ws.training_frame(), ws.known_frame(), actual, backtest.fold_origins(actual, first_fold=0),
        FULL, selection.NO_HOLIDAY))


def _folds(ws: Workspace) -> DataFrame:
    return _oof(ws).filter("fold >= 1")


query("g1_g2_g6_global_backtest")(lambda ws: _folds(ws))
query("g9_model_scores")(lambda ws: backtest.fold_scores(_folds(ws)))
query("m18_model_leaderboard")(lambda ws: evaluate.leaderboard(
    evaluate.summarize_scores(backtest.fold_scores(_folds(ws)).withColumn("model", F.lit("global_model"))),
    evaluate.summarize_scores(_scores(ws))))


@query("g10_feature_importance")
def feature_importance(ws: Workspace) -> DataFrame:
    train = ws.rollup()["train"]
    fitted = model.train_global_model(ws.training_frame(), train.agg(F.max("date")).first()[0], FULL)
    return fitted.importances()


@query("g11_g12_ablation_summary")
def ablation_summary(ws: Workspace) -> DataFrame:
    actual = ws.rollup()["train"]
    scores = backtest.run_experiments(
        ws.training_frame(), ws.known_frame(), actual, backtest.fold_origins(actual),
        {name: (FULL, columns) for name, columns in selection.EXPERIMENTS.items()}, f"{ws.root}/ablation_scores")
    baseline = _scores(ws).filter("model = 'rolling_historical_median_28d'").select(
        F.lit("M0").alias("experiment"), "fold", "rmsle", "mae", "wape")
    return ws.stored("result_ablation", lambda: selection.summarize_ablation(baseline.unionByName(scores)))


query("g13_recommended_experiment")(lambda ws: selection.recommended_experiment(ablation_summary(ws)))


@query("g14_g15_g17_tuning_summary")
def tuning_summary(ws: Workspace) -> DataFrame:
    actual = ws.rollup()["train"]
    scores = backtest.run_experiments(
        ws.training_frame(), ws.known_frame(), actual, backtest.fold_origins(actual),
        {name: (parameters, selection.NO_HOLIDAY) for name, parameters in selection.GRID.items()}, f"{ws.root}/tuning_scores")
    return selection.summarize_tuning(scores)


@query("g18_g19_stored_selection")
def stored_selection(ws: Workspace) -> DataFrame:
    """The chosen settings saved and read back, with the stored model's predictions counted."""
    path = f"{ws.root}/selection"
    chosen = _choice(ws, path)
    train = ws.rollup()["train"]
    last = train.agg(F.max("date")).first()[0]
    model.train_global_model(ws.training_frame(), last, _chosen_parameters(chosen), chosen["feature_list"]).save(f"{path}/model")
    loaded = model.GlobalModel.load(f"{path}/model")
    scored = model.predict_sales(loaded, ws.training_frame().filter("sales IS NOT NULL"))
    return scored.agg(F.count("prediction").alias("scored_rows"), F.min("prediction").alias("smallest")).withColumns({
        "experiment": F.lit(chosen["experiment"]), "feature_count": F.lit(chosen["feature_count"])})


def _two_stage_oof(ws: Workspace) -> DataFrame:
    actual = ws.rollup()["train"]
    return ws.stored("result_two_stage_oof", lambda: backtest.backtest(
        ws.training_frame(), ws.known_frame(), actual, backtest.fold_origins(actual), FULL,
        selection.NO_HOLIDAY, two_stage=True))


def strategy_oofs(ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold rows of the global model and of the two stages; if neither is stored yet, one job fits and one pass walks both."""
    if ws.holds("result_model_oof") or ws.holds("result_two_stage_oof"):
        return _oof(ws), _two_stage_oof(ws)

    def build() -> DataFrame:
        actual = ws.rollup()["train"]
        return backtest.backtest_runs(ws.training_frame(), ws.known_frame(), actual, [
            *backtest.planned_runs("global", backtest.fold_origins(actual, first_fold=0), FULL, selection.NO_HOLIDAY),
            *backtest.planned_runs("two_stage", backtest.fold_origins(actual), FULL, selection.NO_HOLIDAY, two_stage=True)])

    both = ws.stored("result_strategies_oof", build)
    return tuple(ws.stored(name, lambda run=run: both.filter(F.col("experiment") == run).drop("experiment"))
                 for name, run in (("result_model_oof", "global"), ("result_two_stage_oof", "two_stage")))


query("i3_i4_i9_two_stage_backtest")(lambda ws: _two_stage_oof(ws))


@query("i7_i9_two_stage_on_cohort")
def two_stage_on_cohort(ws: Workspace) -> DataFrame:
    cohort = _labels(ws).filter("is_promotion_dependent = 1 OR is_intermittent = 1")
    return intermittent.score_cohort(_two_stage_oof(ws), cohort, "two_stage").unionByName(
        intermittent.score_cohort(_folds(ws), cohort, intermittent.CONTROL))


@query("u11_model_intervals")
def model_intervals(ws: Workspace) -> DataFrame:
    bounds, _ = intervals.calibrate_folds(_oof(ws))
    return intervals.score_intervals(bounds, ["fold"])


@query("u1_u5_model_segments")
def model_segments(ws: Workspace) -> DataFrame:
    segments.validate_oof(_folds(ws))
    return segments.segment_tables(segments.attach_labels(_folds(ws), _labels(ws)), ["store_nbr", "family", "readiness_class"])


@query("s19_z1_z5_final_forecast")
def final_forecast(ws: Workspace) -> DataFrame:
    """Final fit and recursive forecast: a new version, validated as stored, then published."""
    from shelfcast.sources.sinks import publish

    rolled = ws.rollup()
    chosen = _choice(ws, f"{ws.root}/final_selection")
    result = submission.train_and_forecast(
        rolled["train"], rolled["future"], rolled["stores"], rolled["raw_holidays"], _chosen_parameters(chosen),
        chosen["feature_list"], cross_product=False)

    def validate(stored: DataFrame) -> None:
        submission.validate_submission(stored.select("id", "sales"), rolled["future"], rolled["train"], False)

    return publish(rounded(result), f"{ws.root}/submission", validate)


query("q39_id_fingerprint")(lambda ws: submission.ordered_id_hash(ws.rollup()["future"], SALES_GRAIN))


# ------------------------------------------------------------------ what SQL can state about fitted models

@query("g1_g2_g6_oof_contract")
def oof_contract(ws: Workspace) -> DataFrame:
    """Rows, duplicates and invalid predictions of the global model's out-of-fold rows, with what they were scored against."""
    return _with_actuals(_folds(ws))


query("i3_i4_i9_oof_contract")(lambda ws: _with_actuals(_two_stage_oof(ws)))


def _with_actuals(oof: DataFrame) -> DataFrame:
    seen = oof.groupBy("fold").agg(F.sum("sales").alias("actual_sales"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                                   F.count_distinct("store_nbr", "family").alias("series_count"))
    return evaluate.oof_contract(oof).join(seen, "fold")


@query("g10_importance_contract")
def importance_contract(ws: Workspace) -> DataFrame:
    """Every feature once, shares that add up to one, ranks in order of the shares."""
    rows = feature_importance(ws)
    return rows.agg(F.count_distinct("feature").alias("features"), F.count(F.lit(1)).alias("row_count"), F.sum("importance").alias("whole"),
                    F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count_if(F.col("importance") < 0).alias("negative_shares"))


query("g11_g12_ablation_contract")(lambda ws: ablation_summary(ws).select(
    "experiment", "experiment_order", "added_group", "comparison_experiment", "fold_count", F.col("rmsle_mean").isNotNull().alias("scored")))
query("g14_g15_g17_tuning_contract")(lambda ws: ws.stored("result_tuning", lambda: tuning_summary(ws)).select(
    "experiment", *FULL.as_row(), "parameter_change_count", "fold_count", "is_untuned_control", (F.col("rmsle_mean") > 0).alias("scored")))


@query("g18_g19_selection_contract")
def selection_contract(ws: Workspace) -> DataFrame:
    """The stored model scores every observed row, never below zero."""
    return stored_selection(ws).select("scored_rows", (F.col("smallest") >= 0).alias("valid"), "feature_count")


query("u11_interval_contract")(lambda ws: intervals.calibrate_folds(_oof(ws))[0].groupBy("fold").agg(
    F.count(F.lit(1)).alias("row_count"), F.sum("sales").alias("actual_sales"),
    F.count_if((F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")) | (F.col("p10") < 0)).alias("disordered_rows")))
query("z5_forecast_contract")(lambda ws: submission.submission_checks(final_forecast(ws).select("id", "sales"), ws.rollup()["future"]))
