"""Registered queries: feature frame, folds, baselines, intermittent demand, segments, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast import (
    baselines, contract, evaluate, intermittent, intervals, segments, splits, submission, walk,
)
from shelfcast.forecast.backtest import fold_origins
from shelfcast.forecast.model import encode_categories
from shelfcast.functions.columns import one_row
from shelfcast.operators import features, quality, readiness
from shelfcast.operators.audit import union_all
from shelfcast.plans.registry import query
from shelfcast.plans.workspace import Workspace
from shelfcast.schemas import SALES_GRAIN, SERIES

SEGMENT_MODEL = "rolling_historical_median_28d"


def _last(train: DataFrame) -> Column:
    return one_row(train.agg(F.max("date").alias("d")))["d"]


def _dense(ws: Workspace) -> DataFrame:
    return features.densify(ws.rollup()["train"])


def _oof(ws: Workspace) -> DataFrame:
    """Baseline predictions of five folds; fold 0 only calibrates intervals."""
    return ws.stored("result_baseline_oof", lambda: baselines.backtest_predictions(
        ws.rollup()["train"], first_fold=0))


@query("q7_c5_w7_m5_gate_violations")
def gate_violations(ws: Workspace) -> DataFrame:
    return quality.gate_violations(ws.clean(), ws.warehouse(), _oof(ws))


def _segment_oof(ws: Workspace) -> DataFrame:
    return _oof(ws).filter((F.col("model") == SEGMENT_MODEL) & (F.col("fold") >= 1)).select(
        "fold", *SALES_GRAIN, "sales", "prediction")


def _labels(ws: Workspace) -> DataFrame:
    return ws.stored("result_rollup_readiness", lambda: readiness.forecast_readiness(ws.rollup_star()))


def _labeled(ws: Workspace) -> DataFrame:
    frame = ws.known_frame().select(*SALES_GRAIN, "promotion_active", "is_holiday", "store_type")
    return segments.attach_labels(_segment_oof(ws), _labels(ws)).join(frame, SALES_GRAIN, "left")


def _scores(ws: Workspace) -> DataFrame:
    return baselines.backtest_scores(_oof(ws).filter("fold >= 1"))


def _croston(ws: Workspace) -> DataFrame:
    train = ws.rollup()["train"]
    return intermittent.intermittent_backtest(train, train.select(*SERIES).distinct())


def _croston_scores(ws: Workspace) -> DataFrame:
    oof = _croston(ws)
    return union_all([intermittent.score_cohort(oof.filter(F.col("model") == m), oof.select(*SERIES), m)
                      for m in intermittent.METHODS])


def _future_baseline(ws: Workspace) -> DataFrame:
    """Seasonal baseline for the held-out horizon, as a submission source."""
    rolled = ws.rollup()
    ends = rolled["future"].agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
    cutoff = rolled["train"].agg(F.max("date")).first()[0]
    return baselines.forecast_baseline(rolled["train"], ends["a"], ends["z"], cutoff, "seasonal_naive_7d",
                                       rolled["future"])


query("f1_forecast_contract")(lambda ws: contract.forecast_contract(ws.rollup()["train"], ws.rollup()["future"]))


@query("f2_feature_availability")
def feature_availability(ws: Workspace) -> DataFrame:
    rolled, raw = ws.rollup(), ws.raw()
    return contract.feature_availability(rolled["train"], rolled["future"], rolled["stores"], raw["holidays"],
                                         raw["oil"], raw["transactions"])


query("f3_missing_observations")(lambda ws: contract.missing_observations(
    ws.rollup()["train"], ws.warehouse()["dim_store_date"], ws.rollup()["future"]))


@query("f4_f5_f6_forecast_frame")
def forecast_frame(ws: Workspace) -> DataFrame:
    rolled = ws.rollup()
    return features.forecast_frame(rolled["train"], rolled["future"], rolled["stores"], rolled["raw_holidays"])


@query("f7_to_f10_f23_known_frame")
def known_frame(ws: Workspace) -> DataFrame:
    rolled = ws.rollup()
    return features.dense_known_frame(rolled["train"], rolled["stores"], rolled["raw_holidays"])


@query("f11_future_feature_gaps")
def future_feature_gaps(ws: Workspace) -> DataFrame:
    rolled = ws.rollup()
    return features.future_feature_gaps(features.forecast_frame(
        rolled["train"], rolled["future"], rolled["stores"], rolled["raw_holidays"], False))


query("f13_f14_sales_lags")(lambda ws: features.add_lags(_dense(ws)))
query("f16_rolling_features")(lambda ws: features.add_rollings(_dense(ws)))


@query("f15_f18_origin_safe_features")
def origin_safe_features(ws: Workspace) -> DataFrame:
    dense = _dense(ws)
    return features.add_causal_features(dense, F.date_sub(_last(dense), 16))


query("f19_causal_training_frame")(lambda ws: ws.training_frame())


@query("f20_next_day_features")
def next_day_features(ws: Workspace) -> DataFrame:
    last = ws.rollup()["train"].agg(F.date_sub(F.max("date"), 16), F.date_sub(F.max("date"), 15)).first()
    return features.next_day_features(_dense(ws), last[0], last[1], last[1])


@query("f21_encoded_categories")
def encoded_categories(ws: Workspace) -> DataFrame:
    known = ws.known_frame().select(*SALES_GRAIN, "store_type", "cluster", "city", "state")
    encoded = encode_categories(known).transform(known)
    return encoded.select(*SALES_GRAIN, *[F.col(f"{c}_index").cast("int").alias(f"{c}_index")
                                          for c in features.CATEGORICAL])


query("f22_feature_matrix")(lambda ws: features.feature_matrix(ws.training_frame()))

query("m1_rolling_splits")(lambda ws: splits.rolling_splits(ws.spark, _last(ws.rollup()["train"])))
query("m6_to_m13_baseline_predictions")(lambda ws: _oof(ws))
query("m2_m3_m4_m14_baseline_scores")(lambda ws: baselines.backtest_scores(
    baselines.backtest_predictions(ws.rollup()["train"])))
query("m15_m17_baseline_summary")(lambda ws: evaluate.summarize_scores(_scores(ws)))
query("m16_scored_predictions")(lambda ws: evaluate.score_predictions(
    ws.rollup()["all"].join(ws.rollup()["future"].select(*SALES_GRAIN), SALES_GRAIN, "left_semi"), _future_baseline(ws)))
query("m18_leaderboard")(lambda ws: evaluate.leaderboard(
    evaluate.summarize_scores(_croston_scores(ws)), evaluate.summarize_scores(_scores(ws))))


@query("q37_split_check")
def split_check(ws: Workspace) -> DataFrame:
    """Folds beside the dates of the stored backtest."""
    used = _oof(ws).filter("fold >= 1").select("fold", "train_end", "validation_start", "validation_end").distinct()
    wanted = splits.rolling_splits(ws.spark, _last(ws.rollup()["train"]))
    return union_all([wanted.exceptAll(used), used.exceptAll(wanted)]).agg(
        F.count(F.lit(1)).alias("different_folds")).withColumn("passed", F.col("different_folds") == 0)


query("q38_score_contract")(lambda ws: evaluate.score_contract(_scores(ws)))
query("g7_oof_contract")(lambda ws: evaluate.oof_contract(_segment_oof(ws)))


@query("g8_strategy_comparison")
def strategy_comparison(ws: Workspace) -> DataFrame:
    scores = _scores(ws)
    return evaluate.compare_strategies(scores.filter("model = 'seasonal_naive_7d'"),
                                       scores.filter("model = 'rolling_historical_median_28d'"))


@query("g3_g4_g5_recursive_steps")
def recursive_steps(ws: Workspace) -> DataFrame:
    """Recursion with a transparent predictor (yesterday plus ten) from every fold origin."""
    def add_ten(model, inputs):
        return inputs["sales_lag_1"] + 10.0

    origins = fold_origins(ws.rollup()["train"])
    return walk.walk({f: {"steps": None} for f in origins}, ws.known_frame(), [], origins, splits.HORIZON, add_ten, missing=0.0).drop("run")


query("i1_i2_i8_intermittent_predictions")(lambda ws: _croston(ws))
query("i8_intermittent_scores")(lambda ws: _croston_scores(ws))
query("i6_intermittent_series")(lambda ws: intermittent.intermittent_series(
    readiness.forecast_readiness(ws.warehouse())))


def _routing_scores(ws: Workspace) -> DataFrame:
    control = _scores(ws).filter("model = 'seasonal_naive_7d'").select(
        F.lit(intermittent.CONTROL).alias("model"), "fold", "rmsle", "mae", "wape")
    return _croston_scores(ws).unionByName(control)


query("i5_routing_summary")(lambda ws: intermittent.summarize_routing(_routing_scores(ws)))
query("i10_fold_wins")(lambda ws: intermittent.fold_wins(_routing_scores(ws)))


@query("i7_control_on_cohort")
def control_on_cohort(ws: Workspace) -> DataFrame:
    cohort = _labels(ws).filter("is_promotion_dependent = 1 OR is_intermittent = 1")
    return intermittent.score_cohort(_segment_oof(ws), cohort, SEGMENT_MODEL)


query("u2_segment_scores")(lambda ws: segments.score_segments(_segment_oof(ws), ["fold", "store_nbr"]))
query("u3_labeled_predictions")(lambda ws: segments.attach_labels(_segment_oof(ws), _labels(ws)))
query("u4_flag_scores")(lambda ws: segments.score_flags(segments.attach_labels(_segment_oof(ws), _labels(ws))))
query("u5_u6_segment_tables")(lambda ws: segments.segment_tables(_labeled(ws), [
    "store_nbr", "family", "readiness_class", "promotion_active", "is_holiday", "store_type"]))
query("u6_best_and_worst")(lambda ws: segments.best_and_worst(
    segments.score_segments(_segment_oof(ws), SERIES).withColumn(
        "series", F.concat_ws("/", F.col("store_nbr").cast("string"), "family")), "series", 3))


def _calibration_oof(ws: Workspace) -> DataFrame:
    """Predictions of one model over all folds, the earliest included."""
    return _oof(ws).filter(F.col("model") == SEGMENT_MODEL).select("fold", *SALES_GRAIN, "sales", "prediction")


def _calibrated(ws: Workspace):
    return intervals.calibrate_folds(_calibration_oof(ws))


query("u7_u11_calibration")(lambda ws: _calibrated(ws)[1])
query("u7_series_calibration")(lambda ws: intervals.calibrate_series(_calibration_oof(ws)))
query("u8_prediction_intervals")(lambda ws: _calibrated(ws)[0])
query("u9_u10_interval_scores")(lambda ws: intervals.score_intervals(_calibrated(ws)[0], ["fold"]))


@query("u12_interval_segments")
def interval_segments(ws: Workspace) -> DataFrame:
    bounds = ws.stored("result_intervals", lambda: _calibrated(ws)[0])
    return intervals.segment_scores(segments.attach_labels(bounds, _labels(ws)))


query("z3_submission")(lambda ws: submission.create_submission(ws.rollup()["future"], _future_baseline(ws)))
query("q39_z4_submission_checks")(lambda ws: submission.submission_checks(
    submission.create_submission(ws.rollup()["future"], _future_baseline(ws)), ws.rollup()["future"]))
query("z2_final_inputs")(lambda ws: ws.training_frame().select(
    "id", *SALES_GRAIN, *features.FEATURES[2:]))
