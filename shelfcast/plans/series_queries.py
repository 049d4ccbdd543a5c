"""Registered queries at store x family grain: gaps, intermittent series and hot stores reach every step.

The builders are those of the rolled-up queries over another layer. Frames are returned for the rows that models read
(observed or to be forecast); features are computed on the dense days between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.forecast import evaluate, intermittent
from shelfcast.forecast.backtest import fold_scores
from shelfcast.operators import features
from shelfcast.operators.audit import union_all
from shelfcast.plans import forecast_queries as rolled
from shelfcast.plans import model_queries as models
from shelfcast.plans.registry import QUERIES, query
from shelfcast.plans.workspace import SeriesWorkspace, Workspace
from shelfcast.schemas import SALES_GRAIN, SERIES

SUFFIX = "_store_family"
#: Queries that are the same builder over the other layer.
SAME = """f1_forecast_contract f11_future_feature_gaps f20_next_day_features
m1_rolling_splits m6_to_m13_baseline_predictions m2_m3_m4_m14_baseline_scores m15_m17_baseline_summary m16_scored_predictions
q37_split_check q38_score_contract g7_oof_contract g3_g4_g5_recursive_steps
u2_segment_scores u3_labeled_predictions u4_flag_scores u5_u6_segment_tables u6_best_and_worst
u7_u11_calibration u7_series_calibration u8_prediction_intervals u9_u10_interval_scores u12_interval_segments
z3_submission q39_z4_submission_checks""".split()


def by_series(ws: Workspace) -> SeriesWorkspace:
    return SeriesWorkspace.of(ws.spark, ws.folder)


for _name in SAME:
    query(_name + SUFFIX)(lambda ws, build=QUERIES[_name]: build(by_series(ws)))


def _source_rows(frame: DataFrame) -> DataFrame:
    """Rows of the source tables, without the days that densifying added."""
    return frame.filter(F.col("id").isNotNull())


query("f4_f5_f6_source_rows" + SUFFIX)(lambda ws: _source_rows(rolled.forecast_frame(by_series(ws))))
query("f13_f14_sales_lags" + SUFFIX)(lambda ws: _source_rows(features.add_lags(rolled._dense(by_series(ws)))))
query("f16_rolling_features" + SUFFIX)(lambda ws: _source_rows(features.add_rollings(rolled._dense(by_series(ws)))))
query("f15_f18_origin_safe_features" + SUFFIX)(lambda ws: _source_rows(rolled.origin_safe_features(by_series(ws))))
query("f19_causal_training_rows" + SUFFIX)(lambda ws: _source_rows(by_series(ws).training_frame()))


@query("f3_dense_days" + SUFFIX)
def dense_days(ws: Workspace) -> DataFrame:
    """Days and observed days of every series after densifying."""
    return rolled._dense(by_series(ws)).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("days"), F.count("sales").alias("observed_days"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"), F.sum("sales").alias("sales"))


# ------------------------------------------------------------------ intermittent demand on the cohort of readiness

def cohort(ws: SeriesWorkspace) -> DataFrame:
    return ws.stored("result_cohort", lambda: intermittent.intermittent_series(rolled._labels(ws)))


def croston_oof(ws: Workspace) -> DataFrame:
    space = by_series(ws)
    return space.stored("result_croston_oof", lambda: intermittent.intermittent_backtest(space.rollup()["train"], cohort(space)))


def croston_scores(ws: Workspace) -> DataFrame:
    oof, members = croston_oof(ws), cohort(by_series(ws))
    return union_all([intermittent.score_cohort(oof.filter(F.col("model") == m), members, m) for m in intermittent.METHODS])


query("i1_i2_i8_intermittent_predictions" + SUFFIX)(croston_oof)
query("i8_intermittent_scores" + SUFFIX)(croston_scores)


@query("i7_baselines_on_cohort" + SUFFIX)
def baselines_on_cohort(ws: Workspace) -> DataFrame:
    space = by_series(ws)
    return rolled._oof(space).filter("fold >= 1").select("model", "fold", *SALES_GRAIN, "sales", "prediction").join(
        cohort(space), SERIES, "left_semi").groupBy("model", "fold").agg(*intermittent.error_metrics())


# ------------------------------------------------------------------ stored model scores against each other

def _model_scores(ws: Workspace) -> DataFrame:
    """Scores on the cohort per strategy and fold: intermittent methods, two stages and the global model as control."""
    space = by_series(ws)
    members = cohort(space)

    def build() -> DataFrame:
        control, two_stage = models.strategy_oofs(space)
        return union_all([
            croston_scores(ws).select("model", "fold", "rmsle", "mae", "wape"),
            intermittent.score_cohort(two_stage, members, "two_stage"),
            intermittent.score_cohort(control.filter("fold >= 1"), members, intermittent.CONTROL)])

    return space.stored("result_cohort_scores", build)


query("g1_g2_g6_oof_contract" + SUFFIX)(lambda ws: models.oof_contract(by_series(ws)))
query("g9_model_scores" + SUFFIX)(lambda ws: fold_scores(models._folds(by_series(ws))))
query("i7_i9_model_scores_on_cohort" + SUFFIX)(_model_scores)
query("i5_routing_summary_models" + SUFFIX)(lambda ws: intermittent.summarize_routing(_model_scores(ws)))
query("i10_fold_wins_models" + SUFFIX)(lambda ws: intermittent.fold_wins(_model_scores(ws)))


@query("i5_i10_routing_contract" + SUFFIX)
def routing_contract(ws: Workspace) -> DataFrame:
    """What must hold of the routing table: strategies, folds, the control beside them, eligibility by its own rule."""
    scores = intermittent.every_fold(_model_scores(ws), [*intermittent.METHODS, "two_stage", intermittent.CONTROL])
    summary, wins = intermittent.summarize_routing(scores), intermittent.fold_wins(scores)
    gain = F.col("rmsle_improvement_vs_global")
    return summary.join(wins.select("model", "fold_wins"), "model", "left").select(
        "model", "fold_count", (F.col("model") == intermittent.CONTROL).alias("is_control"),
        (F.col("routing_eligible").eqNullSafe(gain >= intermittent.MIN_IMPROVEMENT) | (F.col("model") == intermittent.CONTROL)).alias("eligible_by_rule"),
        F.coalesce(F.col("fold_wins").between(0, 4), F.col("model") == intermittent.CONTROL).alias("wins_in_range"))


@query("g8_strategy_comparison_models" + SUFFIX)
def strategy_comparison(ws: Workspace) -> DataFrame:
    """The global model per fold against the strongest baseline of the stored backtest."""
    space = by_series(ws)
    baseline = rolled._scores(space).filter(F.col("model") == rolled.SEGMENT_MODEL)
    return evaluate.compare_strategies(baseline, fold_scores(models._folds(space)))


query("g8_strategy_contract" + SUFFIX)(lambda ws: strategy_comparison(ws).select(
    "fold", "previous_rmsle", (F.col("current_minus_previous") == F.col("current_rmsle") - F.col("previous_rmsle")).alias("difference_holds")))
