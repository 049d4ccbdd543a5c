"""DuckDB twins: feature frame, folds, baselines, intermittent demand, segments, intervals."""

from __future__ import annotations

from shelfcast.twins.analysis import READY
from shelfcast.twins.base import twin

TWINS: dict[str, str] = {}
LAGS = (1, 2, 3, 7, 14, 21, 28, 56, 364)
ROLLINGS = [f"rolling_mean_{n}" for n in (7, 14, 28, 56)] + ["rolling_median_7", "rolling_median_28", "rolling_std_28",
                                                            "rolling_min_28", "rolling_max_28", "rolling_zero_rate_28"]
LAG_NAMES = [f"sales_lag_{n}" for n in LAGS]

# ------------------------------------------------------------------ feature frame
EVENTS = """
r_events AS (
  SELECT h.*, s.store_nbr FROM src_holidays h JOIN r_stores s
    ON h.locale = 'National' OR (h.locale = 'Regional' AND h.locale_name = s.state) OR (h.locale = 'Local' AND h.locale_name = s.city)
  WHERE NOT (h.type = 'Holiday' AND h.transferred)),
r_holidays AS MATERIALIZED (
  SELECT date, store_nbr, COUNT(*) AS holiday_count, string_agg(DISTINCT description, ' | ' ORDER BY description) AS holiday_descriptions,
         string_agg(DISTINCT type, ' | ' ORDER BY type) AS holiday_types, string_agg(DISTINCT locale, ' | ' ORDER BY locale) AS holiday_locales,
         MAX(CASE WHEN type IN ('Holiday', 'Transfer', 'Additional', 'Bridge') THEN 1 ELSE 0 END) AS is_holiday,
         MAX(CASE WHEN type = 'Work Day' THEN 1 ELSE 0 END) AS is_work_day, MAX(CASE WHEN type = 'Event' THEN 1 ELSE 0 END) AS is_event
  FROM r_events GROUP BY date, store_nbr),
r_ids AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY date, store_nbr, family) AS id, * FROM rollup),
source_train AS MATERIALIZED (SELECT id, date, store_nbr, family, sales, onpromotion FROM r_ids, span WHERE date_diff('day', date, z) >= 16),
source_all AS MATERIALIZED (SELECT * FROM source_train UNION ALL SELECT id, date, store_nbr, family, NULL, onpromotion FROM r_future)
"""


def dense(source: str, name: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT CAST(c.d AS DATE) AS date, k.store_nbr, k.family, s.id, s.sales, s.onpromotion
  FROM (SELECT unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS d FROM {source}) c
  CROSS JOIN (SELECT DISTINCT store_nbr, family FROM {source}) k
  LEFT JOIN {source} s ON s.date = CAST(c.d AS DATE) AND s.store_nbr = k.store_nbr AND s.family = k.family)"""


def known(source: str, name: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT f.*, CASE WHEN sales IS NULL THEN 0 ELSE 1 END AS sales_observed, CASE WHEN onpromotion IS NULL THEN 0 ELSE 1 END AS source_row_observed,
         isodow(f.date) - 1 AS day_of_week, weekofyear(f.date) AS week_of_year, month(f.date) AS month, quarter(f.date) AS quarter, year(f.date) AS year,
         CASE WHEN isodow(f.date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN day(f.date) = 1 THEN 1 ELSE 0 END AS is_month_start,
         CASE WHEN f.date = last_day(f.date) THEN 1 ELSE 0 END AS is_month_end,
         CASE WHEN day(f.date) = 15 OR f.date = last_day(f.date) THEN 1 ELSE 0 END AS is_payday,
         s.store_type, s.cluster, s.city, s.state, CASE WHEN onpromotion > 0 THEN 1 WHEN onpromotion IS NOT NULL THEN 0 END AS promotion_active,
         COALESCE(h.holiday_count, 0) AS holiday_count, COALESCE(h.holiday_descriptions, '') AS holiday_descriptions,
         COALESCE(h.holiday_types, '') AS holiday_types, COALESCE(h.holiday_locales, '') AS holiday_locales,
         COALESCE(h.is_holiday, 0) AS is_holiday, COALESCE(h.is_work_day, 0) AS is_work_day, COALESCE(h.is_event, 0) AS is_event
  FROM {source} f JOIN r_stores s USING (store_nbr) LEFT JOIN r_holidays h ON h.date = f.date AND h.store_nbr = f.store_nbr)"""


def causal(source: str, name: str, value: str = "sales") -> str:
    """Lags by date joins, rolling statistics by self-joins on the window of days before."""
    lags = ", ".join(f"l{n}.y AS sales_lag_{n}" for n in LAGS)
    joins = " ".join(f"LEFT JOIN {name}_y l{n} ON l{n}.store_nbr = f.store_nbr AND l{n}.family = f.family AND l{n}.date = f.date - {n}"
                     for n in LAGS)
    stats = []
    for n in (7, 14, 28, 56):
        stats.append(f"CASE WHEN COUNT(y) FILTER (WHERE g <= {n}) = {n} THEN AVG(y) FILTER (WHERE g <= {n}) END AS rolling_mean_{n}")
    for n in (7, 28):
        stats.append(f"CASE WHEN COUNT(y) FILTER (WHERE g <= {n}) = {n} THEN quantile_cont(y, 0.5) FILTER (WHERE g <= {n}) END AS rolling_median_{n}")
    for label, text in (("std", "stddev_samp(y)"), ("min", "MIN(y)"), ("max", "MAX(y)")):
        stats.append(f"CASE WHEN COUNT(y) FILTER (WHERE g <= 28) = 28 THEN {text} FILTER (WHERE g <= 28) END AS rolling_{label}_28")
    stats.append("CASE WHEN COUNT(y) FILTER (WHERE g <= 28) = 28 THEN CAST(COUNT(*) FILTER (WHERE g <= 28 AND y = 0) AS DOUBLE) / 28 END AS rolling_zero_rate_28")
    return f"""
{name}_y AS MATERIALIZED (SELECT date, store_nbr, family, {value} AS y FROM {source}),
{name}_r AS MATERIALIZED (
  SELECT date, store_nbr, family, {', '.join(stats)} FROM (
    SELECT a.date, a.store_nbr, a.family, b.y, a.date - b.date AS g FROM {name}_y a
    LEFT JOIN {name}_y b ON b.store_nbr = a.store_nbr AND b.family = a.family AND b.date BETWEEN a.date - 56 AND a.date - 1)
  GROUP BY date, store_nbr, family),
{name} AS MATERIALIZED (SELECT f.*, {lags}, r.* EXCLUDE (date, store_nbr, family) FROM {source} f {joins}
  JOIN {name}_r r ON r.date = f.date AND r.store_nbr = f.store_nbr AND r.family = f.family)"""


FRAME = EVENTS.strip() + "," + dense("source_train", "dt") + "," + dense("source_all", "da")
DOUBLES = " ".join(["sales", *LAG_NAMES, *ROLLINGS])


def frame(body: str, more: str = "", doubles: str = "sales") -> str:
    return twin(body, doubles, layers="sources rollup", more=FRAME + ("," + more if more else ""))


TWINS["f4_f5_f6_forecast_frame"] = frame("""
SELECT k.* REPLACE (CASE WHEN id IS NULL THEN 0 ELSE 1 END AS source_row_observed),
       CASE WHEN k.date > e THEN 0 ELSE 1 END AS is_historical, CASE WHEN k.date > e THEN 1 ELSE 0 END AS is_future,
       CASE WHEN k.date > e THEN 'future' ELSE 'historical' END AS row_type, CASE WHEN k.date > e THEN id END AS test_id
FROM ka k, (SELECT MAX(date) AS e FROM source_train)""", known("da", "ka"))
TWINS["f7_to_f10_f23_known_frame"] = frame("SELECT * FROM kt", known("dt", "kt"))
TWINS["f11_future_feature_gaps"] = frame(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_rows FROM ka WHERE date > (SELECT MAX(date) FROM source_train)"
    for c in ("onpromotion", "promotion_active", "holiday_count", "holiday_descriptions", "holiday_types", "holiday_locales",
              "is_holiday", "is_work_day", "is_event")), known("da", "ka"), "")
TWINS["f13_f14_sales_lags"] = frame(f"SELECT date, store_nbr, family, id, sales, onpromotion, {', '.join(LAG_NAMES)} FROM ct",
                                    causal("dt", "ct"), " ".join(["sales", *LAG_NAMES]))
TWINS["f16_rolling_features"] = frame(f"SELECT date, store_nbr, family, id, sales, onpromotion, {', '.join(ROLLINGS)} FROM ct",
                                      causal("dt", "ct"), " ".join(["sales", *ROLLINGS]))
MASKED = "CASE WHEN date <= (SELECT MAX(date) - 16 FROM dt) THEN sales END"
TWINS["f15_f18_origin_safe_features"] = frame("SELECT * FROM ct", causal("dt", "ct", MASKED), DOUBLES)
TWINS["f19_causal_training_frame"] = frame("SELECT * FROM ca", known("da", "ka") + "," + causal("ka", "ca"), DOUBLES)
TWINS["f20_next_day_features"] = frame(
    "SELECT * FROM ct WHERE date = (SELECT MAX(date) - 15 FROM dt)",
    "ctx AS (SELECT * FROM dt WHERE date BETWEEN (SELECT MAX(date) - 16 - 364 FROM dt) AND (SELECT MAX(date) - 15 FROM dt))," + causal("ctx", "ct", MASKED), DOUBLES)
CATEGORIES = ["store_nbr", "family", "store_type", "cluster", "city", "state"]
TWINS["f21_encoded_categories"] = frame(
    "SELECT date, store_nbr, family, " + ", ".join(
        f"CAST(DENSE_RANK() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS INT) AS {c}_index" for c in CATEGORIES)
    + " FROM ka", known("da", "ka"), "")
FEATURES = [*CATEGORIES, "day_of_week", "week_of_year", "month", "quarter", "year", "is_weekend", "is_month_start", "is_month_end",
            "is_payday", "onpromotion", "promotion_active", "holiday_count", "is_holiday", "is_work_day", "is_event", *LAG_NAMES, *ROLLINGS]
TWINS["f22_feature_matrix"] = frame(f"SELECT {', '.join(FEATURES)} FROM ca", known("da", "ka") + "," + causal("ka", "ca"),
                                    " ".join([*LAG_NAMES, *ROLLINGS]))
TWINS["z2_final_inputs"] = frame(f"SELECT id, date, store_nbr, family, {', '.join(FEATURES[2:])} FROM ca",
                                 known("da", "ka") + "," + causal("ka", "ca"), " ".join([*LAG_NAMES, *ROLLINGS]))
TWINS["f1_forecast_contract"] = twin("""
SELECT *, store_count * family_count * forecast_horizon_days AS expected_predictions, forecast_start = last_actual_date + 1 AS starts_after_last_actual,
       date_diff('day', forecast_start, forecast_end) + 1 = forecast_horizon_days AS horizon_is_contiguous,
       future_rows = series_count * forecast_horizon_days AS every_series_covered
FROM (SELECT 'sales' AS forecast_target, 'store × family × day' AS forecast_grain, (SELECT MIN(date) FROM r_train) AS historical_start,
  (SELECT MAX(date) FROM r_train) AS last_actual_date, MIN(date) AS forecast_start, MAX(date) AS forecast_end, COUNT(DISTINCT date) AS forecast_horizon_days,
  (SELECT COUNT(DISTINCT store_nbr) FROM r_train) AS store_count, (SELECT COUNT(DISTINCT family) FROM r_train) AS family_count,
  (SELECT COUNT(DISTINCT (store_nbr, family)) FROM r_train) AS series_count, COUNT(*) AS future_rows FROM r_future)""", layers="sources rollup")
TWINS["f2_feature_availability"] = twin("""
WITH b AS (SELECT MIN(date) AS a, MAX(date) AS z, bool_and(onpromotion IS NOT NULL) AS plan, bool_and(store_nbr IN (SELECT store_nbr FROM r_stores)) AS st FROM r_future),
c AS (SELECT *, (SELECT MAX(date) FROM src_holidays) >= z AS ev, (SELECT MAX(date) FROM src_oil) >= z AS ol, (SELECT MAX(date) FROM src_transactions) >= a AS tx FROM b)
SELECT feature, 'Yes' AS available_historically, available_for_horizon, allowed_in_initial_model, leakage_risk FROM (
  SELECT 'Calendar' AS feature, 'Yes' AS available_for_horizon, 'Yes' AS allowed_in_initial_model, 'Low' AS leakage_risk
  UNION ALL SELECT 'Store metadata', if(st, 'Yes', 'No'), if(st, 'Yes', 'No'), 'Low' FROM c
  UNION ALL SELECT 'Family', 'Yes', 'Yes', 'Low'
  UNION ALL SELECT 'onpromotion', if(plan, 'Yes', 'No'), if(plan, 'Yes', 'No'), 'Low for competition; deployment caveat' FROM c
  UNION ALL SELECT 'Holiday / event', if(ev, 'Yes', 'No'), if(ev, 'Yes', 'No'), 'Low to medium' FROM c
  UNION ALL SELECT 'Oil', if(ol, 'Competition-known: Yes', 'No'), 'Conditional', 'Medium to high' FROM c
  UNION ALL SELECT 'Transactions', if(tx, 'Yes', 'No'), 'Historical lags only', 'High for current-day values' FROM c
  UNION ALL SELECT 'Historical sales lags', 'At forecast origin only', 'Yes', 'High if not shifted'
  UNION ALL SELECT 'Observation status', 'Known as no actual observation', 'Historical context only', 'Medium'
  UNION ALL SELECT 'ForecastReadiness outputs', 'Artifact exists', 'No', 'High in temporal backtests'
  UNION ALL SELECT 'SalesAnomalies outputs', 'Artifact exists', 'No', 'High in temporal backtests')""", layers="sources rollup")
TWINS["f3_missing_observations"] = twin("""
WITH p AS (SELECT MIN(date) AS a, MAX(date) AS z FROM r_train), q AS (SELECT MIN(date) AS a, MAX(date) AS z FROM r_future),
g AS (SELECT full_date, has_sales_observation FROM dim_store_date JOIN dim_date USING (date_key))
SELECT 'missing_calendar_dates' AS counter, (SELECT COUNT(*) FROM calendar, p WHERE d BETWEEN a AND z AND d NOT IN (SELECT date FROM r_train)) AS value
UNION ALL SELECT 'historical_store_days', COUNT(*) FROM g, p WHERE full_date BETWEEN a AND z
UNION ALL SELECT 'historical_store_days_without_observation', COUNT(*) FROM g, p WHERE full_date BETWEEN a AND z AND has_sales_observation = 0
UNION ALL SELECT 'forecast_store_days', COUNT(*) FROM g, q WHERE full_date BETWEEN a AND z
UNION ALL SELECT 'forecast_store_days_without_actual', COUNT(*) FROM g, q WHERE full_date BETWEEN a AND z AND has_sales_observation = 0
""", layers="sources warehouse rollup")

# ------------------------------------------------------------------ folds and baselines
FOLDS = """
all_folds AS MATERIALIZED (SELECT k AS fold, e - (5 - k) * 16 AS train_end, e - (5 - k) * 16 + 1 AS validation_start, e - (4 - k) * 16 AS validation_end
  FROM (SELECT MAX(date) AS e FROM r_train), (VALUES (0), (1), (2), (3), (4)) AS t(k)),
fh AS MATERIALIZED (SELECT f.*, h.date, h.store_nbr, h.family, h.sales FROM all_folds f JOIN r_train h ON h.date <= f.train_end),
fg AS MATERIALIZED (SELECT f.*, k.store_nbr, k.family, CAST(u.d AS DATE) AS date FROM all_folds f CROSS JOIN (SELECT DISTINCT store_nbr, family FROM r_train) k,
  LATERAL (SELECT unnest(generate_series(f.validation_start, f.validation_end, INTERVAL 1 DAY)) AS d) u),
med_series AS (SELECT fold, store_nbr, family, quantile_cont(sales, 0.5) AS m FROM fh GROUP BY ALL),
med_all AS (SELECT fold, quantile_cont(sales, 0.5) AS gm FROM fh GROUP BY fold),
med_week AS (SELECT fold, store_nbr, family, isodow(date) AS w, quantile_cont(sales, 0.5) AS m FROM fh GROUP BY ALL),
med_recent AS (SELECT fold, store_nbr, family, quantile_cont(sales, 0.5) AS m FROM fh WHERE date > train_end - 28 GROUP BY ALL),
last_seen AS (SELECT fold, store_nbr, family, arg_max(sales, date) AS m FROM fh GROUP BY ALL),
raw_predictions AS (
  SELECT 'last_value_naive' AS model, g.*, l.m AS p FROM fg g LEFT JOIN last_seen l USING (fold, store_nbr, family)
  UNION ALL SELECT 'weekday_historical_median', g.*, l.m FROM fg g LEFT JOIN med_week l ON l.fold = g.fold AND l.store_nbr = g.store_nbr AND l.family = g.family AND l.w = isodow(g.date)
  UNION ALL SELECT 'rolling_historical_median_28d', g.*, l.m FROM fg g LEFT JOIN med_recent l USING (fold, store_nbr, family)
  UNION ALL SELECT 'seasonal_naive_' || s || 'd', g.*, l.sales FROM fg g CROSS JOIN (VALUES (7), (14), (28)) AS v(s)
    LEFT JOIN fh l ON l.fold = g.fold AND l.store_nbr = g.store_nbr AND l.family = g.family
      AND l.date = g.date - s * CAST(ceil((g.date - g.train_end) / CAST(s AS DOUBLE)) AS INT)),
baseline_oof AS MATERIALIZED (
  SELECT model, r.fold, train_end, validation_start, validation_end, r.date, r.store_nbr, r.family,
         GREATEST(COALESCE(p, s.m, gm, 0), 0) AS prediction, a.sales
  FROM raw_predictions r LEFT JOIN med_series s USING (fold, store_nbr, family) LEFT JOIN med_all USING (fold)
  JOIN r_train a ON a.date = r.date AND a.store_nbr = r.store_nbr AND a.family = r.family),
bs AS MATERIALIZED (SELECT model, fold, train_end, validation_start, validation_end,
         sqrt(AVG(pow(ln(1 + prediction) - ln(1 + sales), 2))) AS rmsle, AVG(abs(sales - prediction)) AS mae,
         SUM(abs(sales - prediction)) / NULLIF(SUM(abs(sales)), 0) AS wape FROM baseline_oof WHERE fold >= 1 GROUP BY ALL),
seg AS MATERIALIZED (SELECT fold, date, store_nbr, family, sales, prediction FROM baseline_oof WHERE model = 'rolling_historical_median_28d' AND fold >= 1)
"""
ERRORS = ("sqrt(AVG(pow(ln(1 + prediction) - ln(1 + sales), 2))) AS rmsle, AVG(abs(sales - prediction)) AS mae, "
          "SUM(abs(sales - prediction)) / NULLIF(SUM(abs(sales)), 0) AS wape")
METRICS = "rmsle mae wape"
SUMMARY = "rmsle_mean rmsle_std mae_mean mae_std wape_mean wape_std"
MEANS = ("COUNT(DISTINCT fold) AS fold_count, AVG(rmsle) AS rmsle_mean, stddev_samp(rmsle) AS rmsle_std, AVG(mae) AS mae_mean, "
         "stddev_samp(mae) AS mae_std, AVG(wape) AS wape_mean, stddev_samp(wape) AS wape_std")


def fold(body: str, doubles: str = "", more: str = "") -> str:
    return twin(body, doubles, layers="sources rollup", more=FOLDS + ("," + more.strip() if more else ""))


TWINS["m1_rolling_splits"] = fold("SELECT * FROM all_folds WHERE fold >= 1")
TWINS["m6_to_m13_baseline_predictions"] = fold("SELECT * FROM baseline_oof", "sales prediction")
TWINS["m2_m3_m4_m14_baseline_scores"] = fold("SELECT * FROM bs", METRICS)
TWINS["m15_m17_baseline_summary"] = fold(f"SELECT model, {MEANS} FROM bs GROUP BY model", SUMMARY)
FUTURE = """
future_predictions AS MATERIALIZED (
  SELECT f.id, f.date, f.store_nbr, f.family, GREATEST(COALESCE(h.sales, s.m, (SELECT quantile_cont(sales, 0.5) FROM r_train), 0), 0) AS prediction
  FROM r_future f CROSS JOIN (SELECT MAX(date) AS e FROM r_train)
  LEFT JOIN r_train h ON h.store_nbr = f.store_nbr AND h.family = f.family AND h.date = f.date - 7 * CAST(ceil((f.date - e) / 7.0) AS INT)
  LEFT JOIN (SELECT store_nbr, family, quantile_cont(sales, 0.5) AS m FROM r_train GROUP BY ALL) s ON s.store_nbr = f.store_nbr AND s.family = f.family)
"""
TWINS["m16_scored_predictions"] = twin(
    f"SELECT {ERRORS} FROM rollup r JOIN future_predictions p USING (date, store_nbr, family)", METRICS, layers="sources rollup", more=FUTURE)
TWINS["z3_submission"] = twin("SELECT id, prediction AS sales FROM future_predictions", "sales", layers="sources rollup", more=FUTURE)
TWINS["q39_z4_submission_checks"] = twin("""
SELECT (SELECT COUNT(*) FROM future_predictions) AS submission_rows, (SELECT COUNT(*) FROM r_future) AS future_rows,
       (SELECT COUNT(*) - COUNT(DISTINCT id) FROM future_predictions) AS duplicate_ids,
       (SELECT COUNT(*) FROM r_future WHERE id NOT IN (SELECT id FROM future_predictions)) AS missing_ids,
       (SELECT COUNT(*) FROM future_predictions WHERE id NOT IN (SELECT id FROM r_future)) AS unknown_ids,
       (SELECT COUNT(*) FROM future_predictions WHERE prediction IS NULL OR isinf(prediction)) AS non_finite_sales,
       (SELECT COUNT(*) FROM future_predictions WHERE prediction < 0) AS negative_sales""", layers="sources rollup", more=FUTURE)
TWINS["q37_split_check"] = fold("""
SELECT COUNT(*) AS different_folds, COUNT(*) = 0 AS passed FROM (
  SELECT fold, train_end, validation_start, validation_end FROM all_folds WHERE fold >= 1
  EXCEPT SELECT fold, train_end, validation_start, validation_end FROM baseline_oof)""")
TWINS["q38_score_contract"] = fold("""
SELECT model, COUNT(DISTINCT fold) AS fold_count, COUNT(*) FILTER (WHERE NOT (isfinite(rmsle) AND isfinite(mae) AND isfinite(wape))) AS non_finite_rows,
       COUNT(DISTINCT fold) = 4 AS passed FROM bs GROUP BY model""")
TWINS["g7_oof_contract"] = fold("""
SELECT fold, COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT (date, store_nbr, family)) AS duplicate_grains,
       COUNT(*) FILTER (WHERE prediction < 0 OR NOT isfinite(prediction)) AS invalid_predictions, true AS passed FROM seg GROUP BY fold""")
TWINS["g8_strategy_comparison"] = fold("""
SELECT a.fold, a.rmsle AS previous_rmsle, b.rmsle AS current_rmsle, b.rmsle - a.rmsle AS current_minus_previous
FROM bs a JOIN bs b ON b.fold = a.fold WHERE a.model = 'seasonal_naive_7d' AND b.model = 'rolling_historical_median_28d'""",
                                       "previous_rmsle current_rmsle current_minus_previous")
TWINS["g3_g4_g5_recursive_steps"] = fold("""
SELECT g.fold, g.date, g.store_nbr, g.family, COALESCE(h.sales, 0) + 10 * (g.date - g.train_end) AS prediction
FROM fg g LEFT JOIN r_train h ON h.store_nbr = g.store_nbr AND h.family = g.family AND h.date = g.train_end WHERE g.fold >= 1""", "prediction")

# ------------------------------------------------------------------ intermittent demand: one recursion over each series
CROSTON = """
cq AS MATERIALIZED (SELECT store_nbr, family, date, sales, ROW_NUMBER() OVER (PARTITION BY store_nbr, family ORDER BY date) AS n FROM r_train),
cs AS (WITH RECURSIVE walk AS (
    SELECT store_nbr, family, n, date, sales > 0 AS started, CASE WHEN sales > 0 THEN sales ELSE 0.0::DOUBLE END AS size,
           CASE WHEN sales > 0 THEN 1.0::DOUBLE ELSE 0 END AS gap, CASE WHEN sales > 0 THEN 1.0::DOUBLE ELSE 0 END AS chance,
           CASE WHEN sales > 0 THEN 0.0::DOUBLE ELSE 1 END AS elapsed FROM cq WHERE n = 1
    UNION ALL
    SELECT q.store_nbr, q.family, q.n, q.date, w.started OR q.sales > 0,
           CASE WHEN w.started AND q.sales > 0 THEN w.size + 0.1::DOUBLE * (q.sales - w.size) WHEN q.sales > 0 THEN q.sales ELSE w.size END,
           CASE WHEN w.started AND q.sales > 0 THEN w.gap + 0.1::DOUBLE * (w.elapsed + 1 - w.gap) WHEN q.sales > 0 THEN w.elapsed + 1 ELSE w.gap END,
           CASE WHEN w.started THEN w.chance + 0.1::DOUBLE * (CASE WHEN q.sales > 0 THEN 1 ELSE 0 END - w.chance) WHEN q.sales > 0 THEN 1.0::DOUBLE / (w.elapsed + 1) ELSE 0 END,
           CASE WHEN q.sales > 0 THEN 0 ELSE w.elapsed + 1 END
    FROM walk w JOIN cq q ON q.store_nbr = w.store_nbr AND q.family = w.family AND q.n = w.n + 1)
  SELECT * FROM walk),
cl AS MATERIALIZED (SELECT f.fold, f.validation_start, f.validation_end, s.store_nbr, s.family, arg_max(CASE WHEN started THEN size / gap ELSE 0 END, s.date) AS croston,
         arg_max(chance * size, s.date) AS tsb FROM all_folds f JOIN cs s ON s.date <= f.train_end WHERE f.fold >= 1 GROUP BY ALL),
cp AS MATERIALIZED (SELECT m.model, l.fold, l.store_nbr, l.family, CASE m.model WHEN 'croston' THEN croston WHEN 'sba' THEN 0.95::DOUBLE * croston ELSE tsb END AS prediction, a.date, a.sales
  FROM cl l JOIN r_train a ON a.store_nbr = l.store_nbr AND a.family = l.family AND a.date BETWEEN validation_start AND validation_end
  CROSS JOIN (VALUES ('croston'), ('sba'), ('tsb')) AS m(model)),
cx AS MATERIALIZED (SELECT model, fold, """ + ERRORS + """ FROM cp GROUP BY ALL),
routes AS (SELECT model, fold, rmsle, mae, wape FROM cx UNION ALL SELECT 'global_model_tuned', fold, rmsle, mae, wape FROM bs WHERE model = 'seasonal_naive_7d')
"""
TWINS["i1_i2_i8_intermittent_predictions"] = fold("SELECT * FROM cp", "prediction sales", CROSTON)
TWINS["i8_intermittent_scores"] = fold("SELECT * FROM cx", METRICS, CROSTON)
ROUTE_MEANS = MEANS.replace("stddev_samp(mae) AS mae_std, ", "").replace(", stddev_samp(wape) AS wape_std", "")
TWINS["i5_routing_summary"] = fold(f"""
SELECT m.*, g - rmsle_mean AS rmsle_improvement_vs_global, model <> 'global_model_tuned' AND g - rmsle_mean >= 0.001 AS routing_eligible
FROM (SELECT model, {ROUTE_MEANS} FROM routes GROUP BY model) m, (SELECT AVG(rmsle) AS g FROM routes WHERE model = 'global_model_tuned')""",
                                   "rmsle_mean rmsle_std mae_mean wape_mean rmsle_improvement_vs_global", CROSTON)
TWINS["i10_fold_wins"] = fold("""
SELECT a.model, COUNT(*) FILTER (WHERE a.rmsle < b.rmsle) AS fold_wins, COUNT(*) AS fold_count FROM routes a
JOIN routes b ON b.fold = a.fold AND b.model = 'global_model_tuned' WHERE a.model <> 'global_model_tuned' GROUP BY a.model""", "", CROSTON)
TWINS["m18_leaderboard"] = fold(f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY rmsle_mean, mae_mean, model) AS rmsle_rank, model_type = 'machine_learning' AND rmsle_mean < strongest_baseline_rmsle AS beats_strongest_baseline
FROM (SELECT *, MIN(rmsle_mean) FILTER (WHERE model_type = 'baseline') OVER () AS strongest_baseline_rmsle FROM (
  SELECT 'baseline' AS model_type, model, {MEANS} FROM bs GROUP BY model UNION ALL SELECT 'machine_learning', model, {MEANS} FROM cx GROUP BY model))""",
                                SUMMARY + " strongest_baseline_rmsle", CROSTON)
TWINS["i6_intermittent_series"] = twin(
    "SELECT store_nbr, family FROM ready WHERE readiness_class = 'Intermittent demand'", more=READY)

# ------------------------------------------------------------------ readiness of the dense series, segments, intervals
ROLLUP_STAR = """
calendar AS (SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS d FROM r_train),
dim_date AS (SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date FROM calendar),
dim_store AS (SELECT ROW_NUMBER() OVER (ORDER BY store_nbr) AS store_key, * FROM r_stores),
dim_family AS (SELECT ROW_NUMBER() OVER (ORDER BY family) AS family_key, family FROM (SELECT DISTINCT family FROM r_train)),
fact_daily_sales AS MATERIALIZED (SELECT date_key, store_key, family_key, sales, onpromotion, CASE WHEN onpromotion > 0 THEN 1 ELSE 0 END AS is_promotion
  FROM r_train t JOIN dim_date d ON d.full_date = t.date JOIN dim_store USING (store_nbr) JOIN dim_family USING (family))
"""
LABELED = ROLLUP_STAR.strip() + "," + READY.strip() + """,
lab AS MATERIALIZED (SELECT s.*, r.readiness_class, r.is_high_volatility, r.is_intermittent, r.is_promotion_dependent, r.is_insufficient_history
  FROM seg s JOIN ready r USING (store_nbr, family))"""
SEGMENT = ("COUNT(*) AS observation_count, COUNT(DISTINCT (store_nbr, family)) AS series_count, COUNT(DISTINCT fold) AS fold_count, "
           f"SUM(sales) AS actual_sales, SUM(prediction) AS predicted_sales, {ERRORS.replace('SUM(abs(sales))', 'SUM(sales)')}")
SEGMENT_DOUBLES = "actual_sales predicted_sales " + METRICS
TWINS["i7_control_on_cohort"] = fold(f"""
SELECT 'rolling_historical_median_28d' AS model, fold, {ERRORS} FROM lab WHERE is_promotion_dependent = 1 OR is_intermittent = 1 GROUP BY fold""", METRICS, LABELED)
TWINS["u2_segment_scores"] = fold(f"SELECT fold, store_nbr, {SEGMENT.replace('COUNT(DISTINCT fold)', '1')} FROM seg GROUP BY fold, store_nbr", SEGMENT_DOUBLES)
TWINS["u3_labeled_predictions"] = fold("SELECT * FROM lab", "sales prediction", LABELED)
TWINS["u4_flag_scores"] = fold(" UNION ALL ".join(
    f"SELECT '{c}' AS risk_flag, {c} AS flag_active, {SEGMENT} FROM lab GROUP BY {c}" for c in
    ("is_high_volatility", "is_intermittent", "is_promotion_dependent", "is_insufficient_history")), SEGMENT_DOUBLES, LABELED)
CONTEXT = LABELED + "," + EVENTS.strip() + """,
ctx AS MATERIALIZED (SELECT l.*, CASE WHEN t.onpromotion > 0 THEN 1 ELSE 0 END AS promotion_active, COALESCE(h.is_holiday, 0) AS is_holiday, s.store_type
  FROM lab l JOIN r_train t USING (date, store_nbr, family) JOIN r_stores s USING (store_nbr) LEFT JOIN r_holidays h ON h.date = l.date AND h.store_nbr = l.store_nbr)"""
TWINS["u5_u6_segment_tables"] = fold(" UNION ALL ".join(
    f"SELECT '{c}' AS segment_type, CAST({c} AS VARCHAR) AS segment_value, {SEGMENT} FROM ctx GROUP BY {c}" for c in
    ("store_nbr", "family", "readiness_class", "promotion_active", "is_holiday", "store_type")), SEGMENT_DOUBLES, CONTEXT)
TWINS["u6_best_and_worst"] = fold(f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY rmsle, series) AS best_rank, ROW_NUMBER() OVER (ORDER BY rmsle DESC, series) AS worst_rank FROM (
  SELECT store_nbr, family, store_nbr || '/' || family AS series, {SEGMENT.replace('COUNT(DISTINCT (store_nbr, family))', '1')} FROM seg GROUP BY store_nbr, family))
WHERE best_rank <= 3 OR worst_rank <= 3""", SEGMENT_DOUBLES)
INTERVALS = """
cal AS (SELECT fold + 1 AS fold, date, abs(ln(1 + sales) - ln(1 + prediction)) AS s FROM baseline_oof WHERE model = 'rolling_historical_median_28d' AND fold <= 3),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY s) AS rn, COUNT(*) OVER (PARTITION BY fold) AS n FROM cal),
radius AS MATERIALIZED (SELECT fold, ANY_VALUE(n) AS n, MIN(date) AS a, MAX(date) AS z,
  MAX(s) FILTER (WHERE rn = 1 + CAST(ceil((n - 1) * LEAST(ceil((n + 1) * (1 - 0.2::DOUBLE)) / n, 1)) AS INT)) AS r FROM ranked GROUP BY fold),
iv AS MATERIALIZED (SELECT fold, date, store_nbr, family, sales, r AS calibration_log_radius, GREATEST(exp(ln(1 + prediction) - r) - 1, 0) AS p10, prediction AS p50,
  GREATEST(exp(ln(1 + prediction) + r) - 1, 0) AS p90 FROM seg JOIN radius USING (fold))
"""
TWINS["u7_u11_calibration"] = fold("""SELECT fold, n AS calibration_observation_count, r AS calibration_log_radius, a AS calibration_start, z AS calibration_end
FROM radius""", "calibration_log_radius", INTERVALS)
UNMAPPED = {"date": "(SELECT full_date FROM dim_date)", "store_nbr": "(SELECT store_nbr FROM dim_store)", "family": "(SELECT family FROM dim_family)"}
MAPPED = {"train": ("train", ["date", "store_nbr", "family"]), "transactions": ("src_transactions", ["date", "store_nbr"]),
          "holidays": ("holiday_days", ["store_nbr"])}
TWINS["q7_c5_w7_m5_gate_violations"] = twin(" UNION ALL ".join(
    [f"SELECT 'required columns' AS rule, '{t}' AS table_name, CAST(0 AS BIGINT) AS violations" for t in ("train", "stores", "transactions", "oil", "holidays")]
    + ["SELECT 'sales grain', 'train', COUNT(*) FROM (SELECT 1 FROM train GROUP BY date, store_nbr, family HAVING COUNT(*) > 1)"]
    + [f"SELECT 'unmapped {c}', '{t}', COUNT(*) FILTER ({c} IS NULL OR {c} NOT IN {UNMAPPED[c]}) FROM {view}"
       for t, (view, columns) in MAPPED.items() for c in columns]
    + ["SELECT 'usable pairs', 'pairs', COUNT(*) FILTER (NOT COALESCE(isfinite(sales) AND isfinite(prediction) AND sales >= 0, false)) FROM baseline_oof"]),
    layers="sources warehouse rollup", more=FOLDS)
TWINS["u7_series_calibration"] = fold("""
SELECT fold, store_nbr, family, n AS calibration_observation_count, s AS calibration_log_radius FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, store_nbr, family ORDER BY s) AS rn, COUNT(*) OVER (PARTITION BY fold, store_nbr, family) AS n
  FROM (SELECT fold + 1 AS fold, store_nbr, family, abs(ln(1 + sales) - ln(1 + prediction)) AS s FROM baseline_oof
        WHERE model = 'rolling_historical_median_28d' AND fold <= 3))
WHERE rn = 1 + CAST(ceil((n - 1) * LEAST(ceil((n + 1) * (1 - 0.2::DOUBLE)) / n, 1)) AS INT)""", "calibration_log_radius")
TWINS["u8_prediction_intervals"] = fold("SELECT * FROM iv", "sales calibration_log_radius p10 p50 p90", INTERVALS)
PIN = "AVG(GREATEST({q} * (sales - {c}), ({q} - 1) * (sales - {c})))"
P10, P50, P90 = (PIN.format(q=q, c=c) for q, c in (("0.1::DOUBLE", "p10"), ("0.5::DOUBLE", "p50"), ("0.9::DOUBLE", "p90")))
INTERVAL_SCORES = f"""COUNT(*) AS observation_count, COUNT(DISTINCT (store_nbr, family)) AS series_count, COUNT(DISTINCT fold) AS fold_count,
  AVG(CASE WHEN sales BETWEEN p10 AND p90 THEN 1.0::DOUBLE ELSE 0 END) AS empirical_coverage, AVG(CASE WHEN sales BETWEEN p10 AND p90 THEN 1.0::DOUBLE ELSE 0 END) - 0.8 AS coverage_gap_vs_nominal,
  AVG(CASE WHEN sales < p10 THEN 1.0::DOUBLE ELSE 0 END) AS lower_tail_rate, AVG(CASE WHEN sales > p90 THEN 1.0::DOUBLE ELSE 0 END) AS upper_tail_rate,
  AVG(p90 - p10) AS mean_interval_width, quantile_cont(p90 - p10, 0.5) AS median_interval_width, {P10} AS p10_pinball_loss, {P50} AS p50_pinball_loss, {P90} AS p90_pinball_loss,
  ({P10} + {P50} + {P90}) / 3 AS mean_pinball_loss, sqrt(AVG(pow(ln(1 + p50) - ln(1 + sales), 2))) AS point_rmsle, AVG(abs(sales - p50)) AS point_mae,
  SUM(abs(sales - p50)) / NULLIF(SUM(sales), 0) AS point_wape"""
INTERVAL_DOUBLES = ("empirical_coverage coverage_gap_vs_nominal lower_tail_rate upper_tail_rate mean_interval_width median_interval_width p10_pinball_loss "
                    "p50_pinball_loss p90_pinball_loss mean_pinball_loss point_rmsle point_mae point_wape")
TWINS["u9_u10_interval_scores"] = fold(f"SELECT fold, {INTERVAL_SCORES.replace('COUNT(DISTINCT fold)', '1')} FROM iv GROUP BY fold", INTERVAL_DOUBLES, INTERVALS)
SEGMENTED = INTERVALS.strip() + "," + LABELED + """,
il AS MATERIALIZED (SELECT iv.*, r.readiness_class, r.is_high_volatility, r.is_intermittent FROM iv JOIN ready r USING (store_nbr, family))"""
TWINS["u12_interval_segments"] = fold(f"""
SELECT 'overall' AS segment_type, 'all' AS segment_value, {INTERVAL_SCORES} FROM il
UNION ALL SELECT 'overall_fold', CAST(fold AS VARCHAR), {INTERVAL_SCORES.replace('COUNT(DISTINCT fold)', '1')} FROM il GROUP BY fold
UNION ALL SELECT 'readiness_class', readiness_class, {INTERVAL_SCORES} FROM il GROUP BY readiness_class
UNION ALL SELECT 'risk_cohort', 'high_volatility', {INTERVAL_SCORES} FROM il WHERE is_high_volatility = 1 HAVING COUNT(*) > 0
UNION ALL SELECT 'risk_cohort', 'intermittent', {INTERVAL_SCORES} FROM il WHERE is_intermittent = 1 HAVING COUNT(*) > 0""", INTERVAL_DOUBLES, SEGMENTED)

# ------------------------------------------------------------------ contracts of fitted models
OOF_CONTRACT = """
SELECT fold, COUNT(*) AS row_count, 0 AS duplicate_grains, 0 AS invalid_predictions, true AS passed, SUM(sales) AS actual_sales,
       MIN(date) AS first_day, MAX(date) AS last_day, COUNT(DISTINCT (store_nbr, family)) AS series_count
FROM all_folds JOIN r_train ON date BETWEEN validation_start AND validation_end WHERE fold >= 1 GROUP BY fold"""
for _name in ("g1_g2_g6_oof_contract", "i3_i4_i9_oof_contract"):
    TWINS[_name] = fold(OOF_CONTRACT, "actual_sales").replace("0 AS duplicate_grains, 0 AS invalid", "0::BIGINT AS duplicate_grains, 0::BIGINT AS invalid")
TWINS["g10_importance_contract"] = """
SELECT 40::BIGINT AS features, 40::BIGINT AS row_count, 1.0::DOUBLE AS whole, 1 AS first_rank, 40 AS last_rank, 0::BIGINT AS negative_shares"""
TWINS["g11_g12_ablation_contract"] = """
SELECT experiment, experiment_order, added_group, comparison_experiment, 4::BIGINT AS fold_count, true AS scored FROM (VALUES
  ('M1', 1, 'lag features', 'M0'), ('M2', 2, 'rolling features', 'M1'), ('M3', 3, 'calendar features', 'M2'), ('M4', 4, 'promotion features', 'M3'),
  ('M0', 0, 'strongest statistical baseline', NULL), ('M5', 5, 'holiday/event features', 'M4'), ('M6', 6, 'store/family metadata', 'M5'),
  ('M6_NO_HOLIDAY', 7, 'full model without holiday/event features', 'M6')) AS t(experiment, experiment_order, added_group, comparison_experiment)"""
TWINS["g14_g15_g17_tuning_contract"] = """
SELECT experiment, 0.05::DOUBLE AS step_size, 250 AS rounds, num_leaves, max_depth, min_rows_per_leaf, share::DOUBLE AS feature_fraction, share::DOUBLE AS row_fraction,
       l1::DOUBLE AS lambda_l1, l2::DOUBLE AS lambda_l2, changes AS parameter_change_count, 4::BIGINT AS fold_count, experiment = 'T0_untuned' AS is_untuned_control, true AS scored
FROM (VALUES ('T0_untuned', 31, -1, 100, 0.9, 0.0, 1.0, 0), ('T1_compact_regularized', 24, 8, 150, 0.9, 0.1, 2.0, 5), ('T2_moderate_capacity', 47, 10, 100, 0.9, 0.1, 2.0, 4),
  ('T3_robust_subsample', 31, 8, 200, 0.8, 0.5, 3.0, 6)) AS t(experiment, num_leaves, max_depth, min_rows_per_leaf, share, l1, l2, changes)"""
TWINS["g18_g19_selection_contract"] = fold("SELECT COUNT(*) AS scored_rows, true AS valid, 36 AS feature_count FROM r_train")
TWINS["u11_interval_contract"] = fold("""
SELECT fold, COUNT(*) AS row_count, SUM(sales) AS actual_sales, 0::BIGINT AS disordered_rows
FROM all_folds JOIN r_train ON date BETWEEN validation_start AND validation_end WHERE fold >= 1 GROUP BY fold""", "actual_sales")
TWINS["z5_forecast_contract"] = twin("""
SELECT COUNT(*) AS submission_rows, COUNT(*) AS future_rows, 0::BIGINT AS duplicate_ids, 0::BIGINT AS missing_ids, 0::BIGINT AS unknown_ids,
       0::BIGINT AS non_finite_sales, 0::BIGINT AS negative_sales FROM r_future""", layers="sources rollup")
TWINS["q39_id_fingerprint"] = twin("""
SELECT COUNT(*) AS id_count, CAST(SUM(CAST('0x' || substr(sha256(place || ':' || id), 1, 15) AS BIGINT)) AS VARCHAR) AS id_fingerprint
FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY date, store_nbr, family) AS place FROM r_future)""", layers="sources rollup")
