"""DuckDB twins: trend, stores, families, promotions, holidays, transactions, anomalies, readiness."""

from __future__ import annotations

from shelfcast.twins.base import twin

TWINS: dict[str, str] = {}

# ------------------------------------------------------------------ trend
DAILY = """
daily AS MATERIALIZED (
  SELECT d.* EXCLUDE (full_date), d.full_date AS date, s.total_sales,
         CASE WHEN s.total_sales IS NULL THEN 0 ELSE 1 END AS has_sales_observation,
         AVG(s.total_sales) OVER (ORDER BY d.full_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sales_ma_7,
         AVG(s.total_sales) OVER (ORDER BY d.full_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS sales_ma_28
  FROM dim_date d LEFT JOIN (SELECT date_key, SUM(sales) AS total_sales FROM fact_daily_sales GROUP BY 1) s USING (date_key)),
last_day_seen AS (SELECT MAX(date) AS e FROM daily WHERE has_sales_observation = 1),
weekly AS MATERIALIZED (
  SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, SUM(total_sales) AS total_sales,
         CAST(SUM(has_sales_observation) AS BIGINT) AS observed_days, COUNT(*) AS calendar_days,
         COUNT(*) - CAST(SUM(has_sales_observation) AS BIGINT) AS missing_sales_dates
  FROM daily, last_day_seen WHERE date <= e GROUP BY 1),
months AS (
  SELECT CAST(date_trunc('month', date) AS DATE) AS m, year, month, month_name, SUM(total_sales) AS total_sales,
         CAST(SUM(has_sales_observation) AS BIGINT) AS observed_days, COUNT(*) AS calendar_days,
         COUNT(*) - CAST(SUM(has_sales_observation) AS BIGINT) AS missing_sales_dates
  FROM daily, last_day_seen WHERE date <= e GROUP BY ALL),
complete AS (SELECT *, missing_sales_dates = 0 AND last_day(m) <= e AS is_complete_observation_month FROM months, last_day_seen),
monthly AS MATERIALIZED (
  SELECT strftime(a.m, '%Y-%m') AS year_month, a.year, a.month, a.month_name, a.total_sales, a.observed_days,
         a.calendar_days, a.missing_sales_dates, a.is_complete_observation_month,
         CASE WHEN a.is_complete_observation_month AND b.is_complete_observation_month
              THEN a.total_sales / NULLIF(b.total_sales, 0) - 1 END AS mom_growth,
         CASE WHEN a.is_complete_observation_month AND c.is_complete_observation_month
              THEN a.total_sales / NULLIF(c.total_sales, 0) - 1 END AS yoy_growth
  FROM complete a LEFT JOIN complete b ON b.m = a.m - INTERVAL 1 MONTH LEFT JOIN complete c ON c.m = a.m - INTERVAL 12 MONTH)
"""


def trend(body: str, doubles: str = "", ints: str = "") -> str:
    return twin(body, doubles, ints, more=DAILY)


TWINS["a1_daily_summary"] = trend("SELECT * FROM daily", "total_sales sales_ma_7 sales_ma_28")
TWINS["a2_weekly_summary"] = trend("SELECT * FROM weekly", "total_sales")
TWINS["a3_a4_monthly_summary"] = trend("SELECT * FROM monthly", "total_sales mom_growth yoy_growth")
WEEKDAY = """SELECT month, month_name, day_of_week, day_name, AVG(total_sales) AS average_sales, COUNT(*) AS observed_days
FROM daily WHERE has_sales_observation = 1 GROUP BY ALL"""
TWINS["a5_weekday_month_summary"] = trend(WEEKDAY, "average_sales")
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday"
TWINS["a7_weekday_month_pivot"] = trend(
    "SELECT month, month_name, " + ", ".join(
        f"MAX(average_sales) FILTER (WHERE day_name = '{d}') AS {d}" for d in DAYS.split())
    + f" FROM ({WEEKDAY}) GROUP BY month, month_name", DAYS)
TWINS["a6_seasonality_findings"] = trend("""
WITH o AS (SELECT * FROM daily WHERE has_sales_observation = 1), l AS (SELECT * FROM o, last_day_seen WHERE date = e),
ytd AS (SELECT SUM(total_sales) FILTER (WHERE date BETWEEN date_trunc('year', e) AND e) AS a,
  SUM(total_sales) FILTER (WHERE date BETWEEN date_trunc('year', e) - INTERVAL 12 MONTH AND e - INTERVAL 12 MONTH) AS b
  FROM o, last_day_seen),
numbers AS (
  SELECT 'observed_days' AS finding, CAST((SELECT COUNT(*) FROM o) AS DOUBLE) AS value
  UNION ALL SELECT 'latest_daily_sales', total_sales FROM l UNION ALL SELECT 'latest_ma_7', sales_ma_7 FROM l
  UNION ALL SELECT 'latest_ma_28', sales_ma_28 FROM l
  UNION ALL SELECT 'weekend_average', AVG(total_sales) FROM o WHERE is_weekend = 1
  UNION ALL SELECT 'weekday_average', AVG(total_sales) FROM o WHERE is_weekend = 0
  UNION ALL SELECT 'payday_average', AVG(total_sales) FROM o WHERE is_payday = 1
  UNION ALL SELECT 'nonpayday_average', AVG(total_sales) FROM o WHERE is_payday = 0
  UNION ALL SELECT 'year_to_date_sales', a FROM ytd UNION ALL SELECT 'previous_year_to_date_sales', b FROM ytd
  UNION ALL SELECT 'year_to_date_growth', a / NULLIF(b, 0) - 1 FROM ytd)
SELECT finding, CAST(e AS VARCHAR) AS period, value FROM numbers, last_day_seen
UNION ALL SELECT 'missing_historical_dates', NULL, CAST(COUNT(*) AS DOUBLE) FROM daily, last_day_seen WHERE has_sales_observation = 0 AND date <= e
UNION ALL (SELECT 'weekly_peak', CAST(week_start AS VARCHAR), total_sales FROM weekly WHERE total_sales IS NOT NULL ORDER BY total_sales DESC, week_start LIMIT 1)
UNION ALL (SELECT 'latest_month', year_month, total_sales FROM monthly WHERE total_sales IS NOT NULL ORDER BY year_month DESC LIMIT 1)
UNION ALL (SELECT 'latest_month_over_month', year_month, mom_growth FROM monthly WHERE mom_growth IS NOT NULL ORDER BY year_month DESC LIMIT 1)
UNION ALL (SELECT 'latest_year_over_year', year_month, yoy_growth FROM monthly WHERE yoy_growth IS NOT NULL ORDER BY year_month DESC LIMIT 1)
""", "value")

# ------------------------------------------------------------------ stores
STORES = """
sd AS MATERIALIZED (SELECT store_key, full_date, total_sales AS daily_sales FROM store_day JOIN dim_date USING (date_key)),
latest AS (SELECT MAX(full_date) AS e FROM sd),
edges AS (SELECT e, e - 89 AS r0, e - 179 AS p0, e - 90 AS p1, CAST(e - 89 - INTERVAL 12 MONTH AS DATE) AS y0,
          CAST(e - INTERVAL 12 MONTH AS DATE) AS y1 FROM latest),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_key ORDER BY full_date) AS up,
             ROW_NUMBER() OVER (PARTITION BY store_key ORDER BY full_date DESC) AS down FROM sd),
growth AS (
  SELECT store_key, AVG(daily_sales) FILTER (WHERE up <= 90) AS f, AVG(daily_sales) FILTER (WHERE down <= 90) AS l,
         SUM(daily_sales) FILTER (WHERE full_date BETWEEN r0 AND e) AS r, COUNT(*) FILTER (WHERE full_date BETWEEN r0 AND e) AS rn,
         SUM(daily_sales) FILTER (WHERE full_date BETWEEN p0 AND p1) AS p, COUNT(*) FILTER (WHERE full_date BETWEEN p0 AND p1) AS pn,
         SUM(daily_sales) FILTER (WHERE full_date BETWEEN y0 AND y1) AS y, COUNT(*) FILTER (WHERE full_date BETWEEN y0 AND y1) AS yn
  FROM numbered, edges GROUP BY store_key),
totals AS (SELECT store_key, SUM(daily_sales) AS total_sales, AVG(daily_sales) AS average_daily_sales,
           stddev_samp(daily_sales) AS sales_std, COUNT(*) AS active_days FROM sd GROUP BY 1),
visits AS (SELECT store_key, CAST(SUM(transactions) AS BIGINT) AS total_transactions FROM fact_store_transactions GROUP BY 1),
base AS (
  SELECT s.store_nbr, s.city, s.state, s.store_type, s.cluster, t.total_sales, t.average_daily_sales, t.sales_std,
         t.sales_std / NULLIF(t.average_daily_sales, 0) AS coefficient_of_variation, t.active_days, v.total_transactions,
         t.total_sales / NULLIF(CAST(v.total_transactions AS DOUBLE), 0) AS sales_volume_per_transaction,
         (l - f) / NULLIF(f, 0) AS first_vs_last_90d_growth_proxy, f AS first_window_average_daily_sales,
         l AS last_window_average_daily_sales, (r - p) / NULLIF(p, 0) AS recent_90d_growth,
         (r - y) / NULLIF(y, 0) AS recent_90d_yoy_growth, CASE WHEN yn > 0 THEN 1 ELSE 0 END AS has_yoy_comparison,
         r AS recent_90d_sales, p AS previous_90d_sales, y AS yoy_90d_sales, rn AS recent_90d_observed_days,
         pn AS previous_90d_observed_days, yn AS yoy_90d_observed_days, r0 AS recent_90d_start_date, e AS recent_90d_end_date,
         p0 AS previous_90d_start_date, p1 AS previous_90d_end_date, y0 AS yoy_90d_start_date, y1 AS yoy_90d_end_date
  FROM dim_store s JOIN totals t USING (store_key) LEFT JOIN visits v USING (store_key) JOIN growth USING (store_key), edges),
limits AS (SELECT quantile_cont(average_daily_sales, 0.5) AS sales_threshold_median,
           quantile_cont(coefficient_of_variation, 0.5) AS volatility_threshold_median FROM base),
stores AS MATERIALIZED (
  SELECT *, CASE WHEN average_daily_sales >= sales_threshold_median THEN 'High sales – ' ELSE 'Low sales – ' END
         || CASE WHEN coefficient_of_variation > volatility_threshold_median THEN 'volatile' ELSE 'stable' END AS performance_segment,
         RANK() OVER (ORDER BY average_daily_sales DESC NULLS LAST) AS rank_average_daily_sales,
         CASE WHEN recent_90d_growth IS NOT NULL THEN RANK() OVER (ORDER BY recent_90d_growth DESC NULLS LAST) END AS rank_recent_90d_growth,
         CASE WHEN coefficient_of_variation IS NOT NULL THEN RANK() OVER (ORDER BY coefficient_of_variation DESC NULLS LAST) END AS rank_volatility,
         CASE WHEN sales_volume_per_transaction IS NOT NULL THEN RANK() OVER (ORDER BY sales_volume_per_transaction DESC NULLS LAST) END AS rank_sales_volume_per_transaction
  FROM base, limits)
"""
FAMILIES = """
fam AS (SELECT family, SUM(sales) AS total_sales, AVG(sales) AS average_sales, quantile_cont(sales, 0.5) AS median_sales,
        stddev_samp(sales) AS sales_std, AVG(CASE WHEN sales = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zero_sales_rate,
        AVG(is_promotion) AS promotion_rate, COUNT(DISTINCT store_key) FILTER (WHERE sales > 0) AS number_of_active_stores
        FROM fact_daily_sales JOIN dim_family USING (family_key) GROUP BY family),
fam_month AS (SELECT family, date_key // 100 AS m, SUM(sales) AS s FROM fact_daily_sales JOIN dim_family USING (family_key) GROUP BY ALL),
fam_growth AS (SELECT family, quantile_cont(g, 0.5) AS monthly_growth FROM (
  SELECT family, (s - LAG(s) OVER w) / NULLIF(LAG(s) OVER w, 0) AS g FROM fam_month WINDOW w AS (PARTITION BY family ORDER BY m)) GROUP BY family),
families AS MATERIALIZED (
  SELECT family, total_sales, average_sales, median_sales, sales_std, sales_std / NULLIF(average_sales, 0) AS coefficient_of_variation,
         zero_sales_rate, promotion_rate, number_of_active_stores, monthly_growth,
         total_sales / SUM(total_sales) OVER () AS sales_contribution_rate,
         RANK() OVER (ORDER BY total_sales DESC) AS rank_total_sales,
         RANK() OVER (ORDER BY sales_std / NULLIF(average_sales, 0) DESC NULLS LAST) AS rank_volatility,
         RANK() OVER (ORDER BY zero_sales_rate DESC) AS rank_zero_sales_rate,
         RANK() OVER (ORDER BY promotion_rate DESC) AS rank_promotion_rate
  FROM fam JOIN fam_growth USING (family)),
family_limits AS (SELECT quantile_cont(total_sales, 0.5) AS volume_threshold_median,
  quantile_cont(coefficient_of_variation, 0.5) AS volatility_threshold_median,
  quantile_cont(zero_sales_rate, 0.75) AS intermittency_threshold_q75,
  quantile_cont(promotion_rate, 0.75) AS promotion_dependency_threshold_q75 FROM families),
family_rules AS (SELECT *, CASE WHEN promotion_rate >= promotion_dependency_threshold_q75 THEN 1
  WHEN total_sales >= volume_threshold_median AND coefficient_of_variation > volatility_threshold_median THEN 3
  WHEN total_sales >= volume_threshold_median THEN 2
  WHEN zero_sales_rate >= intermittency_threshold_q75 THEN 4 ELSE 5 END AS rule FROM families, family_limits),
family_readiness AS MATERIALIZED (SELECT * EXCLUDE (rule), ['Promotion dependent', 'High volume – stable', 'High volume – volatile', 'Low volume – intermittent', 'Low volume – stable'][rule] AS forecast_readiness,
  ['promotion_rate >= Q75', 'total_sales >= median and CV <= median', 'total_sales >= median and CV > median', 'total_sales < median and zero_sales_rate >= Q75', 'total_sales < median and zero_sales_rate < Q75'][rule] AS segmentation_rule FROM family_rules)
"""
STORE_DOUBLES = ("total_sales average_daily_sales sales_std coefficient_of_variation sales_volume_per_transaction "
                 "first_vs_last_90d_growth_proxy first_window_average_daily_sales last_window_average_daily_sales "
                 "recent_90d_growth recent_90d_yoy_growth recent_90d_sales previous_90d_sales yoy_90d_sales "
                 "sales_threshold_median volatility_threshold_median")
FAMILY_DOUBLES = ("total_sales average_sales median_sales sales_std coefficient_of_variation zero_sales_rate "
                  "promotion_rate monthly_growth sales_contribution_rate")
TWINS["a8_to_a13_store_performance"] = twin("SELECT * FROM stores", STORE_DOUBLES, more=STORES)
STORE_METRICS = ["average_daily_sales", "recent_90d_growth", "coefficient_of_variation", "sales_volume_per_transaction"]
TWINS["a14_top_and_bottom_stores"] = twin(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, CASE WHEN up <= k THEN 'Bottom' ELSE 'Top' END AS ranking_group, store_nbr, {m} AS value FROM "
    f"(SELECT *, ROW_NUMBER() OVER (ORDER BY {m}, store_nbr) AS up, COUNT(*) OVER () AS c, LEAST(10, COUNT(*) OVER () // 2) AS k "
    f"FROM stores WHERE {m} IS NOT NULL) WHERE up <= k OR up > c - k" for m in STORE_METRICS), "value", more=STORES)
TWINS["a15_attribute_averages"] = twin(" UNION ALL ".join(
    f"(SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS attribute_value, AVG(average_daily_sales) AS average_sales, "
    f"ROW_NUMBER() OVER (ORDER BY AVG(average_daily_sales) DESC, CAST({a} AS VARCHAR)) AS position FROM stores GROUP BY {a} "
    f"QUALIFY position <= 15)" for a in ("city", "state", "store_type", "cluster")), "average_sales", more=STORES)
TWINS["a16_store_findings"] = twin(" UNION ALL ".join(
    f"(SELECT '{n}' AS finding, store_nbr, {m} AS value FROM stores WHERE {m} IS NOT NULL ORDER BY {m} {o}, store_nbr LIMIT 1)"
    for n, m, o in [("highest_average_daily_sales", "average_daily_sales", "DESC"), ("fastest_growth", "recent_90d_growth", "DESC"),
                    ("slowest_growth", "recent_90d_growth", "ASC"), ("highest_volatility", "coefficient_of_variation", "DESC"),
                    ("highest_volume_per_transaction", "sales_volume_per_transaction", "DESC")])
    + " UNION ALL SELECT 'undefined_growth_stores', NULL, CAST(COUNT(*) FILTER (WHERE recent_90d_growth IS NULL) AS DOUBLE) FROM stores",
    "value", more=STORES)
TWINS["a17_a18_a19_family_performance"] = twin("SELECT * FROM families", FAMILY_DOUBLES, more=FAMILIES)
TWINS["a20_family_readiness"] = twin(
    "SELECT * FROM family_readiness", FAMILY_DOUBLES + " volume_threshold_median volatility_threshold_median "
    "intermittency_threshold_q75 promotion_dependency_threshold_q75", more=FAMILIES)
TWINS["a21_top_families"] = twin(" UNION ALL ".join(
    f"(SELECT family, '{m}' AS metric, {m} AS value, ROW_NUMBER() OVER (ORDER BY {m} DESC NULLS LAST, family) AS position "
    f"FROM families QUALIFY position <= 15)" for m in
    ("total_sales", "coefficient_of_variation", "zero_sales_rate", "promotion_rate")), "value", more=FAMILIES)
TWINS["a16_family_findings"] = twin(" UNION ALL ".join(
    f"(SELECT '{n}' AS finding, family, {m} AS value FROM families WHERE {m} IS NOT NULL ORDER BY {m} DESC, family LIMIT 1)"
    for n, m in [("largest_sales", "total_sales"), ("highest_volatility", "coefficient_of_variation"),
                 ("highest_zero_sales_rate", "zero_sales_rate"), ("highest_promotion_rate", "promotion_rate")]),
    "value", more=FAMILIES)
TWINS["a22_segment_counts"] = twin("""
SELECT performance_segment AS segment, COUNT(*) AS members FROM stores GROUP BY 1
UNION ALL SELECT forecast_readiness, COUNT(*) FROM family_readiness GROUP BY 1""",
                                   more=STORES.strip() + "," + FAMILIES.strip())
TWINS["a23_sales_histogram"] = twin("""
SELECT bin, low + bin * w AS bin_start, COUNT(*) AS row_count FROM (
  SELECT LEAST(CAST(floor((LEAST(sales, high) - low) / w) AS INT), 59) AS bin, low, w
  FROM train, (SELECT low, high, (high - low) / 60 AS w FROM (SELECT MIN(sales) AS low, quantile_cont(sales, 0.99) AS high FROM train)))
GROUP BY ALL""", "bin_start")
TWINS["a24_row_shares"] = twin("""
SELECT 'zero_sales_row_share' AS measure, CAST(COUNT(*) FILTER (WHERE sales = 0) AS DOUBLE) / COUNT(*) AS value FROM train
UNION ALL SELECT 'positive_sales_row_share', CAST(COUNT(*) FILTER (WHERE sales > 0) AS DOUBLE) / COUNT(*) FROM train
UNION ALL SELECT 'promotion_store_day_share', AVG(p) FROM (SELECT MAX(is_promotion) AS p FROM train GROUP BY date, store_nbr)""", "value")

# ------------------------------------------------------------------ promotions
PROMO = """
e AS MATERIALIZED (
  SELECT f.date_key, f.store_key, f.family_key, f.sales, f.onpromotion, f.is_promotion, m.family, s.store_nbr, s.store_type,
         d.year, d.month, d.day_of_week, CASE WHEN is_promotion = 1 THEN sales END AS sales_promo,
         CASE WHEN is_promotion = 0 THEN sales END AS sales_nonpromo, CASE WHEN is_promotion = 1 THEN onpromotion END AS onpromotion_promo
  FROM fact_daily_sales f JOIN dim_family m USING (family_key) JOIN dim_store s USING (store_key) JOIN dim_date d USING (date_key)),
grouped AS (
  SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(store_nbr) = 0 THEN 'store_nbr'
              WHEN grouping(store_type) = 0 THEN 'store_type' WHEN grouping(day_of_week) = 0 THEN 'day_of_week' ELSE 'month' END AS analysis_dimension,
         CAST(family AS VARCHAR) AS family, CAST(store_nbr AS VARCHAR) AS store_nbr, store_type, CAST(day_of_week AS VARCHAR) AS day_of_week,
         CAST(month AS VARCHAR) AS month, AVG(sales) AS average_sales, quantile_cont(sales, 0.5) AS median_sales, COUNT(*) AS observation_count,
         COUNT(sales_promo) AS promotion_observation_count, COUNT(sales_nonpromo) AS nonpromotion_observation_count,
         AVG(is_promotion) AS promotion_rate, AVG(sales_promo) AS avg_sales_promo, AVG(sales_nonpromo) AS avg_sales_nonpromo,
         quantile_cont(sales_promo, 0.5) AS median_sales_promo, quantile_cont(sales_nonpromo, 0.5) AS median_sales_nonpromo,
         CAST(SUM(onpromotion) AS BIGINT) AS total_onpromotion, AVG(onpromotion) AS average_onpromotion,
         quantile_cont(CAST(onpromotion AS DOUBLE), 0.5) AS median_onpromotion, AVG(onpromotion_promo) AS average_onpromotion_when_promoted
  FROM e GROUP BY GROUPING SETS ((family), (store_nbr), (store_type), (day_of_week), (month))),
basic AS MATERIALIZED (
  SELECT *, COALESCE(family, store_nbr, store_type, day_of_week, month) AS group_value,
         (avg_sales_promo - avg_sales_nonpromo) / NULLIF(avg_sales_nonpromo, 0) * 100 AS uplift_proxy_pct,
         CASE WHEN promotion_observation_count < 100 AND nonpromotion_observation_count < 100 THEN 'Both cohorts below minimum sample size'
              WHEN promotion_observation_count < 100 THEN 'Promotion cohort below minimum sample size'
              WHEN nonpromotion_observation_count < 100 THEN 'Non-promotion cohort below minimum sample size' ELSE '' END AS small_sample_warning,
         100 AS minimum_cohort_observations FROM grouped),
cells AS MATERIALIZED (
  SELECT store_nbr, family, store_type, year, month, day_of_week, AVG(sales_promo) AS avg_sales_promo,
         AVG(sales_nonpromo) AS avg_sales_nonpromo, COUNT(sales_promo) AS promotion_observation_count,
         COUNT(sales_nonpromo) AS nonpromotion_observation_count FROM e GROUP BY ALL
  HAVING COUNT(sales_promo) > 0 AND COUNT(sales_nonpromo) > 0),
rolled AS (
  SELECT CASE WHEN grouping(family) = 0 THEN 'family' ELSE 'store_type' END AS level, family, store_type,
         SUM(avg_sales_promo * promotion_observation_count) / SUM(promotion_observation_count) AS avg_sales_promo,
         SUM(avg_sales_nonpromo * nonpromotion_observation_count) / SUM(nonpromotion_observation_count) AS avg_sales_nonpromo,
         CAST(SUM(promotion_observation_count) AS BIGINT) AS promotion_observation_count,
         CAST(SUM(nonpromotion_observation_count) AS BIGINT) AS nonpromotion_observation_count, COUNT(*) AS matched_group_count
  FROM cells GROUP BY GROUPING SETS ((family), (store_type))),
stacked AS (
  SELECT 'matched_group' AS analysis_level, store_nbr, family, store_type, year, month, day_of_week, avg_sales_promo, avg_sales_nonpromo,
         promotion_observation_count, nonpromotion_observation_count, 1 AS matched_group_count, CAST(NULL AS DOUBLE) AS unmatched_uplift_proxy_pct,
         'At least one matched cohort below minimum sample size' AS warning FROM cells
  UNION ALL
  SELECT level || '_summary', NULL, r.family, r.store_type, NULL, NULL, NULL, r.avg_sales_promo, r.avg_sales_nonpromo,
         r.promotion_observation_count, r.nonpromotion_observation_count, matched_group_count, b.uplift_proxy_pct,
         'At least one aggregated matched cohort below minimum sample size'
  FROM rolled r JOIN basic b ON b.analysis_dimension = level AND b.group_value = COALESCE(r.family, r.store_type)),
matched AS MATERIALIZED (
  SELECT * EXCLUDE (warning, matched_group_count), CAST(matched_group_count AS BIGINT) AS matched_group_count,
         (avg_sales_promo - avg_sales_nonpromo) / NULLIF(avg_sales_nonpromo, 0) * 100 AS matched_uplift_proxy_pct,
         (avg_sales_promo - avg_sales_nonpromo) / NULLIF(avg_sales_nonpromo, 0) * 100 - unmatched_uplift_proxy_pct AS matched_vs_unmatched_difference_pct_points,
         CASE WHEN LEAST(promotion_observation_count, nonpromotion_observation_count) < 100 THEN warning ELSE '' END AS small_sample_warning,
         100 AS minimum_cohort_observations, 'Both cohorts within store_nbr + family + year + month + day_of_week' AS matching_rule,
         'No automatic outlier removal' AS outlier_handling FROM stacked)
"""
PROMO_DOUBLES = ("average_sales median_sales promotion_rate avg_sales_promo avg_sales_nonpromo median_sales_promo "
                 "median_sales_nonpromo average_onpromotion median_onpromotion average_onpromotion_when_promoted uplift_proxy_pct")


def promo(body: str, doubles: str = "", ints: str = "") -> str:
    return twin(body, doubles, ints, more=PROMO)


TWINS["p1_enriched_sales"] = promo("SELECT * FROM e", "sales sales_promo sales_nonpromo")
TWINS["p2_p3_dimension_summary"] = promo("SELECT * FROM basic", PROMO_DOUBLES)
TWINS["p4_promotion_bands"] = promo("""
SELECT b.i AS band_order, b.label AS onpromotion_band, AVG(sales) AS average_sales, quantile_cont(sales, 0.5) AS median_sales,
       COUNT(sales) AS observation_count, AVG(onpromotion) AS average_onpromotion,
       CASE WHEN COUNT(sales) < 100 THEN 'Band below minimum sample size' ELSE '' END AS small_sample_warning
FROM (VALUES (0, '0', -1, 0), (1, '1', 0, 1), (2, '2–5', 1, 5), (3, '6–10', 5, 10), (4, '11–25', 10, 25), (5, '26–50', 25, 50), (6, '51+', 50, 2000000000)) AS b(i, label, lo, hi)
LEFT JOIN e ON onpromotion > lo AND onpromotion <= hi GROUP BY b.i, b.label""", "average_sales median_sales average_onpromotion")
MATCHED_DOUBLES = ("avg_sales_promo avg_sales_nonpromo matched_uplift_proxy_pct unmatched_uplift_proxy_pct "
                   "matched_vs_unmatched_difference_pct_points")
TWINS["p5_p6_p7_matched_analysis"] = promo("SELECT * FROM matched", MATCHED_DOUBLES)
TWINS["p8_overall_cohorts"] = promo("""
SELECT 'Promotion-active observations' AS cohort, SUM(avg_sales_promo * promotion_observation_count) / SUM(promotion_observation_count) AS average_sales FROM basic WHERE analysis_dimension = 'family'
UNION ALL SELECT 'Nonpromotion observations', SUM(avg_sales_nonpromo * nonpromotion_observation_count) / SUM(nonpromotion_observation_count) FROM basic WHERE analysis_dimension = 'family'
""", "average_sales")
TWINS["p9_top_uplift_families"] = promo("""
SELECT family, uplift_proxy_pct, promotion_observation_count, nonpromotion_observation_count FROM basic
WHERE analysis_dimension = 'family' AND uplift_proxy_pct IS NOT NULL AND LEAST(promotion_observation_count, nonpromotion_observation_count) >= 100
ORDER BY uplift_proxy_pct DESC, family LIMIT 15""", "uplift_proxy_pct")
TWINS["p10_limitation_counts"] = promo("""
SELECT 'warned_groups' AS counter, COUNT(*) FILTER (WHERE small_sample_warning <> '') AS value FROM basic
UNION ALL SELECT 'undefined_uplifts', COUNT(*) FILTER (WHERE uplift_proxy_pct IS NULL) FROM basic
UNION ALL SELECT 'matched_groups', COUNT(*) FROM matched WHERE analysis_level = 'matched_group'
UNION ALL SELECT 'warned_matched_groups', COUNT(*) FROM matched WHERE analysis_level = 'matched_group' AND small_sample_warning <> ''""")

# ------------------------------------------------------------------ holidays
HOLIDAY = """
hf AS MATERIALIZED (
  SELECT g.date_key, g.store_key, g.holiday_count, g.holiday_descriptions, g.holiday_types, g.holiday_locales,
         g.is_holiday, g.is_work_day, g.is_event, f.total_sales AS actual_sales, d.full_date, d.day_of_week, d.day_name, d.is_payday,
         s.store_nbr, s.city, s.state,
         CAST(list_contains(string_split(g.holiday_locales, ' | '), 'National') AND g.is_holiday = 1 AS INT) AS is_national_holiday,
         CAST(list_contains(string_split(g.holiday_locales, ' | '), 'Regional') AND g.is_holiday = 1 AS INT) AS is_regional_holiday,
         CAST(list_contains(string_split(g.holiday_locales, ' | '), 'Local') AND g.is_holiday = 1 AS INT) AS is_local_holiday,
         CAST(list_contains(string_split(g.holiday_types, ' | '), 'Holiday') AS INT) AS is_type_holiday,
         CAST(list_contains(string_split(g.holiday_types, ' | '), 'Transfer') AS INT) AS is_transfer,
         CAST(list_contains(string_split(g.holiday_types, ' | '), 'Additional') AS INT) AS is_additional,
         CAST(list_contains(string_split(g.holiday_types, ' | '), 'Bridge') AS INT) AS is_bridge,
         CAST(d.is_payday = 1 AND g.is_holiday = 1 AS INT) AS is_payday_holiday,
         CAST(b.date_key IS NOT NULL AS INT) AS has_holiday_mapping, CAST(b.date_key IS NOT NULL AS INT) AS is_special_day,
         CASE WHEN f.total_sales IS NULL THEN 'left_only' ELSE 'both' END AS sales_observation_status,
         CASE WHEN b.date_key IS NULL THEN 'left_only' ELSE 'both' END AS holiday_mapping_status
  FROM dim_store_date g JOIN dim_date d USING (date_key) JOIN dim_store s USING (store_key)
  LEFT JOIN store_day f ON f.date_key = g.date_key AND f.store_key = g.store_key
  LEFT JOIN bridge_store_holiday b ON b.date_key = g.date_key AND b.store_key = g.store_key),
back AS (SELECT h.*, a.actual_sales AS sales_lag_7d, b.actual_sales AS sales_lag_14d, c.actual_sales AS sales_lag_21d, d.actual_sales AS sales_lag_28d,
    a.is_special_day AS special_day_lag_7d, b.is_special_day AS special_day_lag_14d, c.is_special_day AS special_day_lag_21d, d.is_special_day AS special_day_lag_28d,
    COALESCE(n.is_holiday, 0) AS is_day_before_holiday, COALESCE(p.is_holiday, 0) AS is_day_after_holiday
  FROM hf h LEFT JOIN hf a ON a.store_key = h.store_key AND a.full_date = h.full_date - 7
  LEFT JOIN hf b ON b.store_key = h.store_key AND b.full_date = h.full_date - 14
  LEFT JOIN hf c ON c.store_key = h.store_key AND c.full_date = h.full_date - 21
  LEFT JOIN hf d ON d.store_key = h.store_key AND d.full_date = h.full_date - 28
  LEFT JOIN hf n ON n.store_key = h.store_key AND n.full_date = h.full_date + 1
  LEFT JOIN hf p ON p.store_key = h.store_key AND p.full_date = h.full_date - 1),
based AS (SELECT *, CAST((sales_lag_7d IS NOT NULL) AS INT) + CAST((sales_lag_14d IS NOT NULL) AS INT) + CAST((sales_lag_21d IS NOT NULL) AS INT)
         + CAST((sales_lag_28d IS NOT NULL) AS INT) AS baseline_observation_count,
         (sales_lag_7d + sales_lag_14d + sales_lag_21d + sales_lag_28d) / 4 AS baseline_sales,
         CASE WHEN COALESCE(special_day_lag_7d, special_day_lag_14d, special_day_lag_21d, special_day_lag_28d) IS NOT NULL
              THEN COALESCE(special_day_lag_7d, 0) + COALESCE(special_day_lag_14d, 0) + COALESCE(special_day_lag_21d, 0) + COALESCE(special_day_lag_28d, 0) END AS baseline_special_day_count,
         CASE WHEN holiday_descriptions = '' THEN 'Regular day' ELSE holiday_descriptions END AS event_label FROM back),
ordinary AS (SELECT store_key, day_of_week, AVG(actual_sales) AS same_weekday_regular_average_sales FROM hf WHERE is_special_day = 0 GROUP BY ALL),
labels AS (SELECT event_label, COUNT(actual_sales) AS event_observation_count FROM based GROUP BY 1),
hol AS MATERIALIZED (
  SELECT based.*, CASE WHEN baseline_observation_count = 4 THEN 'Complete four-week baseline' ELSE 'Incomplete baseline retained' END AS baseline_status,
         actual_sales - baseline_sales AS difference, (actual_sales - baseline_sales) / NULLIF(baseline_sales, 0) * 100 AS difference_pct,
         same_weekday_regular_average_sales, actual_sales - same_weekday_regular_average_sales AS same_weekday_regular_difference,
         (actual_sales - same_weekday_regular_average_sales) / NULLIF(same_weekday_regular_average_sales, 0) * 100 AS same_weekday_regular_difference_pct,
         CASE WHEN is_holiday = 1 THEN 'During holiday' WHEN is_day_before_holiday = 1 THEN 'Before holiday'
              WHEN is_day_after_holiday = 1 THEN 'After holiday' ELSE 'Other day' END AS holiday_window, event_observation_count,
         CASE WHEN has_holiday_mapping = 1 AND event_observation_count < 30 THEN 'Event below minimum observation count' ELSE '' END AS small_event_warning
  FROM based LEFT JOIN ordinary USING (store_key, day_of_week) JOIN labels USING (event_label))
"""


def holiday(body: str, doubles: str = "", ints: str = "") -> str:
    return twin(body, doubles, ints, more=HOLIDAY)


TWINS["h1_h2_store_day_frame"] = holiday("SELECT * FROM hf", "actual_sales")
TWINS["h3_h4_h5_h6_holiday_frame"] = holiday(
    "SELECT * FROM hol", "actual_sales sales_lag_7d sales_lag_14d sales_lag_21d sales_lag_28d baseline_sales difference difference_pct "
    "same_weekday_regular_average_sales same_weekday_regular_difference same_weekday_regular_difference_pct")
CATEGORIES = [("Regular day", "is_special_day = 0"), ("National holiday", "is_national_holiday = 1"),
              ("Regional holiday", "is_regional_holiday = 1"), ("Local holiday", "is_local_holiday = 1"),
              ("Holiday", "is_type_holiday = 1"), ("Transfer", "is_transfer = 1"), ("Additional", "is_additional = 1"),
              ("Bridge", "is_bridge = 1"), ("Event", "is_event = 1"), ("Work Day", "is_work_day = 1"),
              ("Payday + holiday", "is_payday_holiday = 1")]
TWINS["h7_category_summary"] = holiday("""
SELECT event_category, COUNT(actual_sales) AS observation_count, AVG(actual_sales) AS average_actual_sales,
       quantile_cont(actual_sales, 0.5) AS median_actual_sales, stddev_samp(actual_sales) AS actual_sales_std,
       AVG(baseline_sales) AS average_baseline_sales, AVG(difference) AS average_difference, quantile_cont(difference, 0.5) AS median_difference,
       AVG(difference_pct) AS average_difference_pct, quantile_cont(difference_pct, 0.5) AS median_difference_pct,
       quantile_cont(difference_pct, 0.25) AS q25_difference_pct, quantile_cont(difference_pct, 0.75) AS q75_difference_pct,
       CAST(SUM(is_payday) AS BIGINT) AS payday_observation_count,
       CASE WHEN COUNT(actual_sales) < 30 THEN 'Category below minimum observation count' ELSE '' END AS small_sample_warning
FROM (""" + " UNION ALL ".join(f"SELECT '{n}' AS event_category, * FROM hol WHERE {c}" for n, c in CATEGORIES)
    + ") GROUP BY event_category",
    "average_actual_sales median_actual_sales actual_sales_std average_baseline_sales average_difference median_difference "
    "average_difference_pct median_difference_pct q25_difference_pct q75_difference_pct")
TWINS["h8_payday_holiday_groups"] = holiday("""
SELECT CASE WHEN is_payday_holiday = 1 THEN 'Payday + holiday' WHEN is_holiday = 1 THEN 'Holiday only' WHEN is_payday = 1 THEN 'Payday only' ELSE 'Neither' END AS payday_holiday_group,
       COUNT(*) AS observation_count, AVG(difference_pct) AS average_difference_pct, quantile_cont(difference_pct, 0.25) AS q25_difference_pct,
       quantile_cont(difference_pct, 0.5) AS median_difference_pct, quantile_cont(difference_pct, 0.75) AS q75_difference_pct
FROM hol WHERE difference_pct IS NOT NULL GROUP BY 1""",
                                          "average_difference_pct q25_difference_pct median_difference_pct q75_difference_pct")
TWINS["h9_log_sales_distributions"] = holiday("""
SELECT view, group_value, COUNT(*) AS observation_count, MIN(v) AS minimum, MAX(v) AS maximum, quantile_cont(v, 0.25) AS q25,
       quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75
FROM (SELECT 'weekday' AS view, day_name || ' / ' || CASE WHEN is_holiday = 1 THEN 'Holiday' ELSE 'Regular' END AS group_value, ln(1 + actual_sales) AS v FROM hol WHERE actual_sales IS NOT NULL
      UNION ALL SELECT 'holiday_window', holiday_window, ln(1 + actual_sales) FROM hol WHERE actual_sales IS NOT NULL)
GROUP BY ALL""", "minimum maximum q25 median q75")
TWINS["h10_limit_counters"] = holiday("""
SELECT 'multi_event_store_days' AS counter, COUNT(*) FILTER (WHERE holiday_count > 1) AS value FROM hol
UNION ALL SELECT 'incomplete_baselines', COUNT(*) FILTER (WHERE baseline_observation_count < 4) FROM hol
UNION ALL SELECT 'special_days_without_sales', COUNT(*) FILTER (WHERE has_holiday_mapping = 1 AND actual_sales IS NULL) FROM hol
UNION ALL SELECT 'rarely_observed_events', COUNT(DISTINCT event_label) FILTER (WHERE small_event_warning <> '') FROM hol""")

# ------------------------------------------------------------------ transactions
VISITS = """
tf AS MATERIALIZED (
  SELECT t.date_key, t.store_key, t.transactions, f.total_sales, d.full_date, d.day_of_week, d.day_name, d.month, d.month_name, d.year,
         s.store_nbr, s.city, s.state, s.store_type, s.cluster, f.total_sales / NULLIF(CAST(t.transactions AS DOUBLE), 0) AS sales_volume_per_transaction,
         CAST(t.transactions = 0 AS INT) AS zero_transaction_flag
  FROM fact_store_transactions t LEFT JOIN store_day f ON f.date_key = t.date_key AND f.store_key = t.store_key
  JOIN dim_date d ON d.date_key = t.date_key JOIN dim_store s ON s.store_key = t.store_key),
med AS (SELECT store_nbr, quantile_cont(CAST(transactions AS DOUBLE), 0.5) AS m FROM tf GROUP BY 1),
mad AS (SELECT store_nbr, quantile_cont(abs(transactions - m), 0.5) AS a FROM tf JOIN med USING (store_nbr) GROUP BY 1),
td AS MATERIALIZED (
  SELECT tf.*, m AS transaction_store_median, a AS transaction_store_mad, 0.6745::DOUBLE * (transactions - m) / NULLIF(a, 0) AS transaction_robust_z,
         CAST(COALESCE(abs(0.6745::DOUBLE * (transactions - m) / NULLIF(a, 0)) >= 3.5, false) AS INT) AS unusual_transaction_day,
         'absolute modified z-score >= 3.5; no rows removed' AS anomaly_rule,
         CASE WHEN COUNT(*) OVER w >= 7 THEN AVG(transactions) OVER w END AS transactions_28_observation_rolling_average
  FROM tf JOIN med USING (store_nbr) JOIN mad USING (store_nbr)
  WINDOW w AS (PARTITION BY store_nbr ORDER BY full_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
tm AS (SELECT strftime(full_date, '%Y-%m') AS year_month, SUM(total_sales) AS total_sales, CAST(SUM(transactions) AS BIGINT) AS total_transactions,
       COUNT(*) AS store_day_count, SUM(total_sales) / NULLIF(CAST(SUM(transactions) AS DOUBLE), 0) AS sales_volume_per_transaction FROM td GROUP BY 1),
tp AS (SELECT *, LAG(total_sales) OVER (ORDER BY year_month) AS previous_total_sales, LAG(total_transactions) OVER (ORDER BY year_month) AS previous_total_transactions,
       LAG(sales_volume_per_transaction) OVER (ORDER BY year_month) AS previous_sales_volume_per_transaction FROM tm),
te AS (SELECT *, total_sales - previous_total_sales AS sales_change,
       (total_transactions - previous_total_transactions) * previous_sales_volume_per_transaction AS transaction_effect,
       (sales_volume_per_transaction - previous_sales_volume_per_transaction) * previous_total_transactions AS volume_per_transaction_effect,
       (total_transactions - previous_total_transactions) * (sales_volume_per_transaction - previous_sales_volume_per_transaction) AS interaction_effect FROM tp),
driver AS MATERIALIZED (SELECT *, CASE WHEN sales_change > 0 THEN 'Increase' WHEN sales_change < 0 THEN 'Decrease' ELSE 'No change / first month' END AS sales_change_direction,
       CASE WHEN sales_change IS NULL THEN 'Not available for first month' WHEN abs(transaction_effect) >= abs(volume_per_transaction_effect + interaction_effect) THEN 'Transactions'
            ELSE 'Sales volume per transaction' END AS dominant_change_driver FROM te)
"""


def visits(body: str, doubles: str = "", ints: str = "") -> str:
    return twin(body, doubles, ints, more=VISITS)


TWINS["t1_store_day_frame"] = visits("SELECT * FROM tf", "total_sales sales_volume_per_transaction")
TWINS["t1_unmapped_store_days"] = visits("""
SELECT COUNT(*) AS store_days_without_sales, CAST(COALESCE(SUM(transactions), 0) AS BIGINT) AS transactions_without_sales FROM tf WHERE total_sales IS NULL""")
TWINS["t2_t3_outliers_and_trend"] = visits(
    "SELECT * FROM td", "total_sales sales_volume_per_transaction transaction_store_median transaction_store_mad "
    "transaction_robust_z transactions_28_observation_rolling_average")
TWINS["t4_store_summary"] = visits("""
SELECT *, RANK() OVER (ORDER BY total_transactions DESC) AS rank_total_transactions,
       CASE WHEN sales_volume_per_transaction IS NOT NULL
            THEN RANK() OVER (ORDER BY sales_volume_per_transaction DESC NULLS LAST) END AS rank_sales_volume_per_transaction
FROM (SELECT store_nbr, city, state, store_type, cluster, SUM(total_sales) AS total_sales, CAST(SUM(transactions) AS BIGINT) AS total_transactions,
             AVG(transactions) AS average_daily_transactions, quantile_cont(CAST(transactions AS DOUBLE), 0.5) AS median_daily_transactions,
             COUNT(*) AS transaction_observation_count, CAST(SUM(unusual_transaction_day) AS BIGINT) AS unusual_transaction_days,
             SUM(total_sales) / NULLIF(CAST(SUM(transactions) AS DOUBLE), 0) AS sales_volume_per_transaction,
             CASE WHEN stddev_pop(total_sales) * stddev_pop(transactions) FILTER (WHERE total_sales IS NOT NULL) > 0
                  THEN corr(total_sales, transactions) END AS sales_transactions_correlation FROM td GROUP BY ALL)
""", "total_sales average_daily_transactions median_daily_transactions sales_volume_per_transaction sales_transactions_correlation")
TWINS["t5_monthly_driver"] = visits(
    "SELECT * FROM driver", "total_sales sales_volume_per_transaction previous_total_sales previous_sales_volume_per_transaction "
    "sales_change transaction_effect volume_per_transaction_effect interaction_effect")
TWINS["t6_daily_totals"] = visits("""
SELECT *, AVG(total_transactions) OVER (ORDER BY full_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS transactions_ma_28
FROM (SELECT full_date, CAST(SUM(transactions) AS BIGINT) AS total_transactions, SUM(total_sales) AS total_sales FROM td GROUP BY 1)
""", "total_sales transactions_ma_28")
TWINS["t6_overall_correlation"] = visits("""
SELECT corr(total_sales, transactions) AS sales_transactions_correlation, CAST(SUM(zero_transaction_flag) AS BIGINT) AS zero_transaction_days,
       CAST(SUM(unusual_transaction_day) AS BIGINT) AS unusual_transaction_days, COUNT(*) AS store_days FROM td""",
                                        "sales_transactions_correlation")
TWINS["t7_calendar_distributions"] = visits("""
SELECT view, group_number, group_name, COUNT(*) AS store_days, AVG(v) AS average_transactions, quantile_cont(v, 0.25) AS q25,
       quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75
FROM (SELECT 'weekday' AS view, day_of_week AS group_number, day_name AS group_name, CAST(transactions AS DOUBLE) AS v FROM td
      UNION ALL SELECT 'month', month, month_name, CAST(transactions AS DOUBLE) FROM td) GROUP BY ALL""",
                                           "average_transactions q25 median q75")
TWINS["t8_driver_counts"] = visits("""SELECT dominant_change_driver, COUNT(*) AS months FROM driver
WHERE sales_change_direction = 'Increase' GROUP BY 1""")

# ------------------------------------------------------------------ anomalies
ANOMALY = """
nd AS MATERIALIZED (
  SELECT f.date_key, f.store_key, f.actual_sales, f.is_promotion, f.promotion_rate, d.full_date, d.day_of_week, d.day_name, s.store_nbr,
         COALESCE(b.is_holiday, 0) AS is_holiday, COALESCE(b.is_event, 0) AS is_event
  FROM (SELECT date_key, store_key, SUM(sales) AS actual_sales, MAX(is_promotion) AS is_promotion, AVG(is_promotion) AS promotion_rate
        FROM fact_daily_sales GROUP BY ALL) f
  JOIN dim_date d USING (date_key) JOIN dim_store s USING (store_key)
  LEFT JOIN bridge_store_holiday b ON b.date_key = f.date_key AND b.store_key = f.store_key),
ns AS MATERIALIZED (SELECT date_key, full_date, day_of_week, day_name, SUM(actual_sales) AS actual_sales, MAX(is_holiday) AS is_holiday,
         MAX(is_event) AS is_event, MAX(is_promotion) AS is_promotion, AVG(promotion_rate) AS promotion_rate, CAST(NULL AS INT) AS store_nbr FROM nd GROUP BY ALL),
both_levels AS (SELECT 'store_day' AS analysis_level, full_date, day_of_week, store_nbr, actual_sales, is_holiday, is_event, is_promotion, promotion_rate FROM nd
  UNION ALL SELECT 'system_day', full_date, day_of_week, store_nbr, actual_sales, is_holiday, is_event, is_promotion, promotion_rate FROM ns),
rolled_scores AS (SELECT *, CASE WHEN COUNT(actual_sales) OVER w >= 14 THEN AVG(actual_sales) OVER w END AS rolling_expected_sales,
         CASE WHEN COUNT(actual_sales) OVER w >= 14 THEN stddev_samp(actual_sales) OVER w END AS rolling_sales_std FROM both_levels
  WINDOW w AS (PARTITION BY analysis_level, store_nbr ORDER BY full_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
peers AS (SELECT analysis_level, store_nbr, day_of_week, quantile_cont(actual_sales, 0.25) AS weekday_q1_sales, quantile_cont(actual_sales, 0.5) AS weekday_median_sales,
         quantile_cont(actual_sales, 0.75) AS weekday_q3_sales, COUNT(*) AS weekday_observation_count FROM both_levels GROUP BY ALL),
scored AS (SELECT r.*, p.* EXCLUDE (analysis_level, store_nbr, day_of_week), weekday_q3_sales - weekday_q1_sales AS weekday_iqr_sales,
         (actual_sales - rolling_expected_sales) / NULLIF(rolling_sales_std, 0) AS z_score
  FROM rolled_scores r JOIN peers p ON p.analysis_level = r.analysis_level AND p.day_of_week = r.day_of_week AND p.store_nbr IS NOT DISTINCT FROM r.store_nbr),
flagged AS MATERIALIZED (SELECT *, (actual_sales - weekday_median_sales) / NULLIF(weekday_iqr_sales, 0) AS weekday_iqr_score,
         CAST(COALESCE(abs(z_score) >= 3, false) AS INT) AS rolling_z_anomaly,
         CAST(actual_sales < weekday_q1_sales - 1.5 * weekday_iqr_sales OR actual_sales > weekday_q3_sales + 1.5 * weekday_iqr_sales AS INT) AS weekday_iqr_anomaly,
         CAST(promotion_rate >= 0.25 AS INT) AS material_promotion_context FROM scored),
reviewed AS (SELECT *, CASE WHEN is_holiday = 1 OR is_event = 1 OR material_promotion_context = 1 THEN 'Business event'
         WHEN actual_sales = 0 OR (rolling_z_anomaly = 1 AND weekday_iqr_anomaly = 1 AND abs(z_score) >= 6) THEN 'Potential data issue'
         ELSE 'Unexplained anomaly' END AS review_category FROM flagged WHERE rolling_z_anomaly = 1 OR weekday_iqr_anomaly = 1),
anomalies AS MATERIALIZED (SELECT analysis_level, full_date AS date, store_nbr, actual_sales, COALESCE(rolling_expected_sales, weekday_median_sales) AS expected_sales,
         actual_sales - COALESCE(rolling_expected_sales, weekday_median_sales) AS difference, z_score, is_holiday, is_event, is_promotion, promotion_rate,
         material_promotion_context, rolling_expected_sales, rolling_sales_std, rolling_z_anomaly, weekday_median_sales, weekday_q1_sales, weekday_q3_sales,
         weekday_iqr_sales, weekday_iqr_score, weekday_iqr_anomaly, weekday_observation_count,
         CASE WHEN rolling_z_anomaly = 1 AND weekday_iqr_anomaly = 1 THEN 'Rolling z-score + weekday IQR' WHEN rolling_z_anomaly = 1 THEN 'Rolling z-score' ELSE 'Weekday IQR' END AS anomaly_method,
         review_category, CASE review_category WHEN 'Business event' THEN 'Known business context overlaps the flag; review, do not treat as error'
           WHEN 'Potential data issue' THEN 'Extreme or zero value without mapped context; investigate source records'
           ELSE 'No mapped business context; investigate before drawing conclusions' END AS review_guidance FROM reviewed)
"""
SCORE_DOUBLES = ("actual_sales promotion_rate rolling_expected_sales rolling_sales_std z_score weekday_q1_sales "
                 "weekday_median_sales weekday_q3_sales weekday_iqr_sales weekday_iqr_score")
TWINS["n1_store_daily"] = twin("SELECT * FROM nd", "actual_sales promotion_rate", more=ANOMALY)
TWINS["n2_system_daily"] = twin("SELECT * FROM ns", "actual_sales promotion_rate", more=ANOMALY)
TWINS["n3_n4_scored_days"] = twin("""
SELECT f.* EXCLUDE (analysis_level, material_promotion_context), d.date_key, d.day_name, s.store_key
FROM flagged f JOIN dim_date d ON d.full_date = f.full_date JOIN dim_store s ON s.store_nbr = f.store_nbr
WHERE analysis_level = 'store_day'""", SCORE_DOUBLES, more=ANOMALY)
TWINS["n5_n6_sales_anomalies"] = twin("SELECT * FROM anomalies", SCORE_DOUBLES + " expected_sales difference", more=ANOMALY)

# ------------------------------------------------------------------ readiness
READY = """
sp AS (SELECT store_key, family_key, MIN(full_date) AS history_start, MAX(full_date) AS history_end, COUNT(DISTINCT full_date) AS active_days
  FROM fact_daily_sales JOIN dim_date USING (date_key) WHERE sales > 0 GROUP BY ALL),
iw AS (SELECT store_key, family_key, COUNT(DISTINCT full_date) AS observed_period_count, AVG(sales) AS average_sales, stddev_samp(sales) AS sales_std,
         AVG(CASE WHEN sales = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zero_sales_rate, AVG(is_promotion) AS promotion_rate
  FROM fact_daily_sales JOIN dim_date USING (date_key) JOIN sp USING (store_key, family_key) WHERE full_date BETWEEN history_start AND history_end GROUP BY ALL),
rm AS MATERIALIZED (
  SELECT s.store_key, f.family_key, s.store_nbr, s.city, s.state, s.store_type, s.cluster, f.family, history_start, history_end,
         COALESCE(active_days, 0) AS active_days, COALESCE(observed_period_count, 0) AS observed_period_count,
         CASE WHEN history_start IS NULL THEN 0 ELSE average_sales END AS average_sales, CASE WHEN history_start IS NULL THEN 0 ELSE sales_std END AS sales_std,
         CASE WHEN history_start IS NULL THEN 1 ELSE zero_sales_rate END AS zero_sales_rate, CASE WHEN history_start IS NULL THEN 0 ELSE promotion_rate END AS promotion_rate,
         COALESCE(date_diff('day', history_start, history_end) + 1, 0) AS history_length, CAST(history_start IS NOT NULL AS INT) AS has_positive_sales
  FROM dim_store s CROSS JOIN dim_family f LEFT JOIN sp USING (store_key, family_key) LEFT JOIN iw USING (store_key, family_key)),
rx AS MATERIALIZED (SELECT *, GREATEST(history_length - observed_period_count, 0) AS missing_period_count, sales_std / NULLIF(average_sales, 0) AS coefficient_of_variation FROM rm),
rl AS (SELECT quantile_cont(zero_sales_rate, 0.5) AS zero_sales_rate_median, quantile_cont(zero_sales_rate, 0.75) AS zero_sales_rate_q75,
         quantile_cont(coefficient_of_variation, 0.5) AS cv_median, quantile_cont(coefficient_of_variation, 0.75) AS cv_q75,
         quantile_cont(promotion_rate, 0.75) AS promotion_rate_q75, quantile_cont(CAST(missing_period_count AS DOUBLE), 0.75) AS missing_period_count_q75
  FROM rx WHERE history_length >= 365 AND active_days >= 90),
rf AS (SELECT *, CAST(history_length < 365 OR active_days < 90 AS INT) AS is_insufficient_history,
         CAST(COALESCE(zero_sales_rate >= zero_sales_rate_q75, false) AS INT) AS is_intermittent,
         CAST(COALESCE(promotion_rate >= promotion_rate_q75, false) AS INT) AS is_promotion_dependent,
         CAST(COALESCE(coefficient_of_variation >= cv_q75, false) AS INT) AS is_high_volatility FROM rx, rl),
rc AS (SELECT *, is_insufficient_history + is_intermittent + is_promotion_dependent + is_high_volatility AS risk_flag_count FROM rf),
rr AS (SELECT *, CAST(COALESCE(risk_flag_count = 0 AND history_length >= 730 AND zero_sales_rate <= zero_sales_rate_median AND coefficient_of_variation <= cv_median
         AND missing_period_count <= missing_period_count_q75, false) AS INT) AS is_ready FROM rc),
ready AS MATERIALIZED (SELECT store_nbr, family, city, state, store_type, cluster, history_start, history_end, history_length, active_days, zero_sales_rate,
         average_sales, sales_std, coefficient_of_variation, promotion_rate, observed_period_count, missing_period_count, has_positive_sales,
         is_insufficient_history, is_intermittent, is_promotion_dependent, is_high_volatility, is_ready, risk_flag_count,
         CASE WHEN is_insufficient_history = 1 THEN 'Insufficient history' WHEN is_intermittent = 1 THEN 'Intermittent demand' WHEN is_promotion_dependent = 1 THEN 'Promotion dependent'
              WHEN is_high_volatility = 1 THEN 'High volatility' WHEN is_ready = 1 THEN 'Ready' ELSE 'Ready with caution' END AS readiness_class,
         CASE WHEN is_insufficient_history = 1 THEN 'history_length < 365 or active_days < 90' WHEN is_intermittent = 1 THEN 'zero_sales_rate >= eligible-series Q75'
              WHEN is_promotion_dependent = 1 THEN 'promotion_rate >= eligible-series Q75' WHEN is_high_volatility = 1 THEN 'coefficient_of_variation >= eligible-series Q75'
              WHEN is_ready = 1 THEN 'history_length >= 730, zero-sales <= median, CV <= median, and missing periods <= Q75'
              ELSE 'Sufficient history without an extreme Q75 risk flag' END AS classification_rule,
         zero_sales_rate_median, zero_sales_rate_q75, cv_median, cv_q75, promotion_rate_q75, missing_period_count_q75 FROM rr)
"""
METRIC_DOUBLES = "average_sales sales_std zero_sales_rate promotion_rate coefficient_of_variation"
THRESHOLDS = "zero_sales_rate_median zero_sales_rate_q75 cv_median cv_q75 promotion_rate_q75 missing_period_count_q75"
TWINS["r1_series_metrics"] = twin("SELECT * FROM rx", METRIC_DOUBLES, "history_length missing_period_count", more=READY)
TWINS["r2_forecast_readiness"] = twin("SELECT * FROM ready", f"{METRIC_DOUBLES} {THRESHOLDS}",
                                      "history_length missing_period_count", more=READY)
TWINS["r3_overlap_summary"] = twin(" UNION ALL ".join(f"""
SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS group_value, COUNT(*) AS series_count, COUNT(*) FILTER (WHERE risk_flag_count >= 2) AS overlapping_risk_series,
       CAST(SUM(risk_flag_count) AS BIGINT) AS total_risk_flags, AVG(risk_flag_count) AS average_risk_flags, MAX(risk_flag_count) AS maximum_risk_flags,
       CAST(COUNT(*) FILTER (WHERE risk_flag_count >= 2) AS DOUBLE) / COUNT(*) AS overlap_rate FROM ready GROUP BY {d}""" for d in ("family", "store_nbr")),
    "average_risk_flags overlap_rate", more=READY)
ISSUE = "readiness_class IN ('Intermittent demand', 'Insufficient history', 'High volatility', 'Promotion dependent')"


def _problems(d: str) -> str:
    return f"""
SELECT '{d}' AS dimension, CAST(a.{d} AS VARCHAR) AS group_value, a.n AS series_count, a.k AS issue_count, CAST(a.k AS DOUBLE) / a.n AS issue_rate, b.readiness_class AS dominant_issue
FROM (SELECT {d}, COUNT(*) AS n, COUNT(*) FILTER (WHERE {ISSUE}) AS k FROM ready GROUP BY {d}) a
LEFT JOIN (SELECT {d}, readiness_class FROM ready WHERE {ISSUE} GROUP BY {d}, readiness_class
           QUALIFY ROW_NUMBER() OVER (PARTITION BY {d} ORDER BY COUNT(*) DESC, readiness_class) = 1) b ON b.{d} = a.{d}"""


TWINS["r4_problem_summary"] = twin(" UNION ALL ".join(_problems(d) for d in ("family", "store_nbr")), "issue_rate", more=READY)
DISTRIBUTION = [("class", c, f"readiness_class = '{c}'") for c in
                ("Ready", "Ready with caution", "Intermittent demand", "Insufficient history", "High volatility", "Promotion dependent")]
DISTRIBUTION += [("flag", c, f"{c} = 1") for c in
                 ("is_insufficient_history", "is_intermittent", "is_promotion_dependent", "is_high_volatility", "is_ready")]
DISTRIBUTION += [("risk_flag_count", str(n), f"risk_flag_count = {n}") for n in range(3)] + [("risk_flag_count", "3+", "risk_flag_count >= 3")]
TWINS["r5_distributions"] = twin(" UNION ALL ".join(
    f"SELECT {i} AS position, '{v}' AS distribution, '{c}' AS category, COUNT(*) FILTER (WHERE {w}) AS series_count, "
    f"CAST(COUNT(*) FILTER (WHERE {w}) AS DOUBLE) / COUNT(*) * 100 AS series_share_pct FROM ready"
    for i, (v, c, w) in enumerate(DISTRIBUTION)), "series_share_pct", more=READY)
TWINS["r6_family_context"] = twin(f"""
SELECT p.group_value AS family, issue_count, issue_rate, dominant_issue, f.zero_sales_rate, f.coefficient_of_variation, f.promotion_rate
FROM (SELECT * FROM ({_problems('family')}) ORDER BY issue_count DESC, issue_rate DESC, group_value LIMIT 10) p JOIN families f ON f.family = p.group_value""",
    "issue_rate zero_sales_rate coefficient_of_variation promotion_rate", more=READY.strip() + "," + FAMILIES.strip())
TWINS["r6_store_context"] = twin(f"""
SELECT s.store_nbr, issue_count, issue_rate, dominant_issue, s.average_daily_sales, s.coefficient_of_variation, COALESCE(a.n, 0) AS anomaly_count
FROM (SELECT * FROM ({_problems('store_nbr')}) ORDER BY issue_count DESC, issue_rate DESC, CAST(group_value AS INT) LIMIT 10) p
JOIN stores s ON s.store_nbr = CAST(p.group_value AS INT)
LEFT JOIN (SELECT store_nbr, COUNT(*) AS n FROM anomalies WHERE analysis_level = 'store_day' GROUP BY 1) a ON a.store_nbr = s.store_nbr""",
    "issue_rate average_daily_sales coefficient_of_variation", more=",".join(x.strip() for x in (READY, STORES, ANOMALY)))
TWINS["q35_layer_reconciliation"] = twin("""
SELECT layer, value, expected, abs(value - expected) <= 1e-6 AS passed FROM (
  SELECT 'fact_sales' AS layer, (SELECT SUM(sales) FROM fact_daily_sales) AS value, (SELECT SUM(sales) FROM train) AS expected
  UNION ALL SELECT 'store_report_sales', (SELECT SUM(total_sales) FROM stores), (SELECT SUM(sales) FROM train)
  UNION ALL SELECT 'family_report_sales', (SELECT SUM(total_sales) FROM families), (SELECT SUM(sales) FROM train)
  UNION ALL SELECT 'fact_transactions', (SELECT SUM(transactions) FROM fact_store_transactions), (SELECT SUM(transactions) FROM src_transactions)
  UNION ALL SELECT 'transactions_without_family', 0, 0)""", "value expected", more=STORES.strip() + "," + FAMILIES.strip())

# ------------------------------------------------------------------ dashboard measures
STAR = """
star AS (SELECT f.*, d.full_date, d.year, s.store_nbr, s.state, m.family FROM fact_daily_sales f JOIN dim_date d USING (date_key)
         JOIN dim_store s USING (store_key) JOIN dim_family m USING (family_key))
"""
TWINS["d1_d2_volume_over_time"] = twin("""
WITH x AS (SELECT family, full_date, SUM(sales) AS total_sales FROM star GROUP BY ALL)
SELECT a.family, a.full_date, a.total_sales, AVG(a.total_sales) OVER (PARTITION BY a.family ORDER BY a.full_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sales_7d_moving_average,
       AVG(a.total_sales) OVER (PARTITION BY a.family ORDER BY a.full_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS sales_28d_moving_average,
       (a.total_sales - b.total_sales) / NULLIF(b.total_sales, 0) * 100 AS yoy_growth_pct
FROM x a LEFT JOIN x b ON b.family = a.family AND b.full_date = CAST(a.full_date - INTERVAL 12 MONTH AS DATE)
""", "total_sales sales_7d_moving_average sales_28d_moving_average yoy_growth_pct", more=STAR)
TWINS["d2_d3_volume_and_coverage"] = twin("""
SELECT year, state, SUM(sales) AS total_sales_volume, SUM(sales) / COUNT(DISTINCT date_key) AS average_daily_sales,
       COUNT(DISTINCT store_nbr) FILTER (WHERE sales > 0) AS active_stores, COUNT(DISTINCT family) FILTER (WHERE sales > 0) AS active_families,
       CAST(COUNT(*) FILTER (WHERE sales = 0) AS DOUBLE) / COUNT(*) AS zero_sales_observation_rate FROM star GROUP BY ALL
""", "total_sales_volume average_daily_sales zero_sales_observation_rate", more=STAR)
TWINS["d4_transaction_measures"] = twin("""
SELECT a.year, a.store_nbr, a.n AS total_transactions, CAST(a.n AS DOUBLE) / a.days AS average_daily_transactions, b.s / NULLIF(CAST(a.n AS DOUBLE), 0) AS sales_volume_per_transaction
FROM (SELECT year, store_nbr, CAST(SUM(transactions) AS BIGINT) AS n, COUNT(DISTINCT date_key) AS days FROM fact_store_transactions
      JOIN dim_date USING (date_key) JOIN dim_store USING (store_key) GROUP BY ALL) a
LEFT JOIN (SELECT year, store_nbr, SUM(sales) AS s FROM star GROUP BY ALL) b ON b.year = a.year AND b.store_nbr = a.store_nbr
""", "average_daily_transactions sales_volume_per_transaction", more=STAR)
TWINS["d5_store_momentum"] = twin("""
SELECT store_nbr, r AS recent_90d_sales, p AS previous_90d_sales, (r - p) / NULLIF(p, 0) * 100 AS recent_90d_growth_pct FROM (
  SELECT store_nbr, SUM(sales) FILTER (WHERE full_date BETWEEN e - 89 AND e) AS r, SUM(sales) FILTER (WHERE full_date BETWEEN e - 179 AND e - 90) AS p
  FROM star, (SELECT MAX(full_date) AS e FROM star) GROUP BY 1)""", "recent_90d_sales previous_90d_sales recent_90d_growth_pct", more=STAR)
TWINS["d6_promotion_measures"] = twin("""
SELECT family, AVG(is_promotion) AS promotion_active_observation_rate, SUM(sales) FILTER (WHERE is_promotion = 1) AS promotion_active_sales_volume,
       SUM(sales) FILTER (WHERE is_promotion = 0) AS nonpromotion_sales_volume,
       (AVG(sales) FILTER (WHERE is_promotion = 1) / AVG(sales) FILTER (WHERE is_promotion = 0) - 1) * 100 AS promotion_difference_proxy_pct
FROM star GROUP BY family""", "promotion_active_observation_rate promotion_active_sales_volume nonpromotion_sales_volume promotion_difference_proxy_pct", more=STAR)
TWINS["d7_holiday_measures"] = twin("""
SELECT *, (holiday_average_store_day - regular_average_store_day) / NULLIF(regular_average_store_day, 0) * 100 AS holiday_difference_proxy_pct FROM (
  SELECT state, SUM(total_sales) FILTER (WHERE is_holiday = 1) AS holiday_sales_volume, SUM(total_sales) FILTER (WHERE is_holiday = 0) AS regular_sales_volume,
         AVG(total_sales) FILTER (WHERE is_holiday = 1) AS holiday_average_store_day, AVG(total_sales) FILTER (WHERE is_holiday = 0) AS regular_average_store_day
  FROM store_day JOIN dim_store_date USING (date_key, store_key) JOIN dim_store USING (store_key) GROUP BY state)
""", "holiday_sales_volume regular_sales_volume holiday_average_store_day regular_average_store_day holiday_difference_proxy_pct")
TWINS["d8_oil_measures"] = twin("""
SELECT (SELECT oil_price FROM oil_clean ORDER BY date DESC LIMIT 1) AS latest_oil_price, AVG(oil_price) AS average_oil_price,
       (SELECT oil_change_1d FROM oil_clean ORDER BY date DESC LIMIT 1) AS latest_oil_change_1d,
       (SELECT oil_change_7d FROM oil_clean ORDER BY date DESC LIMIT 1) AS latest_oil_change_7d, CAST(SUM(oil_was_imputed) AS BIGINT) AS imputed_oil_days
FROM oil_clean""", "latest_oil_price average_oil_price latest_oil_change_1d latest_oil_change_7d")
TWINS["d9_readiness_measures"] = twin("""
SELECT store_type, COUNT(*) AS total_series, COUNT(*) FILTER (WHERE readiness_class = 'Ready') AS ready_series,
       CAST(SUM(is_intermittent) AS BIGINT) AS intermittent_series, CAST(SUM(is_promotion_dependent) AS BIGINT) AS promotion_dependent_series,
       CAST(SUM(is_high_volatility) AS BIGINT) AS high_volatility_series,
       CAST(COUNT(*) FILTER (WHERE readiness_class = 'Ready') AS DOUBLE) / COUNT(*) * 100 AS ready_series_pct FROM ready GROUP BY store_type
""", "ready_series_pct", more=READY)
TWINS["d10_anomaly_measures"] = twin("""
SELECT analysis_level, review_category, COUNT(*) AS anomaly_count, SUM(actual_sales) AS actual_sales_volume, SUM(expected_sales) AS expected_sales_volume,
       (SUM(actual_sales) - SUM(expected_sales)) / NULLIF(SUM(expected_sales), 0) * 100 AS baseline_bias_pct FROM anomalies GROUP BY ALL
""", "actual_sales_volume expected_sales_volume baseline_bias_pct", more=ANOMALY)
