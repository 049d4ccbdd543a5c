"""Independent DuckDB statements used to check the Spark results.

``twin(body, doubles, ints)`` puts the shared views in front of a statement, rounds its
double columns to six digits and widens its integer sums, as the Spark side does.
"""

from __future__ import annotations

SOURCES = """
src_stores AS (
  SELECT n_nationkey + 1 AS store_nbr, n_name AS city, r_name AS state,
         substr('ABCDE', n_nationkey % 5 + 1, 1) AS store_type, n_nationkey % 7 + 1 AS cluster
  FROM nation JOIN region ON n_regionkey = r_regionkey),
src_sales AS MATERIALIZED (
  SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey + 1 AS store_nbr, p_type AS family,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS DOUBLE) AS sales,
         CAST(SUM(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS INT) AS onpromotion
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3),
span AS (SELECT MIN(date) AS a, MAX(date) AS z FROM src_sales),
src_transactions AS (
  SELECT CAST(o_orderdate AS DATE) AS date, c_nationkey + 1 AS store_nbr,
         CAST(COUNT(*) AS INT) AS transactions
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
src_oil AS (
  SELECT CAST(o_orderdate AS DATE) AS date, ROUND(AVG(o_totalprice) / 1000, 2) AS dcoilwtico
  FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) <= 5 GROUP BY 1),
years AS (SELECT DISTINCT year(CAST(l_shipdate AS DATE)) AS y FROM lineitem),
src_holidays AS (
  SELECT make_date(y, 1, 1) AS date, 'Holiday' AS type, 'National' AS locale, 'All' AS locale_name, 'New Year' AS description, false AS transferred FROM years
  UNION ALL SELECT make_date(y, 5, 1), 'Holiday', 'National', 'All', 'Labour Day', y % 2 = 0 FROM years
  UNION ALL SELECT make_date(y, 5, 2), 'Transfer', 'National', 'All', 'Labour Day moved', false FROM years WHERE y % 2 = 0
  UNION ALL SELECT make_date(y, 11, 24), 'Event', 'National', 'All', 'Sale Friday', false FROM years
  UNION ALL SELECT make_date(y, 12, 24), 'Bridge', 'National', 'All', 'Bridge day', false FROM years
  UNION ALL SELECT make_date(y, 12, 27), 'Work Day', 'National', 'All', 'Recovery day', false FROM years
  UNION ALL SELECT make_date(y, r_regionkey + 2, 15), 'Additional', 'Regional', r_name, 'Regional day', false FROM years CROSS JOIN region
  UNION ALL SELECT make_date(y, n_nationkey % 12 + 1, 1), 'Holiday', 'Local', n_name, 'Founding day', false FROM years CROSS JOIN nation)
"""

# Cleaned tables and the star schema, stated the SQL way.
WAREHOUSE = """
train AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY date, store_nbr, family) AS id, s.*,
  CASE WHEN onpromotion > 0 THEN 1 ELSE 0 END AS is_promotion FROM src_sales s),
calendar_span AS (SELECT MIN(date) AS a, MAX(date) AS z FROM (SELECT date FROM src_sales UNION ALL SELECT date FROM src_transactions)),
calendar AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM calendar_span),
dim_date AS MATERIALIZED (
  SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date, day(d) AS day,
         isodow(d) - 1 AS day_of_week, dayname(d) AS day_name, weekofyear(d) AS week_of_year,
         month(d) AS month, monthname(d) AS month_name, quarter(d) AS quarter, year(d) AS year,
         CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN day(d) = 1 THEN 1 ELSE 0 END AS is_month_start,
         CASE WHEN d = last_day(d) THEN 1 ELSE 0 END AS is_month_end,
         CASE WHEN day(d) = 15 OR d = last_day(d) THEN 1 ELSE 0 END AS is_payday
  FROM calendar),
dim_store AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY store_nbr) AS store_key, * FROM src_stores),
dim_family AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY family) AS family_key, family
  FROM (SELECT DISTINCT family FROM src_sales)),
event_store AS (
  SELECT h.*, s.store_nbr FROM src_holidays h JOIN src_stores s
    ON h.locale = 'National' OR (h.locale = 'Regional' AND h.locale_name = s.state)
       OR (h.locale = 'Local' AND h.locale_name = s.city)
  WHERE NOT (h.type = 'Holiday' AND h.transferred)),
holiday_days AS MATERIALIZED (
  SELECT date, store_nbr, COUNT(*) AS holiday_count,
         string_agg(DISTINCT description, ' | ' ORDER BY description) AS holiday_descriptions,
         string_agg(DISTINCT type, ' | ' ORDER BY type) AS holiday_types,
         string_agg(DISTINCT locale, ' | ' ORDER BY locale) AS holiday_locales,
         MAX(CASE WHEN type IN ('Holiday', 'Transfer', 'Additional', 'Bridge') THEN 1 ELSE 0 END) AS is_holiday,
         MAX(CASE WHEN type = 'Work Day' THEN 1 ELSE 0 END) AS is_work_day,
         MAX(CASE WHEN type = 'Event' THEN 1 ELSE 0 END) AS is_event
  FROM event_store GROUP BY date, store_nbr),
bridge_store_holiday AS MATERIALIZED (
  SELECT date_key, store_key, h.* EXCLUDE (date, store_nbr) FROM holiday_days h
  JOIN dim_date d ON d.full_date = h.date JOIN dim_store s ON s.store_nbr = h.store_nbr),
fact_daily_sales AS MATERIALIZED (
  SELECT t.id AS sales_id, date_key, store_key, CAST(date_key AS BIGINT) * 2147483648 + store_key AS date_store_key,
         family_key, sales, onpromotion, is_promotion
  FROM train t JOIN dim_date d ON d.full_date = t.date JOIN dim_store s ON s.store_nbr = t.store_nbr
  JOIN dim_family f ON f.family = t.family),
fact_store_transactions AS MATERIALIZED (
  SELECT date_key, store_key, transactions FROM src_transactions t
  JOIN dim_date d ON d.full_date = t.date JOIN dim_store s ON s.store_nbr = t.store_nbr),
dim_store_date AS MATERIALIZED (
  SELECT CAST(d.date_key AS BIGINT) * 2147483648 + s.store_key AS date_store_key, d.date_key, s.store_key,
         COALESCE(b.holiday_count, 0) AS holiday_count,
         COALESCE(b.holiday_descriptions, '') AS holiday_descriptions,
         COALESCE(b.holiday_types, '') AS holiday_types, COALESCE(b.holiday_locales, '') AS holiday_locales,
         COALESCE(b.is_holiday, 0) AS is_holiday, COALESCE(b.is_work_day, 0) AS is_work_day,
         COALESCE(b.is_event, 0) AS is_event,
         CASE WHEN f.date_key IS NULL THEN 0 ELSE 1 END AS has_sales_observation,
         CASE WHEN t.date_key IS NULL THEN 0 ELSE 1 END AS has_transaction_observation
  FROM dim_date d CROSS JOIN dim_store s
  LEFT JOIN bridge_store_holiday b ON b.date_key = d.date_key AND b.store_key = s.store_key
  LEFT JOIN (SELECT DISTINCT date_key, store_key FROM fact_daily_sales) f
    ON f.date_key = d.date_key AND f.store_key = s.store_key
  LEFT JOIN fact_store_transactions t ON t.date_key = d.date_key AND t.store_key = s.store_key),
oil_days AS (SELECT d, date_diff('day', DATE '1970-01-01', d) AS n, dcoilwtico AS p
  FROM calendar LEFT JOIN src_oil ON src_oil.date = d),
oil_near AS (SELECT d, n, p,
  (SELECT MAX(k.n) FROM oil_days k WHERE k.p IS NOT NULL AND k.n <= o.n) AS n0,
  (SELECT MIN(k.n) FROM oil_days k WHERE k.p IS NOT NULL AND k.n >= o.n) AS n1 FROM oil_days o),
oil_filled AS (
  SELECT o.d AS date, CASE WHEN o.p IS NOT NULL THEN o.p
    WHEN n0 IS NOT NULL AND n1 IS NOT NULL THEN a.p + (b.p - a.p) * (CAST(o.n - n0 AS DOUBLE) / (n1 - n0))
    ELSE COALESCE(a.p, b.p) END AS oil_price, CASE WHEN o.p IS NULL THEN 1 ELSE 0 END AS oil_was_imputed
  FROM oil_near o LEFT JOIN oil_days a ON a.n = n0 LEFT JOIN oil_days b ON b.n = n1),
oil_clean AS MATERIALIZED (
  SELECT date, oil_price, oil_was_imputed,
         oil_price - LAG(oil_price) OVER (ORDER BY date) AS oil_change_1d,
         oil_price - LAG(oil_price, 7) OVER (ORDER BY date) AS oil_change_7d,
         oil_price / NULLIF(LAG(oil_price, 7) OVER (ORDER BY date), 0) - 1 AS oil_pct_change_7d
  FROM oil_filled),
fact_oil_price AS (SELECT date_key, oil_clean.* EXCLUDE (date) FROM oil_clean
  JOIN dim_date ON full_date = date),
store_day AS MATERIALIZED (SELECT date_key, store_key, SUM(sales) AS total_sales
  FROM fact_daily_sales GROUP BY ALL)
"""

MARTS = """
daily_store_performance AS (
  SELECT d.full_date, f.date_key, s.store_nbr, s.city, s.state, s.store_type, s.cluster,
         f.total_sales, f.p AS sales_on_promotion_active_rows, f.q AS sales_on_nonpromotion_rows,
         f.promoted_item_count, f.p / NULLIF(f.total_sales, 0) AS promotion_active_sales_share_proxy,
         t.transactions, f.total_sales / NULLIF(CAST(t.transactions AS DOUBLE), 0) AS sales_volume_per_transaction
  FROM (SELECT date_key, store_key, SUM(sales) AS total_sales,
               COALESCE(SUM(sales) FILTER (WHERE is_promotion = 1), 0) AS p,
               COALESCE(SUM(sales) FILTER (WHERE is_promotion = 0), 0) AS q,
               CAST(SUM(onpromotion) AS BIGINT) AS promoted_item_count
        FROM fact_daily_sales GROUP BY ALL) f
  JOIN dim_date d USING (date_key) JOIN dim_store s USING (store_key)
  LEFT JOIN fact_store_transactions t ON t.date_key = f.date_key AND t.store_key = f.store_key),
family_performance AS (
  SELECT *, (avg_sales_promo - avg_sales_nonpromo) / NULLIF(avg_sales_nonpromo, 0) * 100 AS promotion_uplift_proxy_pct
  FROM (SELECT d.year, d.month, m.family, SUM(sales) AS total_sales, AVG(sales) AS average_sales,
               quantile_cont(sales, 0.5) AS median_sales, stddev_samp(sales) AS sales_std,
               CAST(COUNT(*) FILTER (WHERE sales = 0) AS DOUBLE) / COUNT(*) AS zero_sales_rate,
               CAST(COUNT(*) FILTER (WHERE is_promotion = 1) AS DOUBLE) / COUNT(*) AS promotion_rate,
               AVG(sales) FILTER (WHERE is_promotion = 1) AS avg_sales_promo,
               AVG(sales) FILTER (WHERE is_promotion = 0) AS avg_sales_nonpromo,
               COUNT(*) FILTER (WHERE is_promotion = 1) AS promo_observation_count,
               COUNT(*) FILTER (WHERE is_promotion = 0) AS nonpromo_observation_count
        FROM fact_daily_sales JOIN dim_date d USING (date_key) JOIN dim_family m USING (family_key) GROUP BY ALL)),
store_performance AS (
  SELECT s.store_nbr, s.city, s.state, s.store_type, s.cluster, a.total_sales, a.average_daily_sales, a.sales_std,
         a.active_days, b.total_transactions,
         a.total_sales / NULLIF(CAST(b.total_transactions AS DOUBLE), 0) AS sales_volume_per_transaction
  FROM (SELECT store_key, SUM(total_sales) AS total_sales, AVG(total_sales) AS average_daily_sales,
               stddev_samp(total_sales) AS sales_std, COUNT(*) AS active_days FROM store_day GROUP BY store_key) a
  JOIN dim_store s USING (store_key)
  LEFT JOIN (SELECT store_key, CAST(SUM(transactions) AS BIGINT) AS total_transactions
             FROM fact_store_transactions GROUP BY store_key) b USING (store_key)),
holiday_performance AS (
  SELECT d.full_date, s.store_nbr, h.is_holiday, h.is_work_day, h.is_event, h.holiday_count, h.holiday_types,
         f.total_sales, CAST(t.transactions AS BIGINT) AS transactions
  FROM bridge_store_holiday h JOIN dim_date d USING (date_key) JOIN dim_store s USING (store_key)
  LEFT JOIN store_day f ON f.date_key = h.date_key AND f.store_key = h.store_key
  LEFT JOIN fact_store_transactions t ON t.date_key = h.date_key AND t.store_key = h.store_key),
seasonality AS (
  SELECT year, month, day_of_week, day_name, is_weekend, is_payday, SUM(s) AS total_sales,
         AVG(s) AS average_daily_sales, stddev_samp(s) AS sales_std, COUNT(*) AS active_days,
         CAST(SUM(n) AS BIGINT) AS total_transactions,
         SUM(s) / NULLIF(CAST(SUM(n) AS DOUBLE), 0) AS sales_volume_per_transaction
  FROM (SELECT date_key, SUM(sales) AS s FROM fact_daily_sales GROUP BY 1) a
  LEFT JOIN (SELECT date_key, SUM(transactions) AS n FROM fact_store_transactions GROUP BY 1) b USING (date_key)
  JOIN dim_date USING (date_key) GROUP BY ALL)
"""

ROLLED = """
rollup AS MATERIALIZED (
  SELECT date, 101 + n_regionkey AS store_nbr, 'ALL' AS family, SUM(sales) AS sales, CAST(SUM(onpromotion) AS INT) AS onpromotion
  FROM src_sales JOIN nation ON store_nbr = n_nationkey + 1 GROUP BY date, n_regionkey
  UNION ALL
  SELECT date, 100, family, SUM(sales), CAST(SUM(onpromotion) AS INT) FROM src_sales GROUP BY date, family),
r_stores AS (
  SELECT 101 + r_regionkey AS store_nbr, 'ALL' AS city, r_name AS state, 'A' AS store_type, 1 AS cluster FROM region
  UNION ALL SELECT 100, 'ALL', 'ALL', 'B', 2),
"""
SPLIT = """
r_train AS MATERIALIZED (SELECT r.* FROM rollup r, span WHERE date_diff('day', r.date, z) >= 16),
r_future AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER (ORDER BY d.date, s.store_nbr, s.family) AS id, d.date, s.store_nbr, s.family,
         COALESCE(r.onpromotion, 0) AS onpromotion
  FROM (SELECT DISTINCT date FROM src_sales, span WHERE date_diff('day', date, z) < 16) d
  CROSS JOIN (SELECT DISTINCT store_nbr, family FROM rollup) s
  LEFT JOIN rollup r ON r.date = d.date AND r.store_nbr = s.store_nbr AND r.family = s.family)
"""

LAYERS = {"sources": SOURCES, "warehouse": WAREHOUSE, "marts": MARTS, "rollup": ROLLED + SPLIT.lstrip()}


def twin(body: str, doubles: str = "", ints: str = "", layers: str = "sources warehouse",
         more: str = "") -> str:
    """Full statement: shared views, extra views, body, then column rounding."""
    views = ",".join(LAYERS[layer].strip() for layer in layers.split())
    if more:
        views += "," + more.strip()
    changes = [f"ROUND(CAST({c} AS DOUBLE), 6) AS {c}" for c in doubles.split()]
    changes += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    replace = f" REPLACE ({', '.join(changes)})" if changes else ""
    return f"WITH {views}\nSELECT *{replace} FROM (\n{body.strip()}\n) AS result"
