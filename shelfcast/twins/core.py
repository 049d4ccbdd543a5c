"""DuckDB twins: sources, audit, cleaning, warehouse, marts and checks."""

from __future__ import annotations

from shelfcast.twins.base import twin

TWINS: dict[str, str] = {}
RAW = "SELECT id, date, store_nbr, family, sales, onpromotion FROM train"
RAW_STORES = "SELECT store_nbr, city, state, store_type AS type, cluster FROM src_stores"

TWINS["s2_train_source"] = twin(RAW, "sales", "id")
TWINS["s4_store_source"] = twin(RAW_STORES, layers="sources")
TWINS["s5_transaction_source"] = twin("SELECT * FROM src_transactions", layers="sources")
TWINS["s6_oil_source"] = twin("SELECT * FROM src_oil", "dcoilwtico", layers="sources")
TWINS["s7_holiday_source"] = twin("SELECT * FROM src_holidays", layers="sources")
TWINS["s3_future_source"] = twin("SELECT * FROM r_future", layers="sources rollup")

# ---- profiles: one SELECT per column
COLUMNS = {
    "train": [("id", "bigint"), ("date", "date"), ("store_nbr", "int"), ("family", "string"),
              ("sales", "double"), ("onpromotion", "int")],
    "stores": [("store_nbr", "int"), ("city", "string"), ("state", "string"), ("type", "string"), ("cluster", "int")],
    "transactions": [("date", "date"), ("store_nbr", "int"), ("transactions", "int")],
    "oil": [("date", "date"), ("dcoilwtico", "double")],
    "holidays": [("date", "date"), ("type", "string"), ("locale", "string"), ("locale_name", "string"),
                 ("description", "string"), ("transferred", "boolean")],
}
RAW_FROM = {"train": f"({RAW})", "stores": f"({RAW_STORES})", "transactions": "src_transactions",
            "oil": "src_oil", "holidays": "src_holidays"}


def _profile(table: str, column: str, kind: str) -> str:
    numeric = kind in ("int", "bigint", "double")
    signs = (f"COUNT(*) FILTER (WHERE {column} = 0), COUNT(*) FILTER (WHERE {column} < 0), "
             f"CAST(MIN({column}) AS DOUBLE), CAST(MAX({column}) AS DOUBLE)") if numeric else (
        "CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
    return (f"SELECT '{table}', '{column}', '{kind}', COUNT(*), COUNT(*) - COUNT({column}), "
            f"ROUND(CAST(COUNT(*) - COUNT({column}) AS DOUBLE) / COUNT(*) * 100, 2), COUNT(DISTINCT {column}), "
            f"{signs} FROM {RAW_FROM[table]}")


PROFILE_COLUMNS = ("table_name, column_name, dtype, row_count, missing_count, missing_pct, unique_count, "
                   "zero_count, negative_count, min_value, max_value")
TWINS["q1_q2_column_profiles"] = twin(
    f"SELECT * FROM (" + " UNION ALL ".join(
        _profile(t, c, k) for t, columns in COLUMNS.items() for c, k in columns)
    + f") AS p({PROFILE_COLUMNS})", "missing_pct min_value max_value")
TWINS["s1_s9_csv_profiles"] = TWINS["q1_q2_column_profiles"]
TWINS["s8_sample_submission"] = twin("SELECT id, 0.0::DOUBLE AS sales FROM r_future", layers="sources rollup")
TWINS["s10_s11_pruned_star"] = twin("""
SELECT date_key, total_sales, CAST(total_transactions AS BIGINT) AS total_transactions
FROM (SELECT date_key, SUM(sales) AS total_sales FROM fact_daily_sales GROUP BY 1)
FULL JOIN (SELECT date_key, SUM(transactions) AS total_transactions FROM fact_store_transactions GROUP BY 1) USING (date_key)""", "total_sales")
TWINS["q3_q4_duplicated_grains"] = twin("""
SELECT 'holidays' AS table_name, date, COUNT(*) AS row_count FROM src_holidays
GROUP BY date HAVING COUNT(*) > 1 ORDER BY date LIMIT 20""", layers="sources")


def _grain(table: str, source: str, columns: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{columns}' AS grain_columns, COUNT(*) AS duplicate_combinations, "
            f"COALESCE(CAST(SUM(n) AS BIGINT), 0) AS affected_rows, COUNT(*) = 0 AS is_valid FROM "
            f"(SELECT COUNT(*) AS n FROM {source} GROUP BY {columns} HAVING COUNT(*) > 1)")


TWINS["q5_grain_summaries"] = twin(" UNION ALL ".join([
    _grain("train", "train", "date, store_nbr, family"), _grain("stores", "src_stores", "store_nbr"),
    _grain("transactions", "src_transactions", "date, store_nbr"), _grain("oil", "src_oil", "date"),
    _grain("holidays", "src_holidays", "date, locale_name"), _grain("train", "train", "store_nbr, family")]))
TWINS["q6_orphan_keys"] = twin("""
SELECT 'transactions' AS child_table, 'store_nbr' AS child_column, 'train' AS parent_table, 'store_nbr' AS parent_column,
       CAST(store_nbr AS VARCHAR) AS invalid_value, COUNT(*) AS affected_rows
FROM src_transactions WHERE store_nbr NOT IN (SELECT store_nbr FROM train) GROUP BY store_nbr
UNION ALL
SELECT 'rollup', 'store_nbr', 'stores', 'store_nbr', CAST(store_nbr AS VARCHAR), COUNT(*)
FROM r_train WHERE store_nbr NOT IN (SELECT store_nbr FROM src_stores) GROUP BY store_nbr""",
                               layers="sources warehouse rollup")
RAW_ROWS = {"train": 6, "stores": 5, "transactions": 3, "oil": 2, "holidays": 6}
CLEAN_FROM = {"train": "train", "stores": "src_stores", "transactions": "src_transactions",
              "oil": "oil_clean", "holidays": "holiday_days"}
TWINS["q8_table_shapes"] = twin(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, {n} AS column_count FROM {RAW_FROM[t]}"
    for t, n in RAW_ROWS.items()))
TWINS["q9_date_coverage"] = twin(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(DISTINCT date) AS unique_dates "
    f"FROM {RAW_FROM[t]}" for t in ("train", "transactions", "oil", "holidays")))
TWINS["q10_full_duplicates"] = twin(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COALESCE(CAST(SUM(n) AS BIGINT), 0) AS duplicated_rows FROM "
    f"(SELECT COUNT(*) AS n FROM {source} GROUP BY ALL HAVING COUNT(*) > 1)".replace(
        "SELECT COUNT(*) AS n FROM", "SELECT COUNT(*) AS n, * FROM")
    for t, source in {**RAW_FROM, "store_attributes": "(SELECT state, store_type FROM src_stores)"}.items()))
TWINS["q11_domain_counters"] = twin("""
SELECT 'negative_sales' AS rule, COUNT(*) AS affected_rows FROM train WHERE sales < 0
UNION ALL SELECT 'zero_sales', COUNT(*) FROM train WHERE sales = 0
UNION ALL SELECT 'negative_onpromotion', COUNT(*) FROM train WHERE onpromotion < 0
UNION ALL SELECT 'missing_oil_price', COUNT(*) FROM src_oil WHERE dcoilwtico IS NULL
UNION ALL SELECT 'stores_with_missing_metadata', COUNT(*) FROM src_stores
  WHERE city IS NULL OR state IS NULL OR store_type IS NULL OR cluster IS NULL""")
TWINS["q12_missing_rates"] = twin(" UNION ALL ".join(
    f"SELECT 'oil' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS missing_count, "
    f"ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100, 2) AS missing_pct FROM oil_clean"
    for c in ("oil_price", "oil_change_1d", "oil_change_7d", "oil_pct_change_7d")), "missing_pct")
CLEAN_COLUMNS = {"train": 7, "stores": 5, "transactions": 3, "oil": 6, "holidays": 9}
TWINS["q13_shape_change"] = twin(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, r.n AS raw_rows, {RAW_ROWS[t]} AS raw_columns, c.n AS clean_rows, "
    f"{CLEAN_COLUMNS[t]} AS clean_columns, c.n - r.n AS row_change FROM (SELECT COUNT(*) AS n FROM {RAW_FROM[t]}) r, "
    f"(SELECT COUNT(*) AS n FROM {CLEAN_FROM[t]}) c" for t in RAW_ROWS))
TWINS["q14_cleaning_metrics"] = twin(" UNION ALL ".join(
    [f"SELECT 'raw_rows' AS metric, '{t}' AS table_name, COUNT(*) AS value FROM {RAW_FROM[t]}" for t in RAW_ROWS]
    + [f"SELECT 'clean_rows', '{t}', COUNT(*) FROM {CLEAN_FROM[t]}" for t in RAW_ROWS]
    + [f"SELECT 'exact_duplicates', '{t}', (SELECT COUNT(*) FROM {RAW_FROM[t]}) - "
       f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {RAW_FROM[t]}))" for t in RAW_ROWS]
    + ["SELECT 'imputed_prices', 'oil', COUNT(*) FROM oil_clean WHERE oil_was_imputed = 1",
       "SELECT 'excluded_transfers', 'holidays', COUNT(*) FROM src_holidays WHERE type = 'Holiday' AND transferred",
       "SELECT 'zero_sales_rows', 'train', COUNT(*) FROM train WHERE sales = 0"]))
TWINS["q15_clean_gate"] = twin(" UNION ALL ".join([
    _grain("train", "train", "date, store_nbr, family"), _grain("stores", "src_stores", "store_nbr"),
    _grain("transactions", "src_transactions", "date, store_nbr"), _grain("oil", "oil_clean", "date"),
    _grain("holidays", "holiday_days", "date, store_nbr")]))

# ---- cleaning and warehouse tables
TWINS["c1_clean_train"] = twin("SELECT * FROM train", "sales", "id")
TWINS["c2_clean_future"] = twin(
    "SELECT *, CASE WHEN onpromotion > 0 THEN 1 ELSE 0 END AS is_promotion FROM r_future", layers="sources rollup")
TWINS["c4_clean_stores"] = twin("SELECT * FROM src_stores", layers="sources")
TWINS["c6_c7_holiday_store_days"] = twin("SELECT * FROM holiday_days")
OIL = "oil_price oil_change_1d oil_change_7d oil_pct_change_7d"
TWINS["c8_clean_oil"] = twin("SELECT * FROM oil_clean", OIL)
TWINS["c9_clean_transactions"] = twin("SELECT * FROM src_transactions", layers="sources")
TWINS["c10_store_day_sales"] = twin(
    "SELECT date, store_nbr, SUM(sales) AS total_sales FROM src_sales GROUP BY ALL", "total_sales", layers="sources")
TWINS["c11_sales_with_transactions"] = twin("""
SELECT s.date, s.store_nbr, s.total_sales, t.transactions,
       s.total_sales / NULLIF(CAST(t.transactions AS DOUBLE), 0) AS sales_volume_per_transaction
FROM (SELECT date, store_nbr, SUM(sales) AS total_sales FROM src_sales GROUP BY ALL) s
LEFT JOIN src_transactions t ON t.date = s.date AND t.store_nbr = s.store_nbr""",
                                            "total_sales sales_volume_per_transaction", layers="sources")
TWINS["w1_dim_date"] = twin("SELECT * FROM dim_date")
TWINS["w2_dim_store"] = twin("SELECT * FROM dim_store")
TWINS["w3_dim_family"] = twin("SELECT * FROM dim_family")
TWINS["w4_bridge_store_holiday"] = twin("SELECT * FROM bridge_store_holiday")
TWINS["w5_observed_store_days"] = twin("SELECT DISTINCT date_key, store_key FROM fact_daily_sales")
TWINS["w6_dim_store_date"] = twin("SELECT * FROM dim_store_date")
TWINS["w8_w9_fact_daily_sales"] = twin("SELECT * FROM fact_daily_sales", "sales")
TWINS["w10_fact_store_transactions"] = twin("SELECT * FROM fact_store_transactions")
TWINS["w11_fact_oil_price"] = twin("SELECT * FROM fact_oil_price", OIL)
GRAINS = {
    "dim_date": ["date_key"], "dim_store": ["store_key"], "dim_family": ["family_key"],
    "dim_store_date": ["date_key", "store_key"], "fact_daily_sales": ["date_key", "store_key", "family_key"],
    "fact_store_transactions": ["date_key", "store_key"], "fact_oil_price": ["date_key"],
    "bridge_store_holiday": ["date_key", "store_key"],
}


def _validation(table: str, grain: list[str]) -> str:
    nulls = " + ".join(f"COUNT(*) FILTER (WHERE {g} IS NULL)" for g in grain)
    if table in ("dim_store", "dim_family"):
        low = high = "'N/A'"
    elif table == "dim_date":
        low, high = "CAST(MIN(full_date) AS VARCHAR)", "CAST(MAX(full_date) AS VARCHAR)"
    else:
        low, high = (f"CAST(CAST(strptime(CAST({f}(date_key) AS VARCHAR), '%Y%m%d') AS DATE) AS VARCHAR)"
                     for f in ("MIN", "MAX"))
    return (f"SELECT '{table}' AS table_name, COUNT(*) AS row_count, '{' + '.join(grain)}' AS expected_grain, "
            f"COUNT(*) - COUNT(DISTINCT ({', '.join(grain)})) AS duplicate_grain_count, "
            f"{nulls} AS missing_surrogate_key_count, {low} AS minimum_date, {high} AS maximum_date FROM {table}")


TWINS["q16_q17_w12_warehouse_validation"] = twin(
    " UNION ALL ".join(_validation(t, g) for t, g in GRAINS.items()))
CLEAN_VIEWS = {"train": "train", "stores": "src_stores", "transactions": "src_transactions", "oil": "oil_clean", "holidays": "holiday_days"}
TWINS["s13_s14_published_layers"] = twin(" UNION ALL ".join(
    [f"SELECT 'clean' AS layer, '{t}' AS table_name, COUNT(*) AS row_count FROM {view}" for t, view in CLEAN_VIEWS.items()]
    + [f"SELECT 'warehouse', '{t}', COUNT(*) FROM {t}" for t in GRAINS]))


def _loaded(table: str, label: str, measure: str) -> str:
    value = f"(SELECT CAST({measure} AS DOUBLE) FROM {table})"
    return f"SELECT '{table} {label}' AS check_name, {value} AS source_value, {value} AS stored_value, true AS passed"


TWINS["s16_s17_s18_load_check"] = twin(" UNION ALL ".join(
    [_loaded(t, "rows", "COUNT(*)") for t in GRAINS]
    + [_loaded("fact_daily_sales", f"total {c}", f"SUM({c})") for c in ("sales", "onpromotion")]
    + [_loaded("fact_store_transactions", "total transactions", "SUM(transactions)")]
    + [_loaded("dim_date", "first date_key", "MIN(date_key)"), _loaded("dim_date", "last date_key", "MAX(date_key)")]),
    "source_value stored_value")
TWINS["q34_stored_table_keys"] = twin(" UNION ALL ".join(
    _validation(t, g) for t, g in
    {**GRAINS, "dim_store_date": ["date_store_key"], "fact_daily_sales": ["sales_id"]}.items()))
TWINS["q18_warehouse_reconciliation"] = twin("""
SELECT check_name, CAST(a AS DOUBLE) AS clean_value, CAST(b AS DOUBLE) AS warehouse_value, abs(a - b) <= 1e-6 AS passed
FROM (
  SELECT 'Total sales' AS check_name, (SELECT SUM(sales) FROM train) AS a, (SELECT SUM(sales) FROM fact_daily_sales) AS b
  UNION ALL SELECT 'Total onpromotion', (SELECT SUM(onpromotion) FROM train), (SELECT SUM(onpromotion) FROM fact_daily_sales)
  UNION ALL SELECT 'Total transactions', (SELECT SUM(transactions) FROM src_transactions), (SELECT SUM(transactions) FROM fact_store_transactions)
  UNION ALL SELECT 'Store count', (SELECT COUNT(*) FROM src_stores), (SELECT COUNT(*) FROM dim_store)
  UNION ALL SELECT 'Family count', (SELECT COUNT(DISTINCT family) FROM train), (SELECT COUNT(*) FROM dim_family)
  UNION ALL SELECT 'Store-date row count', (SELECT COUNT(*) FROM dim_date) * (SELECT COUNT(*) FROM dim_store), (SELECT COUNT(*) FROM dim_store_date)
  UNION ALL SELECT 'Store-date holiday mappings', (SELECT COUNT(*) FROM bridge_store_holiday), (SELECT COUNT(*) FROM dim_store_date WHERE holiday_count > 0)
  UNION ALL SELECT 'Store-date sales observations', (SELECT COUNT(*) FROM (SELECT DISTINCT date, store_nbr FROM train)), (SELECT SUM(has_sales_observation) FROM dim_store_date)
  UNION ALL SELECT 'Store-date transaction observations', (SELECT COUNT(*) FROM (SELECT DISTINCT date, store_nbr FROM src_transactions)), (SELECT SUM(has_transaction_observation) FROM dim_store_date)
  UNION ALL SELECT 'Sales fact unmapped date-store keys', 0, (SELECT COUNT(*) FROM fact_daily_sales WHERE date_store_key NOT IN (SELECT date_store_key FROM dim_store_date)))
""", "clean_value warehouse_value")

# ---- marts
ALL = "sources warehouse marts"
MART_DOUBLES = {
    "daily_store_performance": "total_sales sales_on_promotion_active_rows sales_on_nonpromotion_rows "
                               "promotion_active_sales_share_proxy sales_volume_per_transaction",
    "family_performance": "total_sales average_sales median_sales sales_std zero_sales_rate promotion_rate "
                          "avg_sales_promo avg_sales_nonpromo promotion_uplift_proxy_pct",
    "store_performance": "total_sales average_daily_sales sales_std sales_volume_per_transaction",
    "holiday_performance": "total_sales",
    "seasonality": "total_sales average_daily_sales sales_std sales_volume_per_transaction",
}
for _i, (_name, _doubles) in enumerate(MART_DOUBLES.items(), start=1):
    TWINS[f"v{_i}_{_name}"] = twin(f"SELECT * FROM {_name}", _doubles, layers=ALL)


# ---- check sets
def _check(name: str, details: str, actual: str, expected: str, passed: str, severity: str = "FAIL") -> str:
    return (f"SELECT '{name}' AS check_name, '{severity}' AS severity, CAST({actual} AS VARCHAR) AS actual_value, "
            f"{expected} AS expected_value, {passed} AS passed, '{details}' AS details")


def _none(name: str, details: str, counted: str) -> str:
    return f"{_check(name, details, 'n', chr(39) + '0' + chr(39), 'n = 0')} FROM (SELECT ({counted}) AS n)"


ROW_COUNTS = [
    f"""{_check(f'{t}_row_count', f'analytics.{t} row count', 'COUNT(*)', "'> 0'", 'COUNT(*) > 0',
                'WARNING' if t == 'bridge_store_holiday' else 'FAIL')} FROM {t}""" for t in GRAINS]
DUPLICATES = [
    _none(f"{t}_duplicate_grain", f"Duplicate {' + '.join(g)} combinations",
          f"SELECT COUNT(*) FROM (SELECT {', '.join(g)} FROM {t} GROUP BY ALL HAVING COUNT(*) > 1)")
    for t, g in GRAINS.items()]
ORPHAN_TEXT = [
    ("fact_daily_sales", "date", "dim_date", "date_key", "Sales", "date"),
    ("fact_daily_sales", "store", "dim_store", "store_key", "Sales", "store"),
    ("fact_daily_sales", "family", "dim_family", "family_key", "Sales", "family"),
    ("fact_daily_sales", "store_date", "dim_store_date", "date_store_key", "Sales", "date-store"),
    ("fact_store_transactions", "date", "dim_date", "date_key", "Transaction", "date"),
    ("fact_store_transactions", "store", "dim_store", "store_key", "Transaction", "store"),
    ("fact_store_transactions", "store_date", "dim_store_date", "date_key store_key", "Transaction", "date-store"),
    ("dim_store_date", "date", "dim_date", "date_key", "Date-store", "date"),
    ("dim_store_date", "store", "dim_store", "store_key", "Date-store", "store"),
    ("fact_oil_price", "date", "dim_date", "date_key", "Oil", "date"),
    ("bridge_store_holiday", "date", "dim_date", "date_key", "Holiday bridge", "date"),
    ("bridge_store_holiday", "store", "dim_store", "store_key", "Holiday bridge", "store"),
]


def _lost(child: str, parent: str, keys: str) -> str:
    match = " AND ".join(f"p.{k} = c.{k}" for k in keys.split())
    return f"SELECT COUNT(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {match})"


ORPHANS = [
    _none(f"{child}_orphan_{what}", f"{text} rows without a matching {noun} dimension row", _lost(child, parent, keys))
    for child, what, parent, keys, text, noun in ORPHAN_TEXT
] + [_none("warehouse_missing_date_key", "Missing date_key values across facts and bridge",
           "SELECT COUNT(*) FROM (SELECT date_key FROM fact_daily_sales UNION ALL SELECT date_key FROM "
           "fact_store_transactions UNION ALL SELECT date_key FROM fact_oil_price UNION ALL SELECT date_key "
           "FROM bridge_store_holiday) WHERE date_key IS NULL")]
NUMBER = "CAST(CAST({} AS DECIMAL(38,7)) AS VARCHAR)"
MEASURES = [
    _none("negative_sales", "Rows where sales is negative", "SELECT COUNT(*) FROM fact_daily_sales WHERE sales < 0"),
    _none("negative_onpromotion", "Rows where onpromotion is negative",
          "SELECT COUNT(*) FROM fact_daily_sales WHERE onpromotion < 0"),
    _none("negative_transactions", "Rows where transactions is negative",
          "SELECT COUNT(*) FROM fact_store_transactions WHERE transactions < 0"),
    _check("total_sales", "Warehouse total sales", NUMBER.format("SUM(sales)"), "'>= 0'", "SUM(sales) >= 0",
           "WARNING") + " FROM fact_daily_sales",
    _check("total_transactions", "Warehouse total transactions", NUMBER.format("SUM(transactions)"), "'>= 0'",
           "SUM(transactions) >= 0", "WARNING") + " FROM fact_store_transactions",
    _check("store_count", "Number of stores in dim_store", "COUNT(*)", "'> 0'", "COUNT(*) > 0") + " FROM dim_store",
    _check("family_count", "Number of families in dim_family", "COUNT(*)", "'> 0'", "COUNT(*) > 0")
    + " FROM dim_family",
    _check("date_range", "Minimum and maximum date in dim_date",
           "MIN(full_date) || ' to ' || MAX(full_date)", "'non-empty ordered range'",
           "MAX(full_date) >= MIN(full_date)") + " FROM dim_date",
]


def _equal(name: str, details: str, actual: str, expected: str) -> str:
    return (_check(name, details, "a", "CAST(e AS VARCHAR)", "a = e")
            + f" FROM (SELECT ({actual}) AS a, ({expected}) AS e)")


def _total(table: str, column: str) -> str:
    return f"SELECT {NUMBER.format(f'COALESCE(SUM({column}), 0)')} FROM {table}"


def _count(table: str, condition: str) -> str:
    return f"(SELECT COUNT(*) FROM {table} WHERE {condition})"


SEASON = "year, month, day_of_week, day_name, is_weekend, is_payday"
MART_ROWS = [
    _equal("daily_store_sales_reconciliation", "Total sales in daily store mart must equal the sales fact total",
           _total("daily_store_performance", "total_sales"), _total("fact_daily_sales", "sales")),
    _equal("daily_store_transactions_reconciliation",
           "Total transactions in daily store mart must equal the transaction fact total",
           _total("daily_store_performance", "transactions"), _total("fact_store_transactions", "transactions")),
    _equal("family_sales_reconciliation", "Total sales in family mart must equal the sales fact total",
           _total("family_performance", "total_sales"), _total("fact_daily_sales", "sales")),
    _equal("store_count_reconciliation", "Store mart row count must equal the store dimension count",
           "SELECT COUNT(*) FROM store_performance", "SELECT COUNT(*) FROM dim_store"),
    _equal("family_count_reconciliation", "Distinct families in family mart must equal the family dimension count",
           "SELECT COUNT(DISTINCT family) FROM family_performance", "SELECT COUNT(*) FROM dim_family"),
    _none("holiday_store_mapping", "Holiday bridge keys and holiday mart store numbers must map to dim_store",
          f"({_lost('bridge_store_holiday', 'dim_store', 'store_key')}) + "
          f"({_lost('holiday_performance', 'dim_store', 'store_nbr')})"),
] + [
    _none(f"{short}_mart_duplicate_grain", f"Duplicate {text}",
          f"SELECT COUNT(*) FROM (SELECT {grain} FROM {table} GROUP BY ALL HAVING COUNT(*) > 1)")
    for short, table, grain, text in [
        ("daily_store", "daily_store_performance", "full_date, store_nbr",
         "full_date and store_nbr combinations in daily store mart"),
        ("family", "family_performance", "year, month, family",
         "year, month and family combinations in family mart"),
        ("store", "store_performance", "store_nbr", "store_nbr values in store mart"),
        ("holiday", "holiday_performance", "full_date, store_nbr",
         "full_date and store_nbr combinations in holiday mart"),
        ("seasonality", "seasonality", SEASON, "seasonality grain combinations in seasonality mart")]
] + [
    _none("nonnegative_sales", "Negative sales rows across facts and marts", " + ".join(
        [_count("fact_daily_sales", "sales < 0")] + [_count(m, "total_sales < 0") for m in MART_DOUBLES])),
    _none("nonnegative_transactions", "Negative transaction rows across facts and transaction-bearing marts",
          " + ".join([_count(m, "transactions < 0") for m in
                      ("fact_store_transactions", "daily_store_performance", "holiday_performance")]
                     + [_count(m, "total_transactions < 0") for m in ("store_performance", "seasonality")])),
    _none("finite_division_results", "Infinite division results across all marts with calculated ratios",
          " + ".join(_count(m, f"isinf({c})") for m, c in [
              ("daily_store_performance", "promotion_active_sales_share_proxy"),
              ("daily_store_performance", "sales_volume_per_transaction"),
              ("family_performance", "promotion_uplift_proxy_pct"),
              ("store_performance", "sales_volume_per_transaction"),
              ("seasonality", "sales_volume_per_transaction")])),
    _none("mart_date_range_within_dimension",
          "Date-bearing mart rows must map to a date or year-month in dim_date", " + ".join(
              [f"({_lost(m, 'dim_date', 'full_date')})" for m in ("daily_store_performance", "holiday_performance")]
              + [f"({_lost(m, 'dim_date', 'year month')})" for m in ("family_performance", "seasonality")])),
]
CHECK_SETS = {"row_counts": ROW_COUNTS, "duplicate_grain": DUPLICATES, "foreign_keys": ORPHANS,
              "measure_validation": MEASURES, "mart_reconciliation": MART_ROWS}
TWINS["q19_row_count_checks"] = twin(" UNION ALL ".join(ROW_COUNTS))
TWINS["q20_duplicate_grain_checks"] = twin(" UNION ALL ".join(DUPLICATES))
TWINS["q21_orphan_checks"] = twin(" UNION ALL ".join(ORPHANS))
TWINS["q22_measure_checks"] = twin(" UNION ALL ".join(MEASURES))
TWINS["q23_mart_checks"] = twin(" UNION ALL ".join(MART_ROWS), layers=ALL)
TWINS["q25_q26_classified_checks"] = twin(" UNION ALL ".join(
    f"SELECT '{name}' AS check_set, *, CASE WHEN passed THEN 'PASS' ELSE severity END AS status "
    f"FROM ({' UNION ALL '.join(rows)})" for name, rows in CHECK_SETS.items()), layers=ALL)
TWINS["q24_finite_results"] = twin(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE isinf({c}) OR isnan({c})) AS non_finite "
    f"FROM daily_store_performance" for c in MART_DOUBLES["daily_store_performance"].split()), layers=ALL)

# ---- mart by mart
FACT = ("(SELECT SUM(sales) FROM fact_daily_sales)", "(SELECT CAST(SUM(transactions) AS BIGINT) FROM fact_store_transactions)")
DUP = "(SELECT COUNT(*) FROM (SELECT 1 FROM {} GROUP BY full_date, store_nbr HAVING COUNT(*) > 1))"
TWINS["q27_daily_store_reconciliation"] = twin(f"""
SELECT *, fact_total_sales = mart_total_sales AS sales_reconciled,
       fact_total_transactions = mart_total_transactions AS transactions_reconciled,
       duplicate_combinations = 0 AS grain_is_valid
FROM (SELECT {FACT[0]} AS fact_total_sales, SUM(total_sales) AS mart_total_sales, {FACT[1]} AS fact_total_transactions,
             CAST(SUM(transactions) AS BIGINT) AS mart_total_transactions,
             {DUP.format('daily_store_performance')} AS duplicate_combinations FROM daily_store_performance)
""", "fact_total_sales mart_total_sales", layers=ALL)
TWINS["q28_family_differences"] = twin("""
SELECT COALESCE(f.year, m.year) AS year, COALESCE(f.month, m.month) AS month, COALESCE(f.family, m.family) AS family,
       f.s AS fact_total_sales, m.total_sales AS mart_total_sales,
       f.family IS NOT NULL AND m.family IS NOT NULL AS family_preserved, f.s = m.total_sales AS total_sales_reconciled
FROM (SELECT year, month, family, SUM(sales) AS s FROM fact_daily_sales JOIN dim_date USING (date_key)
      JOIN dim_family USING (family_key) GROUP BY ALL) f
FULL JOIN family_performance m
  ON m.year = f.year AND m.month = f.month AND m.family = f.family
WHERE f.family IS NULL OR m.family IS NULL OR f.s IS DISTINCT FROM m.total_sales
""", "fact_total_sales mart_total_sales", layers=ALL)
TWINS["q29_store_reconciliation"] = twin(f"""
SELECT *, row_count = expected_store_count AS row_count_reconciled, duplicate_grain_count = 0 AS grain_is_valid,
       fact_total_sales = mart_total_sales AS sales_reconciled,
       fact_total_transactions = mart_total_transactions AS transactions_reconciled
FROM (SELECT COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT store_nbr) AS duplicate_grain_count,
             SUM(total_sales) AS mart_total_sales, CAST(SUM(total_transactions) AS BIGINT) AS mart_total_transactions,
             (SELECT COUNT(*) FROM dim_store) AS expected_store_count, {FACT[0]} AS fact_total_sales,
             {FACT[1]} AS fact_total_transactions FROM store_performance)
""", "fact_total_sales mart_total_sales", layers=ALL)
TWINS["q30_holiday_reconciliation"] = twin(f"""
SELECT *, expected_row_count = mart_row_count AS row_count_reconciled, duplicate_combinations = 0 AS grain_is_valid,
       expected_total_sales IS NOT DISTINCT FROM mart_total_sales AS sales_reconciled,
       expected_total_transactions IS NOT DISTINCT FROM mart_total_transactions AS transactions_reconciled
FROM (SELECT COUNT(*) AS mart_row_count, SUM(total_sales) AS mart_total_sales,
             CAST(SUM(transactions) AS BIGINT) AS mart_total_transactions,
             (SELECT COUNT(*) FROM bridge_store_holiday) AS expected_row_count,
             (SELECT SUM(total_sales) FROM store_day JOIN bridge_store_holiday USING (date_key, store_key)) AS expected_total_sales,
             (SELECT CAST(SUM(transactions) AS BIGINT) FROM fact_store_transactions JOIN bridge_store_holiday USING (date_key, store_key)) AS expected_total_transactions,
             {DUP.format('holiday_performance')} AS duplicate_combinations FROM holiday_performance)
""", "mart_total_sales expected_total_sales", layers=ALL)
TWINS["q31_seasonality_reconciliation"] = twin(f"""
SELECT *, expected_row_count = mart_row_count AS row_count_reconciled,
       fact_total_sales = mart_total_sales AS sales_reconciled,
       fact_total_transactions = mart_total_transactions AS transactions_reconciled
FROM (SELECT COUNT(*) AS mart_row_count, SUM(total_sales) AS mart_total_sales,
             CAST(SUM(total_transactions) AS BIGINT) AS mart_total_transactions,
             (SELECT COUNT(*) FROM (SELECT DISTINCT {SEASON} FROM fact_daily_sales JOIN dim_date USING (date_key))) AS expected_row_count,
             {FACT[0]} AS fact_total_sales, {FACT[1]} AS fact_total_transactions FROM seasonality)
""", "fact_total_sales mart_total_sales", layers=ALL)


# ---- declared constraints
def _rule(table: str, label: str, condition: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{label}' AS \"constraint\", "
            f"COUNT(*) FILTER (WHERE NOT COALESCE({condition}, false)) AS violations FROM {table}")


def _rules(present: dict, between: dict, binary: dict, at_least: dict) -> list[str]:
    rows = [_rule(t, f"{c} not null", f"{c} IS NOT NULL") for t, cs in present.items() for c in cs.split()]
    rows += [_rule(t, f"{c} between {a} and {b}", f"{c} BETWEEN {a} AND {b}")
             for t, cs in between.items() for c, a, b in cs]
    rows += [_rule(t, f"{c} in (0, 1)", f"{c} IN (0, 1)") for t, cs in binary.items() for c in cs.split()]
    return rows + [_rule(t, f"{c} >= {n}", f"{c} >= {n}") for t, cs in at_least.items() for c, n in cs]


def _unique(table: str, keys: str) -> str:
    return (f"SELECT '{table}', 'unique ({keys})', COUNT(*) FROM "
            f"(SELECT {keys} FROM {table} GROUP BY ALL HAVING COUNT(*) > 1)")


def _foreign(child: str, parent: str, keys: str) -> str:
    return (f"SELECT '{child}', 'foreign key ({', '.join(keys.split())}) to {parent}', "
            f"({_lost(child, parent, keys)})")


HOLIDAY_TEXT = "holiday_count holiday_descriptions holiday_types holiday_locales"
TWINS["q32_dimension_constraints"] = twin(" UNION ALL ".join(_rules(
    {"dim_date": "date_key full_date day_name month_name year",
     "dim_store": "store_key store_nbr city state store_type cluster", "dim_family": "family_key family",
     "dim_store_date": f"date_store_key date_key store_key {HOLIDAY_TEXT}"},
    {"dim_date": [("day", 1, 31), ("day_of_week", 0, 6), ("week_of_year", 1, 53), ("month", 1, 12), ("quarter", 1, 4)]},
    {"dim_date": "is_weekend is_month_start is_month_end is_payday",
     "dim_store_date": "is_holiday is_work_day is_event has_sales_observation has_transaction_observation"},
    {"dim_store_date": [("holiday_count", 0)]},
) + [_unique(t, k) for t, k in [
    ("dim_date", "date_key"), ("dim_date", "full_date"), ("dim_store", "store_key"), ("dim_store", "store_nbr"),
    ("dim_family", "family_key"), ("dim_family", "family"), ("dim_store_date", "date_store_key"),
    ("dim_store_date", "date_key, store_key")]
] + [_foreign("dim_store_date", "dim_date", "date_key"), _foreign("dim_store_date", "dim_store", "store_key")]))
TWINS["q33_fact_constraints"] = twin(" UNION ALL ".join(_rules(
    {"fact_daily_sales": "sales_id date_key store_key date_store_key family_key sales onpromotion",
     "fact_store_transactions": "date_key store_key transactions", "fact_oil_price": "date_key oil_price",
     "bridge_store_holiday": f"date_key store_key {HOLIDAY_TEXT}"},
    {}, {"fact_daily_sales": "is_promotion", "fact_oil_price": "oil_was_imputed",
         "bridge_store_holiday": "is_holiday is_work_day is_event"},
    {"fact_daily_sales": [("sales", 0), ("onpromotion", 0)], "fact_store_transactions": [("transactions", 0)],
     "bridge_store_holiday": [("holiday_count", 1)]},
) + [_rule("fact_daily_sales", "sales fits decimal(20,7)", "CAST(CAST(sales AS DECIMAL(20,7)) AS DOUBLE) = sales")]
  + [_unique(t, k) for t, k in [
      ("fact_daily_sales", "sales_id"), ("fact_daily_sales", "date_key, store_key, family_key"),
      ("fact_store_transactions", "date_key, store_key"), ("fact_oil_price", "date_key"),
      ("bridge_store_holiday", "date_key, store_key")]]
  + [_foreign(*x) for x in [
      ("fact_daily_sales", "dim_date", "date_key"), ("fact_daily_sales", "dim_store", "store_key"),
      ("fact_daily_sales", "dim_store_date", "date_store_key"), ("fact_daily_sales", "dim_family", "family_key"),
      ("fact_store_transactions", "dim_date", "date_key"), ("fact_store_transactions", "dim_store", "store_key"),
      ("fact_store_transactions", "dim_store_date", "date_key store_key"), ("fact_oil_price", "dim_date", "date_key"),
      ("bridge_store_holiday", "dim_date", "date_key"), ("bridge_store_holiday", "dim_store", "store_key")]]))
TWINS["q36_store_day_checks"] = twin(f"""
SELECT check_name, violations, violations = 0 AS passed FROM (
  SELECT 'grid_is_complete' AS check_name, abs((SELECT COUNT(*) FROM dim_store_date) - (SELECT COUNT(*) FROM dim_date) * (SELECT COUNT(*) FROM dim_store)) AS violations
  UNION ALL SELECT 'key_formula', (SELECT COUNT(*) FROM dim_store_date WHERE date_store_key <> CAST(date_key AS BIGINT) * 2147483648 + store_key)
  UNION ALL SELECT 'sales_store_days_covered', ({_lost('fact_daily_sales', 'dim_store_date', 'date_store_key')})
  UNION ALL SELECT 'transaction_store_days_covered', ({_lost('fact_store_transactions', 'dim_store_date', 'date_key store_key')})
  UNION ALL SELECT 'holiday_days_marked', abs((SELECT COUNT(*) FROM bridge_store_holiday) - (SELECT COUNT(*) FROM dim_store_date WHERE holiday_count > 0))
  UNION ALL SELECT 'holiday_days_in_grid', ({_lost('bridge_store_holiday', '(SELECT * FROM dim_store_date WHERE holiday_count > 0)', 'date_key store_key')}))""")
