"""Registered queries: sources, audit, cleaning, warehouse, marts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import audit, cleaning, marts, quality, warehouse
from shelfcast.plans.registry import query
from shelfcast.plans.workspace import Workspace
from shelfcast.schemas import CLEAN_GRAINS, WAREHOUSE_GRAINS
from shelfcast.sources import load, sinks


@query("s2_train_source")
def train_source(ws: Workspace) -> DataFrame:
    return ws.raw()["train"]


@query("s4_store_source")
def store_source(ws: Workspace) -> DataFrame:
    return ws.raw()["stores"]


@query("s5_transaction_source")
def transaction_source(ws: Workspace) -> DataFrame:
    return ws.raw()["transactions"]


@query("s6_oil_source")
def oil_source(ws: Workspace) -> DataFrame:
    return ws.raw()["oil"]


@query("s7_holiday_source")
def holiday_source(ws: Workspace) -> DataFrame:
    return ws.raw()["holidays"]


@query("s3_future_source")
def future_source(ws: Workspace) -> DataFrame:
    return ws.rollup()["future"]


@query("q1_q2_column_profiles")
def column_profiles(ws: Workspace) -> DataFrame:
    return audit.profile_tables(ws.raw())


@query("s1_s9_csv_profiles")
def csv_profiles(ws: Workspace) -> DataFrame:
    """Profiles of the source tables read from CSV; equal to those of the tables they were written from."""
    tables = ws.csv_sources()
    return audit.profile_tables({name: tables[name] for name in ws.raw()})


@query("s8_sample_submission")
def sample_submission(ws: Workspace) -> DataFrame:
    return ws.csv_sources()["sample_submission"]


@query("s10_s11_pruned_star")
def pruned_star(ws: Workspace) -> DataFrame:
    """Daily sales and visits from a scan of only the columns that they need."""
    ws.warehouse()
    t = sinks.read_published_tables(ws.spark, f"{ws.root}/warehouse", ["fact_daily_sales", "fact_store_transactions"], {
        "fact_daily_sales": ["date_key", "sales"], "fact_store_transactions": ["date_key", "transactions"]})
    sales = t["fact_daily_sales"].groupBy("date_key").agg(F.sum("sales").alias("total_sales"))
    visits = t["fact_store_transactions"].groupBy("date_key").agg(F.sum("transactions").alias("total_transactions"))
    return sales.join(visits, "date_key", "full")


@query("q3_q4_duplicated_grains")
def duplicated_grains(ws: Workspace) -> DataFrame:
    return audit.duplicated_grains(ws.raw()["holidays"], ["date"], "holidays", 20)


@query("q5_grain_summaries")
def grain_summaries(ws: Workspace) -> DataFrame:
    raw = ws.raw()
    grains = [(name, grain) for name, grain in CLEAN_GRAINS.items() if name in raw and name != "holidays"]
    grains += [("holidays", ["date", "locale_name"]), ("train", ["store_nbr", "family"])]
    return audit.union_all([audit.grain_summary(raw[name], grain, name) for name, grain in grains])


@query("q6_orphan_keys")
def orphan_keys(ws: Workspace) -> DataFrame:
    raw, rolled = ws.raw(), ws.rollup()
    return audit.union_all([
        audit.orphan_keys(raw["transactions"], "store_nbr", raw["train"], "store_nbr", "transactions", "train"),
        audit.orphan_keys(rolled["train"], "store_nbr", raw["stores"], "store_nbr", "rollup", "stores"),
    ])


@query("q8_table_shapes")
def table_shapes(ws: Workspace) -> DataFrame:
    return audit.table_shapes(ws.raw())


@query("q9_date_coverage")
def date_coverage(ws: Workspace) -> DataFrame:
    return audit.date_coverage(ws.raw())


@query("q10_full_duplicates")
def full_duplicates(ws: Workspace) -> DataFrame:
    raw = ws.raw()
    return audit.full_duplicates({**raw, "store_attributes": raw["stores"].select("state", "type")})


@query("q11_domain_counters")
def domain_counters(ws: Workspace) -> DataFrame:
    raw = ws.raw()
    return audit.domain_counters(raw["train"], raw["oil"], raw["stores"])


@query("q12_missing_rates")
def missing_rates(ws: Workspace) -> DataFrame:
    clean = ws.clean()
    profile = audit.column_profile(clean["oil"], "oil")
    return audit.missing_rates(profile, ["oil_price", "oil_change_1d", "oil_change_7d", "oil_pct_change_7d"])


@query("q13_shape_change")
def shape_change(ws: Workspace) -> DataFrame:
    return audit.shape_change(ws.raw(), ws.clean())


@query("q14_cleaning_metrics")
def cleaning_metrics(ws: Workspace) -> DataFrame:
    return cleaning.cleaning_metrics(ws.raw(), ws.clean())


@query("q15_clean_gate")
def clean_gate(ws: Workspace) -> DataFrame:
    return quality.clean_gate(ws.clean())["grains"]


@query("c1_clean_train")
def clean_train(ws: Workspace) -> DataFrame:
    return ws.clean()["train"]


@query("c2_clean_future")
def clean_future(ws: Workspace) -> DataFrame:
    return cleaning.clean_test(ws.rollup()["future"])


@query("c4_clean_stores")
def clean_stores(ws: Workspace) -> DataFrame:
    return ws.clean()["stores"]


@query("c6_c7_holiday_store_days")
def holiday_store_days(ws: Workspace) -> DataFrame:
    return ws.clean()["holidays"]


@query("c8_clean_oil")
def clean_oil(ws: Workspace) -> DataFrame:
    return ws.clean()["oil"]


@query("c9_clean_transactions")
def clean_transactions(ws: Workspace) -> DataFrame:
    return ws.clean()["transactions"]


@query("c10_store_day_sales")
def store_day_sales(ws: Workspace) -> DataFrame:
    return cleaning.store_day_sales(ws.clean()["train"])


@query("c11_sales_with_transactions")
def sales_with_transactions(ws: Workspace) -> DataFrame:
    clean = ws.clean()
    return cleaning.join_transactions(cleaning.store_day_sales(clean["train"]), clean["transactions"])


@query("w1_dim_date")
def dim_date(ws: Workspace) -> DataFrame:
    return ws.warehouse()["dim_date"]


@query("w2_dim_store")
def dim_store(ws: Workspace) -> DataFrame:
    return ws.warehouse()["dim_store"]


@query("w3_dim_family")
def dim_family(ws: Workspace) -> DataFrame:
    return ws.warehouse()["dim_family"]


@query("w4_bridge_store_holiday")
def bridge_store_holiday(ws: Workspace) -> DataFrame:
    return ws.warehouse()["bridge_store_holiday"]


@query("w5_observed_store_days")
def observed_store_days(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return warehouse.observed_store_days(ws.clean()["train"], t["dim_date"], t["dim_store"], "train")


@query("w6_dim_store_date")
def dim_store_date(ws: Workspace) -> DataFrame:
    return ws.warehouse()["dim_store_date"]


@query("w8_w9_fact_daily_sales")
def fact_daily_sales(ws: Workspace) -> DataFrame:
    return ws.warehouse()["fact_daily_sales"]


@query("w10_fact_store_transactions")
def fact_store_transactions(ws: Workspace) -> DataFrame:
    return ws.warehouse()["fact_store_transactions"]


@query("w11_fact_oil_price")
def fact_oil_price(ws: Workspace) -> DataFrame:
    return ws.warehouse()["fact_oil_price"]


@query("q16_q17_w12_warehouse_validation")
def warehouse_validation(ws: Workspace) -> DataFrame:
    return quality.warehouse_validation(ws.warehouse())


@query("q18_warehouse_reconciliation")
def warehouse_reconciliation(ws: Workspace) -> DataFrame:
    return quality.warehouse_reconciliation(ws.clean(), ws.warehouse())


@query("s13_s14_published_layers")
def published_layers(ws: Workspace) -> DataFrame:
    """Rows of every table that readers of the published layers see."""
    ws.warehouse()
    frames = []
    for layer, names in (("clean", [name for name in CLEAN_GRAINS if name != "test"]), ("warehouse", list(WAREHOUSE_GRAINS))):
        tables = sinks.read_published_tables(ws.spark, f"{ws.root}/{layer}", names)
        frames.append(audit.table_shapes(tables).withColumn("layer", F.lit(layer)))
    return audit.union_all(frames).select("layer", "table_name", "row_count")


@query("s16_s17_s18_load_check")
def loaded_batches(ws: Workspace) -> DataFrame:
    """Loaded tables against the published ones after two batches, a replacement and a replay."""
    return sinks.load_check(ws.warehouse(), load.read_loaded(ws.spark, ws.loaded()))


for _name, _build in marts.MARTS.items():
    _number = list(marts.MARTS).index(_name) + 1
    query(f"v{_number}_{_name}")(lambda ws, build=_build: build(ws.warehouse()))


@query("q19_row_count_checks")
def row_count_checks(ws: Workspace) -> DataFrame:
    return quality.row_count_checks(ws.warehouse())


@query("q20_duplicate_grain_checks")
def duplicate_grain_checks(ws: Workspace) -> DataFrame:
    return quality.duplicate_grain_checks(ws.warehouse())


@query("q21_orphan_checks")
def orphan_checks(ws: Workspace) -> DataFrame:
    return quality.orphan_checks(ws.warehouse())


@query("q22_measure_checks")
def measure_checks(ws: Workspace) -> DataFrame:
    return quality.measure_checks(ws.warehouse())


@query("q23_mart_checks")
def mart_checks(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.mart_checks(t, ws.marts())


@query("q25_q26_classified_checks")
def classified_checks(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.run_check_sets(t, ws.marts())


@query("q24_finite_results")
def finite_results(ws: Workspace) -> DataFrame:
    return quality.finite_counts(ws.marts()["daily_store_performance"])


@query("q27_daily_store_reconciliation")
def daily_store_reconciliation(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.reconcile_daily_store(t, ws.marts()["daily_store_performance"])


@query("q28_family_differences")
def family_differences(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.family_differences(t, ws.marts()["family_performance"])


@query("q29_store_reconciliation")
def store_reconciliation(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.reconcile_store(t, ws.marts()["store_performance"])


@query("q30_holiday_reconciliation")
def holiday_reconciliation(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.reconcile_holiday(t, ws.marts()["holiday_performance"])


@query("q31_seasonality_reconciliation")
def seasonality_reconciliation(ws: Workspace) -> DataFrame:
    t = ws.warehouse()
    return quality.reconcile_seasonality(t, ws.marts()["seasonality"])


@query("q32_dimension_constraints")
def dimension_constraints(ws: Workspace) -> DataFrame:
    return quality.constraint_violations(ws.warehouse(), "dimension")


@query("q33_fact_constraints")
def fact_constraints(ws: Workspace) -> DataFrame:
    return quality.constraint_violations(ws.warehouse(), "fact")


@query("q34_stored_table_keys")
def stored_table_keys(ws: Workspace) -> DataFrame:
    keys = {**WAREHOUSE_GRAINS, "dim_store_date": ["date_store_key"], "fact_daily_sales": ["sales_id"]}
    return quality.warehouse_validation(ws.warehouse(), keys)


@query("q36_store_day_checks")
def store_day_checks(ws: Workspace) -> DataFrame:
    return quality.store_day_and_holiday_checks(ws.warehouse())
