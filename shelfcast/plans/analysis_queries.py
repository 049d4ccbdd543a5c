"""Registered queries: trend, stores, families, promotions, holidays, transactions, anomalies, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfcast.operators import (
    anomalies, families, holiday_analysis, measures, promotion, quality, readiness, stores,
    transaction_analysis, trend,
)
from shelfcast.operators.audit import union_all
from shelfcast.plans.registry import query
from shelfcast.plans.workspace import Workspace


def _daily(ws: Workspace) -> DataFrame:
    return ws.stored("result_daily_summary", lambda: trend.daily_summary(ws.warehouse()))


def _promotion_basic(ws: Workspace) -> DataFrame:
    return ws.stored("result_promotion_basic", lambda: promotion.dimension_summary(
        promotion.enriched_sales(ws.warehouse())))


def _holidays(ws: Workspace) -> DataFrame:
    return ws.stored("result_holiday_frame", lambda: holiday_analysis.holiday_frame(ws.warehouse()))


def _store_days(ws: Workspace) -> DataFrame:
    return ws.stored("result_transaction_days", lambda: transaction_analysis.add_outliers_and_trend(
        transaction_analysis.store_day_frame(ws.warehouse(), check=False)))


def _stores(ws: Workspace) -> DataFrame:
    return ws.stored("result_store_performance", lambda: stores.store_performance(ws.warehouse()))


def _families(ws: Workspace) -> DataFrame:
    return ws.stored("result_family_performance", lambda: families.family_performance(ws.warehouse()))


def _anomalies(ws: Workspace) -> DataFrame:
    return ws.stored("result_anomalies", lambda: anomalies.sales_anomalies(ws.warehouse()))


def _readiness(ws: Workspace) -> DataFrame:
    return ws.stored("result_readiness", lambda: readiness.forecast_readiness(ws.warehouse()))


query("a1_daily_summary")(lambda ws: trend.daily_summary(ws.warehouse()))
query("a2_weekly_summary")(lambda ws: trend.weekly_summary(_daily(ws)))
query("a3_a4_monthly_summary")(lambda ws: trend.monthly_summary(_daily(ws)))
query("a5_weekday_month_summary")(lambda ws: trend.weekday_month_summary(_daily(ws)))
query("a7_weekday_month_pivot")(lambda ws: trend.weekday_month_pivot(trend.weekday_month_summary(_daily(ws))))


@query("a6_seasonality_findings")
def seasonality_findings(ws: Workspace) -> DataFrame:
    daily = _daily(ws)
    return trend.seasonality_findings(daily, trend.weekly_summary(daily), trend.monthly_summary(daily))


query("a8_to_a13_store_performance")(lambda ws: stores.store_performance(ws.warehouse()))
query("a14_top_and_bottom_stores")(lambda ws: union_all(
    [stores.top_and_bottom(_stores(ws), m) for m in stores.STORE_RANKS]))
query("a15_attribute_averages")(lambda ws: stores.attribute_averages(
    _stores(ws), ["city", "state", "store_type", "cluster"]))
query("a16_store_findings")(lambda ws: stores.store_findings(_stores(ws)))
query("a17_a18_a19_family_performance")(lambda ws: families.family_performance(ws.warehouse()))
query("a20_family_readiness")(lambda ws: families.family_readiness(_families(ws)))
query("a21_top_families")(lambda ws: families.top_families(
    _families(ws), ["total_sales", "coefficient_of_variation", "zero_sales_rate", "promotion_rate"]))
query("a16_family_findings")(lambda ws: families.family_findings(_families(ws)))
query("a22_segment_counts")(lambda ws: union_all([
    stores.segment_counts(_stores(ws), "performance_segment"),
    stores.segment_counts(families.family_readiness(_families(ws)), "forecast_readiness")]))
query("a23_sales_histogram")(lambda ws: families.capped_histogram(ws.clean()["train"], "sales"))
query("a24_row_shares")(lambda ws: families.zero_and_promotion_shares(ws.clean()["train"]))

query("p1_enriched_sales")(lambda ws: promotion.enriched_sales(ws.warehouse()))
query("p2_p3_dimension_summary")(lambda ws: promotion.dimension_summary(promotion.enriched_sales(ws.warehouse())))
query("p4_promotion_bands")(lambda ws: promotion.promotion_bands(promotion.enriched_sales(ws.warehouse())))
query("p5_p6_p7_matched_analysis")(lambda ws: promotion.matched_analysis(
    promotion.enriched_sales(ws.warehouse()), _promotion_basic(ws)))
query("p8_overall_cohorts")(lambda ws: promotion.overall_cohorts(_promotion_basic(ws)))
query("p9_top_uplift_families")(lambda ws: promotion.top_uplift_families(_promotion_basic(ws)))
query("p10_limitation_counts")(lambda ws: promotion.limitation_counts(
    _promotion_basic(ws),
    promotion.matched_analysis(promotion.enriched_sales(ws.warehouse()), _promotion_basic(ws))))

query("h1_h2_store_day_frame")(lambda ws: holiday_analysis.store_day_frame(ws.warehouse()))
query("h3_h4_h5_h6_holiday_frame")(lambda ws: holiday_analysis.holiday_frame(ws.warehouse()))
query("h7_category_summary")(lambda ws: holiday_analysis.category_summary(_holidays(ws)))
query("h8_payday_holiday_groups")(lambda ws: holiday_analysis.payday_holiday_groups(_holidays(ws)))
query("h9_log_sales_distributions")(lambda ws: holiday_analysis.log_sales_distributions(_holidays(ws)))
query("h10_limit_counters")(lambda ws: holiday_analysis.limit_counters(_holidays(ws)))

query("t1_store_day_frame")(lambda ws: transaction_analysis.store_day_frame(ws.warehouse(), check=False))
query("t1_unmapped_store_days")(lambda ws: transaction_analysis.unmapped_store_days(_store_days(ws)))
query("t2_t3_outliers_and_trend")(lambda ws: transaction_analysis.add_outliers_and_trend(
    transaction_analysis.store_day_frame(ws.warehouse(), check=False)))
query("t4_store_summary")(lambda ws: transaction_analysis.store_summary(_store_days(ws)))


@query("t5_monthly_driver")
def monthly_driver(ws: Workspace) -> DataFrame:
    """Monthly driver split, given only if the effects add up to the change."""
    drivers = ws.stored("result_monthly_driver", lambda: transaction_analysis.monthly_driver(_store_days(ws)))
    transaction_analysis.assert_driver_identity(drivers)
    return drivers


query("t6_daily_totals")(lambda ws: transaction_analysis.daily_totals(_store_days(ws)))
query("t6_overall_correlation")(lambda ws: transaction_analysis.overall_correlation(_store_days(ws)))
query("t7_calendar_distributions")(lambda ws: transaction_analysis.calendar_distributions(_store_days(ws)))
query("t8_driver_counts")(lambda ws: transaction_analysis.driver_counts(
    transaction_analysis.monthly_driver(_store_days(ws))))

query("n1_store_daily")(lambda ws: anomalies.store_daily(ws.warehouse()))
query("n2_system_daily")(lambda ws: anomalies.system_daily(anomalies.store_daily(ws.warehouse())))
query("n3_n4_scored_days")(lambda ws: anomalies.scored_days(ws.warehouse()))
query("n5_n6_sales_anomalies")(lambda ws: anomalies.sales_anomalies(ws.warehouse()))

query("r1_series_metrics")(lambda ws: readiness.series_metrics(ws.warehouse()))
query("r2_forecast_readiness")(lambda ws: readiness.forecast_readiness(ws.warehouse()))
query("r3_overlap_summary")(lambda ws: union_all(
    [readiness.overlap_summary(_readiness(ws), d) for d in ("family", "store_nbr")]))
query("r4_problem_summary")(lambda ws: union_all(
    [readiness.problem_summary(_readiness(ws), d) for d in ("family", "store_nbr")]))
query("r5_distributions")(lambda ws: readiness.distributions(_readiness(ws)))
query("r6_family_context")(lambda ws: readiness.family_context(_readiness(ws), _families(ws)))
query("r6_store_context")(lambda ws: readiness.store_context(_readiness(ws), _stores(ws), _anomalies(ws)))

query("q35_layer_reconciliation")(lambda ws: quality.layer_reconciliation(
    ws.clean(), ws.warehouse(), _stores(ws), _families(ws)))

query("d1_d2_volume_over_time")(lambda ws: measures.volume_over_time(ws.warehouse(), ["family"]))
query("d2_d3_volume_and_coverage")(lambda ws: measures.volume_and_coverage(ws.warehouse(), ["year", "state"]))
query("d4_transaction_measures")(lambda ws: measures.transaction_measures(ws.warehouse(), ["year", "store_nbr"]))
query("d5_store_momentum")(lambda ws: measures.store_momentum(ws.warehouse(), ["store_nbr"]))
query("d6_promotion_measures")(lambda ws: measures.promotion_measures(ws.warehouse(), ["family"]))
query("d7_holiday_measures")(lambda ws: measures.holiday_measures(ws.warehouse(), ["state"]))
query("d8_oil_measures")(lambda ws: measures.oil_measures(ws.warehouse()))
query("d9_readiness_measures")(lambda ws: measures.readiness_measures(_readiness(ws), ["store_type"]))
query("d10_anomaly_measures")(lambda ws: measures.anomaly_measures(_anomalies(ws), ["analysis_level", "review_category"]))
