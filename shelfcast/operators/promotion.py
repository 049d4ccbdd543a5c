"""Promotion cohorts: overall, by dimension, by intensity and inside matched cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import choose, safe_ratio
from shelfcast.functions.quantiles import with_quantiles
from shelfcast.operators.audit import union_all

Tables = Mapping[str, DataFrame]
MIN_COHORT = 100
TOP_FAMILIES = 15
DIMENSIONS = ["family", "store_nbr", "store_type", "day_of_week", "month"]
# Promoted-item bands, right-closed upper limits.
BANDS = [("0", 0), ("1", 1), ("2–5", 5), ("6–10", 10), ("11–25", 25), ("26–50", 50)]
LAST_BAND = "51+"
MATCH_GRAIN = ["store_nbr", "family", "year", "month", "day_of_week"]


def enriched_sales(t: Tables) -> DataFrame:
    """Fact rows with dimensions; cohort columns are null outside their cohort."""
    promoted = F.col("is_promotion") == 1
    return (
        t["fact_daily_sales"].select("date_key", "store_key", "family_key", "sales", "onpromotion", "is_promotion")
        .join(t["dim_family"], "family_key")
        .join(t["dim_store"].select("store_key", "store_nbr", "store_type"), "store_key")
        .join(t["dim_date"].select("date_key", "year", "month", "day_of_week"), "date_key")
        .withColumn("sales_promo", F.when(promoted, F.col("sales")))
        .withColumn("sales_nonpromo", F.when(~promoted, F.col("sales")))
        .withColumn("onpromotion_promo", F.when(promoted, F.col("onpromotion")))
    )


def uplift(promo: str = "avg_sales_promo", base: str = "avg_sales_nonpromo") -> Column:
    return safe_ratio(F.col(promo) - F.col(base), base) * 100


def dimension_summary(frame: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """One row per dimension value for several dimensions, stacked in one long table.

    Rows are fanned out to (dimension, value) pairs and combined before the shuffle; the
    medians are exact and never hold a whole group.
    """
    keys = ["analysis_dimension", "group_value"]
    measures = ["sales", "sales_promo", "sales_nonpromo", "is_promotion", "onpromotion", "onpromotion_promo"]
    long = frame.select(*measures, F.inline(F.array(*[
        F.struct(F.lit(d).alias("analysis_dimension"), F.col(d).cast("string").alias("group_value"))
        for d in dimensions])))
    summary = long.groupBy(*keys).agg(
        F.avg("sales").alias("average_sales"), F.count("sales").alias("observation_count"),
        F.count("sales_promo").alias("promotion_observation_count"),
        F.count("sales_nonpromo").alias("nonpromotion_observation_count"),
        F.avg("is_promotion").alias("promotion_rate"),
        F.avg("sales_promo").alias("avg_sales_promo"), F.avg("sales_nonpromo").alias("avg_sales_nonpromo"),
        F.sum("onpromotion").alias("total_onpromotion"), F.avg("onpromotion").alias("average_onpromotion"),
        F.avg("onpromotion_promo").alias("average_onpromotion_when_promoted"),
    )
    summary = with_quantiles(summary, long, keys, {
        "median_sales": ("sales", 0.5), "median_sales_promo": ("sales_promo", 0.5),
        "median_sales_nonpromo": ("sales_nonpromo", 0.5), "median_onpromotion": ("onpromotion", 0.5)})
    few_promo = F.col("promotion_observation_count") < MIN_COHORT
    few_rest = F.col("nonpromotion_observation_count") < MIN_COHORT
    warning = choose([
        (few_promo & few_rest, "Both cohorts below minimum sample size"),
        (few_promo, "Promotion cohort below minimum sample size"),
        (few_rest, "Non-promotion cohort below minimum sample size")], "")
    own = {d: F.when(F.col("analysis_dimension") == d, F.col("group_value")) for d in dimensions}
    return summary.withColumns({
        **own, "uplift_proxy_pct": uplift(), "small_sample_warning": warning,
        "minimum_cohort_observations": F.lit(MIN_COHORT)})


def promotion_bands(frame: DataFrame) -> DataFrame:
    """Sales by number of promoted items; bands without rows stay in the result."""
    n = F.col("onpromotion")
    banded = frame.filter(n >= 0).select("sales", "onpromotion", choose(
        [(n <= top, label) for label, top in BANDS], LAST_BAND).alias("onpromotion_band"))
    keys = ["onpromotion_band"]
    summary = banded.groupBy(*keys).agg(
        F.avg("sales").alias("average_sales"), F.count(F.lit(1)).alias("_n"),
        F.avg("onpromotion").alias("average_onpromotion"))
    summary = with_quantiles(summary, banded, keys, {"median_sales": ("sales", 0.5)})
    labels = [label for label, _ in BANDS] + [LAST_BAND]
    bands = frame.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("band_order", "onpromotion_band"))
    return bands.join(summary, "onpromotion_band", "left").select(
        "band_order", "onpromotion_band", "average_sales", "median_sales",
        F.coalesce("_n", F.lit(0)).alias("observation_count"), "average_onpromotion",
        F.when(F.coalesce("_n", F.lit(0)) < MIN_COHORT, F.lit("Band below minimum sample size"))
        .otherwise(F.lit("")).alias("small_sample_warning"))


def matched_cells(frame: DataFrame) -> DataFrame:
    """Store-family-calendar cells that hold both cohorts."""
    cells = frame.groupBy(*MATCH_GRAIN, "store_type").agg(
        F.avg("sales_promo").alias("avg_sales_promo"), F.avg("sales_nonpromo").alias("avg_sales_nonpromo"),
        F.count("sales_promo").alias("promotion_observation_count"),
        F.count("sales_nonpromo").alias("nonpromotion_observation_count"))
    smaller = F.least("promotion_observation_count", "nonpromotion_observation_count")
    return cells.filter(smaller > 0).withColumns({
        "matched_uplift_proxy_pct": uplift(), "matched_group_count": F.lit(1).cast("long"),
        "small_sample_warning": F.when(
            smaller < MIN_COHORT, "At least one matched cohort below minimum sample size").otherwise(""),
        "analysis_level": F.lit("matched_group")})


def matched_rollup(cells: DataFrame, basic: DataFrame, level: str) -> DataFrame:
    """Count-weighted cohort means by ``level`` beside the unmatched proxy."""
    promo, rest = F.col("promotion_observation_count"), F.col("nonpromotion_observation_count")
    sums = cells.groupBy(level).agg(
        F.sum(F.col("avg_sales_promo") * promo).alias("_p"), F.sum(F.col("avg_sales_nonpromo") * rest).alias("_q"),
        F.sum(promo).alias("promotion_observation_count"), F.sum(rest).alias("nonpromotion_observation_count"),
        F.sum("matched_group_count").alias("matched_group_count"),
    ).withColumns({
        "avg_sales_promo": safe_ratio("_p", "promotion_observation_count"),
        "avg_sales_nonpromo": safe_ratio("_q", "nonpromotion_observation_count"),
    }).withColumn("matched_uplift_proxy_pct", uplift()).drop("_p", "_q")
    unmatched = basic.filter(F.col("analysis_dimension") == level).select(
        F.col("group_value").alias(level), F.col("uplift_proxy_pct").alias("unmatched_uplift_proxy_pct"))
    smaller = F.least("promotion_observation_count", "nonpromotion_observation_count")
    return sums.join(unmatched, level).withColumns({
        "matched_vs_unmatched_difference_pct_points":
            F.col("matched_uplift_proxy_pct") - F.col("unmatched_uplift_proxy_pct"),
        "small_sample_warning": F.when(
            smaller < MIN_COHORT, "At least one aggregated matched cohort below minimum sample size").otherwise(""),
        "analysis_level": F.lit(f"{level}_summary")})


def matched_analysis(frame: DataFrame, basic: DataFrame) -> DataFrame:
    """Cells and both rollups in one long table with padded columns."""
    cells = matched_cells(frame)
    stacked = union_all([cells, matched_rollup(cells, basic, "family"), matched_rollup(cells, basic, "store_type")])
    return stacked.select(
        "analysis_level", *MATCH_GRAIN[:2], "store_type", *MATCH_GRAIN[2:],
        "avg_sales_promo", "avg_sales_nonpromo", "promotion_observation_count", "nonpromotion_observation_count",
        "matched_group_count", "matched_uplift_proxy_pct", "unmatched_uplift_proxy_pct",
        "matched_vs_unmatched_difference_pct_points", "small_sample_warning",
        F.lit(MIN_COHORT).alias("minimum_cohort_observations"),
        F.lit("Both cohorts within store_nbr + family + year + month + day_of_week").alias("matching_rule"),
        F.lit("No automatic outlier removal").alias("outlier_handling"))


def overall_cohorts(basic: DataFrame) -> DataFrame:
    """Overall cohort means from the count-weighted family means."""
    sums = basic.filter("analysis_dimension = 'family'").agg(
        F.sum(F.col("avg_sales_promo") * F.col("promotion_observation_count")).alias("p"),
        F.sum("promotion_observation_count").alias("np"),
        F.sum(F.col("avg_sales_nonpromo") * F.col("nonpromotion_observation_count")).alias("q"),
        F.sum("nonpromotion_observation_count").alias("nq"))
    return sums.select(F.inline(F.array(
        F.struct(F.lit("Nonpromotion observations").alias("cohort"), safe_ratio("q", "nq").alias("average_sales")),
        F.struct(F.lit("Promotion-active observations").alias("cohort"), safe_ratio("p", "np").alias("average_sales")))))


def top_uplift_families(basic: DataFrame, n: int = TOP_FAMILIES) -> DataFrame:
    eligible = basic.filter(
        (F.col("analysis_dimension") == "family") & F.col("uplift_proxy_pct").isNotNull()
        & (F.col("promotion_observation_count") >= MIN_COHORT)
        & (F.col("nonpromotion_observation_count") >= MIN_COHORT))
    return eligible.orderBy(F.col("uplift_proxy_pct").desc(), "group_value").limit(n).select(
        F.col("group_value").alias("family"), "uplift_proxy_pct", "promotion_observation_count",
        "nonpromotion_observation_count")


def limitation_counts(basic: DataFrame, matched: DataFrame) -> DataFrame:
    warned = F.count_if(F.col("small_sample_warning") != "")
    cells = matched.filter("analysis_level = 'matched_group'")
    counters = [
        ("warned_groups", basic, warned), ("undefined_uplifts", basic, F.count_if(F.col("uplift_proxy_pct").isNull())),
        ("matched_groups", cells, F.count(F.lit(1))), ("warned_matched_groups", cells, warned)]
    return union_all([df.agg(c.alias("value")).select(F.lit(name).alias("counter"), "value")
                      for name, df, c in counters])
