"""Profiles, grain checks and referential checks for any table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{name}: required columns not found: {', '.join(missing)}")


def _is_numeric(kind: str) -> bool:
    return kind.split("(")[0] in NUMERIC


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """One row per column: type, rows, missing, distinct and, for numbers, signs and range.

    Counts and ranges take one pass.  Distinct counts go through (column, value) pairs that
    are de-duplicated before they are counted, so no column expands the others' rows in one task.
    """
    kinds = dict(df.dtypes)
    measures: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        q = F.col(f"`{c}`")
        measures.append(F.count_if(q.isNull()).alias(f"_miss{i}"))
        if _is_numeric(kinds[c]):
            measures += [
                F.count_if(q == 0).alias(f"_zero{i}"), F.count_if(q < 0).alias(f"_neg{i}"),
                F.min(q).cast("double").alias(f"_min{i}"), F.max(q).cast("double").alias(f"_max{i}"),
            ]
    one = df.agg(*measures)
    entries = []
    for i, c in enumerate(df.columns):
        numeric = _is_numeric(kinds[c])
        def pick(prefix: str, kind: str) -> Column:
            return F.col(f"_{prefix}{i}") if numeric else F.lit(None).cast(kind)
        entries.append(F.struct(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
            F.lit(kinds[c]).alias("dtype"), F.col("_rows").alias("row_count"),
            F.col(f"_miss{i}").alias("missing_count"),
            F.when(F.col("_rows") > 0, F.round(F.col(f"_miss{i}") / F.col("_rows") * 100, 2))
            .otherwise(F.lit(0.0)).alias("missing_pct"),
            pick("zero", "bigint").alias("zero_count"), pick("neg", "bigint").alias("negative_count"),
            pick("min", "double").alias("min_value"), pick("max", "double").alias("max_value"),
        ))
    base = one.select(F.inline(F.array(*entries)))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
        for c in df.columns
    ])
    unique = (
        df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()
        .groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    )
    return base.join(unique, "column_name", "left").select(
        "table_name", "column_name", "dtype", "row_count", "missing_count", "missing_pct",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "zero_count", "negative_count", "min_value", "max_value",
    )


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([column_profile(table, name) for name, table in tables.items()])


def missing_rates(profile: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share of chosen columns."""
    return profile.filter(F.col("column_name").isin(columns)).select(
        "table_name", "column_name", "row_count", "missing_count", "missing_pct")


def grain_counts(df: DataFrame, grain: list[str], name: str = "table") -> DataFrame:
    """Rows per grain value; null keys form a group of their own."""
    if not grain:
        raise ValueError("grain must name at least one column")
    missing = [c for c in grain if c not in df.columns]
    if missing:
        raise KeyError(f"{name}: grain columns not found: {', '.join(missing)}")
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("row_count"))


def duplicated_grains(df: DataFrame, grain: list[str], name: str, sample_size: int = 20) -> DataFrame:
    """The first ``sample_size`` duplicated grain values, in grain order."""
    if sample_size < 0:
        raise ValueError("sample_size must not be negative")
    return (
        grain_counts(df, grain, name).filter("row_count > 1")
        .select(F.lit(name).alias("table_name"), *grain, "row_count")
        .orderBy(*grain).limit(sample_size)
    )


def grain_summary(df: DataFrame, grain: list[str], name: str) -> DataFrame:
    doubled = F.col("row_count") > 1
    return grain_counts(df, grain, name).agg(
        F.count_if(doubled).alias("duplicate_combinations"),
        F.coalesce(F.sum(F.when(doubled, F.col("row_count"))), F.lit(0)).alias("affected_rows"),
    ).select(
        F.lit(name).alias("table_name"), F.lit(", ".join(grain)).alias("grain_columns"),
        "duplicate_combinations", "affected_rows",
        (F.col("duplicate_combinations") == 0).alias("is_valid"),
    )


def count_duplicates(df: DataFrame, grain: list[str]) -> int:
    return int(grain_counts(df, grain).filter("row_count > 1").count())


def assert_unique(df: DataFrame, grain: list[str], name: str) -> None:
    if grain_counts(df, grain, name).filter("row_count > 1").limit(1).count():
        raise ValueError(f"{name}: duplicate grain detected for {', '.join(grain)}")


def orphan_keys(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str,
                child_table: str, parent_table: str) -> DataFrame:
    """Non-null child values without a parent and how many rows carry them.

    The child is counted per key before the join, so a hot key is one row when it meets
    the parent.
    """
    if child_column not in child.columns:
        raise KeyError(f"{child_table}: foreign key column not found: {child_column}")
    if parent_column not in parent.columns:
        raise KeyError(f"{parent_table}: referenced key column not found: {parent_column}")
    used = (
        child.filter(F.col(child_column).isNotNull()).groupBy(F.col(child_column).alias("_key"))
        .agg(F.count(F.lit(1)).alias("affected_rows"))
    )
    known = parent.select(F.col(parent_column).alias("_key")).distinct()
    return used.join(known, "_key", "left_anti").select(
        F.lit(child_table).alias("child_table"), F.lit(child_column).alias("child_column"),
        F.lit(parent_table).alias("parent_table"), F.lit(parent_column).alias("parent_column"),
        F.col("_key").cast("string").alias("invalid_value"), "affected_rows",
    )


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([
        t.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(t.columns)).alias("column_count"))
        for name, t in tables.items()
    ])


def date_coverage(tables: Mapping[str, DataFrame], column: str = "date") -> DataFrame:
    return union_all([
        t.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"),
              F.count_distinct(column).alias("unique_dates"))
        .select(F.lit(name).alias("table_name"), "min_date", "max_date", "unique_dates")
        for name, t in tables.items() if column in t.columns
    ])


def full_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that occur more than once in full; every copy counts."""
    return union_all([
        t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicated_rows"))
        .select(F.lit(name).alias("table_name"), "duplicated_rows")
        for name, t in tables.items()
    ])


def domain_counters(train: DataFrame, oil: DataFrame, stores: DataFrame) -> DataFrame:
    """Named counters of values outside the expected domains."""
    any_missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in stores.columns])
    counters = [
        (train, "negative_sales", F.col("sales") < 0),
        (train, "zero_sales", F.col("sales") == 0),
        (train, "negative_onpromotion", F.col("onpromotion") < 0),
        (oil, "missing_oil_price", F.col("dcoilwtico").isNull()),
        (stores, "stores_with_missing_metadata", any_missing),
    ]
    return union_all([
        df.agg(F.count_if(rule).alias("affected_rows"))
        .select(F.lit(name).alias("rule"), "affected_rows")
        for df, name, rule in counters
    ])


def shape_change(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """Table shapes before and after a step, side by side."""
    old, new = table_shapes(before), table_shapes(after)
    return old.select(
        "table_name", F.col("row_count").alias("raw_rows"), F.col("column_count").alias("raw_columns"),
    ).join(
        new.select("table_name", F.col("row_count").alias("clean_rows"),
                   F.col("column_count").alias("clean_columns")),
        "table_name",
    ).withColumn("row_change", F.col("clean_rows") - F.col("raw_rows"))
