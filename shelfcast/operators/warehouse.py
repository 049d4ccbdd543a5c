"""Star schema: date, store and family dimensions, store-day grid, facts and bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import daily_sequence, date_key, flag, one_row
from shelfcast.functions.numbering import global_row_number
from shelfcast.operators.audit import assert_unique, require_columns
from shelfcast.schemas import HOLIDAY_FLAGS, HOLIDAY_TEXTS, STORE_ATTRIBUTES

STORE_KEYS = 2**31


def date_attributes(date: Column) -> dict[str, Column]:
    """Calendar attributes of a date: Monday is 0, ISO weeks, payday on the 15th and month end."""
    month_end = date == F.last_day(date)
    return {
        "day": F.day(date),
        "day_of_week": F.weekday(date),
        "day_name": F.date_format(date, "EEEE"),
        "week_of_year": F.weekofyear(date),
        "month": F.month(date),
        "month_name": F.date_format(date, "MMMM"),
        "quarter": F.quarter(date),
        "year": F.year(date),
        "is_weekend": flag(F.weekday(date) >= 5),
        "is_month_start": flag(F.day(date) == 1),
        "is_month_end": flag(month_end),
        "is_payday": flag((F.day(date) == 15) | month_end),
    }


def build_dim_date(spark, start: Column, end: Column, check: bool = True) -> DataFrame:
    if check:
        row = spark.range(1).select(start.alias("a"), end.alias("z")).first()
        if row["a"] is None or row["z"] is None:
            raise ValueError("start and end must be valid dates")
        if row["a"] > row["z"]:
            raise ValueError("start date must not lie after the end date")
    days = spark.range(1).select(daily_sequence(start, end).alias("full_date"))
    attributes = date_attributes(F.col("full_date"))
    return days.select(
        date_key("full_date").alias("date_key"), "full_date",
        *[expression.alias(name) for name, expression in attributes.items()],
    )


def reuse_or_build_dim_date(spark, stored: DataFrame | None, start: Column, end: Column) -> DataFrame:
    """Keep a stored calendar that has exactly the wanted days, else build a new one."""
    wanted = build_dim_date(spark, start, end)
    if stored is None or not {"date_key", "full_date"} <= set(stored.columns):
        return wanted
    have = stored.select("full_date")
    need = wanted.select("full_date")
    incomplete = stored.filter(
        " OR ".join(f"`{c}` IS NULL" for c in stored.columns)).limit(1).count()
    differs = have.exceptAll(need).limit(1).count() or need.exceptAll(have).limit(1).count()
    return wanted if incomplete or differs else stored


def _dense_key(df: DataFrame, business_key: str, name: str) -> DataFrame:
    """1..n in business-key order, numbered by sorted partitions."""
    return global_row_number(df, [F.col(business_key)], name).select(F.col(name).cast("int").alias(name), *df.columns)


def build_dim_store(stores: DataFrame, check: bool = True) -> DataFrame:
    require_columns(stores, STORE_ATTRIBUTES, "stores")
    if check:
        if stores.filter(F.col("store_nbr").isNull()).limit(1).count():
            raise ValueError("dim_store: store_nbr must not be missing")
        assert_unique(stores, ["store_nbr"], "dim_store")
    return _dense_key(stores.select(*STORE_ATTRIBUTES), "store_nbr", "store_key")


def build_dim_family(train: DataFrame, check: bool = True) -> DataFrame:
    require_columns(train, ["family"], "train")
    if check and train.filter(F.col("family").isNull()).limit(1).count():
        raise ValueError("dim_family: family must not be missing")
    return _dense_key(train.select("family").distinct(), "family", "family_key")


def _map_store_day(df: DataFrame, dim_date: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Add both surrogate keys, null where unknown; small dimensions are broadcast by size."""
    return (
        df.join(dim_date.select("date_key", F.col("full_date").alias("date")), "date", "left")
        .join(dim_store.select("store_key", "store_nbr"), "store_nbr", "left")
    )


def verify_mapping(source: DataFrame, mapped: DataFrame, keys: dict[str, str], name: str,
                   measures: dict[str, float] | None = None) -> None:
    """Every row mapped, no row gained or lost, measure totals unchanged.

    One pass over each side; examples are only looked up when something is wrong.
    """
    measures = measures or {}
    totals = [F.count(F.lit(1)).alias("_rows")] + [F.sum(m).alias(m) for m in measures]
    nulls = [F.count_if(F.col(key).isNull()).alias(f"_no_{key}") for key in keys]
    after = mapped.agg(*totals, *nulls).first()
    for key, column in keys.items():
        if after[f"_no_{key}"]:
            unknown = mapped.filter(F.col(key).isNull()).select(column).distinct().limit(5).collect()
            raise ValueError(f"{name}: unmapped {column} values: {[row[0] for row in unknown]}")
    before = source.agg(*totals).first()
    if before["_rows"] != after["_rows"]:
        raise RuntimeError(f"{name}: row count changed from {before['_rows']} to {after['_rows']}")
    for measure, tolerance in measures.items():
        if abs((before[measure] or 0) - (after[measure] or 0)) > tolerance:
            raise RuntimeError(f"{name}: total {measure} changed")


STORE_DAY_KEYS = {"date_key": "date", "store_key": "store_nbr"}


def build_bridge_store_holiday(holidays: DataFrame, dim_date: DataFrame, dim_store: DataFrame,
                               check: bool = True) -> DataFrame:
    require_columns(holidays, ["date", "store_nbr", "holiday_count", *HOLIDAY_TEXTS, *HOLIDAY_FLAGS],
                    "holidays")
    span = one_row(dim_date.agg(F.min("full_date").alias("a"), F.max("full_date").alias("z")))
    inside = holidays.filter(F.col("date").between(span["a"], span["z"]))
    mapped = _map_store_day(inside, dim_date, dim_store)
    bridge = mapped.select("date_key", "store_key", "holiday_count", *HOLIDAY_TEXTS, *HOLIDAY_FLAGS)
    if check:
        verify_mapping(inside, mapped, STORE_DAY_KEYS, "bridge_store_holiday")
        assert_unique(bridge, ["date_key", "store_key"], "bridge_store_holiday")
    return bridge


def observed_store_days(observations: DataFrame, dim_date: DataFrame, dim_store: DataFrame,
                        name: str, check: bool = True) -> DataFrame:
    """Distinct (date_key, store_key) pairs that occur in a source."""
    require_columns(observations, ["date", "store_nbr"], name)
    days = observations.select("date", "store_nbr").distinct()
    mapped = _map_store_day(days, dim_date, dim_store)
    if check:
        verify_mapping(days, mapped, STORE_DAY_KEYS, name)
    return mapped.select("date_key", "store_key")


def build_dim_store_date(dim_date: DataFrame, dim_store: DataFrame, bridge: DataFrame,
                         train: DataFrame, transactions: DataFrame, check: bool = True) -> DataFrame:
    """Every store on every calendar day, with holiday defaults and presence flags.

    Each store row generates its own days, so the grid needs no product of two tables.
    """
    span = one_row(dim_date.agg(F.min("full_date").alias("a"), F.max("full_date").alias("z")))
    grid = dim_store.select("store_key", daily_sequence(span["a"], span["z"]).alias("_d")).select(
        date_key("_d").alias("date_key"), "store_key")
    keys = ["date_key", "store_key"]
    seen_sales = observed_store_days(train, dim_date, dim_store, "train", check)
    seen_visits = observed_store_days(transactions, dim_date, dim_store, "transactions", check)
    joined = (
        grid.join(bridge, keys, "left")
        .join(seen_sales.withColumn("_s", F.lit(1)), keys, "left")
        .join(seen_visits.withColumn("_t", F.lit(1)), keys, "left")
    )
    return joined.select(
        store_day_key().alias("date_store_key"),
        *keys,
        F.coalesce("holiday_count", F.lit(0).cast("long")).alias("holiday_count"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in HOLIDAY_TEXTS],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in HOLIDAY_FLAGS],
        F.coalesce("_s", F.lit(0)).alias("has_sales_observation"),
        F.coalesce("_t", F.lit(0)).alias("has_transaction_observation"),
    )


def store_day_key() -> Column:
    """One key for every date and store key that fits 31 bits; facts, grid and checks all use it."""
    return F.col("date_key").cast("long") * STORE_KEYS + F.col("store_key")


def attach_date_store_key(fact: DataFrame, dim_store_date: DataFrame, check: bool = True) -> DataFrame:
    """Store-day key of every fact row.

    The key is a function of its two parts, so the fact is not shuffled for a join with
    the grid; only its distinct store-days are compared with the grid.
    """
    keys = ["date_key", "store_key"]
    if check:
        lost = fact.select(*keys).distinct().join(dim_store_date.select(*keys), keys, "left_anti")
        examples = [tuple(row) for row in lost.limit(5).collect()]
        if examples:
            raise ValueError(f"fact rows outside the store-day grid: {examples}")
    return fact.withColumn("date_store_key", store_day_key())


def build_fact_daily_sales(train: DataFrame, dim_date: DataFrame, dim_store: DataFrame,
                           dim_family: DataFrame, dim_store_date: DataFrame,
                           check: bool = True) -> DataFrame:
    require_columns(train, ["id", "date", "store_nbr", "family", "sales", "onpromotion",
                            "is_promotion"], "train")
    mapped = _map_store_day(train, dim_date, dim_store).join(
        dim_family.select("family_key", "family"), "family", "left")
    fact = attach_date_store_key(mapped, dim_store_date, check=check).select(
        F.col("id").alias("sales_id"), "date_key", "store_key", "date_store_key", "family_key",
        F.col("sales").cast("double").alias("sales"), "onpromotion", "is_promotion",
    )
    if check:
        verify_mapping(train, mapped, {**STORE_DAY_KEYS, "family_key": "family"}, "fact_daily_sales",
                       {"sales": 1e-6, "onpromotion": 0.0})
        assert_unique(fact, ["date_key", "store_key", "family_key"], "fact_daily_sales")
    return fact


def build_fact_store_transactions(transactions: DataFrame, dim_date: DataFrame,
                                  dim_store: DataFrame, check: bool = True) -> DataFrame:
    require_columns(transactions, ["date", "store_nbr", "transactions"], "transactions")
    mapped = _map_store_day(transactions, dim_date, dim_store)
    fact = mapped.select("date_key", "store_key", "transactions")
    if check:
        verify_mapping(transactions, mapped, STORE_DAY_KEYS, "fact_store_transactions", {"transactions": 0.0})
        assert_unique(fact, ["date_key", "store_key"], "fact_store_transactions")
    return fact


def build_fact_oil_price(oil: DataFrame, dim_date: DataFrame, check: bool = True) -> DataFrame:
    columns = ["oil_price", "oil_change_1d", "oil_change_7d", "oil_pct_change_7d", "oil_was_imputed"]
    require_columns(oil, ["date", *columns], "oil")
    fact = oil.join(dim_date.select("date_key", F.col("full_date").alias("date")), "date").select(
        "date_key", *columns)
    if check:
        if oil.join(dim_date.select(F.col("full_date").alias("date")), "date", "left_anti").limit(1).count():
            raise ValueError("fact_oil_price: unmapped date values")
        if oil.filter(F.col("oil_price").isNull()).limit(1).count():
            raise ValueError("fact_oil_price: oil_price contains missing values")
        assert_unique(fact, ["date_key"], "fact_oil_price")
        if fact.count() != dim_date.count():
            raise RuntimeError("fact_oil_price: rows do not match the calendar")
    return fact

