"""Declared source schemas, table grains and column lists."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TRAIN_SCHEMA = _struct(
    ("id", T.LongType()), ("date", T.DateType()), ("store_nbr", T.IntegerType()),
    ("family", T.StringType()), ("sales", T.DoubleType()), ("onpromotion", T.IntegerType()),
)
TEST_SCHEMA = _struct(
    ("id", T.LongType()), ("date", T.DateType()), ("store_nbr", T.IntegerType()),
    ("family", T.StringType()), ("onpromotion", T.IntegerType()),
)
STORES_SCHEMA = _struct(
    ("store_nbr", T.IntegerType()), ("city", T.StringType()), ("state", T.StringType()),
    ("type", T.StringType()), ("cluster", T.IntegerType()),
)
TRANSACTIONS_SCHEMA = _struct(
    ("date", T.DateType()), ("store_nbr", T.IntegerType()), ("transactions", T.IntegerType()),
)
OIL_SCHEMA = _struct(("date", T.DateType()), ("dcoilwtico", T.DoubleType()))
HOLIDAYS_SCHEMA = _struct(
    ("date", T.DateType()), ("type", T.StringType()), ("locale", T.StringType()),
    ("locale_name", T.StringType()), ("description", T.StringType()),
    ("transferred", T.BooleanType()),
)
SUBMISSION_SCHEMA = _struct(("id", T.LongType()), ("sales", T.DoubleType()))

SERIES = ["store_nbr", "family"]
SALES_GRAIN = ["date", "store_nbr", "family"]
STORE_DAY = ["date", "store_nbr"]

CLEAN_GRAINS = {
    "train": SALES_GRAIN,
    "test": SALES_GRAIN,
    "stores": ["store_nbr"],
    "transactions": STORE_DAY,
    "oil": ["date"],
    "holidays": STORE_DAY,
}

WAREHOUSE_GRAINS = {
    "dim_date": ["date_key"],
    "dim_store": ["store_key"],
    "dim_family": ["family_key"],
    "dim_store_date": ["date_key", "store_key"],
    "fact_daily_sales": ["date_key", "store_key", "family_key"],
    "fact_store_transactions": ["date_key", "store_key"],
    "fact_oil_price": ["date_key"],
    "bridge_store_holiday": ["date_key", "store_key"],
}

STORE_ATTRIBUTES = ["store_nbr", "city", "state", "store_type", "cluster"]
HOLIDAY_TEXTS = ["holiday_descriptions", "holiday_types", "holiday_locales"]
HOLIDAY_FLAGS = ["is_holiday", "is_work_day", "is_event"]
# Event types that count as a day off.
DAY_OFF_TYPES = ["Holiday", "Transfer", "Additional", "Bridge"]
