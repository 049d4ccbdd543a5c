"""Typed file sources: CSV with declared schemas and Parquet table sets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfcast import schemas

# Source name, file name and declared schema.
CSV_SOURCES: dict[str, tuple[str, T.StructType]] = {
    "train": ("train.csv", schemas.TRAIN_SCHEMA),
    "test": ("test.csv", schemas.TEST_SCHEMA),
    "stores": ("stores.csv", schemas.STORES_SCHEMA),
    "transactions": ("transactions.csv", schemas.TRANSACTIONS_SCHEMA),
    "oil": ("oil.csv", schemas.OIL_SCHEMA),
    "holidays": ("holidays_events.csv", schemas.HOLIDAYS_SCHEMA),
    "sample_submission": ("sample_submission.csv", schemas.SUBMISSION_SCHEMA),
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test on whatever file system the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(jvm_path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; malformed rows stop the job."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"source file not found: {path}")
    return (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
        .option("dateFormat", "yyyy-MM-dd").csv(path)
    )


def load_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in CSV_SOURCES:
        raise KeyError(f"unknown source: {name}")
    file_name, schema = CSV_SOURCES[name]
    return read_csv(spark, f"{folder}/{file_name}", schema)


def write_csv_source(df: DataFrame, folder: str, name: str) -> None:
    """A source table as CSV files that ``load_source`` reads back: declared columns, in their order, with headers."""
    file_name, schema = CSV_SOURCES[name]
    rows = df.select(*schema.fieldNames()).write.mode("overwrite")
    rows.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{folder}/{file_name}")


def load_all_sources(spark: SparkSession, folder: str, register: bool = False) -> dict[str, DataFrame]:
    """Every source by name, optionally also as temporary views."""
    tables = {name: load_source(spark, folder, name) for name in CSV_SOURCES}
    if register:
        register_views(tables)
    return tables


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def read_tables(spark: SparkSession, folder: str, names: Iterable[str],
                columns: Mapping[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Parquet tables by name; all missing ones are named in one error."""
    names = list(names)
    missing = [name for name in names if not path_exists(spark, f"{folder}/{name}")]
    if missing:
        raise FileNotFoundError("missing tables: " + ", ".join(missing))
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    for name, wanted in (columns or {}).items():
        tables[name] = tables[name].select(*wanted)
    return tables
