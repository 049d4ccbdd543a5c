"""Table sinks: gated writes, read-back checks, staged publishing and resume."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.columns import is_finite
from shelfcast.operators.audit import count_duplicates, union_all
from shelfcast.sources.files import path_exists, read_tables

# Load order of the warehouse: parents before children.
LOAD_ORDER = [
    "dim_date", "dim_store", "dim_family", "dim_store_date",
    "fact_daily_sales", "fact_store_transactions", "fact_oil_price", "bridge_store_holiday",
]
CALENDAR_FLAGS = ["is_weekend", "is_month_start", "is_month_end", "is_payday"]
PARTITIONED = {"fact_daily_sales", "fact_store_transactions", "dim_store_date"}
# Measure compared after a load: table, column, tolerance (None means equal).
MEASURES = [
    ("fact_daily_sales", "sales", 1e-6),
    ("fact_daily_sales", "onpromotion", None),
    ("fact_store_transactions", "transactions", None),
]


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by_year: bool = False) -> None:
    """Write one Parquet table; large ones by year of ``date_key``.

    The rebalance hint lets adaptive execution split a year that holds most of the rows
    and merge small ones, so file sizes stay even without a fixed partition count.
    """
    if by_year:
        df = df.withColumn("year", F.floor(F.col("date_key") / 10000).cast("int"))
        df.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], order: str, buckets: int) -> None:
    """Write ``df`` as a table in ``buckets`` files by ``keys``, each sorted by keys and ``order``.

    Aggregations, windows and joins by ``keys`` over the table need no shuffle of it.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(
        *keys, order).option("path", path).saveAsTable(table)


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}", mode, by_year=name in PARTITIONED)


def load_warehouse(tables: Mapping[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Load in parent-first order with calendar flags as booleans; ``overwrite`` replaces."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    for name in LOAD_ORDER:
        table = tables[name]
        if name == "dim_date":
            table = table.withColumns({c: F.col(c).cast("boolean") for c in CALENDAR_FLAGS})
        write_table(table, f"{folder}/{name}", mode)


def load_check(source: Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, measure totals and date bounds of source against stored tables."""
    plans = [(name, "rows", F.count(F.lit(1)), None) for name in LOAD_ORDER]
    plans += [(name, f"total {c}", F.sum(c), tolerance) for name, c, tolerance in MEASURES]
    plans += [("dim_date", "first date_key", F.min("date_key"), None),
              ("dim_date", "last date_key", F.max("date_key"), None)]
    a, b = F.col("source_value"), F.col("stored_value")
    frames = []
    for name, label, measure, tolerance in plans:
        stored_value = stored[name].agg(measure.cast("double").alias("v")).scalar()
        equal = a == b if tolerance is None else F.abs(a - b) <= tolerance
        frames.append(
            source[name].agg(measure.cast("double").alias("source_value"))
            .select(F.lit(f"{name} {label}").alias("check_name"), "source_value",
                    stored_value.alias("stored_value"))
            .withColumn("passed", F.coalesce(equal, a.isNull() & b.isNull()))
        )
    return union_all(frames)


def publish(df: DataFrame, folder: str, validate: Callable[[DataFrame], None]) -> DataFrame:
    """Write a new version of a published table, validate what was really stored, then let readers see it.

    A version is written once, into a folder of its own. Readers follow the newest of numbered pointers, and a pointer is
    one file that either exists or not: a refused version, or a driver lost at any point, leaves the version before it
    current. Of two publishers that take the same number, readers all follow the one with the larger name; both versions are whole."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{version}")
    validate(spark.read.schema(df.schema).parquet(f"{folder}/versions/{version}"))
    _create(spark, f"{folder}/pointers/{max(_pointers(spark, folder), default=(0, ''))[0] + 1:012d}-{version}")
    return read_published(spark, folder)


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a published table."""
    found = _pointers(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing has been published in {folder}")
    return spark.read.parquet(f"{folder}/versions/{max(found)[1]}")


class Staged:
    """One new version of a set of tables; readers see all of them after ``release``, or none.

    Each table is written once, so a table may be built from the stored copies of those added before it. What ``release``
    checks is what was stored. A refused version, or a driver lost before the pointer, leaves the version before it current.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.version = spark, folder, uuid.uuid4().hex
        self.tables: dict[str, DataFrame] = {}

    def add(self, name: str, table: DataFrame, by_year: bool = False) -> DataFrame:
        """The stored copy of a table; large ones lie in folders by year."""
        path = f"{self.folder}/versions/{self.version}/{name}"
        write_table(table, path, by_year=by_year)
        stored = self.spark.read.parquet(path)
        self.tables[name] = stored.drop("year") if by_year else stored
        return self.tables[name]

    def release(self, check: Callable[[Mapping[str, DataFrame]], None]) -> str:
        """Check the stored tables, switch readers to them and give the folder of the version."""
        check(self.tables)
        number = max(_pointers(self.spark, self.folder), default=(0, ""))[0] + 1
        _create(self.spark, f"{self.folder}/pointers/{number:012d}-{self.version}")
        return f"{self.folder}/versions/{self.version}"


def read_published_tables(spark: SparkSession, folder: str, names: Iterable[str],
                          columns: Mapping[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables of the current version of a published set, all of one version; of some only the named columns."""
    found = _pointers(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing has been published in {folder}")
    tables = read_tables(spark, f"{folder}/versions/{max(found)[1]}", list(names), columns)
    return {name: table.drop("year") if name in PARTITIONED else table for name, table in tables.items()}


def drop_old_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove versions before the ``keep`` newest published ones, and give their names; unpublished ones are left to their writers."""
    old = sorted(_pointers(spark, folder))[:-keep]
    for number, version in old:
        for path in (f"{folder}/pointers/{number:012d}-{version}", f"{folder}/versions/{version}"):
            system, place = _file_system(spark, path)
            system.delete(place, True)
    return [version for _, version in old]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _create(spark: SparkSession, path: str) -> None:
    """An empty file; fails if it is there."""
    system, place = _file_system(spark, path)
    system.create(place, False).close()


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of every publication: one short name each."""
    system, place = _file_system(spark, f"{folder}/pointers")
    if not system.exists(place):
        return []
    names = [x.getPath().getName() for x in system.listStatus(place)]
    return [(int(n.split("-")[0]), n.split("-")[1]) for n in names if not n.startswith((".", "_"))]


def missing_runs(spark: SparkSession, planned: DataFrame, path: str,
                 keys: list[str]) -> DataFrame:
    """Planned (experiment, fold) pairs without a stored score."""
    if not path_exists(spark, path):
        return planned
    return planned.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def append_scores(scores: DataFrame, path: str, partition_by: list[str]) -> None:
    scores.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_result(df: DataFrame, path: str, grain: list[str], name: str) -> None:
    """Result table sink: unique grain and finite numbers first, then the write."""
    if count_duplicates(df, grain):
        raise ValueError(f"{name}: duplicate grain {', '.join(grain)}")
    bad = non_finite_count(df)
    if bad:
        raise ValueError(f"{name}: {bad} non-finite numbers")
    df.write.mode("overwrite").parquet(path)


def non_finite_count(df: DataFrame) -> int:
    doubles = [c for c, kind in df.dtypes if kind in ("double", "float")]
    if not doubles:
        return 0
    counts = [F.count_if(F.col(c).isNotNull() & ~is_finite(c)) for c in doubles]
    total = counts[0]
    for extra in counts[1:]:
        total = total + extra
    return int(df.agg(total.alias("n")).first()["n"])
