"""Stored tables shared by the jobs of one session.

Layers are written once as Parquet below the shared folder and read back, the way the
batch jobs hand tables to each other: no job recomputes the layers before it, plans stay
short, and a lost executor only costs the task it ran.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.forecast import submission
from shelfcast.functions.columns import one_row
from shelfcast.operators import cleaning, features, marts, quality, warehouse
from shelfcast.schemas import SERIES, WAREHOUSE_GRAINS
from shelfcast.session import shared_folder
from shelfcast.sources import files, load, sinks, star_adapter

_WORKSPACES: dict[tuple[type, str, str], "Workspace"] = {}


class Workspace:
    """Raw, clean and warehouse tables derived from one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        label = hashlib.sha256(self.folder.encode()).hexdigest()[:12]
        self.root = f"{shared_folder(spark)}/shelfcast-{spark.sparkContext.applicationId}/{label}"
        self._done: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}
        self._files: set[str] = set()

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Workspace":
        key = (cls, spark.sparkContext.applicationId, folder.rstrip("/"))
        if key not in _WORKSPACES:
            _WORKSPACES[key] = cls(spark, folder)
        space = _WORKSPACES[key]
        if space.spark is not spark:
            space.spark = spark
            space._done = {name: space._reader(name, path) for name, path in space._paths.items()}
        return space

    def stored(self, name: str, build: Callable[[], DataFrame], by_year: bool = False) -> DataFrame:
        """The table ``name``, built and written at its first use."""
        if name not in self._done:
            path = f"{self.root}/{name}"
            sinks.write_table(build(), path, by_year=by_year)
            self._keep(name, path)
        table = self._done[name]
        return table.drop("year") if by_year else table

    def holds(self, name: str) -> bool:
        return name in self._done

    def _keep(self, name: str, path: str) -> None:
        self._paths[name], self._done[name] = path, self._reader(name, path)

    def _reader(self, name: str, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _read(self, name: str, by_year: bool = False) -> DataFrame:
        return self._done[name].drop("year") if by_year else self._done[name]

    # ------------------------------------------------------------ store x family layer

    def raw(self) -> dict[str, DataFrame]:
        """Source tables; the big join runs once and everything else reads its result."""
        spark, folder = self.spark, self.folder
        sales = self.stored("raw_sales", lambda: star_adapter.sales(spark, folder))
        return {
            "train": self.stored("raw_train", lambda: star_adapter.numbered_sales(sales)),
            "stores": self.stored("raw_stores", lambda: star_adapter.stores(spark, folder)),
            "transactions": self.stored("raw_transactions", lambda: star_adapter.transactions(spark, folder)),
            "oil": self.stored("raw_oil", lambda: star_adapter.oil(spark, folder)),
            "holidays": self.stored("raw_holidays", lambda: star_adapter.holidays(spark, folder)),
        }

    def csv_sources(self) -> dict[str, DataFrame]:
        """All seven sources, written as CSV files once and read back with their declared types."""
        folder = f"{self.root}/csv"
        if "csv" not in self._files:
            future = self.rollup()["future"]
            tables = {**self.raw(), "test": future, "sample_submission": future.select("id", F.lit(0.0).alias("sales"))}
            for name, table in tables.items():
                files.write_csv_source(table, folder, name)
            self._files.add("csv")
        return files.load_all_sources(self.spark, folder)

    def clean(self) -> dict[str, DataFrame]:
        """Cleaned tables; readers see them after the gate has passed on the stored copies."""
        names = ("train", "stores", "transactions", "oil", "holidays")
        if "clean_train" not in self._done:
            raw, staged = self.raw(), sinks.Staged(self.spark, f"{self.root}/clean")
            stores = staged.add("stores", cleaning.clean_stores(raw["stores"]))
            start, end = cleaning.calendar_bounds(raw["train"], raw["transactions"])
            staged.add("train", cleaning.clean_train(raw["train"]))
            staged.add("transactions", cleaning.clean_transactions(raw["transactions"]))
            staged.add("oil", cleaning.clean_oil(raw["oil"], start, end))
            staged.add("holidays", cleaning.clean_holidays(raw["holidays"], stores))
            folder = staged.release(quality.enforce_clean_gate)
            for name in names:
                self._keep(f"clean_{name}", f"{folder}/{name}")
        return {name: self._read(f"clean_{name}") for name in names}

    def warehouse(self) -> dict[str, DataFrame]:
        """The star schema; readers see it after validation and reconciliation of the stored copies."""
        if "dim_date" not in self._done:
            clean, staged = self.clean(), sinks.Staged(self.spark, f"{self.root}/warehouse")
            stage_warehouse(staged, clean)
            folder = staged.release(lambda stored: quality.enforce_warehouse_gate(clean, stored))
            for name in WAREHOUSE_GRAINS:
                self._keep(name, f"{folder}/{name}")
        return {name: self._read(name, name in sinks.PARTITIONED) for name in WAREHOUSE_GRAINS}

    def loaded(self) -> str:
        """Folder of the loaded star: an early load, a full replacement up to a middle day, the days after it, and a replay."""
        folder, t = f"{self.root}/loaded", self.warehouse()
        middle = one_row(t["dim_date"].agg(F.percentile_approx("date_key", 0.5).alias("day")))["day"]
        facts = [name for name in sinks.LOAD_ORDER if name.startswith("fact_")]
        first = {name: t[name].filter(F.col("date_key") <= middle) if name in facts else t[name] for name in sinks.LOAD_ORDER}
        rest = {name: t[name].filter(F.col("date_key") > middle) for name in facts}
        load.load_batch(self.spark, {name: t[name] for name in ("dim_date", "dim_store")}, folder, "early")
        load.load_batch(self.spark, first, folder, "first", replace=True)
        load.load_batch(self.spark, rest, folder, "second")
        load.load_batch(self.spark, rest, folder, "second")
        return folder

    def marts(self) -> dict[str, DataFrame]:
        """The five marts, stored once: the checks read each of them several times."""
        t = self.warehouse()
        return {name: self.stored(f"mart_{name}", lambda build=build: build(t)) for name, build in marts.MARTS.items()}

    # ------------------------------------------------------------ dense rollup layer

    def rollup(self) -> dict[str, DataFrame]:
        """train, future, all (with held-out days), stores and holidays of the dense series."""
        raw = self.raw()
        everything = self.stored("rollup_all", lambda: star_adapter.rollup(
            raw["train"], self.spark, self.folder))
        split: dict[str, DataFrame] = {}

        def part(name: str) -> DataFrame:
            if not split:
                split["train"], split["future"] = star_adapter.rollup_train_and_future(everything)
            return split[name]

        return {
            "all": everything,
            "train": self.stored("rollup_train", lambda: part("train")),
            "future": self.stored("rollup_future", lambda: part("future")),
            "stores": self.stored("rollup_stores", lambda: cleaning.clean_stores(
                star_adapter.rollup_stores(self.spark, self.folder))),
            "raw_holidays": raw["holidays"],
        }

    def rollup_star(self) -> dict[str, DataFrame]:
        """The star tables that series readiness needs, over the dense series."""
        rolled = self.rollup()
        if "rollup_fact" not in self._done:
            train = cleaning.clean_train(rolled["train"])
            start, end = cleaning.calendar_bounds(train)
            dim_date = self.stored("rollup_dim_date", lambda: warehouse.build_dim_date(self.spark, start, end))
            dim_store = self.stored("rollup_dim_store", lambda: warehouse.build_dim_store(rolled["stores"]))
            dim_family = self.stored("rollup_dim_family", lambda: warehouse.build_dim_family(train))
            fact = train.join(dim_date.select("date_key", F.col("full_date").alias("date")), "date").join(
                dim_store.select("store_key", "store_nbr"), "store_nbr").join(dim_family, "family")
            self.stored("rollup_fact", lambda: fact.select(
                "date_key", "store_key", "family_key", "sales", "onpromotion", "is_promotion"))
        return {"dim_date": self.stored("rollup_dim_date", lambda: None),
                "dim_store": self.stored("rollup_dim_store", lambda: None),
                "dim_family": self.stored("rollup_dim_family", lambda: None),
                "fact_daily_sales": self.stored("rollup_fact", lambda: None)}

    def training_frame(self) -> DataFrame:
        """All features of the dense series over history and horizon."""
        rolled = self.rollup()
        return self.stored("rollup_training_frame", lambda: submission.final_inputs(
            rolled["train"], rolled["future"], rolled["stores"], rolled["raw_holidays"]))

    def known_frame(self) -> DataFrame:
        return self.training_frame().drop(*features.LAG_FEATURES, *features.ROLLING_FEATURES)


class SeriesWorkspace(Workspace):
    """The forecast layers with every store and family as a series of its own; sources and warehouse are shared.

    The history is stored bucketed by series and sorted by day: densifying, lags, rolling statistics and folds of one
    series find all its rows in one file and need no shuffle of their own.
    """

    #: Rows of the history in a bucket; the number of buckets follows the table's size.
    BUCKET_ROWS = 1 << 20

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.root += "-store-family"
        self._tables: dict[str, str] = {}

    @property
    def base(self) -> Workspace:
        return Workspace.of(self.spark, self.folder)

    def raw(self) -> dict[str, DataFrame]:
        return self.base.raw()

    def clean(self) -> dict[str, DataFrame]:
        return self.base.clean()

    def warehouse(self) -> dict[str, DataFrame]:
        return self.base.warehouse()

    def bucketed(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name``, bucketed by series, one file a bucket."""
        if name not in self._done:
            table, path = f"shelfcast_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{name}", f"{self.root}/{name}"
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(least, -(-self.raw()["train"].count() // self.BUCKET_ROWS))
            sinks.write_bucketed(build(), table, path, SERIES, "date", buckets)
            self._tables[name] = table
            self._keep(name, path)
        return self._done[name]

    def _reader(self, name: str, path: str) -> DataFrame:
        return self.spark.table(self._tables[name]) if name in self._tables else super()._reader(name, path)

    def rollup(self) -> dict[str, DataFrame]:
        """train, future, all, stores and holidays as in the rolled-up layer, one series per store and family."""
        raw = self.raw()
        everything = raw["train"].drop("id")
        split: dict[str, DataFrame] = {}

        def part(name: str) -> DataFrame:
            if not split:
                split["train"], split["future"] = star_adapter.rollup_train_and_future(everything)
            return split[name]

        return {
            "all": everything,
            "train": self.bucketed("train", lambda: part("train")),
            "future": self.stored("future", lambda: part("future")),
            "stores": self.stored("stores", lambda: cleaning.clean_stores(raw["stores"])),
            "raw_holidays": raw["holidays"],
        }

    def rollup_star(self) -> dict[str, DataFrame]:
        return self.warehouse()


def stage_warehouse(staged: sinks.Staged, clean: dict[str, DataFrame]) -> None:
    """Write the eight tables; dimensions, bridge and grid are stored before facts use them."""
    start, end = cleaning.calendar_bounds(clean["train"], clean["transactions"])
    dim_date = staged.add("dim_date", warehouse.build_dim_date(staged.spark, start, end))
    dim_store = staged.add("dim_store", warehouse.build_dim_store(clean["stores"]))
    dim_family = staged.add("dim_family", warehouse.build_dim_family(clean["train"]))
    bridge = staged.add("bridge_store_holiday", warehouse.build_bridge_store_holiday(
        clean["holidays"], dim_date, dim_store))
    grid = staged.add("dim_store_date", warehouse.build_dim_store_date(
        dim_date, dim_store, bridge, clean["train"], clean["transactions"]), by_year=True)
    staged.add("fact_daily_sales", warehouse.build_fact_daily_sales(
        clean["train"], dim_date, dim_store, dim_family, grid), by_year=True)
    staged.add("fact_store_transactions", warehouse.build_fact_store_transactions(
        clean["transactions"], dim_date, dim_store), by_year=True)
    staged.add("fact_oil_price", warehouse.build_fact_oil_price(clean["oil"], dim_date))
