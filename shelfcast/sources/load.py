"""Load of the star schema in batches, each taken once.

A batch writes its tables into folders of its own, parents first, is read back and held against what was given, and counts
from the moment its entry in the ledger exists. The ledger is a folder of empty files, one per batch. A driver lost before
that leaves files that nobody reads; a batch that is sent again adds nothing; a replacing batch hides all before it at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.audit import count_duplicates, union_all
from shelfcast.operators.quality import FOREIGN_KEYS, rows_without_parent
from shelfcast.schemas import WAREHOUSE_GRAINS
from shelfcast.sources import sinks


class Entry(NamedTuple):
    """One line of the ledger."""

    number: int
    mode: str
    batch: str
    attempt: str


def ledger(spark: SparkSession, folder: str) -> list[Entry]:
    """Batches taken, in order; of two loaders that sent one batch at the same time, the first entry counts."""
    system, place = sinks._file_system(spark, f"{folder}/ledger")
    if not system.exists(place):
        return []
    names = [x.getPath().getName() for x in system.listStatus(place)]
    entries = sorted(Entry(int(n), mode, batch, attempt) for n, mode, batch, attempt in (
        name.split("-") for name in names if not name.startswith((".", "_"))))
    first: dict[str, Entry] = {}
    for entry in entries:
        first.setdefault(entry.batch, entry)
    return sorted(first.values())


def live(entries: Iterable[Entry]) -> list[Entry]:
    """Entries from the last replacing one on."""
    kept: list[Entry] = []
    for entry in entries:
        kept = [entry] if entry.mode == "replace" else [*kept, entry]
    return kept


def _read(spark: SparkSession, folder: str, name: str, attempts: list[str]) -> DataFrame | None:
    base = f"{folder}/tables/{name}"
    paths = [path for path in (f"{base}/attempt={a}" for a in attempts) if sinks.path_exists(spark, path)]
    if not paths:
        return None
    return spark.read.option("basePath", base).parquet(*paths).drop("attempt", "year")


def read_loaded(spark: SparkSession, folder: str, names: Iterable[str] = tuple(sinks.LOAD_ORDER)) -> dict[str, DataFrame]:
    """The loaded tables, all as of one state of the ledger."""
    attempts = [entry.attempt for entry in live(ledger(spark, folder))]
    tables = {name: _read(spark, folder, name, attempts) for name in names}
    missing = [name for name, table in tables.items() if table is None]
    if missing:
        raise FileNotFoundError("not loaded: " + ", ".join(missing))
    return tables


def batch_totals(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, measure and value: rows, summed measures and bounds of the days of each table; one pass over each."""
    frames = []
    for name, table in tables.items():
        measures = {"rows": F.count(F.lit(1))} | {
            f"total {c}": F.sum(c) for t, c, _ in sinks.MEASURES if t == name}
        if "date_key" in table.columns:
            measures |= {"first date_key": F.min("date_key"), "last date_key": F.max("date_key")}
        one_pass = table.agg(*[value.cast("double").alias(f"m{i}") for i, value in enumerate(measures.values())])
        entries = [F.struct(F.lit(label).alias("measure"), F.col(f"m{i}").alias("value")) for i, label in enumerate(measures)]
        frames.append(one_pass.select(F.inline(F.array(*entries))).select(
            F.lit(name).alias("table_name"), "measure", "value"))
    return union_all(frames)


def differing_totals(a: DataFrame, b: DataFrame) -> list[str]:
    """Labels of totals that differ; sums of doubles may differ by the order of addition."""
    x, y = F.col("a.value"), F.col("b.value")
    same = x.eqNullSafe(y) | (F.abs(x - y) <= 1e-6 + 1e-9 * F.abs(x))
    joined = a.alias("a").join(b.alias("b"), ["table_name", "measure"], "full").filter(~F.coalesce(same, F.lit(False)))
    return sorted(f"{row['table_name']} {row['measure']}" for row in joined.select("table_name", "measure").collect())


def load_batch(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, batch: str, replace: bool = False) -> bool:
    """Load some tables of the star as one batch; false if the batch had been taken before.

    Keys must be present, unique within the batch and new to the tables loaded; foreign keys must be found in the parents
    loaded or in the batch. A batch of a known name must bring the totals it brought the first time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.]+", batch):
        raise ValueError("a batch is named by letters, digits, points and underscores")
    unknown = sorted(set(tables) - set(sinks.LOAD_ORDER))
    if unknown:
        raise ValueError("not tables of the star: " + ", ".join(unknown))
    ordered = {name: _loadable(name, tables[name]) for name in sinks.LOAD_ORDER if name in tables}
    taken = ledger(spark, folder)
    given = batch_totals(ordered)
    for entry in taken:
        if entry.batch == batch:
            known = spark.read.parquet(f"{folder}/totals/{entry.attempt}")
            differing = differing_totals(given, known)
            if differing:
                raise ValueError(f"batch {batch} was taken with other content: {', '.join(differing)}")
            return False
    attempt = uuid.uuid4().hex
    for name, table in ordered.items():
        sinks.write_table(table, f"{folder}/tables/{name}/attempt={attempt}", by_year=name in sinks.PARTITIONED)
    stored = {name: _read(spark, folder, name, [attempt]) for name in ordered}
    batch_totals(stored).write.parquet(f"{folder}/totals/{attempt}")
    differing = differing_totals(given, spark.read.parquet(f"{folder}/totals/{attempt}"))
    if differing:
        raise RuntimeError(f"batch {batch}: stored totals differ: {', '.join(differing)}")
    before = [] if replace else [entry.attempt for entry in live(taken)]
    check_keys(spark, folder, batch, stored, before)
    number = max((entry.number for entry in taken), default=0) + 1
    sinks._create(spark, f"{folder}/ledger/{number:012d}-{'replace' if replace else 'append'}-{batch}-{attempt}")
    return True


def check_keys(spark: SparkSession, folder: str, batch: str, stored: Mapping[str, DataFrame], before: list[str]) -> None:
    """Refuse a stored batch with missing, repeated or orphaned keys."""
    faults = []
    for name, table in stored.items():
        grain = WAREHOUSE_GRAINS[name]
        missing = " OR ".join(f"{key} IS NULL" for key in grain)
        if table.filter(missing).limit(1).count():
            faults.append(f"{name}: missing key")
        if count_duplicates(table, grain):
            faults.append(f"{name}: key twice in the batch")
        old = _read(spark, folder, name, before)
        if old is not None and table.join(old.select(*grain), grain, "left_semi").limit(1).count():
            faults.append(f"{name}: key loaded before")
    for child, parent, keys in [rule for rules in FOREIGN_KEYS.values() for rule in rules]:
        if child not in stored:
            continue
        parents = [t for t in (stored.get(parent), _read(spark, folder, parent, before)) if t is not None]
        if not parents:
            if stored[child].limit(1).count():
                faults.append(f"{child}: {parent} is not loaded")
            continue
        known = union_all([t.select(*keys) for t in parents])
        orphans = rows_without_parent(stored[child], known, keys).first()["n"]
        if orphans:
            faults.append(f"{child}: {orphans} rows without {parent}")
    if faults:
        raise ValueError(f"batch {batch} refused: {'; '.join(faults)}")


def _loadable(name: str, table: DataFrame) -> DataFrame:
    """Calendar flags are loaded as booleans."""
    return table.withColumns({c: F.col(c).cast("boolean") for c in sinks.CALENDAR_FLAGS}) if name == "dim_date" else table
