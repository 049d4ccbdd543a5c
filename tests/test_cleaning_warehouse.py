import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from shelfcast import schemas
from shelfcast.operators import audit, cleaning, quality, warehouse
from shelfcast.sources import files, sinks


def date(text):
    return F.lit(text).cast("date")


@pytest.fixture(scope="module")
def k1(spark):
    train = spark.createDataFrame([
        (10, day("2020-01-01"), 1, "A", 1.1234567, 1), (11, day("2020-01-01"), 1, "B", 0.0, 0),
        (12, day("2020-01-02"), 2, "A", 3.7654321, 2)], schemas.TRAIN_SCHEMA)
    stores = spark.createDataFrame([(2, " Cuenca ", "Azuay", "B", 2), (1, "Quito", "Pichincha", "A", 1)],
                                   schemas.STORES_SCHEMA)
    return cleaning.clean_train(train), cleaning.clean_stores(stores)


def test_fact_keeps_rows_sums_and_grain(spark, k1):
    train, stores = k1
    dim_date = warehouse.build_dim_date(spark, date("2020-01-01"), date("2020-01-02"))
    dim_store, dim_family = warehouse.build_dim_store(stores), warehouse.build_dim_family(train)
    bridge = spark.createDataFrame([], "date_key int, store_key int, holiday_count long, holiday_descriptions string, "
                                   "holiday_types string, holiday_locales string, is_holiday int, is_work_day int, is_event int")
    visits = spark.createDataFrame([(day("2020-01-01"), 1, 5)], schemas.TRANSACTIONS_SCHEMA)
    grid = warehouse.build_dim_store_date(dim_date, dim_store, bridge, train, visits)
    assert grid.count() == 4
    assert grid.agg(F.sum("has_sales_observation"), F.sum("has_transaction_observation")).first()[:] == (2, 1)
    fact = warehouse.build_fact_daily_sales(train, dim_date, dim_store, dim_family, grid)
    assert rows(fact.select("sales_id", "date_key", "store_key", "date_store_key", "family_key"), "sales_id") == [
        (10, 20200101, 1, 20200101 * 2**31 + 1, 1), (11, 20200101, 1, 20200101 * 2**31 + 1, 2),
        (12, 20200102, 2, 20200102 * 2**31 + 2, 1)]
    assert fact.agg(F.sum("sales")).first()[0] == pytest.approx(4.8888888, abs=1e-9)
    other = train.withColumn("family", F.lit("Z"))
    with pytest.raises(ValueError, match="unmapped family"):
        warehouse.build_fact_daily_sales(other, dim_date, dim_store, dim_family, grid)
    with pytest.raises(ValueError, match="unmapped date"):
        warehouse.build_fact_store_transactions(visits.withColumn("date", date("2021-01-01")), dim_date, dim_store)
    assert [r[1] for r in rows(dim_store.select("store_key", "city"), "store_key")] == ["Quito", "Cuenca"]
    short_grid = grid.filter("date_key > 20200101")
    with pytest.raises(ValueError, match="outside the store-day grid"):
        warehouse.build_fact_daily_sales(train, dim_date, dim_store, dim_family, short_grid)


def test_store_day_keys_of_many_stores(spark, k1):
    train, stores = k1
    one_day = train.filter("id = 10")
    many = spark.range(1, 151).select(F.col("id").cast("int").alias("n")).crossJoin(stores.limit(1)).withColumn("store_nbr", F.col("n")).drop("n")
    train = one_day.crossJoin(spark.range(1, 151).withColumnRenamed("id", "n")).withColumns(
        {"store_nbr": F.col("n").cast("int"), "id": F.col("n")}).drop("n")
    dim_date = warehouse.build_dim_date(spark, date("2020-01-01"), date("2020-01-02"))
    dim_store, dim_family = warehouse.build_dim_store(many), warehouse.build_dim_family(train)
    bridge = spark.createDataFrame([], "date_key int, store_key int, holiday_count long, holiday_descriptions string, "
                                   "holiday_types string, holiday_locales string, is_holiday int, is_work_day int, is_event int")
    visits = spark.createDataFrame([(day("2020-01-01"), 150, 5)], schemas.TRANSACTIONS_SCHEMA)
    grid = warehouse.build_dim_store_date(dim_date, dim_store, bridge, train, visits)
    fact = warehouse.build_fact_daily_sales(train, dim_date, dim_store, dim_family, grid)
    assert grid.select("date_store_key").distinct().count() == grid.count() == 300
    assert fact.join(grid, ["date_store_key", "date_key", "store_key"]).count() == fact.count() == 150


def test_date_dimension_rules(spark):
    dim = warehouse.build_dim_date(spark, date("2024-02-28"), date("2024-03-01"))
    assert rows(dim.select("date_key", "day_of_week", "day_name", "week_of_year", "quarter", "is_month_start",
                           "is_month_end", "is_payday"), "date_key") == [
        (20240228, 2, "Wednesday", 9, 1, 0, 0, 0), (20240229, 3, "Thursday", 9, 1, 0, 1, 1),
        (20240301, 4, "Friday", 9, 1, 1, 0, 0)]
    with pytest.raises(ValueError):
        warehouse.build_dim_date(spark, date("2024-03-02"), date("2024-03-01"))
    start, end = date("2024-02-28"), date("2024-03-01")
    assert warehouse.reuse_or_build_dim_date(spark, dim, start, end) is dim
    assert warehouse.reuse_or_build_dim_date(spark, dim.limit(2), start, end).count() == 3


STORES = [(1, "Quito", "Pichincha"), (2, "Cuenca", "Azuay"), (3, "Quito", "Pichincha")]


@pytest.mark.parametrize("locale,place,kind,moved,expected", [
    ("National", "Ecuador", "Holiday", False, [1, 2, 3]), ("Regional", "Azuay", "Additional", False, [2]),
    ("Local", "Quito", "Event", False, [1, 3]), ("National", "Ecuador", "Holiday", True, []),
    ("National", "Ecuador", "Transfer", True, [1, 2, 3])])
def test_holiday_scope(spark, locale, place, kind, moved, expected):
    stores = spark.createDataFrame(STORES, "store_nbr int, city string, state string")
    events = spark.createDataFrame([(day("2020-01-01"), kind, locale, place, "x", moved)], schemas.HOLIDAYS_SCHEMA)
    assert [r[0] for r in rows(cleaning.clean_holidays(events, stores).select("store_nbr"), "store_nbr")] == expected


def test_holiday_texts_are_distinct_and_ordered(spark):
    stores = spark.createDataFrame(STORES, "store_nbr int, city string, state string")
    events = spark.createDataFrame([
        (day("2020-01-01"), "Work Day", "National", "E", "b", False), (day("2020-01-01"), "Event", "Local", "Quito", "a", False),
        (day("2020-01-01"), "Event", "Local", "Quito", "a", False)], schemas.HOLIDAYS_SCHEMA)
    result = cleaning.clean_holidays(events, stores).filter("store_nbr = 1").first()
    assert (result["holiday_count"], result["holiday_descriptions"], result["holiday_types"]) == (3, "a | b", "Event | Work Day")
    assert (result["is_holiday"], result["is_work_day"], result["is_event"]) == (0, 1, 1)


def test_oil_is_filled_linearly_inside_and_by_edges(spark):
    oil = spark.createDataFrame([(day("2020-01-02"), 10.0), (day("2020-01-03"), None), (day("2020-01-04"), 14.0)],
                                schemas.OIL_SCHEMA)
    result = rows(cleaning.clean_oil(oil, date("2020-01-01"), date("2020-01-05")).select("oil_price", "oil_was_imputed", "date"), "date")
    assert [r[0] for r in result] == [10, 10, 12, 14, 14]
    assert [r[1] for r in result] == [1, 0, 1, 0, 1]
    with pytest.raises(ValueError, match="no observed"):
        cleaning.clean_oil(oil.filter("dcoilwtico IS NULL"), date("2020-01-01"), date("2020-01-05"))


def test_refusals(spark, k1):
    train = spark.createDataFrame([(1, day("2020-01-01"), 1, "A", -1.0, 0)], schemas.TRAIN_SCHEMA)
    with pytest.raises(ValueError, match="negative"):
        cleaning.clean_train(train)
    twice = spark.createDataFrame([(1, day("2020-01-01"), 1, "A", 1.0, 0), (2, day("2020-01-01"), 1, "A", 1.0, 0)],
                                  schemas.TRAIN_SCHEMA)
    with pytest.raises(ValueError, match="duplicate grain"):
        cleaning.clean_train(twice)
    copies = twice.withColumn("id", F.lit(1))
    assert cleaning.clean_train(copies).count() == 1
    with pytest.raises(KeyError):
        cleaning.clean_train(train.drop("sales"))
    visits = spark.createDataFrame([(day("2020-01-01"), 1, None)], schemas.TRANSACTIONS_SCHEMA)
    with pytest.raises(ValueError):
        cleaning.clean_transactions(visits)
    assert cleaning.snake_case(" Store Nbr# ") == "store_nbr"


def test_ratio_is_null_without_transactions(spark):
    daily = spark.createDataFrame([(day("2020-01-01"), 1, 10.0), (day("2020-01-02"), 1, 10.0), (day("2020-01-03"), 1, 10.0)],
                                  "date date, store_nbr int, total_sales double")
    visits = spark.createDataFrame([(day("2020-01-01"), 1, 4), (day("2020-01-02"), 1, 0)], schemas.TRANSACTIONS_SCHEMA)
    result = rows(cleaning.join_transactions(daily, visits).select("date", "sales_volume_per_transaction"), "date")
    assert [r[1] for r in result] == [2.5, None, None]


def test_profile_and_keys(spark):
    df = spark.createDataFrame([(1, None), (0, "a"), (-2, "a")], "n int, t string")
    result = {r["column_name"]: r for r in audit.column_profile(df, "x").collect()}
    assert (result["n"]["zero_count"], result["n"]["negative_count"], result["n"]["min_value"]) == (1, 1, -2.0)
    assert (result["t"]["missing_count"], result["t"]["missing_pct"], result["t"]["unique_count"]) == (1, 33.33, 1)
    assert result["t"]["zero_count"] is None
    parent = spark.createDataFrame([(1,)], "k int")
    child = spark.createDataFrame([(1,), (7,), (7,), (None,)], "k int")
    assert rows(audit.orphan_keys(child, "k", parent, "k", "c", "p").select("invalid_value", "affected_rows")) == [("7", 2)]
    with pytest.raises(KeyError):
        audit.grain_counts(df, ["missing"])


def test_status_and_broken_set(spark, folder):
    from shelfcast.plans.workspace import Workspace
    t = Workspace.of(spark, folder).warehouse()

    def broken(tables, marts):
        raise RuntimeError("boom")

    result = quality.run_check_sets(t, {}, {"row_counts": lambda a, b: quality.row_count_checks(a), "broken": broken})
    found = {r["check_name"]: r["status"] for r in result.collect()}
    assert found["broken"] == "FAIL" and found["dim_date_row_count"] == "PASS" and len(found) == 9
    odd = spark.createDataFrame([(False, "warning"), (False, "odd"), (True, "odd")], "passed boolean, severity string")
    assert [r[0] for r in odd.select(quality.status()).collect()] == ["WARNING", "FAIL", "PASS"]


def test_csv_sources_and_sinks(spark, tmp_path):
    (tmp_path / "train.csv").write_text("id,date,store_nbr,family,sales,onpromotion\n1,2020-01-01,1,A,1.1234567,0\n")
    train = files.load_source(spark, str(tmp_path), "train")
    assert train.schema == schemas.TRAIN_SCHEMA and train.first()["sales"] == 1.1234567
    with pytest.raises(FileNotFoundError):
        files.load_source(spark, str(tmp_path), "oil")
    train.write.parquet(str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).first()["sales"] == 1.1234567
    with pytest.raises(FileNotFoundError, match="b, c"):
        files.read_tables(spark, str(tmp_path), ["kept", "b", "c"])

    def refuse(df):
        raise ValueError("not good")

    with pytest.raises(ValueError):
        sinks.publish(train, str(tmp_path / "target"), refuse)
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, str(tmp_path / "target"))
    assert sinks.publish(train, str(tmp_path / "target"), lambda df: None).count() == 1
    bad = spark.createDataFrame([(1, float("inf"))], "k int, v double")
    with pytest.raises(ValueError, match="non-finite"):
        sinks.write_result(bad, str(tmp_path / "r"), ["k"], "r")


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = lambda: sorted(r["k"] for r in sinks.read_published(spark, folder).collect())
    table = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k int")

    def at_most_two(stored):
        if stored.count() > 2:
            raise ValueError("too many rows")

    sinks.publish(table(1), folder, at_most_two)
    reader = sinks.read_published(spark, folder)
    with pytest.raises(ValueError):
        sinks.publish(table(7, 8, 9), folder, at_most_two)
    assert rows() == [1]  # the refused version is not seen
    table(5).write.parquet(f"{folder}/versions/unfinished")  # a writer that was lost before its pointer
    assert rows() == [1]
    sinks.publish(table(2, 3), folder, at_most_two)
    assert rows() == [2, 3] and [r["k"] for r in reader.collect()] == [1]  # who reads the old version goes on
    for k in range(4, 15):
        sinks.publish(table(k), folder, at_most_two)
    assert rows() == [14] and len(sinks.drop_old_versions(spark, folder)) == 11 and rows() == [14]
    (tmp_path / "table" / "pointers" / "000000000014-x").touch()
    with pytest.raises(Exception):  # noqa: B017
        sinks._create(spark, f"{folder}/pointers/000000000014-x")


def test_load_and_compare(spark, folder, tmp_path):
    from shelfcast.plans.workspace import Workspace
    t = Workspace.of(spark, folder).warehouse()
    target = str(tmp_path / "db")
    sinks.load_warehouse(t, target, "overwrite")
    stored = files.read_tables(spark, target, sinks.LOAD_ORDER)
    assert dict(stored["dim_date"].dtypes)["is_payday"] == "boolean"
    assert not sinks.load_check(t, stored).filter("NOT passed").count()
    sinks.load_warehouse({n: d.limit(1) if n == "fact_daily_sales" else d.limit(0) for n, d in t.items()}, target)
    failed = sinks.load_check(t, files.read_tables(spark, target, sinks.LOAD_ORDER)).filter("NOT passed")
    assert "fact_daily_sales rows" in [r["check_name"] for r in failed.collect()]


def test_gate_before_publish(spark, folder, tmp_path):
    from shelfcast.plans.workspace import Workspace
    ws = Workspace.of(spark, folder)
    clean, t, target = ws.clean(), ws.warehouse(), str(tmp_path / "star")

    def publish(tables):
        staged = sinks.Staged(spark, target)
        for name, table in tables.items():
            staged.add(name, table, name in sinks.PARTITIONED)
        staged.release(lambda stored: quality.enforce_warehouse_gate(clean, stored))

    publish(t)
    before = sinks.read_published_tables(spark, target, t)
    sales = t["fact_daily_sales"].count()
    for broken in (t["fact_daily_sales"].union(t["fact_daily_sales"].limit(1)), t["fact_daily_sales"].filter("sales_id > 1")):
        with pytest.raises(RuntimeError, match="not published"):
            publish({**t, "fact_daily_sales": broken})
        assert sinks.read_published_tables(spark, target, t)["fact_daily_sales"].count() == sales
    assert before["dim_store"].exceptAll(t["dim_store"]).count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_published_tables(spark, str(tmp_path / "none"), t)


def test_batches_are_taken_once(spark, folder, tmp_path):
    from shelfcast.plans.workspace import Workspace
    from shelfcast.sources import load
    t, target = Workspace.of(spark, folder).warehouse(), str(tmp_path / "load")
    day_of = t["dim_date"].agg(F.percentile_approx("date_key", 0.5)).first()[0]
    early = {n: d.filter(F.col("date_key") <= day_of) if n.startswith("fact_") else d for n, d in t.items()}
    late = {n: t[n].filter(F.col("date_key") > day_of) for n in t if n.startswith("fact_")}
    with pytest.raises(ValueError, match="is not loaded"):
        load.load_batch(spark, late, target, "orphans")
    assert load.ledger(spark, target) == []
    assert load.load_batch(spark, early, target, "a") and load.load_batch(spark, late, target, "b")
    assert not load.load_batch(spark, late, target, "b")
    stored = load.read_loaded(spark, target)
    assert dict(stored["dim_date"].dtypes)["is_payday"] == "boolean"
    assert not sinks.load_check(t, stored).filter("NOT passed").count()
    with pytest.raises(ValueError, match="other content"):
        load.load_batch(spark, {"fact_oil_price": late["fact_oil_price"].limit(1)}, target, "b")
    with pytest.raises(ValueError, match="loaded before"):
        load.load_batch(spark, late, target, "c")
    strange = t["fact_oil_price"].limit(1).withColumn("date_key", F.lit(19000101))
    with pytest.raises(ValueError, match="1 rows without dim_date"):
        load.load_batch(spark, {"fact_oil_price": strange}, target, "d")
    assert load.read_loaded(spark, target)["fact_oil_price"].count() == t["fact_oil_price"].count()
    assert load.load_batch(spark, early, target, "all", replace=True)
    now = load.read_loaded(spark, target)
    assert now["fact_daily_sales"].exceptAll(early["fact_daily_sales"]).count() == 0
    assert now["fact_daily_sales"].count() == early["fact_daily_sales"].count()
    assert [e.batch for e in load.ledger(spark, target)] == ["a", "b", "all"]


def test_global_row_number(spark):
    from shelfcast.functions.numbering import global_row_number
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), (F.col("id") % 3).alias("x"))
    got = global_row_number(df.repartition(6), [F.col("k")], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    assert global_row_number(df.limit(0), [F.col("k")], "n").count() == 0


def test_gate_violations_are_counted(spark, folder):
    from shelfcast.plans.workspace import Workspace
    ws = Workspace.of(spark, folder)
    clean, t = ws.clean(), ws.warehouse()
    strange = clean["train"].limit(1)
    train = clean["train"].unionByName(strange).unionByName(strange.withColumns({"store_nbr": F.lit(999), "family": F.lit("none")}))
    pairs = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (1.0, float("nan")), (None, 1.0)], "sales double, prediction double")
    found = quality.gate_violations({**clean, "train": train, "oil": clean["oil"].drop("date")}, t, pairs)
    assert {(r["rule"], r["table_name"]): r["violations"] for r in found.collect() if r["violations"]} == {
        ("required columns", "oil"): 1, ("sales grain", "train"): 1, ("unmapped store_nbr", "train"): 1,
        ("unmapped family", "train"): 1, ("usable pairs", "pairs"): 3}
