"""Warehouse and mart checks as small aggregates in one common row format."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import flag, is_finite, one_row
from shelfcast.operators.audit import (
    grain_counts, grain_summary, orphan_keys, union_all,
)
from shelfcast.operators.marts import MART_GRAINS
from shelfcast.operators.rules import Check, RuleBook
from shelfcast.operators.warehouse import store_day_key
from shelfcast.schemas import CLEAN_GRAINS, WAREHOUSE_GRAINS

Tables = Mapping[str, DataFrame]
CHECK_COLUMNS = ["check_name", "severity", "actual_value", "expected_value", "passed", "details"]


def number_text(value: Column) -> Column:
    """Seven decimals, the stored precision of sales, so texts compare exactly."""
    return value.cast("decimal(38,7)").cast("string")


def _counted(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return df.agg((F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n"))


def _zero(name: str, value: Column, details: str) -> Check:
    return Check(name, value, "0", value == 0, details)


def row_count_rules(book: RuleBook) -> list[Check]:
    """No table may be empty; an empty holiday bridge is only a warning."""
    return [Check(f"{name}_row_count", book.count(name), "> 0", book.count(name) > 0, f"analytics.{name} row count",
                  "WARNING" if name == "bridge_store_holiday" else "FAIL") for name in WAREHOUSE_GRAINS]


def duplicate_grain_rules(book: RuleBook) -> list[Check]:
    return [_zero(f"{name}_duplicate_grain", book.doubled(name), f"Duplicate {' + '.join(grain)} combinations")
            for name, grain in WAREHOUSE_GRAINS.items()]


# Check name, child table, parent table, key columns, description.
ORPHAN_RULES = [
    ("fact_daily_sales_orphan_date", "fact_daily_sales", "dim_date", ["date_key"],
     "Sales rows without a matching date dimension row"),
    ("fact_daily_sales_orphan_store", "fact_daily_sales", "dim_store", ["store_key"],
     "Sales rows without a matching store dimension row"),
    ("fact_daily_sales_orphan_family", "fact_daily_sales", "dim_family", ["family_key"],
     "Sales rows without a matching family dimension row"),
    ("fact_daily_sales_orphan_store_date", "fact_daily_sales", "dim_store_date", ["date_store_key"],
     "Sales rows without a matching date-store dimension row"),
    ("fact_store_transactions_orphan_date", "fact_store_transactions", "dim_date", ["date_key"],
     "Transaction rows without a matching date dimension row"),
    ("fact_store_transactions_orphan_store", "fact_store_transactions", "dim_store", ["store_key"],
     "Transaction rows without a matching store dimension row"),
    ("fact_store_transactions_orphan_store_date", "fact_store_transactions", "dim_store_date",
     ["date_key", "store_key"], "Transaction rows without a matching date-store dimension row"),
    ("dim_store_date_orphan_date", "dim_store_date", "dim_date", ["date_key"],
     "Date-store rows without a matching date dimension row"),
    ("dim_store_date_orphan_store", "dim_store_date", "dim_store", ["store_key"],
     "Date-store rows without a matching store dimension row"),
    ("fact_oil_price_orphan_date", "fact_oil_price", "dim_date", ["date_key"],
     "Oil rows without a matching date dimension row"),
    ("bridge_store_holiday_orphan_date", "bridge_store_holiday", "dim_date", ["date_key"],
     "Holiday bridge rows without a matching date dimension row"),
    ("bridge_store_holiday_orphan_store", "bridge_store_holiday", "dim_store", ["store_key"],
     "Holiday bridge rows without a matching store dimension row"),
]


def rows_without_parent(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent, counted per key first so that hot keys stay cheap.

    A null key has no parent and therefore counts.
    """
    used = grain_counts(child.select(*keys), keys)
    return used.join(parent.select(*keys).distinct(), keys, "left_anti").agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"))


def orphan_rules(book: RuleBook) -> list[Check]:
    checks = [_zero(name, book.orphans(child, keys, parent), details) for name, child, parent, keys, details in ORPHAN_RULES]
    undated = sum((book.count(name, F.col("date_key").isNull()) for name in
                   ("fact_daily_sales", "fact_store_transactions", "fact_oil_price", "bridge_store_holiday")), F.lit(0))
    return [*checks, _zero("warehouse_missing_date_key", undated, "Missing date_key values across facts and bridge")]


def measure_rules(book: RuleBook) -> list[Check]:
    sales, visits = "fact_daily_sales", "fact_store_transactions"

    def at_least_zero(table: str, column: str, name: str, details: str) -> Check:
        total = book.total(table, column)
        return Check(name, number_text(total), ">= 0", total >= 0, details, "WARNING")

    def any_rows(name: str, table: str, details: str) -> Check:
        return Check(name, book.count(table), "> 0", book.count(table) > 0, details)

    ends = book.bounds("dim_date", "full_date")
    shown = F.concat(F.coalesce(ends["a"].cast("string"), F.lit("NULL")), F.lit(" to "),
                     F.coalesce(ends["z"].cast("string"), F.lit("NULL")))
    return [
        _zero("negative_sales", book.count(sales, F.col("sales") < 0), "Rows where sales is negative"),
        _zero("negative_onpromotion", book.count(sales, F.col("onpromotion") < 0), "Rows where onpromotion is negative"),
        _zero("negative_transactions", book.count(visits, F.col("transactions") < 0), "Rows where transactions is negative"),
        at_least_zero(sales, "sales", "total_sales", "Warehouse total sales"),
        at_least_zero(visits, "transactions", "total_transactions", "Warehouse total transactions"),
        any_rows("store_count", "dim_store", "Number of stores in dim_store"),
        any_rows("family_count", "dim_family", "Number of families in dim_family"),
        Check("date_range", shown, "non-empty ordered range", ends["a"].isNotNull() & (ends["z"] >= ends["a"]),
              "Minimum and maximum date in dim_date"),
    ]


def _value(df: DataFrame, measure: Column) -> Column:
    return df.agg(measure.alias("v")).scalar()


def mart_rules(book: RuleBook) -> list[Check]:
    """Marts against facts and dimensions: totals, counts, grains, signs, ratios, dates."""
    daily, family, store, holiday, season = MART_GRAINS
    fact, visits = "fact_daily_sales", "fact_store_transactions"

    def equal(name: str, actual: Column, expected: Column, details: str) -> Check:
        return Check(name, actual, expected, actual == expected, details)

    def total(table: str, column: str) -> Column:
        return number_text(book.total(table, column))

    def all_of(counts: list[Column]) -> Column:
        return sum(counts, F.lit(0))

    checks = [
        equal("daily_store_sales_reconciliation", total(daily, "total_sales"), total(fact, "sales"),
              "Total sales in daily store mart must equal the sales fact total"),
        equal("daily_store_transactions_reconciliation", total(daily, "transactions"), total(visits, "transactions"),
              "Total transactions in daily store mart must equal the transaction fact total"),
        equal("family_sales_reconciliation", total(family, "total_sales"), total(fact, "sales"),
              "Total sales in family mart must equal the sales fact total"),
        equal("store_count_reconciliation", book.count(store), book.count("dim_store"),
              "Store mart row count must equal the store dimension count"),
        equal("family_count_reconciliation", book.distinct(family, "family"), book.count("dim_family"),
              "Distinct families in family mart must equal the family dimension count"),
        _zero("holiday_store_mapping", all_of([
            book.orphans("bridge_store_holiday", ["store_key"], "dim_store"), book.orphans(holiday, ["store_nbr"], "dim_store")]),
            "Holiday bridge keys and holiday mart store numbers must map to dim_store"),
    ]
    grain_texts = {
        daily: ("daily_store", "full_date and store_nbr combinations in daily store mart"),
        family: ("family", "year, month and family combinations in family mart"),
        store: ("store", "store_nbr values in store mart"),
        holiday: ("holiday", "full_date and store_nbr combinations in holiday mart"),
        season: ("seasonality", "seasonality grain combinations in seasonality mart"),
    }
    checks += [_zero(f"{short}_mart_duplicate_grain", book.doubled(name), f"Duplicate {text}")
               for name, (short, text) in grain_texts.items()]
    checks.append(_zero("nonnegative_sales", all_of([
        book.count(fact, F.col("sales") < 0), *[book.count(m, F.col("total_sales") < 0) for m in MART_GRAINS]]),
        "Negative sales rows across facts and marts"))
    checks.append(_zero("nonnegative_transactions", all_of([
        *[book.count(m, F.col("transactions") < 0) for m in (visits, daily, holiday)],
        *[book.count(m, F.col("total_transactions") < 0) for m in (store, season)]]),
        "Negative transaction rows across facts and transaction-bearing marts"))
    ratios = [
        (daily, "promotion_active_sales_share_proxy"), (daily, "sales_volume_per_transaction"),
        (family, "promotion_uplift_proxy_pct"), (store, "sales_volume_per_transaction"), (season, "sales_volume_per_transaction"),
    ]
    checks.append(_zero("finite_division_results", all_of([
        book.count(m, F.col(c).isNotNull() & ~is_finite(c)) for m, c in ratios]),
        "Infinite division results across all marts with calculated ratios"))
    checks.append(_zero("mart_date_range_within_dimension", all_of([
        *[book.orphans(m, ["full_date"], "dim_date") for m in (daily, holiday)],
        *[book.orphans(m, ["year", "month"], "dim_date") for m in (family, season)]]),
        "Date-bearing mart rows must map to a date or year-month in dim_date"))
    return checks


#: Rules of each check set, in the order of the report.
RULE_SETS: dict[str, Callable[[RuleBook], list[Check]]] = {
    "row_counts": row_count_rules, "duplicate_grain": duplicate_grain_rules, "foreign_keys": orphan_rules,
    "measure_validation": measure_rules, "mart_reconciliation": mart_rules,
}
GRAINS = {**WAREHOUSE_GRAINS, **MART_GRAINS}


def _set_rows(name: str, tables: Tables) -> DataFrame:
    book = RuleBook(tables, GRAINS)
    return book.rows(RULE_SETS[name](book))


def row_count_checks(t: Tables) -> DataFrame:
    return _set_rows("row_counts", t)


def duplicate_grain_checks(t: Tables) -> DataFrame:
    return _set_rows("duplicate_grain", t)


def orphan_checks(t: Tables) -> DataFrame:
    return _set_rows("foreign_keys", t)


def measure_checks(t: Tables) -> DataFrame:
    return _set_rows("measure_validation", t)


def mart_checks(t: Tables, marts: Tables) -> DataFrame:
    return _set_rows("mart_reconciliation", {**t, **marts})


def status(passed: str | Column = "passed", severity: str | Column = "severity") -> Column:
    """PASS, else the declared severity when it is known, else FAIL."""
    level = F.upper(F.col(severity) if isinstance(severity, str) else severity)
    ok = F.col(passed) if isinstance(passed, str) else passed
    return (F.when(ok, F.lit("PASS")).when(level.isin("WARNING", "FAIL"), level)
            .otherwise(F.lit("FAIL")))


CHECK_SETS: dict[str, Callable[..., DataFrame]] = {
    name: lambda t, m, name=name: _set_rows(name, {**t, **m}) for name in RULE_SETS
}


def all_rules(t: Tables, marts: Tables) -> DataFrame:
    """Rows of all rule sets from one plan: needs that sets share are met once."""
    book, named = RuleBook({**t, **marts}, GRAINS), []
    for name, build in RULE_SETS.items():
        named += [(name, check) for check in build(book)]
    return book.rows([check for _, check in named], check_set=[name for name, _ in named])


def run_check_sets(t: Tables, marts: Tables,
                   sets: Mapping[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """Classified rows of all check sets; a set that cannot run becomes one FAIL row.

    The sets of the library run as one plan; if that fails, each runs by itself, so that a broken one does not hide the others.
    """
    spark, columns = t["dim_date"].sparkSession, ["check_set", *CHECK_COLUMNS]
    if sets is None:
        try:
            rows = all_rules(t, marts).select(*columns)
            return spark.createDataFrame(rows.collect(), rows.schema).withColumn("status", status())
        except (PySparkException, KeyError):  # a table or column is missing, or a value cannot be read
            sets = CHECK_SETS
    frames = []
    for name, build in sets.items():
        try:
            rows = build(t, marts)
            missing = [c for c in CHECK_COLUMNS if c not in rows.columns]
            if missing:
                raise ValueError(f"check set lacks columns: {', '.join(missing)}")
            done = spark.createDataFrame(rows.select(*CHECK_COLUMNS).collect(), rows.select(*CHECK_COLUMNS).schema)
        except Exception as error:  # one broken set must not hide the others
            done = spark.createDataFrame(
                [(name, "FAIL", "error", "check set runs", False, str(error).splitlines()[0])],
                "check_name string, severity string, actual_value string, expected_value string, "
                "passed boolean, details string")
        frames.append(done.select(F.lit(name).alias("check_set"), *CHECK_COLUMNS, status().alias("status")))
    return union_all(frames)


# ---------------------------------------------------------------- mart-by-mart reconciliation

def reconcile_daily_store(t: Tables, mart: DataFrame) -> DataFrame:
    fact = one_row(t["fact_daily_sales"].agg(F.sum("sales").alias("s")))
    visits = one_row(t["fact_store_transactions"].agg(F.sum("transactions").alias("n")))
    totals = mart.agg(F.sum("total_sales").alias("mart_total_sales"),
                      F.sum("transactions").alias("mart_total_transactions"))
    doubled = one_row(grain_summary(mart, ["full_date", "store_nbr"], "mart"))["duplicate_combinations"]
    return totals.select(
        fact["s"].alias("fact_total_sales"), "mart_total_sales",
        visits["n"].alias("fact_total_transactions"), "mart_total_transactions",
        doubled.alias("duplicate_combinations"),
    ).select(
        "*",
        (F.col("fact_total_sales") == F.col("mart_total_sales")).alias("sales_reconciled"),
        (F.col("fact_total_transactions") == F.col("mart_total_transactions"))
        .alias("transactions_reconciled"),
        (F.col("duplicate_combinations") == 0).alias("grain_is_valid"),
    )


def family_differences(t: Tables, mart: DataFrame) -> DataFrame:
    """Keys on one side only or with unequal totals; empty when the mart is right."""
    keys = ["year", "month", "family"]
    fact = (
        t["fact_daily_sales"].groupBy("date_key", "family_key").agg(F.sum("sales").alias("sales"))
        .join(t["dim_date"].select("date_key", "year", "month"), "date_key")
        .join(t["dim_family"], "family_key")
        .groupBy(*keys).agg(F.sum("sales").alias("fact_total_sales"))
        .withColumn("_f", F.lit(True))
    )
    totals = mart.select(*keys, F.col("total_sales").alias("mart_total_sales"), F.lit(True).alias("_m"))
    both = F.col("_f").isNotNull() & F.col("_m").isNotNull()
    return (
        fact.join(totals, keys, "full")
        .filter(~both | ~F.col("fact_total_sales").eqNullSafe(F.col("mart_total_sales")))
        .select(*keys, "fact_total_sales", "mart_total_sales", both.alias("family_preserved"),
                (F.col("fact_total_sales") == F.col("mart_total_sales")).alias("total_sales_reconciled"))
    )


def reconcile_store(t: Tables, mart: DataFrame) -> DataFrame:
    fact = one_row(t["fact_daily_sales"].agg(F.sum("sales").alias("s")))
    visits = one_row(t["fact_store_transactions"].agg(F.sum("transactions").alias("n")))
    stores = one_row(t["dim_store"].agg(F.count(F.lit(1)).alias("n")))
    return mart.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count(F.lit(1)) - F.count_distinct("store_nbr")).alias("duplicate_grain_count"),
        F.sum("total_sales").alias("mart_total_sales"),
        F.sum("total_transactions").alias("mart_total_transactions"),
    ).select(
        "*", stores["n"].alias("expected_store_count"), fact["s"].alias("fact_total_sales"),
        visits["n"].alias("fact_total_transactions"),
    ).select(
        "*", (F.col("row_count") == F.col("expected_store_count")).alias("row_count_reconciled"),
        (F.col("duplicate_grain_count") == 0).alias("grain_is_valid"),
        (F.col("fact_total_sales") == F.col("mart_total_sales")).alias("sales_reconciled"),
        (F.col("fact_total_transactions") == F.col("mart_total_transactions"))
        .alias("transactions_reconciled"),
    )


def reconcile_holiday(t: Tables, mart: DataFrame) -> DataFrame:
    keys = ["date_key", "store_key"]
    bridge = t["bridge_store_holiday"].select(*keys)
    rows = one_row(bridge.agg(F.count(F.lit(1)).alias("n")))
    sales = one_row(t["fact_daily_sales"].join(bridge, keys, "left_semi").agg(F.sum("sales").alias("s")))
    visits = one_row(t["fact_store_transactions"].join(bridge, keys, "left_semi")
                     .agg(F.sum("transactions").alias("n")))
    doubled = one_row(grain_summary(mart, ["full_date", "store_nbr"], "mart"))["duplicate_combinations"]
    return mart.agg(
        F.count(F.lit(1)).alias("mart_row_count"), F.sum("total_sales").alias("mart_total_sales"),
        F.sum("transactions").alias("mart_total_transactions"),
    ).select(
        "*", rows["n"].alias("expected_row_count"), sales["s"].alias("expected_total_sales"),
        visits["n"].alias("expected_total_transactions"), doubled.alias("duplicate_combinations"),
    ).select(
        "*", (F.col("expected_row_count") == F.col("mart_row_count")).alias("row_count_reconciled"),
        (F.col("duplicate_combinations") == 0).alias("grain_is_valid"),
        F.col("expected_total_sales").eqNullSafe(F.col("mart_total_sales")).alias("sales_reconciled"),
        F.col("expected_total_transactions").eqNullSafe(F.col("mart_total_transactions"))
        .alias("transactions_reconciled"),
    )


def reconcile_seasonality(t: Tables, mart: DataFrame) -> DataFrame:
    dates = t["fact_daily_sales"].select("date_key").distinct()
    groups = dates.join(t["dim_date"], "date_key").select(*MART_GRAINS["seasonality"]).distinct()
    expected = one_row(groups.agg(F.count(F.lit(1)).alias("n")))
    fact = one_row(t["fact_daily_sales"].agg(F.sum("sales").alias("s")))
    visits = one_row(t["fact_store_transactions"].agg(F.sum("transactions").alias("n")))
    return mart.agg(
        F.count(F.lit(1)).alias("mart_row_count"), F.sum("total_sales").alias("mart_total_sales"),
        F.sum("total_transactions").alias("mart_total_transactions"),
    ).select(
        "*", expected["n"].alias("expected_row_count"), fact["s"].alias("fact_total_sales"),
        visits["n"].alias("fact_total_transactions"),
    ).select(
        "*", (F.col("expected_row_count") == F.col("mart_row_count")).alias("row_count_reconciled"),
        (F.col("fact_total_sales") == F.col("mart_total_sales")).alias("sales_reconciled"),
        (F.col("fact_total_transactions") == F.col("mart_total_transactions"))
        .alias("transactions_reconciled"),
    )


# ---------------------------------------------------------------- declared constraints

def _between(column: str, low: int, high: int) -> tuple[str, Column]:
    return f"{column} between {low} and {high}", F.col(column).between(low, high)


def _present(*columns: str) -> list[tuple[str, Column]]:
    return [(f"{c} not null", F.col(c).isNotNull()) for c in columns]


def _binary(*columns: str) -> list[tuple[str, Column]]:
    return [(f"{c} in (0, 1)", F.col(c).isin(0, 1)) for c in columns]


def _at_least(column: str, low: int) -> tuple[str, Column]:
    return f"{column} >= {low}", F.col(column) >= low


HOLIDAY_PRESENT = ["holiday_count", "holiday_descriptions", "holiday_types", "holiday_locales"]


def dimension_rules() -> dict[str, list[tuple[str, Column]]]:
    return {
        "dim_date": _present("date_key", "full_date", "day_name", "month_name", "year") + [
            _between("day", 1, 31), _between("day_of_week", 0, 6), _between("week_of_year", 1, 53),
            _between("month", 1, 12), _between("quarter", 1, 4),
        ] + _binary("is_weekend", "is_month_start", "is_month_end", "is_payday"),
        "dim_store": _present("store_key", "store_nbr", "city", "state", "store_type", "cluster"),
        "dim_family": _present("family_key", "family"),
        "dim_store_date": _present("date_store_key", "date_key", "store_key", *HOLIDAY_PRESENT) + [
            _at_least("holiday_count", 0),
        ] + _binary("is_holiday", "is_work_day", "is_event", "has_sales_observation",
                    "has_transaction_observation"),
    }


def fact_rules() -> dict[str, list[tuple[str, Column]]]:
    return {
        "fact_daily_sales": _present("sales_id", "date_key", "store_key", "date_store_key",
                                     "family_key", "sales", "onpromotion") + [
            _at_least("sales", 0), _at_least("onpromotion", 0),
            ("sales fits decimal(20,7)", F.col("sales").cast("decimal(20,7)").cast("double")
             == F.col("sales")),
        ] + _binary("is_promotion"),
        "fact_store_transactions": _present("date_key", "store_key", "transactions") + [
            _at_least("transactions", 0)],
        "fact_oil_price": _present("date_key", "oil_price") + _binary("oil_was_imputed"),
        "bridge_store_holiday": _present("date_key", "store_key", *HOLIDAY_PRESENT) + [
            _at_least("holiday_count", 1)] + _binary("is_holiday", "is_work_day", "is_event"),
    }


# Unique keys besides the grain, and foreign keys.
UNIQUE_KEYS = {
    "dimension": [("dim_date", ["date_key"]), ("dim_date", ["full_date"]), ("dim_store", ["store_key"]),
                  ("dim_store", ["store_nbr"]), ("dim_family", ["family_key"]),
                  ("dim_family", ["family"]), ("dim_store_date", ["date_store_key"]),
                  ("dim_store_date", ["date_key", "store_key"])],
    "fact": [("fact_daily_sales", ["sales_id"]),
             ("fact_daily_sales", ["date_key", "store_key", "family_key"]),
             ("fact_store_transactions", ["date_key", "store_key"]), ("fact_oil_price", ["date_key"]),
             ("bridge_store_holiday", ["date_key", "store_key"])],
}
FOREIGN_KEYS = {
    "dimension": [("dim_store_date", "dim_date", ["date_key"]),
                  ("dim_store_date", "dim_store", ["store_key"])],
    "fact": [("fact_daily_sales", "dim_date", ["date_key"]),
             ("fact_daily_sales", "dim_store", ["store_key"]),
             ("fact_daily_sales", "dim_store_date", ["date_store_key"]),
             ("fact_daily_sales", "dim_family", ["family_key"]),
             ("fact_store_transactions", "dim_date", ["date_key"]),
             ("fact_store_transactions", "dim_store", ["store_key"]),
             ("fact_store_transactions", "dim_store_date", ["date_key", "store_key"]),
             ("fact_oil_price", "dim_date", ["date_key"]),
             ("bridge_store_holiday", "dim_date", ["date_key"]),
             ("bridge_store_holiday", "dim_store", ["store_key"])],
}


def constraint_violations(t: Tables, kind: str) -> DataFrame:
    """Violating rows per declared constraint; ``kind`` is dimension or fact."""
    rules = dimension_rules() if kind == "dimension" else fact_rules()
    frames = []
    for table, table_rules in rules.items():
        counted = t[table].agg(*[
            F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"c{i}")
            for i, (_, rule) in enumerate(table_rules)
        ])
        entries = F.array(*[
            F.struct(F.lit(label).alias("constraint"), F.col(f"c{i}").alias("violations"))
            for i, (label, _) in enumerate(table_rules)
        ])
        frames.append(counted.select(F.inline(entries)).select(
            F.lit(table).alias("table_name"), "constraint", "violations"))
    for table, keys in UNIQUE_KEYS[kind]:
        doubled = grain_counts(t[table], keys).filter("row_count > 1")
        frames.append(_counted(doubled).select(
            F.lit(table).alias("table_name"), F.lit(f"unique ({', '.join(keys)})").alias("constraint"),
            F.col("n").alias("violations")))
    for child, parent, keys in FOREIGN_KEYS[kind]:
        frames.append(rows_without_parent(t[child], t[parent], keys).select(
            F.lit(child).alias("table_name"),
            F.lit(f"foreign key ({', '.join(keys)}) to {parent}").alias("constraint"),
            F.col("n").alias("violations")))
    return union_all(frames)


# ---------------------------------------------------------------- warehouse validation

def date_bounds(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates for the printed first and last date, or N/A without a date column."""
    if "full_date" in df.columns:
        day = F.col("full_date")
    elif "date_key" in df.columns:
        day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    else:
        return F.lit("N/A"), F.lit("N/A")
    missing = F.lit("N/A")
    return (F.coalesce(F.min(day).cast("string"), missing),
            F.coalesce(F.max(day).cast("string"), missing))


def warehouse_validation(t: Tables, grains: Mapping[str, list[str]] = WAREHOUSE_GRAINS) -> DataFrame:
    """Rows, duplicated grain rows, missing keys and date bounds of every table."""
    frames = []
    for name, grain in grains.items():
        table = t[name]
        low, high = date_bounds(table)
        nulls = sum((flag(F.col(g).isNull()) for g in grain[1:]), flag(F.col(grain[0]).isNull()))
        one_pass = table.agg(F.count(F.lit(1)).alias("row_count"),
                             F.coalesce(F.sum(nulls), F.lit(0)).alias("missing_surrogate_key_count"),
                             low.alias("minimum_date"), high.alias("maximum_date"))
        groups = one_row(grain_counts(table, grain).agg(F.count(F.lit(1)).alias("n")))["n"]
        frames.append(one_pass.select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(" + ".join(grain)).alias("expected_grain"),
            (F.col("row_count") - groups).alias("duplicate_grain_count"),
            "missing_surrogate_key_count", "minimum_date", "maximum_date"))
    return union_all(frames)


def clean_gate(clean: Tables) -> dict[str, DataFrame]:
    """Grain and store-key findings of the cleaned tables, for the job gate."""
    present = {name: grain for name, grain in CLEAN_GRAINS.items() if name in clean}
    grains = union_all([grain_summary(clean[name], grain, name) for name, grain in present.items()])
    orphans = union_all([
        orphan_keys(clean[child], "store_nbr", clean["stores"], "store_nbr", child, "stores")
        for child in ("train", "test", "transactions") if child in clean
    ])
    return {"grains": grains, "orphans": orphans}


def enforce_clean_gate(clean: Tables) -> None:
    found = clean_gate(clean)
    bad = [row["table_name"] for row in found["grains"].filter("NOT is_valid").collect()]
    if bad:
        raise RuntimeError(f"cleaning stopped: invalid grain in {', '.join(bad)}")
    affected = found["orphans"].agg(F.sum("affected_rows")).first()[0]
    if affected:
        raise RuntimeError(f"cleaning stopped: invalid store keys affect {affected} rows")
    if clean["oil"].filter(F.col("oil_price").isNull()).limit(1).count():
        raise RuntimeError("cleaning stopped: oil_price still contains missing values")


def warehouse_reconciliation(clean: Tables, t: Tables) -> DataFrame:
    """Ten clean-against-warehouse comparisons."""
    def total(df: DataFrame, column: str) -> Column:
        return _value(df, F.coalesce(F.sum(column), F.lit(0)).cast("double"))

    def rows(df: DataFrame) -> Column:
        return _value(df, F.count(F.lit(1)).cast("double"))

    grid = t["dim_store_date"]
    days, stores = rows(t["dim_date"]), rows(t["dim_store"])
    lost = rows_without_parent(t["fact_daily_sales"], grid, ["date_store_key"])
    comparisons = [
        ("Total sales", total(clean["train"], "sales"), total(t["fact_daily_sales"], "sales"), 1e-6),
        ("Total onpromotion", total(clean["train"], "onpromotion"),
         total(t["fact_daily_sales"], "onpromotion"), 0.0),
        ("Total transactions", total(clean["transactions"], "transactions"),
         total(t["fact_store_transactions"], "transactions"), 0.0),
        ("Store count", rows(clean["stores"]), stores, 0.0),
        ("Family count", rows(clean["train"].select("family").distinct()), rows(t["dim_family"]), 0.0),
        ("Store-date row count", days * stores, rows(grid), 0.0),
        ("Store-date holiday mappings", rows(t["bridge_store_holiday"]),
         rows(grid.filter("holiday_count > 0")), 0.0),
        ("Store-date sales observations", rows(clean["train"].select("date", "store_nbr").distinct()),
         total(grid, "has_sales_observation"), 0.0),
        ("Store-date transaction observations",
         rows(clean["transactions"].select("date", "store_nbr").distinct()),
         total(grid, "has_transaction_observation"), 0.0),
        ("Sales fact unmapped date-store keys", F.lit(0.0), lost.scalar().cast("double"), 0.0),
    ]
    one = grid.sparkSession.range(1)
    return union_all([
        one.select(F.lit(name).alias("check_name"), a.alias("clean_value"), b.alias("warehouse_value"))
        .withColumn("passed", F.abs(F.col("clean_value") - F.col("warehouse_value")) <= tolerance)
        for name, a, b, tolerance in comparisons
    ])


def enforce_warehouse_gate(clean: Tables, t: Tables) -> None:
    """Refuse a star with doubled grains, missing keys or totals that differ from the cleaned tables."""
    broken = warehouse_validation(t).filter("duplicate_grain_count > 0 OR missing_surrogate_key_count > 0")
    bad = [row["table_name"] for row in broken.collect()]
    if bad:
        raise RuntimeError(f"warehouse not published: invalid keys in {', '.join(sorted(bad))}")
    failed = warehouse_reconciliation(clean, t).filter("NOT coalesce(passed, false)")
    bad = [row["check_name"] for row in failed.collect()]
    if bad:
        raise RuntimeError(f"warehouse not published: {', '.join(sorted(bad))} differ from the cleaned tables")


def gate_violations(clean: Tables, t: Tables, pairs: DataFrame) -> DataFrame:
    """What the refusing checks of the jobs would refuse: missing columns, repeated sales grain, unmapped keys, unusable pairs."""
    one = pairs.sparkSession.range(1)

    def counted(rule: str, table: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.col("n").cast("long").alias("violations"))

    frames = [
        counted("required columns", name, one.select(F.lit(len(set(grain) - set(clean[name].columns))).alias("n")))
        for name, grain in CLEAN_GRAINS.items() if name in clean]
    repeated = grain_counts(clean["train"], CLEAN_GRAINS["train"]).filter("row_count > 1")
    frames.append(counted("sales grain", "train", _counted(repeated)))
    mapped = {"date": ("dim_date", "full_date"), "store_nbr": ("dim_store", "store_nbr"), "family": ("dim_family", "family")}
    for name in ("train", "transactions", "holidays"):
        for column, (parent, key) in mapped.items():
            if column in clean[name].columns and (name, column) != ("holidays", "date"):  # days off the calendar are left out
                frames.append(counted(f"unmapped {column}", name, rows_without_parent(
                    clean[name], t[parent].select(F.col(key).alias(column)), [column])))
    unusable = ~is_finite("sales") | ~is_finite("prediction") | (F.col("sales") < 0)
    frames.append(counted("usable pairs", "pairs", _counted(pairs, F.coalesce(unusable, F.lit(True)))))
    return union_all(frames)


def store_day_and_holiday_checks(t: Tables) -> DataFrame:
    """Grid completeness, key formula, key coverage and holiday mapping."""
    grid, keys = t["dim_store_date"], ["date_key", "store_key"]
    rows = F.count(F.lit(1))
    size = one_row(grid.agg(rows.alias("n")))["n"]
    expected = (one_row(t["dim_date"].agg(rows.alias("n")))["n"]
                * one_row(t["dim_store"].agg(rows.alias("n")))["n"])
    one = grid.sparkSession.range(1)
    holiday_rows = one_row(t["bridge_store_holiday"].agg(rows.alias("n")))["n"]
    marked = one_row(_counted(grid, F.col("holiday_count") > 0))["n"]
    wrong_key = _counted(grid, F.col("date_store_key") != store_day_key())
    return union_all([
        one.select(F.lit("grid_is_complete").alias("check_name"),
                   F.abs(size - expected).cast("long").alias("violations")),
        wrong_key.select(F.lit("key_formula").alias("check_name"), F.col("n").alias("violations")),
        rows_without_parent(t["fact_daily_sales"], grid, ["date_store_key"]).select(
            F.lit("sales_store_days_covered").alias("check_name"), F.col("n").alias("violations")),
        rows_without_parent(t["fact_store_transactions"], grid, keys).select(
            F.lit("transaction_store_days_covered").alias("check_name"), F.col("n").alias("violations")),
        one.select(F.lit("holiday_days_marked").alias("check_name"),
                   F.abs(holiday_rows - marked).cast("long").alias("violations")),
        rows_without_parent(t["bridge_store_holiday"], grid.filter("holiday_count > 0"), keys).select(
            F.lit("holiday_days_in_grid").alias("check_name"), F.col("n").alias("violations")),
    ]).withColumn("passed", F.col("violations") == 0)


def layer_reconciliation(clean: Tables, t: Tables, store_report: DataFrame,
                         family_report: DataFrame) -> DataFrame:
    """The same total in every layer, and transactions free of a family key."""
    def total(df: DataFrame, column: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias("value"))

    base = one_row(total(clean["train"], "sales"))["value"]
    visits = one_row(total(clean["transactions"], "transactions"))["value"]
    layers = [
        ("fact_sales", total(t["fact_daily_sales"], "sales"), base),
        ("store_report_sales", total(store_report, "total_sales"), base),
        ("family_report_sales", total(family_report, "total_sales"), base),
        ("fact_transactions", total(t["fact_store_transactions"], "transactions"), visits),
    ]
    frames = [
        df.select(F.lit(name).alias("layer"), "value", expected.alias("expected"))
        .withColumn("passed", F.abs(F.col("value") - F.col("expected")) <= 1e-6)
        for name, df, expected in layers
    ]
    repeated = "family_key" in t["fact_store_transactions"].columns
    frames.append(t["dim_date"].sparkSession.range(1).select(
        F.lit("transactions_without_family").alias("layer"), F.lit(float(repeated)).alias("value"),
        F.lit(0.0).alias("expected"), F.lit(not repeated).alias("passed")))
    return union_all(frames)


def finite_counts(df: DataFrame) -> DataFrame:
    """Non-finite numbers per double column."""
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    counted = df.agg(*[F.count_if(F.col(c).isNotNull() & ~is_finite(c)).alias(c) for c in doubles])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_finite")) for c in doubles])
    return counted.select(F.inline(entries))
