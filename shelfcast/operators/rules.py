"""Checks as data, compiled into one plan.

A check names what it needs of which table: sums, counts, rows without a parent, distinct keys, doubled grains. The book turns the
needs of one table into entries of a short array, so that the table is read once for all of them, whatever their number;
entries are combined by key inside each task and only distinct keys are shuffled. Grains are counted in a second read,
since they are as many as the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.audit import grain_counts, union_all

Tables = Mapping[str, DataFrame]
FOUND = "_found"
NUMBERS = 2  # whole-number or date columns that a rule's key may have, beside one text


@dataclass(frozen=True)
class Check:
    """One row of a check table; ``actual``, ``expected`` and ``passed`` are built from needs of a book."""

    name: str
    actual: Column
    expected: Column | str
    passed: Column
    details: str
    severity: str = "FAIL"


class RuleBook:
    """Needs of many checks over named tables."""

    def __init__(self, tables: Tables, grains: Mapping[str, Sequence[str]]):
        self.tables, self.grains = tables, grains
        self._rules: dict[tuple, int] = {}
        self._sums: dict[str, dict[str, Column]] = {}
        self._keys: dict[str, list[tuple[int, list[str], bool]]] = {}
        self._scalars: dict[str, Column] = {}

    # -------------------------------------------------------------- needs

    def total(self, table: str, column: str | Column) -> Column:
        """Sum as double; zero for an empty table."""
        value = (F.col(column) if isinstance(column, str) else column).cast("double")
        slots = self._sums.setdefault(table, {})
        slots.setdefault(str(value), value)
        field = f"s{list(slots).index(str(value))}"
        return F.coalesce(self._field(self._rule("sums", table), field), F.lit(0.0))

    def count(self, table: str, condition: Column | None = None) -> Column:
        """Rows, or rows that meet a condition; a null condition does not count."""
        one = F.lit(1.0) if condition is None else F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
        return self.total(table, one).cast("long")

    def orphans(self, child: str, keys: Sequence[str], parent: str, parent_keys: Sequence[str] | None = None) -> Column:
        """Rows of ``child`` whose key is null or not among the keys of ``parent``."""
        rule = self._rule("orphans", child, *keys, parent)
        self._entry(child, rule, keys, True)
        self._entry(parent, rule, parent_keys or keys, False)
        return F.coalesce(self._field(rule, "orphans"), F.lit(0))

    def distinct(self, table: str, column: str) -> Column:
        rule = self._rule("distinct", table, column)
        self._entry(table, rule, [column], True)
        return F.coalesce(self._field(rule, "keys"), F.lit(0))

    def doubled(self, table: str) -> Column:
        """Grains of a table that occur more than once."""
        repeated = grain_counts(self.tables[table], list(self.grains[table])).filter("row_count > 1")
        return self._scalar(f"_doubled_{table}", repeated.agg(F.count(F.lit(1)).alias("n")))

    def bounds(self, table: str, column: str) -> Column:
        """Struct (a, z) of the least and greatest value."""
        ends = F.struct(F.min(column).alias("a"), F.max(column).alias("z")).alias("ends")
        return self._scalar(f"_bounds_{table}_{column}", self.tables[table].agg(ends))

    def _rule(self, *key: str) -> int:
        return self._rules.setdefault(key, len(self._rules))

    def _entry(self, table: str, rule: int, keys: Sequence[str], child: bool) -> None:
        entries = self._keys.setdefault(table, [])
        if (rule, list(keys), child) not in entries:
            entries.append((rule, list(keys), child))

    def _field(self, rule: int, field: str) -> Column:
        return F.try_element_at(F.col(FOUND), F.lit(rule))[field]

    def _scalar(self, name: str, one: DataFrame) -> Column:
        if name not in self._scalars:
            self._scalars[name] = one.scalar().alias(name)
        return F.col(name)

    # -------------------------------------------------------------- plan

    def _key_columns(self, table: DataFrame, keys: Sequence[str]) -> list[Column]:
        """Key as whole numbers (dates as days) and one text, the same places for child and parent."""
        numbers, text = [], F.lit(None).cast("string")
        for key in keys:
            kind = table.schema[key].dataType.typeName()
            if kind == "string":
                text = F.col(key)
            else:
                numbers.append((F.unix_date(key) if kind == "date" else F.col(key)).cast("long"))
        if len(numbers) > NUMBERS:
            raise ValueError(f"a rule's key has more than {NUMBERS} numbers: {', '.join(keys)}")
        numbers += [F.lit(None).cast("long")] * (NUMBERS - len(numbers))
        return [*[n.alias(f"k{i}") for i, n in enumerate(numbers)], text.alias("kt")]

    def _entries(self, name: str, slots: int) -> DataFrame:
        table, entries = self.tables[name], []
        none = [F.lit(None).cast("double").alias(f"s{i}") for i in range(slots)]
        if name in self._sums:
            sums = [v.alias(f"s{i}") for i, v in enumerate(self._sums[name].values())]
            entries.append(F.struct(F.lit(self._rule("sums", name)).alias("rule"), *self._key_columns(table, []),
                                    F.lit(1).alias("n"), F.lit(0).alias("p"), *sums, *none[len(sums):]))
        for rule, keys, child in self._keys.get(name, []):
            known = F.lit(True)
            for key in keys:
                known &= F.col(key).isNotNull()  # a key with a null is nobody's parent
            entries.append(F.struct(F.lit(rule).alias("rule"), *self._key_columns(table, keys), F.lit(int(child)).alias("n"),
                                    (F.lit(0) if child else known.cast("int")).alias("p"), *none))
        return table.select(F.inline(F.array(*entries)))

    def _found(self) -> DataFrame | None:
        names = list(dict.fromkeys([*self._sums, *self._keys]))
        if not names:
            return None
        slots = max((len(x) for x in self._sums.values()), default=0)
        keys = ["rule", *[f"k{i}" for i in range(NUMBERS)], "kt"]
        sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(slots)]
        by_key = union_all([self._entries(name, slots) for name in names]).groupBy(*keys).agg(
            F.sum("n").alias("n"), F.max("p").alias("p"), *sums)
        by_rule = by_key.groupBy("rule").agg(
            F.count_if(F.col("n") > 0).alias("keys"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("orphans"), *sums)
        fields = F.struct("keys", "orphans", *[f"s{i}" for i in range(slots)])
        return by_rule.agg(F.map_from_entries(F.collect_list(F.struct("rule", fields))).alias(FOUND))  # one entry per rule

    def rows(self, checks: Sequence[Check], **labels: Sequence[str]) -> DataFrame:
        """One row per check, with further text columns given per check."""
        found = self._found()
        scalars = [*([] if found is None else [found.scalar().alias(FOUND)]), *self._scalars.values()]
        spark = next(iter(self.tables.values())).sparkSession
        return spark.range(1).select(*scalars).select(F.inline(F.array(*[
            F.struct(
                *[F.lit(values[i]).alias(name) for name, values in labels.items()],
                F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"),
                c.actual.cast("string").alias("actual_value"),
                (F.lit(c.expected) if isinstance(c.expected, str) else c.expected).cast("string").alias("expected_value"),
                F.coalesce(c.passed, F.lit(False)).alias("passed"), F.lit(c.details).alias("details"))
            for i, c in enumerate(checks)])))
