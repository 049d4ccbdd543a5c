"""Small column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient as double; null on a zero, missing or non-finite side."""
    ratio = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return F.when(is_finite(ratio), ratio)


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Aggregate: Pearson correlation, null when a side does not vary (``corr`` would raise)."""
    x, y = col(a).cast("double"), col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return safe_ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def is_finite(value: str | Column) -> Column:
    value = col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def flag(condition: Column) -> Column:
    """0/1 integer; a null condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def joined_set(value: str | Column) -> Column:
    """Aggregate: distinct non-null texts in order, joined with ' | '."""
    return F.array_join(F.array_sort(F.collect_set(col(value).cast("string"))), " | ")


def has_token(text: str | Column, token: str) -> Column:
    """Exact member test in a ' | '-joined text."""
    return F.array_contains(F.split(F.coalesce(col(text), F.lit("")), r" \| "), token)


def choose(rules: list[tuple[Column, object]], default: object) -> Column:
    """First matching rule wins; null conditions do not match."""
    def step(chain, rule):
        condition, value = rule
        value = value if isinstance(value, Column) else F.lit(value)
        return (F if chain is None else chain).when(condition, value)

    chain = reduce(step, rules, None)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def rank_desc(metric: str, window: WindowSpec) -> Column:
    """Min rank, largest first; null metrics stay unranked.  ``window`` must be ordered."""
    return F.when(F.col(metric).isNotNull(), F.rank().over(window))


def full_window(aggregate: Column, value: str | Column, window: WindowSpec, rows: int) -> Column:
    """Windowed aggregate that is null unless all ``rows`` values are present."""
    return F.when(F.count(col(value)).over(window) >= rows, aggregate.over(window))


def date_key(date: str | Column) -> Column:
    return F.date_format(col(date), "yyyyMMdd").cast("int")


def rounded(df, digits: int = 6):
    """Round every double column: last-bit differences between engines do not matter."""
    return df.select(*[
        F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def one_row(df: DataFrame) -> dict[str, Column]:
    """Columns of a one-row result as scalar subqueries: no join, no driver round trip."""
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row")).scalar()
    return {c: row.getField(c) for c in df.columns}


def daily_sequence(start: Column, end: Column) -> Column:
    """One row per day from start to end, generated in place."""
    return F.explode(F.sequence(start, end, F.expr("interval 1 day")))
