"""Exact order statistics that no single task has to hold.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, which
is fine for groups bounded by the calendar but not for a group with a third of all rows.
Here values are first counted, then counted again in narrow logarithmic buckets; only the
buckets that hold a wanted rank are ordered.  Results equal the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import one_row

BUCKETS_PER_LOG_UNIT = 1024


def _bucket(value: str) -> Column:
    """Monotone in the value, so whole buckets are ordered among themselves."""
    v = F.col(value)
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS_PER_LOG_UNIT).cast("long")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[Column | str, float]],
    method: str = "linear",
) -> DataFrame:
    """One row per key with one column per wanted (value, probability).

    ``linear`` interpolates between the two neighbours, ``higher`` takes the upper one.
    Keys may be null; nulls among the values are skipped.  Groups without any value are
    absent: join the result with a left join.
    """
    if method not in ("linear", "higher"):
        raise ValueError(f"unknown quantile method: {method}")
    names = list(wanted)
    values: list[Column] = []
    slots: dict[str, int] = {}
    measure_of: dict[str, int] = {}
    for name in names:
        expression, probability = wanted[name]
        if not 0.0 <= probability <= 1.0:
            raise ValueError("probability must lie between 0 and 1")
        text = expression if isinstance(expression, str) else str(expression)
        if text not in slots:
            slots[text] = len(values)
            values.append(F.col(expression) if isinstance(expression, str) else expression)
        measure_of[name] = slots[text]

    pairs = F.array(*[
        F.struct(F.lit(i).alias("m"), v.cast("double").alias("v")) for i, v in enumerate(values)
    ])
    counted = (
        df.select(*keys, F.explode(pairs).alias("_p"))
        .select(*keys, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_m", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _bucket("_v"))
    )

    group = Window.partitionBy(*keys, "_m")
    buckets = (
        counted.groupBy(*keys, "_m", "_b").agg(F.sum("_n").alias("_nb"))
        .withColumn("_total", F.sum("_nb").over(group))
        .withColumn(
            "_before",
            F.sum("_nb").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
    )
    targets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            (F.lit(wanted[name][1]) * (F.col("_total") - 1)).alias("h"),
        )
        for i, name in enumerate(names)
    ])
    measure_array = F.array(*[F.lit(measure_of[name]) for name in names])
    located = (
        buckets.select("*", F.explode(targets).alias("_t"))
        .filter(F.element_at(measure_array, F.col("_t.i") + 1) == F.col("_m"))
        .withColumn("_lo", F.floor("_t.h"))
        .withColumn("_hi", F.ceil("_t.h"))
        .filter(
            (F.col("_hi") >= F.col("_before"))
            & (F.col("_lo") < F.col("_before") + F.col("_nb"))
        )
        .groupBy(*keys, "_m", "_b")
        .agg(
            F.first("_before").alias("_before"),
            F.collect_list(F.struct(F.col("_t.i").alias("i"), F.col("_t.h").alias("h"),
                                    F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))).alias("_ts"),
        )
    )

    left, right = counted.alias("c"), located.alias("b")
    condition = (F.col("c._m") == F.col("b._m")) & (F.col("c._b") == F.col("b._b"))
    for key in keys:
        condition &= F.col(f"c.{key}").eqNullSafe(F.col(f"b.{key}"))
    inside = Window.partitionBy(*keys, "_m", "_b").orderBy("_v")
    ranked = (
        left.join(right, condition)
        .select(*[F.col(f"c.{k}").alias(k) for k in keys], "c._m", "c._b", "c._v", "c._n",
                "b._before", "b._ts")
        .withColumn("_last", F.col("_before") + F.sum("_n").over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_first", F.col("_last") - F.col("_n"))
        .select(*keys, "_v", "_first", "_last", F.explode("_ts").alias("_t"))
    )
    aggregates = []
    for i, name in enumerate(names):
        mine = F.col("_t.i") == i
        lo = F.max(F.when(mine & (F.col("_t.lo") >= F.col("_first"))
                          & (F.col("_t.lo") < F.col("_last")), F.col("_v")))
        hi = F.max(F.when(mine & (F.col("_t.hi") >= F.col("_first"))
                          & (F.col("_t.hi") < F.col("_last")), F.col("_v")))
        share = F.max(F.when(mine, F.col("_t.h") - F.col("_t.lo")))
        aggregates.append((hi if method == "higher" else lo + (hi - lo) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggregates)


def value_at_place(df: DataFrame, keys: list[str], value: Column, place: Callable[[Column], Column]) -> DataFrame:
    """Per key its number of values ``_n`` and the value ``_v`` at a zero-based place that depends on that number.

    Rows are first counted by bucket, which combines before the shuffle; the bucket that holds the place then meets the rows
    again, and only its rows are counted by value. There is no request per distinct place, so keys may be many. Keys may
    be null; null values are skipped; a key without values is absent.
    """
    values = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_b", _bucket("_v"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # buckets of one key, bounded by their width
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    located = (
        values.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_nb"))
        .withColumns({"_n": F.sum("_nb").over(group), "_before": F.coalesce(F.sum("_nb").over(earlier), F.lit(0))})
        .withColumn("_at", place(F.col("_n")).cast("long"))
        .filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_nb")))
    )
    condition = F.col("c._b") == F.col("b._b")
    for key in keys:
        condition &= F.col(f"c.{key}").eqNullSafe(F.col(f"b.{key}"))
    counted = values.alias("c").join(located.alias("b"), condition).groupBy(
        *[F.col(f"c.{k}").alias(k) for k in keys], F.col("b._n").alias("_n"), F.col("b._before").alias("_before"),
        F.col("b._at").alias("_at"), F.col("c._v").alias("_v")).agg(F.count(F.lit(1)).alias("_nv"))
    last = F.col("_before") + F.sum("_nv").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_last", last).filter(
        (F.col("_at") >= F.col("_last") - F.col("_nv")) & (F.col("_at") < F.col("_last"))).select(*keys, "_n", "_v")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; keeps the left keys once."""
    if not keys:
        return left.withColumns(one_row(right))
    a, b = left.alias("l"), right.alias("r")
    condition = F.lit(True)
    for key in keys:
        condition &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return a.join(b, condition, how).select("l.*", *extra)


def with_quantiles(
    summary: DataFrame, df: DataFrame, keys: list[str],
    wanted: dict[str, tuple[Column | str, float]],
) -> DataFrame:
    """Add exact quantiles of ``df`` to its per-key summary."""
    return join_null_safe(summary, exact_quantiles(df, keys, wanted), keys)
