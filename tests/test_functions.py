import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.columns import has_token, rank_desc, safe_corr, safe_ratio
from shelfcast.functions.numbering import nested_row_number
from shelfcast.functions.quantiles import exact_quantiles, value_at_place
from conftest import rows


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(0, 50, 300), rng.integers(0, 4, 500), rng.lognormal(6, 3, 200)]).astype(float)
    keys = ["hot"] * 800 + ["cold"] * 199 + [None]
    df = spark.createDataFrame(list(zip(keys, values.tolist())), "k string, v double")
    result = {r["k"]: r for r in exact_quantiles(df, ["k"], {
        "q10": ("v", 0.1), "q50": ("v", 0.5), "q99": ("v", 0.99), "low": ("v", 0.0), "high": ("v", 1.0)}).collect()}
    assert set(result) == {"hot", "cold", None}
    for key, part in (("hot", values[:800]), ("cold", values[800:999]), (None, values[999:])):
        for name, p in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99), ("low", 0), ("high", 1)):
            assert result[key][name] == pytest.approx(np.quantile(part, p), rel=1e-12, abs=1e-12)


def test_higher_quantile_and_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)] + [(None,)], "v double")
    assert exact_quantiles(df, [], {"q": ("v", 0.9)}, "higher").first()["q"] == 10
    assert exact_quantiles(df, [], {"q": ("v", 0.9)}).first()["q"] == pytest.approx(9.1)
    with pytest.raises(ValueError):
        exact_quantiles(df, [], {"q": ("v", 1.5)})


def test_value_at_a_place_that_depends_on_the_size(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 50, 300), np.full(500, 7.0), rng.lognormal(6, 3, 199)]).astype(float).tolist()
    keys = ["hot"] * 700 + ["cold"] * 298 + [None]
    df = spark.createDataFrame([*zip(keys, values), ("hot", None), ("nothing", None)], "k string, v double")
    found = value_at_place(df, ["k"], F.col("v"), lambda n: F.floor(n * 0.6))
    want = {k: sorted(v for x, v in zip(keys, values) if x == k) for k in ("hot", "cold", None)}
    assert {r["k"]: (r["_n"], r["_v"]) for r in found.collect()} == {
        k: (len(v), v[int(np.floor(len(v) * 0.6))]) for k, v in want.items()}
    assert value_at_place(df, [], F.col("v"), lambda n: n - 1).first()["_v"] == max(values)
    assert value_at_place(df.limit(0), ["k"], F.col("v"), lambda n: n - 1).count() == 0


def test_several_measures_share_one_pass(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, None), (2, 5.0, 7.0)], "k int, a double, b double")
    assert rows(exact_quantiles(df, ["k"], {"ma": ("a", 0.5), "mb": ("b", 0.5)}), "k") == [(1, 2.0, 10.0), (2, 5.0, 7.0)]


def test_nested_row_number_equals_global_order(spark):
    data = [(d, s, f) for d in range(3) for s in range(2) for f in "ab" if (d, s, f) != (1, 0, "b")]
    df = spark.createDataFrame(data[::-1], "d int, s int, f string").repartition(4)
    result = rows(nested_row_number(df, ["d", "s", "f"], "id").select("d", "s", "f", "id"), "id")
    assert [r[:3] for r in result] == sorted(data) and [r[3] for r in result] == list(range(1, len(data) + 1))


def test_column_helpers(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([(1, 4.0, "Local | National"), (2, 4.0, "National"), (3, None, ""), (4, 1.0, None)],
                               "k int, v double, t string")
    out = df.select("k", safe_ratio("v", F.col("k") - 1).alias("r"), has_token("t", "Local").alias("h"),
                    rank_desc("v", Window.partitionBy(F.lit(0)).orderBy(F.col("v").desc_nulls_last())).alias("rank"))
    assert rows(out, "k") == [(1, None, True, 1), (2, 4.0, False, 1), (3, None, False, None), (4, 1 / 3, False, 3)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, None, 9.0)], "k int, a double, b double")
    result = rows(df.groupBy("k").agg(safe_corr("a", "b").alias("r")), "k")
    assert result[0] == (1, None) and result[1][1] == pytest.approx(1.0)
