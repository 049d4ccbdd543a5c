"""Boosted trees by shards and the walk over the horizon, against plain versions."""
import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.forecast import backtest, boosting, model, recursive, walk
from shelfcast.forecast.boosting import Bins, Fit, Growth, TreeParameters
from shelfcast.operators import features

DAY = dt.date(2024, 1, 1)


def shard(n, columns, seed=1, levels=8):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, levels, (n, columns)).astype(np.uint8)
    sales = np.round(np.expm1(codes[:, 0] / 3 + (codes[:, 1] > levels // 2) * codes[:, 2] / 4 + rng.random(n)), 3) * (rng.random(n) > 0.2)
    return {"key": rng.permutation(n).astype(np.int64), "sales": sales, "codes": codes}


def grow(data, parameters, target="log_sales"):
    names = [f"f{i}" for i in range(data["codes"].shape[1])]
    return Growth(Fit("x", DAY, parameters, tuple(names), target), data, names)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10_000), l1=st.sampled_from([0.0, 0.5]), l2=st.sampled_from([0.0, 3.0]), least=st.sampled_from([1, 20]), target=st.sampled_from(boosting.TARGETS))
def test_first_split_is_the_best_one(seed, l1, l2, least, target):
    p = TreeParameters(num_leaves=2, rounds=1, min_rows_per_leaf=least, feature_fraction=1.0, row_fraction=1.0, lambda_l1=l1, lambda_l2=l2)
    growth = grow(shard(80, 3, seed), p, target)
    score, codes = growth.score.copy(), growth.codes
    guess = 1 / (1 + np.exp(-score)) if growth.logistic else score
    g, h = guess - growth.y, guess * (1 - guess) if growth.logistic else np.ones(len(score))
    strength = lambda rows: max(abs(g[rows].sum()) - l1, 0) ** 2 / (h[rows].sum() + l2)
    every = np.ones(len(score), bool)
    options = [(strength(low) + strength(~low) - strength(every), f, cut) for f in range(3) for cut in range(8)
               for low in [codes[:, f] <= cut] if low.sum() >= least and (~low).sum() >= least]
    tree = growth.tree(0)
    best = max(options, default=(0.0, 0, 0))
    if best[0] > 1e-9:
        assert tree["gain"][0] == pytest.approx(best[0], rel=1e-9, abs=1e-9)
        low = codes[:, tree["feature"][0]] <= tree["bin"][0]
        for rows, leaf in ((low, 1), (~low, 2)):
            value = -p.step_size * np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - l1, 0) / (h[rows].sum() + l2)
            assert tree["value"][leaf] == pytest.approx(value, abs=1e-9) and np.allclose(growth.score[rows] - score[rows], value)
    else:
        assert tree["feature"] == [-1]


def test_limits_of_a_tree():
    data = shard(3000, 5)
    for p in (TreeParameters(num_leaves=7, rounds=3), TreeParameters(max_depth=2, rounds=3), TreeParameters(min_rows_per_leaf=700, rounds=3, row_fraction=1.0)):
        growth = grow(data, p)
        for number in range(p.rounds):
            tree = growth.tree(number)
            leaves = sum(f < 0 for f in tree["feature"])
            depth = {0: 0}
            for i, f in enumerate(tree["feature"]):
                if f >= 0:
                    depth[tree["left"][i]] = depth[tree["right"][i]] = depth[i] + 1
            assert leaves <= p.num_leaves and (p.max_depth < 0 or max(depth.values()) <= p.max_depth)
            assert p.min_rows_per_leaf < 700 or leaves <= 4


def test_order_of_rows_does_not_matter():
    data, order = shard(500, 4), np.random.default_rng(3).permutation(500)
    p = TreeParameters(rounds=4, min_rows_per_leaf=10)
    a, b = grow(data, p), grow({k: v[order] for k, v in data.items()}, p)
    assert [a.tree(i) for i in range(4)] == [b.tree(i) for i in range(4)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(DAY + dt.timedelta(days=d), s, "A", float(x), float(y), float(np.expm1(abs(2 * x + (y > 0.5)))) if rng.random() > 0.1 else None)
            for d in range(120) for s in range(20) for x, y in [rng.random(2)]]
    return spark.createDataFrame(rows, "date date, store_nbr int, family string, x double, y double, sales double").cache()


SHORT = TreeParameters(rounds=40, step_size=0.2, min_rows_per_leaf=20, num_leaves=8)


def fits(*days, parameters=SHORT, target="log_sales"):
    return [Fit(f"d{d}", DAY + dt.timedelta(days=d), parameters, ("x", "y"), target) for d in days]


def test_models_learn_and_do_not_depend_on_company(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "SHARD_ROWS", 700)  # three shards at the later cutoff
    both = boosting.fit_all(table, fits(60, 110), str(tmp_path / "a"))
    alone = boosting.fit_all(table, fits(60), str(tmp_path / "b"))
    assert both["d60"].feature.shape[0] == 2 * 40 and both["d110"].feature.shape[0] == 3 * 40
    for k in ("feature", "threshold", "left", "right", "value", "gain"):
        assert np.array_equal(getattr(both["d60"], k), getattr(alone["d60"], k))
    seen = table.where("sales IS NOT NULL").toPandas()
    late = seen[seen["date"] > DAY + dt.timedelta(days=110)]
    predicted = both["d110"].predict({"x": late["x"].to_numpy(), "y": late["y"].to_numpy()})
    assert np.abs(np.log1p(predicted) - np.log1p(late["sales"])).mean() < 0.12
    assert set(both["d110"].gains()) == {"x", "y"} and both["d60"].predict({"x": np.empty(0), "y": np.empty(0)}).shape == (0,)
    with pytest.raises(ValueError, match="no training rows"):
        boosting.fit_all(table, fits(-5, 60), str(tmp_path / "c"))


def test_later_targets_are_not_learned_from(spark, table, tmp_path):
    changed = table.withColumn("sales", F.when(F.col("date") > F.lit(DAY + dt.timedelta(days=60)), F.lit(1e6)).otherwise(F.col("sales"))) \
        .withColumn("x", F.when(F.col("date") > F.lit(DAY + dt.timedelta(days=60)), F.lit(77.0)).otherwise(F.col("x")))
    a, b = (boosting.fit_all(t, fits(60), str(tmp_path / n))["d60"] for n, t in (("a", table), ("b", changed)))
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_stored_fits_are_read_again(spark, table, monkeypatch):
    first = boosting.fitted(table, fits(60, 90))

    def refuse(rows, open_fits, path):
        raise AssertionError([f.cutoff for f in open_fits])

    monkeypatch.setattr(boosting, "fit_all", refuse)
    again = boosting.fitted(table.repartition(3), fits(90))
    assert np.array_equal(first["d90"].value, again["d90"].value) and again["d90"].features == ["x", "y"]
    for other in (fits(90, parameters=TreeParameters(rounds=2)), fits(91), fits(90, target="any_sale")):
        with pytest.raises(AssertionError):
            boosting.fitted(table, other)
    with pytest.raises(AssertionError):
        boosting.fitted(table.withColumn("sales", F.col("sales") + 1), fits(90))


def known_frame(spark, days=430):
    return spark.createDataFrame([(DAY + dt.timedelta(days=d), s, "A", None if (d + s) % 97 == 0 else float((d * 7 + s) % 13), float(d % 5))
                                  for d in range(days) for s in (1, 2, 3)], "date date, store_nbr int, family string, sales double, plan double")


def test_walk_equals_the_stepwise_recursion(spark):
    frame, origins = known_frame(spark), {1: DAY + dt.timedelta(days=380), 2: DAY + dt.timedelta(days=400)}

    def by_array(factor, x):
        return factor * (np.nan_to_num(x["sales_lag_1"], nan=2.0) + x["plan"] + np.nan_to_num(x["rolling_median_7"], nan=1.0))

    def by_frame(factor, df):
        value = F.coalesce("sales_lag_1", F.lit(2.0)) + F.col("plan") + F.coalesce("rolling_median_7", F.lit(1.0))
        return df.withColumn("prediction", F.lit(factor) * value)

    got = walk.walk({1: {"a": 0.5, "b": 0.25}, 2: {"a": 0.5}}, frame, ["plan"], origins, 9, by_array)
    want = recursive.forecast_folds({1: 0.5, 2: 0.5}, frame, origins, 9, by_frame)
    order = ["fold", "date", "store_nbr"]
    pairs = lambda df: [(*[r[c] for c in order], round(r["prediction"], 9)) for r in df.orderBy(*order).collect()]
    assert pairs(got.where("run = 'a'")) == pairs(want) and got.where("run = 'b'").count() == 27
    with pytest.raises(ValueError, match="ends before"):
        walk.walk({1: {"a": 1.0}}, frame, [], {1: DAY + dt.timedelta(days=425)}, 9, by_array)


def test_history_inputs_equal_the_window_features(spark):
    frame = known_frame(spark)
    rows = features.add_causal_features(frame.withColumn("onpromotion", F.lit(0))).where("date >= '2025-02-25'").collect()
    sales = {(r["store_nbr"], r["date"]): r["sales"] for r in frame.collect()}
    history = np.array([[np.nan if sales[r["store_nbr"], d] is None else sales[r["store_nbr"], d]
                         for d in (r["date"] - dt.timedelta(days=k) for k in range(recursive.HISTORY_DAYS, 0, -1))] for r in rows])
    for name, values in walk.history_inputs(history).items():
        want = [np.nan if r[name] is None else r[name] for r in rows]
        assert np.allclose(values, want, equal_nan=True), name


def test_changed_settings_run_again(spark, tmp_path, monkeypatch):
    calls = []

    def fake(training, known, actual, runs):
        calls.append([(r.experiment, r.fold) for r in runs])
        return spark.createDataFrame([(r.experiment, r.fold, 1.0, 2.0) for r in runs], "experiment string, fold int, sales double, prediction double")

    monkeypatch.setattr(backtest, "backtest_runs", fake)
    frame, path, origins = known_frame(spark, 5), str(tmp_path / "scores"), {1: DAY, 2: DAY + dt.timedelta(days=1)}
    run = lambda plan, rows=frame: backtest.run_experiments(rows, rows, rows, origins, plan, path).count()
    assert run({"M1": (SHORT, ["x"])}) == 2 and run({"M1": (SHORT, ["x"])}) == 2
    assert run({"M1": (SHORT, ["x", "y"])}) == 2 and run({"M1": (TreeParameters(), ["x"]), "M2": (SHORT, ["x"])}) == 4
    assert run({"M1": (SHORT, ["x"])}, frame.withColumn("sales", F.lit(1.0))) == 2
    one, two = [("M1", 1), ("M1", 2)], [("M1", 1), ("M1", 2), ("M2", 1), ("M2", 2)]
    assert [sorted(c) for c in calls] == [one, one, two, one]


def test_two_stage_predictions_are_products(spark, table):
    frame = table.withColumn("sales", F.when(F.col("store_nbr") < 5, F.lit(0.0)).otherwise(F.col("sales"))).withColumn("onpromotion", F.col("x"))
    fitted = model.train_two_stage_model(frame, DAY + dt.timedelta(days=100), SHORT, ["onpromotion", "store_nbr"])
    got = model.predict_two_stage(fitted, frame.limit(50)).collect()
    stage = lambda m: [r["prediction"] for r in model.predict_sales(m, frame.limit(50)).collect()]
    for r, chance, size in zip(got, stage(fitted.occurrence), stage(fitted.magnitude), strict=True):
        assert 0 <= chance <= 1 and r["prediction"] == pytest.approx(chance * size) and (r["store_nbr"] >= 5 or chance < 0.05)


def test_every_fit_and_shard_is_a_partition_of_its_own(spark):
    rng = np.random.default_rng(8)
    cutoffs = [DAY + dt.timedelta(days=i) for i in range(3)]
    rows = [(i, int(k), 1.0, b"\x00") for i, n in enumerate((40, 900, 3000)) for k in rng.integers(0, 1 << 60, n)]
    table = spark.createDataFrame(rows, "cutoff_no int, key long, sales double, bins binary")
    fits = [Fit(f"{c}/{t}", c, TreeParameters(), ("x",), t) for c in cutoffs for t in boosting.TARGETS]
    units, found = boosting.dealt(table, fits, cutoffs, {0: 2, 1: 3, 2: 5})
    assert len(units) == 30 == found.rdd.getNumPartitions()
    held = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("unit").alias("units"), F.min("unit").alias("unit")).collect()
    assert all(r["units"] == 1 and r["unit"] == r["task"] for r in held) and len(held) == 30
    assert found.count() == 3 * len(rows)


@pytest.mark.parametrize("target", boosting.TARGETS)
def test_sums_by_feature_are_those_of_one_call(target, monkeypatch):
    data, p = shard(4000, 6, levels=62), TreeParameters(rounds=3, min_rows_per_leaf=20)
    by_feature = grow(data, p, target)
    monkeypatch.setattr(boosting, "WIDE_ROWS", 1 << 20)
    at_once = grow(data, p, target)
    for number in range(p.rounds):
        monkeypatch.setattr(boosting, "WIDE_ROWS", 0)
        tree = by_feature.tree(number)
        monkeypatch.setattr(boosting, "WIDE_ROWS", 1 << 20)
        assert tree == at_once.tree(number)


def test_shares_of_the_sketches_are_built_once(spark, monkeypatch):
    rows, made = spark.createDataFrame([(DAY, float(i)) for i in range(100)], "date date, x double"), []
    monkeypatch.setattr(boosting.F, "lit", lambda x, lit=F.lit: made.append(x) or lit(x))
    first, second = boosting.bins_by_cutoff(rows.select("date", "x", (2 * F.col("x")).alias("y")), ["x", "y"], [DAY, DAY], 64)
    assert len([x for x in made if isinstance(x, float)]) == 61
    assert np.allclose(first.bounds[1][1:], 2 * first.bounds[0][1:]) and np.array_equal(first.bounds[0], second.bounds[0])
