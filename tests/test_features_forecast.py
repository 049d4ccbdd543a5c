import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import day, rows
from shelfcast.forecast import (
    baselines, evaluate, intermittent, intervals, metrics, recursive, segments, selection, splits, submission,
)
from shelfcast.operators import features, stores as store_ops

SALES = "store_nbr int, family string, date date, sales double, onpromotion int"


def dense_days(spark, days=96, start="2024-01-01"):
    first = day(start)
    return spark.createDataFrame(
        [(1, "A", first + dt.timedelta(days=i), float(i + 1), 0) for i in range(days)], SALES)


def test_growth_windows(spark):
    daily = spark.createDataFrame([
        (1, day("2023-05-01"), 75.0), (1, day("2024-03-01"), 100.0), (1, day("2024-05-01"), 50.0), (1, day("2024-06-30"), 100.0),
        (2, day("2024-03-01"), 0.0), (2, day("2024-05-01"), 20.0)], "store_key int, full_date date, daily_sales double")
    one, two = store_ops.recent_growth(daily).orderBy("store_key").collect()
    assert (one["recent_90d_sales"], one["previous_90d_sales"], one["recent_90d_growth"], one["recent_90d_yoy_growth"]) == (150, 100, 0.5, 1.0)
    assert one["recent_90d_observed_days"] == 2
    assert (one["recent_90d_start_date"], one["recent_90d_end_date"]) == (day("2024-04-02"), day("2024-06-30"))
    assert two["recent_90d_growth"] is None and two["has_yoy_comparison"] == 0


def test_densify_keeps_missing_days_null(spark):
    df = spark.createDataFrame([(1, "A", day("2024-01-01"), 0.0, 1), (1, "A", day("2024-01-04"), 5.0, 0),
                                (2, "A", day("2024-01-02"), 7.0, 2)], SALES)
    result = rows(features.densify(df).select("store_nbr", "date", "sales"), "store_nbr", "date")
    assert [r[2] for r in result] == [0.0, None, None, 5.0, None, 7.0, None, None]


def test_lag_rules(spark):
    frame = dense_days(spark, 60)
    row = features.add_causal_features(frame).filter(F.col("date") == day("2024-02-29")).first()
    assert (row["sales_lag_1"], row["sales_lag_56"], row["sales_lag_364"]) == (59.0, 4.0, None)
    assert row["rolling_mean_7"] == 56.0 and row["rolling_median_28"] == 45.5 and row["rolling_zero_rate_28"] == 0.0
    with pytest.raises(ValueError, match="dense"):
        features.add_lags(frame.filter(F.col("date") != day("2024-01-10")))
    for bad in ([], [0], [1, 1], [True]):
        with pytest.raises(ValueError):
            features.valid_lags(bad)
    with pytest.raises(RuntimeError, match="unsafe"):
        features.feature_matrix(frame.withColumn("transactions", F.lit(1)), ["transactions"])


def test_missing_day_invalidates_its_windows(spark):
    gap = dense_days(spark, 40).withColumn("sales", F.when(F.col("date") != day("2024-01-20"), F.col("sales")))
    result = features.add_rollings(gap).filter(F.col("date").between("2024-01-20", "2024-01-28")).orderBy("date").collect()
    assert result[0]["rolling_mean_7"] is not None
    assert all(r["rolling_mean_7"] is None for r in result[1:8]) and result[8]["rolling_mean_7"] is not None


def test_future_targets_do_not_reach_features(spark):
    origin = "2024-03-10"
    frame = dense_days(spark)
    changed = frame.withColumn("sales", F.when(F.col("date") > origin, 9999.0).otherwise(F.col("sales")))
    columns = ["date", *features.LAG_FEATURES, *features.ROLLING_FEATURES]
    a, b = (features.add_causal_features(f, origin).select(*columns) for f in (frame, changed))
    assert a.exceptAll(b).count() == 0


def test_next_day_only(spark):
    frame = dense_days(spark)
    assert features.next_day_features(frame, "2024-03-10", "2024-03-11", "2024-03-11").count() == 1
    with pytest.raises(ValueError, match="recursive"):
        features.next_day_features(frame, "2024-03-10", "2024-03-11", "2024-03-12")


def plus_ten(model, frame):
    return frame.withColumn("prediction", F.col("sales_lag_1") + 10)


def test_recursion_feeds_predictions_back(spark):
    frame = dense_days(spark)
    result = rows(recursive.recursive_forecast(None, frame, "2024-03-20", "2024-03-21", "2024-03-24", plus_ten)
                  .select("date", "prediction"), "date")
    assert [r[1] for r in result] == [90.0, 100.0, 110.0, 120.0]
    changed = frame.withColumn("sales", F.when(F.col("date") > "2024-03-20", 5000.0).otherwise(F.col("sales")))
    again = rows(recursive.recursive_forecast(None, changed, "2024-03-20", "2024-03-21", "2024-03-24",
                                              lambda m, f: plus_ten(m, f).select("date", "store_nbr", "family", "prediction"))
                 .select("date", "prediction"), "date")
    assert again == result
    with pytest.raises(ValueError, match="dense"):
        recursive.recursive_forecast(None, frame.filter(F.col("date") != day("2024-02-01")), "2024-03-20", "2024-03-21", "2024-03-22", plus_ten)
    with pytest.raises(ValueError, match="horizon"):
        recursive.recursive_forecast(None, frame, "2024-04-01", "2024-04-02", "2024-04-20", plus_ten)
    with pytest.raises(RuntimeError, match="finite"):
        recursive.recursive_forecast(None, frame, "2024-03-20", "2024-03-21", "2024-03-21",
                                     lambda m, f: f.withColumn("prediction", F.lit(-1.0)))


def test_array_features_equal_window_features(spark, folder):
    from shelfcast.plans.workspace import Workspace
    ws = Workspace.of(spark, folder)
    train = ws.rollup()["train"]
    origin = train.agg(F.max("date")).first()[0]
    captured = {}

    def keep(model, frame):
        captured["frame"] = frame
        return frame.withColumn("prediction", F.lit(0.0))

    recursive.recursive_forecast(None, ws.known_frame(), origin, origin + dt.timedelta(days=1), origin + dt.timedelta(days=1), keep)
    names = [*features.LAG_FEATURES, *features.ROLLING_FEATURES]
    got = {(r["store_nbr"], r["family"]): r for r in captured["frame"].collect()}
    want = ws.training_frame().filter(F.col("date") == origin + dt.timedelta(days=1)).collect()
    assert len(want) == len(got)
    for row in want:
        for name in names:
            value = got[row["store_nbr"], row["family"]][name]
            assert (value is None) == (row[name] is None), name
            assert value is None or value == pytest.approx(row[name], rel=1e-9, abs=1e-9), name


def test_expected_folds(spark):
    result = rows(splits.rolling_splits(spark, "2017-08-15"), "fold")
    assert [str(r[1]) for r in result] == ["2017-06-12", "2017-06-28", "2017-07-14", "2017-07-30"]
    assert str(result[-1][3]) == "2017-08-15"
    for bad in (0, -1, True):
        with pytest.raises(ValueError):
            splits.fold_array(F.lit("2017-08-15").cast("date"), bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 1e6), st.floats(-10, 1e6)), min_size=1, max_size=8))
def test_metrics_match_formulas(spark, pairs):
    import numpy as np
    y, p = (np.array(x) for x in zip(*pairs))
    got = spark.createDataFrame(pairs, "sales double, prediction double").agg(
        *metrics.error_metrics(), metrics.pinball("sales", "prediction", 0.1).alias("pin")).first()
    assert got["rmsle"] == pytest.approx(np.sqrt(np.mean((np.log1p(np.clip(p, 0, None)) - np.log1p(y)) ** 2)), abs=1e-9)
    assert got["mae"] == pytest.approx(np.abs(y - p).mean(), rel=1e-9, abs=1e-9)
    if y.sum() == 0:
        assert got["wape"] is None
    assert got["pin"] == pytest.approx(np.maximum(0.1 * (y - p), -0.9 * (y - p)).mean(), rel=1e-9, abs=1e-9)


def test_baselines_ignore_the_future_and_fall_back(spark):
    history = spark.createDataFrame([(1, "A", day("2024-01-01") + dt.timedelta(days=i), float(i), 0) for i in range(40)], SALES)
    known = history.filter(F.col("date") <= "2024-01-31")
    for name in baselines.MODELS:
        a = baselines.forecast_baseline(history, "2024-02-01", "2024-02-09", "2024-01-31", name)
        b = baselines.forecast_baseline(known, "2024-02-01", "2024-02-09", "2024-01-31", name)
        assert a.exceptAll(b).count() == 0 and a.count() == 9
    naive = rows(baselines.forecast_baseline(known, "2024-02-01", "2024-02-09", "2024-01-31", "seasonal_naive_7d"), "date")
    assert [r[3] for r in naive] == [24, 25, 26, 27, 28, 29, 30, 24, 25]
    extra = spark.createDataFrame([(1, "A"), (9, "B")], "store_nbr int, family string")
    fallback = baselines.forecast_baseline(known, "2024-02-01", "2024-02-01", "2024-01-31", "last_value_naive", extra)
    assert [r[3] for r in rows(fallback, "store_nbr")] == [30, 15]
    with pytest.raises(ValueError):
        baselines.forecast_baseline(known, "2024-01-31", "2024-02-01", "2024-01-31", "last_value_naive")
    with pytest.raises(ValueError, match="unsupported"):
        baselines.forecast_baseline(known, "2024-02-01", "2024-02-01", "2024-01-31", "other")


def test_croston_variants(spark):
    history = spark.createDataFrame([(1, "A", day("2024-01-01") + dt.timedelta(days=i), v, 0)
                                     for i, v in enumerate([0.0, 2.0, 0.0, 0.0, 4.0])], SALES)
    series = spark.createDataFrame([(1, "A"), (2, "A")], "store_nbr int, family string")
    expected = {"croston": 2.2 / 2.1, "sba": 0.95 * 2.2 / 2.1, "tsb": 0.4645 * 2.2}
    for method, value in expected.items():
        result = rows(intermittent.forecast_intermittent(history, "2024-01-06", "2024-01-06", "2024-01-05", method, series), "store_nbr")
        assert result[0][3] == pytest.approx(value) and result[1][3] == 0.0
    with pytest.raises(ValueError):
        intermittent.forecast_intermittent(history, "2024-01-06", "2024-01-06", "2024-01-05", "other", series)
    with pytest.raises(ValueError):
        intermittent.forecast_intermittent(history, "2024-01-06", "2024-01-06", "2024-01-05", "sba", series, alpha=0)


@pytest.fixture(scope="module")
def oof(spark):
    data = [(f, day("2024-01-01") + dt.timedelta(days=i), 1 + i % 2, "A", y, p)
            for f in range(1, 5) for i, (y, p) in enumerate([(0.0, 1.0), (10.0, 8.0), (20.0, 18.0)])]
    return spark.createDataFrame(data, "fold int, date date, store_nbr int, family string, sales double, prediction double")


def test_segments_and_intervals(spark, oof):
    segments.validate_oof(oof)
    with pytest.raises(ValueError, match="folds"):
        segments.validate_oof(oof.filter("fold < 4"))
    one = segments.score_segments(oof, ["family"]).first()
    assert (one["observation_count"], one["series_count"], one["fold_count"], one["wape"]) == (12, 2, 4, pytest.approx(20 / 120))
    radius = intervals.conformal_radius(oof.filter("fold = 1"), [])
    assert radius.first()["calibration_log_radius"] == pytest.approx(0.6931471805599453)
    by_series = intervals.calibrate_series(oof)
    assert rows(by_series.select("fold", "store_nbr", "calibration_observation_count"), "fold", "store_nbr") == [
        (f, s, 3 - s) for f in range(2, 5) for s in (1, 2)]
    bounds = intervals.prediction_intervals(oof, 0.5)
    assert not bounds.filter("NOT (p10 <= p50 AND p50 <= p90 AND p10 >= 0)").count()
    assert intervals.score_intervals(bounds, ["fold"]).first()["empirical_coverage"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        intervals.prediction_intervals(oof, float("nan"))
    with pytest.raises(ValueError, match="cover"):
        evaluate.score_predictions(oof.select("date", "store_nbr", "family", "sales").filter("store_nbr = 1").distinct(),
                                   oof.filter("store_nbr = 2"))


def test_selection_rules(spark):
    def scores(values):
        return spark.createDataFrame([(n, f, v + f * (2e-6 if n == "M2" else 1e-6), 1.0, 0.1) for n, v in values.items() for f in range(1, 5)],
                                     "experiment string, fold int, rmsle double, mae double, wape double")

    tuned = selection.summarize_tuning(scores({"T0_untuned": 0.41, "T1_compact_regularized": 0.4097,
                                               "T2_moderate_capacity": 0.401, "T3_robust_subsample": 0.4012}))
    assert selection.chosen_result(tuned)["experiment"] == "T2_moderate_capacity"
    flat = selection.summarize_tuning(scores({name: 0.41 for name in selection.GRID}))
    assert selection.chosen_result(flat)["experiment"] == "T0_untuned"
    with pytest.raises(ValueError):
        selection.summarize_tuning(scores({"T0_untuned": 0.4}))
    summary = selection.summarize_ablation(scores({"M0": 0.48, "M1": 0.44, "M2": 0.4401, "M3": 0.45}))
    assert {r["experiment"]: r["effect"] for r in summary.collect()} == {
        "M0": "reference", "M1": "improved", "M2": "negligible effect", "M3": "degraded"}
    assert selection.recommended_experiment(summary).first()["experiment"] == "M1"


def test_submission_rules(spark):
    future = spark.createDataFrame([(100 + i, day("2024-01-03") + dt.timedelta(days=i // 2), 1 + i % 2, "A", 0) for i in range(4)],
                                   "id long, date date, store_nbr int, family string, onpromotion int")
    train = spark.createDataFrame([(i, day("2024-01-01") + dt.timedelta(days=i // 2), 1 + i % 2, "A", 1.0, 0) for i in range(4)],
                                  "id long, date date, store_nbr int, family string, sales double, onpromotion int")
    predictions = future.select("date", "store_nbr", "family", F.col("id").cast("double").alias("prediction"))
    result = submission.create_submission(future, predictions)
    assert rows(result, "id") == [(100 + i, 100.0 + i) for i in range(4)]
    submission.validate_submission(result, future, train)
    with pytest.raises(ValueError, match="cover"):
        submission.create_submission(future, predictions.limit(3))
    with pytest.raises(ValueError, match="invalid"):
        submission.validate_submission(result.withColumn("sales", -F.col("sales")), future, train)
    with pytest.raises(ValueError, match="day after"):
        submission.validate_future(future.withColumn("date", F.date_add("date", 1)), train)


def test_model_fit_save_and_load(spark, folder, tmp_path):
    from shelfcast.forecast import model
    from shelfcast.plans.workspace import Workspace
    ws = Workspace.of(spark, folder)
    frame = ws.training_frame()
    origin = ws.rollup()["train"].agg(F.max("date")).first()[0]
    short = model.TreeParameters(step_size=0.3, rounds=2, max_depth=2)
    fitted = model.train_global_model(frame, origin, short)
    ahead = frame.filter(F.col("date") > F.lit(origin))
    first = rows(model.predict_sales(fitted, ahead).select("date", "store_nbr", "family", "prediction"), "date", "store_nbr", "family")
    assert all(r[3] >= 0 for r in first) and fitted.importances().count() == len(features.FEATURES)
    fitted.save(str(tmp_path / "m"))
    loaded = model.GlobalModel.load(str(tmp_path / "m"))
    assert rows(model.predict_sales(loaded, ahead).select("date", "store_nbr", "family", "prediction"), "date", "store_nbr", "family") == first
    with pytest.raises(ValueError, match="no training rows"):
        model.train_global_model(frame, "1990-01-01", short)


def test_experiments_resume(spark, folder, tmp_path, monkeypatch):
    from shelfcast.forecast import backtest
    calls = []

    def fake(training, known, actual, runs):
        calls.append({r.fold: r.model.cutoff for r in runs})
        return spark.createDataFrame([(r.experiment, r.fold, 1.0, 2.0) for r in runs], "experiment string, fold int, sales double, prediction double")

    monkeypatch.setattr(backtest, "backtest_runs", fake)
    frame = dense_days(spark)
    origins = {1: day("2024-02-01"), 2: day("2024-02-17")}
    path = str(tmp_path / "scores")
    plan = {"M1": (None, None)}
    assert backtest.run_experiments(frame, frame, frame, {1: origins[1]}, plan, path).count() == 1
    assert backtest.run_experiments(frame, frame, frame, origins, plan, path).count() == 2
    assert calls == [{1: origins[1]}, {2: origins[2]}]


def test_id_fingerprint_sees_the_order(spark):
    from shelfcast.forecast import submission
    data = [(i, 100 + i) for i in range(50)]
    swapped = [(i, {3: 107, 7: 103}.get(i, v)) for i, v in data]
    of = lambda pairs, parts: submission.ordered_id_hash(
        spark.createDataFrame(pairs, "place int, id long").repartition(parts), ["place"]).first()
    assert of(data, 1) == of(data[::-1], 7)
    assert of(data, 3)["id_count"] == 50 and of(data, 3)["id_fingerprint"] != of(swapped, 3)["id_fingerprint"]
