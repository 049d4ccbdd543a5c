"""What the registered model queries fit."""
import pytest

from shelfcast.forecast import backtest, model, selection, submission
from shelfcast.plans import all_queries, model_queries


class Space:
    """Stands for a workspace whose tables are not looked at."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)

    def rollup(self):
        table = self.spark.sql("SELECT DATE'2020-01-01' date, 1.0D sales")
        return dict.fromkeys(("train", "future", "stores", "raw_holidays"), table)

    def training_frame(self):
        return self.rollup()["train"]

    known_frame = training_frame

    def stored(self, name, build):
        return build()


class Seen(Exception):
    """Raised with what would be fitted."""


def seen(place):
    def stop(*args, **named):
        raise Seen([x for x in [*args, *named.values()] if isinstance(x, (model.TreeParameters, dict))][place])
    return stop


@pytest.mark.parametrize("name", ["g1_g2_g6_global_backtest", "g9_model_scores", "i3_i4_i9_two_stage_backtest", "u11_model_intervals"])
def test_backtests_use_the_whole_schedule(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(backtest, "backtest", seen(-1))
    with pytest.raises(Seen) as found:
        all_queries()[name](Space(spark, tmp_path))
    assert found.value.args[0] == model.TreeParameters() and model.TreeParameters().rounds == 250


def test_experiments_use_the_whole_schedule_and_grid(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backtest, "run_experiments", seen(-1))
    fitted = {}
    for name in ("g11_g12_ablation_summary", "g14_g15_g17_tuning_summary"):
        with pytest.raises(Seen) as found:
            all_queries()[name](Space(spark, tmp_path))
        fitted[name] = {k: parameters for k, (parameters, _) in found.value.args[0].items()}
    assert fitted["g14_g15_g17_tuning_summary"] == selection.GRID
    assert set(fitted["g11_g12_ablation_summary"].values()) == {model.TreeParameters()}


def test_final_fits_take_the_choice(spark, tmp_path, monkeypatch):
    rmsle = {"T0_untuned": 0.5, "T1_compact_regularized": 0.5, "T2_moderate_capacity": 0.5, "T3_robust_subsample": 0.4}
    scores = spark.createDataFrame([(k, f, v, 1.0, 0.1) for k, v in rmsle.items() for f in range(1, 5)],
                                   "experiment string, fold int, rmsle double, mae double, wape double")
    monkeypatch.setattr(backtest, "run_experiments", lambda *_: scores)
    monkeypatch.setattr(model, "train_global_model", seen(-1))
    monkeypatch.setattr(submission, "train_and_forecast", seen(-1))
    for name in ("g18_g19_stored_selection", "s19_z1_z5_final_forecast"):
        with pytest.raises(Seen) as found:
            all_queries()[name](Space(spark, tmp_path))
        assert found.value.args[0] == selection.GRID["T3_robust_subsample"], name
    assert model_queries.FULL == model.TreeParameters()


def test_strategies_on_the_cohort_are_fitted_together(spark, tmp_path, monkeypatch):
    class Empty(Space):
        def holds(self, name):
            return False

    def stop(training, known, actual, runs):
        raise Seen({(r.experiment, r.fold, r.model.two_stage, r.model.parameters) for r in runs})

    monkeypatch.setattr(backtest, "backtest_runs", stop)
    with pytest.raises(Seen) as found:
        model_queries.strategy_oofs(Empty(spark, tmp_path))
    assert found.value.args[0] == {("global", f, False, model_queries.FULL) for f in range(5)} | {("two_stage", f, True, model_queries.FULL) for f in range(1, 5)}


def test_routing_covers_strategies_that_had_nothing_to_score(spark):
    from shelfcast.forecast import intermittent
    scores = spark.createDataFrame([("a", f, 0.5, 1.0, 0.1) for f in (1, 2)], "model string, fold int, rmsle double, mae double, wape double")
    full = intermittent.every_fold(scores, ["a", "b"])
    assert full.count() == 8 and full.filter("rmsle IS NOT NULL").count() == 2
    assert {r["model"]: r["fold_count"] for r in intermittent.summarize_routing(full, "b").collect()} == {"a": 4, "b": 4}
    assert full.exceptAll(scores).filter("rmsle IS NOT NULL").count() == 0
