"""The store x family layer: history bucketed by series, shared by the steps that follow."""
import re

from pyspark.sql import functions as F

from shelfcast.forecast import intermittent
from shelfcast.operators import features, rules
from shelfcast.plans.workspace import SeriesWorkspace, Workspace
from shelfcast.schemas import SALES_GRAIN


def test_features_of_the_bucketed_history_need_no_shuffle(spark, folder):
    train = SeriesWorkspace.of(spark, folder).rollup()["train"]
    frame = features.add_causal_features(features.densify(train), check=False)
    assert not re.findall(r"Exchange hashpartitioning", frame._jdf.queryExecution().executedPlan().toString())
    plain = features.add_causal_features(features.densify(spark.createDataFrame(train.toPandas(), train.schema)), check=False)
    assert frame.count() == plain.count()
    assert not frame.exceptAll(plain).limit(1).count()


def test_layer_keeps_every_observed_row(spark, folder):
    base, space = Workspace.of(spark, folder), SeriesWorkspace.of(spark, folder)
    sales, rolled = base.raw()["train"], space.rollup()
    last = sales.agg(F.max("date")).first()[0]
    past = sales.filter(F.datediff(F.lit(last), "date") >= 16)
    assert rolled["train"].count() == past.count()
    assert rolled["train"].agg(F.sum("sales")).first()[0] == past.agg(F.sum("sales")).first()[0]
    series = sales.select("store_nbr", "family").distinct().count()
    days = sales.filter(F.datediff(F.lit(last), "date") < 16).select("date").distinct().count()
    assert rolled["future"].count() == series * days == rolled["future"].select(*SALES_GRAIN).distinct().count()


def test_cohort_is_that_of_readiness(spark, folder):
    from shelfcast.operators import readiness
    from shelfcast.plans import series_queries
    space = SeriesWorkspace.of(spark, folder)
    wanted = intermittent.intermittent_series(readiness.forecast_readiness(space.warehouse()))
    assert sorted(map(tuple, series_queries.cohort(space).collect())) == sorted(map(tuple, wanted.collect()))


def test_rules_find_what_is_broken(spark):
    child = spark.createDataFrame([(1, 5.0, "x"), (1, -1.0, "x"), (2, 2.0, "y"), (None, 1.0, None)], "k int, v double, t string")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    empty = child.limit(0)
    book = rules.RuleBook({"child": child, "parent": parent, "empty": empty}, {"child": ["k"]})
    zero = lambda name, value: rules.Check(name, value, "0", value == 0, "")
    found = {r["check_name"]: (r["actual_value"], r["passed"]) for r in book.rows([
        zero("orphans", book.orphans("child", ["k"], "parent")), zero("negative", book.count("child", F.col("v") < 0)),
        zero("doubled", book.doubled("child")), zero("empty", book.count("empty")), zero("empty_total", book.total("empty", "v")),
        zero("texts", book.distinct("child", "t")), zero("no_child", book.orphans("empty", ["k"], "parent")),
        rules.Check("total", book.total("child", "v"), "7.0", book.total("child", "v") == 7.0, "")]).collect()}
    assert found == {"orphans": ("2", False), "negative": ("1", False), "doubled": ("1", False), "empty": ("0", True),
                     "empty_total": ("0.0", True), "texts": ("3", False), "no_child": ("0", True), "total": ("7.0", True)}


def test_rules_read_a_table_once_for_all_its_measures(spark, folder):
    t = Workspace.of(spark, folder).warehouse()
    book = rules.RuleBook({"fact": t["fact_daily_sales"], "dim": t["dim_store"]}, {})
    checks = [rules.Check(str(i), book.count("fact", F.col("sales") < i), "0", F.lit(True), "") for i in range(3)]
    checks.append(rules.Check("o", book.orphans("fact", ["store_key"], "dim"), "0", F.lit(True), ""))
    book.rows(checks)
    assert book._found()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
