"""Components against a plain union-find, with hubs of either end and long chains."""
import random

import pytest
from pyspark.sql import functions as F

from shelfcast.llm.components import components


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


CASES = {
    "small hub": [(0, i) for i in range(1, 400)],
    "large hub": [(1000, i) for i in range(400)],
    "chain": [(i, i + 1) for i in range(60)],
    "two hubs and a bridge": [(5, i) for i in range(10, 200)] + [(900, i) for i in range(300, 500)] + [(199, 300)],
    "nulls, loops, repeated and turned links": [(1, 1), (None, 2), (2, None), (3, 4), (4, 3), (3, 4), (-7, 3)],
    "empty": [],
    "random": [(random.Random(3).randrange(300) * k % 311, random.Random(k).randrange(300)) for k in range(260)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_union_find(spark, name):
    links = CASES[name]
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["component"] for r in components(df).collect()} == plain(links)


def test_joins_deal_the_edges_of_a_hub(spark):
    """No exchange of the edges is by one end alone."""
    from shelfcast.llm import components as module
    edges = spark.range(1, 2000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    for step in (module._large_star, module._small_star):
        told = step(edges)._jdf.queryExecution().executedPlan().toString()
        assert "part#" in told


def test_driver_holds_no_news_of_the_edges(spark, tmp_path):
    """A packed file of edges is far smaller than the news repeated for each part, so none of it is broadcast."""
    from shelfcast.llm import components as module
    links = spark.range(1, 4000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    links.unionByName(spark.range(1, 4000).select((F.col("id") + 5000).alias("u"), F.col("id").alias("v"))).write.parquet(f"{tmp_path}/edges")
    for step in (module._large_star, module._small_star):
        told = step(spark.read.parquet(f"{tmp_path}/edges"))
        told.collect()
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize(("links", "rounds"), [([(0, i) for i in range(1, 50)], 0), ([(1, 2), (2, 3), (10, 11)], 1), ([], 0)])
def test_no_round_without_a_change(spark, monkeypatch, links, rounds):
    from shelfcast.llm import components as module
    ran, star = [], module._small_star
    monkeypatch.setattr(module, "_small_star", lambda edges: ran.append(1) or star(edges))
    found = module.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in found.collect()} == plain(links) and len(ran) == rounds


def test_settled_is_a_star_around_the_smallest(spark):
    from shelfcast.llm import components as module
    for edges, settled in (([(2, 1), (3, 1), (5, 4)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False), ([], True)):
        assert module._settled(spark.createDataFrame(edges, "u long, v long")) is settled
