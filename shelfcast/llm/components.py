"""Connected components of a table of links, by alternating large and small stars.

The smallest id of a large group is one key that holds all its members: no join gathers the edges of a node in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored


#: Parts that the edges of one node are dealt over in a join; what a node has to be told is repeated for each part.
PARTS = 16


def _told(edges: DataFrame, end: str, other: str, news: DataFrame, how: str) -> DataFrame:
    """Edges beside what ``news`` (node, m) tells their ``end``; a node's edges are spread by their ``other`` end.

    Always joined by sorting: the size that a broadcast would be chosen by is that of the packed file of edges, and the news
    that the driver would have to hold take several hundred times as much, once each is repeated for its parts."""
    part = F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int")
    each = news.select(F.col("node").alias(end), "m", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return edges.withColumn("part", part).join(each.hint("merge"), [end, "part"], how)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every edge (u > v) moves from v to the smallest neighbour of v, where that is smaller than v.

    Only nodes with a smaller neighbour have news, so the edges of a settled root, however many, meet none."""
    news = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    moved = _told(edges, "v", "u", news, "left").select("u", F.coalesce("m", "v").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    news = least.where("n > 1").select(F.col("u").alias("node"), "m")
    others = _told(edges, "u", "v", news, "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Are all groups stars around their smallest node: every u has one edge, and no v is also a u?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where(F.col("up") + F.col("down") > 1).agg(F.count("*")).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is the smallest id reachable.

    Each round is written to the shared folder, so a lost executor costs its tasks only. Its plan is what the driver holds most of,
    so no round is spent on seeing that nothing changes. Null ends and self-links are ignored; an empty table gives no rows."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        edges = stored(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
