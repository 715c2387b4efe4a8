"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import join_skewed, materialise


#: From so many links on, nodes of very many neighbours are joined apart; fewer links fit any task.
MANY = 1_000_000


def _with_least(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """links(u, v) with the m of their u from least(u, m)."""
    if n < MANY:
        return links.join(least, "u")
    links = materialise(links, "components-links")
    least = least.join(links.groupBy("u").agg(F.count("*").alias("links")), "u")
    return join_skewed(links, materialise(least, "components-least"), "u", "links")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.filter("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node reachable.

    Every round is written to the shared folder. Rounds go on until a round changes nothing;
    their number grows with the logarithm of the longest path.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialise(current.distinct(), "components")
    before = state(current)
    for _ in range(max_rounds if before[0] else 0):
        current = materialise(_small_star(_large_star(current, before[0]), before[0]), "components")
        now = state(current)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())
