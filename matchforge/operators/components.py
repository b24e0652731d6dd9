"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.sources.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node of the component of every node that has a link: (node, component).

    Large-star and small-star rounds in turn (Kiveris et al., 2014) until nothing
    changes; each round is written to the shared folder, so lost executors cost
    one round at most and plans stay short. Only two numbers a round come to the
    driver. Minima are combined before the shuffle, and a node with very many
    links meets only its own minimum in a join that AQE can split. Links to
    itself, repeated links and links with a null end add nothing.
    """
    x, y = F.col(a), F.col(b)
    edges = links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = stored(edges, "edges")
    before = _digest(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes that edges (a, b) lead to from `start` (node), itself included, a breadth-first round at a time."""
    seen = stored(start.distinct(), "seen")
    frontier = seen
    while not frontier.isEmpty():
        steps = frontier.join(edges, frontier["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        frontier = stored(steps.join(seen, "node", "left_anti"), "frontier")
        seen = seen.union(frontier)
    return seen
