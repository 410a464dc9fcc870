"""Connected components by alternating large-star and small-star rounds.

Each round replaces edges by edges to the smallest known neighbour until nothing
changes; the number of rounds grows with the logarithm of the graph's size.  A
node's neighbours are never gathered in one place: their minimum is a combinable
aggregate, and nodes with a large part of all edges meet it by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, join_counted, saved


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_counted(both, least, ["u"], 2 * count)
    return joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, ["u"], count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest node.

    Null ends, self-loops and repeated edges are ignored.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("s"), F.col(dst).alias("d"))
    now = saved(e.where("s is not null and d is not null and u <> v").select("u", "v").distinct(), "edges")
    stamp = None
    while True:
        new = F.xxhash64("u", "v").cast("decimal(38,0)")
        mark = tuple(now.agg(F.count("*"), F.sum(new)).first())
        if mark == stamp or not mark[0]:
            break
        stamp, before = mark, now
        large = saved(_large_star(before, mark[0]).distinct(), "stars")
        now = saved(_small_star(large, mark[0]).distinct(), "stars")
        drop_saved(before)
        drop_saved(large)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
