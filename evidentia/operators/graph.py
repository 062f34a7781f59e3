"""Evidence graph: edges and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..sources.work import cut


def edges(*frames: DataFrame) -> DataFrame:
    """edge_id, source, relation, target of all frames (source, relation, target), each edge once."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out.select(stable_id("edg", "source", "relation", "target").alias("edge_id"), "source", "relation", "target").dropDuplicates(["edge_id"])


def traverse(graph: DataFrame, start: str, depth: int, relations: list[str] | None = None) -> DataFrame:
    """Out-edges of every node within ``depth - 1`` steps of ``start``, with the step at which each node was first reached.

    One join per step, nodes seen before being left out; frontier and result stay tables, and each step's plan starts
    from checkpoints of the one before.
    """
    allowed = cut(graph if relations is None else graph.where(F.col("relation").isin(relations)))
    spark = graph.sparkSession
    frontier = spark.createDataFrame([(start,)], "node string")
    seen, out = frontier, None
    for step in range(depth):
        found = cut(allowed.join(F.broadcast(frontier) if step == 0 else frontier, allowed["source"] == frontier["node"]).select("edge_id", "source", "relation", "target", F.lit(step).alias("depth")))
        out = found if out is None else out.unionByName(found)
        frontier = cut(found.select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that links lead to) of every end of links (a, b); ids are numbers. Rounds are checkpointed and end when nothing moves.

    In a round every node is tied to the smallest of its neighbours and itself, first those above it and then those below; each round shortens every path, and sums of ties only get smaller.
    """
    up = cut(links.where("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    while True:
        seen = up.union(up.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = seen.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("to"))
        above = seen.where("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("to").alias("low")).distinct()
        root = above.groupBy("high").agg(F.min("low").alias("to"))
        tied = above.join(root, "high")
        ties = tied.select("high", F.col("to").alias("low")).union(tied.where("low != to").select(F.col("low").alias("high"), F.col("to").alias("low")))
        now = cut(ties.distinct())
        if now.exceptAll(up).isEmpty() and up.exceptAll(now).isEmpty():
            roots = now.select(F.col("low").alias("id")).distinct().join(now.select(F.col("high").alias("id")).distinct(), "id", "left_anti")
            return now.select(F.col("high").alias("id"), F.col("low").alias("component")).union(roots.select("id", F.col("id").alias("component")))
        up = now
