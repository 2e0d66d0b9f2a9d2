"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelquarry.llm.common import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; a component is named by its smallest node.

    Each round lets every node choose the smallest of itself and its neighbours, follows the choice once more,
    and replaces both ends of every link by what they chose; links inside a node vanish. Rounds are
    few, as links shrink by a factor. A node with very many links only meets sums and unique
    join partners. Each round is written to the shared folder. Links with a null end are ignored.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    edges = store(ends.filter("a < b").union(ends.filter("a > b").select("b", "a")).distinct(), "edges")
    mapping = None
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        chosen = store(lowest.select(F.col("a").alias("node"), F.least("a", "low").alias("to")), "chosen")
        after = chosen.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = store(chosen.join(after, "to").select("node", F.col("next").alias("to")), "step")
        mapping = step if mapping is None else store(
            mapping.withColumnRenamed("to", "mid").join(step.withColumnRenamed("node", "mid"), "mid", "left").select("node", F.coalesce("to", "mid").alias("to")),
            "mapping")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x != y")
        edges = store(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if mapping is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(mapping, "node", "left").select("node", F.coalesce("to", "node").alias("component"))
