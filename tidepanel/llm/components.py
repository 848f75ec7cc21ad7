"""Connected components of an undirected edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node on an edge; ``edges`` has columns a and b.

    Each round is written to the shared folder, and rounds go on until the edges are stars that no longer change.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = stored(_star(_star(now, True), False), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("node"), "label").distinct())
