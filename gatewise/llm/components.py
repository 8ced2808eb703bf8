"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.scratch import table


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) of the nodes in ``links(a, b)`` but the least themselves.

    Each round hands the larger, then the smaller neighbours of every node to the least node
    around it, until nothing changes; a row is then a node and its component. Rounds aggregate
    before they shuffle and are written, so no node's links meet in one task.
    """
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = tuple(now)
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = table(large.where("a <> b").distinct(), "edges")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = table(small.where("a <> b").distinct(), "edges")
