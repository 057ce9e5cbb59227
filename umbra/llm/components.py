"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, made, stored


class Union:
    """Union-find over the nodes that a task meets; roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> list[tuple[int, int]]:
        """A link from each node to its root, without the roots."""
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) of every node with a link; edges: longs u, v.

    Each step is written to the shared folder, and the result of a step is all that the next one needs. A hub's rows
    meet in partial minima and in joins with the stored minima, of which both sides come straight from an exchange, so
    that adaptive execution can split them. Null ends and loops are no links; no links, no rows.
    """
    spark, since = edges.sparkSession, made(edges.sparkSession)
    links = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", few=True)
    while True:
        ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR (up = 1 AND root = 1)").isEmpty():  # stars only
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n = links.count()  # no step makes more links, or ends, than twice that
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", rows=n)
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", rows=n)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low", rows=n)
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = stored(small.distinct(), "links", rows=n)
        dropped(spark, since, links)
