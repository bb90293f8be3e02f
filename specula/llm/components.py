"""Connected components of a graph given as edges, by alternating large and small stars.

Each round hangs the neighbours of a node on the least of them (Kiveris et al., "Connected components in MapReduce
and beyond", 2014); the number of rounds grows with the logarithm of a component's size. Only minima are gathered
for a node, in a partial aggregate, and joined back, so that a node of any degree is never in one task at once:
Spark splits a skewed join. Each round is a written table; nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm.common import drop_written, written


def _star(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): (v, least neighbour of u or u itself)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (least node) of every node that has an edge to another."""
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)  # v is less than u here, so m is the least
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = written(hung.where("u <> v").distinct(), "stars")
        drop_written(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
