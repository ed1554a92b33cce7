"""Connected components of a graph given by its edges, in a number of rounds that grows with the logarithm of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node that edges lead to), for each node that has an edge to another.

    Large-star and small-star steps in turn: each node hands its larger, then its smaller neighbours to the smallest
    one that it knows. Each round is written to the shared folder, and only a count and a checksum of its edges come to
    the driver, to see whether it has changed anything. Null nodes and loops are ignored.
    """
    one = F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")
    now = written(edges.select(F.greatest(*one).alias("u"), F.least(*one).alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())
