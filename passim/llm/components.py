"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passim.session import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of an edge.

    Each turn ties all greater neighbours of a node, and then all smaller ones,
    to the smallest it knows, which at least halves the long ways. A node with
    many neighbours is reduced by partial minima before any shuffle; the edges
    are tied by a join, whose large partitions Spark can split. Loops and
    repeated edges do no harm.
    """
    now = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(smallest, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = checkpointed(small)
        # Done when every node hangs on one root that hangs on none.
        roots = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        now = new
        if roots.isEmpty() and several.isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
