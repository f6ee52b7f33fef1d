"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``; a component is named by its smallest node.

    Large-star and small-star rounds: every node hands its larger (then its smaller) neighbours to the smallest node it
    knows, until each component is a star around its smallest node; their number grows with the logarithm of the longest
    chain. Each round's links are a written table, so a lost executor costs a re-read. Minima are combined before they
    are shuffled; only a count and a sum of hashes reach the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut_lineage(small.filter("u > v").distinct())
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
