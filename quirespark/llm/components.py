"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.shared import freeze, release


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node of its component, other than itself). edges: longs a and b.

    Nodes that are roots themselves are not listed. Loops, repeats and either direction are allowed. Each step joins
    edges to a written table of one row for each node, so that Spark can split the edges of a node with many.
    """
    stars = freeze(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (now := stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != before and now[0]:
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = freeze(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = freeze(both.join(lowest, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        lower = freeze(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        joined = large.join(lower, "u")
        old, stars = stars, freeze(joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct(), "small-stars")
        release(old, lowest, large, lower)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
