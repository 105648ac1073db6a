"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of longs to (node, component): the smallest node that each can reach.

    Alternates large stars (a node's larger neighbours go to its least one) and small stars (its smaller ones do) until the edges stay as they are,
    which takes a number of rounds logarithmic in the number of nodes. Minima are taken before rows are shuffled; the
    edges of a hub are dealt again by the other end. Nodes without an edge to another aren't returned.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        moved = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
