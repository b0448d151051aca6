"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """Roots of all linked nodes, from links (a long, b long): node, root, the smallest node of its component.

    Each round writes its edges to the shared folder; nothing but a count and a checksum reaches the driver. Minima are
    combined before the shuffle, so a node with very many links stays cheap; the joins on nodes can be split when skewed.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
