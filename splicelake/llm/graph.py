"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import checkpointed


def fresh(name: str) -> Column:
    """The long column ``name`` as an expression of its own. A join on it shuffles its side anew instead of reusing the
    partitioning of an aggregation below, and so adaptive execution can split partitions with hot keys."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("long"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the least node that it is connected to, for each node of ``links`` that is not its own root.

    Alternating stars: each node links its greater neighbours to the least node it knows (large star), then itself and
    its smaller neighbours (small star), until nothing changes; every round is a few joins of links, and each round's
    links are written to the shared folder. Nodes are longs. Links with a null end and links of a node to itself count
    for nothing.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    stars = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    stars = checkpointed(stars)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u").alias("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u").alias("u"), "m")
        joined = large.join(least, "u").select("u", "v", "m")
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = checkpointed(joined.select(F.inline(ends)).where("u != v").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
