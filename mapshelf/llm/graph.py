"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapshelf.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link, with the smallest node of its component as root.

    In turn, each node's larger neighbours, then all its smaller ones, are linked to its smallest neighbour, until nothing changes; the number
    of turns grows with the logarithm of the longest path. Smallest neighbours are combined before the shuffle, and written, so
    that a node with very many links is split in the join that follows. Null ends and links of a node to itself do not count.
    """
    def oriented(df: DataFrame, x, y) -> DataFrame:
        return df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()

    links = stored(oriented(links, F.col(a), F.col(b)), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "links-low")
        links = stored(oriented(both.where("v > u").join(low, "u"), F.col("v"), F.col("m")), "links-large")
        low = stored(links.groupBy("u").agg(F.min("v").alias("m")), "links-low")
        near = links.join(low, "u")
        small = near.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("u").alias("x"), F.col("m").alias("y")))
        links = stored(oriented(small, F.col("x"), F.col("y")), "links-small")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
