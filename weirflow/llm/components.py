"""Connected components of links between documents, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import materialise, release


def _least(links: DataFrame) -> DataFrame:
    """For each node the least of its neighbourhood. Written out before it is joined back, so that both sides of the join have an exchange of their own and AQE can split the rows of a hub."""
    return materialise(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b, any order and repetition): component is the least node reachable.

    The number of rounds grows with the logarithm of the longest chain, not with the size of a component,
    and each round is written out, after which the files of the round before go. No links give no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs, state = materialise(pairs, "links"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Each node points its larger neighbours to the least of its neighbourhood, then all of them and itself.
        first = _least(both)
        large = materialise(both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large")
        second = _least(large)
        small = large.join(second, "u").select("m", F.explode(F.array("u", "v")).alias("u")).filter("u > m").select("u", F.col("m").alias("v")).distinct()
        before, pairs = pairs, materialise(small, "links")
        release(before, first, large, second)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return materialise(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
