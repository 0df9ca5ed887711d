"""Connected components of a table of links, by alternating large and small stars.

Every round rewires each node's neighbours to the smallest one (Kiveris et al., "Connected components in
MapReduce and beyond", 2014); it is two aggregations and joins over the links, so nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v). Large: each node's larger neighbours go to its least; small: the others and itself do."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """links: u, v (bigint). Returns node, component (the smallest node reachable) for nodes with links."""
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = scratch.save(links, f"{name}0"), None
    for i in range(max_rounds):
        links = scratch.save(_star(_star(links, True), False), f"{name}{i + 1}")
        scratch.drop(f"{name}{i}")
        n = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == n:
            break
        before = n
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
