"""The block index: vectors sorted by code key, cut into blocks, with a representative code each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.config import Coding
from veilspan.operators import coding
from veilspan.operators.ranking import numbered


@dataclass(frozen=True)
class Index:
    """Routing state only: no plaintext, ciphertext or key."""

    functions: coding.GFunctions
    partitions: DataFrame  # table, division, part_idx, n_ids, min_key, max_key, center_key, rep_code
    membership: DataFrame  # table, division, part_idx, vec_id

    def write(self, path: str) -> None:
        spark = self.partitions.sparkSession
        self.functions.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/gfuncs")
        self.partitions.write.mode("overwrite").partitionBy("table", "division").parquet(f"{path}/partitions")
        self.membership.write.mode("overwrite").partitionBy("table", "division").parquet(f"{path}/membership")

    @staticmethod
    def read(spark, path: str, lam: int) -> Index:
        return Index(coding.GFunctions.from_table(spark.read.parquet(f"{path}/gfuncs"), lam), spark.read.parquet(f"{path}/partitions"), spark.read.parquet(f"{path}/membership"))


def positions(codes: DataFrame, block: int, n_vectors: int) -> DataFrame:
    """Codes with pos (by key, then id) and part_idx = pos div block."""
    return numbered(codes, ["table", "division"], ["key", "vec_id"], "pos", n_vectors).withColumn("part_idx", F.floor(F.col("pos") / block).cast("bigint"))


def blocks(placed: DataFrame, block: int) -> DataFrame:
    """One row a block; the representative is element (n - 1) div 2."""
    inside = F.col("pos") - F.col("part_idx") * block
    group = placed.withColumn("_at", inside).groupBy("table", "division", "part_idx")
    out = group.agg(
        F.count(F.lit(1)).alias("n_ids"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.array_sort(F.collect_list(F.struct("_at", "key", "code"))).alias("_all")
    )  # block rows at most in a list
    middle = F.get("_all", F.floor((F.col("n_ids") - 1) / 2).cast("int"))
    return out.select("table", "division", "part_idx", "n_ids", "min_key", "max_key", middle["key"].alias("center_key"), middle["code"].alias("rep_code"))


def build(vectors: DataFrame, c: Coding, functions: coding.GFunctions | None = None) -> Index:
    g = functions or coding.functions_from_sample(vectors, c)
    placed = positions(coding.encode(vectors, g), c.block, vectors.count())
    return Index(g, blocks(placed, c.block), placed.select("table", "division", "part_idx", "vec_id"))
