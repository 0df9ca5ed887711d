"""Exact neighbours: a stated query set against all vectors, in groups of vectors of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.coding import matrix

#: Bytes of vectors that a task holds at most, on average over the hash of their ids.
GROUP_BYTES = 32 << 20


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and distances (rounded to 9 digits) of the k rows nearest to q by (distance, id); the row ``own`` is left out."""
    d = np.round(np.sqrt(((x - q) ** 2).sum(1)), 9)
    if own is not None:
        d[ids == own] = np.inf
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    near = near[np.isfinite(d[near])]
    near = near[np.lexsort((ids[near], d[near]))[:k]]
    return ids[near], d[near]


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """q_id, rank, vec_id, distance: the k nearest by (distance rounded to 9 digits, id).

    Vectors are dealt into groups of bounded size; each task holds one group, and the queries stream past it in
    batches. It gives its k best for every query, so the merge gets k rows for each query and group.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = size["n"], size["dim"]
    if not n:
        return spark.createDataFrame([], "q_id bigint, rank int, vec_id bigint, distance double")
    groups = max(1, -(-n * dim * 8 // group_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    v, e = F.lit(False).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding")
    held = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"), v, F.col("vec_id").cast("bigint").alias("id"), e)
    asking = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"), F.lit(True).alias("asks"), F.col("q_id").cast("bigint").alias("id"), e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, x, ids = None, [], []
        for b in batches:
            g, asks, own, rows = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), matrix(b.column(3), dim)
            out: list[list] = [[], [], []]
            for at in range(len(g)):
                if g[at] != group:
                    group, x, ids = g[at], [], []
                if not asks[at]:
                    x.append(rows[at : at + 1])
                    ids.append(own[at : at + 1])
                    continue
                if len(x) > 1:
                    x, ids = [np.concatenate(x)], [np.concatenate(ids)]
                if x:
                    found, far = nearest(x[0], ids[0], rows[at], own[at] if exclude_self else None, k)
                    for column, value in zip(out, (np.full(len(found), own[at]), found, far)):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["q_id", "vec_id", "distance"])

    both = held.unionByName(asking).repartition(groups, "g").sortWithinPartitions("g", "asks")
    found = both.mapInArrow(run, "q_id bigint, vec_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "distance")


def exact_nn(queries: DataFrame, vectors: DataFrame, exclude_self: bool = True) -> DataFrame:
    """q_id, vec_id, distance: the nearest; the lowest id wins ties."""
    return exact_knn(queries, vectors, 1, exclude_self).select("q_id", "vec_id", "distance")
