"""Refinement: exact distances of a bounded number of candidates, in the clear or from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.vectors import is_finite, l2
from veilspan.operators import crypto
from veilspan.operators.evaluate import opened_counts


def _ranked(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("distance", 9), "hamming", "vec_id"))
    return rows.withColumn("rank", rank)


def distances(budgeted: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """q_id, vec_id, hamming, distance of the budgeted candidates; those without a usable vector are left out.

    Candidates are joined on their id; the queries, a stated set, are small.
    """
    q = queries.select("q_id", F.col("embedding").cast("array<double>").alias("q"))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(is_finite(F.col("v")))
    rows = budgeted.select("q_id", "vec_id", "hamming").join(v, "vec_id").join(q, "q_id")
    return rows.select("q_id", "vec_id", "hamming", l2(F.col("q"), F.col("v")).alias("distance"))


def encrypted_distances(budgeted: DataFrame, queries: DataFrame, records: DataFrame, keys: DataFrame) -> DataFrame:
    """As distances, from encrypted records: each candidate record is opened once, however many queries want it."""
    wanted = budgeted.select("vec_id").distinct()
    opened = crypto.decrypted(records.where(~F.col("deleted")).join(wanted, "vec_id", "left_semi"), keys)
    return distances(budgeted, queries, opened.where("embedding IS NOT NULL").select("vec_id", "embedding"))


def top_k(found: DataFrame, k: int) -> DataFrame:
    """q_id, rank, vec_id, distance by (distance, hamming, id)."""
    return _ranked(found).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "distance")


def needs_retry(found: DataFrame, queries: DataFrame, k: int, factor: int = 10) -> DataFrame:
    """q_id of queries with fewer than k results, or than factor times k opened candidates (rows of these, or counts)."""
    n = opened_counts(found)
    both = queries.select("q_id").join(n, "q_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.where((F.least(F.col("n"), F.lit(k)) < k) | (F.col("n") < factor * k)).select("q_id")


def touched(found: DataFrame) -> DataFrame:
    """Ids that any query opened."""
    return found.select("vec_id").distinct()
