"""Ground truth, recall, ratios and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_k(results: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, and the results of rank up to k: one search at the largest k serves all."""
    return results.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))


def recall(results: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """q_id, k, hits, recall = hits / k."""
    found, wanted = at_k(results, ks).select("q_id", "k", "vec_id"), at_k(truth, ks).select("q_id", "k", "vec_id")
    hits = found.join(wanted, ["q_id", "k", "vec_id"], "left_semi").groupBy("q_id", "k").agg(F.count(F.lit(1)).alias("hits"))
    every = queries.select("q_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    out = every.join(hits, ["q_id", "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    return out.withColumn("recall", F.col("hits") / F.col("k"))


def distance_ratio(results: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """q_id, k, distance_ratio: mean of i-th found by i-th true distance, null unless all k pairs are usable."""
    pairs = results.select("q_id", "rank", F.col("distance").alias("d")).join(truth.select("q_id", "rank", F.col("distance").alias("t")), ["q_id", "rank"])
    pairs = pairs.where("t > 0").withColumn("ratio", F.col("d") / F.col("t"))
    got = at_k(pairs, ks).groupBy("q_id", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean"))
    every = queries.select("q_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return every.join(got, ["q_id", "k"], "left").select("q_id", "k", F.when(F.col("n") == F.col("k"), F.col("mean")).alias("distance_ratio"))


def opened_counts(refined: DataFrame) -> DataFrame:
    """q_id, n of opened candidates; counts are taken as they are."""
    return refined.select("q_id", "n") if "n" in refined.columns else refined.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))


def candidate_ratio(refined: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """q_id, k, candidate_ratio = opened ids / k, null if none."""
    n = opened_counts(refined)
    every = queries.select("q_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).join(n, "q_id", "left")
    return every.select("q_id", "k", F.when(F.col("n") > 0, F.col("n") / F.col("k")).alias("candidate_ratio"))


def summary(metrics: DataFrame) -> DataFrame:
    """k, queries, mean_recall, mean_ratio."""
    return metrics.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("mean_recall"), F.avg("distance_ratio").alias("mean_ratio"))


def headline(metrics: DataFrame, ratio_k: int = 100, recall_k: int = 10) -> DataFrame:
    """One row: avg_ratio at ratio_k, avg_recall at recall_k, and over all rows."""
    pick = lambda c, k: F.avg(F.when(F.col("k") == k, F.col(c)))
    return metrics.agg(pick("distance_ratio", ratio_k).alias("headline_ratio"), pick("recall", recall_k).alias("headline_recall"), F.avg("recall").alias("avg_recall"), F.avg("distance_ratio").alias("avg_ratio"))


def gt_mismatch(truth: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: n, mismatch_rate of the first truth against the true nearest."""
    both = truth.where("rank = 1").select("q_id", F.col("vec_id").alias("gt")).join(nearest.select("q_id", F.col("vec_id").alias("nn")), "q_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gt") != F.col("nn")).cast("int")).alias("mismatch_rate"))


def check_truth(truth: DataFrame, nearest: DataFrame, sample: int, tolerance: float) -> float:
    """The mismatch rate of the first ``sample`` queries; an error if it is above the tolerance."""
    first = truth.select("q_id").distinct().orderBy("q_id").limit(sample)
    rate = gt_mismatch(truth.join(first, "q_id", "left_semi"), nearest).first()["mismatch_rate"] or 0.0
    if rate > tolerance:
        raise ValueError(f"{rate:.4f} of the ground truth is wrong, more than {tolerance}")
    return rate


def check_zero_hits(hits: DataFrame, most: float = 0.8, after: int = 5) -> float:
    """The share of queries without a hit; an error if it is above ``most`` with more than ``after`` queries."""
    row = zero_hit_rate(hits).first()
    if row["queries"] > after and row["zero_rate"] > most:
        raise ValueError(f"{row['zero']} of {row['queries']} queries found no true neighbour")
    return row["zero_rate"]


def mean_run_time(rows: DataFrame) -> DataFrame:
    """One row: art_ms, the mean run_ms over rows with run_ms > 0, null without any."""
    return rows.agg(F.avg(F.when(F.col("run_ms") > 0, F.col("run_ms"))).alias("art_ms"))


def meter_summary(rows: DataFrame, name: str, value: str) -> DataFrame:
    """name, count, total_ms, mean_ms, max_ms of a meter's records; a meter without values counts 0."""
    return rows.groupBy(F.col(name).alias("name")).agg(
        F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total_ms"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.max(value), F.lit(0.0)).alias("max_ms")
    )


def gt_in_bounds(truth: DataFrame, n: int) -> DataFrame:
    return truth.agg(F.min("vec_id").alias("min_id"), F.max("vec_id").alias("max_id")).withColumn("ok", (F.col("min_id") >= 0) & (F.col("max_id") < n))


def latency_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, std (of the population), min, max, p95."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.percentile(value, 0.95).alias("p95"),
    )


def zero_hit_rate(hits: DataFrame) -> DataFrame:
    """One row: share of queries without a hit."""
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("hits") == 0).alias("zero"), (F.count_if(F.col("hits") == 0) / F.count(F.lit(1))).alias("zero_rate"))


def worst(hits: DataFrame, n: int) -> DataFrame:
    """The n queries of least recall, by recall, then id."""
    return hits.orderBy("recall", "q_id").limit(n)


def topk_factors(refined: DataFrame, results: DataFrame, n_vectors: int, k: int) -> DataFrame:
    """q_id, opened, returned, cf_k = opened / k, cf_returned = opened / returned, sf = opened / all."""
    a = opened_counts(refined).select("q_id", F.col("n").alias("opened"))
    b = results.groupBy("q_id").agg(F.count(F.lit(1)).alias("returned"))
    both = a.join(b, "q_id")
    return both.select("q_id", "opened", "returned", (F.col("opened") / k).alias("cf_k"), (F.col("opened") / F.nullif("returned", F.lit(0))).alias("cf_returned"), (F.col("opened") / n_vectors).alias("sf"))


def bounded_server_ms(rows: DataFrame) -> DataFrame:
    """server_ms is cut to the client's window where it exceeds 1.1 times that."""
    over = (F.col("client_ms") > 0) & (F.col("server_ms") > F.col("client_ms") * 1.1)
    return rows.withColumn("server_ms", F.when(over, F.col("client_ms")).otherwise(F.col("server_ms")))
