"""Whole plans: build, search with retry and fallback, metrics, maintenance."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.config import Config, Search
from veilspan.operators import coding, crypto, evaluate, keys, refine, routing, scan, store
from veilspan.operators.index import Index, build
from veilspan.scratch import Scratch
from veilspan.sources import vecs


def tokens(queries: DataFrame, index: Index, top_k: int) -> DataFrame:
    """q_id, table, division, code, key, top_k: what routing needs to know of a query."""
    return coding.encode(queries, index.functions, "q_id").withColumn("top_k", F.lit(top_k))


def derive_tokens(made: DataFrame, top_k: int) -> DataFrame:
    """The same tokens for another number of results; codes are not computed again."""
    return made.withColumn("top_k", F.lit(top_k))


def query_tokens(queries: DataFrame, index: Index | None, top_k: int) -> DataFrame:
    """tokens, behind checks: there is a finished index, and every query has its dimension and is finite.

    A cloaked token is this one too: no noise is added to it.
    """
    if index is None:
        raise ValueError("tokens need a finished index")
    if top_k < 1:
        raise ValueError("top_k is 1 or more")
    return tokens(vecs.require_dim(queries, index.functions.dim), index, top_k)


def adaptive_probes(s: Search, factor: float, most: int) -> int:
    """probes times a factor, at most ``most``."""
    return max(s.probes, min(most, int(s.probes * factor)))


def route(queries: DataFrame, index: Index, s: Search, probes: int, deleted: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """q_id, vec_id, hamming of all candidates: of the probes before which fewer than the cap were seen."""
    probed = routing.probe_order(tokens(queries, index, 0), index.partitions, probes)
    seen = routing.sightings(probed, index.membership, deleted)
    if exclude_self:
        seen = seen.where("vec_id <> q_id")
    cap = s.hard_cap if s.cap is None else s.cap
    return routing.candidates(routing.capped(seen, cap) if cap else seen)


def refine_once(
    queries: DataFrame, index: Index, s: Search, probes: int, vectors: DataFrame | None = None, records: DataFrame | None = None, key_table: DataFrame | None = None, exclude_self: bool = False
) -> DataFrame:
    """q_id, vec_id, hamming, distance of the opened candidates."""
    deleted = None if records is None else records.where("deleted").select("vec_id")
    budgeted = routing.prefiltered(route(queries, index, s, probes, deleted, exclude_self), s.refinement_limit, s.threshold)
    if records is None:
        return refine.distances(budgeted, queries, vectors)
    return refine.encrypted_distances(budgeted, queries, records, key_table)


def probed_runs(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """scan.runs of the queries, kept as a table."""
    scratch = Scratch(queries.sparkSession, "runs")
    made = scratch.save(tokens(queries, index, 0), "tokens")
    return scratch.save(scan.runs(made, routing.probe_order(made, index.partitions, probes)), "runs")


def scan_once(queries: DataFrame, index: Index, probes: int, k: int, vectors: DataFrame | None = None, exclude_self: bool = False) -> scan.Found:
    """What refine_once opens without a cap and limit, ranked and counted but not listed."""
    return scan.search(probed_runs(queries, index, probes), index, queries, k, vectors, exclude_self)


def scan_encrypted(queries: DataFrame, index: Index, probes: int, k: int, records: DataFrame, key_table: DataFrame, exclude_self: bool = False) -> scan.Found:
    """The same from the store: live records that any query wants are opened once, and others never."""
    runs = probed_runs(queries, index, probes)
    wanted = scan.search(runs, index, queries, k, None, exclude_self).touched
    opened = crypto.decrypted(records.where(~F.col("deleted")).join(wanted, "vec_id", "left_semi"), key_table)
    return scan.search(runs, index, queries, k, opened.where("embedding IS NOT NULL").select("vec_id", "embedding"), exclude_self)


def uncut(s: Search) -> bool:
    """Whether all candidates are opened, so that they are too many to list."""
    return s.cap == 0 and s.refinement_limit >= 2**31 - 1


def search_whole(queries: DataFrame, index: Index, config: Config, k: int, vectors: DataFrame, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """search for uncut settings: (results, counts), where counts (q_id, n) stand for the opened candidates."""
    s = config.search
    first = scan_once(queries, index, s.probes, k, vectors, exclude_self)
    best, counts = first.best, first.counts
    again = queries.join(refine.needs_retry(counts, queries, k, s.retry_factor), "q_id", "left_semi")
    if not again.isEmpty():
        second, ids = scan_once(again, index, s.retry_probes, k, vectors, exclude_self), again.select("q_id")
        best = best.join(ids, "q_id", "left_anti").unionByName(second.best)
        counts = counts.join(ids, "q_id", "left_anti").unionByName(second.counts)
    empty = queries.join(counts.select("q_id"), "q_id", "left_anti")
    if not empty.isEmpty():
        third = scan_once(empty, index, max(2 * s.probes, 4), k, vectors, exclude_self)
        best, counts = best.unionByName(third.best), counts.unionByName(third.counts)
    return refine.top_k(best, k), counts


def search(
    queries: DataFrame, index: Index, config: Config, k: int, vectors: DataFrame | None = None, records: DataFrame | None = None, key_table: DataFrame | None = None, exclude_self: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(results, opened), without the vector of a query's own id if exclude_self. Queries with too little run again with retry_probes, empty ones once more with the most."""
    s, scratch = config.search, Scratch(queries.sparkSession, "search")
    more = {"vectors": vectors, "records": records, "key_table": key_table, "exclude_self": exclude_self}
    opened = scratch.save(refine_once(queries, index, s, s.probes, **more), "first")
    again = queries.join(refine.needs_retry(opened, queries, k, s.retry_factor), "q_id", "left_semi")
    if not again.isEmpty():
        second = refine_once(again, index, s, s.retry_probes, **more)
        opened = scratch.save(opened.join(again.select("q_id"), "q_id", "left_anti").unionByName(second.select(*opened.columns)), "second")
    empty = queries.join(opened.select("q_id").distinct(), "q_id", "left_anti")
    if not empty.isEmpty():
        opened = scratch.save(opened.unionByName(refine_once(empty, index, s, max(2 * s.probes, 4), **more).select(*opened.columns)), "third")
    return refine.top_k(opened, k), opened


def metrics(results: DataFrame, opened: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """q_id, k, recall, distance_ratio, candidate_ratio."""
    out = evaluate.recall(results, truth, queries, ks).join(evaluate.distance_ratio(results, truth, queries, ks), ["q_id", "k"])
    return out.join(evaluate.candidate_ratio(opened, queries, ks), ["q_id", "k"]).select("q_id", "k", "recall", "distance_ratio", "candidate_ratio")


def run_queries(
    queries: DataFrame,
    index: Index,
    config: Config,
    truth: DataFrame,
    limit: int | None = None,
    vectors: DataFrame | None = None,
    records: DataFrame | None = None,
    key_table: DataFrame | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """One metric row for each query and k: one search at the largest k for all queries at once serves every k.

    Times are the batch's, shared equally by its queries. limit takes the first queries by id.
    """
    ks, scratch = config.evaluation.k_variants, Scratch(queries.sparkSession, "run")
    if limit is not None:
        queries = vecs.first_queries(queries, limit)
    queries = scratch.save(queries.select("q_id", "embedding"), "queries")
    started = time.time()
    s = config.search
    whole = uncut(s) and records is None
    results, opened = search_whole(queries, index, config, max(ks), vectors, exclude_self) if whole else search(queries, index, config, max(ks), vectors, records, key_table, exclude_self)
    results = scratch.save(results, "results")
    n = queries.count()
    each = (time.time() - started) * 1000 / max(1, n)
    deleted = None if records is None else records.where("deleted").select("vec_id")
    listed = scan_once(queries, index, s.probes, max(ks), None, exclude_self).counts if whole else route(queries, index, s, s.probes, deleted, exclude_self)
    routed = scratch.save(evaluate.opened_counts(listed).withColumnRenamed("n", "cand_total"), "routed")
    kept = evaluate.opened_counts(opened).withColumnRenamed("n", "cand_decrypted")
    got = results.groupBy("q_id").agg(F.count(F.lit(1)).alias("_n"))
    code_bytes = 8 * -(-config.coding.m * config.coding.lam // 63) * config.coding.tables * config.coding.divisions
    dim = index.functions.dim
    out = metrics(results, opened, truth, queries, ks)
    for part in (routed, kept, got):
        out = out.join(part, "q_id", "left")
    none, nil = F.lit(0).cast("bigint"), F.lit(0.0)
    return out.select(
        "q_id", "k", "recall", "distance_ratio", "candidate_ratio",
        F.least(F.coalesce("_n", none), F.col("k")).alias("returned"),
        F.coalesce("cand_total", none).alias("cand_total"), F.least(F.coalesce("cand_total", none), F.lit(s.refinement_limit)).alias("cand_kept"), F.coalesce("cand_decrypted", none).alias("cand_decrypted"),
        F.lit(each).alias("server_ms"), F.lit(each).alias("client_ms"), F.lit(each).alias("run_ms"), nil.alias("decrypt_ms"), nil.alias("insert_ms"),
        F.lit(code_bytes + (28 + 8 * dim if records is not None else 0)).alias("token_bytes"), F.lit(dim).alias("vector_dim"),
        F.coalesce("cand_decrypted", none).alias("touched_count"), *[none.alias(c) for c in ("reenc_count", "reenc_time_ms", "reenc_bytes_delta", "reenc_bytes_after")],
        F.lit(config.evaluation.ratio_source).alias("ratio_denom_source"), F.col("k").alias("token_k"), F.lit(max(ks)).alias("token_k_base"),
        (F.row_number().over(Window.partitionBy("k").orderBy("q_id")) - 1).alias("q_index"), F.lit("full").alias("mode"),
    )


def evaluate_one(query: DataFrame, index: Index, config: Config, k: int, **where) -> list[tuple[int, float]]:
    """(id, distance) of one query's k best, in order."""
    return [(r["vec_id"], r["distance"]) for r in search(query.limit(1), index, config, k, **where)[0].orderBy("rank").collect()]  # k rows


def evaluate_batch(queries: DataFrame, index: Index, config: Config, k: int, **where) -> DataFrame:
    """q_id and the ids of its k best, in order."""
    found = search(queries, index, config, k, **where)[0].groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l"))
    return found.select("q_id", F.transform("l", lambda x: x["vec_id"]).alias("ids"))


def query_only(spark: SparkSession, index_path: str, store_path: str, lam: int) -> tuple[Index, store.Store]:
    """The stored index and records, without a source: searches need nothing else."""
    return Index.read(spark, index_path, lam), store.Store(spark, store_path)


def migrate_touched(held: store.Store, service: keys.KeyService, touched: DataFrame) -> dict[str, int]:
    """One rotation, then re-encryption of the touched records; routing tables are not involved.

    The report also has the time and the bytes of all records before and after.
    """
    spark, started = held.spark, time.time()
    before = held.read()
    size = lambda: store.storage(held.read()).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    bytes_before = size()
    target = service.rotate()
    table = service.table(spark)
    n = store.stale(before, target, touched).count()
    held.change(lambda r: store.migrate(r, table, target, touched))
    left = store.remaining(held.read(), target - 1).first()["n"]
    service.count(n)
    after = size()
    report = {"touched": touched.distinct().count(), "reencrypted": n, "target": target, "left_on_previous": left}
    return report | {"time_ms": round((time.time() - started) * 1000), "bytes_delta": after - bytes_before, "bytes_after": after}


def migrate_now() -> dict[str, int]:
    """Asks for nothing but the next end of run: touched records migrate there, so this report is empty."""
    return dict.fromkeys(("touched", "reencrypted", "time_ms", "bytes_delta", "bytes_after"), 0)


def rotate_full(held: store.Store, service: keys.KeyService) -> dict[str, int]:
    """One rotation, then re-encryption of all live records, whatever was touched."""
    report = migrate_touched(held, service, held.read().select("vec_id"))
    held.set_index_version(report["target"])
    return report


def rebuild_index(held: store.Store, service: keys.KeyService, version: int, config: Config) -> Index:
    """An index of the live records of one key version, opened with that version's key.

    A stored index needs none of this; it serves where only the records are left.
    """
    rows = store.filter_deleted(store.of_version(held.read(), version))
    opened = crypto.decrypted(rows, service.table(held.spark)).where("embedding IS NOT NULL")
    return build(Scratch(held.spark, "rebuilt").save(opened.select("vec_id", "embedding"), "vectors"), config.coding)


def retire(held: store.Store, service: keys.KeyService) -> list[int]:
    used = {r["key_version"] for r in store.key_usage(held.read()).collect()}  # a row for each key version
    return service.retire(used)
