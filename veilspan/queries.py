"""Queries of the vector engine over ``embeddings`` (and ``events``), with the SQL that checks them.

Queries are the stated set: every vector whose id is divisible by 50, against all vectors but itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.config import Coding, Config, Evaluation, Search
from veilspan.functions import vectors as vx
from veilspan.operators import coding, crypto, evaluate, index, keys, knn, refine, routing, scan, store
from veilspan.plans import search as plans
from veilspan.scratch import Scratch
from veilspan.sources import reports, vecs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIM, K, KS = 64, 10, (1, 5, 10)
CODING = Coding(m=8, lam=2, divisions=2, tables=4, seed=13, min_sample=1)
#: Searches probe a fixed share of the blocks of every order and open all candidates, so recall holds at every size.
SHARE = 4
CAP, THRESHOLD, LIMIT = 150, 3, 100
#: A fixed test key ring: answers don't depend on keys, so a literal master serves.
MASTER = bytes(range(32))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def queries_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def index_of(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index, built once and kept as tables, so that queries read it back rather than build it twice."""
    path = f"{Scratch(spark, 'index').root}"
    index.build(vectors_of(spark, sf_dir), CODING).write(path)
    return index.Index.read(spark, path, CODING.lam)


def config_of(built: index.Index) -> Config:
    """Limits by the size of the index: a quarter of an order's blocks, and no cut of candidates."""
    n = built.partitions.agg(F.coalesce(F.max("part_idx") + 1, F.lit(0))).first()[0]
    probes = max(2, -(-n // SHARE))
    return Config(CODING, Search(refinement_limit=2**31 - 1, cap=0, max_candidates=2**31 - 1, probes=probes, retry_probes=2 * probes), Evaluation(k_variants=KS))


def seen_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, q = index_of(spark, sf_dir), queries_of(vectors_of(spark, sf_dir))
    probed = routing.probe_order(plans.tokens(q, built, K), built.partitions, config_of(built).search.probes)
    return routing.sightings(probed, built.membership).where("vec_id <> q_id")


def opened_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, scan.Found]:
    """(queries, vectors, what they opened): all candidates are opened, but only the best, counts and ids are listed."""
    v, built = vectors_of(spark, sf_dir), index_of(spark, sf_dir)
    q = queries_of(v)
    return q, v, plans.scan_once(q, built, config_of(built).search.probes, K, v, exclude_self=True)


def records_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store on three key versions (by id), every 7th id soft-deleted, and its keys."""
    v = vectors_of(spark, sf_dir)
    ring = crypto.key_table(spark, {i: crypto.derive_key(MASTER, i) for i in (1, 2, 3, 4)})
    parts = [store.live(crypto.encrypt_vectors(v.where(F.col("vec_id") % 3 == i), ring, i + 1)) for i in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    gone = v.where("vec_id % 7 = 3").select("vec_id")
    held = store.soft_delete(rows, gone, F.lit("2024-01-01").cast("timestamp"))
    return Scratch(spark, "records").save(held, "records"), ring


@lru_cache(1)
def _functions_sql() -> str:
    alpha, u = coding.directions(CODING, DIM)
    rows = [f"({t},{d},{j},[{','.join(repr(float(x)) for x in alpha[t, d, j])}]::DOUBLE[],{float(u[t, d, j])!r}::DOUBLE)" for t in range(CODING.tables) for d in range(CODING.divisions) for j in range(CODING.m)]
    return "g(t, d, j, alpha, u) AS (VALUES " + ",\n".join(rows) + ")"


M, P = CODING.m, "(SELECT p FROM lim)"
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS q_id, e FROM v WHERE vec_id % 50 = 0)"
_TRUTH = f"""{_V},
    near_ AS (SELECT q_id, vec_id, round(list_distance(q.e, v.e), 9) AS distance FROM q, v WHERE vec_id <> q_id),
    truth AS (SELECT * FROM (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM near_) WHERE rank <= {K})"""
_CODES = f"""{_V}, {_functions_sql()},
    smp AS (SELECT * FROM v ORDER BY vec_id LIMIT {CODING.sample_size}),
    pr AS (SELECT t, d, j, max(p) - min(p) AS rng FROM (SELECT t, d, j, list_inner_product(e, alpha) AS p FROM smp, g) GROUP BY t, d, j),
    w AS (SELECT g.t, g.d, g.j, alpha, u, greatest(rng, 1e-6) / {CODING.omega_divisor} AS omega FROM g JOIN pr ON g.t = pr.t AND g.d = pr.d AND g.j = pr.j),
    hs AS (SELECT vec_id, t, d, j, floor((list_inner_product(e, alpha) + u * omega) / omega)::BIGINT AS h FROM v, w),
    hm AS (SELECT vec_id, t, d, j, ((h % 4) + 4) % 4 AS h FROM hs),
    c AS (SELECT vec_id, t, d, sum((h // 2) * (1::BIGINT << (62 - j)) + (h % 2) * (1::BIGINT << ({62 - M} - j)))::BIGINT AS key FROM hm GROUP BY vec_id, t, d)"""
_PARTS = f"""{_CODES},
    placed AS (SELECT *, pos // {CODING.block} AS part_idx FROM (SELECT *, row_number() OVER (PARTITION BY t, d ORDER BY key, vec_id) - 1 AS pos FROM c)),
    inblk AS (SELECT *, pos - part_idx * {CODING.block} AS at_, count(*) OVER (PARTITION BY t, d, part_idx) AS n FROM placed),
    parts AS (SELECT t, d, part_idx, max(n) AS n_ids, min(key) AS min_key, max(key) AS max_key, max(key) FILTER (at_ = (n - 1) // 2) AS center_key FROM inblk GROUP BY t, d, part_idx)"""
_NEAR = f"""{_PARTS},
    tok AS (SELECT vec_id AS q_id, t, d, key FROM c WHERE vec_id % 50 = 0),
    ctr AS (SELECT * FROM (SELECT q_id, tok.t, tok.d, key, part_idx AS center, greatest(min_key - key, key - max_key, 0) AS range_dist,
            row_number() OVER (PARTITION BY q_id, tok.t, tok.d ORDER BY greatest(min_key - key, key - max_key, 0), part_idx) AS rn
            FROM tok JOIN parts ON tok.t = parts.t AND tok.d = parts.d) WHERE rn = 1)"""
_LIM = f"lim AS (SELECT greatest(2, (max(part_idx) + {SHARE}) // {SHARE})::BIGINT AS p FROM parts)"


def _probed(p: str, x: str = "") -> str:
    """Probed blocks and what is seen in them, for p probes; x ends the names."""
    return f"""
    around{x} AS (SELECT q_id, ctr.t, ctr.d, part_idx, sign(part_idx - center) AS side, abs(part_idx - center) AS dist, bit_count(xor(key, center_key))::BIGINT AS hamming
            FROM ctr JOIN parts ON ctr.t = parts.t AND ctr.d = parts.d AND abs(part_idx - center) < {p}),
    way{x} AS (SELECT *, CASE WHEN side = 0 THEN -1 ELSE max(hamming) OVER (PARTITION BY q_id, t, d, side ORDER BY dist) END AS way FROM around{x}),
    probe{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, t, d ORDER BY way, side, dist) AS probe_rank FROM way{x}) WHERE probe_rank <= {p}),
    seen{x} AS (SELECT q_id, vec_id, hamming, b.t, b.d, probe_rank FROM probe{x} b JOIN placed ON b.t = placed.t AND b.d = placed.d AND b.part_idx = placed.part_idx WHERE vec_id <> q_id),
    cand{x} AS (SELECT q_id, vec_id, min(hamming) AS hamming FROM seen{x} GROUP BY q_id, vec_id)"""


_PROBE = f"{_NEAR}, {_LIM}, {_probed(P)}"
_CAND = f"""{_PROBE},
    budget AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY hamming, vec_id) AS cand_rank FROM cand) WHERE cand_rank <= {LIMIT})"""


def _found(where: str = "TRUE") -> str:
    return f"""{_CAND},
    opened AS (SELECT q_id, vec_id, hamming, list_distance(q.e, v.e) AS distance FROM cand JOIN q USING (q_id) JOIN v USING (vec_id) WHERE {where}),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(distance, 9), hamming, vec_id) AS rank FROM opened) WHERE rank <= {K}),
    tr0 AS (SELECT q_id, vec_id, round(list_distance(q.e, v.e), 9) AS distance FROM q, v WHERE vec_id <> q_id),
    truth AS (SELECT * FROM (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM tr0) WHERE rank <= {K}),
    ks AS (SELECT unnest([{', '.join(map(str, KS))}])::INTEGER AS k),
    rec AS (SELECT q.q_id, k, (SELECT count(*) FROM found f JOIN truth t ON f.q_id = t.q_id AND f.vec_id = t.vec_id WHERE f.q_id = q.q_id AND f.rank <= k AND t.rank <= k) AS hits FROM q, ks),
    rat AS (SELECT q.q_id, k, count(f.q_id) AS n, avg(f.distance / t.distance) AS mean FROM q CROSS JOIN ks LEFT JOIN (found f JOIN truth t ON f.q_id = t.q_id AND f.rank = t.rank AND t.distance > 0) ON f.q_id = q.q_id AND f.rank <= k GROUP BY q.q_id, k),
    met AS (SELECT rec.q_id, rec.k, hits / rec.k AS recall, CASE WHEN n = rec.k THEN mean END AS distance_ratio,
            (SELECT count(*) FROM opened o WHERE o.q_id = rec.q_id) / rec.k AS candidate_ratio, hits FROM rec JOIN rat ON rec.q_id = rat.q_id AND rec.k = rat.k)"""


def r6(name: str):
    return F.round(name, 6).alias(name)


def rank_int(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


# Exact neighbours and ground truth


@query(f"WITH {_TRUTH} SELECT q_id, rank, vec_id, round(distance, 6) AS distance FROM truth")
def exact_knn(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return rank_int(knn.exact_knn(queries_of(v), v, K)).select("q_id", "rank", "vec_id", r6("distance"))


@query(f"WITH {_TRUTH} SELECT q_id, vec_id, round(distance, 6) AS distance FROM truth WHERE rank = 1")
def exact_nn(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return knn.exact_nn(queries_of(v), v).select("q_id", "vec_id", r6("distance"))


@query(f"""WITH {_TRUTH}, named AS (SELECT q_id, first(vec_id ORDER BY rank) FILTER (rank = CASE WHEN q_id % 100 = 0 THEN 2 ELSE 1 END) AS gt, first(vec_id ORDER BY rank) FILTER (rank = 1) AS nn FROM truth GROUP BY q_id)
    SELECT count(*) AS n, avg((gt <> nn)::INTEGER) AS mismatch_rate FROM named""")
def gt_validate(spark, sf_dir):
    """Ground truth in which every second query names its second neighbour first, against the true nearest."""
    v = vectors_of(spark, sf_dir)
    q = queries_of(v)
    truth = Scratch(spark, "truth").save(knn.exact_knn(q, v, K), "t")
    first = F.when(F.col("q_id") % 100 == 0, 2).otherwise(1)
    return evaluate.gt_mismatch(truth.where(F.col("rank") == first).withColumn("rank", F.lit(1)), knn.exact_nn(q, v))


@query(f"WITH {_TRUTH} SELECT min(vec_id) AS min_id, max(vec_id) AS max_id, min(vec_id) >= 0 AND max(vec_id) < (SELECT count(*) FROM v) AS ok FROM truth")
def gt_bounds(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return evaluate.gt_in_bounds(knn.exact_knn(queries_of(v), v, K), v.count())


# Coding and index


@query(f"WITH {_V}, {_functions_sql()} SELECT t AS \"table\", d AS division, j, round(min(p), 6) AS low, round(max(p), 6) AS high FROM (SELECT t, d, j, list_inner_product(e, alpha) AS p FROM v, g) GROUP BY t, d, j")
def proj_range(spark, sf_dir):
    return coding.projection_ranges(vectors_of(spark, sf_dir), CODING).select("table", "division", "j", r6("low"), r6("high"))


@query(f"WITH {_CODES} SELECT min(omega_) AS omega_min, max(omega_) AS omega_max, round(avg(omega_), 6) AS omega_mean FROM (SELECT round(omega, 6) AS omega_ FROM w)")
def omega_stats(spark, sf_dir):
    g = coding.functions_from_sample(vectors_of(spark, sf_dir), CODING).table(spark).select(r6("omega"))
    return g.agg(F.min("omega").alias("omega_min"), F.max("omega").alias("omega_max"), F.round(F.avg("omega"), 6).alias("omega_mean"))


@query(f"WITH {_CODES} SELECT vec_id, t AS \"table\", d AS division, string_agg(h, ',' ORDER BY j) AS hashes FROM hs GROUP BY vec_id, t, d")
def hash_tables(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    h = coding.hash_tables(v, coding.functions_from_sample(v, CODING))
    return h.select("vec_id", "table", "division", F.array_join(F.col("hashes").cast("array<string>"), ",").alias("hashes"))


@query(f"WITH {_CODES} SELECT vec_id, t AS \"table\", d AS division, key FROM c")
def code_words(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return coding.encode(v, coding.functions_from_sample(v, CODING)).select("vec_id", "table", "division", "key")


@query(f"WITH {_CODES} SELECT vec_id, t AS \"table\", d AS division, substr(lpad(bin(key), 63, '0'), 1, 16) AS bits FROM c")
def code_bits(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return coding.encode(v, coding.functions_from_sample(v, CODING)).select("vec_id", "table", "division", vx.bit_string(F.col("code"), 2 * M).alias("bits"))


@query(f"WITH {_PARTS} SELECT t AS \"table\", d AS division, part_idx, vec_id FROM placed")
def partition_build(spark, sf_dir):
    return index_of(spark, sf_dir).membership.select("table", "division", "part_idx", "vec_id")


@query(f"WITH {_PARTS} SELECT t AS \"table\", d AS division, part_idx, n_ids, min_key, max_key, center_key FROM parts")
def block_reps(spark, sf_dir):
    return index_of(spark, sf_dir).partitions.select("table", "division", "part_idx", "n_ids", "min_key", "max_key", "center_key")


@query(f"""WITH {_CODES} SELECT vec_id, t AS "table", d AS division, (((sum(h * (31::HUGEINT ** ({M} - 1 - j))::HUGEINT) + {31**CODING.m}::HUGEINT + {1 << 31}) % {1 << 32} + {1 << 32}) % {1 << 32} - {1 << 31})::INTEGER AS hash FROM hs GROUP BY vec_id, t, d""")
def table_hashes(spark, sf_dir):
    """The hashes of a division as one 32-bit int."""
    v = vectors_of(spark, sf_dir)
    return coding.table_hashes(v, coding.functions_from_sample(v, CODING))


# Routing


@query(f"WITH {_NEAR} SELECT q_id, t AS \"table\", d AS division, center, range_dist FROM ctr")
def nearest_partition(spark, sf_dir):
    built, v = index_of(spark, sf_dir), vectors_of(spark, sf_dir)
    return routing.nearest_blocks(plans.tokens(queries_of(v), built, K), built.partitions)


@query(f"WITH {_PROBE} SELECT q_id, t AS \"table\", d AS division, part_idx, hamming, probe_rank FROM probe")
def probe_order(spark, sf_dir):
    built, v = index_of(spark, sf_dir), vectors_of(spark, sf_dir)
    return routing.probe_order(plans.tokens(queries_of(v), built, K), built.partitions, config_of(built).search.probes).withColumn("probe_rank", F.col("probe_rank").cast("bigint"))


@query(f"WITH {_CAND} SELECT q_id, vec_id, hamming FROM cand")
def candidates_min_score(spark, sf_dir):
    return routing.candidates(seen_of(spark, sf_dir))


@query(f"""WITH {_PROBE},
    f1 AS (SELECT *, row_number() OVER (PARTITION BY q_id, vec_id ORDER BY t, d, probe_rank) = 1 AS fresh FROM seen),
    f2 AS (SELECT q_id, t, d, probe_rank, count(*) FILTER (fresh) AS n FROM f1 GROUP BY q_id, t, d, probe_rank),
    f3 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY q_id ORDER BY t, d, probe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f2)
    SELECT q_id, vec_id, min(hamming) AS hamming FROM seen SEMI JOIN (SELECT * FROM f3 WHERE before < {CAP}) k USING (q_id, t, d, probe_rank) GROUP BY q_id, vec_id""")
def cap_prefix(spark, sf_dir):
    return routing.candidates(routing.capped(seen_of(spark, sf_dir), CAP))


@query(f"""WITH {_PROBE}, b AS (SELECT q_id, hamming, min(hamming) OVER (PARTITION BY q_id, vec_id ORDER BY t, d, probe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM seen)
    SELECT q_id, count(*) FILTER (best IS NULL OR hamming < best) AS raw_seen FROM b GROUP BY q_id""")
def raw_seen(spark, sf_dir):
    return routing.raw_seen(seen_of(spark, sf_dir))


@query(f"WITH {_CAND} SELECT q_id, vec_id, hamming, cand_rank, hamming <= {THRESHOLD} AS under FROM budget")
def hamming_prefilter(spark, sf_dir):
    out = routing.prefiltered(routing.candidates(seen_of(spark, sf_dir)), LIMIT, THRESHOLD)
    return out.withColumn("cand_rank", F.col("cand_rank").cast("bigint"))


# Refinement and evaluation


@query(f"WITH {_found()} SELECT q_id, rank, vec_id, round(distance, 6) AS distance FROM found")
def refine_topk(spark, sf_dir):
    _, _, opened = opened_of(spark, sf_dir)
    return rank_int(refine.top_k(opened.best, K)).select("q_id", "rank", "vec_id", r6("distance"))


@query(f"WITH {_found('vec_id % 7 <> 3')} SELECT q_id, rank, vec_id, round(distance, 6) AS distance FROM found")
def refine_encrypted(spark, sf_dir):
    """From the store, on mixed key versions; soft-deleted records are never opened."""
    q, built = queries_of(vectors_of(spark, sf_dir)), index_of(spark, sf_dir)
    records, ring = records_of(spark, sf_dir)
    opened = plans.scan_encrypted(q, built, config_of(built).search.probes, K, records, ring, exclude_self=True)
    return rank_int(refine.top_k(opened.best, K)).select("q_id", "rank", "vec_id", r6("distance"))


def _metrics(spark, sf_dir) -> DataFrame:
    q, v, opened = opened_of(spark, sf_dir)
    results, truth = Scratch(spark, "results"), Scratch(spark, "truth")
    return plans.metrics(results.save(refine.top_k(opened.best, K), "r"), opened.counts, truth.save(knn.exact_knn(q, v, K), "t"), q, KS)


@query(f"WITH {_found()} SELECT q_id, k, recall FROM met")
def recall_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("q_id", "k", "recall")


@query(f"WITH {_found()} SELECT q_id, k, round(distance_ratio, 6) AS distance_ratio FROM met")
def distance_ratio_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("q_id", "k", r6("distance_ratio"))


@query(f"WITH {_found()} SELECT q_id, k, candidate_ratio FROM met")
def candidate_ratio(spark, sf_dir):
    return _metrics(spark, sf_dir).select("q_id", "k", "candidate_ratio")


@query(f"WITH {_found()} SELECT k, count(*) AS queries, round(avg(recall), 6) AS mean_recall, round(avg(distance_ratio), 6) AS mean_ratio FROM met GROUP BY k")
def eval_aggregates(spark, sf_dir):
    return evaluate.summary(_metrics(spark, sf_dir)).select("k", "queries", r6("mean_recall"), r6("mean_ratio"))


@query(f"""WITH {_found()} SELECT round(avg(distance_ratio) FILTER (k = 10), 6) AS headline_ratio, round(avg(recall) FILTER (k = 10), 6) AS headline_recall, round(avg(recall), 6) AS avg_recall, round(avg(distance_ratio), 6) AS avg_ratio FROM met""")
def eval_headline(spark, sf_dir):
    out = evaluate.headline(_metrics(spark, sf_dir), 10, 10)
    return out.select(*[r6(c) for c in out.columns])


@query(f"WITH {_found()} SELECT 'run' AS label, {', '.join(f'round(avg(recall) FILTER (k = {k}), 6) AS recall_at_{k}, round(avg(distance_ratio) FILTER (k = {k}), 6) AS ratio_at_{k}' for k in KS)} FROM met")
def summary_report(spark, sf_dir):
    out = reports.summary_row("run", evaluate.summary(_metrics(spark, sf_dir)), KS)
    return out.select("label", *[r6(c) for c in out.columns if c != "label"])


@query(f"WITH {_found()} SELECT q_id, k, recall FROM met WHERE k = 10 ORDER BY recall, q_id LIMIT 5")
def worst_queries(spark, sf_dir):
    return evaluate.worst(_metrics(spark, sf_dir).where("k = 10").select("q_id", "k", "recall"), 5)


@query(f"WITH {_found()} SELECT count(*) AS queries, count(*) FILTER (hits = 0) AS zero, count(*) FILTER (hits = 0) / count(*) AS zero_rate FROM met WHERE k = 10")
def zero_hit_rate(spark, sf_dir):
    return evaluate.zero_hit_rate(_metrics(spark, sf_dir).where("k = 10").withColumn("hits", F.col("recall") * 10))


@query(f"""WITH {_found()}, a AS (SELECT q_id, count(*) AS opened FROM opened GROUP BY q_id), b AS (SELECT q_id, count(*) AS returned FROM found GROUP BY q_id)
    SELECT q_id, opened, returned, opened / {K} AS cf_k, opened / returned AS cf_returned, opened / (SELECT count(*) FROM v) AS sf FROM a JOIN b USING (q_id)""")
def topk_factors(spark, sf_dir):
    _, v, opened = opened_of(spark, sf_dir)
    return evaluate.topk_factors(opened.counts, refine.top_k(opened.best, K), v.count(), K)


@query(f"WITH {_found()} SELECT q_id, string_agg(vec_id, ';' ORDER BY rank) AS ids FROM found GROUP BY q_id")
def audit_report(spark, sf_dir):
    _, _, opened = opened_of(spark, sf_dir)
    return reports.audit_rows(refine.top_k(opened.best, K))


@query(f"WITH {_found()} SELECT DISTINCT vec_id FROM opened")
def touched_union(spark, sf_dir):
    return refine.touched(opened_of(spark, sf_dir)[2].touched)


@query(f"WITH {_found()} SELECT f.q_id, f.vec_id FROM found f SEMI JOIN truth t ON f.q_id = t.q_id AND f.vec_id = t.vec_id")
def set_intersect_ids(spark, sf_dir):
    q, v, opened = opened_of(spark, sf_dir)
    return refine.top_k(opened.best, K).select("q_id", "vec_id").intersect(knn.exact_knn(q, v, K).select("q_id", "vec_id"))


def _retried(p: str, p2: str, factor: int) -> str:
    """found of a search whose queries with too few results or opened candidates run again with p2 probes."""
    dist = "SELECT q_id, vec_id, hamming, list_distance(q.e, v.e) AS distance FROM {} JOIN q USING (q_id) JOIN v USING (vec_id)"
    return f"""{_NEAR}, {_LIM}, {_probed(p)}, {_probed(p2, "2")},
    need AS (SELECT q_id FROM q LEFT JOIN (SELECT q_id, count(*) AS n FROM cand GROUP BY q_id) USING (q_id) WHERE coalesce(n, 0) < {factor * K}),
    opened AS ({dist.format("cand")} WHERE q_id NOT IN (FROM need) UNION ALL {dist.format("cand2")} WHERE q_id IN (FROM need)),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(distance, 9), hamming, vec_id) AS rank FROM opened) WHERE rank <= {K})"""


@query(f"WITH {_retried(P, '2 * ' + P, 10)} SELECT q_id, rank, vec_id, round(distance, 6) AS distance FROM found")
def search_run(spark, sf_dir):
    """The whole search on plaintext, with retry and fallback."""
    v, built = vectors_of(spark, sf_dir), index_of(spark, sf_dir)
    results, _ = plans.search_whole(queries_of(v), built, config_of(built), K, v, exclude_self=True)
    return rank_int(results).select("q_id", "rank", "vec_id", r6("distance"))


#: One probe an order, and a second run with three for queries that open fewer than 33 k, about half of them.
RETRY = Search(refinement_limit=2**31 - 1, cap=0, max_candidates=2**31 - 1, probes=1, retry_probes=3, retry_factor=33)


@query(f"WITH {_retried('1', '3', 33)} SELECT q_id, rank, vec_id, round(distance, 6) AS distance, (SELECT count(*) FROM need)::BIGINT AS retried FROM found")
def search_retry(spark, sf_dir):
    """A search with few probes, so that many queries run again."""
    v, built = vectors_of(spark, sf_dir), index_of(spark, sf_dir)
    config = Config(CODING, RETRY, Evaluation(k_variants=KS))
    q = queries_of(v)
    results, _ = plans.search(q, built, config, K, vectors=v, exclude_self=True)
    first = plans.refine_once(q, built, RETRY, RETRY.probes, vectors=v, exclude_self=True)
    again = refine.needs_retry(first, q, K, RETRY.retry_factor).agg(F.count(F.lit(1)).alias("retried"))
    return rank_int(results).select("q_id", "rank", "vec_id", r6("distance")).join(F.broadcast(again), F.lit(True))


def _run_rows(spark, sf_dir, limit: int | None = None) -> tuple[DataFrame, Config, int]:
    v, built = vectors_of(spark, sf_dir), index_of(spark, sf_dir)
    q, config, n = queries_of(v), config_of(built), v.count()
    truth = Scratch(spark, "truth").save(knn.exact_knn(q, v, K), "t")
    return plans.run_queries(q, built, config, truth, limit, vectors=v, exclude_self=True), config, n


_ROWS = "SELECT m.q_id, m.k, recall, round(distance_ratio, 6) AS distance_ratio, candidate_ratio, k::BIGINT AS returned, n AS cand_total, n AS cand_decrypted FROM met m JOIN (SELECT q_id, count(*) AS n FROM opened GROUP BY q_id) USING (q_id)"


@query(f"WITH {_found()} {_ROWS}")
def run_queries(spark, sf_dir):
    """A metric row for each query and k, without the times."""
    rows = _run_rows(spark, sf_dir)[0].withColumn("returned", F.col("returned").cast("bigint"))
    return rows.select("q_id", "k", "recall", r6("distance_ratio"), "candidate_ratio", "returned", "cand_total", "cand_decrypted")


@query(f"WITH {_found()}, few AS (SELECT q_id FROM q ORDER BY q_id LIMIT 3) {_ROWS} SEMI JOIN few USING (q_id)")
def limit_query(spark, sf_dir):
    """The same for the first three queries."""
    rows = _run_rows(spark, sf_dir, 3)[0].withColumn("returned", F.col("returned").cast("bigint"))
    return rows.select("q_id", "k", "recall", r6("distance_ratio"), "candidate_ratio", "returned", "cand_total", "cand_decrypted")


@query(f"""WITH {_found()}, o AS (SELECT q_id, count(*) AS n FROM opened GROUP BY q_id)
    SELECT 'embeddings' AS dataset, round(avg(distance_ratio), 6) AS avg_distance_ratio, round(avg(candidate_ratio), 6) AS avg_candidate_expansion_factor, round(avg(recall), 6) AS avg_recall, round(avg(n), 6) AS avg_cand_total,
           round(avg(m.k), 6) AS avg_returned, round(avg(recall) FILTER (k = 10), 6) AS recall_at_10 FROM met m JOIN o USING (q_id)""")
def run_report(spark, sf_dir):
    """The row of the summary file, without settings and times."""
    rows, config, _ = _run_rows(spark, sf_dir)
    out = reports.run_report(rows, {"dataset": "embeddings", "profile": "default", "index_time_ms": 0}, config)
    names = ["avg_distance_ratio", "avg_candidate_expansion_factor", "avg_recall", "avg_cand_total", "avg_returned", "recall_at_10"]
    return out.select("dataset", *[r6(c) for c in names])


@query(f"""WITH {_found()}, o AS (SELECT q_id, count(*) AS n FROM opened GROUP BY q_id)
    SELECT q_id AS "QueryID", k AS "TopK", round(recall, 6) AS "Precision", n AS "CandTotal", round(n / k, 6) AS "CF_req", round(n / k, 6) AS "CF_ret", round(n / (SELECT count(*) FROM v), 6) AS "SF" FROM met JOIN o USING (q_id)""")
def top_k_report(spark, sf_dir):
    """Rows of the top-k file, without settings and times."""
    rows, _, n = _run_rows(spark, sf_dir)
    return reports.top_k_rows(rows, n).select("QueryID", "TopK", r6("Precision"), "CandTotal", r6("CF_req"), r6("CF_ret"), r6("SF"))


@query("SELECT avg(value) FILTER (value > 0) AS art_ms FROM events")
def mean_run_time(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("run_ms"))
    return evaluate.mean_run_time(rows)


@query("""SELECT event_type AS name, '[]' AS tags, count(value) AS count, round(coalesce(sum(value), 0), 4) AS "totalMs", round(coalesce(avg(value), 0), 4) AS "meanMs", coalesce(max(value), 0) AS "maxMs" FROM events GROUP BY event_type""")
def meter_report(spark, sf_dir):
    rows = reports.meter_rows(evaluate.meter_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value"))
    return rows.withColumn("totalMs", F.round("totalMs", 4)).withColumn("meanMs", F.round("meanMs", 4))


@query(f'WITH {_V} SELECT q_id, a.t::INTEGER AS "table", b.d::INTEGER AS division, 5::INTEGER AS top_k FROM q, range({CODING.tables}) a(t), range({CODING.divisions}) b(d)')
def token_derive(spark, sf_dir):
    """Tokens for k results made into tokens for five."""
    built, v = index_of(spark, sf_dir), vectors_of(spark, sf_dir)
    made = plans.query_tokens(queries_of(v), built, K)
    return plans.derive_tokens(made, 5).select("q_id", "table", "division", "top_k")


# Store, keys and maintenance

_STORE = "s AS (SELECT vec_id, (vec_id % 3 + 1)::INTEGER AS key_version, vec_id % 7 = 3 AS deleted FROM embeddings)"


@query(f"WITH {_STORE} SELECT key_version, count(*) AS n FROM s GROUP BY key_version")
def key_usage(spark, sf_dir):
    return store.key_usage(records_of(spark, sf_dir)[0])


@query(f"WITH {_TRUTH} SELECT q_id, vec_id, round(distance, 6) AS distance FROM truth WHERE rank = 1")
def query_tokens(spark, sf_dir):
    """Queries encrypted, opened again, and then searched for exactly."""
    v = vectors_of(spark, sf_dir)
    _, ring = records_of(spark, sf_dir)
    opened = crypto.decrypt_queries(crypto.encrypt_queries(queries_of(v), ring, 4), ring)
    return knn.exact_nn(opened.select("q_id", "embedding"), v).select("q_id", "vec_id", r6("distance"))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM embeddings")
def encrypt_roundtrip(spark, sf_dir):
    records, ring = records_of(spark, sf_dir)
    opened = crypto.decrypted(records, ring)
    return opened.select("vec_id", F.round(vx.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


@query(f"WITH {_STORE} SELECT CASE WHEN key_version < 4 AND NOT deleted AND vec_id % 5 = 0 THEN 4 ELSE key_version END::INTEGER AS key_version, count(*) AS n FROM s GROUP BY 1")
def key_usage_after_rotate(spark, sf_dir):
    """Every fifth id touched, keys rotated to version 4, touched live records migrated."""
    records, ring = records_of(spark, sf_dir)
    touched = records.where("vec_id % 5 = 0").select("vec_id")
    return store.key_usage(store.migrate(records, ring, 4, touched))


@query(f"WITH {_STORE} SELECT count(*) FILTER (vec_id % 5 = 0) AS touched, count(*) FILTER (vec_id % 5 = 0 AND NOT deleted) AS reencrypted FROM s")
def migrate_touched_counts(spark, sf_dir):
    records, _ = records_of(spark, sf_dir)
    touched = records.where("vec_id % 5 = 0").select("vec_id")
    return touched.agg(F.count(F.lit(1)).alias("touched")).join(store.stale(records, 4, touched).agg(F.count(F.lit(1)).alias("reencrypted")), F.lit(True))


@query(f"WITH {_STORE} SELECT vec_id, CASE WHEN deleted THEN key_version ELSE 4 END::INTEGER AS key_version, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM s JOIN embeddings USING (vec_id)")
def migrate_all(spark, sf_dir):
    records, ring = records_of(spark, sf_dir)
    opened = crypto.decrypted(Scratch(spark, "migrated").save(store.migrate(records, ring, 4), "m"), ring)
    return opened.select("vec_id", "key_version", F.round(vx.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


@query(f"WITH {_STORE}, k AS (SELECT unnest([1, 2, 3, 4])::INTEGER AS key_version) SELECT key_version, key_version < 3 AND key_version NOT IN (SELECT key_version FROM s WHERE deleted) AS retire FROM k")
def retire_eligibility(spark, sf_dir):
    """What the key service retires after migration of all live records to version 4."""
    records, ring = records_of(spark, sf_dir)
    service = keys.KeyService()
    while service.current < 4:
        service.rotate()
    used = {r["key_version"] for r in store.key_usage(store.migrate(records, ring, 4)).collect()}  # a row for each key version
    gone = service.retire(used)
    return ring.select("key_version", F.col("key_version").isin(gone).alias("retire"))


@query(f"WITH {_STORE} SELECT vec_id FROM s WHERE key_version = 2")
def filter_version(spark, sf_dir):
    return store.of_version(records_of(spark, sf_dir)[0], 2).select("vec_id")


@query(f"WITH {_STORE} SELECT vec_id, key_version, deleted FROM s WHERE vec_id = 7")
def scan_store_point(spark, sf_dir):
    return store.point(records_of(spark, sf_dir)[0], 7).select("vec_id", "key_version", "deleted")


@query("SELECT vec_id FROM embeddings")
def scan_ids(spark, sf_dir):
    return store.ids(records_of(spark, sf_dir)[0])


@query(f"WITH {_STORE} SELECT max(key_version) AS newest, 3::INTEGER AS index_version FROM s")
def detect_version(spark, sf_dir):
    """The newest version in a store and the one that its index is on."""
    held = store.Store(spark, Scratch(spark, "versions").root)
    held.commit(records_of(spark, sf_dir)[0])
    held.set_index_version(3)
    return spark.createDataFrame([(held.latest_version(), held.index_version())], "newest int, index_version int")


@query(f"WITH {_STORE} SELECT (SELECT count(*) FROM events) - count(*) AS missing FROM events JOIN s ON s.vec_id = event_id AND NOT deleted")
def missing_records(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("vec_id"))
    return store.missing(wanted, records_of(spark, sf_dir)[0])


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS a, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'kept' END AS b FROM embeddings WHERE vec_id % 4 <> 1")
def metadata_changes(spark, sf_dir):
    """Maps put whole (by 5), merged key by key (by 3) and removed (by 4)."""
    v = vectors_of(spark, sf_dir).select("vec_id")
    lit = lambda **kv: F.create_map(*[F.lit(x) for pair in kv.items() for x in pair]).alias("metadata")
    rows = store.put(v.select("vec_id", lit(a="old", b="kept")), v.where("vec_id % 5 = 0").select("vec_id", lit(a="old")))
    rows = store.remove(store.merge(rows, v.where("vec_id % 3 = 0").select("vec_id", lit(a="new"))), v.where("vec_id % 4 = 1"))
    return rows.select("vec_id", F.try_element_at("metadata", F.lit("a")).alias("a"), F.try_element_at("metadata", F.lit("b")).alias("b"))


@query(f"WITH {_PARTS.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 3 = 1 AND vec_id % 7 <> 3)', 1)} SELECT t AS \"table\", d AS division, part_idx, vec_id FROM placed")
def restore_index(spark, sf_dir):
    """An index built again from the live records of key version 2."""
    records, ring = records_of(spark, sf_dir)
    held = store.Store(spark, Scratch(spark, "restore").root)
    held.commit(records)
    service = keys.KeyService()
    service.master = MASTER
    while service.current < 4:
        service.rotate()
    return plans.rebuild_index(held, service, 2, Config(CODING)).membership.select("table", "division", "part_idx", "vec_id")


@query(f"WITH {_STORE} SELECT key_version, count(*) AS n FROM s WHERE NOT deleted AND key_version < 3 GROUP BY key_version")
def filter_stale(spark, sf_dir):
    return store.key_usage(store.stale(records_of(spark, sf_dir)[0], 3))


@query(f"WITH {_STORE} SELECT vec_id, key_version FROM s WHERE NOT deleted")
def filter_deleted(spark, sf_dir):
    return store.filter_deleted(records_of(spark, sf_dir)[0]).select("vec_id", "key_version")


@query(f"WITH {_STORE} SELECT count(*) FILTER (deleted) AS n_deleted FROM s")
def count_deleted(spark, sf_dir):
    return records_of(spark, sf_dir)[0].agg(F.count_if("deleted").alias("n_deleted"))


@query(f"WITH {_STORE} SELECT count(*) AS n FROM s WHERE key_version = 2")
def migration_remaining(spark, sf_dir):
    return store.remaining(records_of(spark, sf_dir)[0], 2)


@query(f"WITH {_STORE} SELECT 64::INTEGER AS dim, key_version, count(*) AS n, (count(*) * (12 + 64 * 8 + 16))::BIGINT AS bytes FROM s GROUP BY key_version")
def storage_by_dim(spark, sf_dir):
    return store.storage(records_of(spark, sf_dir)[0])


@query("SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, CASE WHEN b.vec_id IS NULL THEN 'metadata' ELSE 'disk' END AS side FROM (SELECT vec_id FROM embeddings WHERE label < 7) a FULL JOIN (SELECT vec_id FROM embeddings WHERE label > 2) b ON a.vec_id = b.vec_id WHERE a.vec_id IS NULL OR b.vec_id IS NULL")
def drift_full_outer(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return store.drift(v.where("label < 7"), v.where("label > 2"))


@query("SELECT vec_id FROM embeddings WHERE label < 7 EXCEPT SELECT vec_id FROM embeddings WHERE label > 2")
def set_except_ids(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return v.where("label < 7").select("vec_id").subtract(v.where("label > 2").select("vec_id"))


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 4)")
def cleanup_stale(spark, sf_dir):
    records, _ = records_of(spark, sf_dir)
    valid = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IN (1, 4)").select("vec_id")
    return store.cleanup_stale(records, valid).select("vec_id")


@query(f"WITH {_STORE} SELECT event_id AS at, event_id AS vec_id, coalesce((key_version)::VARCHAR, '') AS version FROM events LEFT JOIN s ON s.vec_id = event_id")
def multi_get(spark, sf_dir):
    records, _ = records_of(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("at"), F.col("event_id").alias("vec_id"))
    return store.multi_get(ids, records).select("at", "vec_id", F.coalesce(F.try_element_at("metadata", F.lit("version")), F.lit("")).alias("version"))


# Filters, ordinals and scalar functions


def _dirty(spark, sf_dir) -> DataFrame:
    """The vectors with nulls, short ones, and NaN and infinity put in by id."""
    e = vx.as_double("embedding")
    bad = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 11 == 1, F.slice(e, 1, 10)).when(F.col("vec_id") % 11 == 2, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan"))))).when(F.col("vec_id") % 11 == 3, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("inf"))))).otherwise(e)
    return vectors_of(spark, sf_dir).withColumn("embedding", bad)


@query("SELECT vec_id FROM embeddings WHERE vec_id % 11 > 1")
def filter_dim(spark, sf_dir):
    return vecs.with_dim(_dirty(spark, sf_dir), DIM).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 11 = 1 OR vec_id % 11 > 3")
def filter_finite(spark, sf_dir):
    return _dirty(spark, sf_dir).where(vx.is_finite(F.col("embedding"))).select("vec_id")


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS vec_id FROM embeddings QUALIFY vec_id % 11 > 1")
def assign_ordinal(spark, sf_dir):
    """Ordinals count skipped rows too."""
    rows = vecs.with_ordinals(_dirty(spark, sf_dir).withColumnRenamed("vec_id", "id"), "id")
    return vecs.with_dim(rows, DIM).select("id", "vec_id")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_min(embedding)::DOUBLE, 6) AS low, round(list_max(embedding)::DOUBLE, 6) AS high FROM embeddings")
def vector_stats(spark, sf_dir):
    e = vx.as_double("embedding")
    return vectors_of(spark, sf_dir).select("vec_id", F.round(vx.norm(e), 6).alias("norm"), F.round(F.array_min(e), 6).alias("low"), F.round(F.array_max(e), 6).alias("high"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    out = evaluate.latency_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")
    return out.select("event_type", "n", r6("mean"), r6("median"), r6("std"), "low", "high", r6("p95"))


@query("SELECT event_id, CASE WHEN value > 0 AND value * 1.2 > value * 1.1 THEN value ELSE value * 1.2 END AS server_ms FROM events")
def bounded_server_ms(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") * 1.2).alias("server_ms"), F.col("value").alias("client_ms"))
    return evaluate.bounded_server_ms(rows).select("event_id", "server_ms")


@query("SELECT event_id, event_type AS type, user_id::VARCHAR AS \"user\" FROM events")
def csv_map_parse(spark, sf_dir):
    """Maps written as escaped text and read back."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = rows.select("event_id", vx.map_to_text(F.create_map(F.lit("type=;"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))).alias("text"))
    back = made.select("event_id", vx.text_to_map(F.col("text")).alias("m"))
    return back.select("event_id", F.col("m")["type=;"].alias("type"), F.col("m")["user"].alias("user"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def numeric_text_roundtrip(spark, sf_dir):
    """Vectors as lines of decimal text, parsed again."""
    lines = vectors_of(spark, sf_dir).select("vec_id", F.array_join(vx.as_double("embedding").cast("array<string>"), ", ").alias("line"))
    back = lines.select("vec_id", vecs.numeric_rows(F.col("line")).alias("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_TRUTH} SELECT q_id, rank, vec_id FROM truth")
def ivecs_roundtrip(spark, sf_dir):
    """Ground truth written as .ivecs and read back by the data source."""
    v = vectors_of(spark, sf_dir)
    truth = knn.exact_knn(queries_of(v), v, K)
    order = queries_of(v).select("q_id").orderBy("q_id")
    path = f"{Scratch(spark, 'ivecs').root}.ivecs"
    vecs.write_ivecs(truth, path)
    read = vecs.read_truth(spark, path).withColumnRenamed("q_id", "at")
    ids = vecs.with_ordinals(order).withColumnRenamed("vec_id", "at")
    return read.join(ids, "at").select("q_id", F.col("rank").cast("bigint").alias("rank"), "vec_id")


@query()
def decoy_mix(spark, sf_dir):
    """Real queries and as many decoys of unit norm."""
    out = vecs.decoys(queries_of(vectors_of(spark, sf_dir)), 1.0, DIM, seed=5)
    return out.select("q_id", "is_decoy", F.round(vx.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {_found()} SELECT run, touched, sum(touched) OVER (ORDER BY run)::BIGINT AS total FROM (SELECT q_id AS run, count(*) AS touched FROM opened GROUP BY q_id)")
def cumulative_touched(spark, sf_dir):
    runs = opened_of(spark, sf_dir)[2].counts.select(F.col("q_id").alias("run"), F.col("n").alias("touched"))
    return reports.cumulative_touched(runs)


assert np.isfinite(CODING.omega_divisor) and set(ORACLE_SQL) <= set(QUERIES)
