"""Files, codes, keys and the store: the edge cases and properties that SQL doesn't reach."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from veilspan import queries
from veilspan.config import Coding, Config, Evaluation, Rotation, Search, load
from veilspan.functions import vectors as vx
from veilspan.operators import coding, crypto, evaluate, index, keys, knn, refine, routing, scan, store
from veilspan.operators import ranking
from veilspan.operators.keys import KeyService
from veilspan.plans import cache
from veilspan.plans import search as plans
from veilspan.sources import reports, vecs
from veilspan.streaming import ingest


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")


def cluster(spark, n=1024, dim=8, seed=42):
    return frame(spark, 5 + 0.1 * np.random.default_rng(seed).normal(size=(n, dim)))


@pytest.mark.parametrize("kind,values", [("fvecs", [1.5, 2.5, 3.5, 4.5]), ("bvecs", [0, 50, 100, 150, 200, 255]), ("ivecs", [1, 2, 3])])
def test_vecs_files(spark, tmp_path, kind, values):
    path = tmp_path / f"x.{kind}"
    one = struct.pack("<i", len(values)) + np.array(values, vecs.TYPES[kind]).tobytes()
    path.write_bytes(one * 10 + one[:6])  # the last record is cut short
    got = vecs.read_vecs(spark, str(path), partition_bytes=2 * len(one)).orderBy("ordinal").collect()
    assert [r[0] for r in got] == list(range(10)) and all(list(r[1]) == values for r in got)


@pytest.mark.parametrize("dim", [0, -10, 2_000_000])
def test_bad_lengths(spark, tmp_path, dim):
    path = tmp_path / "x.fvecs"
    path.write_bytes(struct.pack("<i", dim) + b"\0" * 16)
    with pytest.raises(PySparkException):
        vecs.read_vecs(spark, str(path)).collect()


def test_text_vectors_and_dispatch(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("﻿1, 2 3\n# note\n\nname,b\n4,5,6,,\n7 x 9\n")
    assert [list(r[0]) for r in vecs.read_any(spark, str(path)).collect()] == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(ValueError):
        vecs.read_any(spark, "x.bin")


def test_truth_roundtrip_and_errors(spark, tmp_path):
    truth = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 1, 0), (1, 2, 4)], "q_id bigint, rank int, vec_id bigint")
    path = str(tmp_path / "gt.ivecs")
    vecs.write_ivecs(truth, path)
    assert sorted(map(tuple, vecs.read_truth(spark, path).collect())) == [(0, 1, 3), (0, 2, 2), (1, 1, 0), (1, 2, 4)]
    assert [r["vec_id"] for r in vecs.truth_row(truth, 0, 1).collect()] == [3] and vecs.truth_row(truth, 9, 1).count() == 0
    (tmp_path / "empty.ivecs").write_bytes(b"")
    with pytest.raises(PySparkException):
        vecs.read_truth(spark, str(tmp_path / "empty.ivecs")).collect()


def test_require_dim(spark):
    assert vecs.require_dim(frame(spark, [[1, 2]]), 2).count() == 1
    with pytest.raises(PySparkException):
        vecs.require_dim(frame(spark, [[1, 2]]), 3).collect()


def test_wide_codes_use_several_words():
    h = np.arange(39).reshape(1, 1, 1, 39) % 7 - 3
    words = coding.code_words(h[..., :39], 2)
    assert words.shape[-1] == 2 and (words >= 0).all()
    bits = "".join(f"{w:063b}" for w in words[0, 0, 0])
    assert bits[:39] == "".join(str((x >> 1) & 1) for x in h[0, 0, 0]) and bits[39:78] == "".join(str(x & 1) for x in h[0, 0, 0])


def test_first_code_bit_is_the_top_bit_of_the_first_hash(spark):
    v = frame(spark, [[0.01 * i for i in range(128)]])
    g = coding.random_functions(Coding(m=24, lam=2, divisions=1, tables=1, seed=12345), 128)
    code = coding.encode(v, g).first()["code"]
    h = coding.hash_tables(v, g).first()["hashes"]
    assert f"{code[0]:063b}"[0] == str((h[0] >> 1) & 1)


def test_equal_codes_span_blocks_and_rankings_agree(spark, monkeypatch):
    v = frame(spark, [[1.0, 2.0]] * 150)
    c = Coding(m=4, divisions=1, tables=1, min_sample=1)
    built = index.build(v, c)
    assert sorted(r["n_ids"] for r in built.partitions.collect()) == [22, 64, 64]
    codes = coding.encode(cluster(spark, 300), coding.functions_from_sample(cluster(spark, 300), c))
    want = sorted(map(tuple, ranking.numbered(codes.drop("code"), ["table", "division"], ["key", "vec_id"], "pos", 300).collect()))
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 100)
    got = ranking.numbered(codes.drop("code"), ["table", "division"], ["key", "vec_id"], "pos", 300)
    assert sorted(map(tuple, got.select("vec_id", "table", "division", "key", "pos").collect())) == want


def greedy(ham, center, probes):
    """Grows a run of blocks towards the smaller distance, left first among equals."""
    order, left, right = [center], center - 1, center + 1
    while len(order) < probes and (left >= 0 or right < len(ham)):
        if right >= len(ham) or (left >= 0 and ham[left] <= ham[right]):
            order.append(left)
            left -= 1
        else:
            order.append(right)
            right += 1
    return order


def test_probe_order_is_greedy_growth(spark):
    rng = np.random.default_rng(0)
    ham = rng.permutation(20)
    parts = spark.createDataFrame([(0, 0, i, 64, i * 10, i * 10 + 5, i * 10, [int((1 << h) - 1)]) for i, h in enumerate(ham.tolist())], "table int, division int, part_idx bigint, n_ids bigint, min_key bigint, max_key bigint, center_key bigint, rep_code array<bigint>")
    for key, center in ((102, 10), (0, 0), (500, 19), (57, 5)):
        tokens = spark.createDataFrame([(1, 0, 0, [0], key)], "q_id bigint, table int, division int, code array<bigint>, key bigint")
        got = routing.probe_order(tokens, parts, 7).orderBy("probe_rank").collect()
        assert [r["part_idx"] for r in got] == greedy(ham, center, 7)


CFG = Config(Coding(m=4, lam=3, divisions=4, tables=2, seed=42), Search(refinement_limit=500, probes=3))


def test_more_probes_give_more_candidates_and_recall(spark):
    v = cluster(spark)
    q = v.where("vec_id < 10").select(F.col("vec_id").alias("q_id"), "embedding")
    built = index.build(v, CFG.coding)
    few, many = (plans.route(q, built, CFG.search, p).select("q_id", "vec_id") for p in (2, 6))
    assert few.subtract(many).count() == 0 and many.count() > few.count()
    results, opened = plans.search(q, built, CFG, 10, vectors=v)
    truth = knn.exact_knn(q, v, 10, exclude_self=False)
    m = plans.metrics(results, opened, truth, q, (1, 10)).toPandas()
    assert m[m.k == 10].recall.mean() > 0.5 and m[m.k == 1].distance_ratio.isna().all()  # a query is its own neighbour


def test_sample_must_be_large_enough(spark):
    with pytest.raises(ValueError):
        index.build(frame(spark, [[1.0, 2.0]]), Coding())


def test_lifecycle(spark, tmp_path):
    """Rotation, migration and retirement leave routing and answers as they were; keys in use can't go."""
    v = cluster(spark)
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("q_id"), "embedding")
    service, held = KeyService(str(tmp_path / "keys.json")), store.Store(spark, str(tmp_path / "store"))
    held.insert(v, service.table(spark), service.current)
    built = index.build(v, CFG.coding)
    built.write(str(tmp_path / "index"))
    built = index.Index.read(spark, str(tmp_path / "index"), CFG.coding.lam)

    def answer():
        results, opened = plans.search(q, built, CFG, 5, records=held.read(), key_table=service.table(spark))
        return sorted((r["q_id"], r["rank"], r["vec_id"]) for r in results.collect()), opened.select("vec_id").distinct()

    first, touched = answer()
    ids = spark.createDataFrame([(r[0],) for r in touched.collect()], "vec_id bigint")
    report = plans.migrate_touched(held, service, ids)
    assert report["reencrypted"] == report["touched"] == ids.count() and service.current == 2
    assert answer()[0] == first
    service.rotate()
    service.rotate()
    assert plans.retire(held, service) == [] and set(service.versions) == {1, 2, 3, 4}
    held.change(lambda r: store.migrate(r, service.table(spark), service.current))
    assert plans.retire(held, service) == [1, 2] and answer()[0] == first
    assert KeyService(str(tmp_path / "keys.json")).key(4) == service.key(4)
    with pytest.raises(KeyError):
        service.key(1)
    assert held.vacuum() == 2 and held.read().count() == v.count()
    hits = {r["vec_id"] for r in ids.limit(3).collect()}
    held.change(lambda r: store.soft_delete(r, ids.where(F.col("vec_id").isin(hits))))
    assert not hits & {x[2] for x in answer()[0]}
    held.change(store.hard_delete)
    assert held.read().count() == v.count() - len(hits)


def test_ciphertext_is_bound_to_its_record(spark):
    v = frame(spark, [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]])
    ring = crypto.key_table(spark, {1: crypto.derive_key(b"m" * 32, 1), 2: crypto.derive_key(b"m" * 32, 2)})
    sealed = crypto.encrypt_vectors(v, ring, 1).collect()
    assert len({bytes(r["iv"]) for r in sealed}) == 2
    records = spark.createDataFrame(sealed, "vec_id bigint, key_version int, iv binary, ct binary, dim int")
    assert [list(r["embedding"]) for r in crypto.decrypted(records, ring).orderBy("vec_id").collect()] == [[1, 2, 3], [0, 0, 0]]
    for name, value in (("vec_id", F.col("vec_id") + 7), ("key_version", F.lit(2)), ("key_version", F.lit(9))):
        assert crypto.decrypted(records.withColumn(name, value), ring).where("embedding IS NOT NULL").count() == 0
    with pytest.raises(PySparkException):
        crypto.encrypt_vectors(frame(spark, [[float("nan")]]), ring, 1).collect()


def test_rotation_policy(tmp_path):
    now = [0.0]
    service = KeyService(policy=Rotation(max_age_ms=1000), clock=lambda: now[0])
    assert not service.rotate_if_needed()
    now[0] = 2
    assert service.rotate_if_needed() and service.current == 2
    service.pin(1)
    now[0] = 9
    assert service.current == 1 and not service.rotate_if_needed()
    service.unpin()
    assert service.rotate_if_needed() and service.current == 3


def test_refinement_skips_what_it_cannot_use(spark):
    v = frame(spark, [[1.1, 2.1, 3.1], [1.2, 2.2, 3.2], [float("inf"), 0, 0]])
    q = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "q_id bigint, embedding array<double>")
    found = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 0), (0, 77, 0)], "q_id bigint, vec_id bigint, hamming bigint")
    assert [r["vec_id"] for r in refine.top_k(refine.distances(found, q, v), 10).orderBy("rank").collect()] == [0, 1]


def test_config(spark):
    text = '{"base": 1, "paper": {"m": 0, "lambda": 3}, "runtime": {"probeOverride": -1}, "profiles": [{"name": "p", "overrides": {"runtime": {"probeOverride": 9}}}]}'
    assert load(text).coding.m == 1 and load(text).search.probes == 5 and load(text, "p").search.probes == 9
    with pytest.raises(ValueError):
        load('{"runtime": {"maxGlobalCandidates": 5}}')
    with pytest.raises(KeyError):
        load("{}", "none")
    assert load("{}").digest() == Config().digest()


def test_scalar_functions(spark):
    df = spark.createDataFrame([({"a=b": "c;d\\e", "k": ""}, 'x"y,z')], "m map<string,string>, s string")
    row = df.select(vx.text_to_map(vx.map_to_text(F.col("m"))).alias("m"), vx.csv_quote(F.col("s")).alias("s"), vx.fold31(F.array(F.lit(5), F.lit(2**31 - 1)).cast("array<bigint>")).alias("f")).first()
    assert row["m"] == {"a=b": "c;d\\e", "k": ""} and row["s"] == '"x""y,z"'
    want = ((1 * 31 + 5) * 31 + 2**31 - 1) % 2**32
    assert row["f"] == (want - 2**32 if want >= 2**31 else want)


def test_reports_stay_inside(tmp_path):
    assert reports.inside(str(tmp_path), "a/b.csv").endswith("a/b.csv")
    with pytest.raises(ValueError):
        reports.inside(str(tmp_path), "../x.csv")


def test_streaming_ingest_and_background_migration(spark, tmp_path):
    v = cluster(spark, 50)
    v.unionByName(frame(spark, [[1.0]]).select((F.col("vec_id") + 900).alias("vec_id"), "embedding")).write.parquet(str(tmp_path / "in"))
    held, service = store.Store(spark, str(tmp_path / "store")), KeyService()
    ingest.ingest(spark, str(tmp_path / "in"), held, service, str(tmp_path / "cp"), 8).awaitTermination()
    assert held.read().count() == 50
    service.rotate()
    assert ingest.background_migration(held, service, 20, seed=1) == 20
    assert {r["key_version"]: r["n"] for r in store.key_usage(held.read()).collect()} == {1: 30, 2: 20}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([], "q_id bigint, embedding array<double>")
    assert knn.exact_knn(q, empty, 3).count() == 0
    assert store.Store(spark, "/tmp/none-such-store").read().count() == 0


def test_block_search_by_tree_equals_the_plain_one(spark):
    """Duplicate keys over several blocks, gaps, and queries below and above all blocks."""
    rng = np.random.default_rng(4)
    rows = []
    for t in range(2):
        keys = np.sort(rng.integers(10, 400, 300) // 7 * 7)
        rows += [(t, 0, i, int(k.min()), int(k.max())) for i, k in enumerate(np.array_split(keys, 75))]
    parts = spark.createDataFrame(rows, "table int, division int, part_idx bigint, min_key bigint, max_key bigint")
    asked = spark.createDataFrame([(q, t, 0, q) for q in range(0, 420) for t in range(2)], "q_id bigint, table int, division int, key bigint")
    plain = sorted(map(tuple, routing.nearest_blocks(asked, parts).collect()))
    for fan in (3, 16):
        assert sorted(map(tuple, routing.nearest_blocks(asked, parts, fan).collect())) == plain


def test_exact_neighbours_in_groups_with_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (200, 3)).astype(float)
    v = frame(spark, x)
    q = v.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "q_id")
    got = {}
    for r in knn.exact_knn(q, v, 5, group_bytes=24 * 30).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["vec_id"]
    for i in range(0, 200, 9):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
        want = [int(j) for j in np.lexsort((np.arange(200), d)) if j != i][:5]
        assert [got[i][k] for k in range(1, 6)] == want
    assert knn.exact_knn(q.limit(0), v, 5).count() == 0 and knn.exact_knn(q, v.limit(0), 5).count() == 0


def test_single_records_slices_and_batches(spark, tmp_path):
    path, dim = str(tmp_path / "b.fvecs"), 3
    x = np.arange(30, dtype="<f4").reshape(10, dim)
    with open(path, "wb") as f:
        for row in x:
            f.write(struct.pack("<i", dim) + row.tobytes())
    assert vecs.record_count(path) == 10
    got = {r["ordinal"]: r["embedding"] for r in vecs.read_at(spark.createDataFrame([(0,), (7,), (10,), (-1,)], "ordinal bigint"), path).collect()}
    assert got == {0: [0.0, 1.0, 2.0], 7: [21.0, 22.0, 23.0], 10: None, -1: None}
    assert vecs.slice_records(path, str(tmp_path / "few.fvecs"), 4) == 4 and vecs.read_vecs(spark, str(tmp_path / "few.fvecs")).count() == 4
    assert [len(b) for b in vecs.batches(spark.range(25), 10)] == [10, 10, 5] and list(vecs.batches(spark.range(0), 10)) == []


def test_load_queries_falls_back_limits_and_refuses_empty_files(spark, tmp_path):
    raw, empty = tmp_path / "q.raw", tmp_path / "e.fvecs"
    raw.write_bytes(b"".join(struct.pack("<i2f", 2, i, i) for i in range(6)))
    empty.write_bytes(b"")
    assert vecs.load_queries(spark, str(raw)).count() == 6
    assert [r["q_id"] for r in vecs.load_queries(spark, str(raw), 2).orderBy("q_id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        vecs.load_queries(spark, str(empty))


def test_truth_text_with_a_bad_token_is_an_error(spark, tmp_path):
    path = tmp_path / "gt.csv"
    path.write_text("# ids\n3,2,1\n\n1,x,2\n")
    with pytest.raises(PySparkException):
        vecs.read_truth(spark, str(path)).collect()
    path.write_text("3,2,1\n0,1,2\n")
    assert sorted(map(tuple, vecs.read_truth(spark, str(path)).collect()))[:3] == [(0, 1, 3), (0, 2, 2), (0, 3, 1)]


def test_tokens_are_checked(spark):
    v = cluster(spark, 128)
    q = v.where("vec_id = 0").withColumnRenamed("vec_id", "q_id")
    built = index.build(v, Coding(m=4, lam=2, divisions=1, tables=1, min_sample=1))
    assert plans.query_tokens(q, built, 3).first()["top_k"] == 3
    for bad in (lambda: plans.query_tokens(q, None, 3), lambda: plans.query_tokens(q, built, 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PySparkException):
        plans.query_tokens(q.withColumn("embedding", F.slice("embedding", 1, 3)), built, 3).collect()
    assert plans.adaptive_probes(Search(probes=3), 2.5, 6) == 6 and plans.adaptive_probes(Search(probes=3), 0.1, 6) == 3


def test_results_are_cached_by_code_version_and_k(spark):
    v = cluster(spark, 128)
    q = v.where("vec_id < 3").withColumnRenamed("vec_id", "q_id")
    built = index.build(v, Coding(m=4, lam=2, divisions=1, tables=1, min_sample=1))
    now = [0.0]
    held, ran = cache.ResultCache(ttl=10, most=2, clock=lambda: now[0]), []

    def search():
        ran.append(1)
        return plans.search(q, built, CFG, 2, vectors=v)[0]

    for version, k in ((1, 2), (1, 2), (2, 2), (1, 2)):
        assert held.get(q, built, version, k, search).count() == 6
    assert len(ran) == 2 and held.hits == 2
    now[0] = 11.0
    held.get(q, built, 1, 2, search)
    assert len(ran) == 3 and len(held.held) == 1


def test_checks_of_truth_and_hits(spark):
    truth = spark.createDataFrame([(i, 1, i) for i in range(10)], "q_id bigint, rank int, vec_id bigint")
    near = spark.createDataFrame([(i, i if i < 8 else 99) for i in range(10)], "q_id bigint, vec_id bigint")
    assert evaluate.check_truth(truth, near, 8, 0.0) == 0.0 and evaluate.check_truth(truth, near, 10, 0.2) == 0.2
    with pytest.raises(ValueError):
        evaluate.check_truth(truth, near, 10, 0.1)
    hits = spark.createDataFrame([(i, 0 if i else 1) for i in range(10)], "q_id bigint, hits bigint")
    with pytest.raises(ValueError):
        evaluate.check_zero_hits(hits)
    assert evaluate.check_zero_hits(hits.limit(3)) > 0.5


def test_decoys_jitter_and_uniform_ones(spark):
    q = frame(spark, np.eye(4)).withColumnRenamed("vec_id", "q_id")
    assert {vecs.decoy_count(100, 0.5, 0.1, s) for s in range(40)} <= set(range(45, 56)) and vecs.decoy_count(100, -1) == 0
    out = vecs.decoys(q, 2.0, 4, seed=3, uniform=True)
    norm = out.select(F.round(vx.norm(F.col("embedding")), 9).alias("n")).distinct().collect()
    assert out.where("is_decoy").count() == 8 and [r["n"] for r in norm] == [1.0]


def test_maintenance_reports_history_and_full_rotation(spark, tmp_path):
    v = cluster(spark, 60)
    held, service = store.Store(spark, str(tmp_path / "s")), KeyService(policy=Rotation(max_operations=50))
    held.insert(v, service.table(spark), 1)
    held.note_storage("before")
    service.count(60)
    assert service.rotate_if_needed() and service.current == 2 and not service.rotate_if_needed()
    report = plans.rotate_full(held, service)
    assert report["reencrypted"] == 60 and report["target"] == 3 and report["bytes_delta"] == 0 and report["bytes_after"] == 60 * (12 + 64 + 16)
    assert held.latest_version() == held.index_version() == 3 and keys.safe_to_delete(store.key_usage(held.read()), 1)
    held.note_storage("after")
    assert [(r["label"], r["key_version"], r["n"]) for r in held.storage_history().collect()] == [("before", 1, 60), ("after", 3, 60)]
    assert held.files().agg(F.sum("bytes")).first()[0] > report["bytes_after"] and set(plans.migrate_now().values()) == {0}
    row = reports.reencrypt_row(spark, report, 60).first()
    assert row["Mode"] == "end" and row["BytesAfter"] == report["bytes_after"] and row["TargetVersion"] == 3
    built = plans.rebuild_index(held, service, 3, Config(Coding(m=4, lam=2, divisions=1, tables=1, min_sample=1)))
    assert built.membership.count() == 60
    built.write(str(tmp_path / "index"))
    again, records = plans.query_only(spark, str(tmp_path / "index"), str(tmp_path / "s"), 2)
    q = v.where("vec_id = 5").withColumnRenamed("vec_id", "q_id")
    best = plans.evaluate_one(q, again, CFG, 2, records=records.read(), key_table=service.table(spark))
    assert best[0][0] == 5 and plans.evaluate_batch(q, again, CFG, 2, vectors=v).first()["ids"][0] == 5
    assert store.sharded(held.read(), 4).select("shard_id").distinct().count() <= 4


def test_listener_wiping_and_opening_without_data(spark):
    listener, ring = Observation(), crypto.key_table(spark, {1: bytes(range(32))})
    sealed = crypto.encrypt_queries(cluster(spark, 20).withColumnRenamed("vec_id", "q_id"), ring, 1)
    rows = crypto.observed(sealed, listener).collect()
    assert listener.get["encrypted"] == len(rows) == 20
    held = spark.createDataFrame(rows, sealed.schema).withColumnRenamed("enc_query", "ct")
    assert crypto.open_without_data(held, bytes(range(32))).where("embedding IS NOT NULL").count() == 20
    assert crypto.open_without_data(held, bytes(32)).where("embedding IS NOT NULL").count() == 0
    key = bytearray(b"abc")
    keys.wipe(key)
    assert key == bytes(3)


def test_null_helpers_and_ids(spark):
    rows = spark.createDataFrame([(None, 0.0, "12"), (float("nan"), 2.0, "0"), (-3.0, None, "7")], "a double, b double, t string")
    got = rows.select(vx.nz(F.col("a")), vx.coalesce_nonzero(F.col("a"), F.col("b")), vx.non_negative(F.col("a")), vx.parse_id(F.col("t"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, -3.0] and got[0][1] == 0 and got[2][2] == 0 and [r[3] for r in got] == [12, 0, 7]
    for bad in ("-1", "x", "", "99999999999"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "t string").select(vx.parse_id(F.col("t"))).collect()


def test_reports_have_their_columns_and_append(spark, tmp_path):
    ks = Config().evaluation.k_variants
    columns = reports.summary_columns(ks)
    assert len(columns) == 39 and columns[26] == "recall_at_100" and len(reports.TOP_K) == 31 and len(reports.accuracy_columns(ks)) == 28 and len(reports.cost_columns()) == 18
    v = cluster(spark, 200)
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id")
    config = Config(Coding(m=4, lam=2, divisions=2, tables=2, min_sample=1), Search(probes=4), Evaluation(k_variants=(1, 5)))
    rows = plans.run_queries(q, index.build(v, config.coding), config, knn.exact_knn(q, v, 5), vectors=v)
    report = reports.run_report(rows, {"dataset": "d", "profile": "p", "index_time_ms": 3}, config)
    for _ in range(2):
        reports.append_run(report, str(tmp_path / "out"), (1, 5))
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "summary"))
    assert back.columns == reports.summary_columns((1, 5)) and back.count() == 2 and float(back.first()["avg_art_ms"]) > 0
    assert reports.top_k_rows(rows, 200).columns == reports.TOP_K and rows.where("server_ms > 0 AND q_index >= 0").count() == 8


def test_hard_cap_holds_unless_it_is_turned_off(spark):
    v = cluster(spark, 1024)
    q = v.where("vec_id = 0").withColumnRenamed("vec_id", "q_id")
    built = index.build(v, Coding(m=4, lam=2, divisions=2, tables=2, min_sample=1))
    n = {cap: plans.route(q, built, Search(refinement_limit=10, max_candidates=100, cap=cap), 4).count() for cap in (None, 0)}
    assert 100 <= n[None] < 164 < n[0]


def listed(spark, rows, probes, c):
    """(index, queries, vectors, the opened candidates as rows, by joins)."""
    v = frame(spark, rows)
    q, built = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding"), index.build(v, c)
    return built, q, v, plans.refine_once(q, built, Search(refinement_limit=2**31 - 1, cap=0, probes=probes), probes, vectors=v, exclude_self=True)


@pytest.mark.parametrize("m", [6, 40])
def test_scan_opens_what_joins_open(spark, m):
    """Also with codes of two words, copies of a vector, and small groups; pairs are not listed."""
    rng = np.random.default_rng(m)
    x = rng.normal(size=(700, 8))
    x[300:500] = x[0]
    built, q, v, rows = listed(spark, x, 3, Coding(m=m, tables=2, divisions=2, min_sample=1))
    runs = plans.probed_runs(q, built, 3)
    found = scan.search(runs, built, q, 5, v, True, group_bytes=20_000)
    got = sorted((r["q_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in refine.top_k(found.best, 5).collect())
    assert got == sorted((r["q_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in refine.top_k(rows, 5).collect())
    assert sorted(map(tuple, found.counts.collect())) == sorted(map(tuple, evaluate.opened_counts(rows).collect()))
    ids = [r[0] for r in found.touched.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r[0] for r in refine.touched(rows).collect()}
    groups = found.table.where("q_id IS NULL").count()
    assert groups > 3 and found.table.selectExpr("max(size(ids)) FILTER (WHERE q_id IS NOT NULL)").first()[0] <= 5
    assert found.best.count() <= 5 * groups * q.count() and found.counts.agg(F.sum("n")).first()[0] > found.best.count()


def test_scan_retry_and_counts_equal_search(spark):
    v = cluster(spark, 600)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    config = Config(Coding(m=4, lam=3, divisions=2, tables=2, seed=42, min_sample=1), Search(refinement_limit=2**31 - 1, cap=0, probes=1, retry_probes=4, retry_factor=27))
    built = index.build(v, config.coding)
    results, counts = plans.search_whole(q, built, config, 8, v, exclude_self=True)
    want, opened = plans.search(q, built, config, 8, vectors=v, exclude_self=True)
    need = refine.needs_retry(plans.refine_once(q, built, config.search, 1, vectors=v, exclude_self=True), q, 8, 27).count()
    assert 0 < need and plans.uncut(config.search)
    assert sorted((r["q_id"], r["rank"], r["vec_id"]) for r in results.collect()) == sorted((r["q_id"], r["rank"], r["vec_id"]) for r in want.collect())
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, evaluate.opened_counts(opened).collect()))


def test_scan_opens_no_deleted_records(spark):
    v = cluster(spark, 300)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    built, ring = index.build(v, Coding(m=4, divisions=2, tables=2, min_sample=1)), crypto.key_table(spark, {1: b"\1" * 32})
    held = store.soft_delete(store.live(crypto.encrypt_vectors(v, ring, 1)), v.where("vec_id % 7 = 3").select("vec_id"))
    found = plans.scan_encrypted(q, built, 2, 10, held, ring)
    ids = {r[0] for r in found.touched.collect()}
    plain = plans.scan_once(q, built, 2, 10, v)
    assert ids == {r[0] for r in plain.touched.collect() if r[0] % 7 != 3} and any(r[0] % 7 == 3 for r in plain.touched.collect())


@pytest.mark.parametrize("name", ["refine_topk", "refine_encrypted", "search_run", "recall_at_k", "touched_union", "cumulative_touched"])
def test_registered_searches_list_no_pairs(spark, monkeypatch, name):
    """The join that makes a row for each query and candidate is not met."""

    def met(*_, **__):
        raise AssertionError("pairs are listed")

    for f in ("sightings", "candidates"):
        monkeypatch.setattr(routing, f, met)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
