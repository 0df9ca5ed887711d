"""The record store: encrypted vectors with key versions and deletion marks, kept as immutable snapshots.

A change writes a new folder and then moves a one-line pointer file, so a failed job leaves the last
snapshot valid, and record and version can't part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import crypto

SCHEMA = "vec_id bigint, key_version int, iv binary, ct binary, dim int, deleted boolean, deleted_at timestamp"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def snapshot(self) -> str | None:
        fs, path, jvm = self._fs()
        if not fs.exists(path):
            return None
        source = fs.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").strip()
        finally:
            source.close()

    def read(self) -> DataFrame:
        name = self.snapshot()
        return self.spark.createDataFrame([], SCHEMA) if name is None else self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")

    def commit(self, records: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.partitionBy("key_version").parquet(f"{self.path}/{name}")
        fs, path, jvm = self._fs()
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT.part")
        out = fs.create(part, True)
        out.write(name.encode())
        out.close()
        fs.delete(path, False)
        fs.rename(part, path)

    def insert(self, vectors: DataFrame, keys: DataFrame, version: int) -> None:
        """Adds vectors; a record of the same id is replaced."""
        new = live(crypto.encrypt_vectors(vectors, keys, version))
        old = self.read()
        self.commit(old.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new) if self.snapshot() else new)

    def change(self, how: Callable[[DataFrame], DataFrame]) -> None:
        self.commit(how(self.read()))

    def latest_version(self) -> int | None:
        """The highest key version that any record is on, from the folders' names."""
        return self.read().agg(F.max("key_version")).first()[0]

    def set_index_version(self, version: int) -> None:
        self.spark.createDataFrame([("index", version)], "name string, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index-version")

    def index_version(self) -> int | None:
        """The key version that the index was built on; None before the first build."""
        fs, path, jvm = self._fs()
        at = f"{self.path}/index-version"
        row = self.spark.read.parquet(at).where("name = 'index'").first() if fs.exists(jvm.org.apache.hadoop.fs.Path(at)) else None
        return row["version"] if row else None

    def note_storage(self, label: str) -> None:
        """Appends the sizes of now, by dimension and key version, to the store's history."""
        now = storage(self.read()).select(F.lit(label).alias("label"), F.current_timestamp().alias("at"), "*")
        now.coalesce(1).write.mode("append").parquet(f"{self.path}/history")

    def storage_history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/history").orderBy("at", "dim", "key_version")

    def files(self) -> DataFrame:
        """path, bytes of the files of the present snapshot."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.path}/{self.snapshot()}")
        return listed.select("path", F.col("length").alias("bytes"))

    def vacuum(self, keep: int = 0) -> int:
        """Removes superseded snapshots but the newest ``keep``; returns how many."""
        fs, path, jvm = self._fs()
        now = self.snapshot()
        old = sorted((s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() != now), key=lambda s: -s.getModificationTime())
        for s in old[keep:]:
            fs.delete(s.getPath(), True)
        return len(old[keep:])


def live(records: DataFrame) -> DataFrame:
    return records.withColumn("deleted", F.lit(False)).withColumn("deleted_at", F.lit(None).cast("timestamp"))


def soft_delete(records: DataFrame, ids: DataFrame, at=None) -> DataFrame:
    """Marks records; their versions stay."""
    mark = ids.select("vec_id", F.lit(True).alias("_gone")).distinct()
    at = F.current_timestamp() if at is None else at
    both = records.join(mark, "vec_id", "left")
    return both.withColumn("deleted_at", F.when(F.col("_gone") & ~F.col("deleted"), at).otherwise(F.col("deleted_at"))).withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def hard_delete(records: DataFrame) -> DataFrame:
    return records.where(~F.col("deleted"))


def filter_deleted(records: DataFrame) -> DataFrame:
    return records.where(~F.col("deleted"))


def cleanup_stale(records: DataFrame, valid: DataFrame) -> DataFrame:
    return records.join(valid.select("vec_id").distinct(), "vec_id", "left_semi")


def point(records: DataFrame, vec_id: int) -> DataFrame:
    """The record of an id; no row if there is none."""
    return records.where(F.col("vec_id") == vec_id)


def ids(records: DataFrame) -> DataFrame:
    return records.select("vec_id")


def of_version(records: DataFrame, version: int) -> DataFrame:
    """Records on one key version; the folders of others are not read."""
    return records.where(F.col("key_version") == version)


def missing(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """One row: how many of the wanted ids have no live record."""
    live_ids = records.where(~F.col("deleted")).select("vec_id")
    return wanted.select("vec_id").distinct().join(live_ids, "vec_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


def sharded(records: DataFrame, shards: int) -> DataFrame:
    """Records with their shard, by a hash of the id, dealt into as many partitions."""
    return records.withColumn("shard_id", F.abs(F.hash("vec_id").cast("bigint") % shards).cast("int")).repartition(shards, "shard_id")


def put(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """metadata (vec_id, metadata map) with rows in place of those of the same id."""
    return metadata.join(rows.select("vec_id"), "vec_id", "left_anti").unionByName(rows.select("vec_id", "metadata"))


def merge(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """The same, but keys that the new map doesn't have stay."""
    new = rows.select("vec_id", F.col("metadata").alias("_new"))
    both = metadata.join(new, "vec_id", "full_outer")
    old = F.map_filter("metadata", lambda k, _: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    joined = F.when(F.col("_new").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("_new")).otherwise(F.map_concat(old, "_new"))
    return both.select("vec_id", joined.alias("metadata"))


def remove(metadata: DataFrame, gone: DataFrame) -> DataFrame:
    return metadata.join(gone.select("vec_id").distinct(), "vec_id", "left_anti")


def key_usage(records: DataFrame) -> DataFrame:
    return records.groupBy("key_version").agg(F.count(F.lit(1)).alias("n"))


def remaining(records: DataFrame, version: int) -> DataFrame:
    return records.where(F.col("key_version") == version).agg(F.count(F.lit(1)).alias("n"))


def stale(records: DataFrame, target: int, touched: DataFrame | None = None) -> DataFrame:
    """Records to migrate: live, below the target version and, if given, touched."""
    rows = records.where((F.col("key_version") < target) & ~F.col("deleted"))
    return rows if touched is None else rows.join(touched.select("vec_id").distinct(), "vec_id", "left_semi")


def migrate(records: DataFrame, keys: DataFrame, target: int, touched: DataFrame | None = None) -> DataFrame:
    """The store after re-encryption of stale (touched) records; records that don't open stay as they are."""
    due = crypto.decrypted(stale(records, target, touched), keys).where("embedding IS NOT NULL")
    kept = ["deleted", "deleted_at"]
    marks = due.select("vec_id", *kept)
    # The new records are used twice below, and their IVs are drawn anew in every run: write the result once.
    new = crypto.encrypt_vectors(due.select("vec_id", "embedding"), keys, target).join(marks, "vec_id")
    return records.join(due.select("vec_id"), "vec_id", "left_anti").unionByName(new.select(*records.columns))


def storage(records: DataFrame) -> DataFrame:
    """dim, key_version, n, bytes."""
    return records.groupBy("dim", "key_version").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("iv") + F.octet_length("ct")).alias("bytes"))


def drift(metadata: DataFrame, disk: DataFrame) -> DataFrame:
    """vec_id, side: ids of only one side."""
    a, b = metadata.select("vec_id").distinct().withColumn("_a", F.lit(1)), disk.select("vec_id").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, "vec_id", "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select("vec_id", F.when(F.col("_b").isNull(), "metadata").otherwise("disk").alias("side"))


def multi_get(ids: DataFrame, records: DataFrame) -> DataFrame:
    """ids (at, vec_id) with their records' metadata as a map, empty if missing, in order of at."""
    meta = F.create_map(F.lit("version"), F.col("key_version").cast("string"), F.lit("dim"), F.col("dim").cast("string"), F.lit("deleted"), F.col("deleted").cast("string"))
    found = records.select("vec_id", meta.alias("metadata"))
    return ids.join(found, "vec_id", "left").select("at", "vec_id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata")).orderBy("at")
