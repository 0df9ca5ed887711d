"""Streams into the store: ingestion by micro-batch and background migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import keys, store


def ingest(spark: SparkSession, source: str, held: store.Store, service: keys.KeyService, checkpoint: str, dim: int):
    """Reads new parquet files of vec_id, embedding; each micro-batch is filtered, encrypted and committed."""

    def batch(rows: DataFrame, _: int) -> None:
        service.rotate_if_needed()
        good = rows.where(F.size("embedding") == dim)
        held.insert(good, service.table(spark), service.current)
        service.count(good.count())

    stream = spark.readStream.schema("vec_id bigint, embedding array<double>").parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def background_migration(held: store.Store, service: keys.KeyService, sample: int = 2000, seed: int | None = None) -> int:
    """One round: re-encrypts up to ``sample`` random records below the current version; returns how many."""
    due = store.stale(held.read(), service.current).select("vec_id")
    picked = due.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(sample)
    ids = [r[0] for r in picked.collect()]  # sample rows at most
    if ids:
        chosen = held.spark.createDataFrame([(i,) for i in ids], "vec_id bigint")
        held.change(lambda r: store.migrate(r, service.table(held.spark), service.current, chosen))
    return len(ids)
