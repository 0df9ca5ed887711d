"""Encryption as columns: AES-256-GCM by Spark's own functions, keys by HMAC on the driver.

A key reaches the executors as a column of a small table, never as a literal of a plan. Associated data
bind a ciphertext to its id, key version and dimension.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.vectors import is_finite, pack, unpack


def derive_key(master: bytes, version: int) -> bytes:
    """HMAC-SHA256 of the version as a big-endian int32."""
    return hmac.new(master, version.to_bytes(4, "big"), hashlib.sha256).digest()


def new_master() -> bytes:
    return secrets.token_bytes(32)


def _fresh(ids: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(12) for _ in range(len(ids))])


def fresh_iv(any_col: Column) -> Column:
    """12 random bytes for each row; not deterministic, so write the result once."""
    return F.pandas_udf(_fresh, "binary").asNondeterministic()(any_col)


#: The labels inside the associated data.
def associated(vec_id: Column, version: Column, dim: Column) -> Column:
    return F.concat(F.lit("id:"), vec_id.cast("string"), F.lit("|v:"), version.cast("string"), F.lit("|d:"), dim.cast("string")).cast("binary")


def key_table(spark: SparkSession, keys: dict[int, bytes]) -> DataFrame:
    return spark.createDataFrame([(v, bytearray(k)) for v, k in sorted(keys.items())], "key_version int, key binary")


def encrypt_vectors(vectors: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """vec_id, key_version, iv, ct (ciphertext and tag), dim. Vectors must be finite and not empty."""
    key = keys.where(F.col("key_version") == version)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("key_version", F.lit(version))
    checked = F.when(is_finite(F.col("v")) & (F.size("v") > 0), F.col("v")).otherwise(F.raise_error(F.lit("a vector is empty or not finite")).cast("array<double>"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("iv", fresh_iv(F.col("vec_id"))).withColumn("raw", pack(checked))
    rows = rows.join(F.broadcast(key), "key_version")  # one row
    sealed = F.aes_encrypt("raw", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("iv"), associated(F.col("vec_id"), F.col("key_version"), F.col("dim")))
    return rows.select("vec_id", "key_version", "iv", F.substring(sealed, 13, 2**31 - 1).alias("ct"), "dim")


def decrypted(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds embedding; null where the key is missing or the record doesn't open."""
    opened = F.try_aes_decrypt(F.concat("iv", "ct"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), associated(F.col("vec_id"), F.col("key_version"), F.col("dim")))
    rows = records.join(F.broadcast(keys), "key_version", "left")  # a row for each live key
    return rows.withColumn("embedding", unpack(opened)).drop("key")


def encrypt_queries(queries: DataFrame, keys: DataFrame, version: int) -> DataFrame:
    """q_id, key_version, iv, enc_query: without associated data."""
    key = keys.where(F.col("key_version") == version)
    rows = queries.select("q_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("key_version", F.lit(version)).withColumn("iv", fresh_iv(F.col("q_id")))
    rows = rows.withColumn("raw", pack("v")).join(F.broadcast(key), "key_version")
    return rows.select("q_id", "key_version", "iv", F.substring(F.aes_encrypt("raw", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("iv")), 13, 2**31 - 1).alias("enc_query"))


def decrypt_queries(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    rows = tokens.join(F.broadcast(keys), "key_version", "left")
    return rows.withColumn("embedding", unpack(F.try_aes_decrypt(F.concat("iv", "enc_query"), F.col("key"), F.lit("GCM")))).drop("key")


def open_without_data(rows: DataFrame, key: bytes) -> DataFrame:
    """iv, ct opened by one key and without associated data: adds embedding, null where that fails."""
    one = rows.sparkSession.createDataFrame([(bytearray(key),)], "key binary")
    opened = F.try_aes_decrypt(F.concat("iv", "ct"), F.col("key"), F.lit("GCM"))
    return rows.join(F.broadcast(one), F.lit(True)).withColumn("embedding", unpack(opened)).drop("key")  # one key


def observed(rows: DataFrame, listener: Observation) -> DataFrame:
    """The rows, whose number an action reports to the listener as ``encrypted``: no callback runs in a task."""
    return rows.observe(listener, F.count(F.lit(1)).alias("encrypted"))
