"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes tables to spark.checkpoint.dir (a new local folder only where that is unset)."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = tempfile.mkdtemp(prefix="veilspan-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
