"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract, and a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove shuffle files of the jobs that have ended."""
        self.spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Gives freed memory of this worker back to the system: workers live on between stages, and so does what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, for mapInArrow, with its memory released at the end of a partition."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def repeats(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether any doc_id is null or occurs twice; ids are counted on the map side first."""
    ids = docs.select(docs[id_col].cast("bigint").alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    return not ids.where("_n > 1 OR _id IS NULL").isEmpty()


def numbered(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, doc_id, text, with doc telling all rows apart in the order of doc_id, null last.

    doc is doc_id itself where that does; otherwise rows are numbered once, in a table, as numbers don't outlive a rerun.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    if not repeats(docs, id_col):
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    return scratch.save(rows.orderBy(F.asc_nulls_last("doc_id"), "text").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "rows")
