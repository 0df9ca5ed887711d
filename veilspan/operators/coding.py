"""Projection codes: data-adaptive hash functions and bit codes of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.config import Coding
from veilspan.functions.vectors import fold31

WORD = 63


@dataclass(frozen=True)
class GFunctions:
    """alpha[t, d, j, dim], r and omega [t, d, j]."""

    alpha: np.ndarray
    r: np.ndarray
    omega: np.ndarray
    lam: int

    @property
    def dim(self) -> int:
        return self.alpha.shape[-1]

    def table(self, spark) -> DataFrame:
        """table, division, j, alpha, r, omega: the form that is kept with an index."""
        t, d, m, _ = self.alpha.shape
        rows = [(a, b, j, self.alpha[a, b, j].tolist(), float(self.r[a, b, j]), float(self.omega[a, b, j])) for a in range(t) for b in range(d) for j in range(m)]
        return spark.createDataFrame(rows, "table int, division int, j int, alpha array<double>, r double, omega double")

    @staticmethod
    def from_table(df: DataFrame, lam: int) -> GFunctions:
        rows = df.orderBy("table", "division", "j").collect()  # tables x divisions x m rows
        t, d, m = (max(r[i] for r in rows) + 1 for i in range(3))
        return GFunctions(
            np.array([r["alpha"] for r in rows]).reshape(t, d, m, -1), np.array([r["r"] for r in rows]).reshape(t, d, m), np.array([r["omega"] for r in rows]).reshape(t, d, m), lam
        )

    def stats(self) -> dict[str, float]:
        return {"omega_min": float(self.omega.min()), "omega_max": float(self.omega.max()), "omega_mean": float(self.omega.mean())}


def gauss(rng: np.random.Generator, shape) -> np.ndarray:
    """Box-Muller: sqrt(-2 ln u) cos(2 pi w)."""
    u = np.maximum(rng.random(shape), np.finfo(float).tiny)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * rng.random(shape))


def directions(c: Coding, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows alpha and offsets in [0, 1), from a seed for each table and division."""
    alpha, u = np.empty((c.tables, c.divisions, c.m, dim)), np.empty((c.tables, c.divisions, c.m))
    for t in range(c.tables):
        for d in range(c.divisions):
            rng = np.random.default_rng(c.seed + 1_000_003 * t + d)
            a = gauss(rng, (c.m, dim))
            alpha[t, d], u[t, d] = a / np.linalg.norm(a, axis=1, keepdims=True), rng.random(c.m)
    return alpha, u


def random_functions(c: Coding, dim: int, omega: float = 1.0) -> GFunctions:
    """Functions without a sample."""
    alpha, u = directions(c, dim)
    return GFunctions(alpha, u * omega, np.full(u.shape, omega), c.lam)


def first_vectors(vectors: DataFrame, c: Coding) -> np.ndarray:
    """The first sample_size vectors by id."""
    rows = vectors.orderBy("vec_id").limit(c.sample_size).select("embedding").collect()  # sample_size rows at most
    if len(rows) < c.min_sample:
        raise ValueError(f"a sample needs {c.min_sample} vectors, there are {len(rows)}")
    return np.array([r[0] for r in rows], float)


def functions_from_sample(vectors: DataFrame, c: Coding) -> GFunctions:
    """omega is the range of a row's projections over the sample, by omega_divisor; r = u omega."""
    sample = first_vectors(vectors, c)
    if not np.isfinite(sample).all():
        raise ValueError("the sample has components that are not finite")
    alpha, u = directions(c, sample.shape[1])
    p = np.einsum("nk,tdjk->tdjn", sample, alpha)
    omega = np.maximum(p.max(-1) - p.min(-1), 1e-6) / c.omega_divisor
    return GFunctions(alpha, u * omega, omega, c.lam)


def projection_ranges(vectors: DataFrame, c: Coding) -> DataFrame:
    """table, division, j, low, high of the projections over all vectors, combined per batch."""
    spark = vectors.sparkSession
    dim = vectors.selectExpr("size(embedding)").first()[0]
    alpha, _ = directions(c, dim)
    flat, shape = alpha.reshape(-1, dim), alpha.shape[:3]
    index = np.stack(np.unravel_index(np.arange(len(flat)), shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = matrix(b.column(0), dim) @ flat.T
                yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int32)) for i in index), pa.array(p.min(0)), pa.array(p.max(0))], ["table", "division", "j", "low", "high"])

    del spark
    part = vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(run, "table int, division int, j int, low double, high double")
    return part.groupBy("table", "division", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column; a row of another length is an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors must have {dim} components")
    return flat.reshape(len(column), dim)


def hashes(x: np.ndarray, g: GFunctions) -> np.ndarray:
    """floor((x . alpha + r) / omega): [n, t, d, j]."""
    p = np.stack([x @ a.T for a in g.alpha.reshape(-1, g.alpha.shape[2], g.dim)], 1).reshape(len(x), *g.r.shape)
    return np.floor((p + g.r) / g.omega).astype(np.int64)


def code_words(h: np.ndarray, lam: int) -> np.ndarray:
    """Bits i = lam-1..0 of all hashes j, most significant first, in words of 63 bits: [..., words]."""
    bits = np.concatenate([(h >> i) & 1 for i in range(lam - 1, -1, -1)], axis=-1)
    n = bits.shape[-1]
    words = np.zeros((*h.shape[:-1], -(-n // WORD)), np.int64)
    for p in range(n):
        words[..., p // WORD] |= bits[..., p] << (WORD - 1 - p % WORD)
    return words


def encode(vectors: DataFrame, g: GFunctions, id_col: str = "vec_id") -> DataFrame:
    """id, table, division, code (array of words), key (the first 63 bits) of every vector."""
    t_n, d_n = g.alpha.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = code_words(hashes(matrix(b.column(1), g.dim), g), g.lam)
            n, w = b.num_rows * t_n * d_n, words.shape[-1]
            each = t_n * d_n
            place = np.tile(np.arange(each), b.num_rows)
            code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(words.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column(0).to_numpy(), each)), pa.array((place // d_n).astype(np.int32)), pa.array((place % d_n).astype(np.int32)), code, pa.array(words[..., 0].reshape(-1))],
                [id_col, "table", "division", "code", "key"],
            )

    return vectors.select(F.col(id_col).cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(run, f"{id_col} bigint, table int, division int, code array<bigint>, key bigint")


def hash_tables(vectors: DataFrame, g: GFunctions) -> DataFrame:
    """vec_id, table, division, hashes (array of the m hashes)."""
    t_n, d_n, m = g.r.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = hashes(matrix(b.column(1), g.dim), g)
            each, n = t_n * d_n, b.num_rows * t_n * d_n
            place = np.tile(np.arange(each), b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(h.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), each)), pa.array((place // d_n).astype(np.int32)), pa.array((place % d_n).astype(np.int32)), lists], ["vec_id", "table", "division", "hashes"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, table int, division int, hashes array<bigint>")


def table_hashes(vectors: DataFrame, g: GFunctions) -> DataFrame:
    """vec_id, table, division, hash: the m hashes of a division folded to one 32-bit int, 31 h + x."""
    return hash_tables(vectors, g).select("vec_id", "table", "division", fold31(F.col("hashes")).alias("hash"))
