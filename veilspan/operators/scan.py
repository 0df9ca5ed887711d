"""Whole searches without lists of candidates: groups of vectors that the queries stream past.

A search that opens all candidates of a fixed share of the blocks has as many pairs of query and candidate as that
share of all pairs. They are told, opened and counted in arrays, and only the best of each query and group, its number of
candidates and the ids that anything opened leave a task. Blocks that a query probes lie side by side in their order, so
a query is known by a first and a last block and its code for each order, and a vector by its blocks and their codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.vectors import is_finite
from veilspan.operators.coding import matrix
from veilspan.operators.index import Index
from veilspan.operators.knn import GROUP_BYTES
from veilspan.scratch import Scratch

#: More than any Hamming distance: not in a probed block.
FAR = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Found:
    """What a search opened, as one table: a row for each query and group, and one without q_id for the ids that a group opened."""

    table: DataFrame  # q_id, n, ids, hammings, distances

    @property
    def best(self) -> DataFrame:
        """q_id, vec_id, hamming, distance: the k best of every group, which hold the k best of all."""
        rows = self.table.where("q_id IS NOT NULL").select("q_id", F.explode(F.arrays_zip("ids", "hammings", "distances")).alias("x"))
        return rows.select("q_id", F.col("x.ids").alias("vec_id"), F.col("x.hammings").alias("hamming"), F.col("x.distances").alias("distance"))

    @property
    def counts(self) -> DataFrame:
        """q_id, n: how many candidates a query opened; queries without any have no row."""
        return self.table.where("q_id IS NOT NULL").groupBy("q_id").agg(F.sum("n").alias("n"))

    @property
    def touched(self) -> DataFrame:
        """vec_id of all that any query opened; each id is in one group."""
        return self.table.where("q_id IS NULL").select(F.explode("ids").alias("vec_id"))


class Group:
    """Vectors with their blocks and the codes of these, by order."""

    def __init__(self, slots: int, words: int):
        self.slots, self.words, self.rows = slots, words, []

    def add(self, ids, sizes, slot, part, code, x) -> None:
        self.rows.append((ids, sizes, slot, part, code, x))

    def build(self) -> None:
        self.ids, sizes, slot, part, code, x = (None if c[0] is None else np.concatenate(c) for c in zip(*self.rows))
        self.rows, self.x, n = [], x, len(sizes)
        row = np.repeat(np.arange(n), sizes)
        # Rows of an id that occurs more than once have as many blocks in an order: the first of each, the second of each, and so on.
        cell = row * self.slots + slot
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        nth = np.arange(len(cell)) - np.repeat(first, np.diff(np.r_[first, len(cell)]))
        deep = int(nth.max()) + 1
        self.of = np.tile(np.arange(self.slots), deep)
        self.part, self.code = np.full((self.slots * deep, n), -1, np.int64), np.zeros((self.slots * deep, self.words, n), np.int64)
        self.part[nth * self.slots + slot, row] = part
        self.code[nth * self.slots + slot, :, row] = code
        self.touched = np.zeros(n, bool)

    def hammings(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The least distance over the probed blocks that hold a vector, FAR if none does."""
        inside = (self.part >= low[self.of, None]) & (self.part <= high[self.of, None])
        far = np.bitwise_count(self.code ^ code[self.of, :, None])
        return np.where(inside, far.sum(1, dtype=np.int32), FAR).min(0)

    def ask(self, own: int | None, low, high, code, q: np.ndarray | None, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The number of opened vectors, and ids, Hamming and exact distances of the k best by (distance rounded to 9 digits, hamming, id)."""
        ham = self.hammings(low, high, code)
        seen = ham < FAR
        if own is not None:
            seen &= self.ids != own
        self.touched |= seen
        at = np.flatnonzero(seen)
        if q is None or not len(at):
            return len(at), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        y = self.x[at] - q
        d = np.sqrt(np.einsum("ij,ij->i", y, y))
        near = np.round(d, 9)
        keep = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1]) if len(at) > k else np.arange(len(at))
        keep = keep[np.lexsort((self.ids[at[keep]], ham[at[keep]], near[keep]))[:k]]
        return len(at), self.ids[at[keep]], ham[at[keep]].astype(np.int64), d[keep]


def runs(tokens: DataFrame, probed: DataFrame) -> DataFrame:
    """q_id, table, division, low, high, code: the probed blocks of routing.probe_order, which are a run in each order."""
    td = ["table", "division"]
    ends = probed.groupBy("q_id", *td).agg(F.min("part_idx").alias("low"), F.max("part_idx").alias("high"))
    return ends.join(tokens.select("q_id", *td, "code"), ["q_id", *td])


def search(probed: DataFrame, index: Index, queries: DataFrame, k: int, vectors: DataFrame | None = None, exclude_self: bool = False, group_bytes: int = GROUP_BYTES) -> Found:
    """Every candidate of the probed blocks (as runs), opened and ranked; without vectors they are only counted and named.

    Vectors that are not finite are left out. Vectors are dealt by a hash of their id into groups of at most group_bytes
    on average; a task holds one group at a time, and never all queries.
    """
    spark = queries.sparkSession
    divisions, dim = index.functions.alpha.shape[1], index.functions.dim if vectors is not None else 0
    slots, words = index.functions.alpha.shape[0] * divisions, -(-index.functions.alpha.shape[2] * index.functions.lam // 63)
    slot, td = (F.col("table") * divisions + F.col("division")).alias("slot"), ["table", "division"]
    n = index.partitions.where("table = 0 AND division = 0").agg(F.coalesce(F.sum("n_ids"), F.lit(0))).first()[0]
    groups = max(1, -(-n * 8 * (dim + slots * (1 + words)) // group_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024))

    def listed(rows: DataFrame, key: str, first: str, last: str, code: str) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct(slot, F.col(first).alias("low"), F.col(last).alias("high"), F.col(code).alias("code"))))  # a row for each order
        made = rows.groupBy(F.col(key).cast("bigint").alias("id")).agg(each.alias("a"))
        return made.select("id", F.col("a.slot").alias("slot"), F.col("a.low").alias("low"), F.col("a.high").alias("high"), F.flatten("a.code").alias("code"))

    asking = listed(probed, "q_id", "low", "high", "code")
    held = listed(index.membership.join(index.partitions.select(*td, "part_idx", "rep_code"), [*td, "part_idx"]), "vec_id", "part_idx", "part_idx", "rep_code")
    if vectors is None:
        none = F.lit(None).cast("array<double>").alias("e")
        asking, held = asking.withColumn("e", none), held.withColumn("e", none)
    else:
        e = F.col("embedding").cast("array<double>").alias("e")
        asking = asking.join(queries.select(F.col("q_id").cast("bigint").alias("id"), e), "id")
        held = held.join(vectors.select(F.col("vec_id").cast("bigint").alias("id"), e).where(is_finite(F.col("e"))), "id")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    rows = ["id", "slot", "low", "high", "code", "e"]
    both = held.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), *rows).unionByName(asking.select(every.alias("g"), F.lit(True).alias("asks"), *rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, ready = None, None, False

        def batch(out: list[tuple]) -> pa.RecordBatch:
            q, n, *lists = zip(*out)
            ends = np.r_[0, np.cumsum([len(x) for x in lists[0]])].astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(c))) for c in lists]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int64()), *made], ["q_id", "n", "ids", "hammings", "distances"])

        def opened() -> list[tuple]:
            ids = group.ids[group.touched] if ready else np.zeros(0, np.int64)
            return [(None, None, ids, np.zeros(len(ids), np.int64), np.zeros(len(ids)))] if len(ids) else []

        for b in batches:
            if not b.num_rows:
                continue
            g, asks, ids = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            sizes = b.column(3).value_lengths().to_numpy()
            slot_, low, high = (b.column(i).flatten().to_numpy() for i in (3, 4, 5))
            code = b.column(6).flatten().to_numpy().reshape(-1, words)
            x = matrix(b.column(7), dim) if dim else None
            ends, out = np.r_[0, np.cumsum(sizes)], []
            cuts = np.r_[np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (asks[1:] != asks[:-1])]), len(g)].tolist()
            for s, e in zip(cuts[:-1], cuts[1:]):
                if group is None or g[s] != at:
                    out += opened()
                    group, at, ready = Group(slots, words), g[s], False
                a, z = ends[s], ends[e]
                if not asks[s]:
                    group.add(ids[s:e].copy(), sizes[s:e].copy(), slot_[a:z].copy(), low[a:z].copy(), code[a:z].copy(), None if x is None else x[s:e].copy())
                    continue
                if not ready and group.rows:
                    group.build()
                    ready = True
                if not ready:
                    continue  # no vectors in this group
                for i in range(s, e):
                    mine, a, z = np.zeros((slots, words), np.int64), ends[i], ends[i + 1]
                    first, last = np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
                    first[slot_[a:z]], last[slot_[a:z]], mine[slot_[a:z]] = low[a:z], high[a:z], code[a:z]
                    got = group.ask(ids[i] if exclude_self else None, first, last, mine, None if x is None else x[i], k)
                    if got[0]:
                        out.append((ids[i], *got))
            if out:
                yield batch(out)
        if out := opened():
            yield batch(out)

    found = both.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "asks").mapInArrow(run, "q_id bigint, n bigint, ids array<bigint>, hammings array<bigint>, distances array<double>")
    return Found(Scratch(spark, "scan").save(found, "found"))
