"""A cache of search results: tables of whole batches, by what decides them."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.index import Index
from veilspan.plans.search import tokens
from veilspan.scratch import Scratch


class ResultCache:
    """Keeps at most ``most`` results for ``ttl`` seconds; the least recently used goes first.

    The key is the index's key version, the dimension, k and a hash of the queries' ids and codes, so queries of equal
    codes share an entry, and a rotation makes all entries stale. Results are tables in the shared folder.
    """

    def __init__(self, ttl: float = 600.0, most: int = 1000, clock: Callable[[], float] = time.time):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.held: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()
        self.hits = 0

    @staticmethod
    def key(queries: DataFrame, index: Index, version: int, k: int) -> tuple:
        codes = F.xxhash64("q_id", "table", "division", "code").cast("decimal(38,0)")
        row = tokens(queries, index, k).agg(F.count(F.lit(1)).alias("n"), F.sum(codes).alias("h")).first()
        return version, index.functions.dim, k, row["n"], str(row["h"])

    def get(self, queries: DataFrame, index: Index, version: int, k: int, search: Callable[[], DataFrame]) -> DataFrame:
        key, now = self.key(queries, index, version, k), self.clock()
        for old in [x for x, (at, _) in self.held.items() if now - at >= self.ttl]:
            del self.held[old]
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        found = Scratch(queries.sparkSession, "cache").save(search(), "results")
        self.held[key] = (now, found)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return found
