"""Suffix-array deduplication: removes every byte of a string of ``length`` bytes that starts twice or more.

Suffix arrays are sparse. Of the gear hashes inside each window of ``length`` bytes, the least of the first
``spread`` (the leftmost of equals) marks the window's suffix; equal windows have the same mark, so a match of ``length``
bytes always shares a mark. An entry of a suffix array is the range of window starts that one mark owns,
with two prints: ``k``, of the suffix up to the end of the shortest of these windows (its first three bytes,
then 40 bits of hash, so entries sort as suffixes do), and ``u``, of all bytes that the range's windows cover.

The index is a logarithmic family. A batch of documents gets a suffix array of its own, sorted by ``k``
with counts of equal entries; it is merge-scanned with the levels there are, and levels of equal size merge,
so n batches cost log n merges. In the merged levels an entry with an unmatched ``k`` has no match in any
window; one with a matched ``u`` has a match in all of them. What lies between is an end of a match: its
range is cut into blocks of ``block`` starts, indexed the same way, and then into single windows.

Texts are UTF-8 bytes and matches never cross documents. ``k`` and ``u`` count together (104 bits), single
windows by 128 bits.

Defined cases: null text counts as empty; texts shorter than ``length`` keep all bytes; copies lose all
bytes if long enough, as every string of theirs starts elsewhere; repeated rows are documents of their own, told
apart by a row number; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Scratch, numbered, tidy
from veilspan.llm.rolling import HISTORY, Prints, gear, mix64, scramble, sliding_min

_ENTRY = ["k", "u"]


def owners(raw: np.ndarray, length: int, spread: int) -> np.ndarray:
    """The mark of the window that starts at each byte: a place in the text."""
    order = scramble(gear(raw))[HISTORY - 1 :]
    keyed = (order.astype(np.uint64) << np.uint64(32)) | np.arange(len(order), dtype=np.uint64)
    least = sliding_min(keyed, spread)[: len(raw) - length + 1]
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # where the history of the mark starts


def ranges(raw: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, ...]:
    """first, last (window starts of one mark), mark."""
    own = owners(raw, length, spread)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return first, np.r_[first[1:], len(own)] - 1, own[first]


def _suffix_key(raw: np.ndarray, start: np.ndarray, h: np.ndarray) -> np.ndarray:
    head = (raw[start].astype(np.uint64) << np.uint64(16)) | (raw[start + 1].astype(np.uint64) << np.uint64(8)) | raw[start + 2]
    return (head << np.uint64(40)) | (h >> np.uint64(24))


def entries(raw: np.ndarray, length: int, spread: int):
    """first, last, mark, k, u of all ranges of a text."""
    first, last, mark = ranges(raw, length, spread)
    prints = Prints(raw)
    k = _suffix_key(raw, mark, prints.of(mark, mark - spread + 1 + length, 0))
    shape = ((mark - first) << 20 | (last - first)).astype(np.uint64)
    return first, last, mark, k, mix64(prints.of(first, last + length, 1) + shape * np.uint64(0x9E3779B97F4A7C15))


def blocks(raw: np.ndarray, prints: Prints, first: int, last: int, mark: int, length: int, block: int):
    """The same for blocks of starts, which lie at fixed distances from the mark."""
    q = np.arange((mark - last) // block, (mark - first) // block + 1)
    high, low = mark - q * block, mark - q * block - block + 1
    k = _suffix_key(raw, high, prints.of(high, low + length, 0))
    a, b = np.maximum(low, first), np.minimum(high, last)
    shape = ((mark - a) << 20 | (b - a)).astype(np.uint64)
    return a, b, k, mix64(prints.of(a, b + length, 1) + shape * np.uint64(0x9E3779B97F4A7C15))


class IndexFamily:
    """Levels of merged suffix arrays: each holds entries (k, u, n) sorted by k, n counting occurrences."""

    def __init__(self, scratch: Scratch, name: str):
        self.scratch, self.name, self.levels, self.made = scratch, name, [], 0

    def add(self, batch: DataFrame, batches: int = 1) -> None:
        new, size, old = batch.groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("n")), batches, []
        while self.levels and self.levels[-1][0] <= size:
            held, level, path = self.levels.pop()
            size, new = size + held, self.merge(new, level)
            old.append(path)
        path = f"{self.name}{self.made}"
        self.made += 1
        self.levels.append((size, self.scratch.save(new.sortWithinPartitions(*_ENTRY), path), path))
        for gone in old:
            self.scratch.drop(gone)

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy(*_ENTRY).agg(F.sum("n").alias("n"))

    def matched(self) -> DataFrame:
        """k, u, whole, mixed: entries whose k occurs twice or more; whole: u does too; mixed: not every u with k."""
        levels = [level for _, level, _ in self.levels]
        every = levels[0]
        for level in levels[1:]:
            every = self.merge(every, level)
        twice = every.groupBy("k").agg(F.sum("n").alias("_k"), F.min("n").alias("_least")).where("_k > 1")
        return every.join(twice, "k").select("k", "u", (F.col("n") > 1).alias("whole"), (F.col("_least") == 1).alias("mixed"))


def _mapped(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.mapInArrow(tidy(run), schema)


def _out(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, schema)], schema=schema)


_RANGE = pa.schema([("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("mark", pa.int32()), ("k", pa.int64()), ("u", pa.int64())])
_SPAN = "doc bigint, first int, last int, mark int, k bigint, u bigint"


def _scan(rows: DataFrame, length: int, spread: int) -> DataFrame:
    """A range entry for each mark of each document that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = [[] for _ in _RANGE], 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = np.frombuffer(t.as_py().encode("utf-8", "replace"), np.uint8)
                if len(raw) < length:
                    continue
                first, last, mark, k, u = entries(raw, length, spread)
                for c, v in zip(cols, (np.full(len(first), doc), first, last, mark, k.view(np.int64), u.view(np.int64))):
                    c.append(v)
                held += len(first)
                if held > 100_000:
                    yield _out(cols, _RANGE)
                    cols, held = [[] for _ in _RANGE], 0
        if held:
            yield _out(cols, _RANGE)

    return _mapped(rows, run, _SPAN)


def _refine(texts: DataFrame, length: int, block: int) -> DataFrame:
    """Entries for parts of unsettled spans: blocks of starts, or single windows if block is 1.

    texts: doc, text, spans (array of first, last, mark).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = [[] for _ in _RANGE], 0
        for b in batches:
            for doc, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = np.frombuffer(t.as_py().encode("utf-8", "replace"), np.uint8)
                prints = Prints(raw)
                for s in spans.as_py():
                    if block > 1:
                        a, e, k, u = blocks(raw, prints, s["first"], s["last"], s["mark"], length, block)
                    else:
                        a = e = np.arange(s["first"], s["last"] + 1)
                        k, u = prints.of(a, a + length, 0), prints.of(a, a + length, 1)
                    for c, v in zip(cols, (np.full(len(a), doc), a, e, np.full(len(a), s["mark"]), k.view(np.int64), u.view(np.int64))):
                        c.append(v)
                    held += len(a)
                if held > 100_000:
                    yield _out(cols, _RANGE)
                    cols, held = [[] for _ in _RANGE], 0
        if held:
            yield _out(cols, _RANGE)

    return _mapped(texts, run, _SPAN)


def _settle(found: DataFrame, scratch: Scratch, name: str, batches: int) -> tuple[DataFrame, DataFrame]:
    """Indexes entries batch by batch. Returns (doc, first, last) of those that repeat as a whole, and spans to refine.

    To refine are entries of which only k is matched, and of the whole ones beside them one for each u: what
    a part of an entry equals may lie in a span that as a whole equals a third one.
    """
    family = IndexFamily(scratch, f"{name}-level")
    for i in range(batches):
        family.add(found.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i) if batches > 1 else found)
        scratch.release()
    out = scratch.save(found.join(family.matched(), _ENTRY), f"{name}-settled")
    scratch.release()
    whole = out.where("whole").select("doc", "first", "last")
    beside = out.where("whole AND mixed").withColumn("_down", F.col("mark") - F.col("first")).withColumn("_long", F.col("last") - F.col("first"))
    beside = beside.groupBy(*_ENTRY).agg(F.min("doc").alias("doc"), F.min_by("mark", "doc").alias("mark"), F.max("_down").alias("_down"), F.max("_long").alias("_long"))
    beside = beside.withColumn("first", F.col("mark") - F.col("_down")).withColumn("last", F.col("first") + F.col("_long"))
    spans = ["doc", "first", "last", "mark"]
    unsettled = out.where("NOT whole").select(*spans).unionByName(beside.select(*spans))
    return whole, unsettled.groupBy("doc").agg(F.collect_list(F.struct("first", "last", "mark")).alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, spread: int = 160, block: int = 16, batches: int = 4) -> DataFrame:
    """Per document: doc_id, text, spans: merged [start, end) of the bytes that repeat elsewhere, in order."""
    if not HISTORY + spread <= length:
        raise ValueError("spread must leave room for the gear hash's history")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = numbered(docs, scratch, id_col, text_col)
    spans = scratch.save(_scan(rows.select("doc", "text"), length, spread), "ranges")
    whole, listed = _settle(spans, scratch, "ranges", batches)
    scratch.drop("ranges")
    texts = scratch.save(rows.select("doc", "text").join(listed, "doc"), "open")
    scratch.release()
    for size, name in ((block, "blocks"), (1, "windows")):
        parts = scratch.save(_refine(texts, length, size), name)
        more, listed = _settle(parts, scratch, name, 1)
        scratch.drop(name)
        whole = whole.unionByName(more)
        texts = texts.select("doc", "text").join(listed, "doc")
    covered = whole.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")))).alias("spans"))
    return _merged(rows.join(covered, "doc", "left").select("doc_id", "text", "spans"))


def _merged(rows: DataFrame) -> DataFrame:
    """Joins spans that meet or overlap; they come in order of their starts."""
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = []
            for spans in b.column(2):
                merged: list[dict] = []
                for s in spans.as_py() or ():
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(s)
                every.append(merged)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(every, shape)], ["doc_id", "text", "spans"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, text string, spans array<struct<start:int,end:int>>")


def kept_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of texts without their repeated spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, sha = [], [], []
            for t, spans in zip(b.column(1), b.column(2)):
                raw, at, digest, n = t.as_py().encode("utf-8", "replace"), 0, hashlib.sha256(), 0
                for s in spans.as_py():
                    digest.update(raw[at : s["start"]])
                    at, n = s["end"], n + s["end"] - s["start"]
                digest.update(raw[at:])
                size.append(len(raw))
                gone.append(n)
                sha.append(digest.hexdigest())
            runs = np.array([len(s) for s in b.column(2)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
