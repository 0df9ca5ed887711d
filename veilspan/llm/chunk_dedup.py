"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes puts a cut wherever its scrambled value is small, so chunks have
variable length and an insertion moves only the cuts beside it. Chunks are known by two 64-bit prints.
Where chunks that occur twice or more follow each other for ``min_run`` bytes, they are a repeated span;
of each chunk in such spans the first occurrence (smallest doc_id, then place) stays and others are removed.
Short runs, as of common phrases, are left alone.

Counts are combined on the map side before they are shuffled, so a chunk that a third of all documents
share is one row for a task. Chunks end after ``max_chunk`` bytes at the latest.

Defined cases: null text counts as empty, and has no chunks; null doc_ids come after all others; repeated rows,
and rows that share a doc_id, are documents of their own, in the order of their texts; ties go to the smaller
place; a text of one chunk is treated like any other; very long texts are read whole; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Scratch, numbered, tidy
from veilspan.llm.rolling import Prints, gear, scramble

_CHUNK = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("k", pa.int64()), ("u", pa.int64())])
_PLACE = "CAST(doc AS DECIMAL(20,0)) * CAST(2147483648 AS DECIMAL(10,0)) + start"


def chunk_starts(raw: np.ndarray, mean: int, max_chunk: int) -> np.ndarray:
    """Starts of chunks: after each cut, and after max_chunk bytes without one."""
    cuts = np.flatnonzero(scramble(gear(raw)) < np.uint32(2**32 // mean)) + 1
    starts = np.unique(np.r_[0, cuts[cuts < len(raw)]])
    size = np.diff(np.r_[starts, len(raw)])
    if (size > max_chunk).any():
        starts = np.concatenate([np.arange(s, s + n, max_chunk) for s, n in zip(starts, size)])
    return starts


def chunks(rows: DataFrame, mean: int, max_chunk: int) -> DataFrame:
    """doc, start, size, k, u of every chunk. rows: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = [[] for _ in _CHUNK], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, _CHUNK)], schema=_CHUNK)

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = np.frombuffer(t.as_py().encode("utf-8", "replace"), np.uint8)
                if not len(raw):
                    continue
                start = chunk_starts(raw, mean, max_chunk)
                end, prints = np.r_[start[1:], len(raw)], Prints(raw)
                for c, v in zip(cols, (np.full(len(start), doc), start, end - start, prints.of(start, end, 0).view(np.int64), prints.of(start, end, 1).view(np.int64))):
                    c.append(v)
                held += len(start)
                if held > 100_000:
                    yield out()
                    cols, held = [[] for _ in _CHUNK], 0
        if held:
            yield out()

    return rows.mapInArrow(tidy(run), "doc bigint, start int, size int, k bigint, u bigint")


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 48, max_chunk: int = 1024, min_run: int = 160) -> DataFrame:
    """Per document: doc_id, text, n_chunks, repeated and removed (arrays of start, end in bytes)."""
    scratch = Scratch(docs.sparkSession, "chunks")
    rows = numbered(docs, scratch, id_col, text_col)
    found = scratch.save(chunks(rows.select("doc", "text"), mean, max_chunk), "chunks")
    index = found.groupBy("k", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr(_PLACE).cast("decimal(38,0)")).alias("place")).where("n > 1")
    index = scratch.save(index, "index")
    scratch.release()
    again = found.join(index, ["k", "u"]).select("doc", "start", "size", (F.expr(_PLACE).cast("decimal(38,0)") != F.col("place")).alias("gone"))
    listed = again.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "size", "gone"))).alias("again"))
    listed = scratch.save(listed, "again")
    scratch.release()
    both = rows.join(listed, "doc", "left").select("doc_id", "text", "again")
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, repeated, removed = [], [], []
            for t, again in zip(b.column(1), b.column(2)):
                raw = np.frombuffer(t.as_py().encode("utf-8", "replace"), np.uint8)
                counts.append(len(chunk_starts(raw, mean, max_chunk)) if len(raw) else 0)
                runs: list[list] = []
                for c in again.as_py() or ():
                    s, e = c["start"], c["start"] + c["size"]
                    if runs and runs[-1][1] == s:
                        runs[-1][1] = e
                        runs[-1][2].append((s, e, c["gone"]))
                    elif not runs or s >= runs[-1][1]:
                        runs.append([s, e, [(s, e, c["gone"])]])
                runs = [r for r in runs if r[1] - r[0] >= min_run]
                repeated.append([{"start": s, "end": e} for s, e, _ in runs])
                gone: list[dict] = []
                for s, e, _ in (c for r in runs for c in r[2] if c[2]):
                    if gone and gone[-1]["end"] == s:
                        gone[-1]["end"] = e
                    else:
                        gone.append({"start": s, "end": e})
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(repeated, shape), pa.array(removed, shape)], ["doc_id", "text", "n_chunks", "repeated", "removed"]
            )

    span = "array<struct<start:int,end:int>>"
    return both.mapInArrow(tidy(run), f"doc_id bigint, text string, n_chunks bigint, repeated {span}, removed {span}")


def chunk_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated, n_removed (bytes), removed_spans, kept_sha256."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = []
            for t, spans in zip(b.column(1), b.column(4)):
                raw, at, digest = t.as_py().encode("utf-8", "replace"), 0, hashlib.sha256()
                for s in spans.as_py():
                    digest.update(raw[at : s["start"]])
                    at = s["end"]
                digest.update(raw[at:])
                sha.append((len(raw), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in sha], pa.int64()), b.column(2), b.column(3), b.column(4), pa.array([h for _, h in sha])],
                ["doc_id", "n_bytes", "n_chunks", "repeated", "removed", "kept_sha256"],
            )

    span = "array<struct<start:int,end:int>>"
    rows = found.select("doc_id", "text", "n_chunks", "repeated", "removed").mapInArrow(tidy(kept), f"doc_id bigint, n_bytes bigint, n_chunks bigint, repeated {span}, removed {span}, kept_sha256 string")
    length = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    said = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_bytes", "n_chunks", length("repeated").alias("n_repeated"), length("removed").alias("n_removed"), said.alias("removed_spans"), "kept_sha256")
