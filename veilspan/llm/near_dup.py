"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. XOR-hashing a set into a bit sketch (each
element flips one bit) makes the Hamming distance of two sketches a lower bound of the sets' symmetric
difference, and a Jaccard similarity of t bounds that by (1 - t) / (1 + t) times the sum of their sizes.

1. Sets: one pass over the texts gives each document's size, a 128-bit digest and the words of its sketch.
   Documents with equal digests are one class; from here on only classes move.
2. Size bands: a band holds sizes from l to r; a pair with its larger set in a band has the smaller one in
   it or in the band below, and differs in at most k elements. The sketch is cut into k + 1 + s words of
   2^32 bits, known by the XOR of a random number for each bit that is set, so similar sets agree in 1 + s
   of them (pigeonhole). Each set files as many words as it can differ in, and c more, those with most
   elements first; similar sets share c filed words (prefix filter).
3. Sets that share a word form a group. Sets with fewer than c words in groups go, groups with the same members are
   one. In a group, sets are compared by whole sketches of two or more bits for each element, and pairs whose
   Hamming distance is within the bound are candidates. A group gives a spanning forest of its candidates
   (Prim's algorithm, so no pairs are held), and a group of over ``max_group`` sets a star of all of them.
4. Components of these edges are candidate families: no link leaves one. A family's texts meet in one
   task if they have up to ``budget`` shingles, otherwise in blocks that meet in pairs. There every pair is verified
   on exact sets; links are counted, not emitted, and a spanning forest of them gives the components.

So what moves grows with the number of texts, and the pairs of a family are only counted in memory. Only families
over the budget (of different sets that differ little, or share most of their words with very many) move
each text once for each of their blocks.

Defined cases: a null text or one without words has an empty set, linked with nothing; fewer words than a
shingle make one shingle of all; very long texts are read whole; ties of any kind go to the smallest
doc_id; a null doc_id ranks last, links as any other, and the component of null doc_ids alone is null;
repeated rows are copies of each other; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Scratch, text_of, tidy
from veilspan.llm.components import components

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles. bytes.split and bytes.lower are ASCII's, as the contract asks."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    w = min(width, n)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out = out * _M2 + h[i : n - w + 1 + i]
    return np.unique(mix64(out))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class Bands:
    """Size bands for a similarity of num / den or more."""

    def __init__(self, num: int, den: int, ratio: float = 1.3):
        self.num, self.den, self.ratio = num, den, max(ratio, den / num)
        self.low = [1]

    def bound(self, both: int) -> int:
        """The largest symmetric difference of similar sets with so many elements together."""
        return (self.den - self.num) * both // (self.den + self.num)

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(int(self.low[-1] * self.ratio) + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def places(self, n: int) -> list[tuple[int, int, int]]:
        """(band, k, own) of the bands in which a set of n elements is filed; own: k for this size."""
        j = self.of(n)
        self.of(self.low[j + 1])
        bands = [j, j + 1] if self.den * n >= self.num * self.low[j + 1] else [j]
        out = []
        for i in bands:
            high = self.low[i + 1] - 1
            out.append((i, self.bound(2 * high), self.bound(n + min(high, n * self.den // self.num))))
        return [x for x in out if x[2] > 0]

    def filed(self, s: np.ndarray) -> np.ndarray:
        """Keys of the sketch words under which a set is filed; their last byte is c, 255 at most."""
        keys = [np.zeros(0, np.uint64)]
        for j, k, own in self.places(len(s)):
            spare = 1 + k // 5
            n, c = k + 1 + spare, 1 + spare // 2
            block = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # rises with s, which is sorted
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            at = block[first].astype(np.int64)
            words, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
            words[at] = np.bitwise_xor.reduceat(mix64(s & np.uint64(0xFFFFFFFF)), first)
            size[at] = np.diff(np.r_[first, len(s)])
            key = mix64(mix64(words) ^ mix64(np.arange(n, dtype=np.uint64) + np.uint64(j << 32)))
            key = key[np.lexsort((key, -size))[: own + c]]
            keys.append((key & ~np.uint64(255)) | np.uint64(min(c, 255)))
        return np.concatenate(keys)


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch of 2^i bits, two or more for each element; it folds to any smaller size by XOR of halves."""
    m = max(256, 1 << (2 * len(s) - 1).bit_length())
    flips = np.bincount(((s >> np.uint64(8)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, n: int) -> np.ndarray:
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _sets(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, x, n, digest, keys of every document; digest and keys are null for empty sets. rows: doc_id, x, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in batches:
            n, d, keys, held, done = [], [], [], 0, 0
            for i, t in enumerate(b.column(2)):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                d.append(digest(s) if len(s) else None)
                keys.append(bands.filed(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
                held += len(keys[-1])
                if held > 200_000 or i + 1 == b.num_rows:
                    part = b.slice(done, len(n))
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(d, pa.binary()), lists], ["doc_id", "x", "n", "digest", "keys"])
                    n, d, keys, held, done = [], [], [], 0, i + 1

    return rows.mapInArrow(tidy(run), "doc_id bigint, x bigint, n bigint, digest binary, keys array<bigint>")


def _met(filed: DataFrame) -> DataFrame:
    """The rows (key, d) whose key others have too. Partitions are sorted by key; only one row is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again = None, False  # the last row, and whether its key was met before
        for b in batches:
            k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            if last is not None:
                k, d = np.r_[last[0], k], np.r_[last[1], d]
            same = k[1:] == k[:-1]
            keep = np.r_[again, same] | np.r_[same, False]
            last, again = (k[-1:], d[-1:]), bool(keep[-1])
            if keep[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(k[:-1][keep[:-1]]), pa.array(d[:-1][keep[:-1]])], ["key", "d"])
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["key", "d"])

    return filed.mapInArrow(tidy(run), "key bigint, d bigint")


def _groups(met: DataFrame, max_group: int) -> DataFrame:
    """g, d of groups of two to max_group sets, each set of members once for a partition; a larger group has rows
    (d, to): a star that joins all of it. Partitions are sorted by key and set; max_group members are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[np.ndarray] = []
        key, pivot = None, None  # of the group that is read; pivot if it is a large one
        out: list[list[np.ndarray]] = [[], [], []]

        def put(g, d, to):
            for column, v in zip(out, (g, d, to)):
                column.append(v)

        def close():
            members = np.unique(np.concatenate(held))
            if pivot is not None:
                put(np.zeros(len(members), np.int64), members, np.full(len(members), pivot))
            elif len(members) > 1:
                g = int(xxhash.xxh3_64_intdigest(members.tobytes()) >> 1)
                if g not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(g)
                    put(np.full(len(members), g), members, np.full(len(members), -1))

        def batch():
            arrays = [pa.array(np.concatenate(c)) for c in out]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, ["g", "d", "to"])

        for b in batches:
            k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            cuts = np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and k[s] != key:
                    close()
                    held, pivot = [], None
                key = k[s]
                held.append(d[s:e])
                if sum(map(len, held)) > max_group:
                    pivot = held[0][0] if pivot is None else pivot
                    close()
                    held = [np.array([pivot])]
            if sum(map(len, out[0])) > 100_000:
                yield batch()
        if held:
            close()
        if out[0]:
            yield batch()

    return met.mapInArrow(tidy(run), "g bigint, d bigint, to bigint")


def forest(n: np.ndarray, sk: list[bytes], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose sketches allow them to be similar, nearest first (Prim)."""
    x = [np.frombuffer(s, np.uint64) for s in sk]
    low = min(map(len, x))
    x, far_off = np.stack([fold(w, low) for w in x]), np.iinfo(np.int64).max
    best, parent, left = np.full(len(n), far_off), np.full(len(n), -1), np.arange(len(n))
    while len(left):
        at = int(best[left].argmin())
        i, left = left[at], np.delete(left, at)
        if parent[i] >= 0:
            yield int(parent[i]), int(i)
        limit = (den - num) * (n[left] + n[i]) // (den + num)
        near = np.flatnonzero(np.abs(n[left] - n[i]) <= limit)
        far = np.bitwise_count(x[left[near]] ^ x[i]).sum(1, dtype=np.int64)
        ok = (far <= limit[near]) & (far < best[left[near]])
        best[left[near[ok]]], parent[left[near[ok]]] = far[ok], i


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Whole runs of rows with equal first columns, in batches of these rows."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        cuts = np.r_[np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(0)]), b.num_rows].tolist()
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and (k[:, s] != last).any():
                yield held
                held = []
            held.append(b.slice(s, e - s))
            last = k[:, s]
    if held:
        yield held


def _forests(members: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: candidate edges. members: g, d, n, sketch; partitions sorted by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()

        def batch():
            a = np.array(sorted(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

        for parts in _runs(batches, 1):
            d, n = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (1, 2))
            sk = [v.as_py() for p in parts for v in p.column(3)]
            found.update((int(max(d[i], d[j])), int(min(d[i], d[j]))) for i, j in forest(n, sk, num, den))
            if len(found) > 100_000:
                yield batch()
        if found:
            yield batch()

    return members.mapInArrow(tidy(run), "u bigint, v bigint")


class Overlaps:
    """Sizes of the intersections of some sets: of bit rows over shared elements, or of postings if these are too wide."""

    def __init__(self, sets: list[np.ndarray], widest: int = 1 << 26):
        self.n = np.array([len(s) for s in sets], np.int64)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        row = np.repeat(np.arange(len(sets)), self.n)[shared[at]]
        column = (np.cumsum(shared) - 1)[at[shared[at]]]
        wide = -(-int(shared.sum()) // 64) * 8
        self.bits = self.by = None
        if len(sets) * wide <= widest:
            self.bits = np.zeros((len(sets), max(8, wide)), np.uint8)
            np.bitwise_or.at(self.bits, (row, column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
            self.bits = self.bits.view(np.uint64)
        else:
            self.start = np.r_[0, np.cumsum(np.bincount(column))]
            self.by = row[np.argsort(column, kind="stable")]
            self.mine = np.split(column, np.cumsum(np.bincount(row, minlength=len(sets)))[:-1])

    def after(self, i: int) -> np.ndarray:
        """Of set i with every later one."""
        if self.bits is not None:
            return np.bitwise_count(self.bits[i + 1 :] & self.bits[i]).sum(1, dtype=np.int64)
        out = np.zeros(len(self.n), np.int64)
        for c in self.mine[i]:
            out[self.by[self.start[c] : self.start[c + 1]]] += 1
        return out[i + 1 :]


def _linked_families(families: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """d, to, links: the links of d inside its family (blocks a and b of it), and an edge of their spanning forest.

    families: comp, a, b, d, block, w (its copies), text; partitions sorted by comp, a, b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def batch():
            arrays = [pa.array(c, pa.int64()) for c in out]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, ["d", "to", "links"])

        for parts in _runs(batches, 3):
            d, block, w = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (3, 4, 5))
            across = parts[0].column(1)[0].as_py() != parts[0].column(2)[0].as_py()
            sets = [shingles(t.as_py(), width) for p in parts for t in p.column(6)]
            over, links, label = Overlaps(sets), np.zeros(len(d), np.int64), np.arange(len(d))
            for i in range(len(d) - 1):
                both = over.after(i)
                ok = den * both >= num * (over.n[i] + over.n[i + 1 :] - both)
                if across:
                    ok &= block[i + 1 :] != block[i]
                j = np.flatnonzero(ok) + i + 1
                if len(j):
                    links[i] += w[j].sum()
                    links[j] += w[i]
                    met = np.unique(np.r_[label[i], label[j]])
                    if len(met) > 1:
                        label[np.isin(label, met)] = met[0]
            least = np.full(len(d), np.iinfo(np.int64).max)
            np.minimum.at(least, label, d)
            for column, v in zip(out, (d, least[label], links)):
                column.extend(v.tolist())
            if len(out[0]) > 100_000:
                yield batch()
        if out[0]:
            yield batch()

    return families.mapInArrow(tidy(run), "d bigint, to bigint, links bigint")


#: So many ids, of 32 bytes, are sent to all tasks to pick documents; more are joined by a shuffle.
_SENT_IDS = 250_000


def _row_hash(docs: DataFrame, id_col: str, text_col: str):
    """Tells rows apart whose doc_id is null or shared; only repeated rows (equal doc_id and text) have it in common."""
    doc_id = docs[id_col].cast("bigint")
    return F.xxhash64(doc_id.isNull(), doc_id, text_of(docs, text_col))


def _linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, max_group: int = 4096, budget: int = 2_000_000
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, x, n, digest) and classes (d, digest, w, head, comp, links).

    head is the first row of a class: (none, doc_id, x), so that null doc_ids come last. links counts documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), _row_hash(docs, id_col, text_col).alias("x"), text_of(docs, text_col).alias("text"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.save(_sets(rows, width, num, den).withColumn("row", F.monotonically_increasing_id()), "found")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x", "row")).alias("head")
    classes = found.where("digest IS NOT NULL").groupBy("digest").agg(head, F.count(F.lit(1)).alias("w"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    filed = scratch.save(classes.select(F.col("head.row").alias("d"), "digest", "w", "n", "head", "keys"), "classes")
    sets = scratch.save(found.drop("keys", "row"), "sets")
    classes = filed.drop("keys")
    scratch.drop("found")
    scratch.release()

    keyed = filed.select(F.explode("keys").alias("key"), "d").repartition(parts, "key").sortWithinPartitions("key")
    met = scratch.save(_met(keyed).withColumn("least", F.col("key").bitwiseAND(F.lit(255))), "met")
    scratch.release()
    enough = met.groupBy("d", "least").agg(F.count(F.lit(1)).alias("n")).where("n >= least").select("d", "least")
    met = met.join(enough, ["d", "least"], "left_semi").select("key", "d")
    groups = scratch.save(_groups(met.repartition(parts, "key").sortWithinPartitions("key", "d"), max_group), "groups0")
    groups = scratch.save(groups.distinct(), "groups")
    for done in ("met", "groups0"):
        scratch.drop(done)
    scratch.release()

    wanted = classes.join(groups.select("d").distinct(), "d").select("d", "digest", F.col("head.x").alias("x"))
    wanted = scratch.save(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= _SENT_IDS else wanted.hint("shuffle_hash")
    texts = rows.join(wanted, "x").select("d", "digest", "text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk, keep = [], []
            for want, t in zip(b.column(1), b.column(2)):
                s = shingles(t.as_py(), width)
                keep.append(digest(s) == want.as_py())  # x is a hash of 64 bits
                sk.append((len(s), sketch(s)))
            columns = [b.column(0), b.column(2), pa.array([n for n, _ in sk], pa.int64()), pa.array([s for _, s in sk], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "text", "n", "sketch"]).filter(pa.array(keep, pa.bool_()))

    texts = scratch.save(texts.mapInArrow(tidy(sketched), "d bigint, text string, n bigint, sketch binary").dropDuplicates(["d"]), "texts")
    scratch.release()

    members = groups.where("to < 0").select("g", "d").join(texts.select("d", "n", "sketch"), "d").select("g", "d", "n", "sketch")
    edges = _forests(members.repartition(parts, "g").sortWithinPartitions("g"), num, den)
    stars = groups.where("to >= 0").select(F.col("d").alias("u"), F.col("to").alias("v"))
    edges = scratch.save(edges.unionByName(stars).distinct(), "edges")
    scratch.release()
    labels = components(edges, scratch, "cc")
    families = labels.select(F.col("node").alias("d"), F.col("component").alias("comp")).join(classes.select("d", "n", "w"), "d")
    families = scratch.save(families, "families")
    scratch.release()
    blocks = families.groupBy("comp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    blocks = blocks.select("comp", F.greatest(F.lit(1), F.ceil(F.col("n") / budget), F.ceil(F.col("m") / (4 * max_group))).cast("int").alias("blocks"))
    large = scratch.save(blocks.where("blocks > 1"), "large")
    any_large = not large.isEmpty()
    placed = families.join(texts.select("d", "text"), "d")
    if any_large:
        placed = placed.join(F.broadcast(large) if large.count() <= _SENT_IDS else large, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumn("a", F.least("block", "_with")).withColumn("b", F.greatest("block", "_with"))
    else:
        placed = placed.withColumns({c: F.lit(0) for c in ("a", "b", "block")})
    placed = placed.select("comp", "a", "b", "d", "block", "w", "text").repartition(parts, "comp", "a", "b").sortWithinPartitions("comp", "a", "b", "d")
    linked = scratch.save(_linked_families(placed, width, num, den), "linked")
    scratch.release()
    labels = linked.select("d", F.col("to").alias("comp"))
    if any_large:
        labels = components(linked.select(F.col("d").alias("u"), F.col("to").alias("v")), scratch, "cl").select(F.col("node").alias("d"), F.col("component").alias("comp"))
    degree = linked.groupBy("d").agg(F.sum("links").alias("links"))
    classes = classes.join(labels.join(degree, "d"), "d", "left")
    classes = classes.select("d", "digest", "w", "head", F.coalesce("comp", "d").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    return sets, scratch.save(classes, "labelled")


#: The classes of a large component meet their head in so many tasks.
_SALTS = 16


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_shingles, n_links (documents that it is linked with, its copies among them), component_id.

    component_id is the smallest doc_id of a component, and null if it has none.
    """
    sets, classes = _linked(docs, id_col, text_col, **options)
    heads = classes.groupBy("comp").agg(F.min("head")["doc_id"].alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    out = classes.withColumn("salt", F.pmod("d", F.lit(_SALTS)).cast("int")).join(heads, ["comp", "salt"]).select("digest", "component_id", "links")
    out = sets.join(out, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (null comes last), with all its columns.

    Texts without shingles have no links: one row of each doc_id stays, and of null doc_ids one of each text.
    """
    sets, classes = _linked(docs, id_col, text_col, **options)
    heads = classes.groupBy("comp").agg(F.min("head")["x"].alias("__x")).select("__x")
    bare = sets.where("digest IS NULL").groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("x"))).agg(F.min("x").alias("__x")).select("__x")
    rows = docs.select("*", _row_hash(docs, id_col, text_col).alias("__x"))
    return rows.join(heads.unionByName(bare), "__x", "left_semi").dropDuplicates(["__x"]).select(*[docs[c] for c in docs.columns])
