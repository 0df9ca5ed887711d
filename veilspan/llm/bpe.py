"""Byte-level BPE encoding and decoding.

Texts are split into pieces by the pattern of the rank files. The distinct pieces of a slice of documents
are encoded by Spark's higher-order functions: an ``aggregate`` over the piece's bytes that joins, step by
step, the adjacent pair of lowest rank, looked up in a literal rank map (a hash table in an array, as Spark's maps
are walked from end to end). Nothing is shuffled: a slice is one row, and its documents are put together
from the coded pieces in the same task.

The fold is interpreted and takes about 0.1 ms a piece. So it codes the ``folded`` most frequent pieces of a
slice, which make up most of its text; rare ones are merged in numpy, many at once, and pieces of over 256
bytes by a heap of pairs. All three follow the same map of ranks.

Decoding concatenates the bytes of each id.

Defined cases: null text counts as empty and gives no ids; texts of any length are read whole; special
tokens' strings are ordinary text; an empty table gives an empty result; repeated rows are coded each;
ids out of the vocabulary raise an error when decoded. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import release_memory, text_of, tidy

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: The characters of Unicode's White_Space, and the pattern's contractions.
_WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = _LETTER
        elif c == "N":
            out[i] = _NUMBER
    for c in _WHITE:
        out[ord(c)] = _SPACE
    return out


def piece_starts(cp: np.ndarray) -> np.ndarray:
    """Where pieces start among the code points of a text."""
    n = len(cp)
    kind = _classes()[cp]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # A run of white space before another run gives its last character away: a blank leads the next piece.
    turn = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE)) + 1
    start[turn - 1] = True
    start[turn[cp[turn - 1] == 32]] = False
    # Contractions: an apostrophe of its own, not led by a blank, and the letters after it.
    quote = np.flatnonzero((cp == 39) & start)
    for i in quote[quote < n - 1].tolist():
        if kind[i + 1] != _LETTER:
            continue
        after = "".join(map(chr, cp[i + 1 : i + 3]))
        for s in _SHORT:
            if after.startswith(s):
                start[i + 1] = False
                if i + 1 + len(s) < n:
                    start[i + 1 + len(s)] = True
                break
    return np.flatnonzero(start)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, and a random value for each byte."""

    base = 0x9E3779B97F4A7C15 | 5

    def __init__(self):
        self.value = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def split_pieces(text: str) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces of a text and the place of each piece among them."""
    if not text:
        return [], np.zeros(0, np.int32)
    raw = text.encode()
    if len(raw) == len(text):
        cp = np.frombuffer(raw, np.uint8)
        starts = piece_starts(cp)
    else:
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(cp)
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        starts = (np.cumsum(width) - width)[starts]
    ends = np.r_[starts[1:], len(raw)]
    up, down = _POWERS.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_POWERS.value[np.frombuffer(raw, np.uint8)] * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[first].tolist(), ends[first].tolist()
    return [raw[i:j] for i, j in zip(s, e)], at.astype(np.int32)


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Two slots for each pair of ids in the literal rank map.
_SLOTS, _FIRST, _SECOND, _MIX = 1 << 18, 250007, 262133, (1000003, 999983)


def rank_map(ranks: dict[bytes, int]) -> list[int]:
    """The rank of every pair of ids that joins to a token: (first * 65536 + second) * 65536 + rank in a slot.

    A cuckoo table: a pair is in one of its two slots, so a lookup reads at most two entries.
    """
    table = [0] * _SLOTS
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is None or b is None:
                continue
            entry, at = (a * 65536 + b) * 65536 + rank, (a * 65536 + b) % _FIRST
            for _ in range(1000):
                entry, table[at] = table[at], entry
                if not entry:
                    break
                pair = entry >> 16
                one, two = pair % _FIRST, (pair % _MIX[0]) * (pair % _MIX[1]) % _SECOND
                at = two if at == one else one
            else:
                raise ValueError("the rank map is too full")
    return table


_NONE = 1 << 17


@lru_cache(4)
def _table(path: str) -> np.ndarray:
    return np.array(rank_map(read_ranks(path)), np.int64)


def _pair_ranks(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pair = a * 65536 + b
    one, two = table[pair % _FIRST], table[(pair % _MIX[0]) * (pair % _MIX[1]) % _SECOND]
    out = np.where(one >> 16 == pair, one & 65535, np.where(two >> 16 == pair, two & 65535, _NONE))
    out[(a < 0) | (b < 0)] = _NONE
    return out


def merge_batch(words: list[bytes], path: str, widest: int = 256) -> list[np.ndarray]:
    """Ranked merges of many pieces at once: each round joins the lowest pair of every row that has one."""
    ranks, table = read_ranks(path), _table(path)
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    out: list[np.ndarray | None] = [None] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w in ranks:
            out[i] = np.array([ranks[w]])
        elif len(w) > widest:
            out[i] = np.array(merge_long(w, ranks))
        else:
            by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
    for width, chosen in by_width.items():
        for at in range(0, len(chosen), max(1, (1 << 17) // width)):
            rows = chosen[at : at + max(1, (1 << 17) // width)]
            ids = np.full((len(rows), width + 1), -1, np.int64)
            sizes = np.array([len(words[i]) for i in rows])
            inside = np.arange(width + 1) < sizes[:, None]
            ids[inside] = single[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
            found = _pair_ranks(table, ids[:, :-1], ids[:, 1:])
            left, columns = np.arange(len(rows)), np.arange(width + 1)
            while len(left):
                place = found[left].argmin(1)
                lowest = found[left, place]
                go = lowest < _NONE
                left, place, lowest = left[go], place[go], lowest[go]
                if not len(left):
                    break
                mine, theirs = ids[left], found[left]
                moved = columns > place[:, None]
                mine = np.where(moved, np.c_[mine[:, 1:], np.full(len(left), -1)], mine)
                theirs = np.where(moved[:, :-1], np.c_[theirs[:, 1:], np.full(len(left), _NONE)], theirs)
                k = np.arange(len(left))
                mine[k, place] = lowest
                theirs[k, place] = _pair_ranks(table, lowest, mine[k, place + 1])
                before = np.flatnonzero(place > 0)
                theirs[before, place[before] - 1] = _pair_ranks(table, mine[before, place[before] - 1], lowest[before])
                ids[left], found[left] = mine, theirs
            sizes = (ids >= 0).sum(1)
            for i, part in zip(rows, np.split(ids[ids >= 0], np.cumsum(sizes)[:-1])):
                out[i] = part
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges over a doubly linked list with a heap of pairs."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    part, after, before = [piece[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k, m in ((before[i], i), (i, after[i])):
            if k >= 0 and m < n and (r := ranks.get(part[k] + part[m])) is not None:
                heapq.heappush(heap, (r, k, part[k], part[m]))
    return [ranks[p] for p in part if p]


def fold_column(words: str, ranks: dict[bytes, int]):
    """For arrays of the ids of single bytes: the ids after all ranked merges.

    An element is an id, and above 20 bits the rank of its pair with the next one, so a step looks up only
    the two pairs that a merge makes.
    """
    literal = F.from_json(F.lit(json.dumps(rank_map(ranks), separators=(",", ":"))), "array<bigint>")

    def rank(table, a, b):
        pair = a * 65536 + b
        one = F.get(table, (pair % _FIRST).cast("int"))
        two = F.get(table, (((pair % _MIX[0]) * (pair % _MIX[1])) % _SECOND).cast("int"))
        found = F.when(F.shiftright(one, 16) == pair, one.bitwiseAND(F.lit(65535))).when(F.shiftright(two, 16) == pair, two.bitwiseAND(F.lit(65535)))
        return F.coalesce(found, F.lit(_NONE).cast("bigint"))

    def named(value, use):
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def low(x):
        return x.bitwiseAND(F.lit((1 << 20) - 1))

    def both(table, a, b):
        return F.when(b.isNull(), a + (_NONE << 20)).otherwise(a + F.shiftleft(rank(table, a, b), 20))

    def step(table, parts):
        # Rank and place of the lowest pair; of equal ranks the leftmost.
        lowest = F.array_min(F.transform(parts, lambda x, i: F.shiftright(x, 20) * 64 + i))

        def join(m):
            i, joined = m.bitwiseAND(F.lit(63)).cast("int"), F.shiftright(m, 6)
            left = named(low(F.get(parts, i - 1)), lambda a: F.array(both(table, a, joined)))
            mid = F.array(both(table, joined, low(F.get(parts, i + 2))))
            made = F.when(i > 0, F.concat(F.slice(parts, F.lit(1), i - 1), left, mid, F.slice(parts, i + 3, F.lit(64)))).otherwise(F.concat(mid, F.slice(parts, i + 3, F.lit(64))))
            return F.when(joined >= _NONE, parts).otherwise(made)

        return named(lowest, join)

    def folded(table, word):
        first = F.transform(word, lambda x, i: both(table, x, F.get(word, i + 1)))
        merged = named(first, lambda parts: F.aggregate(F.sequence(F.lit(2), F.size(word)), parts, lambda p, _: step(table, p)))
        return F.when(F.size(word) < 2, word).otherwise(F.transform(merged, low))

    # The literal is named once, as every mention of it would be a copy in the plan.
    return named(literal, lambda table: F.transform(words, lambda word: folded(table, word)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 3 << 20, folded: int = 3072, long_piece: int = 48, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers); with decoded also the bytes of these ids."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.binary())]))
    names = ["doc_id", "ids"] + ["decoded"] * decoded

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        index: dict[bytes, int] = {}
        ids, places, size = [], [], 0

        def row():
            # Frequent pieces first, of which those that can be folded go to the fold and the rest to unpack().
            words = list(index)
            times = np.bincount(np.concatenate(places), minlength=len(words)) if words else np.zeros(0, np.int64)
            times[np.fromiter((len(w) > long_piece for w in words), bool, len(words))] = 0
            order = np.argsort(-times, kind="stable")
            n = min(folded, int((times > 0).sum()))
            new = np.empty(len(words), np.int32)
            new[order] = np.arange(len(words), dtype=np.int32)
            # Tokens of the vocabulary are their own rank; others start as the ranks of their bytes.
            hot = [np.array([ranks[w]]) if w in ranks else single[np.frombuffer(w, np.uint8)] for w in (words[i] for i in order[:n].tolist())]
            inner = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, hot)]), pa.int32()), pa.array(np.concatenate(hot) if hot else np.zeros(0, np.int64), pa.int64())
            )
            docs_of = pa.array([[{"doc_id": i, "at": new[p].tobytes()} for i, p in zip(ids, places)]], shape)
            rest = pa.array([[words[i] for i in order[n:].tolist()]], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), inner), rest, docs_of], ["words", "rest", "docs"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                pieces, at = split_pieces(text)
                place = np.fromiter((index.setdefault(p, len(index)) for p in pieces), np.int32, len(pieces))
                ids.append(i)
                places.append(place[at])
                size += len(text)
                if size >= slice_bytes:
                    yield row()
                    index.clear()
                    ids, places, size = [], [], 0
        if ids:
            yield row()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pieces_of(path)

        def batch(doc_ids, out):
            columns = [doc_ids, pa.array(out, pa.binary())]
            return pa.RecordBatch.from_arrays(columns + [pa.array([decode_ids(i, tokens) for i in out], pa.binary())] * decoded, names)

        for b in batches:
            for r in range(b.num_rows):
                coded = b.column(2).slice(r, 1).flatten()
                ends = coded.offsets.to_numpy().astype(np.int64)
                more = merge_batch([w.as_py() for w in b.column(0).slice(r, 1).flatten()], path)
                lengths = np.r_[np.diff(ends), np.fromiter(map(len, more), np.int64, len(more))]
                flat = np.concatenate([coded.flatten().to_numpy(zero_copy_only=False), *more]).astype("<u4")
                starts = np.cumsum(lengths) - lengths
                docs_of = b.column(1).slice(r, 1).flatten()
                doc_ids, out, made, done = docs_of.field("doc_id"), [], 0, 0
                for at in docs_of.field("at"):
                    place = np.frombuffer(at.as_buffer(), np.int32)
                    size = lengths[place]
                    upto = np.cumsum(size)
                    total = int(upto[-1]) if len(upto) else 0
                    out.append(flat[np.repeat(starts[place] - upto + size, size) + np.arange(total)].tobytes())
                    made += total
                    if made > 1 << 20:
                        yield batch(doc_ids.slice(done, len(out)), out)
                        done, out, made = done + len(out), [], 0
                if out:
                    yield batch(doc_ids.slice(done, len(out)), out)
                del coded, more, flat, docs_of, doc_ids
            release_memory()

    packed = rows.mapInArrow(tidy(pack), "words array<array<bigint>>, rest array<binary>, docs array<struct<doc_id:bigint,at:binary>>")
    coded = packed.select("rest", "docs", fold_column("words", read_ranks(path)).alias("ids"))
    return coded.mapInArrow(tidy(unpack), "doc_id bigint, ids binary" + ", decoded binary" * decoded)


@lru_cache(4)
def pieces_of(path: str) -> list[bytes]:
    return [w for w, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]


def decode_ids(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (binary): the bytes of the ids one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [decode_ids(i.as_buffer(), pieces) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, ids binary, decoded binary")


def roundtrip(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, ids, decoded: decode(encode()) in the same tasks, so ids don't pass through two more workers."""
    return encode(docs, path, decoded=True, **options)


def token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
