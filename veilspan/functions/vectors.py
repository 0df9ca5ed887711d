"""Column expressions over vectors, codes and maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; vectors of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), F.sqrt(l2_squared(a, b))).otherwise(F.raise_error(F.lit("lengths differ")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_finite(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two codes, arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def bit_string(words: Column, n: int) -> Column:
    """The first n bits of a code, words holding 63 bits each."""
    return F.substring(F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), 63, "0")), ""), 1, n)


@F.pandas_udf(T.BinaryType())
def pack(v: pd.Series) -> pd.Series:
    """Vectors as 8-byte big-endian doubles."""
    return v.map(lambda x: None if x is None else np.asarray(x, ">f8").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in it:
        yield b.map(lambda x: None if x is None else np.frombuffer(x, ">f8").astype(float))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def nz(x: Column) -> Column:
    """0 for null and not finite values."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def coalesce_nonzero(*xs: Column) -> Column:
    """The first value that is neither null nor 0, else 0."""
    return F.coalesce(*[F.when(x != 0, x) for x in xs], F.lit(0))


def non_negative(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))


def parse_id(text: Column) -> Column:
    """A string as an id of 0 or more; anything else is an error."""
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(number, F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(text, F.lit("null")))).cast("int"))


def fold31(hashes: Column) -> Column:
    """31 h + x over the hashes with 32-bit wrap-around, as a signed int."""
    span = 1 << 32
    folded = F.aggregate(hashes, F.lit(1).cast("bigint"), lambda s, x: F.pmod(s * 31 + x, F.lit(span)))
    return F.when(folded >= span // 2, folded - span).otherwise(folded).cast("int")


def map_to_text(m: Column) -> Column:
    """key=value;... by key, with = and ; escaped by a backslash."""
    esc = lambda s: F.regexp_replace(s, r"([=;\\])", r"\\$1")
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(esc(e["key"]), F.lit("="), esc(e["value"]))), ";")


def text_to_map(s: Column) -> Column:
    """Reads map_to_text back."""
    un = lambda x: F.regexp_replace(x, r"\\(.)", "$1")
    parts = F.filter(F.regexp_extract_all(s, F.lit(r"((?:[^;\\]|\\.)*)(?:;|$)"), F.lit(1)), lambda p: p != "")
    pattern = r"^((?:[^=\\]|\\.)*)=((?:[^\\]|\\.)*)$"
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(un(F.regexp_extract(p, pattern, 1)), un(F.regexp_extract(p, pattern, 2)))))


def csv_quote(s: Column) -> Column:
    """Quotes a field that holds a comma, quote or line feed."""
    return F.when(s.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
