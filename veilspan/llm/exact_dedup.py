"""Exact deduplication in three combining stages that compare full content.

1. Locally: Spark's map-side combine keeps one row per content and task before anything is shuffled.
2. Salted: the combined rows of one content meet in at most ``salts`` tasks, by content and salt.
3. Globally: the winners of the salts meet by content.

Content itself is part of every grouping key; the digests only spread the rows. A digest that two
different contents share (SHA-256, a 64-bit hash and the length all equal) raises an error.

Defined cases: null text counts as empty; empty texts form one group; very long texts are compared whole; ties
in length go to the smaller doc_id; a null doc_id ranks after all others; of rows that repeat a doc_id inside a
group, one is kept; an empty table gives an empty result; further columns pass through the filter untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import SPACES, Scratch, repeats, text_of

#: One more than the range of shifted doc_ids, so that length comes first in a rank.
_SPAN = "CAST(36893488147419103232 AS DECIMAL(20,0))"
_TOP = "CAST(9223372036854775808 AS DECIMAL(20,0))"
_KEY = ["text_sha256", "_h", "_n"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    text = text_of(docs, text_col)
    content = F.translate(text, SPACES, "")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.char_length(text).alias("_chars"), content.alias("_content"))
    return rows.select(
        "doc_id",
        "_content",
        *_digests(F.col("_content"), _KEY),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(salts)).cast("int").alias("_salt"),
        _rank(F.col("doc_id"), F.col("_chars")).alias("_rank"),
    )


def _digests(content, names: list[str]) -> list:
    return [c.alias(n) for c, n in zip((F.sha2(content.cast("binary"), 256), F.xxhash64(content), F.octet_length(content)), names)]


def _rank(doc_id, chars):
    low = F.coalesce(F.expr(_TOP) - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (chars.cast("decimal(10,0)") * F.expr(_SPAN) + low).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per group of equal contents: digests, group_size and keep_id."""
    return _ranked_groups(docs, id_col, text_col, salts).drop("_best")


def _ranked_groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """exact_groups with _best, the rank of the row that stays."""
    rows = _keyed(docs, id_col, text_col, salts)
    salted = rows.groupBy(*_KEY, "_content", "_salt").agg(F.count(F.lit(1)).alias("_c"), F.max("_rank").alias("_rank"))
    whole = salted.groupBy(*_KEY, "_content").agg(F.sum("_c").alias("_c"), F.max("_rank").alias("_rank"))
    one = whole.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_contents"), F.sum("_c").alias("group_size"), F.max("_rank").alias("_rank"))
    low = F.expr(f"_rank % {_SPAN}")
    return one.select(
        *_KEY,
        F.when(F.col("_contents") > 1, F.raise_error(F.lit("two contents share all digests")).cast("bigint")).otherwise(F.col("group_size")).alias("group_size"),
        F.when(low > 0, (F.expr(_TOP) - low).cast("bigint")).alias("keep_id"),
        F.col("_rank").alias("_best"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (dropped rows too)."""
    # The groups are a table, so both sides of the join are dealt for it alone, and Spark can split a hot group's rows.
    groups = Scratch(docs.sparkSession, "exact").save(exact_groups(docs, id_col, text_col, salts), "groups")
    both = _keyed(docs, id_col, text_col, salts).select("doc_id", *_KEY, "_rank").join(groups, _KEY)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if repeats(docs, id_col):
        again = F.row_number().over(Window.partitionBy(*_KEY, "doc_id").orderBy(F.desc("_rank")))
        both = both.repartition("doc_id", "_h").withColumn("_again", again)
        kept = kept & (F.col("_again") == 1)
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row of each group, with all its columns.

    Rows are picked by content and rank, not by doc_id, which may be null or repeated; repeated rows agree in both.
    """
    names = ["__sha256", "__h", "__n", "__rank"]
    text = text_of(docs, text_col)
    rows = docs.select("*", *_digests(F.translate(text, SPACES, ""), names), _rank(docs[id_col].cast("bigint"), F.char_length(text)).alias("__rank"))
    groups = _ranked_groups(docs, id_col, text_col, salts).select(*[F.col(c).alias(n) for c, n in zip([*_KEY, "_best"], names)])
    kept = rows.join(Scratch(docs.sparkSession, "exact").save(groups, "best"), names, "left_semi")
    return (kept.dropDuplicates(names) if repeats(docs, id_col) else kept).select(*[docs[c] for c in docs.columns])
