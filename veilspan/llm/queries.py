"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bm25, bpe, chat, chunk_dedup, exact_dedup, mixing, near_dup, quality, secrets, suffix_dedup
from veilspan.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(bpe.roundtrip(table(spark, sf_dir, "documents"), path))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_digests(chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_digests(secrets.scan(docs, secrets.train_scanner(docs)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digests(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(docs, docs.where("doc_id % 50 = 0"))
    return found.withColumn("score", F.round("score", 6))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.parse_chats(chat.format_chats(chat.chains(turns.unionByName(more)))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_byte_bpe, op3_chunk_dedup, op4_secret_scan, op5_suffix_dedup, op6_exact_dedup, op7_mixing, op8_bm25_topk, op9_chat_format, op10_quality)
}

#: White space of the contracts as a class of DuckDB's regular expressions.
_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op8_bm25_topk": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+') AS words
                   FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
        s AS (SELECT count(*) AS n, greatest(1.0, avg(len(words))) AS mean FROM d),
        p AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, unnest(words) AS term, len(words) AS size FROM d) GROUP BY doc_id, term),
        f AS (SELECT term, ln(1 + ((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM p GROUP BY term),
        r AS (SELECT q.doc_id AS q_id, p.doc_id, round(sum(w * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.size / (SELECT mean FROM s)))), 9) AS score
              FROM p q JOIN f ON q.term = f.term JOIN p ON p.term = q.term WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, p.doc_id)
        SELECT q_id, rank, doc_id, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "op6_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g') AS content FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               row_number() OVER (PARTITION BY content ORDER BY chars DESC, doc_id) = 1 AS kept,
               sha256(content) AS text_sha256
        FROM d""",
    "op9_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g') AS escaped FROM t),
        c AS (
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(length(role) + 1 + length(escaped) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id)
        SELECT * FROM c""",
}
