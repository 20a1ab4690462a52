"""Queries of the training-data operators and, where SQL can express one, the
SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, exact, mixing, packing, quality, simhash, substring, toxicity, warc
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.windows(chat.with_trap(table(spark, sf_dir, "conversations"))))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passage_classes(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op9_simhash_groups": op9_simhash_groups,
        "op6_quality": op6_quality,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op7_nearest": op7_nearest,
        "op8_toxicity": op8_toxicity,
        "op4_warc_round_trip": op4_warc_round_trip,
        "op5_chat_windows": op5_chat_windows,
        "op2_repeated_passages": op2_repeated_passages,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op10_exact_dedup": OP10_SQL}


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         ([1, 2, 3])[((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(cap, w * max(level) FILTER (WHERE level * w <= cap) OVER ()), cap) AS target,
         CAST('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM levels),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS nth FROM sized),
rated AS (
  SELECT p.*, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(floor(start + each * nth) - floor(start + each * (nth - 1)), ceil(each)))::BIGINT * size AS taken
FROM rated
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
