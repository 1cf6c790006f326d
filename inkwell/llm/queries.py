"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, line_dedup, mixing, ogg_media, orc_tokens, secret_scan, simhash, suffix_dedup, toxicity
from .common import documents


def ranks() -> bpe.Vocabulary:
    return bpe.Vocabulary("tiktoken", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def tokenizer_json() -> bpe.Vocabulary:
    return bpe.Vocabulary("tokenizers", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(documents(spark, sf_dir), ranks())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(documents(spark, sf_dir))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.media_report(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.orc_report(documents(spark, sf_dir), tokenizer_json())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_secret_scan, op4_embedding_dedup, op5_byte_bpe, op6_line_dedup, op7_simhash, op8_ogg_media, op9_source_mix, op10_orc_tokens)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op9_source_mix": SOURCE_MIX_SQL}


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos) p
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \t-\r]+', ''), '[ \t-\r]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, common.keeper IS NOT NULL AND keyed.doc_id <> common.keeper AS dropped
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SOURCE_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source
), running AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM per WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - cap_before)::DOUBLE / (weights - weight_before)::DOUBLE AS level FROM running
), last AS (
  SELECT arg_min(level, weight_before) AS last_level FROM levels WHERE NOT level * weight > cap
), targets AS (
  SELECT source, source_size, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE least(last_level * weight, cap::DOUBLE) END AS target
  FROM levels, last
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                        < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
