"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import chat, fingerprints, jaccard, licenses, mixing, prefixfree, quality, secrets, tiling, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixfree.remove_repeats(table(spark, sf_dir, "documents"), text_too=True)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


#: Each turn's place in its dialogue, heads and bodies from each participant's side, running sums for masks.
OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM said
), people AS (
  SELECT DISTINCT conv_id, role AS participant FROM said WHERE role <> 'system'
), sides AS (
  SELECT t.conv_id, p.participant, t.place, t.role = p.participant AS own, t.text || '<|im_end|>' || chr(10) AS body,
    CASE WHEN t.role = p.participant THEN '<|im_start|>assistant' WHEN t.role = 'system' THEN '<|im_start|>system'
      ELSE '<|im_start|>user name=' || t.role END || chr(10) AS head
  FROM placed t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), ends AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY place) AS stop FROM sides
)
SELECT conv_id, participant, place // 256 AS chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || body, '' ORDER BY place) AS rendered,
  coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR), ',' ORDER BY place) FILTER (own), '') AS mask,
  CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars, CAST(min(stop - length(head) - length(body)) AS BIGINT) AS first_char
FROM ends GROUP BY conv_id, participant, place // 256
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL}
