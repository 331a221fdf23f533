"""Columns of the operators' queries that SQL can state, as queries of their own beside that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, langid, pii, secrets, sharding, token_counts

SHARDS = 40


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3_feistel_shards(spark, sf_dir).select("doc_id", "size", "law")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard and its slots: gapless from 0 if there are as many as the largest and one."""
    found = sharding.op3_feistel_shards(spark, sf_dir)
    return found.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("slot").alias("least"), F.max("slot").alias("most"), F.countDistinct("slot").alias("slots"))


def languages_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op2_rank_order_languages(spark, sf_dir).select("doc_id", (F.col("lang_pred") == langid.UNKNOWN).alias("unknown"), F.col("score").between(0, 1).alias("in_range"))


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op1_weak_supervision_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_phone")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8_crf_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids decode to the text itself."""
    return bpe.op9_bpe_round_trip(spark, sf_dir).select("doc_id", "decoded_sha256")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op10_pre_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes") + 1).alias("bounded"), (F.col("over_limit") == (F.col("n_tokens") > token_counts.LIMIT)).alias("flagged"))


def _found(pattern: str, group: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all(t, '{quoted}', {group})"


def _count(found: str, test: str) -> str:
    return f"CAST(len(list_filter({found}, lambda x: {test})) AS BIGINT)"


TEXTS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
SQL = {
    "shard_rows": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, 'rows' AS law FROM documents",
    "shard_counts": f"""WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(range AS INTEGER) AS shard, n // {SHARDS} + CASE WHEN range < n % {SHARDS} THEN 1 ELSE 0 END AS rows FROM range({SHARDS}), n)
 SELECT shard, CAST(rows AS BIGINT) AS rows, CAST(0 AS BIGINT) AS least, CAST(rows - 1 AS BIGINT) AS most, CAST(rows AS BIGINT) AS slots FROM s WHERE rows > 0""",
    "languages_unknown": "SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\\p{L}') AS unknown, true AS in_range FROM documents",
    "personal_data_counts": f"""{TEXTS} SELECT doc_id, {_count(_found("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"), "true")} AS n_email,
 {_count(_found("[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"), "len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0")} AS n_ip,
 {_count(_found("[+][0-9][ ().0-9-]+[0-9]"), "len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15")} AS n_phone FROM d""",
    "secret_counts": f"""{TEXTS} SELECT doc_id, {_count(_found('''(?:(?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)''', 1), "len(x) >= 12")} AS n_assign,
 {_count(_found("AKIA[A-Z0-9]+"), "len(x) >= 18")} AS n_access, {_count(_found("[0-9a-f]+"), "len(x) >= 16")} AS n_hex FROM d""",
    "bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "token_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, true AS bounded, true AS flagged FROM documents",
}
QUERIES = {f.__name__: f for f in (shard_rows, shard_counts, languages_unknown, personal_data_counts, secret_counts, bpe_decoded, token_bytes)}
