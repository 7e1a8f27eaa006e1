"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.session import reachable



def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which is never copied."""
    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.storage import new_folder
    from tessera.llm.token_files import read_token_files, write_token_files

    docs = _documents(spark, sf_dir)
    return read_token_files(write_token_files(docs, new_folder(spark, "tokens"), vocabulary("byte_bpe_50k.json"), 2))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentence_pieces import round_trip

    return round_trip(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), seed=1)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii, pii_digest

    return pii_digest(find_pii(_documents(spark, sf_dir)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_log")
    return judge(_documents(spark, sf_dir, "doc_id", "text", "lang")).select(*columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secret_scan import find_secrets, secret_digest

    return secret_digest(find_secrets(_documents(spark, sf_dir)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    return dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign_shards

    return assign_shards(_documents(spark, sf_dir))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_duplicates

    return near_duplicates(reachable(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES: dict[str, str] = {
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line,
         translate(trim(l[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) t(i)),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last_doc > doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(last_doc > doc_id, false)), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id""",
    "op9_sharding": f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, '-'), '|', coalesce(text, '-'))), 1, 15))::BIGINT AS h
  FROM documents),
p AS (SELECT doc_id, n_bytes, h, d, h >> (60 - d) AS bucket FROM r, range(0, 61) t(d)),
s AS (
  SELECT d, bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM p GROUP BY d, bucket HAVING sum(n_bytes) <= {64 << 20} OR min(h) = max(h)),
f AS (SELECT p.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id, h ORDER BY d) AS k FROM p JOIN s USING (d, bucket))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(bucket), d::INTEGER, '0') END AS shard, d AS depth,
       shard_bytes, shard_docs, shard_bytes <= {64 << 20} AS fits
FROM f WHERE k = 1""",
}
