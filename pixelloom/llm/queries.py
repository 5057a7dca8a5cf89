"""One thin query an operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import ann, byte_bpe, langid, linededup, packing, simhash, store, suffixdedup, token_files, toxicity, webp

Query = Callable[[SparkSession, str], DataFrame]


_BLANKS = r"[\x20\x09-\x0D]+"
_STRIPPED = f"translate(regexp_replace(regexp_replace(line, '^{_BLANKS}', ''), '{_BLANKS}$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINES_SQL = f"""WITH lines AS (SELECT doc_id, i, all_lines[i] AS line FROM (SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents))),
keyed AS (SELECT *, {_STRIPPED} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT doc_id, i, line, k IN (SELECT k FROM common) AS gone FROM keyed),
runs AS (SELECT doc_id, gone, min(i) AS a, count(*) AS n FROM (
  SELECT doc_id, gone, i, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS g FROM flagged) GROUP BY doc_id, gone, g),
turns AS (SELECT doc_id, (CASE WHEN arg_min(gone, a) THEN '0,' ELSE '' END) || string_agg(n, ',' ORDER BY a) AS keep_runs FROM runs GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256, any_value(keep_runs) AS keep_runs
FROM flagged JOIN turns USING (doc_id) GROUP BY doc_id"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffixdedup.digests(_docs(spark, d))


def op2_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.digests(_docs(spark, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_files(spark: SparkSession, d: str) -> DataFrame:
    out = store.shared_dir(spark, "token-files")
    token_files.write(_docs(spark, d), public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_files.read(spark, out)


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, d))


def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(_docs(spark, d), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op7_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{d}/embeddings.parquet"))


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_docs(spark, d), public_tokenizers.path("word_bpe_49k.json"))


def op9_webp_media(spark: SparkSession, d: str) -> DataFrame:
    return webp.digests(_docs(spark, d))


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return linededup.digests(_docs(spark, d))


def queries() -> dict[str, Query]:
    found = (
        op1_suffix_array_dedup, op2_byte_bpe, op3_token_files, op4_simhash, op5_language_id, op6_toxicity,
        op7_nearest_neighbours, op8_packing, op9_webp_media, op10_line_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": LINES_SQL}
