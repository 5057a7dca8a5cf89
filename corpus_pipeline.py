"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Every stage works on all that the one before kept, and all but the last return the columns of ``documents``, whatever
further columns there are and whatever they are called: operators know a row by its block and place, not by a name.

Rows of every stage: a row is a document of its own, rows that share a doc_id or repeat another row included; a null
doc_id stays null and counts as larger than any other; an empty table gives an empty table with the same columns.
``n_chars``, where it exists, follows a text that a stage rewrites.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import langid, linededup, packing, simhash, store, suffixdedup

#: Bytes of known words that a Python worker keeps.  Executors have grown by the stages before, so this is less than the operators alone take.
WORD_CACHE = 40 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told (null text, or text without letters); the rest stay as they are."""
    return langid.identified(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), cache=WORD_CACHE)


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that at least ten documents share out of every text; null text stays null."""
    return _counted(linededup.without_common_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates: the smallest doc_id, and of one doc_id the smallest text hash.

    Null text is like text without words: all such documents are one group.
    """
    return simhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a smaller doc_id has already; a character of which a part is cut goes whole; null text stays null."""
    return _counted(suffixdedup.rewritten(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows; null text is one piece of the end id."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), cache=WORD_CACHE)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]
#: SimHash fingerprints and learned predictions have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = store.shared_dir(spark, f"pipeline-{name}")
        with store.scratch():  # what a stage stores on the way goes once its rows are written
            docs = store.staged(stage(spark, docs, sf_dir), f"pipeline-{name}", folder)
    return STAGES[-1][1](spark, docs, sf_dir)
