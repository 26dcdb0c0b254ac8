"""From raw documents to training tokens: quality rules, near-duplicates, repeated passages, source mix, token ids.

Every stage takes all rows of the one before and, but for the last, returns the columns of `documents`, whatever else stands in the table and however it is named.
Null text counts as empty. An empty table stays empty at every stage. Each stage's docstring says what becomes of empty texts, ties, repeated rows and rows without a doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, mixing, quality, simhash, suffix_dedup
from parley.llm.common import new_folder


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands. Empty texts fail; each row is judged by its own text, so repeated rows and rows without a doc_id fare like all others."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by near fingerprints or by five-word shingles of similarity 0.8 or more. Empty texts are one group. doc_id
    should be unique: rows that repeat the one that stays, stay with it, and rows without a doc_id, whose place in a group can't be told, stay too."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that one of smaller doc_id holds. Rows of equal doc_id don't cut each other; rows without one lose nothing and cut nothing. A text may end empty."""
    return _measured(suffix_dedup.remove_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, the one at the budget cut to it. Empty texts have nothing to take and go; a null source is a source; repeated rows and rows without a doc_id are taken each for itself."""
    return _measured(mixing.mix(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of each row, in as many rows as came; the ids were decoded again for decoded_sha256."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.coded(docs, path, public_tokenizers.PATTERN, ids=True)


STAGES = [("quality rules", keep_good), ("near-duplicates", drop_near_copies), ("repeated passages", cut_repeats), ("source mix", mix_sources), ("token ids", tokenise)]

#: No stage but the mix can be put in SQL; tests/llm/test_pipeline.py compares each stage with brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over `documents`, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
