"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept: quality rules drop documents, exact
dedup keeps one of equal ones, SimHash keeps one of each group of near copies, mixing cuts the rest to blocks drawn by
source, and byte-level BPE turns them into token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.bpe import encode, read_ranks
from assaykit.llm.common import DOCUMENT_COLUMNS, bounded_batches, table
from assaykit.llm.exact_dedup import drop_exact_copies
from assaykit.llm.mixing import mix
from assaykit.llm.quality import keep_good
from assaykit.llm.simhash import one_of_each_component

BYTE_BPE, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return keep_good(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return one_of_each_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mix."""
    bounded_batches(spark)
    out = encode(docs, read_ranks(public_tokenizers.path(BYTE_BPE)), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixing), ("byte_bpe", tokens)]
#: SQL can't express the tokenisers, fingerprints and draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
