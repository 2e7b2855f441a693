"""Exact dedup by content sort, with DataFrame functions only.

The normalised texts are range-partitioned by sampled splitters and sorted, so that equal contents are neighbours and
the window compares whole contents, not hashes. Splitters are drawn from the contents' heads and hashes, which are short
whatever the texts are and lead the sort, then a salt: copies of one content are spread over at most SALTS ranges, each
of which elects its best row. The few elected rows of a content are then settled by
length and SHA-256, without their texts, so the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import SPACES, order_id, parts, table

#: Ranges over which the copies of one content may spread.
SALTS = 32
#: Characters of a content by which it is sorted first.
HEAD = 16


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the row with the most code points stays, then the smallest
    doc_id (null last). A null text counts as empty, and all empty texts are one group. Of rows that agree in text and
    doc_id one is kept. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    content = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("n"),
        F.translate(text, SPACES, "").alias("content"),
    )
    # equal rows share a salt, so which of them is elected doesn't matter
    content = content.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)).cast("int"))
    content = content.withColumn("head", F.left("content", F.lit(HEAD))).withColumn("hash", F.xxhash64("content"))
    in_run = Window.partitionBy("head", "hash", "salt", "content")
    best = in_run.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    runs = (
        content.repartitionByRange(parts(docs), "head", "hash", "salt")
        .withColumn("place", F.row_number().over(best))
        .withColumn("copies", F.count(F.lit(1)).over(in_run))
        .select("doc_id", "n", "salt", "place", "copies", F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"), F.char_length("content").alias("size"))
    )
    runs = table(runs, "content-runs")
    of_content = Window.partitionBy("text_sha256", "size")
    elected = (
        runs.where("place = 1")
        .withColumn("seat", F.row_number().over(of_content.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))))
        .withColumn("keep_id", F.first("doc_id").over(of_content.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))))
        .withColumn("group_size", F.sum("copies").over(of_content))
        .select("text_sha256", "salt", "seat", "keep_id", "group_size")
    )
    return runs.join(elected, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", ((F.col("seat") == 1) & (F.col("place") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = exact_groups(docs).where("kept").select(order_id().alias("_did"), F.col("text_sha256").alias("_content"))
    # rows equal in id and content all match, and are thinned to one here
    same = Window.partitionBy("_did", "_content").orderBy(F.desc("n"))
    content = F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)
    out = docs.select(F.struct(*docs.columns).alias("row"), order_id().alias("_did"), content.alias("_content"), F.char_length(text).alias("n"))
    out = out.join(kept, ["_did", "_content"], "left_semi")
    return out.withColumn("place", F.row_number().over(same)).where("place = 1").select("row.*")
