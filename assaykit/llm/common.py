"""What several corpus operators share: shared scratch tables, row keys, words and packed numbers."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.shared import shared_folder, table  # noqa: F401  shared_folder and table are used through here

#: The white space that separates words in every operator here (fixed value).
SPACES = " \t\n\x0b\x0c\r"
#: A word as a Java regular expression (fixed value).
WORD = "[^\\x20\\x09-\\x0D]+"
#: A null doc_id ranks after every other one.
LAST_ID = 2**63 - 1
#: The documents columns, which the pipeline's stages pass on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bucketed(df: DataFrame, path: str, n: int, *keys: str) -> DataFrame:
    """Writes df to path as a table of n buckets by the keys and reads it again.

    df has the rows of a key in one partition already, so a bucket is one sorted file; joins, groups and unions by the
    keys then need no shuffle of it.
    """
    name = bucketed_name(path)
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.read.table(name)


def bucketed_name(path: str) -> str:
    return "bucketed_" + re.sub(r"\W", "_", path.rpartition("/")[2]) + f"_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def opened_bucketed(spark: SparkSession, path: str, schema: str, n: int, *keys: str) -> DataFrame:
    """The table that bucketed() wrote to path, in a session that may not know it yet."""
    name, by = bucketed_name(path), ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.read.table(name)


def drop_bucketed(spark: SparkSession, path: str) -> None:
    """Deletes a bucketed() table and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {bucketed_name(path)}")
    _delete(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def order_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a row key: `did` orders documents, `rid` tells rows with the same id apart by their text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(order_id().alias("did"), F.xxhash64(text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def bounded_batches(spark: SparkSession, rows: int = 400) -> None:
    """Lets Arrow batches have so many rows at most, which bounds what a Python worker and the JVM hold of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def parts(df: DataFrame, floor: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts and joins record batches so that each has up to `size` bytes of text, or one row."""
    held, have = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths)
        piece = upto // size
        starts = np.r_[0, np.flatnonzero(piece[1:] != piece[:-1]) + 1, batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            new = int(upto[b - 1] - upto[a] + lengths[a])
            if held and have + new > size:
                yield pa.concat_batches(held)
                held, have = [], 0
            held.append(batch.slice(a, b - a))
            have += new
    if held:
        yield pa.concat_batches(held)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and length, one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a public finaliser with its usual constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
