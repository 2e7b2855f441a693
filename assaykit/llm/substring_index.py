"""Incremental substring dedup with a log-structured index of window fingerprints.

The index is a folder of runs and a manifest. A run is an immutable table with buckets by ranges of fingerprints, a row a
bucket with the sorted fingerprints of the windows' anchors (see repeats) and the documents that hold them. A batch's
anchors are sorted into a new run, the only shuffle, which is merge-joined with all older runs bucket by bucket where
they lie; what meets is a candidate. Once a level has more than `fan_in` runs they are compacted into one of the next. Candidates are
verified by comparing whole windows of words, so a fingerprint collision costs a comparison and never a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import repeats
from assaykit.llm.common import LAST_ID, bucketed, drop_bucketed, drop_table, keyed, opened_bucketed, parts, scratch, table
from assaykit.llm.repeats import NOBODY, SPANS, Scheme, anchor_blocks, bucket_count, hits_of, joined_spans, packed, packed_marks, removable, sorted_entries, sure_hits, table_of, unpacked

#: Words in a window, and in the grams of which a window's anchor is the least.
WINDOW, GRAM = 13, 6
RUN_DDL = "bucket int, data binary"
RUN = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
HITS = pa.schema([("target", pa.int32()), ("data", pa.binary())])
HITS_DDL = "target int, data binary"
#: The block of a bucket without entries.
NOTHING = packed(*[np.zeros(0, np.int64)] * 3)
#: Rows of spans that are handed on together.
SENT_ROWS = 1000


class WindowIndex:
    """Runs of fingerprints of everything added so far, in a folder that later sessions open.

    A manifest, beside older ones, names the runs and hits that the index consists of: a row a name, with the index's settings
    and the number of rows. The hits of a batch are the documents of marks that are known to be repeated. Whatever is
    written has a new name, a manifest is written last, and runs that it no longer names are deleted after it is read back;
    so work that breaks off anywhere leaves the index as it was, and the batch can be added again. One session may
    change an index at a time. The number of buckets holds for the index's life; a bucket of all runs is read by one task.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int, runs: list[str], hits: list[str], buckets: int, fan_in: int):
        self.spark, self.folder, self.version, self.runs, self.hits, self.buckets, self.fan_in = spark, folder, version, runs, hits, buckets, fan_in
        self.scheme = Scheme("word", WINDOW, GRAM)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int, fan_in: int = 4) -> WindowIndex:
        """An empty index in a new folder, which all executors share."""
        index = cls(spark, folder, -1, [], [], buckets, fan_in)
        index._note([], [])
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> WindowIndex:
        """The index in folder, as its newest whole manifest tells; raises if a run that it names isn't there in full."""
        told = spark.read.schema(MANIFEST).json(f"{folder}/manifest-*").groupBy("version", "token", "buckets", "fan_in", "total").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("n"))
        newest = told.where("n = total").orderBy(F.desc("version"), "token").first()
        if newest is None:
            raise ValueError(f"{folder} has no whole manifest")
        named = lambda kind: [x for x in newest["names"] if x.startswith(kind)]
        index = cls(spark, folder, newest["version"], named("run-"), named("hits-"), newest["buckets"], newest["fan_in"])
        for run in index.runs:
            try:
                found = index._run(run).agg(F.count_distinct("bucket")).first()[0]
            except AnalysisException:
                found = 0
            if found != index.buckets:
                raise ValueError(f"{folder}/{run} has {found} of {index.buckets} buckets")
        return index

    def _note(self, runs: list[str], hits: list[str]) -> None:
        """Writes the next manifest, reads it back, and takes on what it says."""
        version, names, token = self.version + 1, [*runs, *hits] or [None], uuid.uuid4().hex
        path = f"{self.folder}/manifest-{version:08d}-{token}"
        self.spark.createDataFrame([(version, token, name, self.buckets, self.fan_in, len(names)) for name in names], MANIFEST).coalesce(1).write.json(path)
        if self.spark.read.schema(MANIFEST).json(path).count() != len(names):
            raise ValueError(f"{path} can't be read back")
        self.version, self.runs, self.hits = version, runs, hits

    def _run(self, name: str) -> DataFrame:
        return opened_bucketed(self.spark, f"{self.folder}/{name}", RUN_DDL, self.buckets, "bucket")

    def merge_joined(self, runs: list[str] | None = None) -> DataFrame:
        """bucket, data0, data1, ...: the blocks of runs (all, by default) side by side. Their buckets lie together, so nothing
        is shuffled."""
        runs = runs or self.runs
        met = self._run(runs[0]).withColumnRenamed("data", "data0")
        for i, run in enumerate(runs[1:], 1):
            met = met.join(self._run(run).withColumnRenamed("data", f"data{i}").hint("merge"), "bucket")
        return met

    def add(self, batch: DataFrame) -> DataFrame:
        """Sorts the batch (did, text) into a new run and merge-joins it with the others.

        Returns target, data: packed, repeated marks of the batch's documents and of older documents that share them.
        """
        targets, many = parts(batch), repeats.HOT
        blocks = table(anchor_blocks(batch, self.scheme, self.buckets, targets, alone=False), "window-blocks")

        def sort(x: pa.Table) -> pa.Table:
            return run_of(x, sorted_entries(x.column("data").to_pylist()))

        def meet(batches):
            for _, entries in entries_of(batches):
                yield table_of(hits_of(entries, targets, False, many), HITS)

        every = batch.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(NOTHING).alias("data"))
        run, met = self._new("run-0"), self._new("hits")
        bucketed(blocks.where("bucket >= 0").unionByName(every).groupBy("bucket").applyInArrow(sort, RUN_DDL), f"{self.folder}/{run}", self.buckets, "bucket")
        runs = [*self.runs, run]
        self.merge_joined(runs).mapInArrow(meet, HITS_DDL).unionByName(sure_hits(blocks)).write.parquet(f"{self.folder}/{met}")
        drop_table(blocks)
        runs, old = self.compacted(runs)
        self._note(runs, [*self.hits, met])
        for gone in old:
            drop_bucketed(self.spark, f"{self.folder}/{gone}")
        return self.spark.read.schema(HITS_DDL).parquet(f"{self.folder}/{met}")

    def _new(self, kind: str) -> str:
        return f"{kind}-{self.version + 1:08d}-{uuid.uuid4().hex[:12]}"

    def compacted(self, runs: list[str]) -> tuple[list[str], list[str]]:
        """The runs after more than `fan_in` runs of a level have become one of the next level, and those that it replaces.

        Levels grow by fan_in in size, so an entry is written anew once a level, not once a batch.
        """
        old: list[str] = []
        while True:
            of_level: dict[int, list[str]] = {}
            for run in runs:
                of_level.setdefault(int(run.split("-")[1]), []).append(run)
            level = next((k for k, x in sorted(of_level.items()) if len(x) > self.fan_in), None)
            if level is None:
                return runs, old
            merged = self._new(f"run-{level + 1}")
            bucketed(self.merge_joined(of_level[level]).mapInArrow(merge_runs, RUN_DDL), f"{self.folder}/{merged}", self.buckets, "bucket")
            old += of_level[level]
            runs = [*(r for r in runs if r not in of_level[level]), merged]

    def drop(self) -> None:
        """Deletes the runs; hits that were handed out stay."""
        for run in self.runs:
            drop_bucketed(self.spark, f"{self.folder}/{run}")


MANIFEST = "version int, token string, name string, buckets int, fan_in int, total int"


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs as one: a row a bucket, and of a mark known to be repeated a single entry."""
    for bucket, (mark, wait, n) in entries_of(batches):
        if len(mark):
            starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            low, high = np.minimum.reduceat(wait, starts), np.maximum.reduceat(wait, starts)
            # what has met was reported then and is found among the hits; entries with one did haven't met
            mark, wait, n = mark[starts], np.where(low == high, low, NOBODY), np.add.reduceat(n, starts)
        yield table_of([(bucket, packed(mark, wait, n))], RUN)


def run_of(bucket: pa.Table, entries: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_batches([table_of([(bucket.column("bucket")[0].as_py(), packed(*entries))], RUN)])


def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket of merge_joined() with its entries of all runs, sorted by mark."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row.column(0)[0].as_py(), sorted_entries([row.column(k)[0].as_py() for k in range(1, row.num_columns)])


def resolver(scheme: Scheme):
    """Of a mark's stretches, sorted by mark: which windows stand in a document with a smaller did."""

    def judged(stretches: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        stretches.sort(key=lambda x: x[1])
        first: dict[bytes, int] = {}
        whole: dict[bytes, int] = {}
        for _, did, rid, starts, content, windows in stretches:
            if whole.setdefault(content, did) < did:  # all its windows stand in that document
                spans = [[0, windows + scheme.window - 1]]
            else:
                at, spans = [0], []
                for w in content.split():
                    at.append(at[-1] + len(w) + 1)
                for i in range(windows):
                    if first.setdefault(content[at[i] : at[i + scheme.window] - 1], did) < did:
                        if spans and spans[-1][1] >= i:
                            spans[-1][1] = i + scheme.window
                        else:
                            spans.append([i, i + scheme.window])
            if spans:
                yield did, rid, (np.frombuffer(starts, np.int64)[:, None, None] + np.array(spans)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], []
        for batch in batches:
            known = batch.column("mark").to_numpy() < 0
            if known.any():
                yield batch.filter(pa.array(known)).select(["did", "rid", "data"]).cast(SPANS)
                batch = batch.filter(pa.array(~known))
            for row in zip(*(batch.column(k).to_pylist() for k in ("mark", "did", "rid", "data", "content", "windows")), strict=True):
                if row[0] != now:
                    if len(held) > 1:
                        rows += judged(held)
                    now, held = row[0], []
                held.append(row)
            if len(rows) >= SENT_ROWS:
                yield table_of(rows, SPANS)
                rows = []
        yield table_of([*rows, *(judged(held) if len(held) > 1 else ())], SPANS)

    return run


def without_repeated_windows(docs: DataFrame, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """Each document without words in windows that a document with a smaller doc_id has: doc_id, n_words, n_removed, kept.

    kept is the remaining words, joined by one space. The table goes through a new index in batches of rising doc_id, as
    it would over days, and the candidates of all batches are verified together; a window is judged against everything
    with a smaller doc_id. Null and empty texts have no words; texts of under 13 words stay whole. A null doc_id comes
    last. Rows with the same doc_id don't take words from one another. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark, rows = docs.sparkSession, keyed(docs)
    index = WindowIndex.create(spark, scratch(spark, "window-index"), bucket_count(rows, parts(docs)), fan_in)
    # rows without an id join the last batch; a quantile is a double, which may pass the largest id
    bounds = rows.where("doc_id IS NOT NULL").approxQuantile("did", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({min(int(b), LAST_ID - 1) for b in bounds})
    hits = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("did") > low)
        if high is not None:
            batch = batch.where(F.col("did") <= high)
        hits.append(index.add(batch))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    index.drop()
    return cut_windows(removable(rows, found, index.scheme, resolver(index.scheme), within=False, n=parts(docs)))


def new_documents(index: WindowIndex, batch: DataFrame, older: DataFrame) -> DataFrame:
    """A batch's documents as without_repeated_windows() gives them, judged at once against all that the index holds.

    batch and older have doc_id and text; older are the documents added before, and have smaller ids. Of them those are
    compared that share a mark with the batch, as this batch's and all earlier hits tell.
    """
    rows, old = keyed(batch), keyed(older)
    hits = index.add(rows)
    shared = marks_of(hits).select("mark").distinct()
    every = [f"{index.folder}/{name}" for name in index.hits]
    asked = marks_of(batch.sparkSession.read.schema(HITS_DDL).parquet(*every)).join(shared, "mark", "left_semi")
    # of the older texts only those that are asked for take part
    asked = table(asked.distinct(), "asked-marks")
    old = old.join(asked.select("did").distinct(), "did", "left_semi")
    found = removable(old.unionByName(rows), hits, index.scheme, resolver(index.scheme), within=False, n=parts(batch), asked=asked)
    return cut_windows(found.join(rows.select("did").distinct(), "did", "left_semi"))


def marks_of(hits: DataFrame) -> DataFrame:
    """did, mark: the hits as rows."""
    schema = pa.schema([("did", pa.int64()), ("mark", pa.int64())])

    def run(batches):
        for batch in batches:
            for x in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in unpacked(x)[:2]], schema=schema)

    return hits.where("target >= 0").select("data").mapInArrow(run, "did long, mark long")


def cut_windows(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept from the rows and spans of removable()."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, rid, text, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "rid", "text", "spans")), strict=True):
                words = text.encode().split()
                cut = joined_spans([x["data"] for x in spans or () if x["rid"] is None or x["rid"] == rid], len(words)) if len(words) >= WINDOW else []
                kept, at = [], 0
                for a, b in cut:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield table_of(out, KEPT)

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
