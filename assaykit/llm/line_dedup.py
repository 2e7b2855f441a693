"""Line dedup with two Bloom filters.

The hashes of all lines are dealt by hash to segments. Each segment feeds two Bloom filters, one for hashes seen once and
one for hashes seen again, and names the hashes that the second one holds. Only lines with such a hash are suspected
repeats; as rows of their own they alone are shuffled as text, for exact confirmation and the choice of the first
document. The filters live inside a task, sized by its share of the lines, so nothing that grows with the data is
broadcast. Documents are shuffled once, to meet their suspected hashes, into a table with buckets by document, from
which the rest is done without moving them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bucketed, chunks, keyed, mixed, parts, scratch, table
from assaykit.llm.repeats import grouped, packed, table_of, unpacked

#: White space stripped from a line's ends, and the shortest key (code points) that can be a repeat.
STRIPPED, LEAST = b" \t\n\x0b\x0c\r", 10
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bits of each filter for each hash it may get, bits set for a hash, hashes of a segment.
BITS, PROBES, SEGMENT = 12, 4, 1 << 20


def line_keys(text: str) -> list[bytes]:
    """The keys of the lines, in UTF-8, those that are too short as empty ones."""
    keys = [line.strip(STRIPPED) for line in text.encode().translate(LOWER).split(b"\n")]
    # a code point has up to four bytes
    return [k if len(k) >= 4 * LEAST or len(k) >= LEAST and (k.isascii() or len(k.decode()) >= LEAST) else b"" for k in keys]


class Bloom:
    """A Bloom filter for 64-bit hashes."""

    def __init__(self, items: int):
        self.size = np.uint64(max(64, items * BITS))
        self.bits = np.zeros(int(self.size) // 8 + 1, np.uint8)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = mixed(hashes) | np.uint64(1)
        for k in range(PROBES):
            yield mixed(hashes + np.uint64(k) * step) % self.size

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


BLOCKS = pa.schema([("segment", pa.int32()), ("data", pa.binary())])
LINES = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_lines", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def line_hashes(rows: DataFrame) -> DataFrame:
    """did, rid, doc_id, n_lines, and the hashes of the distinct keys that are long enough."""

    def run(batches):
        for batch in chunks(batches):
            out = []
            for did, rid, doc_id, text in zip(*(batch.column(k).to_pylist() for k in ("did", "rid", "doc_id", "text")), strict=True):
                keys = line_keys(text)
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in {*keys} if k], np.uint64)
                out.append((did, rid, doc_id, len(keys), hashes.view(np.int64)))
            yield table_of(out, LINES)

    return rows.mapInArrow(run, "did long, rid long, doc_id long, n_lines long, hashes array<long>")


def suspected(lines: DataFrame, n: int, count: int) -> DataFrame:
    """Distinct hashes that the second filter of their segment holds: all that repeat, and a few others."""
    segments = max(n, -(-count // SEGMENT))

    def blocks(batches):
        for batch in batches:
            hashes = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(hashes):
                continue
            # a hash twice in a batch is sent twice at most: that is all the filters need
            hashes = np.sort(hashes)
            keep = np.ones(len(hashes), bool)
            keep[2:] = hashes[2:] != hashes[:-2]
            hashes = hashes[keep]
            segment = (hashes >> np.uint64(32)).astype(np.int64) * segments >> 32
            cuts = np.flatnonzero(segment[1:] != segment[:-1]) + 1
            rows = [(int(s), packed(h.view(np.int64))) for s, h in zip(segment[np.r_[0, cuts]], np.split(hashes, cuts), strict=True)]
            yield table_of(rows, BLOCKS)

    def filters(batches):
        for _, held in grouped(batches, "segment"):
            all_blocks = [unpacked(x)[0].view(np.uint64) for b in held for x in b.column("data").to_pylist()]
            size = sum(map(len, all_blocks))
            once, twice = Bloom(size), Bloom(size)
            for hashes in all_blocks:
                new, times = np.unique(hashes, return_counts=True)
                twice.add(new[(times > 1) | once.has(new)])
                once.add(new)
            found = [np.unique(h[twice.has(h)]) for h in all_blocks]
            found = np.unique(np.concatenate(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["hash"])

    dealt = lines.select("hashes").mapInArrow(blocks, "segment int, data binary")
    return dealt.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(filters, "hash long")


KEYS = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("key", pa.binary()), ("places", pa.list_(pa.int32()))])


def suspected_lines(docs: DataFrame) -> DataFrame:
    """did, rid, key, places: each suspected key of a document and where its lines are. docs has text and hashes."""

    def run(batches):
        for batch in chunks(batches):
            out = []
            for did, rid, text, hashes in zip(*(batch.column(k).to_pylist() for k in ("did", "rid", "text", "hashes")), strict=True):
                wanted, places = {h % (1 << 64) for h in hashes}, {}
                for i, key in enumerate(line_keys(text)):
                    if key:
                        places.setdefault(key, []).append(i)
                out += [(did, rid, key, at) for key, at in places.items() if xxhash.xxh3_64_intdigest(key) in wanted]
            yield table_of(out, KEYS)

    return docs.select("did", "rid", "text", "hashes").mapInArrow(run, "did long, rid long, key binary, places array<int>")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Each document without lines that a document with a smaller doc_id has: doc_id, n_lines, n_dropped, kept.

    A line's key is the line stripped of white space, A-Z lower-cased; keys of under 10 code points never count. kept is
    the other lines, joined by a line feed. A null or empty text is one empty line. A null doc_id comes last, and all
    null ids count as one document, as rows with the same doc_id do. Lines equal in key within one document never drop each
    other; texts of any length are judged whole. Other columns are ignored; an empty table gives an empty result.
    """
    n, rows = parts(docs), keyed(docs)
    lines = table(line_hashes(rows), "line-hashes")
    count = lines.agg(F.sum(F.size("hashes"))).first()[0] or 0
    hashes = lines.select("did", "rid", F.explode("hashes").alias("hash")).join(table(suspected(lines, n, count), "line-suspects"), "hash", "left_semi")
    asked = hashes.groupBy("did", "rid").agg(F.collect_set("hash").alias("hashes"))
    held = bucketed(rows.repartition(n, "did", "rid").join(asked, ["did", "rid"], "left"), scratch(docs.sparkSession, "line-docs"), n, "did", "rid")
    found = table(suspected_lines(held.where("hashes IS NOT NULL")), "line-keys")
    # tables of their own, so that the joins shuffle both sides as they are and a very common line can be split
    first = table(found.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last"), "line-firsts")
    # a repeated row's lines come once for each row, which changes nothing
    gone = found.join(first, "key").where("did > first").groupBy("did", "rid").agg(F.flatten(F.collect_list("places")).alias("gone"))
    cut = held.join(gone, ["did", "rid"], "left")

    def run(batches):
        for batch in chunks(batches):
            out = []
            for doc_id, text, gone in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "gone")), strict=True):
                all_lines = text.split("\n")
                drop = set(gone or ())
                kept = [line for i, line in enumerate(all_lines) if i not in drop]
                out.append((doc_id, len(all_lines), len(drop), "\n".join(kept)))
            yield table_of(out, KEPT)

    return cut.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
