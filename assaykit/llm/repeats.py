"""Repeated windows of consecutive symbols (words or bytes) between documents, found exactly in two rounds.

Round 1 looks at anchors: of the `width` grams of `gram` symbols inside a window of gram + width - 1 symbols, the one of
least hash. Equal windows have equal anchors, so a window whose anchor occurs once is no repeat. Anchors travel as packed
blocks, a few bytes each. Round 2 sends only stretches of windows that share a repeated anchor, as text, to that
anchor's task, where whole windows are compared. What a task can settle by itself it settles before the shuffle: in
round 1 an anchor of several documents of a batch is sent once, in round 2 a stretch that several documents of a batch
have is sent for the first of them. So a very common passage puts one row a batch on its task, not one a document. An
anchor that very many documents have in different surroundings isn't kept together at all: its windows go out one by one,
each to the task of its own content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import LAST_ID, chunks, mixed, ranges, table

#: Symbols hashed at once; longer texts go in overlapping pieces. Bytes of text whose anchors are packed together.
PIECE, BATCH_BYTES = 1 << 17, 16 << 20
#: Bytes of stretches that are combined before they are sent.
SENT_TOGETHER = 8 << 20
#: Documents from which on an anchor's windows go out one by one, and how many anchors do, those of most documents. An anchor
#: kept together thus has at most so many rows, or a 500,000th of all, and the list of the others is 4 MB at most.
HOT, MOST_HOT = 2_000, 500_000
#: Stands for a did where a mark is known to be repeated and no document waits for an answer.
NOBODY = -(2**63)
#: The target of rows that tell hot anchors; the first mark of a single window's task.
HOT_TARGET, OF_WINDOW = -1, 1 << 61
#: Bytes of text for a bucket of anchors, about, and most buckets of a table (Spark's own limit).
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64
BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64))


class Scheme:
    """What a symbol is, and how long windows and grams are."""

    def __init__(self, kind: str, window: int, gram: int):
        self.kind, self.window, self.gram, self.width = kind, window, gram, window - gram + 1

    def symbols(self, text: str):
        data = text.encode()
        return data.split() if self.kind == "word" else data

    def values(self, symbols) -> np.ndarray:
        if self.kind == "byte":
            return BYTE_VALUES[np.frombuffer(symbols, np.uint8)]
        return np.array(list(map(WORDS.__getitem__, symbols)), U64)

    def content(self, symbols, a: int, b: int) -> bytes:
        return b" ".join(symbols[a:b]) if self.kind == "word" else symbols[a:b]


class Words(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, PIECE + 1024)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    n = len(values) - gram + 1
    if n < 1:
        return np.zeros(0, U64)
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[gram:] - total[:n]) * down[:n])


def anchor_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window the place of its anchor: the least hash (its upper half), the leftmost among equals."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = hashes & U64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=U64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: have - width], least[width - have :])
    return (least & U64(0xFFFFFFFF)).astype(np.int64)


def pieces(texts: list[str], scheme: Scheme) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of about PIECE symbols: (symbols by document of the piece, document, place in it) and, by window,
    the anchor's fingerprint and place. Yields symbols, doc, start, anchor, mark, where doc counts within `texts`."""
    held, size = [], 0
    for i, text in enumerate(texts):
        symbols = scheme.symbols(text)
        if len(symbols) < scheme.window:
            continue
        for a in range(0, len(symbols) - scheme.window + 1, PIECE):
            held.append((i, a, symbols))
            size += min(len(symbols) - a, PIECE + scheme.window - 1)
            if size >= PIECE or len(held) >= 50_000:
                yield _piece(held, scheme)
                held, size = [], 0
    if held:
        yield _piece(held, scheme)


def _piece(held: list, scheme: Scheme):
    cut = [(s if a == 0 and len(s) <= PIECE + scheme.window - 1 else s[a : a + PIECE + scheme.window - 1]) for _, a, s in held]
    lengths = np.array([len(s) for s in cut], np.int64)
    joined = b"".join(cut) if scheme.kind == "byte" else [w for s in cut for w in s]
    hashes = gram_hashes(scheme.values(joined), scheme.gram)
    anchor = anchor_places(hashes, scheme.width)
    # least hashes crowd at the low end, so fingerprints are spread anew: buckets are ranges of them
    marks = mixed(hashes) >> U64(16)
    first = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - scheme.window + 1, 0)
    at = ranges(first, windows)
    return {i: s for i, _, s in held}, np.repeat(np.array([i for i, _, _ in held]), windows), at - np.repeat(first - np.array([a for _, a, _ in held]), windows), anchor[at] - at, marks[anchor[at]]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes; the first is sorted and goes as differences."""
    out = [np.array([len(arrays[0])], np.int64).tobytes()]
    for k, a in enumerate(arrays):
        a = a.astype(np.int64)
        a = np.diff(a, prepend=0) if k == 0 else a
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    if not n:
        return [np.zeros(0, np.int64)] * 3
    out = [np.ascontiguousarray(np.frombuffer(raw[8 + k : 8 + k + 8 * n], np.uint8).reshape(8, n).T).view(np.int64).ravel() for k in range(0, len(raw) - 8, 8 * n)]
    return [np.cumsum(out[0]), *out[1:]]


def answers(dids: np.ndarray, marks: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """Documents and their marks, packed for each of so many targets that the documents are dealt to; rows without an id,
    which may be many, by their marks."""
    target = (mixed(np.where(dids == LAST_ID, marks, dids).astype(U64)) % U64(targets)).astype(np.int64)
    order = np.lexsort((dids, target))
    for t, a, z in zip(*_cuts(target[order]), strict=True):
        at = order[a:z]
        yield t, packed(dids[at], marks[at])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def bucket_count(rows: DataFrame, floor: int) -> int:
    """Buckets of anchors for the texts of rows, so that each fits into a task whatever the session's partitions are."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(floor, min(MOST_BUCKETS, size // BUCKET_BYTES))


MARKS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def anchor_blocks(docs: DataFrame, scheme: Scheme, buckets: int, targets: int, alone: bool) -> DataFrame:
    """Round 1, before the shuffle: rows bucket, data.

    From 0 on: a block of the bucket, packed marks with their documents' dids (NOBODY: the mark is known to be repeated and
    nobody waits for an answer) and the number of documents that have them. Below: packed dids with marks of theirs that are repeated for sure, for the target
    -1 - bucket. alone: whether a mark that one document has twice is a repeat.
    """

    def run(batches):
        for batch in chunks(batches, size=BATCH_BYTES):
            dids = batch.column("did").to_numpy(zero_copy_only=False)
            docs_of, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, doc, start, anchor, mark in pieces([t or "" for t in batch.column("text").to_pylist()], scheme):
                new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] + anchor[1:] != start[:-1] + anchor[:-1])]
                docs_of.append(dids[doc[new]])
                marks.append(mark[new].astype(np.int64))
            did, mark = np.concatenate(docs_of), np.concatenate(marks)
            if not len(mark):
                continue
            order = np.lexsort((did, mark))
            did, mark = did[order], mark[order]
            group = np.cumsum(np.r_[True, mark[1:] != mark[:-1]]) - 1
            starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            ends = np.r_[starts[1:], len(mark)]
            twice = (ends - starts > 1) if alone else did[starts] != did[ends - 1]
            sure = twice[group]
            rows = [(-1 - t, x) for t, x in answers(did[sure], mark[sure], targets)]
            wait = np.where(twice, NOBODY, did[starts])
            lead = mark[starts]
            bucket = (lead >> 16) * buckets >> 32
            for b, a, z in zip(*_cuts(bucket), strict=True):
                rows.append((b, packed(lead[a:z], wait[a:z], (ends - starts)[a:z])))
            yield table_of(rows, MARKS)

    return docs.select("did", "text").mapInArrow(run, "bucket int, data binary")


def _cuts(sorted_keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(sorted_keys):
        return [], [], []
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return sorted_keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_keys)]


def sorted_entries(blocks: list[bytes]) -> list[np.ndarray]:
    """mark, wait and n of all blocks, sorted by mark; blocks are sorted themselves, so a stable sort merges them."""
    both = [unpacked(x) for x in blocks]
    mark, wait, n = (np.concatenate([x[k] for x in both]) for k in range(3))
    order = np.argsort(mark, kind="stable")
    return [mark[order], wait[order], n[order]]


def repeated_marks(mark: np.ndarray, wait: np.ndarray, n: np.ndarray, alone: bool, many: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of one bucket's entries, sorted by mark: the (did, mark) that wait and whose mark stands in more than one entry or
    is known; and the marks of more than `many` documents with their numbers."""
    if not len(mark):
        return (wait, mark), (mark, n)
    starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
    sizes = np.diff(np.r_[starts, len(mark)])
    low, high, total = np.minimum.reduceat(wait, starts), np.maximum.reduceat(wait, starts), np.add.reduceat(n, starts)
    # entries of rows with one did are a repeat only if a document's own count
    hit = np.repeat((low == NOBODY) | (sizes > 1) & ((low != high) | alone), sizes) & (wait != NOBODY)
    hot = total > many
    return (wait[hit], mark[hit]), (mark[starts][hot], total[hot])


def grouped(batches, key: str, loose: bool = False) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The batches of a sorted stream, cut by key, each key's together; loose: but for keys below 0."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        for k, a, b in zip(*_cuts(keys), strict=True) if len(keys) else ():
            if held and (k != now or loose and k < 0):
                yield now, held
                held = []
            now = k
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


HITS = pa.schema([("target", pa.int32()), ("data", pa.binary())])


def hits_of(entries: list[np.ndarray], targets: int, alone: bool, many: int) -> list[tuple[int, bytes]]:
    """Rows target, data of one bucket: packed dids and repeated marks, and for HOT_TARGET hot marks and their documents."""
    found, hot = repeated_marks(*entries, alone, many)
    return [*answers(*found, targets), *([(HOT_TARGET, packed(*hot))] if len(hot[0]) else [])]


def sure_hits(blocks: DataFrame) -> DataFrame:
    """Rows target, data of the answers that anchor_blocks() gave by itself."""
    return blocks.where("bucket < 0").select((-1 - F.col("bucket")).alias("target"), "data")


def matched_anchors(blocks: DataFrame, n: int, buckets: int, alone: bool) -> DataFrame:
    """Round 1, after the shuffle to the buckets: rows target, data (packed dids and repeated marks)."""
    many = HOT

    def run(batches):
        for _, held in grouped(batches, "bucket"):
            yield table_of(hits_of(sorted_entries([x for b in held for x in b.column("data").to_pylist()]), n, alone, many), HITS)

    by_bucket = blocks.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(run, "target int, data binary").unionByName(sure_hits(blocks))


def hot_marks(hits: DataFrame) -> np.ndarray:
    """The hot marks, sorted: those of most documents, MOST_HOT at most."""
    schema = pa.schema([("mark", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for x in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in unpacked(x)[:2]], schema=schema)

    told = hits.where(F.col("target") == HOT_TARGET).select("data").mapInArrow(run, "mark long, n long")
    told = told.groupBy("mark").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "mark").limit(MOST_HOT)
    return np.sort(np.array([r["mark"] for r in told.collect()], np.int64))


ASKED = pa.schema([("did", pa.int64()), ("spot", pa.int64()), ("marks", pa.binary())])
def spot() -> Column:
    """Tells rows of one did apart that have no id: they are as many as they like, and each is a key of its own."""
    return F.when(F.col("did") == LAST_ID, F.col("rid")).otherwise(F.lit(0).cast("long"))


def asked_marks(hits: DataFrame, n: int, nameless: bool = False) -> DataFrame:
    """did, spot, marks (distinct, sorted, as bytes): a row a document, from the packed answers of its target; if nameless, of
    rows without an id instead, one for each target.

    Tasks tell the rows apart and set spot to 0: as filters or literals of the plan these would be inferred for one of two
    uses of the texts, which would then be shuffled twice.
    """

    def run(batches):
        for _, held in grouped(batches, "target"):
            both = [unpacked(x) for b in held for x in b.column("data").to_pylist()]
            did, mark = (np.concatenate([x[k] for x in both]) for k in (0, 1))
            did, mark = did[(did == LAST_ID) == nameless], mark[(did == LAST_ID) == nameless]
            if not len(did):
                continue
            order = np.lexsort((mark, did))
            did, mark = did[order], mark[order]
            new = np.r_[True, (did[1:] != did[:-1]) | (mark[1:] != mark[:-1])]
            did, mark = did[new], mark[new]
            yield table_of([(d, 0, mark[a:z].tobytes()) for d, a, z in zip(*_cuts(did), strict=True)], ASKED)

    return hits.where("target >= 0").repartition(n, "target").sortWithinPartitions("target").mapInArrow(run, "did long, spot long, marks binary")


def own_marks(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """rid, mark: the marks of each text."""
    schema = pa.schema([("rid", pa.int64()), ("mark", pa.int64())])

    def run(batches):
        for batch in chunks(batches, size=BATCH_BYTES):
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for _, doc, start, anchor, mark in pieces([t or "" for t in batch.column("text").to_pylist()], scheme):
                new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] + anchor[1:] != start[:-1] + anchor[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(rids[doc[new]]), pa.array(mark[new].astype(np.int64))], schema=schema)

    return docs.select("rid", "text").mapInArrow(run, "rid long, mark long")


def packed_marks(asked: DataFrame) -> DataFrame:
    """did, spot, marks as bytes, from an array of them."""

    def run(batches):
        for batch in batches:
            marks = [np.sort(np.array(m, np.int64)).tobytes() for m in batch.column("marks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("spot"), pa.array(marks, pa.binary())], names=["did", "spot", "marks"])

    return asked.mapInArrow(run, "did long, spot long, marks binary")


def asked_of_rows(docs: DataFrame, hits: DataFrame, n: int, scheme: Scheme, asked: DataFrame | None) -> DataFrame:
    """did, spot, marks: what each row is asked for, by the hits or, where they are given, by the rows (did, mark) of asked.

    A row without an id finds its marks by joining its own ones with those asked of such rows.
    """
    if asked is None:
        real = asked_marks(hits, n)
    else:
        real = packed_marks(asked.where(F.col("did") != LAST_ID).withColumn("spot", F.lit(0).cast("long")).groupBy("did", "spot").agg(F.collect_set("mark").alias("marks")))
    without = docs.where("doc_id IS NULL")
    if without.isEmpty():
        return real
    if asked is None:
        numbers = lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], ["mark"]) for b in batches for x in b.column("marks").to_pylist())
        single = asked_marks(hits, n, nameless=True).select("marks").mapInArrow(numbers, "mark long")
    else:
        single = asked.where(F.col("did") == LAST_ID).select("mark")
    # tables of their own, so that both sides are plain shuffles and a very common mark can be split
    wanted = table(single.distinct(), "marks-without-id")
    found = table(own_marks(without, scheme), "own-marks").join(wanted, "mark").groupBy("rid").agg(F.collect_set("mark").alias("marks"))
    return real.unionByName(packed_marks(found.select(F.lit(LAST_ID).alias("did"), F.col("rid").alias("spot"), "marks")))


STRETCHES = pa.schema([("mark", pa.int64()), ("content", pa.binary()), ("did", pa.int64()), ("rid", pa.int64()), ("anchor", pa.int32()), ("windows", pa.int32()), ("data", pa.binary())])
STRETCH_DDL = "mark long, content binary, did long, rid long, anchor int, windows int, data binary"


def stretches(docs: DataFrame, scheme: Scheme, within: bool, hot: np.ndarray) -> DataFrame:
    """Round 2, before the shuffle. docs: did, rid, text, marks (those that are repeated, as bytes).

    Rows: a stretch of windows with one repeated anchor (mark and content; the anchor's distance from its start, the
    number of windows, in data the places in did and rid where it starts), or, with a negative mark, in data spans of
    symbols of did and rid to remove for sure. A hot mark's windows are a row each, with a mark made of their content, from
    OF_WINDOW on. within: whether a window that stands earlier in the same document counts.
    """

    def flush(held: dict) -> pa.RecordBatch:
        rows, sure = [], {}
        for (content, mark, anchor, windows), found in held.items():
            found.sort()
            first, asked = found[0][:2] if within else found[0][:1], {}
            for did, start, rid in found:
                if ((did, start) if within else (did,)) == first:
                    asked.setdefault((did, rid), []).append(start)
                else:
                    sure.setdefault((did, rid), []).append((start, start + windows + scheme.window - 1))
            for (did, rid), starts in asked.items():
                rows.append((mark, content, did, rid, anchor, windows, np.array(starts, np.int64).tobytes()))
        for (did, rid), spans in sure.items():
            rows.append((-1 - (did ^ rid) % 1_000_003, None, did, rid, None, None, np.array(spans, np.int64).tobytes()))
        return table_of(rows, STRETCHES)

    def run(batches):
        held, size = {}, 0
        for batch in chunks(batches):
            dids, rids = batch.column("did").to_pylist(), batch.column("rid").to_pylist()
            marks = [np.frombuffer(m, np.int64) for m in batch.column("marks").to_pylist()]
            for symbols, doc, start, anchor, mark in pieces([t or "" for t in batch.column("text").to_pylist()], scheme):
                number = {d: i for i, d in enumerate(symbols)}
                local = np.array([number[d] for d in np.unique(doc).tolist()], U64)
                codes = np.sort(np.concatenate([np.array([number[d]], U64) << U64(48) | marks[d].astype(U64) for d in symbols]))
                local = np.repeat(local, np.unique(doc, return_counts=True)[1])
                code = local << U64(48) | mark
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                place = start + anchor
                new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
                first = np.flatnonzero(new)
                count = np.diff(np.r_[first, len(doc)])
                first, count = first[hit[first]], count[hit[first]]
                apart = np.isin(mark[first].astype(np.int64), hot, kind="sort") if len(hot) else np.zeros(len(first), bool)
                for d, s, a, m, c, single in zip(doc[first].tolist(), start[first].tolist(), anchor[first].tolist(), mark[first].tolist(), count.tolist(), apart.tolist(), strict=True):
                    if single:
                        for k in range(c):
                            content = scheme.content(symbols[d], s + k, s + k + scheme.window)
                            own = OF_WINDOW | xxhash.xxh3_64_intdigest(content) >> 3
                            held.setdefault((content, own, a - k, 1), []).append((dids[d], s + k, rids[d]))
                        size += c * len(content)
                        continue
                    content = scheme.content(symbols[d], s, s + c + scheme.window - 1)
                    held.setdefault((content, m, a, c), []).append((dids[d], s, rids[d]))
                    size += len(content)
                if size >= SENT_TOGETHER:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, STRETCH_DDL)


SPANS = pa.schema([("did", pa.int64()), ("rid", pa.int64()), ("data", pa.binary())])
SPAN_DDL = "did long, rid long, data binary"


def joined_spans(spans: list[bytes], n: int) -> list[tuple[int, int]]:
    """Spans of symbols, sorted and joined where they touch, within 0..n."""
    if not spans:
        return []
    pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in spans])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    cuts = np.flatnonzero(pairs[1:, 0] > ends[:-1]) + 1
    firsts, lasts = np.r_[0, cuts], np.r_[cuts - 1, len(pairs) - 1]
    return [(max(a, 0), min(b, n)) for a, b in zip(pairs[firsts, 0].tolist(), ends[lasts].tolist(), strict=True)]


def whole_copies(docs: DataFrame) -> DataFrame:
    """did and spot of documents whose whole text stands in a document with a smaller did: all their windows are repeats.

    Ids with several texts are left to the windows themselves. The first of each text are a table of their own, so that
    the join can split a text of very many documents.
    """
    thin = docs.select("did", spot().alias("spot"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    thin = thin.groupBy("did", "spot").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).where("digest = other").select("did", "spot", "digest")
    first = table(thin.groupBy("digest").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-of-text")
    return thin.join(first, "digest").where("did > first").select("did", "spot")


Resolver = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def removable(docs: DataFrame, hits: DataFrame, scheme: Scheme, resolve: Resolver, within: bool, n: int, asked: DataFrame | None = None) -> DataFrame:
    """docs (did, rid, doc_id, text) with `spans`: an array of (rid, data) with spans of symbols to remove.

    A whole copy's span is everything. The documents with repeated marks go through round 2. hits is a table;
    asked (did, mark) tells the documents with repeated marks where the hits don't. Rows are dealt by did, those without an
    id by their text too.
    """
    copies, hot = table(whole_copies(docs), "whole-copies"), hot_marks(hits)
    keys = ["did", "spot"]
    asked = asked_of_rows(docs, hits, n, scheme, asked).join(copies, keys, "left_anti")
    dealt = docs.withColumn("spot", spot()).repartition(n, *keys)
    found = stretches(dealt.join(asked, keys).select("did", "rid", "doc_id", "text", "marks"), scheme, within, hot)
    spans = found.repartition(n, "mark").sortWithinPartitions("mark").mapInArrow(resolve, SPAN_DDL).withColumn("spot", spot())
    everything = np.array([0, 2**62], np.int64).tobytes()
    spans = spans.unionByName(copies.select("did", F.lit(None).cast("long").alias("rid"), F.lit(everything).alias("data"), "spot"))
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("rid", "data")).alias("spans"))
    return dealt.join(spans, keys, "left").select("did", "rid", "doc_id", "text", "spans")
