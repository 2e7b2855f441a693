"""Repeated byte strings across documents by blockwise suffix sorting.

A suffix bucket is the set of all windows with one cover position's content (see repeats: in every occurrence of a
window the cover position stands at the same distance from its start). Buckets go to tasks and are sorted a block of
them at a time; a bucket of very many windows is dealt by whole windows (see repeats), so memory is bounded by the block. Within a block the suffixes and the reversed prefixes at the cover
positions are ranked once; windows are then told apart, however long their common prefixes, by the two ranks of their
cover position alone. The cover is content-defined instead of the arithmetic difference cover: see the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaykit.llm.common import keyed, parts, table
from assaykit.llm.repeats import SPANS, Scheme, anchor_blocks, bucket_count, grouped, joined_spans, matched_anchors, removable, table_of

#: Bytes in a string, and in the grams of which its cover position begins the least.
WINDOW, GRAM = 100, 50
#: Stretches ranked together (whole buckets, so a block may have a bucket's more), and stretches whose contexts are cut at once.
BLOCK, CUT = 6_000, 2_000


def ranked(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes sorted within equal `first`: their order, and each one's common prefix with the one before it
    (-1 where `first` differs)."""
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((*keys.T[::-1], first))
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return order, np.r_[-1, np.where(first[order[1:]] == first[order[:-1]], common, -1)]


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """A number for each row, equal for rows that agree in `length` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def contexts(data: np.ndarray, base: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each cover position on, and those before it in reverse, filled up with zeros."""
    right, left = np.zeros((len(base), pad), np.uint8), np.zeros((len(base), pad), np.uint8)
    after, before = np.arange(pad), np.arange(1, pad + 1)
    for i in range(0, len(base), CUT):
        part = slice(i, i + CUT)
        at = (base[part] + anchor[part])[:, None]
        right[part] = np.where(after < (lengths[part] - anchor[part])[:, None], data[np.minimum(at + after, len(data) - 1)], 0)
        left[part] = np.where(before <= anchor[part][:, None], data[np.maximum(at - before, 0)], 0)
    return right, left


def block_spans(marks: list[int], contents: list[bytes], anchor: np.ndarray, windows: np.ndarray, did: np.ndarray, start: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each stretch of a block, spans of its document's bytes in windows that stand earlier."""
    pad = (window + 7) // 8 * 8
    lengths = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents) + bytes(1), np.uint8)
    base = np.cumsum(lengths) - lengths
    right, left = contexts(data, base, lengths, anchor, pad)
    group = np.unique(np.array(marks, np.int64), return_inverse=True)[1]
    r_order, r_common = ranked(group, right)
    l_order, l_common = ranked(group, left)
    # a window's place in the order of all text is its cover position's, as equal windows have it at equal distances
    place = start + anchor
    by_place = np.lexsort((place, did))
    turn = np.empty(len(did), np.int64)
    turn[by_place] = np.cumsum(np.r_[0, (did[by_place][1:] != did[by_place][:-1]) | (place[by_place][1:] != place[by_place][:-1])])
    found: list[list[tuple[int, int]]] = [[] for _ in contents]
    for distance in range(int(anchor.max()), max(-1, int((anchor - windows).min())), -1):
        rows = np.flatnonzero((anchor >= distance) & (anchor - distance < windows))
        if len(rows) < 2:
            continue
        pair = classes(r_order, r_common, window - distance)[rows] * (len(contents) + 1) + classes(l_order, l_common, distance)[rows]
        order = np.lexsort((turn[rows], pair))
        head = np.r_[True, pair[order][1:] != pair[order][:-1]]
        earliest = turn[rows][order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        for k in rows[order[turn[rows][order] > earliest]].tolist():
            a = int(place[k]) - distance
            if found[k] and found[k][-1][1] >= a:
                found[k][-1] = (found[k][-1][0], a + window)
            else:
                found[k].append((a, a + window))
    return found


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches sorted by mark, the spans to remove: a block of whole marks at a time."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = pa.Table.from_batches(held)
        n = {k: x.column(k).to_numpy().astype(np.int64) for k in ("did", "rid", "anchor", "windows")}
        # of a document, only the first place of a stretch is asked about
        n["start"] = np.array([int.from_bytes(d[:8], "little") for d in x.column("data").to_pylist()], np.int64)
        found = block_spans(x.column("mark").to_pylist(), x.column("content").to_pylist(), n["anchor"], n["windows"], n["did"], n["start"])
        return table_of([(d, r, np.array(f, np.int64).tobytes()) for d, r, f in zip(n["did"].tolist(), n["rid"].tolist(), found, strict=True) if f], SPANS)

    held, size = [], 0
    for mark, of_mark in grouped(batches, "mark", loose=True):
        if mark < 0:
            for b in of_mark:
                yield b.select(["did", "rid", "data"]).cast(SPANS)
            continue
        rows = sum(b.num_rows for b in of_mark)
        if rows < 2 and of_mark[0].column("windows")[0].as_py() < 2:
            continue
        held += of_mark
        size += rows
        if size >= BLOCK:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def without_repeated_strings(docs: DataFrame) -> DataFrame:
    """Each document without bytes in 100-byte strings that start earlier: doc_id, n_bytes, n_removed, n_spans, kept.

    Earlier is in a smaller doc_id, or in the same one at a smaller place; kept is the remaining bytes (binary: a cut may
    fall inside a character). Null and empty texts have no bytes; texts of under 100 bytes stay whole. A null doc_id comes
    last; rows with the same doc_id count as one document whose texts start at the same place. Other columns are
    ignored; an empty table gives an empty result.
    """
    n, rows, scheme = parts(docs), keyed(docs), Scheme("byte", WINDOW, GRAM)
    buckets = bucket_count(rows, n)
    blocks = table(anchor_blocks(rows, scheme, buckets, n, alone=True), "anchor-blocks")
    hits = table(matched_anchors(blocks, n, buckets, alone=True), "anchor-hits")
    found = removable(rows, hits, scheme, resolve, within=True, n=n)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, rid, text, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "rid", "text", "spans")), strict=True):
                data = text.encode()
                cut = joined_spans([x["data"] for x in spans or () if x["rid"] is None or x["rid"] == rid], len(data)) if len(data) >= WINDOW else []
                kept, at = [], 0
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc_id, len(data), len(data) - len(kept), len(cut), kept))
            yield table_of(out, KEPT)

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
