"""Byte-level BPE by merge replay over the distinct words of a batch of documents.

The distinct pre-tokens of a batch are laid end to end, one token a byte. An inverted index maps each mergeable token
pair to the positions where it stands; the replay takes the pair of the lowest rank, merges it at all its positions at
once, and re-indexes only the neighbours it touched. Documents are then sequences of encoded words. Batches are cut by
bytes within a task, so memory is bounded and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import chunks, ranges

NONE = np.int32(2**31 - 1)
#: Bytes of text whose distinct words are encoded together.
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a rank file ("base64 rank" a line) by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return tuple(ranks[i] for i in range(len(ranks)))


class Vocabulary:
    """Tokens by rank, and the rank that each mergeable pair of tokens makes."""

    def __init__(self, tokens: tuple[bytes, ...]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank[t[:k]] << 32 | self.rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        made = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.made = np.r_[made[:, 0], np.int64(2**62)], np.r_[made[:, 1], NONE].astype(np.int32)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it can't be merged."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], NONE)

    def one_word(self, word: bytes) -> list[int]:
        """The ids of one word by the definition: the lowest rank first, the leftmost first among equals."""
        n = len(word)
        parts: list[bytes | None] = [bytes([b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.rank[p], i, p) for i in range(n - 1) if (p := word[i : i + 2]) in self.rank]
        heapq.heapify(queue)
        while queue:
            _, i, made = heapq.heappop(queue)
            k = after[i]
            # what was queued counts as long as both parts stand; merges only lengthen them
            if parts[i] is None or k >= n or parts[i] + parts[k] != made:
                continue
            parts[i], parts[k], after[i] = made, None, after[k]
            if after[k] < n:
                before[after[k]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (p := parts[a] + parts[after[a]]) in self.rank:
                    heapq.heappush(queue, (self.rank[p], a, p))
        return [self.rank[p] for p in parts if p is not None]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])].tobytes()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and each word's number of ids: the merge replay."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        token = np.r_[self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # position n stands for "none"
        ends = np.cumsum(lengths) - 1
        full = lengths > 0
        after[ends[full]] = n
        before[(ends - lengths + 1)[full]] = n
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.merged(token[inner], token[after[inner]])
        # the index: positions by rank, those of a rank in order; what merges add comes in `more`
        order = np.argsort(rank[:n], kind="stable").astype(np.int32)
        seen, first = np.unique(rank[order], return_index=True)
        index = {int(r): [order[a:b]] for r, a, b in zip(seen, first, np.r_[first[1:], n], strict=True) if r != NONE}
        queue, odd = list(index), set()
        heapq.heapify(queue)
        while queue:
            now = heapq.heappop(queue)
            lists = index.pop(now)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == now]
            if not len(at):
                continue
            follows = after[at[:-1]] == at[1:]
            if follows.any():  # runs like "aaa": every other one, from the left
                keep, last = np.ones(len(at), bool), False
                for i in np.flatnonzero(follows):
                    last = keep[i]
                    keep[i + 1] = not last
                at = at[keep]
            gone = after[at]
            token[at] = now
            rank[gone] = NONE
            token[gone] = -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            touched = np.concatenate((at, left[left < n]))
            right = after[touched]
            new = np.where(right < n, self.merged(token[touched], token[right]), NONE).astype(np.int32)
            rank[touched] = new
            some = new != NONE
            new, touched = new[some], touched[some]
            if not len(new):
                continue
            if (new < now).any():  # must come before the word's next merge of this rank, which is done already
                held, times = np.unique(word[at], return_counts=True)
                odd.update(np.intersect1d(word[touched[new < now]], held[times > 1]).tolist())
            by = np.argsort(new, kind="stable")
            new, touched = new[by], touched[by]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            for r, p in zip(new[np.r_[0, cuts]].tolist(), np.split(touched, cuts), strict=True):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(queue, r)
        alive = token[:n] >= 0
        ids, counts = token[:n][alive], np.bincount(word[alive], minlength=len(words)).astype(np.int64)
        if odd:
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for w in odd:
                pieces[w] = np.array(self.one_word(words[w]), np.int32)
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, counts


@lru_cache(maxsize=2)
def vocabulary(tokens: tuple[bytes, ...]) -> Vocabulary:
    return Vocabulary(tokens)


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: Where a space isn't a word's first character for sure: it stands after other white space.
UNCLEAR = re.compile(r"\s ")


def encoded_texts(texts: Iterable[str], vocab: Vocabulary, pattern: regex.Pattern, told: bool = True) -> Iterator[tuple[np.ndarray, list[str]]]:
    """For each text its ids, and, if told, the same in decimal, joined by spaces unit by unit.

    A unit is a stretch that the pattern splits alike wherever it stands. A match never holds white space after other
    characters, so a space behind a non-space always begins a match, and what lies between two such spaces is a unit,
    split once for all its occurrences. In texts with a space behind other white space each match is a unit.
    """
    units, pieces = Numbers(), Numbers()
    docs = []
    for text in texts:
        if UNCLEAR.search(text):
            keys = [(m,) for m in pattern.findall(text)]
        else:
            keys = text.split(" ")
            keys[0] += " "  # marks the one unit that has no space before it
        docs.append(np.array(list(map(units.__getitem__, keys)), np.int64))
    split = [[pieces[k[0]]] if isinstance(k, tuple) else [pieces[m] for m in pattern.findall(k[:-1] if k[-1:] == " " else f" {k}")] for k in units]
    ids, counts = vocab.encode([p.encode() for p in pieces])
    starts = np.cumsum(counts) - counts
    of_unit = np.fromiter((p for ps in split for p in ps), np.int64)
    n_pieces = np.array([len(ps) for ps in split], np.int64)
    ids = ids[ranges(starts[of_unit], counts[of_unit])]
    upto = np.r_[0, np.cumsum(counts[of_unit])]
    piece_end = np.cumsum(n_pieces)
    starts, counts = upto[piece_end - n_pieces], upto[piece_end] - upto[piece_end - n_pieces]
    flat = list(map(str, ids.tolist())) if told else []
    decimal = [" ".join(flat[a : a + k]) for a, k in zip(starts.tolist(), counts.tolist(), strict=True)]
    for words in docs:
        yield ids[ranges(starts[words], counts[words])], [d for w in words.tolist() if (d := decimal[w])] if told else []


def encode(docs: DataFrame, tokens: tuple[bytes, ...], pattern: str) -> DataFrame:
    """doc_id and ids (array of int) for each row; a null or empty text has no ids, repeated rows are encoded alike."""

    def run(batches):
        vocab, splits = vocabulary(tokens), regex.compile(pattern)
        for batch in chunks(batches, size=BATCH_BYTES):
            ids = [x for x, _ in encoded_texts((t or "" for t in batch.column("text").to_pylist()), vocab, splits, told=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokens: tuple[bytes, ...]) -> DataFrame:
    """doc_id and bytes (binary) for each row of encode()'s result; null ids give empty bytes, unknown ids nothing."""

    def run(batches):
        vocab = vocabulary(tokens)
        for batch in batches:
            out = [vocab.decode(np.array([i for i in x or () if i is not None], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, tokens: tuple[bytes, ...], pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids and of the bytes that the ids decode to, for each row.

    A null text counts as empty (no ids, no bytes); repeated rows give repeated results; an empty table an empty one.
    """

    def run(batches):
        vocab, splits = vocabulary(tokens), regex.compile(pattern)
        for batch in chunks(batches, size=BATCH_BYTES):
            n, told, back = [], [], []
            for ids, decimal in encoded_texts((t or "" for t in batch.column("text").to_pylist()), vocab, splits):
                n.append(len(ids))
                told.append(hashlib.sha256(" ".join(decimal).encode()).hexdigest())
                back.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
