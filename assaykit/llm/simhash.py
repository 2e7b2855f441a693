"""SimHash near-dedup by a binary trie self-join.

Distinct fingerprints form a binary trie. Its upper levels are traversed as data: a fingerprint goes to each pair of
nodes at the split level that its own node makes within the error budget. Each pair of subtrees is then traversed in
one task: node pairs go down together, bit by bit, carry the bits that differ, and are dropped when these exceed the
budget; blocks of node pairs go down one after another, so memory is bounded. The split level grows with the number of
fingerprints, so a subtree has some ten thousand of them, and few fingerprints go to many pairs. A task sends on only what
joins new parts of what it has seen, so a dense group costs as many rows as it has members, not pairs. Connected
components are then found over fingerprints, in rounds of joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import chunks, drop_table, keyed, order_id, parts, table
from assaykit.llm.repeats import grouped, table_of

#: Fixed values of the fingerprint: words in a shingle, the hash's seed.
SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints may differ.
BUDGET = 2
#: Fingerprints of a subtree, about; node pairs with so few fingerprints are compared at once; node pairs of a block.
SUBTREE, LEAF, NODES = 1 << 17, 8, 1 << 14
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str) -> int:
    """Bit by bit the majority of the shingles' XXH64, a tie giving 0; 0 for a text without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


PRINTS = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("rid", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, did, rid, fp (the 64 bits as a signed long) of each row."""

    def run(batches):
        for batch in chunks(batches):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("did"), batch.column("rid"), pa.array(fps)], schema=PRINTS)

    return keyed(docs).select("doc_id", "did", "rid", "text").mapInArrow(run, "doc_id long, did long, rid long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def subtree_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints (sorted, uint64) of two subtrees at `depth`, whose paths differ in `errors` bits, that are within
    the budget; right None: of one subtree with itself. Yields index arrays, in blocks."""
    same = right is None
    right = left if same else right
    # a node is a range of sorted fingerprints; the deepest block of node pairs goes first
    blocks = [(63 - depth, np.array([[0, len(left), 0, len(right), errors]], np.int64))]
    while blocks:
        bit, level = blocks.pop()
        sizes = (level[:, 1] - level[:, 0]) * (level[:, 3] - level[:, 2])
        small = (sizes <= LEAF * LEAF) | (bit < 0)
        if small.any():
            a, b, c, d, _ = level[small].T
            n = sizes[small]
            pair = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[pair] + k // (d - c)[pair], c[pair] + k % (d - c)[pair]
            near = popcount(left[i] ^ right[j]) <= budget
            near &= (i < j) if same else True
            yield i[near], j[near]
            level = level[~small]
        if not len(level):
            continue
        one = np.uint64(1) << np.uint64(bit)
        # all fingerprints of a node agree above `bit`, so its children meet where the bit turns on
        split = lambda x, lo, hi: np.minimum(np.maximum(np.searchsorted(x, x[lo] >> np.uint64(bit) >> np.uint64(1) << np.uint64(bit) << np.uint64(1) | one), lo), hi)
        a, b, c, d, e = level.T
        m, n = split(left, a, b), split(right, c, d)
        children = [(a, m, c, n, e), (m, b, n, d, e), (a, m, n, d, e + 1), (m, b, c, n, e + 1)]
        level = np.concatenate([np.stack(x, 1) for x in children])
        level = level[(level[:, 0] < level[:, 1]) & (level[:, 2] < level[:, 3]) & (level[:, 4] <= budget)]
        if same:  # a pair of nodes once: the other order is its mirror image
            level = level[level[:, 0] <= level[:, 2]]
        blocks += [(bit - 1, x) for x in np.array_split(level, -(-len(level) // NODES) or 1) if len(x)]


class Forest:
    """Which of n items are joined already."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        root = self.parent[of]
        while ((up := self.parent[root]) != root).any():
            root = up
        self.parent[of] = root
        return root

    def joined(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Joins the pairs; the places of those that joined what was apart."""
        a, b = self.roots(i), self.roots(j)
        apart = np.flatnonzero(a != b)
        # of pairs with the same two roots one is enough
        ends = np.sort(np.stack((a[apart], b[apart]), 1), 1)
        ends, first = np.unique(ends, axis=0, return_index=True)
        out, parent = [], self.parent
        for (a, b), k in zip(ends.tolist(), apart[first].tolist(), strict=True):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append(k)
        return np.array(out, np.int64)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(fps: DataFrame, count: int, n: int, budget: int = BUDGET) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp) within the budget, as many as join what belongs together."""
    depth = max(2, math.ceil(math.log2(max(2, count / SUBTREE))))
    masks = [sum(1 << b for b in bits) for k in range(budget + 1) for bits in combinations(range(depth), k)]
    node = F.shiftrightunsigned("fp", 64 - depth)
    x = fps.select("fp", node.alias("node"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    x = x.withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    x = x.select("fp", F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high"), (F.col("node") > F.col("other")).alias("is_high"))
    x = x.select("fp", (F.col("low") * (1 << depth) + F.col("high")).alias("pair"), "is_high")

    def run(batches):
        for pair, held in grouped(batches, "pair"):
            low, high = pair >> depth, pair & ((1 << depth) - 1)
            t = pa.Table.from_batches(held)
            fp, up = t.column("fp").to_numpy().view(np.uint64), t.column("is_high").to_numpy()
            left, right = np.sort(fp[~up]), np.sort(fp[up])
            if low == high:
                found, right = subtree_pairs(left, None, depth, 0, budget), left
            elif len(left) and len(right):
                found = subtree_pairs(left, right, depth, (low ^ high).bit_count(), budget)
            else:
                continue
            shift = 0 if low == high else len(left)
            forest = Forest(shift + len(right))
            for i, j in found:
                if len(k := forest.joined(i, j + shift)):
                    yield pa.RecordBatch.from_arrays([pa.array(left[i[k]].view(np.int64)), pa.array(right[j[k]].view(np.int64))], schema=EDGES)

    return x.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of the edges (a, b): the smallest node that can be reached.

    Each round links each node to the smallest neighbour of its neighbourhood (large star, then small star), which
    halves distances; the edges are cut from their lineage in each round. The least neighbours are tables of their own, so
    that both sides of each join are plain shuffles and a hub of very many edges can be split. Ends when the edges are stars.
    """
    now = table(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "links")
    last = None
    while True:
        # large star: each node's larger neighbours go to the least of it and its neighbours
        both = now.select(F.col("low").alias("n"), F.col("high").alias("o")).unionByName(now.select(F.col("high").alias("n"), F.col("low").alias("o")))
        least = table(both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m")), "least-neighbours")
        large = table(both.where("o > n").join(least, "n").select(F.col("o").alias("high"), F.col("m").alias("low")).distinct(), "links")
        drop_table(now)
        drop_table(least)
        # small star: each node and its smaller neighbours go to the least of these
        least = table(large.groupBy("high").agg(F.min("low").alias("m")), "least-neighbours")
        small = large.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).unionByName(least.select("high", F.col("m").alias("low")))
        now = table(small.where("low < high").distinct(), "links")
        drop_table(large)
        drop_table(least)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def rooted(prints: DataFrame, n: int, budget: int) -> DataFrame:
    """fp, first, key, root: each distinct fingerprint of prints with its least did, its least row (did, rid) and its
    component's root."""
    key = F.min(F.struct("did", "rid")).alias("key")
    fps = table(prints.groupBy("fp").agg(key).select("fp", F.col("key.did").alias("first"), "key"), "distinct-prints")
    roots = table(components(links(fps, fps.count(), n, budget)), "roots")
    return fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "key", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most `budget` bits; component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and link like any others. A null doc_id never is the smallest,
    unless its component has no other; then component_id is null. Repeated rows share a component. Texts of any length
    are hashed whole. Other columns are ignored; an empty table gives an empty result.
    """
    prints = table(fingerprints(docs), "prints")
    joined = rooted(prints, parts(docs), budget)
    joined = table(joined, "rooted")
    least = table(joined.groupBy("root").agg(F.min("first").alias("least")), "least-of-root")
    # tables of their own, so that the joins can split a component of very many fingerprints, and one of very many documents
    of_print = table(joined.join(least, "root").select("fp", "least"), "of-prints")
    out = prints.join(of_print, "fp")
    component = F.when(F.col("least") == F.col("did"), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def one_of_each_component(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Exactly one row of each component of near copies, with all its columns: that with the smallest doc_id, null last,
    and of rows with the same id that with the least hash of the text.

    Components keep their row whatever ids they share with others. Rows equal in id and text are one document.
    """
    prints = table(fingerprints(docs), "prints")
    kept = rooted(prints, parts(docs), budget).groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.did").alias("_did"), F.col("key.rid").alias("_rid"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), order_id().alias("_did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_rid"))
    # only copies in id and text meet in a group
    one = Window.partitionBy("_did", "_rid").orderBy(F.xxhash64("row"))
    out = rows.join(kept, ["_did", "_rid"], "left_semi")
    return out.withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each doc_id that one_of_each_component() keeps, for tables whose doc_id is a key.

    Where ids are null or shared by unlike texts this leaves out whole components; the pipeline doesn't use it.
    """
    one = Window.partitionBy("_did").orderBy(F.xxhash64("row.text"))
    kept = one_of_each_component(docs)
    out = kept.select(F.struct(*docs.columns).alias("row"), order_id().alias("_did"))
    return out.withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")
