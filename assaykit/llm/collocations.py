"""Phrase collocation mining with merged count-min sketches.

The words of the corpus are written once as blocks of one language, as numbers into the block's own vocabulary. First pass:
each block counts its distinct n-grams and sends them as hashes to bands of hash space; the task of a band adds the
blocks' counts up in a count-min sketch, which overestimates only, and answers each block with one bit an n-gram: whether
the sketch reaches the threshold. Second pass: each block counts its n-grams again, keeps those with a set bit, and they
alone are aggregated exactly, as text. What is frequent can't be lost, and what is not falls to the exact counts.

A band holds what BAND_WORDS words bring, and its sketch is as wide as that asks for, so bands grow in number with the
corpus, not in size; no sketch is broadcast or gathered. A very common n-gram is one entry a block. Scores and subsumption
are joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import chunks, mixed, parts, table
from assaykit.llm.repeats import grouped, packed, table_of, unpacked

#: Words of the longest phrase; occurrences that make a phrase a candidate.
LONGEST, LEAST = 4, 30
#: A part of a score's fraction, percent of a phrase's occurrences that a longer one must have, phrases told of a language.
SCALE, SHARE, TOP = 2_000_000, 80, 2_000
#: Bytes of text of a block; words whose n-grams meet in one band of the sketch.
BLOCK_BYTES, BAND_WORDS = 8 << 20, 4 << 20
#: What ends a piece, as bytes to one of them; a tab is a space; A-Z lower-cased.
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"......... abcdefghijklmnopqrstuvwxyz")
#: The language of rows that have none.
NO_LANG = "und"
U64 = np.uint64

BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("seq", pa.binary())])


def blocks(docs: DataFrame) -> DataFrame:
    """block, lang, n_words, words, seq: the distinct words of some texts of one language, joined by spaces, and the
    texts as numbers into them (int32, compressed), with -1 between pieces."""

    def block(number: int, lang: str, texts: list[bytes]) -> tuple:
        tokens = b" . ".join([t.translate(PIECES).replace(b".", b" . ") for t in texts]).split()
        numbers = {b".": -1}
        seq = np.fromiter((numbers.setdefault(t, len(numbers) - 1) for t in tokens), np.int32, len(tokens))
        del numbers[b"."]
        return number, lang, int((seq >= 0).sum()), b" ".join(numbers), zstandard.ZstdCompressor(level=1).compress(seq.tobytes())

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, size=BLOCK_BYTES):
            lang = batch.column("lang").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            of_lang: dict[str, list[bytes]] = {}
            for name, text in zip(lang, texts, strict=True):
                of_lang.setdefault(name, []).append(text)
            rows = []
            for name, own in of_lang.items():
                rows.append(block(number, name, own))
                number += 1
            yield table_of([r for r in rows if r[2]], BLOCKS)

    text, lang = F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")
    return docs.select(lang, text).mapInArrow(run, "block long, lang string, n_words long, words binary, seq binary")


class Grams:
    """The distinct n-grams of a block, length by length: `words`, and for each longer length the (shorter one, last word) of
    each n-gram; hashes and counts of all."""

    def __init__(self, row: dict, longest: int):
        self.words = row["words"].split(b" ")
        seq, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["seq"]), np.int32), len(self.words)
        seed = xxhash.xxh3_64_intdigest(row["lang"].encode())
        word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), U64, size)
        at = np.flatnonzero(seq >= 0).astype(np.int32)
        code = seq[at]
        self.longer: list[tuple[np.ndarray, np.ndarray]] = []
        hashes, counts = [word], [np.bincount(code, minlength=size)]
        for k in range(2, longest + 1):
            # an n-gram is a shorter one and a further word: exact numbers, no hashes
            on = at + k - 1 < len(seq)
            at, code = at[on], code[on]
            last = seq[at + k - 1]
            on = last >= 0
            at = at[on]
            pair, code, times = np.unique(code[on] * np.int64(size) + last[on], return_inverse=True, return_counts=True)
            code = code.astype(np.int32)
            shorter, last = pair // size, pair % size
            hashes.append(mixed(hashes[-1][shorter] * U64(0x9E3779B97F4A7C15) + word[last]))
            self.longer.append((shorter.astype(np.int32), last.astype(np.int32)))
            counts.append(times)
        self.sizes = [len(c) for c in counts]
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)

    def phrases(self, length: int, chosen: np.ndarray) -> list[bytes]:
        """The chosen n-grams of a length as text."""
        columns = []
        for shorter, last in self.longer[: length - 1][::-1]:
            columns.append(last[chosen])
            chosen = shorter[chosen]
        words = [map(self.words.__getitem__, c.tolist()) for c in [chosen, *columns[::-1]]]
        return [b" ".join(x) for x in zip(*words, strict=True)]

    def in_bands(self, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams' order by band and the low half of their hash; that half in order; where each n-gram's band begins."""
        band = (self.hashes >> U64(32)) * U64(bands) & U64(0xFFFFFFFF00000000)
        key = band | self.hashes & U64(0xFFFFFFFF)
        order = np.argsort(key)
        band = (key[order] >> U64(32)).astype(np.int64)
        return order, (key[order] & U64(0xFFFFFFFF)).astype(np.int64), band


def each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time, as each is large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def cuts_of(band: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(band[1:] != band[:-1]) + 1] if len(band) else np.zeros(0, np.int64)


SENT = pa.schema([("band", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ANSWERS = pa.schema([("band", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())])


def partial_sketches(held: DataFrame, bands: int, longest: int, least: int) -> DataFrame:
    """band, block, data: for each band the hashes of a block's n-grams and their counts, which stop at the threshold."""

    def run(batches):
        for batch in batches:
            for row in each(batch):
                grams = Grams(row, longest)
                order, low, band = grams.in_bands(bands)
                counts, cut = np.minimum(grams.counts[order], least), cuts_of(band)
                pieces = zip(band[cut].tolist(), np.split(low, cut[1:]), np.split(counts, cut[1:]), strict=True)
                yield table_of([(b, row["block"], packed(h, c)) for b, h, c in pieces], SENT)

    return held.mapInArrow(run, "band long, block long, data binary")


def cells(low: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cells of a hash in the rows of a sketch."""
    for k in range(2):
        yield (mixed(low.astype(U64) + U64((k << 40) + 1)) & U64(width - 1)).astype(np.int64)


def reached(entries: list[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[np.ndarray]:
    """For each block of a band, which of its entries (hashes, counts) the merged sketch puts at `least` or more."""
    width = 1 << max(10, sum(len(h) for h, _ in entries).bit_length() - 1)
    sketch = np.zeros((2, width), np.uint32)
    for hashes, counts in entries:
        for row, at in zip(sketch, cells(hashes, width), strict=True):
            np.add.at(row, at, counts)
    enough = sketch >= least
    for hashes, _ in entries:
        a, b = cells(hashes, width)
        yield enough[0][a] & enough[1][b]


def survivors(sent: DataFrame, n: int, least: int) -> DataFrame:
    """band, block, bits: the answer to each row of partial_sketches()."""

    def run(batches):
        for band, held in grouped(batches, "band"):
            entries = []
            for data in (d for b in held for d in b.column("data").to_pylist()):
                hashes, counts = unpacked(data)[:2]
                entries.append((hashes.astype(np.uint32), counts.astype(np.uint32)))
            of_block = [x for b in held for x in b.column("block").to_pylist()]
            yield table_of([(band, block, np.packbits(bits).tobytes()) for block, bits in zip(of_block, reached(entries, least), strict=True)], ANSWERS)

    return sent.repartition(n, "band").sortWithinPartitions("band").mapInArrow(run, "band long, block long, bits binary")


FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def survivor_counts(answered: DataFrame, bands: int, longest: int) -> DataFrame:
    """lang, phrase, f: the surviving n-grams of each block, counted exactly within it."""

    def run(batches):
        for batch in batches:
            for row in each(batch):
                grams = Grams(row, longest)
                order, _, band = grams.in_bands(bands)
                sizes = np.diff(np.r_[cuts_of(band), len(band)])
                bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n) for a, n in zip(sorted(row["answers"], key=lambda a: a["band"]), sizes.tolist(), strict=True)]
                alive = np.zeros(len(order), bool)
                alive[order] = np.concatenate(bits).astype(bool)
                start = 0
                for length, size in enumerate(grams.sizes, 1):
                    chosen = np.flatnonzero(alive[start : start + size])
                    counts = grams.counts[start + chosen]
                    start += size
                    phrases = pa.array(grams.phrases(length, chosen), pa.binary()).cast(pa.string())
                    lang = pa.array([row["lang"]] * len(phrases), pa.string())
                    yield pa.RecordBatch.from_arrays([lang, phrases, pa.array(counts.astype(np.int64))], schema=FOUND)

    return answered.mapInArrow(run, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases, sizes): lang, phrase, k, f of all phrases of 1 to `longest` words that occur `least` times, with their exact
    counts f and numbers of words k; and lang, n of all word occurrences."""
    held = table(blocks(docs), "phrase-blocks")
    n = parts(docs)
    total = held.agg(F.sum("n_words")).first()[0] or 0
    bands = max(n, -(-total // BAND_WORDS))
    answers = survivors(partial_sketches(held, bands, longest, least), n, least)
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("band", "bits")).alias("answers"))
    counts = survivor_counts(held.join(answers, "block").drop("block", "n_words"), bands, longest)
    counts = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = table(counts.withColumn("k", F.size(F.split("phrase", " "))), "phrases")
    return phrases, held.groupBy("lang").agg(F.sum("n_words").alias("n"))


def _words(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def scored(phrases: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases of two words and more: of the cut with the lowest score, the first of such."""
    count = phrases.select("lang", "phrase", "f")
    cut = phrases.where("k > 1").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "cut", _words(F.lit(1), F.col("cut")).alias("left"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    # the parts of a frequent phrase are frequent
    cut = cut.join(count.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"])
    cut = cut.join(count.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    # decimals: scale * a may pass 64 bits
    cut = cut.withColumn("score", F.expr(f"CAST(CAST(a AS DECIMAL(20, 0)) * {scale} AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    return cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def longest_holders(phrases: DataFrame) -> DataFrame:
    """lang, phrase, of_longer: the most occurrences of a longer frequent phrase that holds all words of this one."""
    long = phrases.where("k > 2").withColumn("w", F.split("phrase", " ")).withColumn("size", F.explode(F.expr("sequence(2, k - 1)")))
    long = long.withColumn("start", F.explode(F.expr("sequence(1, k - size + 1)")))
    return long.groupBy("lang", _words(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("of_longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, scale: int = SCALE, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, then a, then the phrase.

    Texts are lower-cased (A-Z), cut into pieces and these into words. A phrase has 2 to `longest` words of one piece and a
    occurrences, overlaps included, `least` at least. l and r count its parts at the cut with the lowest
    floor(scale * a / (l + r)), n the language's words. Phrases inside a longer one with `share` percent of their occurrences
    or more are dropped. A null text counts as empty, a null lang as `und`. Rows that repeat count each time; texts of any
    length are read whole; other columns are ignored. A table without frequent phrases gives an empty result.
    """
    phrases, sizes = frequent_phrases(docs, longest, least)
    found = scored(phrases, scale).join(longest_holders(phrases), ["lang", "phrase"], "left")
    found = found.where(f"of_longer IS NULL OR CAST(of_longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {share}")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the best of each of many parts first, so that no task ranks all phrases of a language
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts(docs, 64))))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return found.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
