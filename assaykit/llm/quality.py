"""Quality rules from tokeniser fertility, beside a base of word and line counts.

Public vocabularies tell how a text differs from what they were made for: characters per token and the entropy of the
tokens come from a byte-level BPE, the share of bytes that fall back to byte tokens from a piece vocabulary. A text
outside its language's bands, or those of the script of most of its letters where the language is unknown, is rejected. All of it is per row, in
Arrow batches cut by bytes, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.bpe import Vocabulary, encoded_texts, read_ranks
from assaykit.llm.common import chunks


@dataclass(frozen=True)
class Bands:
    """What a text may have: characters per token from low to high, share of fallback bytes, bits per token.

    Entropy is judged from `sure` tokens on, as a short text has little of it whatever it says.
    """

    low: float = 1.2
    high: float = 8.0
    fallback: float = 0.2
    bits: float = 4.0
    sure: int = 100


#: By language. Text in Latin script takes few bytes per token; other scripts take more tokens and fall back more.
LANGUAGES = {"en": Bands(low=1.8), "de": Bands(low=1.6), "fr": Bands(low=1.6), "es": Bands(low=1.6)}
#: By script, for unknown languages: Latin, or any other.
SCRIPTS = {"latin": Bands(low=1.3), "other": Bands(low=0.3, fallback=0.6, bits=2.5)}
#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WORDS, MAX_REPEAT_PERCENT = 20, 8, 30
#: Characters whose letters are counted at once.
STRETCH = 1 << 15


def repeated_words(words: list[bytes], width: int = REPEAT_WORDS) -> int:
    """Words in windows of `width` words that occur twice or more in the list, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # ranks of runs of 1, 2, 4, ... words, each from a pair of ranks of half the length: exact, without hashing
    have, runs = 1, ids
    while have < width:
        step = min(have, width - have)
        pair = runs[:-step] * (runs.max() + 1) + runs[step:]
        order, runs = np.unique(pair, return_inverse=True)
        have += step
        if len(order) == len(pair):
            return 0
    starts = np.bincount(runs)[runs] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(starts)] += starts
    edge[width:] -= starts
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    full = [line for line in lines if line.strip(" \t\x0b\x0c\r")]
    return len(full) - len(set(full))


@lru_cache(maxsize=1)
def _tokenizers(ranks_path: str, pattern: str, pieces_path: str):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    is_byte = np.array([pieces.IsByte(i) for i in range(pieces.GetPieceSize())])
    return Vocabulary(read_ranks(ranks_path)), regex.compile(pattern), pieces, is_byte


class Fertility:
    """chars_per_token, fallback_share, token_bits and the number of tokens of texts."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        self.vocabulary, self.pattern, self.pieces, self.is_byte = _tokenizers(ranks_path, pattern, pieces_path)
        self.fallback: dict[str, int] = {}

    def fallback_bytes(self, words: list[bytes]) -> int:
        """Bytes of the words that the piece vocabulary spells byte by byte; it has all of printable ASCII."""
        rare = [w.decode() for w in words if not w.isascii() or not w.isalnum() and not w.decode().isprintable()]
        if new := [w for w in set(rare) if w not in self.fallback]:
            if len(self.fallback) > 200_000:
                self.fallback = {}
                new = list(set(rare))
            for w, ids in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
                self.fallback[w] = int(self.is_byte[ids].sum()) if ids else 0
        return sum(map(self.fallback.__getitem__, rare))

    def measures(self, texts: list[str], words: list[list[bytes]]) -> Iterator[tuple[float, float, float, int]]:
        """Of each text, tokenised whole, and its words."""
        for text, mine, (ids, _) in zip(texts, words, encoded_texts(texts, self.vocabulary, self.pattern, told=False), strict=True):
            if not len(ids):
                yield 0.0, 0.0, 0.0, 0
                continue
            share = np.unique(ids, return_counts=True)[1] / len(ids)
            size = sum(map(len, mine))
            yield len(text) / len(ids), (self.fallback_bytes(mine) / size if size else 0.0), float(-(share * np.log2(share)).sum()), len(ids)


def band_of(text: str, lang: str | None, languages: Mapping[str, Bands], scripts: Mapping[str, Bands]) -> Bands:
    if lang in languages:
        return languages[lang]
    latin = letters = 0
    for i in range(0, len(text), STRETCH):
        # the letters of a stretch, each as often as it stands there
        seen, n = np.unique(np.frombuffer(text[i : i + STRETCH].encode("utf-32-le"), np.uint32), return_counts=True)
        for c, k in zip(map(chr, seen.tolist()), n.tolist(), strict=True):
            if c.isalpha():
                letters += k
                latin += k * (c < "ɐ")
    return scripts["latin" if 2 * latin >= letters else "other"]


def quality_rules(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, languages: Mapping[str, Bands] = LANGUAGES, scripts: Mapping[str, Bands] = SCRIPTS) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, the three measures and the failed rule.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are whole-text counts. base_failed: too few words or too
    many repeated ones. kept: not base_failed and inside the bands. A null or empty text has no words and fails the
    base. A null language, or a table without one, goes by script. Texts of any length are measured and tokenised whole.
    Repeated rows get repeated results; other columns are ignored; an empty table gives an empty result.
    """
    measured = _measured(ranks_path, pattern, pieces_path, dict(languages), dict(scripts))

    def run(batches):
        for batch, rows in measured(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True))], names=NAMES)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, fallback_share double, token_bits double, failed_rule string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, languages: Mapping[str, Bands] = LANGUAGES, scripts: Mapping[str, Bands] = SCRIPTS) -> DataFrame:
    """The rows of docs (with text, and lang if there is one) that quality_rules() keeps, with all their columns."""
    measured = _measured(ranks_path, pattern, pieces_path, dict(languages), dict(scripts))

    def run(batches):
        for batch, rows in measured(batches):
            yield batch.filter(pa.array([row[6] for row in rows]))

    return docs.mapInArrow(run, docs.schema)


def _measured(ranks_path: str, pattern: str, pieces_path: str, languages: dict, scripts: dict):
    """A function from record batches to pieces of these with a tuple of measures for each row."""

    def run(batches):
        fertility = Fertility(ranks_path, pattern, pieces_path)
        for batch in chunks(batches):
            rows, texts = [], [text or "" for text in batch.column("text").to_pylist()]
            langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * len(texts)
            of_text = [text.encode().split() for text in texts]
            for text, lang, words, (per_token, fallback, bits, n) in zip(texts, langs, of_text, fertility.measures(texts, of_text), strict=True):
                chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
                repeat = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
                b = band_of(text, lang, languages, scripts)
                rule = "base" if failed else "chars_per_token" if not b.low <= per_token <= b.high else "fallback_share" if fallback > b.fallback else "token_bits" if n >= b.sure and bits < b.bits else None
                rows.append((len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeat, failed, rule is None, per_token, fallback, bits, rule))
            yield batch, rows

    return run


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_bits", "failed_rule"]
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
