"""URL filters: rules by host and path, and a character language-model ratio where no rule decides.

Two Markov models of variable order, one of URLs that the rules allow and one of those they block, are counted over all
ruled rows, smoothed by backing off from long contexts to short ones. A URL's score is the difference of its two
log-likelihoods a character; the threshold is calibrated on all ruled rows, each scored by models without its fold of
hosts. Counts are exact: a Spark table with a row a gram, which grows with the input and is joined with the grams that blocks of URLs ask for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import chunks, mixed, ranges, table


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host, its subdomains, and paths that start alike."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules (fixed values).
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
#: Longest context in bytes (6 at most), slots of hashed counters (see slots()), how strongly a shorter context pulls.
ORDER, SLOTS, PULL = 4, 1 << 15, 2.0
#: Bits of a character in a gram's key; what stands before and after a URL, beside 256 bytes.
BITS, BEFORE, AFTER = 9, 256, 257
#: Rows of a block, which asks for each of its grams once, as a power of two.
BLOCK_BITS = 12
#: Folds of hosts, each calibrated by the others' counts; bins of the calibration's histogram, from -SPAN to SPAN.
FOLDS, BINS, SPAN = 5, 2000, 10.0
#: Longest stretch of a URL for slots(); in longer URLs contexts begin anew at each.
STRETCH = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is behind the first "://" up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, null if none does; the first of equally long ones."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def slots(urls: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of each URL and each context length from 0 to order: the slot of its context with it, and of
    the context; and which URL it belongs to. Contexts don't reach into other URLs.

    Hashed counters, for small samples in one process; judged() counts exactly (see gram_counts)."""
    cut = [(i, u[a : a + STRETCH].encode()) for i, u in enumerate(urls) for a in range(0, max(1, len(u)), STRETCH)]
    data = np.frombuffer(b"".join(b"\x02" * order + u + b"\x03" for _, u in cut) or b"\x02" * order, np.uint8).astype(np.uint64)
    sizes = np.array([len(u) + 1 for _, u in cut], np.int64)
    at = ranges(np.cumsum(sizes + order) - sizes, sizes)
    context = np.zeros(len(at), np.uint64)
    grams, contexts = [], []
    for k in range(order + 1):
        if k:
            context = mixed(context * np.uint64(257) + data[at - k] + np.uint64(1))
        salted = context + np.uint64(k)
        contexts.append((mixed(salted) % np.uint64(SLOTS)).astype(np.int64) + (2 * k + 1) * SLOTS)
        grams.append((mixed(salted * np.uint64(263) + data[at] + np.uint64(7)) % np.uint64(SLOTS)).astype(np.int64) + 2 * k * SLOTS)
    return np.stack(grams), np.stack(contexts), np.repeat(np.array([i for i, _ in cut], np.int64), sizes)


class Ratio:
    """The smoothed models, from the count table: at most 4 * (order + 1) * SLOTS numbers."""

    def __init__(self, counts: np.ndarray, order: int):
        self.counts, self.order = counts, order

    def scores(self, urls: Sequence[str]) -> np.ndarray:
        """Rejected minus accepted log-likelihood a character."""
        grams, contexts, owner = slots(urls, self.order)
        likelihood = []
        for c in self.counts:
            p = np.full(grams.shape[1], 1 / 256)
            for k in range(self.order + 1):
                # the context's estimate, pulled towards that of the next shorter one
                p = (c[grams[k]] + PULL * p) / (np.maximum(c[contexts[k]], c[grams[k]]) + PULL)
            likelihood.append(np.bincount(owner, np.log(p), len(urls)))
        return (likelihood[1] - likelihood[0]) / np.bincount(owner, minlength=len(urls))


def grams(urls: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each URL, and its end: the key of it with the `order` characters before it, nothing hashed; and
    which URL it belongs to."""
    encoded = [u.encode() for u in urls]
    data = np.frombuffer(b"".join(bytes(order) + u + b"\0" for u in encoded), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in encoded], np.int64)
    ends = np.cumsum(sizes + order)
    data[ends - 1] = AFTER
    data[ranges(ends - sizes - order, np.full(len(sizes), order))] = BEFORE
    at = ranges(ends - sizes, sizes)
    key = np.zeros(len(at), np.int64)
    for k in range(order, -1, -1):
        key = key << BITS | data[at - k]
    return key, np.repeat(np.arange(len(encoded)), sizes)


#: Columns of counts: of allowed and blocked rows of each fold.
COUNTS = [f"{c}{f}" for f in range(FOLDS) for c in "ab"]


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and COUNTS, a row for each gram of the rows (url, ruled, fold); those of rows without a rule count nowhere."""
    schema = pa.schema([("gram", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])
    kinds = 2 * FOLDS + 1

    def run(batches):
        for batch in chunks(batches, "url", 1 << 18):
            keys, owner = grams([u or "" for u in batch.column("url").to_pylist()], order)
            kind = np.array([kinds - 1 if v is None else 2 * f + (v == "block") for f, v in zip(batch.column("fold").to_pylist(), batch.column("ruled").to_pylist(), strict=True)], np.int64)[owner]
            place = np.lexsort((kind, keys))
            keys, kind = keys[place], kind[place]
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.array(kind[starts].astype(np.int32)), pa.array(np.diff(np.r_[starts, len(keys)]))], schema=schema)

    part = rows.select("url", "ruled", F.col("fold").cast("int").alias("fold")).mapInArrow(run, "gram long, kind int, n long")
    return part.groupBy("gram").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(F.lit(0))).alias(c) for k, c in enumerate(COUNTS)))


def ratios(rows: DataFrame, models: Sequence[Sequence[int]], order: int = ORDER) -> DataFrame:
    """gram and d0, d1, ...: for each gram of the rows and each model, counted over so many folds, by how much its last
    character is likelier after the others among blocked rows than among allowed ones (logarithm).

    A gram's estimate is pulled towards that of the gram without its first character. No group in here has more rows
    than there are characters, however common a gram is.
    """
    levels = [table(gram_counts(rows, order), "grams")]
    for k in range(order, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
        levels.append(levels[-1].groupBy(shorter).agg(*(F.sum(c).alias(c) for c in COUNTS)))
    of_context = Window.partitionBy(F.shiftright("gram", BITS))
    names = [f"{c}_{m}" for m in range(len(models)) for c in "ab"]
    below = None
    for k, level in enumerate(reversed(levels)):
        x = level.select("gram", *COUNTS, *(F.sum(c).over(of_context).alias(f"of_{c}") for c in COUNTS))
        if below is None:
            x = x.withColumns({f"p{n}": F.lit(1 / 256) for n in names})
        else:
            x = x.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(below.withColumnRenamed("gram", "shorter"), "shorter")
        sums = lambda prefix, folds: sum((F.col(f"{prefix}{f}") for f in folds), F.lit(0))
        estimate = lambda c, m: (sums(c, models[m]) + PULL * F.col(f"p{c}_{m}")) / (sums(f"of_{c}", models[m]) + PULL)
        below = x.select("gram", *(estimate(c, m).alias(f"p{c}_{m}") for m in range(len(models)) for c in "ab"))
    return below.select("gram", *((F.log(f"pb_{m}") - F.log(f"pa_{m}")).alias(f"d{m}") for m in range(len(models))))


def with_scores(rows: DataFrame, told: DataFrame, models: int, order: int = ORDER) -> DataFrame:
    """The rows (page_id, url, host, path, rule, ruled, fold, block) without url and block, with scores: for each model
    the mean of its ratios (told) over the URL; null for a URL without "://".

    A block asks for each of its grams once, so a gram in every URL is a row a block, and the answers meet the block.
    """
    kept = ["page_id", "host", "path", "rule", "ruled", "fold"]
    of_gram = [f"d{m}" for m in range(models)]

    def asked(batches):
        for batch in chunks(batches, "url", 1 << 18):
            keys, owner = grams([u or "" for u in batch.column("url").to_pylist()], order)
            block = batch.column("block").to_numpy()
            for b in np.unique(block):
                wanted = np.unique(keys[(block == b)[owner]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), b)), pa.array(wanted)], names=["block", "gram"])

    def scored(mine: pa.Table, answers: pa.Table) -> pa.Table:
        urls = [u or "" for u in mine.column("url").to_pylist()]
        keys, owner = grams(urls, order)
        have, place = np.unique(answers.column("gram").to_numpy(), return_index=True)
        at = place[np.searchsorted(have, keys)]
        sizes = np.bincount(owner, minlength=len(urls))
        means = np.stack([np.bincount(owner, answers.column(d).to_numpy()[at], len(urls)) / sizes for d in of_gram], 1)
        scores = [m if "://" in u else None for u, m in zip(urls, means.tolist(), strict=True)]
        return mine.select(kept).append_column("scores", pa.array(scores, pa.list_(pa.float64())))

    wanted = rows.select("url", "block").mapInArrow(asked, "block long, gram long")
    answers = wanted.join(told, "gram").select("block", "gram", *of_gram)
    schema = "page_id long, host string, path string, rule string, ruled string, fold long, scores array<double>"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def judged(pages: DataFrame, rules: Sequence[UrlRule] = RULES, order: int = ORDER) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    A rule decides where one fits; elsewhere a score above the threshold blocks. The models that give the score count all
    ruled rows. Each fold of hosts, scored by models without it, has a threshold where its ruled rows' errors, each class
    weighing the same, are fewest, amid the highest such stretch. The median of these counts, so that no host sets it
    alone; where no fold has both classes it is the threshold of all of them together, and 0 where these lack a class. A
    fold whose others lack a class can't be scored and is left out of the calibration only. A null url, one without "://", and the case that the rules leave a class
    empty (nothing to learn from) are allowed with score 0. Other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("long"))
    rows = table(rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "urls")
    # two classes of FOLDS folds at most
    shown = {(r["fold"], r["ruled"]) for r in rows.where("ruled IS NOT NULL").select("fold", "ruled").distinct().collect()}
    if len({v for _, v in shown}) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    # the models of all ruled rows, then those without fold 0, 1, ...
    models = [range(FOLDS), *([g for g in range(FOLDS) if g != f] for f in range(FOLDS))]
    out = table(with_scores(rows, ratios(rows, models, order), len(models), order), "url-scores")
    learnt = [f for f in range(FOLDS) if len({v for g, v in shown if g != f}) == 2]
    held = out.where(F.col("ruled").isNotNull() & F.col("fold").isin(learnt)).withColumn("score", F.get("scores", F.col("fold").cast("int") + 1))
    held = held.withColumn("bin", F.floor((F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * (BINS / 2 / SPAN)))
    histograms = np.zeros((FOLDS, 2, BINS + 2))
    for r in held.groupBy("fold", "ruled", "bin").count().collect():  # two classes of at most BINS + 1 bins a fold
        histograms[r["fold"], int(r["ruled"] == "block"), r["bin"]] += r["count"]
    whole = [h for h in histograms if h.sum(1).all()]
    threshold = float(np.median([threshold_of(h) for h in whole or [histograms.sum(0)]]))
    score = F.get("scores", F.lit(0))
    # without "://" there is no score, so nothing that a threshold below 0 could block
    verdict = F.coalesce("ruled", F.when(score > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce(score, F.lit(0.0)).alias("score"))


def threshold_of(histogram: np.ndarray) -> float:
    """The score above which to block: least error over both classes, each weighing the same, amid the highest stretch of
    such scores; 0 without both classes."""
    n = histogram.sum(1)
    if not n.all():
        return 0.0
    allowed_above = (n[0] - np.cumsum(histogram[0])) / n[0]
    blocked_below = np.cumsum(histogram[1]) / n[1]
    errors = allowed_above + blocked_below
    least = np.flatnonzero(errors == errors.min())
    start = least[-1] - np.argmax(np.r_[np.diff(least)[::-1] != 1, True])  # of the highest run of such places
    return ((start + least[-1]) / 2 + 1) * (2 * SPAN / BINS) - SPAN

