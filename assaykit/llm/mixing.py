"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream, which is cut into blocks of a fixed length. Each output shard draws how many
blocks it takes from each source: multinomial shares, drawn by systematic resampling (one uniform number per shard),
so that a count stays within one block of its expectation. The slots of a source, numbered over all shards, go
through a pseudorandom permutation of the source's block indexes, anew on each pass, and join the blocks by index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import WORD, parts, table

#: Words in a block, output shards, weights of the sources in code-point order (repeating).
BLOCK_WORDS, SHARDS, WEIGHTS = 128, 64, (3, 1, 2)
#: Runs that a source's stream is cut into, at least, and rows for each of them beyond; slots exploded together. All depend
#: on the table alone, so that the draw is the same in any session.
RUNS, RUN_ROWS, SLOTS_TOGETHER = 1024, 1_000_000, 1 << 16
#: Words of the mix for each word there is; words taken of a source, at most, for each that it has.
SHARE, PASSES = 1.5, 2
#: Large primes: each is coprime to any smaller number, so i -> (i * prime + shift) mod n permutes 0..n-1.
PRIMES = (2305843009213693951, 4611686018427387847, 9223372036854775783, 1152921504606846883)
SEED = 42


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """source, source_size, target: target words by weight, each at most `passes` times the source's size.

    Sharing out the excess until nothing is above its bound is the same as filling all sources to one level per weight
    (`level`): those whose bound lies below the level stop there, found by one pass in the order of bound per weight.
    sizes has a row per source, so the windows here see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("w", F.element_at(ws, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("bound", F.lit(float(passes)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("bound") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("all_words", F.sum("source_size").over(everything) * share).withColumn("all_w", F.sum("w").over(everything))
    left = F.col("all_words") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    w_left = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    x = x.withColumn("level_here", left / w_left)
    x = x.withColumn("full", F.col("bound") / F.col("w") <= F.col("level_here"))
    full = F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(everything), F.lit(0.0))
    full_w = F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0.0))
    level = F.when(F.col("all_w") > full_w, (F.col("all_words") - full) / (F.col("all_w") - full_w))
    return x.withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(level * F.col("w"))).select("source", "source_size", F.col("target").cast("double").alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _permuted(i: Column, n: Column, name: Column, turn: Column) -> Column:
    """i's place in a pseudorandom permutation of 0..n-1 that depends on the source and the pass; decimals avoid overflow."""
    primes = F.array(*[F.lit(p) for p in PRIMES])
    prime = F.element_at(primes, (F.pmod(F.xxhash64(F.lit("prime"), name, turn), F.lit(len(PRIMES))) + 1).cast("int"))
    step = F.pmod(prime, n).cast("decimal(19,0)")
    shift = F.pmod(F.xxhash64(F.lit("shift"), name, turn), n).cast("decimal(19,0)")
    return ((i.cast("decimal(19,0)") * step + shift) % n.cast("decimal(19,0)")).cast("long")


def packed(docs: DataFrame, of_row: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their sizes and their places in their source's stream of words, and the sources with their sizes.

    The place is a running sum within one of many runs of a source, moved by the sizes of the runs before it; no task
    needs a whole source. Rows go to runs by id and text, so rows without an id spread too; the number of runs follows
    from the number of rows. Columns of_row are passed on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("rid"), *of_row), "mix-sizes")
    n_runs = max(RUNS, rows.count() // RUN_ROWS)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n_runs)))
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    runs = table(runs.withColumn("run_start", F.sum("run_size").over(Window.partitionBy("source").orderBy("run")) - F.col("run_size")), "mix-runs")
    sources = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    within = Window.partitionBy("source", "run").orderBy(F.asc_nulls_last("doc_id"), "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), "run_start")
    placed = rows.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r"))).withColumn("start", F.col("start") + F.col("run_start"))
    return placed.select("doc_id", "source", "size", "start", *of_row), sources


def drawn_blocks(plan: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """name, block, uses: how often each block of each source is drawn; plan has source, source_size, target."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    x = plan.where("source_size > 0").withColumn("name", name).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    # the last block is short: slots are words by the source's mean block length
    x = x.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("below", F.coalesce(F.sum("want").over(in_order), F.lit(0.0)) / shards).withColumn("above", F.col("below") + F.col("want") / shards)
    x = x.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # the shards' uniforms are an evenly spread sequence from a pseudorandom start, so their errors don't add up
    jitter = F.pmod(_uniform(F.lit("shard")) + F.col("shard") * F.lit(0.6180339887498949), F.lit(1.0))
    x = x.withColumn("n", (F.floor(F.col("above") + jitter) - F.floor(F.col("below") + jitter)).cast("long"))
    x = x.withColumn("first", F.sum("n").over(Window.partitionBy("name").orderBy("shard")) - F.col("n")).where("n > 0")
    # a shard's slots are exploded in parts, as their number grows with the input
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS_TOGETHER))))
    x = x.repartition(parts(plan), "name", "shard", "part")
    begin, end = F.col("first") + F.col("part") * SLOTS_TOGETHER, F.col("first") + F.col("n") - 1
    x = x.select("name", "blocks", F.explode(F.sequence(begin, F.least(end, begin + SLOTS_TOGETHER - 1))).alias("slot"))
    x = x.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("int")).where(F.col("turn") < PASSES)
    x = x.withColumn("block", _permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.col("name"), F.col("turn")))
    return x.groupBy("name", "block").agg(F.count(F.lit(1)).alias("uses"))


def mixed_pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, of_row: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): rows have doc_id, source, size, start, source_size, target and of_row; a piece is the words
    from_word (0-based) to to_word (exclusive) of the row at its source's place `start`, taken `uses` times."""
    placed, sources = packed(docs, of_row)
    plan = table(targets(sources), "mix-plan")
    placed = table(placed, "mix-places")
    uses = drawn_blocks(plan, block_words, shards)
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    full = placed.where("size > 0").withColumn("name", name)
    full = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    # the planner takes uses, which a few rows explode to, for small, and would broadcast it
    pieces = full.join(uses.hint("merge"), ["name", "block"]).select(
        "source",
        "start",
        "uses",
        F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).alias("from_word"),
        F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")).alias("to_word"),
        *of_row,
    )
    plan = plan.select(F.col("source").alias("s"), "source_size", "target")
    return placed.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s"), pieces


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    A null text has no words and a null source is a source of its own, last in order. Rows without words take part with
    0 words. Of rows with the same doc_id each has its own place in the stream. Other columns are ignored; an empty
    table gives an empty result. The draw depends on the rows alone, so reruns agree.
    """
    rows, pieces = mixed_pieces(docs, block_words, shards)
    # a place in a source's stream belongs to one row with words
    taken = pieces.groupBy(F.col("source").alias("s"), F.col("start").alias("p")).agg(F.sum(F.col("uses") * (F.col("to_word") - F.col("from_word"))).alias("taken"))
    rows = rows.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("p")) & (F.col("size") > 0), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """The mix as documents: each row cut to the words drawn of it, repeats included; others go.

    A row's drawn pieces stay in their order, each as often as drawn, joined by one space; of repeated rows each has its
    own pieces, so a row holds just what mixture() says is taken of it. n_chars follows the new text. Further columns of
    docs are kept. The rows are written once with a number of their own, by which pieces find them.
    """
    held = table(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("of_row")), "mix-rows")
    _, pieces = mixed_pieces(held.select("row.doc_id", "row.source", "row.text", "of_row"), block_words, shards, ["of_row"])
    drawn = pieces.groupBy("of_row").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word", "uses"))).alias("drawn"))
    out = held.join(drawn.hint("merge"), "of_row")
    # a lambda's variable holds the words, which are split once a row and after the shuffle
    words = F.array(F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), F.lit(1)))
    piece = lambda w, p: F.array_repeat(F.array_join(F.slice(w, (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")), " "), p["uses"].cast("int"))
    out = out.withColumn("text", F.element_at(F.transform(words, lambda w: F.array_join(F.flatten(F.transform("drawn", lambda p: piece(w, p))), " ")), 1))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
