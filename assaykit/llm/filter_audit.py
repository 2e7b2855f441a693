"""Filter interaction audit in long form, with DataFrame functions.

Each document becomes a mask of the filters that it fails. Documents of one part and mask behave alike in any order of the
filters, so the corpus shrinks to a few counted mask cells a part. The cells are unpivoted against the steps of every
order; a running bit-or over the earlier steps tells what a cell failed before, conditional sums give the metrics of a
step, and totals by filter window over all orders give its Shapley share.

A filter that looks at other rows ("identical to a smaller doc_id's text") is settled by counting: equal texts are told by
SHA-256, their copies are combined before they are shuffled, and rows of a text meet only as one row a part and label.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import order_id, table

#: Separators of words, and characters that fail filter D.
SEPARATORS, MARKUP = "[\\x20\\x09-\\x0D]+", "[#$%&*|]"
#: The filters' letters; filter k has bit 1 << k.
FILTERS = "ABCDE"
#: Keys over which rows without a doc_id are spread.
NULL_KEYS = 1024


def row_filters(text: Column) -> list[Column]:
    """Whether a text fails A to D: under 200 words; distinct words under half; over 3 % of A-Z; a character of MARKUP."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    n = F.size(words).cast("long")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n, 100 * capitals > 3 * F.char_length(text).cast("long"), text.rlike(MARKUP)]


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just the filters of the mask, and their labels.

    A null text counts as empty and a null part as an empty string. A doc_id that labels tells more than once is good or
    toxic if any of its rows says so; null labels say nothing, and rows without a doc_id have no labels. A text fails the
    last filter if it is identical to one of a row with a smaller doc_id (null ranks last), so rows that repeat the smallest
    id of a text all pass. Other columns are ignored; an empty table has no cells.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    failed = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(row_filters(text))]
    own = sum(failed[1:], failed[0])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), order_id().alias("did"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("digest"), own.alias("own"),
    )
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_KEYS)) + 1).otherwise(F.lit(0).cast("long")))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    # written first, so that both sides of the join are plain shuffles and a hot id can be split
    said = table(said.withColumn("spread", F.lit(0).cast("long")), "audit-labels")
    rows = rows.join(said, ["id", "spread"], "left").na.fill(0, ["good", "toxic"])
    kinds = ("digest", "own", "part", "good", "toxic")
    once = rows.groupBy(*kinds, "did").agg(F.count(F.lit(1)).alias("n"))
    of_text = once.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("did").alias("low"), F.min_by("n", "did").alias("at_low"))
    # a text has one row here for each part and label it occurs with, however many copies there are
    first = F.col("low") == F.min("low").over(Window.partitionBy("digest"))
    of_text = of_text.withColumn("passed", F.when(first, F.col("at_low")).otherwise(F.lit(0)))
    repeat = 1 << len(failed)
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("passed").alias("n")), F.struct((F.col("own") + repeat).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    cells = of_text.select("part", "good", "toxic", both.alias("cell")).select("part", "cell.mask", "cell.n", (F.col("good") * F.col("cell.n")).alias("good"), (F.col("toxic") * F.col("cell.n")).alias("toxic"))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(cells: DataFrame, filters: str = FILTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """The metrics of every step of every order (all permutations of the filters by default), one row per part, zeros included.

    cells has part, mask, n, good, toxic; bit k of mask is filters[k]. kept, removed, redundant, unique_fails, good_lost and
    toxic_lost count documents; shapley is what the step's filter removes, summed over all orders.
    """
    orders = orders or ["".join(p) for p in itertools.permutations(filters)]
    long = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    long = long.withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(filters))])))
    long = long.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.col("filter"))
    long = long.withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
