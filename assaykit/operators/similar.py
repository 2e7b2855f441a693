"""Near-duplicate short texts by token sets: the larger of Jaccard similarity and containment.

Sets meet by a prefix index. Tokens have one global order, the rarest first. If two sets reach the threshold t, the smaller
one, of n tokens, shares at least ceil(t * n) with the other, so it shares one of its first n - ceil(t * n) + 1 tokens, its
prefix. So only prefixes are looked up, in the index of all tokens (containment holds for a larger set of any size, so its
tokens can't be cut short). A pair that meets at its prefix's place i and the other's place j can share no more than the tokens
after both, which bounds it before it is counted; common tokens, last in the order, hardly bring any pair together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import set_similarity, token_set
from assaykit.functions.shared import table

#: From this similarity on two texts say the same (fixed value).
SAME = 0.6
#: Tokens that a passage and a document must share in the passage's prefix.
MEETINGS = 4


def _counts(each: DataFrame, *group: str) -> DataFrame:
    """group, token, often: how many sets hold a token."""
    return table(each.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("often")), "token-counts")


def _ordered(sets: DataFrame, *group: str, often: DataFrame | None = None) -> DataFrame:
    """group, row, n, tokens, other columns: the sets with their tokens in the global order of their group, by how many sets
    hold a token (by `often` if given: 0 if not there), then by the token."""
    each = sets.select("row", *group, F.explode("tokens").alias("token"))
    if often is None:
        told = each.join(_counts(each, *group), [*group, "token"])
    else:
        told = each.join(often, [*group, "token"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    told = told.select("row", F.transform("t", lambda t: t["token"]).alias("tokens"), F.size("t").alias("n"))
    return sets.drop("tokens").join(told, "row")


def _least(n: Column, threshold: float) -> Column:
    """Tokens that a set of n tokens must share with a larger one; rounded down a little, so that no pair is lost."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _places(sets: DataFrame, side: str, upto: Column, *group: str) -> DataFrame:
    """group, token, row, n and place (from 0) of the tokens of a set up to a place."""
    return sets.select(*group, F.col("row").alias(f"row_{side}"), F.col("n").alias(f"n_{side}"), F.posexplode(F.slice("tokens", F.lit(1), upto)).alias(f"place_{side}", "token"))


def _prefix(sets: DataFrame, threshold: float, *group: str) -> DataFrame:
    return _places(sets, "s", F.col("n") - _least(F.col("n"), threshold) + 1, *group)


def candidates(small: DataFrame, large: DataFrame, threshold: float, when: str, *group: str) -> DataFrame:
    """row_s, row_l: pairs that meet in the prefix of the smaller set and may still share enough tokens.

    Of a pair that meets at several places the first one counts, which leaves the most.
    """
    met = _prefix(small, threshold, *group).join(_places(large, "l", F.col("n"), *group), [*group, "token"]).where(when)
    left = F.least(F.col("n_s") - F.col("place_s"), F.col("n_l") - F.col("place_l"))
    met = met.groupBy("row_s", "row_l").agg(F.max(left).alias("left"), F.first("n_s").alias("n_s"))
    return met.where(F.col("left") >= _least(F.col("n_s"), threshold)).select("row_s", "row_l")


def _verified(pairs: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """The pairs (row_a, row_b) whose sets reach the threshold, with `similarity` and the columns of both sides."""
    x = pairs.join(a.withColumnsRenamed({"row": "row_a", "n": "n_a", "tokens": "tokens_a"}), "row_a").join(b.withColumnsRenamed({"row": "row_b", "n": "n_b", "tokens": "tokens_b"}), "row_b")
    # exploded, as a plain column would be worked out anew wherever it is named
    x = x.withColumn("both", F.explode(F.array(F.size(F.array_intersect("tokens_b", "tokens_a")))))
    both = F.col("both")
    value = F.greatest(both / (F.col("n_a") + F.col("n_b") - both), both / F.least("n_a", "n_b"))
    return x.withColumn("similarity", value).drop("both").where(F.col("similarity") >= threshold).withColumn("similarity", F.round("similarity", 6))


def _token_sets(texts: DataFrame, text: Column, *columns: Column) -> DataFrame:
    # exploded, as a filter on a plain column would make the sets twice
    sets = texts.select(*columns, F.explode(F.filter(F.array(token_set(text)), lambda t: F.size(t) > 0)).alias("tokens"))
    # written, so that a row keeps its number
    return table(sets.withColumn("row", F.monotonically_increasing_id()), "token-sets")


def similar_pairs(texts: DataFrame, group: str, key: str, text: str, threshold: float = SAME) -> DataFrame:
    """group, a, b (a < b), similarity to 6 decimals of pairs in one group that reach the threshold. Keys are unique in a group."""
    sets = table(_ordered(_token_sets(texts, F.col(text), F.col(group), F.col(key).alias("k")), group), "ordered-sets")
    # of sets of one size that of the lesser row is taken for the smaller
    met = candidates(sets, sets, threshold, "n_s < n_l OR n_s = n_l AND row_s < row_l", group).toDF("row_a", "row_b")
    x = _verified(met, sets.withColumnRenamed("k", "k_a"), sets.drop(group).withColumnRenamed("k", "k_b"), threshold).where("k_a <> k_b")
    return x.select(group, F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), "similarity")


def _met_in(passages: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """row_a, row_b: documents (tokens: row, n, token) and passages of no more tokens that may share enough.

    k places more in the prefix than for one shared token must hold k more of those shared, which common tokens seldom do.
    """
    least = _least(F.col("n"), threshold)
    asked = F.least(F.lit(MEETINGS), least)
    prefix = passages.select(F.col("row").alias("row_b"), F.col("n").alias("n_s"), asked.alias("asked"), F.explode(F.slice("tokens", F.lit(1), F.col("n") - least + asked)).alias("token"))
    met = tokens.select("token", F.col("row").alias("row_a"), F.col("n").alias("n_l")).join(prefix, "token").where("n_s <= n_l")
    return met.groupBy("row_a", "row_b", "asked").count().where("count >= asked").select("row_a", "row_b")


def contained_passages(docs: DataFrame, passages: DataFrame, threshold: float = SAME) -> DataFrame:
    """doc_id, item_id, similarity of documents and passages by token sets; either may be the smaller set.

    A document's tokens need no order where the passage is the smaller set: its prefix alone is looked up, in the order of how
    many documents hold a passage's token. Only documents of fewer tokens than some passage are ordered themselves.
    """
    d = _token_sets(docs, F.coalesce("text", F.lit("")), F.col("doc_id")).withColumn("n", F.size("tokens"))
    p = _token_sets(passages, F.col("text"), F.col("item_id")).withColumn("row", -1 - F.col("row"))
    tokens = d.select("row", "n", F.explode("tokens").alias("token"))
    often = _counts(tokens.join(p.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi"))
    small = table(_ordered(p, often=often), "ordered-sets")
    met = _met_in(small, tokens, threshold)
    # the other direction: one order for the few tokens of both
    longest = small.agg(F.max("n").alias("longest"))
    short = d.join(longest, F.col("n") < F.col("longest")).select("row", "tokens")
    sets = table(_ordered(short.unionByName(p.select("row", "tokens"))), "ordered-sets")
    met = met.unionByName(candidates(sets.where("row >= 0"), sets.where("row < 0"), threshold, "n_s < n_l").toDF("row_a", "row_b"))
    return _verified(met, d, small, threshold).select("doc_id", "item_id", "similarity")


__all__ = ["SAME", "contained_passages", "set_similarity", "similar_pairs"]
