"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy, as a list of
alternatives, each a set of trigrams that must all occur. The index has a posting for each document and trigram of these
queries. Intersecting postings gives each rule's candidate documents; the expression itself runs on these alone. A rule
without mandatory trigrams runs on all documents, in the scan that builds the index. Of the texts only those are shuffled
that have the rarest trigram, by its number of postings, of some alternative.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import keyed, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where the expression matches and `group` has at least `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base kinds, in their order (fixed values).
BASE = (
    Rule("assign", """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]+", 16),
)
#: Further public token formats, after the base kinds. Stretches that can begin at many places and then fail are bounded, so
#: that each expression takes time in proportion to the text.
FURTHER = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,512}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]*"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", "[a-z]{1,20}://[^\\x20\\x09-\\x0D/:@]+:[^\\x20\\x09-\\x0D/:@]+@"),
)
RULES = (*BASE, *FURTHER)
#: Most strings kept apart while deriving a query; beyond, the query just asks for less.
MOST_STRINGS = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _simplest(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    return _simplest(frozenset(x | y for x, y in product(a, b)))


def _of_strings(strings: set[str]) -> Query:
    """What a text with one of the strings must have, in lower case."""
    return _simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, in lower case, of which each match has one completely; ANY if nothing is mandatory."""
    from re import _constants as c
    from re import _parser

    def sequence(items) -> tuple[set[str] | None, Query]:
        """The strings that the items spell, if these are few, and what else must occur."""
        query, now, exact = ANY, {""}, True
        for kind, value in items:
            strings, more = item(kind, value)
            query = _both(query, more)
            if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
                now = {a + b for a in now for b in strings}
            else:
                query, exact = _both(query, _of_strings(now)), False
                now = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
        return (now, query) if exact else (None, _both(query, _of_strings(now)))

    def item(kind, value) -> tuple[set[str] | None, Query]:
        if kind is c.LITERAL:
            return {chr(value).lower()}, ANY
        if kind is c.IN and all(k is c.LITERAL for k, _ in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}, ANY
        if kind is c.SUBPATTERN:
            return sequence(value[-1])
        if kind is c.BRANCH:
            found = [sequence(x) for x in value[1]]
            if all(s is not None for s, _ in found):
                return set().union(*(s for s, _ in found)), ANY
            return None, _simplest(frozenset().union(*(_both(q, _of_strings(s) if s is not None else ANY) for s, q in found)))
        if kind in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = value
            strings, query = sequence(inner)
            if (low, high) == (0, 1) and strings is not None:
                return strings | {""}, ANY
            if low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
                return {"".join(x) for x in product(strings, repeat=low)}, ANY
            return None, (_both(query, _of_strings(strings)) if strings is not None else query) if low else ANY
        if kind is c.AT:
            return {""}, ANY
        return None, ANY

    strings, query = sequence(_parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def present(low: Column, trigrams: Sequence[str]) -> Column:
    """Those of the given trigrams that stand in a lower-cased text."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """did, rid, kinds: the rules that a document may match, from the index's postings (did, rid, trigram). The query table
    has as many rows as the rules have trigrams."""
    asked = [(kind, i, len(a), t) for kind, q in queries.items() for i, a in enumerate(sorted(q, key=sorted)) for t in sorted(a)]
    asked = index.sparkSession.createDataFrame(asked, "kind string, alternative int, needed long, trigram string")
    met = index.distinct().join(F.broadcast(asked), "trigram").groupBy("did", "rid", "kind", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("did", "rid").agg(F.collect_set("kind").alias("kinds"))


MATCHES = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"


def _found(rule: Rule, number: int, asked: Column | None) -> Column:
    """An array of (kind, place in order, characters before it since the last match, its length, whether it counts)."""
    # a run of one class is found at once when the least length is part of the expression
    pattern = re.sub(r"^(\[[^]]*\])\+$", rf"\1{{{rule.least},}}", rule.pattern)
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split("text", pattern), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(whole.alias("w"), gaps.alias("g"), judged.alias("j"))
    each = F.transform(zipped, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"), F.char_length(x["w"]).alias("size"), (F.char_length(x["j"]) >= rule.least).alias("ok")))
    here = F.col("text").rlike(pattern)
    return F.when(here if asked is None else asked & here, each.cast(MATCHES)).otherwise(F.array().cast(MATCHES))


def _places(found: DataFrame) -> DataFrame:
    """did, rid, kind, start, stop of the matches that count, from did, rid and an array of _found() of each row."""
    each = found.select("did", "rid", F.inline("found"))
    before = Window.partitionBy("did", "rid", "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.col("size")).over(before)
    return each.withColumn("stop", stop).where("ok").select("did", "rid", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(rows, secrets): did, rid, doc_id of each row; did, rid, kind (the rule's number), start, stop for each secret of
    each distinct row, places in code points.

    Matches of a rule are the leftmost that don't overlap, those with too short a group dropped afterwards.
    """
    rows = keyed(docs)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    trigrams = sorted({t for q in indexed.values() for a in q for t in a})
    scanned = [_found(r, i, None) for i, r in enumerate(rules) if r.kind not in indexed]
    # a projection of its own, so that a text is lower-cased once and not for each trigram
    low = rows.withColumn("low", F.lower("text"))
    scan = table(low.select("did", "rid", "doc_id", present(F.col("low"), trigrams).alias("trigrams"), F.concat(F.array().cast(MATCHES), *scanned).alias("found")), "trigrams")
    index = scan.select("did", "rid", F.explode("trigrams").alias("trigram"))
    # as many rows as the rules have trigrams
    postings = {r["trigram"]: r["count"] for r in index.groupBy("trigram").count().collect()}
    rarest = sorted({min(a, key=lambda t: (postings.get(t, 0), t)) for q in indexed.values() for a in q})
    found = []
    if scanned:
        found.append(scan.select("did", "rid", "found").where(F.size("found") > 0))
    if rarest := [t for t in rarest if t in postings]:
        likely = low.where(reduce(or_, (F.contains("low", F.lit(t)) for t in rarest))).select("did", "rid", "text")
        met = likely.join(candidates(index, indexed), ["did", "rid"])
        matches = F.concat(*[_found(r, i, F.array_contains("kinds", r.kind)) for i, r in enumerate(rules) if r.kind in indexed])
        found.append(met.select("did", "rid", matches.alias("found")).where(F.size("found") > 0))
    # kinds of the two parts differ, and repeated rows find the same twice
    places = [_places(f.dropDuplicates(["did", "rid"])) for f in found]
    return scan.select("did", "rid", "doc_id"), reduce(DataFrame.unionByName, places)


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row per row of docs: doc_id, a count for each of the first `base` rules (n_<kind>), their spans and all spans,
    as kind:start:end by start, then in the rules' order, joined by commas.

    A null text counts as empty; without secrets the strings are empty. Repeated rows get repeated results; other
    columns are ignored; an empty table gives an empty result. Time grows in proportion to a text's length, whatever it
    holds. Where spans start alike, the rules' order decides.
    """
    name = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind") + 1)
    rows, each = secrets(docs, rules)
    each = each.withColumn("told", F.concat_ws(":", name, "start", "stop"))
    told = lambda wanted: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("start", "kind", "told")))), lambda x: x["told"]), ",")
    counts = [F.count_if(F.col("kind") == i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    by_row = each.groupBy("did", "rid").agg(*counts, told(F.col("kind") < base).alias("base_spans"), told(F.lit(True)).alias("spans"))
    by_row = by_row.withColumnsRenamed({"did": "d", "rid": "r"})
    out = rows.join(by_row, (F.col("did") == F.col("d")) & (F.col("rid") == F.col("r")), "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in rules[:base]],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
