"""Release rules over many files: phrases that no file may hold, phrases that one must hold, and files that must parse.

Files: release, path, text. All phrases of a rule set are looked for together, by one automaton that runs once over each text;
what it meets is rows, and what is missing is found by anti-joins, so nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import stripped


class Phrase(NamedTuple):
    """A phrase and what is told of it. required: some file must hold it, else none may; fold: in either case of letters; name: as
    a whole word, not behind a $ or / (which mark a call by name)."""

    code: str
    phrase: str
    required: bool = False
    fold: bool = False
    name: bool = False


def is_name(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands alone as a name."""
    word = lambda c: c.isalnum() or c == "_"
    before, after = text[start - 1 : start], text[end : end + 1]
    return before not in ("$", "/") and not (before and word(before)) and not (after and word(after))


def met_phrases(files: DataFrame, phrases: Sequence[Phrase]) -> DataFrame:
    """release, path, line, rule (the phrase's place in `phrases`), content: a row for each line and phrase on it.

    Lines end at a line feed. Letters are folded one by one where that keeps a text's length; other characters are compared as
    they are. A null text has no lines.
    """
    phrases = list(phrases)
    if not phrases or any(not p.phrase or "\n" in p.phrase for p in phrases):
        raise ValueError("phrases have text, within a line")

    def folded(text: str) -> str:
        low = text.lower()
        return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, rules = ahocorasick.Automaton(), {}
        for i, p in enumerate(phrases):
            rules.setdefault(folded(p.phrase), []).append(i)
        for key, value in rules.items():
            machine.add_word(key, (len(key), value))
        machine.make_automaton()
        for batch in batches:
            out = []
            for release, path, text in zip(*(batch.column(c).to_pylist() for c in ("release", "path", "text")), strict=True):
                seen, line, upto = set(), 1, 0
                for last, (size, ids) in machine.iter(folded(text)):
                    start, end = last - size + 1, last + 1
                    line, upto = line + text.count("\n", upto, start), max(upto, start)
                    for i in ids:
                        p = phrases[i]
                        at = line if start >= upto else text.count("\n", 0, start) + 1
                        if (at, i) in seen or not p.fold and text[start:end] != p.phrase or p.name and not is_name(text, start, end):
                            continue
                        seen.add((at, i))
                        begin, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
                        out.append((release, path, at, i, text[begin : stop if stop >= 0 else len(text)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["release", "path", "line", "rule", "content"])

    rows = files.where("text IS NOT NULL").select(F.col("release").cast("string").alias("release"), F.col("path").cast("string").alias("path"), "text")
    return rows.mapInArrow(run, "release string, path string, line long, rule int, content string")


def phrase_findings(files: DataFrame, phrases: Sequence[Phrase], shown: int = 90) -> DataFrame:
    """release, path, line, code, phrase, excerpt: forbidden phrases where they stand, and required ones that no file of a release
    holds (path and line null). excerpt is the line's begin."""
    spark = files.sparkSession
    rules = spark.createDataFrame([(i, p.code, p.phrase, p.required) for i, p in enumerate(phrases)], "rule int, code string, phrase string, required boolean")
    met = met_phrases(files, phrases).join(F.broadcast(rules), "rule")  # the rule set is an argument
    stale = met.where("NOT required").select("release", "path", "line", "code", "phrase", F.left(stripped(F.col("content")), F.lit(shown)).alias("excerpt"))
    wanted = [F.struct(F.lit(i).alias("rule"), F.lit(p.code).alias("code"), F.lit(p.phrase).alias("phrase")) for i, p in enumerate(phrases) if p.required]
    if not wanted:
        return stale
    releases = files.select(F.col("release").cast("string").alias("release")).distinct().select("release", F.inline(F.array(*wanted)))
    missing = releases.join(met.where("required").select("release", "rule").distinct(), ["release", "rule"], "left_anti")
    return stale.unionByName(missing.select("release", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"), "code", "phrase", F.lit("").alias("excerpt")))


def parse_findings(files: DataFrame, code: str = "PARSE-FAILURE") -> DataFrame:
    """release, path, code of JSON files whose text isn't JSON."""
    bad = F.try_parse_json(F.nullif(stripped(F.coalesce("text", F.lit(""))), F.lit(""))).isNull()
    return files.where(F.col("path").endswith(".json") & bad).select("release", "path", F.lit(code).alias("code"))
