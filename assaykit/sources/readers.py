"""Readers of assessment records: JSON blocks in pages, fenced and fronted Markdown, JSON lines, file fingerprints.

All are DataFrame expressions over Spark's own readers; a bad record is a row with an error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.scalars import lines_of, stripped

#: Folders that no walk enters (fixed values).
IGNORED = (".git", "node_modules", "dist", "build", "coverage", ".cache", "__pycache__", ".venv", "venv")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def islands(pages: DataFrame, text: str, element: str) -> DataFrame:
    """pages with `island` (VARIANT) and `error`: the JSON of the script element with that id."""
    raw = F.regexp_extract(F.col(text), f"(?s)<script[^>]*\\bid=[\"']{element}[\"'][^>]*>(.*?)</script>", 1)
    island = F.try_parse_json(F.nullif(stripped(raw), F.lit("")))
    error = F.when(raw == "", "island-absent").when(island.isNull(), "island-invalid")
    return pages.withColumn("island", island).withColumn("error", error)


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """path, record (VARIANT), error of each file that is to hold one JSON value; json_records() tells the errors."""
    return json_records(whole_texts(spark, path), "text").drop("text")


def json_records(rows: DataFrame, text: str) -> DataFrame:
    """rows with `record` (VARIANT) and `error`: json-absent for a null or blank text, json-invalid for one that isn't JSON."""
    record = F.try_parse_json(F.nullif(stripped(F.col(text)), F.lit("")))
    error = F.when(F.coalesce(stripped(F.col(text)), F.lit("")) == "", "json-absent").when(record.isNull(), "json-invalid")
    return rows.withColumn("record", record).withColumn("error", error)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, entry (VARIANT) for each line that is JSON; others are skipped."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(lines_of(F.col("value"))))
    return rows.select("path", (F.col("pos") + 1).alias("line"), F.try_parse_json("col").alias("entry")).where("entry IS NOT NULL")


def last_usage(entries: DataFrame, session: str = "path", place: str = "line") -> DataFrame:
    """session, place, tokens of the last assistant entry outside side chains that has a usage record."""
    get = lambda p, t: F.try_variant_get("entry", p, t)
    x = entries.select(
        session,
        place,
        get("$.type", "string").alias("type"),
        F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("side"),
        get("$.message.usage.input_tokens", "long").alias("i"),
        F.coalesce(get("$.message.usage.cache_read_input_tokens", "long"), F.lit(0)).alias("r"),
        F.coalesce(get("$.message.usage.cache_creation_input_tokens", "long"), F.lit(0)).alias("c"),
    )
    x = x.where("type = 'assistant' AND NOT side AND i IS NOT NULL").withColumn("tokens", F.col("i") + F.col("r") + F.col("c"))
    return x.groupBy(session).agg(F.max_by(F.struct(place, "tokens"), place).alias("u")).select(session, "u.*")


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stripped(x), '^"+|"+$', ""), "^'+|'+$", "")


def frontmatter(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fields (MAP of strings), body and error: `key: value` lines between two lines of hyphens at the top.

    What follows # is a comment; of repeated keys the last counts.
    """
    pattern = "(?s)\\A---\\s*\\n(.*?)\\n---\\s*(?:\\n|\\z)"
    lines = F.filter(F.transform(lines_of(F.regexp_extract(F.col(text), pattern, 1)), lambda s: F.regexp_replace(F.regexp_replace(s, "#.*$", ""), "\\s+$", "")), lambda s: stripped(s) != "")
    # columns of their own, so that each is worked out once a row
    x = docs.withColumn("_there", F.col(text).rlike(pattern)).withColumn("_lines", lines)
    pair = F.transform("_lines", lambda s: F.struct(stripped(F.regexp_extract(s, "^([^:]*):", 1)).alias("key"), _unquoted(F.regexp_extract(s, "^[^:]*:(.*)$", 1)).alias("value")))
    x = x.withColumn("_pairs", pair).withColumn("_bad", F.exists("_lines", lambda s: ~F.contains(s, F.lit(":"))))
    keys = F.array_distinct(F.transform("_pairs", lambda p: p["key"]))
    # the last of equal keys, without the session's map policy mattering
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter("_pairs", lambda p: p["key"] == k), -1)["value"].alias("value")))
    there, bad = F.col("_there"), F.col("_bad")
    error = F.when(~there, "frontmatter-missing").when(bad, "frontmatter-line")
    x = x.withColumn("fields", F.when(there & ~bad, F.map_from_entries(last))).withColumn("body", F.regexp_replace(F.col(text), pattern, "")).withColumn("error", error)
    return x.drop("_there", "_lines", "_pairs", "_bad")


#: What a value must be for the indented lines below it to be the value (fixed values).
BLOCK_SCALARS = ("|", ">", "|-", ">-", "|+", ">+")


def block_frontmatter(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fields (MAP of strings) and error: front matter whose values may be blocks of indented lines.

    The lines of a block that `|` opens are joined by line ends, those of `>` by spaces; indentation goes. Other indented
    lines, blank ones, comments and lines without a colon name nothing. The last of equal keys counts.
    """
    x = docs.withColumn("_lines", lines_of(F.coalesce(F.col(text), F.lit(""))))
    fence = lambda s: stripped(s) == "---"
    there = F.coalesce(fence(F.get("_lines", F.lit(0))), F.lit(False))
    rest = F.when(there, F.slice("_lines", F.lit(2), F.size("_lines"))).otherwise(F.array().cast("array<string>"))
    x = x.withColumn("_there", there).withColumn("_rest", rest)
    x = x.withColumn("_end", F.array_position(F.transform("_rest", fence), F.lit(True)))
    x = x.withColumn("_block", F.slice("_rest", F.lit(1), F.greatest(F.col("_end") - 1, F.lit(0)).cast("int")))
    # one pass with the entries so far, and whether indented lines belong to the last of them
    entry = "struct<key:string,mark:string,parts:array<string>>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("entries"), F.lit(False).alias("within"))

    def step(state: Column, line: Column) -> Column:
        entries, blank = state["entries"], stripped(line) == ""
        indented = blank | line.rlike("^[ \\t]")
        value = stripped(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
        opens = value.isin(*BLOCK_SCALARS)
        new = F.struct(
            stripped(F.regexp_extract(line, "^([^:]*):", 1)).alias("key"),
            F.when(opens, F.substring(value, 1, 1)).otherwise(F.lit("")).alias("mark"),
            F.when(opens, F.array().cast("array<string>")).otherwise(F.array(_unquoted(value))).alias("parts"),
        )
        last = F.element_at(entries, -1)
        longer = F.struct(last["key"].alias("key"), last["mark"].alias("mark"), F.array_append(last["parts"], F.regexp_replace(line, "^\\s+", "")).alias("parts"))
        kept = F.slice(entries, F.lit(1), F.size(entries) - 1)
        names = line.rlike("^[^\\s#][^:]*:|^:")
        entries = F.when(state["within"] & indented, F.array_append(kept, longer)).when(names & ~blank, F.array_append(entries, new)).otherwise(entries)
        within = F.when(state["within"] & indented, F.lit(True)).otherwise(names & ~blank & opens)
        return F.struct(entries.alias("entries"), within.alias("within"))

    x = x.withColumn("_entries", F.aggregate("_block", start, step)["entries"])
    joined = lambda e: stripped(F.when(e["mark"] == "|", F.array_join(e["parts"], "\n")).otherwise(F.array_join(e["parts"], " ")))
    keys = F.array_distinct(F.transform("_entries", lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), joined(F.element_at(F.filter("_entries", lambda e: e["key"] == k), -1)).alias("value")))
    x = x.withColumn("fields", F.when(F.col("_there") & (F.col("_end") > 0), F.map_from_entries(last)))
    x = x.withColumn("error", F.when(~F.col("_there"), "frontmatter-missing").when(F.col("_end") == 0, "frontmatter-unclosed"))
    return x.drop("_lines", "_there", "_rest", "_end", "_block", "_entries")


def tickets(files: DataFrame) -> DataFrame:
    """path, id, title, type, state, claimed_by, blocked_by, has_resolution and error of ticket texts (path, text).

    All errors come out as rows; a caller that must stop at any asks for the rows with one.
    """
    x = frontmatter(files)
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    x = x.withColumn("blocked_by", F.when(F.col("error").isNull(), id_list(get("blocked_by"))))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "[.]md$", "")
    return x.select(
        "path",
        F.when(get("id").rlike("^-*[0-9]+$"), get("id").try_cast("long")).alias("id"),
        F.when(get("title") == "", stem).otherwise(get("title")).alias("title"),
        get("type").alias("type"),
        get("state").alias("state"),
        F.when(get("claimed_by") == "", get("assignee")).otherwise(get("claimed_by")).alias("claimed_by"),
        "blocked_by",
        F.col("body").rlike("(?m)^##\\s+Resolution\\b").alias("has_resolution"),
        F.coalesce("error", F.when(F.col("blocked_by").isNull(), "blocked-by-invalid")).alias("error"),
    )


def filled(templates: DataFrame, markers: Mapping[str, Column], text: str = "template") -> DataFrame:
    """templates with output, bytes, sha256 and error: each marker, in the order given, must stand in the text exactly once
    when its turn comes, and its value takes its place; otherwise there is no output."""
    out, error = F.col(text), F.lit(None).cast("string")
    for marker, value in markers.items():
        n = F.size(F.split(out, f"\\Q{marker}\\E", -1)) - 1
        error = F.coalesce(error, F.when(n == 0, f"marker-missing:{marker}").when(n > 1, f"marker-duplicate:{marker}"))
        out = F.replace(out, F.lit(marker), value.cast("string"))
    x = templates.withColumn("error", error).withColumn("output", F.when(F.col("error").isNull(), out))
    return x.withColumn("bytes", F.octet_length("output").cast("long")).withColumn("sha256", F.sha2("output", 256))


def id_list(x: Column) -> Column:
    """Ids of a list such as "[1, 2]" or "1, 2"; null if an entry is no number."""
    inner = F.regexp_replace(stripped(F.coalesce(x, F.lit(""))), "^\\[(.*)\\]$", "$1")
    parts = F.filter(F.transform(F.split(inner, ","), stripped), lambda p: p != "")
    return F.when(F.forall(parts, lambda p: p.rlike("^[0-9]+$")), F.transform(parts, lambda p: p.cast("long")))


def file_fingerprints(spark: SparkSession, path: str, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """path, bytes, sha256 of all files under a folder but those in ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*ignored))
    return files.where(~inside).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def repository_fingerprint(files: DataFrame) -> DataFrame:
    """One row: files, bytes, fingerprint, which changes with any path or content and not with their order."""
    one = F.sha2(F.concat_ws("\n", "path", "sha256"), 256)
    # sums of parts of the digests are the same in any order, and partial sums combine
    part = lambda i: F.sum(F.conv(F.substring(one, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.concat_ws("/", *[part(i).cast("string") for i in range(5)]), 256).alias("fingerprint"))


def changed_paths(status: Column) -> Column:
    """Sorted distinct paths of a NUL-separated status listing; a rename or copy has a second path, which counts too."""
    tokens = F.filter(F.split(status, "\\x00"), lambda t: t != "")
    # the token after one that begins with R or C is a bare path
    start = F.struct(F.array().cast("array<string>").alias("paths"), F.lit(False).alias("bare"))
    step = lambda s, t: F.struct(F.array_append(s["paths"], F.when(s["bare"], t).otherwise(t.substr(F.lit(4), F.length(t)))).alias("paths"), (~s["bare"] & t.rlike("^[RC]|^.[RC]")).alias("bare"))
    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["paths"]))


def write_once(df: DataFrame, path: str) -> None:
    """Writes JSON lines; refuses if the target exists."""
    df.write.mode("errorifexists").json(path)
