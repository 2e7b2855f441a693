"""Handoff texts: the fenced meta block, secrets by line, and what sections must hold. Documents: doc_id, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import ascii_words, lines_of, stripped
from assaykit.operators.lint import lines_under, sectioned

# Fixed values of the handoff rules.
META_KEYS = ("written", "cwd", "root", "branch", "head", "focus", "dirty")
FENCE_WITHIN = 6
ABSOLUTE = r"^(?:/|[A-Za-z]:[\\/]|\\\\)"
SUBGROUPS = ("**Done and verified**", "**Done, unverified**", "**In flight**")
ANCHOR = (
    r"(\b[\w\-]+\.[A-Za-z0-9]{1,8}(:\d+)?\b"
    r"|(?:^|[\s(])/?[\w.\-]+/[\w.\-]+/[\w./\-]+"
    r"|`[^`\n]*/[^`\n]*`"
    r"|`[^`\n]+\s+[^`\n]+`)"
)
SECRETS = {
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "forty-characters": r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+=]{0,39}[A-Z])(?=[A-Za-z0-9/+=]{0,39}[a-z])(?=[A-Za-z0-9/+=]{0,39}\d)[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "gitlab-token": r"\bglpat-[A-Za-z0-9_\-]{20}\b",
    "npm-token": r"\bnpm_[A-Za-z0-9]{30,}\b",
    "stripe-key": r"\b[srp]k_(live|test)_[A-Za-z0-9]{16,}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "google-key": r"\bAIza[0-9A-Za-z_\-]{30,}\b",
    "sk-key": r"\bsk-[A-Za-z0-9_\-]{20,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}",
    "url-login": r"[A-Za-z][A-Za-z0-9+.\-]*://[^/\s:@]+:[^@\s]+@",
    "assignment": r"(?i)^[^=:\n]{0,64}(secret|token|passw|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|connection[_-]?string)[^=:\n]{0,32}[:=]\s*['\"]?(?![<$*{])[^\s'\"]{8,}",
}
#: What a line must hold for a pattern to be tried at all: keeps the costly ones from most lines.
NEEDS = {"url-login": "://", "jwt": "eyJ"}


def secret_lines(docs: DataFrame) -> DataFrame:
    """doc_id, secret, line: each kind of secret on each line. Row-local; nothing is shuffled."""
    gate = lambda k, s: F.contains(s, F.lit(NEEDS[k])) if k in NEEDS else F.lit(True)
    each = lambda s, i: F.transform(F.array_compact(F.array(*[F.when(gate(k, s) & s.rlike(ascii_words(p)), F.lit(k)) for k, p in SECRETS.items()])), lambda k: F.struct(k.alias("secret"), (i + 1).cast("long").alias("line")))
    return docs.select("doc_id", F.inline(F.flatten(F.transform(lines_of(F.coalesce("text", F.lit(""))), each))))


def meta(docs: DataFrame) -> DataFrame:
    """doc_id, opened (the line of the fence, from 0; -1: none), closed, entries (key, value in order) of the fenced block."""
    # only lines that may be a fence or an entry are stripped
    fences = lambda ls: F.transform(ls, lambda s: F.when(F.contains(s, F.lit("```")), stripped(s)).otherwise(""))
    x = docs.select("doc_id", lines_of(F.coalesce("text", F.lit(""))).alias("l")).withColumn("opened", F.array_position(fences(F.col("l")), F.lit("```yaml")) - 1)
    x = x.withColumn("rest", F.when(F.col("opened") >= 0, F.slice("l", (F.col("opened") + 2).cast("int"), F.size("l"))).otherwise(F.array().cast("array<string>")))
    x = x.withColumn("end", F.array_position(fences(F.col("rest")), F.lit("```"))).withColumn("block", F.when(F.col("end") > 0, F.slice("rest", F.lit(1), (F.col("end") - 1).cast("int"))).otherwise(F.col("rest")))
    named = F.filter(F.transform(F.filter("block", lambda s: F.contains(s, F.lit(":"))), stripped), lambda s: s.rlike("^[A-Za-z_]+:"))
    pair = F.transform(named, lambda s: F.struct(F.regexp_extract(s, "^([A-Za-z_]+):", 1).alias("key"), stripped(F.regexp_extract(s, "^[A-Za-z_]+:(.*)$", 1)).alias("value")))
    return x.select("doc_id", "opened", (F.col("end") > 0).alias("closed"), pair.alias("entries"))


def meta_findings(docs: DataFrame) -> DataFrame:
    """doc_id, code, key: faults of the fenced meta block. Without a block in the first lines nothing else is judged."""
    entries = F.col("entries")
    # the last of equal keys counts
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    told_of = lambda k: F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(-1))["value"]
    x = meta(docs).select("doc_id", "opened", "closed", "entries", *[told_of(k).alias(f"_{k}") for k in META_KEYS])
    value = lambda k: F.col(f"_{k}")
    fault = lambda code, key, when: F.when(when, F.array(F.struct(F.lit(code).alias("code"), (F.lit(key) if isinstance(key, str) else key).alias("key")))).otherwise(F.array().cast("array<struct<code:string,key:string>>"))
    keys = F.transform(entries, lambda e: e["key"])
    repeated = F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda o: o == k)) > 1)
    marked = F.filter(F.array_distinct(keys), lambda k: F.contains(last(k), F.lit("<")))
    each = lambda code, ks: F.transform(ks, lambda k: F.struct(F.lit(code).alias("code"), k.alias("key")))
    written = value("written")
    at = F.when(written.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(written, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    judged = F.concat(
        each("meta-duplicate", repeated),
        fault("meta-unclosed", "", ~F.col("closed")),
        *[fault("meta-missing", k, ~has(value(k))) for k in META_KEYS],
        each("meta-placeholder", marked),
        fault("meta-written", "written", has(written) & at.isNull()),
        fault("meta-year", "written", at.isNotNull() & ~F.year(at).between(2020, 2100)),
        *[fault("meta-path", k, has(value(k)) & ~value(k).rlike(ABSOLUTE)) for k in ("cwd", "root")],
        fault("meta-dirty", "dirty", has(value("dirty")) & ~value("dirty").isin("true", "false")),
    )
    absent = (F.col("opened") < 0) | (F.col("opened") >= FENCE_WITHIN)
    return x.select("doc_id", F.inline(F.when(absent, F.array(F.struct(F.lit("meta-absent").alias("code"), F.lit("").alias("key")))).otherwise(judged)))


def content_findings(docs: DataFrame) -> DataFrame:
    """doc_id, code, place: subgroups of the current state that are missing or empty, a next action without an anchor,
    decisions without their kind. place is the subgroup or the line. Row-local; nothing is shuffled."""
    text = lambda heading: F.array_join(F.transform(lines_under(heading), lambda s: s["content"]), "\n")
    x = sectioned(docs).select("doc_id", text("Current state").alias("body"), text("Next action").alias("action"), lines_under("Locked decisions and constraints").alias("decisions"))
    missing = F.filter(F.array(*map(F.lit, SUBGROUPS)), lambda s: ~F.contains("body", s))
    # the n-th piece after any subgroup's name belongs to the n-th subgroup, whichever names stand there
    pieces = F.split("body", "|".join(rf"\Q{s}\E" for s in SUBGROUPS))
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    empty = F.filter(F.transform(F.arrays_zip(F.array(*map(F.lit, SUBGROUPS)).alias("s"), pieces.alias("p")), lambda z: F.when(z["s"].isNotNull() & z["p"].isNotNull() & ~z["p"].rlike(r"(?m)(^\s*-\s+\S|^\s*None\s*$)"), z["s"])), lambda s: s.isNotNull())
    told = lambda code, places: F.transform(places, lambda p: F.struct(F.lit(code).alias("code"), p.alias("place")))
    immediate = lambda t: F.split(t, r"(?m)^\s*Then:?\s*$")[0]
    none = F.array().cast("array<string>")
    anchorless = F.when((F.col("action") != "") & ~immediate(F.col("action")).rlike(ascii_words(ANCHOR)), F.array(F.lit(""))).otherwise(none)
    loose = F.filter("decisions", lambda d: d["content"].rlike(r"^\s*-\s") & ~d["content"].rlike(r"^\s*-\s*(LOCKED:|revisit-if)"))
    loose = F.transform(loose, lambda d: d["line"].cast("string"))
    state = lambda places: F.when(F.col("body") != "", places).otherwise(none)
    found = F.concat(told("subgroup-missing", state(missing)), told("subgroup-empty", state(empty)), told("action-without-anchor", anchorless), told("decision-without-kind", loose))
    return x.select("doc_id", F.inline(found))
