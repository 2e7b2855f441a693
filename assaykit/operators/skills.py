"""Skill packages as tables: front matter, bodies, folder structure, links between files.

Skills: skill_id, directory, name, description, when_to_use, context, agent, effort, and flags by their names. Files:
skill_id, path (relative, with forward slashes), text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import has_text, lines_of, stripped
from assaykit.operators.findings import Rule, run_rules

# Fixed values of the skill rules.
NAME = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
LONGEST_DESCRIPTION, MOST_LINES = 1536, 500
PERSON = r"(?i)^(I|We|You)\b"
TRIGGER = r"(?i)\bUse when\b"
NON_GOAL = r"(?i)\b(?:Do not use|Don't use|Not for)\b"
FLAGS = ("disable-model-invocation", "user-invocable")
EFFORTS = ("low", "medium", "high", "xhigh", "max")
PLACEHOLDERS = ("TODO", "TBD", "FIXME", "XXX")
SECRETS = {
    "api-key": r"\bsk-[A-Za-z0-9_-]{16,}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "private-key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
RISKS = {
    "destructive-shell-command": r"(?i)\brm\s+-rf\b|\bdel\s+/[sq]\b",
    "privilege-escalation": r"\bsudo\b|\bRunAs\b",
    "implicit-latest-dependency": r"\bnpx\s+\S+@latest\b|\bpip\s+install\b|\bnpm\s+install\b",
    "network-fetch": r"\bcurl\b|\bwget\b|Invoke-WebRequest",
    "dynamic-evaluation": r"\beval\s*\(|\bexec\s*\(",
}
FOLDERS = ("references", "assets", "scripts")
EXTRA_DOCS = ("README.md", "CHANGELOG.md", "INSTALLATION_GUIDE.md")
LINK = r"\[[^\]]*\]\(([^)]+)\)"
CODE_PATH = r"`((?:references|assets|scripts)/[^`\s]+)`"
ELSEWHERE = "^(?:#|http://|https://|mailto:|data:)"


def frontmatter_findings(skills: DataFrame, reserved: Sequence[str] = ()) -> DataFrame:
    """Faults of a skill's front matter; reserved: words that a name's hyphenated parts should avoid."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    name, description, context = text("name"), text("description"), text("context")
    flags = [f for f in FLAGS if f in skills.columns]
    flag = lambda f: F.lower(text(f"`{f}`"))
    return run_rules(
        skills,
        "skill",
        "skill_id",
        [
            Rule("name.missing", name == "", "name", "warning"),
            Rule("name.format", (name != "") & ~name.rlike(NAME), "name", "warning"),
            Rule("name.directory", (name != "") & (name != F.col("directory")), "name", "warning"),
            Rule("name.reserved", F.arrays_overlap(F.split(name, "-"), F.array(*map(F.lit, reserved)).cast("array<string>")), "name", "warning"),
            Rule("name.xml", name.rlike("[<>]"), "name"),
            Rule("description.missing", description == "", "description", "warning"),
            Rule("description.length", (description != "") & (F.char_length(description) + F.char_length(text("when_to_use")) > LONGEST_DESCRIPTION), "description"),
            Rule("description.person", description.rlike(PERSON), "description", "warning"),
            Rule("description.trigger", (description != "") & ~description.rlike(TRIGGER), "description", "warning"),
            Rule("description.nongoal", (description != "") & ~description.rlike(NON_GOAL), "description", "warning"),
            Rule("description.xml", description.rlike("[<>]"), "description"),
            *[Rule("frontmatter.bool", ~flag(f).isin("", "true", "false"), f) for f in flags],
            Rule("frontmatter.context", ~context.isin("", "fork"), "context"),
            Rule("frontmatter.agent-without-fork", has_text(F.col("agent")) & (context != "fork"), "agent", "warning"),
            Rule("frontmatter.effort", ~text("effort").isin("", *EFFORTS), "effort"),
        ],
    )


#: Values that begin a block of indented lines (fixed values).
BLOCKS = ("|", ">", "|-", ">-", "|+", ">+")


def syntax_findings(files: DataFrame) -> DataFrame:
    """skill_id, code, line (from 1) of the front matter of main files: frontmatter.missing, .unclosed, .nested for indented lines
    outside a block, .syntax for lines without a colon. files: skill_id, path, text. Folded within the row."""
    lines = lines_of(F.coalesce("text", F.lit("")))
    x = files.where(F.col("path") == "SKILL.md").select("skill_id", lines.alias("l"))
    x = x.withColumn("t", F.transform("l", stripped)).withColumn("opened", F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")) == "---")
    x = x.withColumn("end", F.array_position(F.slice("t", 2, F.size("t")), F.lit("---")))
    found = "array<struct<code:string,line:bigint>>"
    start = F.struct(F.lit(False).alias("block"), F.lit(1).cast("long").alias("i"), F.array().cast(found).alias("found"))

    def step(s, raw):
        blank, indented = stripped(raw) == "", raw.rlike("^[ \t]")
        held = s["block"] & (blank | indented)
        silent = held | blank | F.ltrim(raw).startswith("#")
        code = F.when(silent, F.lit(None)).when(indented, "frontmatter.nested").when(~F.contains(raw, F.lit(":")), "frontmatter.syntax")
        begins = ~silent & ~indented & stripped(F.regexp_extract(raw, "^[^:]*:(.*)$", 1)).isin(*BLOCKS)
        told = F.when(code.isNull(), s["found"]).otherwise(F.array_append(s["found"], F.struct(code.alias("code"), (s["i"] + 1).alias("line"))))
        # a blank or comment line outside a block ends none
        return F.struct((held | begins).alias("block"), (s["i"] + 1).alias("i"), told.alias("found"))

    inner = F.aggregate(F.slice("l", F.lit(2), F.greatest(F.col("end") - 1, F.lit(0)).cast("int")), start, step)["found"]
    one = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("line"))).cast(found)
    return x.select("skill_id", F.inline(F.when(~F.col("opened"), one("frontmatter.missing")).when(F.col("end") == 0, one("frontmatter.unclosed")).otherwise(inner)))


def body_findings(files: DataFrame, suppression: str = "allow-risk", most: int = MOST_LINES) -> DataFrame:
    """skill_id, path, code, line: what lines of a package hold.

    In the main file possible backslash paths and placeholders, and too many lines (line 0); in it, references and
    scripts secrets; in scripts risks, but for lines with the suppression. Row-local: nothing is shuffled.
    """
    main, folder = F.col("path") == "SKILL.md", F.split("path", "/")[0]
    script, kept = folder == "scripts", F.col("path").rlike("^(SKILL[.]md|references/[^/]+[.][mM][dD]|scripts/[^/]+)$")
    line = lambda s: [
        F.when(main & F.contains(s, F.lit("\\")) & ~s.rlike(r"""\\[nrt'"\\]"""), "path.possible-backslash"),
        *[F.when(main & s.rlike(rf"\b{m}\b"), f"placeholder.{m}") for m in PLACEHOLDERS],
        *[F.when(kept & s.rlike(p), f"secret.{k}") for k, p in SECRETS.items()],
        *[F.when(script & kept & s.rlike(p) & ~F.contains(s, F.lit(suppression)), f"risk.{k}") for k, p in RISKS.items()],
    ]
    lines = lines_of(F.coalesce("text", F.lit("")))
    found = F.flatten(F.transform(lines, lambda s, i: F.transform(F.array_compact(F.array(*line(s))), lambda code: F.struct(code.alias("code"), (i + 1).cast("long").alias("line")))))
    whole = F.when(main & (F.size(lines) > most), F.array(F.struct(F.lit("skill.lines").alias("code"), F.lit(0).cast("long").alias("line"))))
    return files.select("skill_id", "path", F.inline(F.concat(found, F.coalesce(whole, F.array().cast("array<struct<code:string,line:bigint>>")))))


def structure_findings(files: DataFrame) -> DataFrame:
    """Files nested too deeply in the standard folders, and documents that a package shouldn't have."""
    parts = F.split("path", "/")
    return run_rules(
        files.withColumn("_file", F.concat_ws("/", F.col("skill_id").cast("string"), "path")),
        "file",
        "_file",
        [
            Rule("structure.nested", parts[0].isin(*FOLDERS) & (F.size(parts) > 2), F.col("path")),
            Rule("structure.extra-doc", F.col("path").isin(*EXTRA_DOCS), F.col("path"), "warning"),
        ],
    )


def normalized(path: Column) -> Column:
    """A relative path without . and .. segments; what leads out of the root keeps its first .. segments."""
    inside = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & inside(acc), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def links(files: DataFrame) -> DataFrame:
    """skill_id, path, kind (link, or path for code paths of the main file), target (resolved inside the package)."""
    text = F.coalesce("text", F.lit(""))
    found = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("raw")))
    both = F.concat(found("link", LINK), F.when(F.col("path") == "SKILL.md", found("path", CODE_PATH)).otherwise(F.array().cast("array<struct<kind:string,raw:string>>")))
    x = files.where(F.col("path").rlike("^(SKILL[.]md|references/[^/]+[.][mM][dD])$")).select("skill_id", "path", F.inline(both))
    raw = F.regexp_replace(F.split(F.trim("raw"), " ")[0], "^[<>]+|[<>]+$", "")
    # percent signs that begin no code stand for themselves, and so do plus signs
    coded = F.replace(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    x = x.withColumn("raw", F.coalesce(F.try_url_decode(coded), raw)).where((F.col("raw") != "") & ~F.col("raw").rlike(ELSEWHERE))
    x = x.withColumn("clean", F.regexp_extract("raw", "^([^#?]*)", 1)).where("clean <> ''")
    base = F.when(F.col("kind") == "path", "").otherwise(F.regexp_replace("path", "[^/]*$", ""))
    return x.select("skill_id", "path", "kind", "clean", normalized(F.concat(base, "clean")).alias("target"))


def link_findings(files: DataFrame) -> DataFrame:
    """skill_id, path, target, code: links out of the package, to no file of it, or with backslashes."""
    told = links(files)
    there = files.select("skill_id", F.col("path").alias("target")).distinct().withColumn("there", F.lit(True))
    x = told.join(there, ["skill_id", "target"], "left")
    out = F.split("target", "/")[0] == ".."
    missing = F.when(out, F.lit("path.escape")).when(F.col("there").isNull(), F.concat("kind", F.lit(".broken")))
    codes = F.array_compact(F.array(F.when(F.contains("clean", F.lit("\\")), F.lit("path.backslash")), missing))
    return x.select("skill_id", "path", "target", F.explode(codes).alias("code"))


def unreferenced(files: DataFrame) -> DataFrame:
    """skill_id, path of references that no link names; names with a leading dot don't count."""
    kept = files.where(F.col("path").rlike("^references/[^./][^/]*$")).select("skill_id", "path").distinct()
    return kept.join(links(files).select("skill_id", F.col("target").alias("path")), ["skill_id", "path"], "left_anti")
