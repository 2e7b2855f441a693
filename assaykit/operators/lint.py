"""Text linting: rules over documents and their lines, one finding a row.

Rules over whole texts and their first lines are told within the row: a pattern is tried on the whole text, and its lines
are only looked at where it is there. Nothing is shuffled for them. A document row has doc_id and text; findings have doc_id, rule, severity, line (0: the whole text).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalars import ascii_words, bound, lines_of, stripped

# Fixed values of the prompt rules.
CREDENTIALS = (
    r"(?i)\bsk-[A-Za-z0-9_-]{8,}",
    r"(?i)\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\bghp_[A-Za-z0-9]{20,}",
    r"(?i)\bxox[bapor]-[A-Za-z0-9-]{10,}",
    r"(?i)\bAIza[0-9A-Za-z_-]{30,}",
    r"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*\S{4,}",
    r"(?i)\b(?:api[_-]?key|secret|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}",
    r"(?i)(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqp)://[^\s'\"]*:[^\s'\"]*@",
    r"(?i)\bBearer\s+[A-Za-z0-9_\-\.=]{20,}",
)
INJECTIONS = (
    r"(?i)ignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+instructions",
    r"(?i)disregard\s+(?:your|all|the)\s+(?:previous\s+)?(?:instructions|rules|guidelines)",
    r"(?i)(?:reveal|print|show|output|repeat)\s+(?:your|the)\s+system\s+prompt",
    r"(?i)you\s+are\s+now\s+(?:free|unrestricted|jailbroken|dan)\b",
    r"(?i)pretend\s+(?:you\s+have|there\s+are)\s+no\s+(?:rules|restrictions|guidelines)",
)
CAPABILITY = (
    r"(?i)\b(edit|modify|delete|remove|create|write|refactor|rename|move)\b[^.\n]{0,60}\b(files?|director(?:y|ies)|repo(?:sitory)?|codebase|schema|database|branch)\b"
    r"|\brun\b[^.\n]{0,40}\b(command|terminal|shell|script|migration)s?\b"
    r"|\b(install|uninstall|upgrade)\b[^.\n]{0,40}\b(dependenc|package|librar)"
    r"|\b(deploy|push\s+to\s+(?:prod|production|main|master)|force[- ]push)\b"
    r"|\b(purchase|buy|checkout|pay|transaction|submit\s+the\s+form)\b"
    r"|\b(send|post)\b[^.\n]{0,40}\b(email|message|dm|tweet|slack)\b"
)
STOP = (
    r"(?i)\bdone\s+when\b|\bstop\s+(?:and\s+ask|when|after|before|if)\b|\bask\s+(?:me\s+)?(?:before|first)\b|\bcheck\s*point\b"
    r"|\breturn\s+(?:only\s+)?when\b|\bdo\s+not\s+(?:touch|modify|delete|edit)\b|\bconfirm\s+(?:with\s+me\s+)?before\b"
    r"|\brequire\s+(?:my\s+)?approval\b|\bforbidden\s+actions?\b|\bmust\s+not\s+(?:touch|modify|delete)\b|\bhuman\s+review\b"
    r"|\bwithout\s+(?:my\s+)?(?:approval|confirmation)\b"
)
PERSISTENCE = (
    r"(?i)\bdo\s+not\s+(?:return|stop|give\s+up|quit)\s+until\b|\bkeep\s+(?:going|working|trying)\b|\bnever\s+give\s+up\b|\bspend\s+at\s+least\b"
    r"|\bassume\s+(?:that\s+)?a\s+(?:complete\s+)?solution\s+exists\b|\buntil\s+(?:it|the\s+task|everything)\s+is\s+(?:complete|done|solved)\b"
)
VERIFICATION = (
    r"(?i)\bverif(?:y|ied|ication)\b|\baudit(?:ed|or|s)?\b|\bcheck(?:ed)?\s+against\b|\breview(?:ed|er)?\b|\bvalidat(?:e|ed|ion)\b"
    r"|\btest(?:s|ed)?\s+pass\b|\bsurviv(?:e|es|ed)\s+(?:the\s+)?(?:audit|review)\b|\bdoes\s+not\s+count\b"
)
SCAFFOLD = r"(?i)\bthink\s+step[\s-]+by[\s-]+step\b|\bchain[\s-]+of[\s-]+thought\b|\blet'?s\s+think\s+(?:about\s+this\s+)?step\b|\bshow\s+your\s+(?:reasoning|work)\s+step\b"
VAGUE = (
    r"(?i)^\s*(?:please\s+)?(help|handle|improve|fix|optimize|enhance|deal\s+with|look\s+at|do\s+something\s+about)\b"
    r"(?![^.\n]{0,80}\b(?:`|\bfunction\b|\bfile\b|\bline\s+\d|\bclass\b|\bendpoint\b|\berror\b|\bmethod\b))"
)
CONTRACT = (
    r"(?i)\boutput\b|\bformat\b|\brespond\s+(?:with|in|using)\b|\breturn\s+(?:a|an|the|only)\b|\bjson\b|\bmarkdown\b|\btable\b|\bbullet\b"
    r"|\b\d+\s+(?:words?|sentences?|paragraphs?|lines?|bullets?|items?)\b|\bdone\s+when\b|\bdeliverable\b"
    r"|\bas\s+a\s+(?:report|table|list|diff|summary|spreadsheet)\b|\bstructure\s+(?:the|your)\b|--ar\s+\d|\bnegative\s+prompt\b"
)
UNRESOLVED = r"(?i)\bTODO\b|\bTBD\b|\bFIXME\b|\bXXX\b|\?\?\?|<fill[\s_-]?in"
EMPHASIS = r"\b(MUST(?:\s+NOT)?|NEVER|ALWAYS)\b"
LEAST_EMPHASIS, WORDS_AN_EMPHASIS, LEAST_REPEATED = 4, 40, 40
#: Words in lower case of which a text must hold one to match a pattern at all: a cheap test before the expression.
NEEDS = {
    **dict(zip(CREDENTIALS, (["sk-"], ["akia"], ["ghp_"], ["xox"], ["aiza"], ["private key"], ["password", "passwd", "pwd"], ["api", "secret", "token"], ["://"], ["bearer"]), strict=True)),
    **dict(zip(INJECTIONS, (["instructions"], ["disregard"], ["prompt"], ["now"], ["pretend"]), strict=True)),
    CAPABILITY: ["edit", "modify", "delete", "remove", "create", "write", "refactor", "rename", "move", "run", "install", "upgrade", "deploy", "push", "purchase", "buy", "checkout", "pay", "transaction", "submit", "send", "post"],
    STOP: ["done", "stop", "ask", "check", "return", "not", "confirm", "approval", "forbidden", "human", "without"],
    PERSISTENCE: ["until", "keep", "never", "spend", "assume"],
    VERIFICATION: ["verif", "audit", "check", "review", "validat", "test", "surviv", "does"],
    SCAFFOLD: ["step", "chain"],
    UNRESOLVED: ["todo", "tbd", "fixme", "xxx", "???", "<fill"],
}
# Fixed values of the handoff rules.
SECTIONS = ("Goal and definition of done", "Current state", "Next action", "Locked decisions and constraints", "File map", "Verification", "Dead ends", "Resume protocol", "Redaction note")
MANY_LINES, TOO_MANY_LINES = 250, 400
TEMPLATE = (
    "<UTC ISO-8601>",
    "<absolute path>",
    "<project root>",
    "<branch or n/a>",
    "<short SHA or n/a>",
    "<focus hint or none>",
    "<true|false>",
    "<One concrete, file-and-line-anchored step.>",
    "<follow-on step>",
    "<path>",
    "<command>",
    "<result>",
    "<approach>",
    "<why closed>",
    "<evidence pointer>",
    "<item",
    "<What the task is",
    "<session-specific requirements",
    "<list or",
    "<VAR_NAME in <location>",
)
MARKER = r"(?i)<\s*(todo|tbd|fixme|fill[- ]?me|placeholder|xxx)\s*>"
PLACEHOLDER = r"^\s*<[^<>\n]+>\s*$|<[^<>\n]*\s[^<>\n]*\s[^<>\n]*>"
DIRECTIVES = (
    r"(?i)(ignore|disregard|forget|override|bypass)\s+(all\s+|any\s+)?(previous|prior|earlier|above|preceding)\s+(instructions?|directions?|directives?|prompts?|rules?|guidance)",
    r"(?m)^\s*SYSTEM\s*:",
    r"\|\s*(sudo\s+)?(ba|z)?sh\b",
)
EXPECTED = r"(?i)(expected|→|->)"
QUESTION = r"(?m)^\s*>?\s*\d+\.\s+(.+?\?)\s*$"


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), content."""
    return docs.select("doc_id", F.posexplode(lines_of(F.coalesce("text", F.lit(""))))).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("col").alias("content"))


def anywhere(pattern: str) -> str:
    """A pattern that is in a text if a line of it has the given one: without anchors, as a line may begin where (?m) has none."""
    return re.sub(r"(?<!\[)\^", "", ascii_words(pattern))


def has(low: Column, text: Column, pattern: str) -> Column:
    """Whether a text, low in lower case, has the pattern."""
    there = text.rlike(ascii_words(pattern))
    return reduce(or_, (F.contains(low, F.lit(w)) for w in NEEDS[pattern])) & there if pattern in NEEDS else there


def first_line(low: Column, text: Column, pattern: str) -> Column:
    """The first line, from 1, that has the pattern; 0: none."""
    # what looks ahead could look beyond a line's end, so the whole text is tried without that
    there = text.rlike(anywhere(pattern.partition("(?!")[0]))
    if pattern in NEEDS:
        there = reduce(or_, (F.contains(low, F.lit(w)) for w in NEEDS[pattern])) & there
    return F.when(there, F.array_position(F.transform(lines_of(text), lambda s: s.rlike(ascii_words(pattern))), True)).otherwise(0).cast("long")


def _finding(rule: str, severity: Column | str, line: Column, when: Column) -> tuple[str, Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rule, F.when(when, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), line.cast("long").alias("line")))


def prompt_findings(docs: DataFrame, agentic: bool = False, reasoning: bool = False, rules: Sequence[str] | None = None) -> DataFrame:
    """doc_id, rule, severity, line for all prompt rules but repeated lines, or for some of them: no other patterns are tried then."""
    line_rules = [*CREDENTIALS, *INJECTIONS, CAPABILITY, PERSISTENCE, SCAFFOLD, VAGUE, UNRESOLVED]
    n, m = len(CREDENTIALS), len(CREDENTIALS) + len(INJECTIONS)
    # a projection of its own, so that a text is lower-cased once
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    low, text = F.col("low"), F.col("text")
    words = F.greatest(F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")), F.lit(1))
    hits = F.when(reduce(or_, (F.contains(text, F.lit(w)) for w in ("MUST", "NEVER", "ALWAYS"))), F.regexp_count(text, F.lit(ascii_words(EMPHASIS)))).otherwise(0)
    whole = [has(low, text, STOP).alias("stop"), has(low, text, VERIFICATION).alias("verified"), text.rlike(ascii_words(CONTRACT)).alias("contract"), ((hits >= LEAST_EMPHASIS) & (hits > words / WORDS_AN_EMPHASIS)).alias("stacked")]
    x = rows.select("doc_id", *whole, *[first_line(low, text, p).alias(f"l{i}") for i, p in enumerate(line_rules)])
    at = lambda i: F.col(f"l{i}")
    injected = F.coalesce(*[F.nullif(at(i), F.lit(0)) for i in range(n, m)])
    found = [
        *[_finding("CRED", "error", at(i), at(i) > 0) for i in range(n)],
        _finding("INJECT", "error", injected, injected.isNotNull()),
        _finding("AGENTIC", "error" if agentic else "warning", at(m), ~F.col("stop") & (F.lit(agentic) | (at(m) > 0))),
        _finding("PERSIST", "error", at(m + 1), (at(m + 1) > 0) & ~F.col("verified")),
        _finding("COT", "error" if reasoning else "info", at(m + 2), at(m + 2) > 0),
        _finding("VAGUE", "warning", at(m + 3), at(m + 3) > 0),
        _finding("FORMAT", "warning", F.lit(0), ~F.col("contract")),
        _finding("STACK", "warning", F.lit(0), F.col("stacked")),
        _finding("TODO", "warning", at(m + 4), at(m + 4) > 0),
    ]
    return x.select("doc_id", F.inline(F.array_compact(F.array(*[f for rule, f in found if rules is None or rule in rules]))))


def repeated_lines(docs: DataFrame, least: int = LEAST_REPEATED) -> DataFrame:
    """doc_id, line, first: later lines that equal an earlier one but for case and ends; short ones don't count.

    Whether a text has any is told within the row, so only such texts' lines are shuffled.
    """
    key = lambda s: F.lower(stripped(s))
    keys = F.filter(F.transform(lines_of(F.coalesce("text", F.lit(""))), key), lambda k: F.char_length(k) >= least)
    some = docs.withColumn("_keys", keys).where(F.size(F.array_distinct("_keys")) < F.size("_keys"))
    x = exploded(some).withColumn("key", key(F.col("content"))).where(F.char_length("key") >= least)
    first = x.groupBy("doc_id", "key").agg(F.min("line").alias("first"), F.array_sort(F.collect_list("line")).alias("lines")).where(F.size("lines") > 1)
    later = first.select("doc_id", "first", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line"))
    return later.select("doc_id", F.col("line").cast("long").alias("line"), F.col("first").cast("long").alias("first"))


def sectioned(docs: DataFrame) -> DataFrame:
    """doc_id, sections: array of heading, line (of the heading), body (its lines up to the next heading). Row-local; what
    stands above the first heading is in none."""
    heading = lambda s: F.when(s.rlike("^##\\s"), F.regexp_extract(s, "^##\\s+(.*?)\\s*$", 1))
    x = docs.select("doc_id", lines_of(F.coalesce("text", F.lit(""))).alias("l"))
    heads = F.transform("l", lambda s, i: F.struct(F.when(F.startswith(s, F.lit("##")), heading(s)).alias("heading"), (i + 1).alias("line")))
    x = x.withColumn("heads", F.filter(heads, lambda h: h["heading"].isNotNull()))
    end = lambda k: F.coalesce(F.get("heads", k + 1)["line"], F.size("l") + 1)
    body = lambda h, k: F.slice("l", h["line"] + 1, end(k) - h["line"] - 1)
    return x.select("doc_id", F.transform("heads", lambda h, k: F.struct(h["heading"].alias("heading"), h["line"].alias("line"), body(h, k).alias("body"))).alias("sections"))


def lines_under(heading: str) -> Column:
    """Array of line, content: the lines of `sections` under a heading, wherever it is repeated."""
    mine = F.filter("sections", lambda s: s["heading"] == heading)
    return F.flatten(F.transform(mine, lambda s: F.transform(s["body"], lambda c, i: F.struct((s["line"] + i + 1).cast("long").alias("line"), c.alias("content")))))


def section_findings(docs: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """doc_id, code, section: missing, repeated, empty and misplaced sections. Row-local; nothing is shuffled."""
    words = lambda c: F.size(F.filter(F.split(F.regexp_replace(c, "[*_`#>\\-\\d.]", " "), "\\s+"), lambda w: w != ""))
    content = lambda c: ~F.contains(c, F.lit("<")) & (words(c) >= 3)
    wanted = F.array(*[F.lit(s) for s in sections])

    def fault(s: Column) -> Column:
        code = lambda mine: F.when(F.size(mine) == 0, "section-missing").when(F.size(mine) > 1, "section-repeated").when(~F.exists(mine[0]["body"], content), "section-empty")
        return F.struct(bound(F.filter("sections", lambda x: x["heading"] == s), code).alias("code"), s.alias("section"))

    x = sectioned(docs).withColumn("order", F.filter(F.transform("sections", lambda s: s["heading"]), lambda h: h.isin(*sections)))
    found = F.filter(F.transform(wanted, fault), lambda f: f["code"].isNotNull())
    wrong = (F.size("order") == len(sections)) & (F.size(F.array_distinct("order")) == len(sections)) & (F.col("order") != wanted)
    misplaced = F.array(F.struct(F.when(wrong, "sections-out-of-order").alias("code"), F.lit("").alias("section")))
    return x.select("doc_id", F.inline(F.concat(found, F.filter(misplaced, lambda f: f["code"].isNotNull()))))


def line_findings(docs: DataFrame) -> DataFrame:
    """doc_id, code, line of handoff lines: placeholders (one a line, by precedence) and each directive's every line."""
    c, text = F.col("content"), F.col("text")
    template = reduce(or_, (F.contains(c, F.lit(t)) for t in TEMPLATE))
    placeholder = F.when(F.contains(c, F.lit("<")), F.when(template, F.lit("template-placeholder")).when(c.rlike(MARKER), "inline-placeholder").when(c.rlike(PLACEHOLDER), "placeholder"))
    codes = F.array_compact(F.array(placeholder, *[F.when(F.col(f"d{i}") & c.rlike(ascii_words(p)), F.lit(f"directive-{i + 1}")) for i, p in enumerate(DIRECTIVES)]))
    # a directive in no part of a text is in none of its lines; of such texts only lines with < can have a code
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = x.select("doc_id", "text", *[text.rlike(anywhere(p)).alias(f"d{i}") for i, p in enumerate(DIRECTIVES)])
    some = reduce(or_, (F.col(f"d{i}") for i in range(len(DIRECTIVES))))
    lines = F.transform(lines_of(text), lambda s, i: F.struct((i + 1).cast("long").alias("line"), s.alias("content")))
    x = x.select("doc_id", *[f"d{i}" for i in range(len(DIRECTIVES))], F.inline(F.filter(lines, lambda s: some | F.contains(s["content"], F.lit("<")))))
    return x.select("doc_id", F.explode(codes).alias("code"), "line")


def folded_bullets(docs: DataFrame, section: str) -> DataFrame:
    """doc_id, line, bullet: bullets of a section with the lines that continue them. Row-local; nothing is shuffled."""
    x = sectioned(docs).select("doc_id", lines_under(section).alias("l"))
    at = F.transform("l", lambda c, i: F.when(c["content"].rlike("^\\s*-\\s"), i + 1))
    x = x.withColumn("starts", F.filter(at, lambda i: i.isNotNull()))
    own = lambda i, k: F.slice("l", i + 1, F.coalesce(F.get("starts", k + 1), F.size("l") + 1) - i - 1)
    more = lambda i, k: F.filter(F.transform(own(i, k), lambda c: c["content"]), lambda c: c.rlike("^\\s+\\S"))
    first = lambda i: F.get("l", i - 1)
    bullet = lambda i, k: F.array_join(F.transform(F.concat(F.array(first(i)["content"]), more(i, k)), stripped), " ")
    return x.select("doc_id", F.inline(F.transform("starts", lambda i, k: F.struct(first(i)["line"].alias("line"), bullet(i, k).alias("bullet")))))


def unexpected_bullets(docs: DataFrame) -> DataFrame:
    """Verification bullets that name no expected result; bullets about the environment are exempt."""
    x = folded_bullets(docs, "Verification")
    return x.where(~F.col("bullet").rlike(ascii_words("^-\\s*Env\\b")) & ~F.col("bullet").rlike(EXPECTED))


def line_budget(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, severity for documents of too many lines."""
    n = F.array(F.size(lines_of(F.coalesce("text", F.lit("")))).cast("long"))
    # exploded, as a filter on a plain column would make the lines twice
    x = docs.select("doc_id", F.explode(F.filter(n, lambda k: k > MANY_LINES)).alias("n_lines"))
    return x.select("doc_id", "n_lines", F.when(F.col("n_lines") > TOO_MANY_LINES, "error").otherwise("warning").alias("severity"))


def questions(docs: DataFrame) -> DataFrame:
    """doc_id, place, question: numbered lines that end with a question mark."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(QUESTION), F.lit(1)))).select("doc_id", F.col("pos").cast("long").alias("place"), stripped(F.col("col")).alias("question"))


def text_checks(docs: DataFrame, checks: Sequence[tuple[int, Sequence[str], Sequence[str]]], evidence: int = 6) -> DataFrame:
    """doc_id, check_id, ok, evidence for checks (check_id, required words, forbidden words).

    ok: all required words and no forbidden one occur, in any case; evidence: the first offenders, sorted.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    when = lambda w, there: F.when(F.contains(low, F.lit(w.lower())) == there, F.lit(w))
    bad = lambda required, forbidden: F.array_sort(F.array_distinct(F.array_compact(F.array(*[when(w, False) for w in required], *[when(w, True) for w in forbidden]))))
    each = F.array(*[F.struct(F.lit(i).alias("check_id"), bad(r, f).alias("bad")) for i, r, f in checks])
    return docs.select("doc_id", F.inline(each)).select("doc_id", "check_id", (F.size("bad") == 0).alias("ok"), F.array_join(F.slice("bad", 1, evidence), ",").alias("evidence"))


class Check(NamedTuple):
    """What an answer's text must be like: words it holds and lacks, words that no question of it has, how many questions it
    asks (least, most), and two words of which the first comes before the second, all in any case of letters."""

    check_id: str
    code: str = "EVIDENCE-INCOMPLETE"
    required: Sequence[str] = ()
    forbidden: Sequence[str] = ()
    not_asked: Sequence[str] = ()
    questions: tuple[int, int] | None = None
    order: tuple[str, str] | None = None


def check_runs(docs: DataFrame, checks: Sequence[Check], evidence: int = 6) -> DataFrame:
    """doc_id, check_id, code, ok, evidence (the first offenders, in the order of the check's parts, joined by |).

    Row-local: a text is lower-cased and its questions are found once for all checks.
    """
    text = F.coalesce("text", F.lit(""))
    x = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"), F.transform(F.regexp_extract_all(text, F.lit(QUESTION), F.lit(1)), stripped).alias("asked"))
    low, asked = F.col("low"), F.col("asked")

    def offenders(c: Check) -> Column:
        none = F.array().cast("array<string>")
        asking = lambda w: F.filter(asked, lambda q: F.contains(F.lower(q), F.lit(w.lower())))
        parts = [asking(w) for w in c.not_asked]
        parts += [F.when(~F.contains(low, F.lit(w.lower())), F.array(F.lit(f"missing: {w}"))).otherwise(none) for w in c.required]
        parts += [F.when(F.contains(low, F.lit(w.lower())), F.array(F.lit(f"present: {w}"))).otherwise(none) for w in c.forbidden]
        if c.questions:
            parts.append(F.when(~F.size(asked).between(*c.questions), F.array(F.concat(F.lit("question count "), F.size(asked).cast("string")))).otherwise(none))
        if c.order:
            first, second = (F.locate(w.lower(), low) for w in c.order)
            parts.append(F.when(~((first > 0) & (first < second)), F.array(F.lit(f"order {c.order[0]} before {c.order[1]} not observed"))).otherwise(none))
        return F.concat(none, *parts)

    each = F.array(*[F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.code).alias("code"), offenders(c).alias("bad")) for c in checks])
    return x.select("doc_id", F.inline(each)).select("doc_id", "check_id", "code", (F.size("bad") == 0).alias("ok"), F.array_join(F.slice("bad", 1, evidence), "|").alias("evidence"))
