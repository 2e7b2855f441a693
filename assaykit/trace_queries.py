"""Registered queries of packages, handoffs, traceability, orders and single rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import delta, evidence, findings, graph, handoff, health, health_rules, ledger, lint, orders, release, scores, similar, skills, traceability, tracker
from assaykit.plans.views import VIEWS, dealt, view
from assaykit.queries import CURRENT, LINE_SQL, PREVIOUS, SQL, STOP_SQL, query, table
from assaykit.queries import _snapshots as snapshots
from assaykit.sources import fixtures, readers
from assaykit.streaming import receipts, sessions


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(quoted(i) for i in items)


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


# Skill packages

_T = {c: f"coalesce(trim({c}), '')" for c in ("name", "description", "when_to_use", "context", "agent", "effort", "user_invocable")}
_SKILL_RULES = [
    ("name.missing", f"{_T['name']} = ''"),
    ("name.format", f"{_T['name']} <> '' AND NOT regexp_matches({_T['name']}, {quoted(skills.NAME)})"),
    ("name.directory", f"{_T['name']} <> '' AND {_T['name']} <> directory"),
    ("name.reserved", f"list_contains(string_split({_T['name']}, '-'), 'kept')"),
    ("name.xml", f"regexp_matches({_T['name']}, '[<>]')"),
    ("description.missing", f"{_T['description']} = ''"),
    ("description.length", f"{_T['description']} <> '' AND length({_T['description']}) + length({_T['when_to_use']}) > 1536"),
    ("description.person", f"regexp_matches({_T['description']}, {quoted(skills.PERSON)})"),
    ("description.trigger", f"{_T['description']} <> '' AND NOT regexp_matches({_T['description']}, {quoted(skills.TRIGGER)})"),
    ("description.nongoal", f"{_T['description']} <> '' AND NOT regexp_matches({_T['description']}, {quoted(skills.NON_GOAL)})"),
    ("description.xml", f"regexp_matches({_T['description']}, '[<>]')"),
    ("frontmatter.bool", f"lower({_T['user_invocable']}) NOT IN ('', 'true', 'false')"),
    ("frontmatter.context", f"{_T['context']} NOT IN ('', 'fork')"),
    ("frontmatter.agent-without-fork", f"{_T['agent']} <> '' AND {_T['context']} <> 'fork'"),
    ("frontmatter.effort", f"{_T['effort']} NOT IN ('', {listed(skills.EFFORTS)})"),
]


@query("skill_frontmatter", union(*[f"SELECT CAST(skill_id AS STRING) AS subject_id, '{code}' AS code FROM {{skill}} WHERE {when}" for code, when in _SKILL_RULES]))
def skill_frontmatter(spark, d):
    return skills.frontmatter_findings(view(spark, d, "skill").withColumnRenamed("user_invocable", "user-invocable"), reserved=["kept"]).select("subject_id", "code")


_KEPT = "regexp_matches(path, '^(SKILL[.]md|references/[^/]+[.][mM][dD]|scripts/[^/]+)$')"
_BODY = [
    ("path.possible-backslash", f"path = 'SKILL.md' AND contains(s, chr(92)) AND NOT regexp_matches(s, {quoted(r'''\\[nrt'"\\]''')})"),
    *[(f"placeholder.{m}", f"path = 'SKILL.md' AND regexp_matches(s, '\\b{m}\\b')") for m in skills.PLACEHOLDERS],
    *[(f"secret.{k}", f"{_KEPT} AND regexp_matches(s, {quoted(p)})") for k, p in skills.SECRETS.items()],
    *[(f"risk.{k}", f"{_KEPT} AND starts_with(path, 'scripts/') AND NOT contains(s, 'allow-risk') AND regexp_matches(s, {quoted(p)})") for k, p in skills.RISKS.items()],
]


@query(
    "skill_body",
    "WITH f AS (SELECT skill_id, path, string_split(text, chr(10)) AS l FROM {skill_file}), x AS (SELECT skill_id, path, i, l[i] AS s FROM f, unnest(range(1, len(l) + 1)) AS u(i)) "
    + union(*[f"SELECT skill_id, path, '{code}' AS code, i AS line FROM x WHERE {when}" for code, when in _BODY], "SELECT skill_id, path, 'skill.lines', 0 FROM f WHERE path = 'SKILL.md' AND len(l) > 500"),
)
def skill_body(spark, d):
    return skills.body_findings(view(spark, d, "skill_file"))


@query("skill_structure", "SELECT concat_ws('/', skill_id, path) AS subject_id, 'structure.nested' AS code FROM {skill_file} WHERE regexp_matches(path, '^(references|assets|scripts)/[^/]+/') UNION ALL SELECT concat_ws('/', skill_id, path), 'structure.extra-doc' FROM {skill_file} WHERE path IN ('README.md', 'CHANGELOG.md', 'INSTALLATION_GUIDE.md')")
def skill_structure(spark, d):
    return skills.structure_findings(view(spark, d, "skill_file")).select("subject_id", "code")


_LINKS = rf"""f AS (SELECT * FROM {{skill_file}} WHERE regexp_matches(path, '^(SKILL[.]md|references/[^/]+[.]md)$')),
    r AS (SELECT skill_id, path, 'link' AS kind, unnest(regexp_extract_all(text, {quoted(skills.LINK)}, 1)) AS raw FROM f UNION ALL SELECT skill_id, path, 'path', unnest(regexp_extract_all(text, {quoted(skills.CODE_PATH)}, 1)) FROM f WHERE path = 'SKILL.md'),
    c AS (SELECT skill_id, path, kind, regexp_replace(string_split(trim(raw), ' ')[1], '^[<>]+|[<>]+$', '', 'g') AS raw FROM r),
    t AS (SELECT skill_id, path, regexp_replace(concat(CASE WHEN kind = 'path' OR path = 'SKILL.md' THEN '' ELSE 'references/' END, regexp_extract(raw, '^([^#?]*)', 1)), '[^/.]+/[.][.]/', '') AS target, kind FROM c WHERE regexp_extract(raw, '^([^#?]*)', 1) <> '' AND NOT regexp_matches(raw, '^(#|https?://)'))"""


@query("skill_links", "WITH " + _LINKS + " SELECT skill_id, path, target, CASE WHEN starts_with(target, '../') THEN 'path.escape' ELSE concat(kind, '.broken') END AS code FROM t WHERE starts_with(target, '../') OR NOT EXISTS (SELECT 1 FROM {skill_file} z WHERE z.skill_id = t.skill_id AND z.path = t.target)")
def skill_links(spark, d):
    return skills.link_findings(view(spark, d, "skill_file"))


@query(
    "skill_link_spellings",
    """SELECT p_partkey AS skill_id, 'SKILL.md' AS path, CASE p_partkey % 6 WHEN 1 THEN 'references/a+b.md' WHEN 3 THEN concat('references', chr(92), 'x.md') WHEN 4 THEN 'references/50%.md' ELSE '../out.md' END AS target, c AS code
    FROM part, unnest(CASE p_partkey % 6 WHEN 1 THEN ['link.broken'] WHEN 3 THEN ['path.backslash', 'link.broken'] WHEN 4 THEN ['link.broken'] WHEN 5 THEN ['path.escape'] ELSE [] END) AS u(c)""",
)
def skill_link_spellings(spark, d):
    """Targets with percent signs, plus signs, backslashes and encoded steps out of the package."""
    target = "CASE p_partkey % 6 WHEN 0 THEN 'references/a%20b.md' WHEN 1 THEN 'references/a+b.md' WHEN 2 THEN '%72eferences/%C3%A9.md%23top' WHEN 3 THEN concat('references', chr(92), 'x.md') WHEN 4 THEN 'references/50%.md' ELSE '%2e%2e/out.md' END"
    mains = table(spark, d, "part").selectExpr("p_partkey AS skill_id", "'SKILL.md' AS path", f"concat('see [it](', {target}, ')') AS text")
    others = mains.select("skill_id", F.explode(F.array(F.lit("references/a b.md"), F.lit("references/é.md"))).alias("path"), F.lit("").alias("text"))
    return skills.link_findings(mains.unionByName(others))


@query("skill_unreferenced", "WITH " + _LINKS + " SELECT DISTINCT skill_id, path FROM {skill_file} z WHERE regexp_matches(path, '^references/[^./][^/]*$') AND NOT EXISTS (SELECT 1 FROM t WHERE t.skill_id = z.skill_id AND t.target = z.path)")
def skill_unreferenced(spark, d):
    return skills.unreferenced(view(spark, d, "skill_file"))


# Handoffs

_HANDOFF_LINES = "l AS (SELECT doc_id, i, x[i] AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {handoff_text}), unnest(range(1, len(x) + 1)) AS u(i))"
_SECTIONED = _HANDOFF_LINES + r", h AS (SELECT *, CASE WHEN regexp_matches(c, '^##\s') THEN regexp_extract(c, '^##\s+(.*?)\s*$', 1) END AS own FROM l), s AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS heading FROM h)"


@query(
    "handoff_meta",
    r"WITH x AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(s)) AS l FROM {handoff_text}), o AS (SELECT doc_id, l, coalesce(list_position(l, '```yaml'), 0) AS p FROM x), r AS (SELECT doc_id, l[p + 1:] AS rest FROM o WHERE p BETWEEN 1 AND 6),"
    r" b AS (SELECT doc_id, rest, coalesce(list_position(rest, '```'), 0) AS e FROM r), k AS (SELECT doc_id, e, CASE WHEN e > 0 THEN rest[1:e - 1] ELSE rest END AS block FROM b),"
    r" n AS (SELECT doc_id, i, regexp_extract(block[i], '^([A-Za-z_]+):', 1) AS key, trim(regexp_extract(block[i], '^[A-Za-z_]+:(.*)$', 1)) AS value FROM k, unnest(range(1, len(block) + 1)) AS u(i) WHERE regexp_matches(block[i], '^[A-Za-z_]+:')),"
    r" v AS (SELECT doc_id, key, arg_max(value, i) AS value, count(*) AS n, try_strptime(arg_max(value, i), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM n GROUP BY doc_id, key) "
    + union(
        "SELECT doc_id, 'meta-absent' AS code, '' AS key FROM o WHERE p NOT BETWEEN 1 AND 6",
        "SELECT doc_id, 'meta-duplicate', key FROM v WHERE n > 1",
        "SELECT doc_id, 'meta-unclosed', '' FROM k WHERE e = 0",
        "SELECT k.doc_id, 'meta-missing', w.key FROM k CROSS JOIN (VALUES ('written'), ('cwd'), ('root'), ('branch'), ('head'), ('focus'), ('dirty')) w(key) LEFT JOIN v ON v.doc_id = k.doc_id AND v.key = w.key WHERE coalesce(v.value, '') = ''",
        "SELECT doc_id, 'meta-placeholder', key FROM v WHERE contains(value, '<')",
        "SELECT doc_id, 'meta-written', key FROM v WHERE key = 'written' AND value <> '' AND stamp IS NULL",
        "SELECT doc_id, 'meta-year', key FROM v WHERE key = 'written' AND year(stamp) NOT BETWEEN 2020 AND 2100",
        rf"SELECT doc_id, 'meta-path', key FROM v WHERE key IN ('cwd', 'root') AND value <> '' AND NOT regexp_matches(value, {quoted(handoff.ABSOLUTE)})",
        "SELECT doc_id, 'meta-dirty', key FROM v WHERE key = 'dirty' AND value NOT IN ('', 'true', 'false')",
    ),
)
def handoff_meta(spark, d):
    return handoff.meta_findings(view(spark, d, "handoff_text"))


_GROUPS = listed(handoff.SUBGROUPS)


@query(
    "handoff_content",
    "WITH " + _SECTIONED + ", b AS (SELECT doc_id, heading, string_agg(c, chr(10) ORDER BY i) AS body FROM s WHERE own IS NULL AND heading IN ('Current state', 'Next action') GROUP BY doc_id, heading),"
    r" p AS (SELECT doc_id, string_split_regex(body, '\*\*Done and verified\*\*|\*\*Done, unverified\*\*|\*\*In flight\*\*')[2:] AS p FROM b WHERE heading = 'Current state') "
    + union(
        f"SELECT doc_id, 'subgroup-missing' AS code, g AS place FROM b, unnest([{_GROUPS}]) AS u(g) WHERE heading = 'Current state' AND NOT contains(body, g)",
        rf"SELECT doc_id, 'subgroup-empty', ([{_GROUPS}])[k] FROM p, unnest([1, 2, 3]) AS u(k) WHERE k <= len(p) AND NOT regexp_matches(p[k], '(?m)(^\s*-\s+\S|^\s*None\s*$)')",
        rf"SELECT doc_id, 'action-without-anchor', '' FROM b WHERE heading = 'Next action' AND NOT regexp_matches(string_split_regex(body, '(?m)^\s*Then:?\s*$')[1], {quoted(handoff.ANCHOR)})",
        r"SELECT doc_id, 'decision-without-kind', CAST(i AS STRING) FROM s WHERE own IS NULL AND heading = 'Locked decisions and constraints' AND regexp_matches(c, '^\s*-\s') AND NOT regexp_matches(c, '^\s*-\s*(LOCKED:|revisit-if)')",
    ),
)
def handoff_content(spark, d):
    return handoff.content_findings(view(spark, d, "handoff_text"))


_SECTIONS = listed(lint.SECTIONS)


@query(
    "handoff_sections",
    "WITH "
    + _SECTIONED
    + rf", per AS (SELECT doc_id, heading, count(own) AS n, min(i) FILTER (own IS NOT NULL) AS spot, count(*) FILTER (own IS NULL AND NOT contains(c, '<') AND len(list_filter(string_split_regex(regexp_replace(c, '[*_`#>\-\d.]', ' ', 'g'), '\s+'), lambda w: w <> '')) >= 3) AS filled FROM s WHERE heading IN ({_SECTIONS}) GROUP BY doc_id, heading),"
    rf" w AS (SELECT doc_id, unnest([{_SECTIONS}]) AS heading FROM {{handoff_text}}), f AS (SELECT w.doc_id, CASE WHEN n IS NULL THEN 'section-missing' WHEN n > 1 THEN 'section-repeated' WHEN filled = 0 THEN 'section-empty' END AS code, w.heading AS section FROM w LEFT JOIN per ON per.doc_id = w.doc_id AND per.heading = w.heading)"
    rf" SELECT * FROM f WHERE code IS NOT NULL UNION ALL SELECT doc_id, 'sections-out-of-order', '' FROM per GROUP BY doc_id HAVING count(*) = 9 AND sum(n) = 9 AND list(heading ORDER BY spot) <> [{_SECTIONS}]",
)
def handoff_sections(spark, d):
    return lint.section_findings(view(spark, d, "handoff_text"))


@query(
    "handoff_verification",
    "WITH "
    + _SECTIONED
    + r", v AS (SELECT *, count(*) FILTER (regexp_matches(c, '^\s*-\s')) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s WHERE heading = 'Verification' AND own IS NULL), b AS (SELECT doc_id, min(i) AS line, string_agg(trim(c), ' ' ORDER BY i) AS bullet FROM v WHERE k > 0 AND (regexp_matches(c, '^\s*-\s') OR regexp_matches(c, '^\s+\S')) GROUP BY doc_id, k)"
    r" SELECT doc_id, line, bullet FROM b WHERE NOT regexp_matches(bullet, '^-\s*Env\b') AND NOT regexp_matches(bullet, '(?i)(expected|→|->)')",
)
def handoff_verification(spark, d):
    return lint.unexpected_bullets(view(spark, d, "handoff_text"))


@query("handoff_budget", "SELECT doc_id, n AS n_lines, CASE WHEN n > 400 THEN 'error' ELSE 'warning' END AS severity FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM {handoff_text}) WHERE n > 250")
def handoff_budget(spark, d):
    return lint.line_budget(view(spark, d, "handoff_text"))


@query("handoff_questions", r"SELECT doc_id, q.i - 1 AS place, trim(r[q.i]) AS question FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^\s*>?\s*\d+\.\s+(.+?\?)\s*$', 1) AS r FROM {handoff_text}), unnest(range(1, len(r) + 1)) AS q(i)")
def handoff_questions(spark, d):
    return lint.questions(view(spark, d, "handoff_text"))


def _line_sql(lines: str, key: str = "content", at: str = "line") -> str:
    template = " OR ".join(f"contains({key}, {quoted(t)})" for t in lint.TEMPLATE)
    found = f"CASE WHEN {template} THEN 'template-placeholder' WHEN regexp_matches({key}, {quoted(lint.MARKER)}) THEN 'inline-placeholder' WHEN regexp_matches({key}, {quoted(lint.PLACEHOLDER)}) THEN 'placeholder' END"
    return union(
        f"SELECT doc_id, code, line FROM (SELECT doc_id, {found} AS code, {at} AS line FROM {lines}) WHERE code IS NOT NULL",
        *[f"SELECT doc_id, 'directive-{i + 1}', {at} FROM {lines} WHERE regexp_matches({key}, {quoted(p)})" for i, p in enumerate(lint.DIRECTIVES)],
    )


SQL["lint_handoff_lines"] = _line_sql(LINE_SQL)


@query("handoff_lines", "WITH " + _HANDOFF_LINES + " " + _line_sql("l", "c", "i"))
def handoff_lines(spark, d):
    return lint.line_findings(view(spark, d, "handoff_text"))


def _view_lines(name: str) -> str:
    return f"(SELECT doc_id, i AS line, l[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {{{name}}}), unnest(range(1, len(l) + 1)) AS u(i))"


@query("handoff_placeholders", "WITH l AS " + _view_lines("placeholder_text") + " " + _line_sql("l"))
def handoff_placeholders(spark, d):
    return lint.line_findings(view(spark, d, "placeholder_text"))


#: The two patterns that look around, in a form that any engine has.
_LOOKING = {
    "forty-characters": r"len(list_filter(regexp_extract_all(content, '[A-Za-z0-9/+=]+'), lambda t: length(t) = 40 AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '\d'))) > 0",
    "assignment": "regexp_matches(content, " + quoted(handoff.SECRETS["assignment"].replace(r"""(?![<$*{])[^\s'\"]{8,}""", r"""[^\s'\"<$*{][^\s'\"]{7,}""")) + ")",
}


def _secret_sql(lines: str) -> str:
    return union(*[f"SELECT doc_id, '{k}' AS secret, line FROM {lines} WHERE {_LOOKING.get(k) or 'regexp_matches(content, ' + quoted(p) + ')'}" for k, p in handoff.SECRETS.items()])


@query("handoff_secrets", "WITH l AS " + LINE_SQL + " " + _secret_sql("l"))
def handoff_secrets(spark, d):
    return handoff.secret_lines(table(spark, d, "documents"))


@query("handoff_secret_kinds", "WITH l AS " + _view_lines("prompt_text") + " " + _secret_sql("l"))
def handoff_secret_kinds(spark, d):
    return handoff.secret_lines(view(spark, d, "prompt_text"))


def _lint_sql(lines: str = LINE_SQL, texts: str = "documents") -> str:
    """All prompt rules: the first line of each pattern, and the rules of whole texts."""
    vague, unless = lint.VAGUE.split("(?!")
    patterns = [*lint.CREDENTIALS, *lint.INJECTIONS, lint.CAPABILITY, lint.PERSISTENCE, lint.SCAFFOLD, None, lint.UNRESOLVED]
    hit = lambda p: f"regexp_matches(content, {quoted(p)})" if p else f"regexp_matches(content, {quoted(vague)}) AND NOT regexp_matches(content, {quoted(vague + unless[:-1])})"
    first = ", ".join(f"coalesce(min(line) FILTER ({hit(p)}), 0) AS l{i}" for i, p in enumerate(patterns))
    n, m = len(lint.CREDENTIALS), len(lint.CREDENTIALS) + len(lint.INJECTIONS)
    whole = lambda p: f"regexp_matches(t, {quoted(p)})"
    words = r"greatest(len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')), 1)"
    parts = [f"SELECT doc_id, 'CRED' AS rule, 'error' AS severity, l{i} AS line FROM x WHERE l{i} > 0" for i in range(n)]
    injected = "coalesce(" + ", ".join(f"nullif(l{i}, 0)" for i in range(n, m)) + ")"
    parts += [
        f"SELECT doc_id, 'INJECT', 'error', {injected} FROM x WHERE {injected} IS NOT NULL",
        f"SELECT doc_id, 'AGENTIC', 'warning', l{m} FROM x WHERE l{m} > 0 AND NOT {whole(lint.STOP)}",
        f"SELECT doc_id, 'PERSIST', 'error', l{m + 1} FROM x WHERE l{m + 1} > 0 AND NOT {whole(lint.VERIFICATION)}",
        f"SELECT doc_id, 'COT', 'info', l{m + 2} FROM x WHERE l{m + 2} > 0",
        f"SELECT doc_id, 'VAGUE', 'warning', l{m + 3} FROM x WHERE l{m + 3} > 0",
        f"SELECT doc_id, 'FORMAT', 'warning', 0 FROM x WHERE NOT {whole(lint.CONTRACT)}",
        f"SELECT doc_id, 'STACK', 'warning', 0 FROM (SELECT *, len(regexp_extract_all(t, {quoted(lint.EMPHASIS)})) AS hits FROM x) WHERE hits >= {lint.LEAST_EMPHASIS} AND hits > {words} / {lint.WORDS_AN_EMPHASIS}",
        f"SELECT doc_id, 'TODO', 'warning', l{m + 4} FROM x WHERE l{m + 4} > 0",
    ]
    return f"WITH l AS (SELECT doc_id, {first} FROM {lines} GROUP BY doc_id), x AS (SELECT d.doc_id, coalesce(d.text, '') AS t, l.* EXCLUDE (doc_id) FROM {texts} d LEFT JOIN l USING (doc_id)) " + union(*parts)


SQL["lint_all"] = _lint_sql()


@query("lint_rule_texts", None)
def lint_rule_texts(spark, d):
    """The prompt rules over texts that trip each of them."""
    return lint.prompt_findings(view(spark, d, "prompt_text"))


SQL["lint_rule_texts"] = _lint_sql(f"(SELECT doc_id, i AS line, l[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {VIEWS['prompt_text'].sql()}), unnest(range(1, len(l) + 1)) AS u(i))", VIEWS["prompt_text"].sql())


# Traceability


def _envelopes(spark, d):
    x = view(spark, d, "envelope")
    lanes = F.when(F.col("ordinal") % 13 != 0, F.array("first_lane", "second_lane"))
    claims = F.when(F.col("ordinal") % 17 != 0, F.array("first_claim", "second_claim")).otherwise(F.array().cast("array<long>"))
    return x.withColumn("group", F.col("ledger_id")).withColumn("lane_sources", lanes).withColumn("claim_refs", claims)


_ENVELOPE = [
    *[("candidate-shape", f"coalesce(trim({c}), '') = ''") for c in ("title", "summary", "root_cause")],
    ("candidate-missing-lane-sources", "ordinal % 13 = 0"),
    ("candidate-missing-claim-refs", "ordinal % 17 = 0"),
    ("candidate-evidence-missing", "n_evidence < 1"),
    *[("candidate-scores", f"{c} IS NULL OR {c} NOT BETWEEN 1 AND 5") for c in traceability.SCORES],
    ("candidate-rollup", "priority_score NOT BETWEEN -10 AND 22"),
    ("candidate-scheduling", "effort = 'XL'"),
]


@query("trace_envelopes", union(*[f"SELECT candidate_id AS subject_id, '{code}' AS code FROM {{envelope}} WHERE {when}" for code, when in _ENVELOPE]))
def trace_envelopes(spark, d):
    return traceability.envelope_findings(_envelopes(spark, d)).select("subject_id", "code")


_REFS = "c AS (SELECT ledger_id, candidate_id, 0 AS turn, first_claim AS ref, first_lane, second_lane, ordinal FROM {envelope} WHERE ordinal % 17 <> 0 UNION ALL SELECT ledger_id, candidate_id, 1, second_claim, first_lane, second_lane, ordinal FROM {envelope} WHERE ordinal % 17 <> 0)"


@query(
    "trace_findings",
    "WITH " + _REFS + ", s AS (SELECT ledger_id, candidate_id, first_lane AS ref FROM {envelope} WHERE ordinal % 13 <> 0 UNION ALL SELECT ledger_id, candidate_id, second_lane FROM {envelope} WHERE ordinal % 13 <> 0)"
    " SELECT ledger_id, candidate_id, ref, 'candidate-lane-unknown' AS code FROM s WHERE NOT EXISTS (SELECT 1 FROM {trace_lane} l WHERE l.ledger_id = s.ledger_id AND l.lane = s.ref)"
    " UNION ALL SELECT c.ledger_id, candidate_id, CAST(ref AS STRING), CASE WHEN k.claim_id IS NULL THEN 'candidate-claim-unknown' ELSE 'candidate-claim-foreign' END FROM c LEFT JOIN {trace_claim} k ON k.ledger_id = c.ledger_id AND k.claim_id = c.ref WHERE k.claim_id IS NULL OR ordinal % 13 <> 0 AND k.lane NOT IN (first_lane, second_lane)",
)
def trace_findings(spark, d):
    x = _envelopes(spark, d).withColumn("claim_refs", F.transform("claim_refs", lambda c: c.cast("string")))
    claims = view(spark, d, "trace_claim").select(F.col("ledger_id").alias("group"), F.col("claim_id").cast("string").alias("claim_id"), "lane")
    lanes = view(spark, d, "trace_lane").withColumnRenamed("ledger_id", "group")
    return traceability.trace_findings(x, claims, lanes).withColumnRenamed("group", "ledger_id")


@query(
    "trace_projected",
    "WITH " + _REFS + ", p AS (SELECT ledger_id, claim_id, k AS place, CASE k WHEN 0 THEN concat('p', claim_id) ELSE concat('q', CAST(claim_id % 10 AS STRING)) END AS projected_id FROM {trace_claim}, unnest([0, 1]) AS u(k)),"
    " f AS (SELECT c.ledger_id, candidate_id, projected_id, min(turn * 2 + place) AS spot FROM c JOIN p ON p.ledger_id = c.ledger_id AND p.claim_id = c.ref GROUP BY ALL) SELECT ledger_id, candidate_id, string_agg(projected_id, ',' ORDER BY spot) AS refs FROM f GROUP BY ledger_id, candidate_id",
)
def trace_projected(spark, d):
    claims = view(spark, d, "trace_claim")
    names = F.array(F.concat(F.lit("p"), "claim_id"), F.concat(F.lit("q"), F.col("claim_id") % 10))
    projected = claims.select(F.col("ledger_id").alias("group"), "claim_id", F.posexplode(names).alias("place", "projected_id"))
    x = traceability.projected_refs(_envelopes(spark, d), projected)
    return x.select(F.col("group").alias("ledger_id"), "candidate_id", F.array_join("refs", ",").alias("refs"))


@query("trace_sources", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 1 THEN 'line' WHEN o_orderkey % 3 = 0 THEN 'path' WHEN o_orderkey % 2 = 0 THEN 'other' END AS kind, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 1 THEN concat('f', o_orderkey, ':1-2') WHEN o_orderkey % 3 = 0 THEN concat('f', o_orderkey) WHEN o_orderkey % 2 = 0 THEN 'architecture-level observation' END AS ref FROM orders")
def trace_sources(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN concat('f', o_orderkey) END AS path", "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1-2' END AS lines", "o_orderkey % 2 = 0 AS arch")
    return x.select("id", traceability.source_of(F.col("path"), F.col("lines"), F.col("arch")).alias("s")).select("id", "s.kind", "s.ref")


@query("trace_settled", "SELECT DISTINCT packet_id, claim_id FROM {claim} WHERE status = 'unknown' EXCEPT SELECT packet_id, claim_id FROM {claim} WHERE status = 'confirmed'")
def trace_settled(spark, d):
    c = view(spark, d, "claim")
    return traceability.settled(c.where("status = 'confirmed'"), c.where("status = 'unknown'"), ["packet_id", "claim_id"])


@query(
    "trace_handoff_groups",
    "SELECT ledger_id, CASE WHEN status IN ('needs-human-decision', 'blocked') THEN 'blocked' WHEN status = 'rejected' OR action = 'reject' THEN 'rejected' WHEN action IN ('design', 'prototype') THEN 'architecture' ELSE 'integrity' END AS part, string_agg(candidate_id, ',' ORDER BY candidate_id) AS ids FROM {envelope} GROUP BY ALL",
)
def trace_handoff_groups(spark, d):
    return traceability.handoff_groups(view(spark, d, "envelope"), "ledger_id").select("ledger_id", "part", F.array_join("ids", ",").alias("ids"))


@query("trace_merged", "WITH x AS (SELECT ledger_id, ordinal % 10 AS dup, list(DISTINCT candidate_id ORDER BY candidate_id) AS ids, list_sort(list_distinct(list_concat(list(first_lane), list(second_lane)))) AS lanes FROM {envelope} GROUP BY ALL) SELECT ledger_id, dup, ids[1] AS candidate_id, array_to_string(ids[2:], ',') AS merged_from, array_to_string(lanes, ',') AS lane_sources FROM x")
def trace_merged(spark, d):
    x = view(spark, d, "envelope").withColumn("dup", F.col("ordinal") % 10).withColumn("lane_sources", F.array("first_lane", "second_lane"))
    x = traceability.merged_candidates(x, ["ledger_id", "dup"])
    return x.select("ledger_id", "dup", "candidate_id", F.array_join("merged_from", ",").alias("merged_from"), F.array_join("lane_sources", ",").alias("lane_sources"))


@query("trace_strongest", "SELECT surface, arg_max(coverage, CASE coverage WHEN 'inspected' THEN 6 WHEN 'sampled' THEN 5 WHEN 'inventory-only' THEN 4 WHEN 'uninspected' THEN 3 WHEN 'unavailable' THEN 2 WHEN 'not-applicable' THEN 1 ELSE 0 END) AS coverage FROM {observation} GROUP BY surface")
def trace_strongest(spark, d):
    return traceability.strongest_coverage(view(spark, d, "observation"), ["surface"])


@query("score_suites", "SELECT suite, sum(correctness + robustness + efficiency + generalization + safety)::BIGINT AS total, count(*) * 10 AS most, NOT bool_or(safety = 0) AS passed FROM {suite_case} GROUP BY suite")
def score_suites(spark, d):
    return traceability.suite_score(view(spark, d, "suite_case"), "suite")


_SNAP_ID = "CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN ' ' ELSE concat('k', CAST(CAST(floor(p_partkey / 3) AS BIGINT) * 3 + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 3 END AS STRING)) END"


@query("delta_snapshot_ids", f"SELECT 'claims' AS kind, id, CASE WHEN trim(coalesce(id, '')) = '' THEN 'previous-shape' ELSE 'previous-duplicate' END AS code, count(*) AS n FROM (SELECT {_SNAP_ID} AS id FROM part) GROUP BY id HAVING count(*) > 1 OR trim(coalesce(id, '')) = ''")
def delta_snapshot_ids(spark, d):
    return traceability.snapshot_findings(table(spark, d, "part").selectExpr(f"{_SNAP_ID} AS claim_id"), "claims", "claim_id")


_DESCRIPTOR = "'1' AS schema_version, concat('n', CAST(p_partkey % 3 AS STRING)) AS namespace, 'r' AS repository_key, concat('l', CAST(p_partkey AS STRING)) AS lane_id, 'v2' AS contract_version, p_name AS input_fingerprint, p_type AS dependency_fingerprint, p_brand AS environment_fingerprint, CASE WHEN p_partkey % 2 = 0 THEN 's' END AS scope"


@query(
    "cache_descriptors",
    f"""SELECT lane_id, sha256(concat('{{"contract_version":"', contract_version, '","dependency_fingerprint":"', dependency_fingerprint, '","environment_fingerprint":"', environment_fingerprint, '","input_fingerprint":"', input_fingerprint, '","lane_id":"', lane_id, '","namespace":"', namespace, '","repository_key":"', repository_key, '","schema_version":"', schema_version, '","scope":', CASE WHEN scope IS NULL THEN 'null' ELSE concat('"', scope, '"') END, '}}')) AS key FROM (SELECT {_DESCRIPTOR} FROM part)""",
)
def cache_descriptors(spark, d):
    return delta.descriptor_key(table(spark, d, "part").selectExpr(*_columns(_DESCRIPTOR))).select("lane_id", "key")


@query(
    "cache_value_keys",
    """SELECT o_orderkey AS id, sha256(concat('{"lines":[', lines, '],"order":{"empty":{},"none":null,"price":', CASE WHEN o_orderkey % 3 = 0 THEN '1.5' ELSE (o_orderkey % 7)::VARCHAR END, ',"status":"', o_orderstatus, '"}}')) AS key
    FROM orders JOIN (
        SELECT l_orderkey, string_agg(concat('{"a":[', l_linenumber, ',[true]],"z":"', l_returnflag, '"}'), ',' ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY l_orderkey
    ) ON l_orderkey = o_orderkey""",
)
def cache_value_keys(spark, d):
    """Orders with their lines as nested JSON, with keys in two orders and numbers in two spellings."""
    line = """CASE WHEN l_orderkey % 2 = 0 THEN concat('{"z": "', l_returnflag, '", "a": [', l_linenumber, '.0, [true]]}') ELSE concat('{"a":[', l_linenumber, ',[true]],"z":"', l_returnflag, '"}') END"""
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag", f"{line} AS line").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "line"))), lambda x: x["line"]).alias("lines"))
    price = "CASE WHEN o_orderkey % 3 = 0 THEN '15e-1' ELSE concat(o_orderkey % 7, '') END"
    order = f"""concat('{{"status":"', o_orderstatus, '","none":null,"price":', {price}, ',"empty":{{}}}}')"""
    text = f"""CASE WHEN o_orderkey % 2 = 0 THEN concat('{{"order":', {order}, ',"lines":[', array_join(lines, ','), ']}}') ELSE concat('{{"lines":[', array_join(lines, ', '), '], "order" : ', {order}, '}}') END"""
    x = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_orderkey AS id", f"parse_json({text}) AS v")
    return delta.value_key(x, "v").select("id", "key")


def _columns(select: str) -> list[str]:
    """The expressions of a select list: cut at commas outside parentheses."""
    out, depth = [""], 0
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query(
    "cache_lane_descriptors",
    "WITH f AS (SELECT l_suppkey AS lane_id, string_agg(t, chr(10) ORDER BY t) FILTER (r) AS i, string_agg(t, chr(10) ORDER BY t) FILTER (NOT r) AS j FROM (SELECT l_suppkey, concat(l_orderkey, '/', l_linenumber, ':', l_partkey) AS t, l_linenumber % 2 = 1 AS r FROM lineitem) GROUP BY l_suppkey) SELECT s_suppkey AS lane_id, sha256(coalesce(i, '')) AS input_fingerprint, sha256(coalesce(j, '')) AS dependency_fingerprint FROM supplier LEFT JOIN f ON lane_id = s_suppkey",
)
def cache_lane_descriptors(spark, d):
    files = table(spark, d, "lineitem").selectExpr("l_suppkey AS lane_id", "CASE WHEN l_linenumber % 2 = 1 THEN 'input' ELSE 'dependency' END AS role", "concat(l_orderkey, '/', l_linenumber) AS path", "CAST(l_partkey AS STRING) AS sha256")
    return delta.lane_descriptors(table(spark, d, "supplier").selectExpr("s_suppkey AS lane_id"), files)


# Orders


@query("order_ready", "WITH t AS (SELECT grp, node, cost AS critical, node % 2 AS priority, node % 3 AS weight FROM {task}) SELECT grp, node, row_number() OVER (PARTITION BY grp ORDER BY critical DESC, priority DESC, weight DESC, node) AS position FROM t")
def order_ready(spark, d):
    x = view(spark, d, "task").selectExpr("grp", "node AS id", "cost AS critical", "node % 2 AS priority", "node % 3 AS weight")
    return orders.ready_order(x, "grp").select("grp", F.col("id").alias("node"), "position")


@query("order_admission", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 2 END, 0) DESC, CAST(floor(event_id / 4) AS BIGINT), event_id) AS position FROM events WHERE event_type <> 'error'")
def order_admission(spark, d):
    x = table(spark, d, "events").selectExpr("user_id", "event_id AS id", "CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 2 END AS priority", "CAST(floor(event_id / 4) AS BIGINT) AS submitted", "CASE WHEN event_type = 'error' THEN 'DONE' ELSE 'READY' END AS status")
    return orders.admission_order(x, "user_id").select("user_id", F.col("id").alias("event_id"), "position")


@query("order_findings", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CAST(l_orderkey AS STRING), coalesce(CASE WHEN l_linenumber > 1 THEN l_linenumber END, 0), CAST(l_linenumber AS STRING)) AS position FROM lineitem")
def order_findings(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warning' ELSE 'info' END AS severity", "CAST(l_orderkey AS STRING) AS path", "CASE WHEN l_linenumber > 1 THEN l_linenumber END AS line", "CAST(l_linenumber AS STRING) AS code")
    return orders.finding_order(x, "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", "position")


@query("order_frontier", "SELECT tracker, id, row_number() OVER (PARTITION BY tracker ORDER BY id NULLS LAST) AS position FROM (SELECT tracker, id FROM {ticket} t WHERE state = 'open' AND claimed_by IS NULL AND NOT EXISTS (SELECT 1 FROM {block} b LEFT JOIN {ticket} c ON c.tracker = b.tracker AND c.id = b.blocker AND c.state = 'closed' WHERE b.tracker = t.tracker AND b.id = t.id AND c.id IS NULL))")
def order_frontier(spark, d):
    return orders.frontier_order(tracker.frontier(view(spark, d, "ticket"), view(spark, d, "block"))).select("tracker", "id", "position")


_RING = "CASE WHEN id % 3 = 2 THEN id - 2 ELSE id + 1 END"


@query("tracker_cycles", f"WITH o AS (SELECT o_orderkey % 50 AS tracker, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F') SELECT a.tracker, concat_ws(',', a.id, a.id + 1, a.id + 2) AS members FROM (SELECT 0 AS tracker, id FROM o) a JOIN o b ON b.id = a.id + 1 JOIN o c ON c.id = a.id + 2 WHERE a.id % 3 = 0")
def tracker_cycles(spark, d):
    tickets = table(spark, d, "orders").selectExpr("0 AS tracker", "o_orderkey AS id", "CASE WHEN o_orderstatus <> 'F' THEN 'open' ELSE 'closed' END AS state")
    blocks = tickets.selectExpr("tracker", "id", f"{_RING} AS blocker")
    return tracker.blocking_cycles(tickets, blocks).select("tracker", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


#: Each line needs the one that three times its number leads to in its order, and lines of over 25 pieces the next one too.
_TASKS = "SELECT DISTINCT l_orderkey AS grp, l_linenumber AS node, n FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)"
_TASK_EDGES = f"""e AS (
        SELECT DISTINCT grp, node, needs FROM (
            SELECT grp, node, node * 3 % n + 1 AS needs FROM ({_TASKS})
            UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber + 1 FROM lineitem WHERE l_quantity > 25
        ) WHERE node <> needs),
    r AS (SELECT grp, node, needs FROM e UNION SELECT r.grp, r.node, e.needs FROM r JOIN e ON e.grp = r.grp AND e.node = r.needs),
    tied AS (SELECT DISTINCT a.grp, a.node, a.needs AS other FROM r a JOIN r b ON b.grp = a.grp AND b.node = a.needs AND b.needs = a.node),
    sets AS (SELECT grp, node, min(other) AS component FROM tied GROUP BY grp, node HAVING count(*) > 1)"""


def _task_edges(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("node"), "l_quantity")
    last = lines.groupBy("group").agg(F.max("node").alias("n"))
    ring = lines.join(last, "group").select("group", "node", (F.col("node") * 3 % F.col("n") + 1).alias("needs"))
    return ring.unionByName(lines.where("l_quantity > 25").select("group", "node", (F.col("node") + 1).alias("needs")))


@query("graph_task_cycles", f"WITH RECURSIVE {_TASK_EDGES} SELECT grp, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM sets GROUP BY grp, component")
def graph_task_cycles(spark, d):
    return graph.cycles(_task_edges(spark, d)).select(F.col("group").alias("grp"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query("graph_components", f"WITH RECURSIVE {_TASK_EDGES} SELECT grp, node, component FROM sets")
def graph_components(spark, d):
    return graph.components(_task_edges(spark, d)).withColumnRenamed("group", "grp")


@query(
    "graph_closed_paths",
    f"""WITH RECURSIVE {_TASK_EDGES},
    w AS (
        SELECT grp, component, node, [node] AS path, false AS closed FROM sets WHERE node = component
        UNION ALL
        SELECT w.grp, w.component, e.needs, list_append(w.path, e.needs), e.needs = w.component
        FROM w JOIN e ON e.grp = w.grp AND e.node = w.node JOIN sets s ON s.grp = w.grp AND s.node = e.needs AND s.component = w.component
        WHERE NOT w.closed AND (e.needs = w.component OR NOT list_contains(w.path, e.needs)))
    SELECT grp, array_to_string(path, '->') AS path FROM w WHERE closed QUALIFY row_number() OVER (PARTITION BY grp, component ORDER BY len(path), path) = 1""",
)
def graph_closed_paths(spark, d):
    """The tasks of an order that can't be run, with the path that shows why."""
    x = graph.closed_paths(_task_edges(spark, d))
    return x.select(F.col("group").alias("grp"), F.array_join(F.transform("path", lambda m: m.cast("string")), "->").alias("path"))


# Reports, isolation, syntax and full descriptors


@query(
    "delta_report",
    f"SELECT owner, item, CASE WHEN p.owner IS NULL THEN 'new' WHEN c.owner IS NULL THEN 'resolved' ELSE 'carried' END AS kind, p.score AS previous, c.score AS current, floor((c.score - p.score) * 100 + 0.5) / 100 AS change FROM {PREVIOUS} p FULL JOIN {CURRENT} c USING (owner, item)",
)
def delta_report(spark, d):
    return delta.report_diff(*snapshots(spark, d, "score"), ["owner", "item"], "score")


_LETTER = "CASE " + " ".join(f"WHEN score >= {floor} THEN '{g}'" for g, floor in health.GRADES if floor is not None) + f" ELSE '{health.GRADES[-1][0]}' END"


@query(
    "delta_stored_lanes",
    f"""WITH l AS (SELECT repository, lane, score, {_LETTER} AS grade, CASE WHEN repository % 3 = 0 THEN score + 1 WHEN repository % 3 = 1 THEN score END AS stored_score, CASE WHEN repository % 4 = 0 THEN 'B' WHEN repository % 4 = 1 THEN {_LETTER} END AS stored_grade FROM {{lanes}})
    SELECT repository, lane, 'lane_grade' AS field, stored_grade AS stored, grade AS computed FROM l WHERE stored_grade <> grade
    UNION ALL SELECT repository, lane, 'lane_score', 'higher', 'lower' FROM l WHERE floor(stored_score * 100 + 0.5) / 100 <> floor(score * 100 + 0.5) / 100""",
)
def delta_stored_lanes(spark, d):
    """Stored lane scores and grades that aren't what the dimensions give."""
    x = health.lane_scores(view(spark, d, "dimension")).withColumn("grade", health.letter(health.grade_index(F.col("score"))))
    x = x.selectExpr("repository", "lane", "score", "grade", "CASE WHEN repository % 3 = 0 THEN score + 1 WHEN repository % 3 = 1 THEN score END AS lane_score", "CASE WHEN repository % 4 = 0 THEN 'B' WHEN repository % 4 = 1 THEN grade END AS lane_grade")
    numbers = delta.stored_mismatches(x, ["repository", "lane"], {"lane_score": "score"})
    told = numbers.select("repository", "lane", "field", F.when(F.col("stored") > F.col("computed"), "higher").otherwise("lower").alias("stored"), F.when(F.col("stored") > F.col("computed"), "lower").otherwise("higher").alias("computed"))
    return delta.stored_states(x, ["repository", "lane"], {"lane_grade": "grade"}).unionByName(told)


_ISOLATION = "CASE repository % 6 WHEN 0 THEN 'worktree' WHEN 1 THEN 'in-place' WHEN 2 THEN 'none' WHEN 3 THEN 'odd' WHEN 4 THEN 'container' END"


@query(
    "health_isolation",
    f"SELECT repository, CASE WHEN i IN ('in-place', 'none') THEN 'baseline-not-isolated' ELSE 'baseline-isolation-unknown' END AS code FROM (SELECT DISTINCT repository, {_ISOLATION} AS i FROM {{command}}) WHERE i IS NULL OR i IN ('in-place', 'none', 'odd')",
)
def health_isolation(spark, d):
    commands = view(spark, d, "command")
    return health_rules.isolation_findings(commands.selectExpr("repository", f"{_ISOLATION} AS isolation").where("repository % 6 <> 5"), commands)


@query(
    "health_inventory",
    "WITH s AS (SELECT unnest(" + str(list(health.SURFACES)) + ") AS surface, unnest(range(" + str(len(health.SURFACES)) + ")) AS i), r AS (SELECT DISTINCT p_partkey // 40 AS repository FROM part)"
    " SELECT repository, surface FROM r JOIN s ON true WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey // 40 = r.repository AND p_size % " + str(len(health.SURFACES)) + " = i AND p_size % 3 > 0)",
)
def health_inventory(spark, d):
    """Repositories that list part of the inventory, and what they leave out."""
    names = F.array(*[F.lit(x) for x in health.SURFACES])
    surface = F.when(F.col("p_size") % 3 > 0, F.element_at(names, (F.col("p_size") % len(health.SURFACES) + 1).cast("int"))).otherwise("elsewhere")
    return health.missing_surfaces(table(spark, d, "part").select(F.expr("p_partkey DIV 40").alias("repository"), surface.alias("surface")))


_FRONT_LINES = "concat_ws(chr(10), CASE WHEN p_partkey % 9 <> 0 THEN '---' END, 'name: x', CASE p_partkey % 4 WHEN 0 THEN 'no colon here' WHEN 1 THEN concat('about: |', chr(10), '  a block', chr(10), chr(10), '  of lines') WHEN 2 THEN concat('tags:', chr(10), '  - one') ELSE '# a note' END, 'k: v', CASE WHEN p_partkey % 7 <> 0 THEN '---' END, 'body without colon')"


@query(
    "skill_frontmatter_syntax",
    """SELECT p_partkey AS skill_id, CASE WHEN p_partkey % 9 = 0 THEN 'frontmatter.missing' WHEN p_partkey % 7 = 0 THEN 'frontmatter.unclosed' WHEN p_partkey % 4 = 0 THEN 'frontmatter.syntax' ELSE 'frontmatter.nested' END AS code,
    CASE WHEN p_partkey % 9 = 0 OR p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 4 = 0 THEN 3 ELSE 4 END AS line FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 7 = 0 OR p_partkey % 4 IN (0, 2)""",
)
def skill_frontmatter_syntax(spark, d):
    return skills.syntax_findings(table(spark, d, "part").selectExpr("p_partkey AS skill_id", "'SKILL.md' AS path", f"{_FRONT_LINES} AS text"))


@query(
    "cache_full_descriptors",
    """WITH f AS (SELECT l_suppkey AS lane_id, string_agg(t, chr(10) ORDER BY t) FILTER (r) AS i, string_agg(t, chr(10) ORDER BY t) FILTER (NOT r) AS j FROM (SELECT l_suppkey, concat(l_orderkey, '/', l_linenumber, ':', l_partkey) AS t, l_linenumber % 2 = 1 AS r FROM lineitem) GROUP BY l_suppkey),
    x AS (SELECT s_suppkey AS lane_id, concat('n', s_nationkey) AS repository_key, sha256(coalesce(i, '')) AS a, sha256(coalesce(j, '')) AS b, sha256(concat('{"CI":"', s_suppkey % 2, '","OS":"', s_nationkey, '"}')) AS e, CASE WHEN n_regionkey <> 2 THEN concat('"', n_name, '"') ELSE 'null' END AS rev, CASE WHEN n_regionkey <> 2 THEN concat('"r', n_regionkey, '"') ELSE 'null' END AS tree
        FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN f ON lane_id = s_suppkey)
    SELECT lane_id, e AS environment_fingerprint, sha256(concat('{"dependency_fingerprint":"', b, '","environment_fingerprint":"', e, '","input_fingerprint":"', a, '","lane_id":', lane_id, ',"repository_key":"', repository_key, '","source_revision":', rev, ',"working_tree_fingerprint":', tree, '}')) AS key FROM x""",
)
def cache_full_descriptors(spark, d):
    files = table(spark, d, "lineitem").selectExpr("l_suppkey AS lane_id", "CASE WHEN l_linenumber % 2 = 1 THEN 'input' ELSE 'dependency' END AS role", "concat(l_orderkey, '/', l_linenumber) AS path", "CAST(l_partkey AS STRING) AS sha256")
    lanes = table(spark, d, "supplier").selectExpr("s_suppkey AS lane_id", "concat('n', s_nationkey) AS repository_key", "CASE WHEN s_suppkey % 3 = 0 THEN map('OS', CAST(s_nationkey AS STRING), 'CI', CAST(s_suppkey % 2 AS STRING)) ELSE map('CI', CAST(s_suppkey % 2 AS STRING), 'OS', CAST(s_nationkey AS STRING)) END AS environment")
    repositories = table(spark, d, "nation").where("n_regionkey <> 2").selectExpr("concat('n', n_nationkey) AS repository_key", "n_name AS source_revision", "concat('r', n_regionkey) AS working_tree_fingerprint")
    return delta.full_descriptors(lanes, files, repositories).select("lane_id", "environment_fingerprint", "key")


# Releases and fixtures

#: In documents by source: names that are stale, a phrase in either case, and phrases that each source must have.
_PHRASES = [release.Phrase("NAME-STALE", "und", name=True), release.Phrase("LANGUAGE-STALE", "LICENSE", fold=True), release.Phrase("SECRET", "AKIA"), release.Phrase("INCOMPLETE", "the", required=True), release.Phrase("INCOMPLETE", "Copyright 19", required=True)]


@query(
    "release_phrases",
    rf"""WITH l AS {LINE_SQL}, x AS (SELECT coalesce(source, 'none') AS release, doc_id::VARCHAR AS path, line, content FROM l JOIN documents USING (doc_id))
    SELECT release, path, line, 'NAME-STALE' AS code, 'und' AS phrase FROM x WHERE regexp_matches(content, '(^|[^\p{{L}}\p{{N}}_$/])und($|[^\p{{L}}\p{{N}}_])')
    UNION ALL SELECT release, path, line, 'LANGUAGE-STALE', 'LICENSE' FROM x WHERE contains(lower(content), 'license')
    UNION ALL SELECT release, path, line, 'SECRET', 'AKIA' FROM x WHERE contains(content, 'AKIA')
    UNION ALL SELECT r.release, NULL, NULL, 'INCOMPLETE', p FROM (SELECT DISTINCT release FROM x) r, unnest(['the', 'Copyright 19']) AS u(p)
    WHERE NOT EXISTS (SELECT 1 FROM x o WHERE o.release = r.release AND contains(o.content, p))""",
)
def release_phrases(spark, d):
    files = table(spark, d, "documents").selectExpr("coalesce(source, 'none') AS release", "CAST(doc_id AS STRING) AS path", "coalesce(text, '') AS text")
    return release.phrase_findings(files, _PHRASES).drop("excerpt")


@query(
    "source_fixtures",
    """SELECT o_orderkey AS id, o_orderstatus AS status, n AS lines, first_flag, second_tag FROM orders JOIN (
        SELECT l_orderkey, count(*) AS n, (arg_min(l_returnflag, struct_pack(a := l_linenumber, b := l_returnflag))) AS first_flag, concat('n', max(l_linenumber)) AS second_tag FROM lineitem GROUP BY l_orderkey
    ) ON l_orderkey = o_orderkey""",
)
def source_fixtures(spark, d):
    """Orders with their lines as indented texts, read back as nested values."""
    line = "concat('    - flag: ', x.l_returnflag, '  # of the line', chr(10), '      tags: [x, n', x.l_linenumber, ']')"
    # an order's lines become text where they are sorted: numbers and flags alone are shuffled
    kept = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("kept"))
    lines = kept.selectExpr("l_orderkey", f"array_join(transform(kept, x -> {line}), chr(10)) AS lines")
    text = "concat('---', chr(10), 'order:', chr(10), '  status: \"', o_orderstatus, '\"', chr(10), '  lines:', chr(10), lines, chr(10), 'note: >-', chr(10), '  folded', chr(10), '  text')"
    x = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("o_orderkey AS id", f"{text} AS text")
    got = fixtures.fixtures(x).where("try_variant_get(record, '$.note', 'string') = 'folded text'")
    get = lambda p: F.try_variant_get("record", p, "string")
    tags = F.transform(F.try_variant_get("record", "$.order.lines", "array<struct<flag:string,tags:array<string>>>"), lambda y: y["tags"][1])
    size = F.size(F.try_variant_get("record", "$.order.lines", "array<variant>"))
    return got.select("id", get("$.order.status").alias("status"), size.cast("long").alias("lines"), get("$.order.lines[0].flag").alias("first_flag"), F.array_max(tags).alias("second_tag"))


# Single rules


@query(
    "ledger_lifecycles",
    "WITH x AS (SELECT *, state IS NOT NULL AND state <> 'odd' AND owner_skill IS NOT NULL AS ok FROM {lifecycle}) "
    + union(
        "SELECT candidate_id AS subject_id, 'lifecycle-shape' AS code FROM x WHERE NOT ok",
        "SELECT candidate_id, 'lifecycle-completion' FROM x WHERE ok AND state = 'completed' AND (completed_at IS NULL OR n_refs = 0)",
        "SELECT candidate_id, 'lifecycle-superseded' FROM x WHERE ok AND state = 'superseded' AND superseded_by IS NULL",
        "SELECT candidate_id, 'lifecycle-resolution' FROM x WHERE ok AND state IN ('rejected', 'deferred') AND reason IS NULL",
    ),
)
def ledger_lifecycles(spark, d):
    refs = F.when(F.col("n_refs") > 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    return ledger.lifecycle_findings(view(spark, d, "lifecycle").withColumn("verification_refs", refs)).select("subject_id", "code")


_CONTRA = "SELECT packet_id, concat('x', CAST(ordinal AS STRING)) AS contradiction_id, CASE WHEN ordinal % 2 = 0 THEN claim_id ELSE 'gone' END AS claim_id FROM {claim} WHERE ordinal % 7 = 1"


@query("evidence_contradictions", f"SELECT x.packet_id, contradiction_id, x.claim_id, CASE WHEN c.claim_id IS NULL THEN 'contradiction-claim-unknown' ELSE 'contradiction-not-reciprocal' END AS code FROM ({_CONTRA}) x LEFT JOIN {{claim}} c ON c.packet_id = x.packet_id AND c.claim_id = x.claim_id WHERE c.claim_id IS NULL OR c.ordinal % 4 <> 0")
def evidence_contradictions(spark, d):
    c = view(spark, d, "claim")
    told = c.where("ordinal % 7 = 1").selectExpr("packet_id", "concat('x', ordinal) AS contradiction_id", "array(CASE WHEN ordinal % 2 = 0 THEN claim_id ELSE 'gone' END) AS claim_refs")
    return evidence.contradiction_findings(told, c.selectExpr("packet_id", "claim_id", "CASE WHEN ordinal % 4 = 0 THEN array(concat('x', ordinal)) END AS contradiction_refs"))


@query("evidence_best_surfaces", "WITH s AS (SELECT c_custkey AS ordinal, concat('s', CAST(c_custkey AS STRING)) AS surface, CASE c_custkey % 3 WHEN 0 THEN 'inspected' WHEN 1 THEN 'sampled' ELSE 'uninspected' END AS coverage, c_custkey % 40 AS claim FROM customer), b AS (SELECT claim, arg_max(struct_pack(s := surface, c := coverage), [CASE coverage WHEN 'inspected' THEN 3 WHEN 'sampled' THEN 2 ELSE 1 END, -ordinal]) AS b FROM s GROUP BY claim) SELECT n_nationkey AS claim_id, b.b.s AS surface, b.b.c AS coverage FROM nation LEFT JOIN b ON b.claim = n_nationkey")
def evidence_best_surfaces(spark, d):
    s = table(spark, d, "customer").selectExpr("concat('s', c_custkey) AS surface", "CASE c_custkey % 3 WHEN 0 THEN 'inspected' WHEN 1 THEN 'sampled' ELSE 'uninspected' END AS coverage", "c_custkey AS ordinal", "array(c_custkey % 40) AS claim_refs")
    return evidence.best_surfaces(table(spark, d, "nation").selectExpr("n_nationkey AS claim_id"), s)


@query("evidence_overlays", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'over' ELSE p_brand END AS p_brand, p_size::BIGINT AS p_size FROM part")
def evidence_overlays(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_brand", "CAST(p_size AS BIGINT) AS p_size")
    return evidence.overlaid(p, p.where("p_partkey % 3 = 0").selectExpr("p_partkey", "'over' AS p_brand", "CAST(NULL AS BIGINT) AS p_size"), "p_partkey", ["p_brand", "p_size"])


@query("evidence_lanes", "SELECT packet_id, claim_id AS id, CASE WHEN origin_lane IS NULL THEN 'expedition-origin-lane-missing' ELSE 'expedition-origin-lane-unknown' END AS code FROM {claim} c WHERE origin_lane IS NULL OR origin_lane = 'b' AND packet_id % 2 = 1")
def evidence_lanes(spark, d):
    c = view(spark, d, "claim").withColumnRenamed("claim_id", "id")
    lanes = c.where("origin_lane = 'a' OR packet_id % 2 = 0").where("origin_lane IS NOT NULL")
    every = c.select("packet_id").distinct().withColumn("lane_id", F.lit("a")).unionByName(lanes.select("packet_id", F.col("origin_lane").alias("lane_id"))).distinct()
    return evidence.lane_findings(c, every)


_RECEIPT = """o_custkey AS packet_id, CASE WHEN o_orderkey % 11 = 0 THEN '-lane' WHEN o_orderkey % 10 = 0 THEN 'same' ELSE concat('lane', o_orderkey) END AS lane_id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'src' END AS surface,
    CASE WHEN o_orderkey % 5 = 0 THEN 'lost' ELSE 'complete' END AS status, o_orderkey % 6 AS k, o_orderkey AS c"""


@query(
    "evidence_receipts",
    f"""WITH r AS (SELECT {_RECEIPT} FROM orders)
    SELECT packet_id, lane_id, 'id-invalid' AS code, 'lane_id' AS path FROM r WHERE lane_id = '-lane'
    UNION ALL SELECT packet_id, lane_id, 'lane-surface-missing', 'surface' FROM r WHERE surface = ' '
    UNION ALL SELECT packet_id, lane_id, 'lane-status-invalid', 'status' FROM r WHERE status = 'lost'
    UNION ALL SELECT packet_id, lane_id, 'array-required', 'limitations' FROM r WHERE k = 0
    UNION ALL SELECT packet_id, lane_id, 'string-required', 'limitations' FROM r WHERE k = 1
    UNION ALL SELECT packet_id, lane_id, 'duplicate-value', 'claim_refs' FROM r WHERE k = 2
    UNION ALL SELECT packet_id, lane_id, 'lane-ref-unknown', concat('negative_claim_refs:', 'n', c) FROM r WHERE k = 3
    UNION ALL SELECT packet_id, lane_id, 'lane-id-duplicate', 'lane_id' FROM r GROUP BY packet_id, lane_id HAVING count(*) > 1
    UNION ALL SELECT c_custkey, NULL, CASE c_custkey % 3 WHEN 0 THEN 'inline-lanes-forbidden' ELSE 'expedition-lanes-missing' END, 'lane_receipts' FROM (SELECT c_custkey, count(packet_id) AS n FROM customer LEFT JOIN r ON packet_id = c_custkey GROUP BY c_custkey) WHERE c_custkey % 3 = 0 AND n > 0 OR c_custkey % 3 = 1 AND n < 2""",
)
def evidence_receipts(spark, d):
    r = table(spark, d, "orders").selectExpr(*[x.strip() for x in _columns(_RECEIPT)])
    text = "CAST(array() AS array<string>)"
    r = r.selectExpr("packet_id", "lane_id", "surface", "status", "CASE WHEN k = 2 THEN array(concat('c', c), concat('c', c)) ELSE array(concat('c', c)) END AS claim_refs", f"CASE WHEN k = 3 THEN array(concat('n', c)) ELSE {text} END AS negative_claim_refs", f"{text} AS contradiction_refs", f"CASE k WHEN 0 THEN NULL WHEN 1 THEN array('x', ' ') ELSE {text} END AS limitations")
    records = table(spark, d, "orders").selectExpr("o_custkey AS packet_id", "'claim_refs' AS field", "concat('c', o_orderkey) AS id")
    packets = table(spark, d, "customer").selectExpr("c_custkey AS packet_id", "CASE c_custkey % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'expedition' END AS mode")
    return evidence.receipt_findings(r, records, packets)


@query("evidence_freshness", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN 'fresh' ELSE 'stale' END AS freshness FROM orders")
def evidence_freshness(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey % 3 AS revision", "0L AS head", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 = 0 END AS dirty")
    return x.select("id", evidence.is_fresh(F.col("revision"), F.col("head"), F.col("dirty")).alias("freshness"))


@query(
    "health_sprawl",
    "WITH x AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_custkey % 2 = 0 AS named, o_orderkey % 4 AS m FROM orders) SELECT CAST(id AS STRING) AS subject_id, 'sprawl-kind-unknown' AS code FROM x WHERE k = 5 UNION ALL SELECT CAST(id AS STRING), 'sprawl-entry' FROM x WHERE k < 5 AND (NOT named OR k IN (1, 2) AND m < 2)",
)
def health_sprawl(spark, d):
    kinds = F.array(*[F.lit(k) for k in health_rules.SPRAWL], F.lit("odd"))
    x = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    fields = F.create_map(*[F.lit(v) for k in ("claim_id", "path", "note", "group", "contract") for v in (k, "x")])
    few = F.map_from_arrays(F.array(F.lit("path")), F.array(F.lit(" ")))
    members = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    return health_rules.sprawl_findings(x.select("id", F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("kind"), F.when(F.col("o_custkey") % 2 == 0, fields).otherwise(few).alias("fields"), members.alias("members"))).select("subject_id", "code")


@query("health_optional_lanes", "SELECT coalesce(a.lane, b.lane) AS lane, CASE WHEN b.lane IS NULL THEN 'lane-declared-not-scored' ELSE 'lane-scored-not-declared' END AS code FROM (SELECT DISTINCT concat('l', c_custkey % 40) AS lane FROM customer) a FULL JOIN (SELECT DISTINCT concat('l', o_custkey % 60 + 20) AS lane FROM orders) b ON a.lane = b.lane WHERE a.lane IS NULL OR b.lane IS NULL")
def health_optional_lanes(spark, d):
    return health_rules.optional_lanes(table(spark, d, "customer").selectExpr("concat('l', c_custkey % 40) AS lane"), table(spark, d, "orders").selectExpr("concat('l', o_custkey % 60 + 20) AS lane"))


_CAP = "SELECT DISTINCT o_custkey AS repository, concat('cap', CAST(o_orderkey %% 6 AS STRING)) AS cap FROM orders WHERE %s"
_DECLARED, _FIRED = _CAP % "o_orderkey % 4 <> 0", _CAP % "o_orderkey % 5 <> 0"


@query("health_cap_differences", f"SELECT *, 'cap-declared-not-fired' AS code FROM (({_DECLARED}) EXCEPT ({_FIRED})) UNION ALL SELECT *, 'cap-fired-not-declared' FROM (({_FIRED}) EXCEPT ({_DECLARED}))")
def health_cap_differences(spark, d):
    x = table(spark, d, "orders").withColumn("repository", F.col("o_custkey")).withColumn("cap", F.concat(F.lit("cap"), F.col("o_orderkey") % 6))
    return health_rules.cap_differences(x.where("o_orderkey % 4 <> 0"), x.where("o_orderkey % 5 <> 0"))


_DIMS = list(scores.WEIGHTS)
_HAS = f"CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN 'odd' ELSE ([{listed(_DIMS)}])[(l_linenumber - 1) % {len(_DIMS)} + 1] END"


@query("score_dimension_faults", f"WITH x AS (SELECT l_orderkey AS run, list(DISTINCT {_HAS}) AS has FROM lineitem GROUP BY l_orderkey), y AS (SELECT run, array_to_string(list_sort(list_filter([{listed(_DIMS)}], lambda w: NOT list_contains(has, w))), ',') AS missing, array_to_string(list_sort(list_filter(has, lambda w: NOT list_contains([{listed(_DIMS)}], w))), ',') AS extra FROM x) SELECT * FROM y WHERE missing <> '' OR extra <> ''")
def score_dimension_faults(spark, d):
    names = F.array(*map(F.lit, _DIMS))
    has = F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 3 == 0), "odd").otherwise(F.element_at(names, ((F.col("l_linenumber") - 1) % len(_DIMS) + 1).cast("int")))
    return scores.dimension_faults(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), has.alias("dimension")), "run")


@query("score_traced", "SELECT d.doc_id, contains(lower(coalesce(d.text, '')), 'the') AND contains(lower(coalesce(b.text, '')), 'the') AND contains(lower(coalesce(d.text, '')), 'and') AND contains(lower(coalesce(b.text, '')), 'and') AS covered FROM documents d LEFT JOIN (SELECT DISTINCT item_id, text FROM benchmark) b ON b.item_id = d.doc_id")
def score_traced(spark, d):
    cases = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit("THE"), F.lit("and")).alias("anchors"))
    return scores.traced(cases, table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("body")).distinct(), "doc_id")


@query("receipt_stage_times", "SELECT user_id, event_type AS stage, coalesce(sum(greatest(0, CASE WHEN event_id % 6 > 0 THEN event_id % 50 END - 10)) FILTER (event_id % 6 > 0), 0)::BIGINT AS elapsed FROM events GROUP BY user_id, event_type")
def receipt_stage_times(spark, d):
    x = table(spark, d, "events").selectExpr("user_id", "event_type AS stage", "event_id AS started", "CASE WHEN event_id % 6 > 0 THEN event_id + event_id % 50 - 10 END AS ended")
    return scores.stage_times(x, "user_id")


_TASK_ID = "CASE WHEN o_orderkey % 50 = 0 THEN ' ' WHEN o_orderkey % 30 = 0 THEN 'twice' ELSE concat('t', o_orderkey) END"


def _tasks(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'me' END AS owner", "CASE o_orderkey % 4 WHEN 1 THEN 'unit-test' WHEN 2 THEN 'render' WHEN 3 THEN 'scout' END AS kind", "CAST(NULL AS STRING) AS executor_class", "o_orderkey % 8 AS weight", "CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS priority",
        "o_orderkey % 5 AS expected_ms", "CASE WHEN o_orderkey % 2 = 0 THEN array('a', 'b', 'a') END AS depends_on", "CASE WHEN o_orderkey % 3 = 0 THEN array('db', 'db') END AS resources", "o_orderkey % 4 - 1 AS retries", "o_orderkey % 6 - 2 AS timeout_ms", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 = 1 END AS retry_on_timeout",
    )


@query(
    "receipt_tasks",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'unowned' ELSE 'me' END AS owner, CASE o_orderkey % 4 WHEN 0 THEN 'task' WHEN 1 THEN 'unit-test' WHEN 2 THEN 'render' ELSE 'scout' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'command' WHEN 2 THEN 'report' ELSE 'agent' END AS executor_class,"
    " CASE WHEN o_orderkey % 8 >= 1 THEN o_orderkey % 8 ELSE 1 END AS weight, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 0 END AS priority, CASE WHEN o_orderkey % 5 >= 1 THEN o_orderkey % 5 ELSE 1 END AS expected_ms, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS needs,"
    " CASE WHEN o_orderkey % 3 = 0 THEN 'db' ELSE '' END AS resources, greatest(o_orderkey % 4 - 1, 0) AS retries, CASE WHEN o_orderkey % 6 > 2 THEN o_orderkey % 6 - 2 END AS timeout_ms, o_orderkey % 5 = 1 AS retry_on_timeout, false AS allow_failed_dependencies FROM orders",
)
def receipt_tasks(spark, d):
    return scores.normalized_tasks(_tasks(spark, d)).select("id", "owner", "kind", "executor_class", "weight", "priority", "expected_ms", F.array_join("depends_on", ",").alias("needs"), F.array_join("resources", ",").alias("resources"), "retries", "timeout_ms", "retry_on_timeout", "allow_failed_dependencies")


@query(
    "receipt_task_findings",
    f"""WITH t AS (SELECT o_custkey % 20 AS plan, {_TASK_ID} AS id, o_orderkey % 8 AS weight, CASE WHEN o_orderkey % 9 = 0 THEN concat('t', o_orderkey + 1) WHEN o_orderkey % 9 = 1 THEN concat('t', o_orderkey) END AS need FROM orders)
    SELECT plan, trim(id) AS id, 'TASK_ID_INVALID' AS code, '' AS detail FROM t WHERE trim(id) = ''
    UNION ALL SELECT plan, id, 'TASK_WEIGHT_EXCEEDS_BUDGET', weight::VARCHAR FROM t WHERE weight > 6
    UNION ALL SELECT plan, id, 'TASK_ID_DUPLICATE', count(*)::VARCHAR FROM t WHERE trim(id) <> '' GROUP BY plan, id HAVING count(*) > 1
    UNION ALL SELECT plan, trim(id), 'TASK_DEPENDENCY_UNKNOWN', need FROM t WHERE need IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t o WHERE o.plan = t.plan AND o.id = t.need)""",
)
def receipt_task_findings(spark, d):
    need = "CASE WHEN o_orderkey % 9 = 0 THEN array(concat('t', o_orderkey + 1), concat('t', o_orderkey + 1)) WHEN o_orderkey % 9 = 1 THEN array(concat('t', o_orderkey)) END"
    x = table(spark, d, "orders").selectExpr("o_custkey % 20 AS plan", f"{_TASK_ID} AS id", "o_orderkey % 8 AS weight", f"{need} AS depends_on")
    return scores.task_findings(x, "plan", 6)


@query("finding_unknown_keys", "SELECT CAST(p_partkey AS STRING) AS subject_id, k AS path FROM part, unnest(['x', concat('y', CAST(p_partkey % 3 AS STRING))]) AS u(k) WHERE k <> 'y1'")
def finding_unknown_keys(spark, d):
    raw = table(spark, d, "part").selectExpr("p_partkey AS id", """concat('{"a":1,"x":2,"y', p_partkey % 3, '":{"z":1}}') AS raw""")
    return findings.unknown_keys(raw, "id", "raw", ["a", "y1"], "part").select("subject_id", "path")


@query("finding_unknown_references", "SELECT CAST(o_orderkey AS STRING) AS subject_id, CAST(r AS STRING) AS path FROM orders, unnest([o_custkey, o_custkey * 3]) AS u(r) WHERE r NOT IN (SELECT c_custkey FROM customer)")
def finding_unknown_references(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "array(o_custkey, o_custkey * 3) AS refs")
    return findings.unknown_references(rows, "id", "refs", table(spark, d, "customer").select("c_custkey"), "ref-unknown", "order").select("subject_id", "path")


_ISLAND = """CASE c_custkey % 4 WHEN 0 THEN 'no island' WHEN 1 THEN '<script id="data">{broken</script>' ELSE concat('<p><script type="x" id="data">{"n": ', CAST(c_custkey AS STRING), '}</script><script>1</script>') END"""


@query("source_islands", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 1 THEN c_custkey END AS n, CASE c_custkey % 4 WHEN 0 THEN 'island-absent' WHEN 1 THEN 'island-invalid' END AS error FROM customer")
def source_islands(spark, d):
    x = readers.islands(table(spark, d, "customer").selectExpr("c_custkey AS id", f"{_ISLAND} AS html"), "html", "data")
    return x.select("id", F.try_variant_get("island", "$.n", "long").alias("n"), "error")


_FRONT = "CASE WHEN c_custkey % 5 = 0 THEN 'no front matter' ELSE concat('---', chr(10), 'id: ', CAST(c_custkey AS STRING), ' # note', chr(10), CASE WHEN c_custkey % 5 = 1 THEN concat('broken', chr(10)) ELSE '' END, 'title: \"T ', CAST(c_custkey AS STRING), '\"', chr(10), 'id: ', CAST(c_custkey + 1 AS STRING), chr(10), '---', chr(10), 'body ', CAST(c_custkey AS STRING)) END"


@query("source_frontmatter", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 1 THEN concat('T ', c_custkey) END AS title, CASE WHEN c_custkey % 5 > 1 THEN CAST(c_custkey + 1 AS STRING) END AS own_id, CASE WHEN c_custkey % 5 = 0 THEN 'no front matter' ELSE concat('body ', c_custkey) END AS body, CASE c_custkey % 5 WHEN 0 THEN 'frontmatter-missing' WHEN 1 THEN 'frontmatter-line' END AS error FROM customer")
def source_frontmatter(spark, d):
    x = readers.frontmatter(table(spark, d, "customer").selectExpr("c_custkey AS id", f"{_FRONT} AS text"))
    return x.select("id", F.try_element_at("fields", F.lit("title")).alias("title"), F.try_element_at("fields", F.lit("id")).alias("own_id"), "body", "error")


@query("source_changed_paths", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('a', c_custkey, ',b/new,b/old') ELSE concat('a', c_custkey, ',z') END AS paths FROM customer")
def source_changed_paths(spark, d):
    x = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN concat(' M a', c_custkey, chr(0), 'R  b/new', chr(0), 'b/old', chr(0)) ELSE concat('?? z', chr(0), ' M a', c_custkey, chr(0), 'A  z', chr(0)) END AS status")
    return x.select("id", F.array_join(readers.changed_paths(F.col("status")), ",").alias("paths"))


@query(
    "ledger_band_stops",
    """SELECT i, percent, count(*) FILTER (place < percent) AS below, count(*) FILTER (place >= percent) AS reached
    FROM (SELECT (greatest(-10, least(22, {priority})) + 10) * 100.0 / 32 AS place FROM {candidate}), (SELECT unnest([1, 2]) AS i, unnest([(5 + 10) * 100.0 / 32, (13 + 10) * 100.0 / 32]) AS percent) GROUP BY ALL""",
)
def ledger_band_stops(spark, d):
    """Where bands meet on the axis, and how many candidates lie on either side."""
    x = ledger.scored(view(spark, d, "candidate")).select(ledger.fill_percent(F.col("priority")).alias("at"))
    stops = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(p).alias("percent")) for i, p in enumerate(ledger.band_stops(), 1)])
    return x.select("at", F.inline(stops)).groupBy("i", "percent").agg(F.count_if(F.col("at") < F.col("percent")).alias("below"), F.count_if(F.col("at") >= F.col("percent")).alias("reached"))


@query("ledger_counts", "SELECT ledger_id, CASE WHEN {priority} >= 13 THEN 'strong' WHEN {priority} >= 6 THEN 'worth' ELSE 'speculative' END AS band, action, count(*) AS n, count(*) FILTER (unresolved <> '') AS n_blocked FROM {gated} GROUP BY ALL")
def ledger_counts(spark, d):
    return ledger.counts(ledger.gated(view(spark, d, "candidate"), view(spark, d, "dep")), "ledger_id")


@query(
    "cache_reuse_counts",
    """WITH r AS (SELECT w.id % 5 AS part, CASE WHEN c.id IS NULL THEN 'miss' WHEN c.input_fp = w.input_fp AND c.dep_fp = w.dep_fp AND c.env_fp = w.env_fp AND c.rev = w.rev THEN 'exact'
        WHEN c.input_fp = w.input_fp AND c.dep_fp = w.dep_fp AND c.env_fp = w.env_fp THEN 'content-stable' WHEN c.env_fp = w.env_fp THEN 'warm-only' ELSE 'miss' END AS reuse FROM {wanted} w LEFT JOIN {cached} c ON c.id = w.id)
    SELECT part, reuse, count(*) AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY part) * 1000 + 0.5) / 1000 AS share FROM r GROUP BY part, reuse""",
)
def cache_reuse_counts(spark, d):
    content = ["input_fp", "dep_fp", "env_fp"]
    reuse = delta.reuse_class(view(spark, d, "cached"), view(spark, d, "wanted"), "id", [*content, "rev"], content, ["env_fp"])
    return delta.reuse_counts(reuse.withColumn("part", F.col("id") % 5), "part")


@query(
    "ledger_shape_cases",
    """WITH c AS (SELECT candidate_id AS id, CASE WHEN ordinal % 7 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN ordinal % 5 = 0 THEN 6 WHEN ordinal % 5 = 1 THEN NULL ELSE severity END AS severity, CASE WHEN ordinal % 3 = 0 THEN 'XL' END AS effort, status_stored, priority_stored,
        severity AS s, {priority} AS priority FROM {candidate})
    SELECT id AS subject_id, 'missing-field' AS code, 'title' AS path FROM c WHERE title = ' '
    UNION ALL SELECT id, 'score-range', 'severity' FROM c WHERE severity IS NULL OR severity > 5
    UNION ALL SELECT id, 'effort-range', 'effort' FROM c WHERE effort = 'XL'
    UNION ALL SELECT id, 'status-invalid', 'status' FROM c WHERE status_stored = 'done'
    UNION ALL SELECT id, 'priority-mismatch', 'priority_score' FROM c WHERE priority_stored <> priority - s + severity""",
)
def ledger_shape_cases(spark, d):
    """Candidates with a fault of each kind."""
    x = view(spark, d, "candidate").selectExpr("* EXCEPT (severity, effort, title)", "CASE WHEN ordinal % 5 = 0 THEN 6 WHEN ordinal % 5 = 1 THEN NULL ELSE severity END AS severity", "CASE WHEN ordinal % 3 = 0 THEN 'XL' END AS effort", "CASE WHEN ordinal % 7 = 0 THEN ' ' ELSE 't' END AS title")
    return ledger.shape_findings(x).select("subject_id", "code", "path")


_RUNS = [
    lint.Check("words", required=["goal", "zebra"], forbidden=["SYSTEM:"]),
    lint.Check("questions", "QUESTION-COUNT", questions=(2, 3), not_asked=["next"]),
    lint.Check("order", "ORDER", order=("File map", "Verification")),
    lint.Check("reversed", "ORDER", order=("Verification", "Goal")),
]


@query(
    "text_check_runs",
    r"""WITH t AS (SELECT doc_id, lower(text) AS low, list_transform(regexp_extract_all(text, '(?m)^\s*>?\s*\d+\.\s+(.+?\?)\s*$', 1), lambda q: trim(q)) AS asked FROM {handoff_text}),
    b AS (
        SELECT doc_id, 'words' AS check_id, 'EVIDENCE-INCOMPLETE' AS code, list_concat(CASE WHEN contains(low, 'goal') THEN [] ELSE ['missing: goal'] END, ['missing: zebra'], CASE WHEN contains(low, 'system:') THEN ['present: SYSTEM:'] ELSE [] END) AS bad FROM t
        UNION ALL SELECT doc_id, 'questions', 'QUESTION-COUNT', list_concat(list_filter(asked, lambda q: contains(lower(q), 'next')), CASE WHEN len(asked) BETWEEN 2 AND 3 THEN [] ELSE [concat('question count ', len(asked))] END) FROM t
        UNION ALL SELECT doc_id, 'order', 'ORDER', CASE WHEN strpos(low, 'file map') > 0 AND strpos(low, 'file map') < strpos(low, 'verification') THEN [] ELSE ['order File map before Verification not observed'] END FROM t
        UNION ALL SELECT doc_id, 'reversed', 'ORDER', CASE WHEN strpos(low, 'verification') > 0 AND strpos(low, 'verification') < strpos(low, 'goal') THEN [] ELSE ['order Verification before Goal not observed'] END FROM t)
    SELECT doc_id, check_id, code, len(bad) = 0 AS ok, array_to_string(bad[1:6], '|') AS evidence FROM b""",
)
def text_check_runs(spark, d):
    return lint.check_runs(view(spark, d, "handoff_text"), _RUNS)


@query(
    "receipt_observed",
    """WITH open AS (SELECT o_custkey % 10 AS k, o_totalprice FROM orders WHERE o_orderstatus <> 'F')
    SELECT 'read' AS stage, count(*) AS rows, NULL::BIGINT AS highest, true AS timed FROM orders
    UNION ALL SELECT 'open', count(*), max(o_totalprice)::BIGINT, true FROM open
    UNION ALL SELECT 'grouped', count(DISTINCT k), NULL, true FROM open""",
)
def receipt_observed(spark, d):
    """What passed through the stages of a real query, noted while it ran once."""
    told = receipts.Receipts(spark, "open orders")
    read = told.watched(table(spark, d, "orders"), "read")
    held = told.watched(read.where("o_orderstatus <> 'F'"), "open", highest=F.max("o_totalprice"))
    grouped = told.watched(held.groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.sum("o_totalprice")), "grouped")
    with told.timed("grouped"):
        grouped.write.format("noop").mode("overwrite").save()
    took = told.stages().where("started IS NOT NULL").count() == 1
    rows = [(stage, m["rows"], None if m.get("highest") is None else int(m["highest"] + 0.5), took) for stage, m in told.metrics()]
    return spark.createDataFrame(rows, "stage string, rows long, highest long, timed boolean")


@query("session_newest_handoff", "WITH x AS (SELECT user_id AS folder, event_id, concat('202405', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '-0102', lpad(CAST(event_id % 70 AS STRING), 2, '0'), 'Z-abcdef12-handoff.md') AS name, event_id % 5 = 0 AS bad, event_id % 70 < 60 AS real FROM events), g AS (SELECT folder, max(name) AS best FROM x WHERE NOT bad AND real GROUP BY folder) SELECT x.folder, best AS name, count(*) FILTER (x.name > best) AS newer, count(*) FILTER (x.name < best) AS older FROM x JOIN g ON g.folder = x.folder GROUP BY x.folder, best")
def session_newest_handoff(spark, d):
    x = table(spark, d, "events").selectExpr("user_id AS folder", "concat('202405', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), '-0102', lpad(CAST(event_id % 70 AS STRING), 2, '0'), 'Z-abcdef12-handoff.md') AS name", "CAST(NULL AS BIGINT) AS written_ms", "CASE WHEN event_id % 5 = 0 THEN 1 END AS faults")
    return sessions.newest_valid(x, 4_000_000_000_000)


def _tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)))"


@query(
    "similar_passages",
    f"WITH d AS (SELECT doc_id, {_tokens_sql("coalesce(text, '')")} AS s FROM documents), b AS (SELECT item_id, {_tokens_sql('text')} AS s FROM benchmark), p AS (SELECT doc_id, item_id, len(list_intersect(d.s, b.s)) AS i, len(d.s) AS nd, len(b.s) AS nb FROM d, b),"
    " q AS (SELECT *, greatest(i / (nd + nb - i), i / least(nd, nb)) AS v FROM p WHERE i > 0) SELECT doc_id, item_id, round(v, 6) AS similarity FROM q WHERE v >= 0.6",
)
def similar_passages(spark, d):
    return similar.contained_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


_JSON = "CASE c_custkey % 4 WHEN 0 THEN '{broken' WHEN 1 THEN ' ' WHEN 2 THEN concat('{\"n\": ', CAST(c_custkey AS STRING), '}') END"


@query("source_json_records", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 2 THEN c_custkey END AS n, CASE c_custkey % 4 WHEN 0 THEN 'json-invalid' WHEN 1 THEN 'json-absent' WHEN 3 THEN 'json-absent' END AS error FROM customer")
def source_json_records(spark, d):
    x = readers.json_records(table(spark, d, "customer").selectExpr("c_custkey AS id", f"{_JSON} AS text"), "text")
    return x.select("id", F.try_variant_get("record", "$.n", "long").alias("n"), "error")


_BLOCKS = (
    "CASE c_custkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN concat_ws(chr(10), '---', 'a: b') ELSE concat_ws(chr(10), '---', '# note', concat('name: n', CAST(c_custkey AS STRING)), concat('about: ', CASE c_custkey % 5 WHEN 2 THEN '|' WHEN 3 THEN '>-' ELSE 'one' END),"
    " '  first', '', concat('    at 9: ', c_name), 'last: \"q\"', ' stray: x', 'no colon', '---', 'body: 1') END"
)


@query(
    "source_block_frontmatter",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 1 THEN concat('n', c_custkey) END AS name, CASE c_custkey % 5 WHEN 2 THEN concat('first', chr(10), chr(10), 'at 9: ', c_name) WHEN 3 THEN concat('first  at 9: ', c_name) WHEN 4 THEN 'one' END AS about,"
    " CASE WHEN c_custkey % 5 > 1 THEN 'q' END AS last, CASE WHEN c_custkey % 5 > 1 THEN 3 END AS n, CASE c_custkey % 5 WHEN 0 THEN 'frontmatter-missing' WHEN 1 THEN 'frontmatter-unclosed' END AS error FROM customer",
)
def source_block_frontmatter(spark, d):
    x = readers.block_frontmatter(table(spark, d, "customer").selectExpr("c_custkey AS id", f"{_BLOCKS} AS text"))
    get = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return x.select("id", get("name"), get("about"), get("last"), F.size(F.map_keys("fields")).alias("n"), "error")


_TICKET = "CASE WHEN c_custkey % 6 = 0 THEN 'no block' ELSE concat_ws(chr(10), '---', concat('id: ', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 3 = 0 THEN 'title: T' END, 'type: task', 'state: open', CASE WHEN c_custkey % 4 = 0 THEN 'assignee: me' END, CASE WHEN c_custkey % 6 = 1 THEN 'blocked_by: [1, x]' ELSE 'blocked_by: [1, 2]' END, '---', 'body', CASE WHEN c_custkey % 5 = 0 THEN '## Resolution' END) END"


@query(
    "source_tickets",
    "SELECT concat('m/t', c_custkey, '.md') AS path, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 6 = 3 THEN 'T' ELSE concat('t', c_custkey) END AS title, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 4 = 0 THEN 'me' ELSE '' END AS claimed_by,"
    " CASE WHEN c_custkey % 6 > 1 THEN '1,2' END AS blocked_by, c_custkey % 6 <> 0 AND c_custkey % 5 = 0 AS has_resolution, CASE c_custkey % 6 WHEN 0 THEN 'frontmatter-missing' WHEN 1 THEN 'blocked-by-invalid' END AS error FROM customer",
)
def source_tickets(spark, d):
    x = readers.tickets(dealt(table(spark, d, "customer").select("c_custkey")).selectExpr("concat('m/t', c_custkey, '.md') AS path", f"{_TICKET} AS text"))
    return x.select("path", "id", "title", "claimed_by", F.array_join(F.transform("blocked_by", lambda i: i.cast("string")), ",").alias("blocked_by"), "has_resolution", "error")


@query(
    "sink_templates",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 1 THEN concat('<b>', p_name, '</b>', p_type) END AS output, CASE WHEN p_partkey % 4 > 1 THEN sha256(concat('<b>', p_name, '</b>', p_type)) END AS sha256, CASE WHEN p_partkey % 4 > 1 THEN 7 + strlen(p_name) + strlen(p_type) END AS bytes,"
    " CASE p_partkey % 4 WHEN 0 THEN 'marker-missing:@@TYPE@@' WHEN 1 THEN 'marker-duplicate:@@NAME@@' END AS error FROM part",
)
def sink_templates(spark, d):
    x = table(spark, d, "part").selectExpr("p_partkey AS id", "p_name", "p_type", "CASE p_partkey % 4 WHEN 0 THEN '<b>@@NAME@@</b>' WHEN 1 THEN '@@NAME@@@@TYPE@@@@NAME@@' ELSE '<b>@@NAME@@</b>@@TYPE@@' END AS template")
    return readers.filled(x, {"@@NAME@@": F.col("p_name"), "@@TYPE@@": F.col("p_type")}).select("id", "output", "sha256", "bytes", "error")
