"""Registered queries of the assessment operators over the star schema's views, with SQL for those that SQL expresses."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import scalars
from assaykit.operators import delta, evidence, findings, graph, health, health_rules, ledger, lint, scores, similar, tracker
from assaykit.plans.views import VIEWS, view
from assaykit.functions.shared import shared_folder
from assaykit.sources import files, readers
from assaykit.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; in its SQL, {view} stands for a view's own SQL."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = re.sub(r"\{([a-z]\w+)\}", lambda m: VIEWS[m[1]].sql() if m[1] in VIEWS else FRAGMENTS[m[1]], sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRIORITY = "(severity + confidence + leverage + locality + testability - blast_radius - regression_risk - human_decision_risk)"
EFFORT = "CASE effort WHEN 'S' THEN 0 WHEN 'L' THEN 2 ELSE 1 END"
COVER = "CASE coverage WHEN 'inspected' THEN 1.0 WHEN 'sampled' THEN 0.6 WHEN 'inventory-only' THEN 0.25 WHEN 'uninspected' THEN 0.0 WHEN 'unavailable' THEN 0.0 END::DOUBLE"
WORTH = "CASE quality WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.9 WHEN 'weak' THEN 0.7 WHEN 'none' THEN 0.0 END::DOUBLE"
FRAGMENTS = {
    "priority": PRIORITY,
    "unresolved": f"""(SELECT e.ledger_id, e.candidate_id, list(DISTINCT e.depends_on ORDER BY e.depends_on) AS unresolved
        FROM {VIEWS["dep"].sql()} e LEFT JOIN {VIEWS["candidate"].sql()} c ON c.ledger_id = e.ledger_id AND c.candidate_id = e.depends_on
        WHERE e.candidate_id <> e.depends_on AND c.status_stored IS DISTINCT FROM 'completed' GROUP BY ALL)""",
    "lanes": """(SELECT repository, lane, max(lane_weight) AS lane_weight, floor(sum(level / 4.0 * CASE dimension WHEN 'observed_soundness' THEN 30
        WHEN 'automated_enforcement' THEN 25 WHEN 'verification_readiness' THEN 20 WHEN 'boundary_clarity' THEN 10 WHEN 'change_containment' THEN 10 ELSE 5 END::DOUBLE) * 100 + 0.5) / 100 AS score
        FROM """
    + VIEWS["dimension"].sql()
    + " GROUP BY repository, lane)",
    "coverage": f"""(SELECT repository,
        coalesce(floor(sum(weight * cr) FILTER (cr IS NOT NULL) / sum(weight) FILTER (cr IS NOT NULL) * 100 * 10 + 0.5) / 10, 0.0) AS weighted_coverage,
        coalesce(floor(sum(weight * wo) FILTER (cr IS NOT NULL) / sum(weight) FILTER (cr IS NOT NULL) * 100 * 10 + 0.5) / 10, 0.0) AS evidence_strength,
        coalesce(floor(sum(weight * cr) FILTER (cr IS NOT NULL AND core) / sum(weight) FILTER (cr IS NOT NULL AND core) * 100 * 10 + 0.5) / 10, 0.0) AS core_availability,
        count(*) FILTER (core AND coverage = 'unavailable') AS unavailable_core
        FROM (SELECT *, {COVER} * {WORTH} AS cr, {WORTH} AS wo FROM {VIEWS["surface"].sql()}) GROUP BY repository)""",
    "baseline": f"""(SELECT repository,
        CASE WHEN t = 0 THEN 'partial' WHEN bt > 0 THEN 'untrustworthy' WHEN bo > 0 THEN 'partial' ELSE 'trustworthy' END AS state,
        CASE WHEN t = 0 THEN 'no-test-command' WHEN bt > 0 THEN 'test-not-passing' WHEN bo > 0 THEN 'non-test-not-passing' ELSE 'all-passing' END AS reason
        FROM (SELECT repository, count(*) FILTER (kind = 'test') AS t, count(*) FILTER (kind = 'test' AND result <> 'pass') AS bt,
              count(*) FILTER (kind <> 'test' AND result NOT IN ('pass', 'skipped')) AS bo FROM {VIEWS["command"].sql()} GROUP BY repository))""",
}
FRAGMENTS["overall"] = f"""(SELECT repository, floor(sum(score * lane_weight) / sum(lane_weight) * 100 + 0.5) / 100 AS overall_raw,
    (min(struct_pack(s := score, l := lane)) FILTER (lane_weight >= 4)).l AS weakest_lane, min(score) FILTER (lane_weight >= 4) AS weakest_score
    FROM {FRAGMENTS["lanes"]} GROUP BY repository)"""
FRAGMENTS["gated"] = f"""(SELECT c.*, coalesce(array_to_string(u.unresolved, ','), '') AS unresolved,
    CASE WHEN action = 'reject' THEN 'rejected' WHEN human_decision_risk >= 4 OR blocked_by THEN 'needs-human-decision'
         WHEN u.unresolved IS NOT NULL THEN 'blocked' ELSE 'ready' END AS status_derived,
    row_number() OVER (PARTITION BY c.ledger_id ORDER BY {PRIORITY} DESC, {EFFORT}, severity DESC, confidence DESC, c.candidate_id) AS rank
    FROM {VIEWS["candidate"].sql()} c LEFT JOIN {FRAGMENTS["unresolved"]} u ON u.ledger_id = c.ledger_id AND u.candidate_id = c.candidate_id)"""
VALID = "status_stored IN ('ready', 'blocked', 'needs-human-decision', 'rejected', 'completed')"
FRAGMENTS["eligible"] = f"(SELECT * FROM {FRAGMENTS['gated']} WHERE status_derived = 'ready' AND (status_stored IS NULL OR status_stored = 'ready'))"


# Ledgers


@query(
    "ledger_rank",
    f"SELECT ledger_id, candidate_id, {PRIORITY} AS priority, {PRIORITY} * 100.0 / 32 + 1000.0 / 32 AS fill_percent, CASE WHEN {PRIORITY} >= 13 THEN 'strong' WHEN {PRIORITY} >= 6 THEN 'worth' ELSE 'speculative' END AS band,"
    f" human_decision_risk >= 4 AS judgment_heavy, row_number() OVER (PARTITION BY ledger_id ORDER BY {PRIORITY} DESC, {EFFORT}, severity DESC, confidence DESC, candidate_id) AS rank FROM {{candidate}}",
)
def ledger_rank(spark, d):
    return ledger.ranked(view(spark, d, "candidate")).select("ledger_id", "candidate_id", "priority", "fill_percent", "band", "judgment_heavy", "rank")


@query(
    "ledger_gates",
    f"SELECT ledger_id, candidate_id, unresolved, status_derived, CASE WHEN {VALID} THEN status_stored ELSE status_derived END AS status,"
    " coalesce(status_derived = 'ready' AND (status_stored IS NULL OR status_stored = 'ready'), false) AS eligible FROM {gated}",
)
def ledger_gates(spark, d):
    x = ledger.gated(view(spark, d, "candidate"), view(spark, d, "dep"))
    return x.select("ledger_id", "candidate_id", F.coalesce(F.array_join("unresolved", ","), F.lit("")).alias("unresolved"), "status_derived", "status", "eligible")


@query("ledger_queue", "SELECT ledger_id, candidate_id, row_number() OVER (PARTITION BY ledger_id ORDER BY rank) AS position FROM {eligible}")
def ledger_queue(spark, d):
    return ledger.queue(ledger.gated(view(spark, d, "candidate"), view(spark, d, "dep")))


HUMAN = "SELECT ledger_id, candidate_id, -ordinal AS place FROM {candidate} WHERE ordinal % 8 = 2 UNION ALL SELECT ledger_id, 'x', 0 FROM {candidate} WHERE ordinal % 50 = 7"


def _human(spark, d):
    c = view(spark, d, "candidate")
    return c.where("ordinal % 8 = 2").selectExpr("ledger_id", "candidate_id", "-ordinal AS place").unionByName(c.where("ordinal % 50 = 7").selectExpr("ledger_id", "'x' AS candidate_id", "0L AS place"))


@query(
    "ledger_human_order",
    f"SELECT e.ledger_id, e.candidate_id, row_number() OVER (PARTITION BY e.ledger_id ORDER BY h.place NULLS LAST, rank) AS position FROM {{eligible}} e LEFT JOIN ({HUMAN}) h ON h.ledger_id = e.ledger_id AND h.candidate_id = e.candidate_id",
)
def ledger_human_order(spark, d):
    return ledger.queue(ledger.gated(view(spark, d, "candidate"), view(spark, d, "dep")), _human(spark, d))


@query(
    "ledger_skipped_orders",
    f"SELECT DISTINCT h.ledger_id, h.candidate_id, CASE WHEN c.candidate_id IS NULL THEN 'unknown' ELSE 'ineligible' END AS reason FROM ({HUMAN}) h"
    " LEFT JOIN {candidate} c ON c.ledger_id = h.ledger_id AND c.candidate_id = h.candidate_id LEFT JOIN {eligible} e ON e.ledger_id = h.ledger_id AND e.candidate_id = h.candidate_id WHERE e.candidate_id IS NULL",
)
def ledger_skipped_orders(spark, d):
    return ledger.skipped_orders(ledger.gated(view(spark, d, "candidate"), view(spark, d, "dep")), _human(spark, d))


@query(
    "ledger_references",
    "SELECT e.ledger_id, e.candidate_id, CASE WHEN e.candidate_id = e.depends_on THEN 'dep-self' ELSE 'dep-unknown' END AS code, e.depends_on AS ref FROM {dep} e"
    " LEFT JOIN {candidate} c ON c.ledger_id = e.ledger_id AND c.candidate_id = e.depends_on WHERE e.candidate_id = e.depends_on OR c.candidate_id IS NULL",
)
def ledger_references(spark, d):
    return ledger.reference_findings(view(spark, d, "candidate"), view(spark, d, "dep"))


@query(
    "ledger_shape",
    f"SELECT candidate_id AS subject_id, 'status-invalid' AS code FROM {{candidate}} WHERE status_stored = 'done' UNION ALL SELECT candidate_id, 'priority-mismatch' FROM {{candidate}} WHERE priority_stored <> {PRIORITY}",
)
def ledger_shape(spark, d):
    return ledger.shape_findings(view(spark, d, "candidate")).select("subject_id", "code")


@query("ledger_bands", f"SELECT CASE WHEN {PRIORITY} >= 13 THEN 'strong' WHEN {PRIORITY} >= 6 THEN 'worth' ELSE 'speculative' END AS band, action, count(*) AS n FROM {{candidate}} GROUP BY ALL")
def ledger_bands(spark, d):
    return ledger.scored(view(spark, d, "candidate")).groupBy("band", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_card_order",
    f"WITH r AS (SELECT ledger_id, candidate_id, ordinal AS place, row_number() OVER (PARTITION BY ledger_id ORDER BY {PRIORITY} DESC, {EFFORT}, severity DESC, confidence DESC, candidate_id) AS rank FROM {{candidate}}),"
    " m AS (SELECT *, max(rank) OVER (PARTITION BY ledger_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM r) SELECT ledger_id, candidate_id, rank, highest_before FROM m WHERE rank <= highest_before",
)
def ledger_card_order(spark, d):
    return ledger.out_of_order(ledger.ranked(view(spark, d, "candidate")).withColumnRenamed("ordinal", "place")).select("ledger_id", "candidate_id", "rank", "highest_before")


EDGES = "SELECT ledger_id AS grp, candidate_id AS node, depends_on AS needs FROM {dep} WHERE candidate_id <> depends_on"


@query(
    "ledger_cycles",
    f"WITH RECURSIVE e AS (SELECT DISTINCT d.* FROM ({EDGES}) d JOIN {{candidate}} c ON c.ledger_id = d.grp AND c.candidate_id = d.needs),"
    " w AS (SELECT grp, node AS start, needs AS cur, [node, needs] AS path FROM e WHERE needs > node UNION ALL SELECT w.grp, w.start, e.needs, list_append(w.path, e.needs) FROM w JOIN e ON e.grp = w.grp AND e.node = w.cur WHERE e.needs > w.start AND NOT list_contains(w.path, e.needs))"
    " SELECT DISTINCT w.grp AS ledger_id, array_to_string(list_sort(w.path), ',') AS members FROM w JOIN e ON e.grp = w.grp AND e.node = w.cur AND e.needs = w.start",
)
def ledger_cycles(spark, d):
    known = view(spark, d, "candidate").select(F.col("ledger_id").alias("group"), F.col("candidate_id").alias("needs"))
    edges = view(spark, d, "dep").select(F.col("ledger_id").alias("group"), F.col("candidate_id").alias("node"), F.col("depends_on").alias("needs"))
    x = graph.cycles(edges.join(known, ["group", "needs"], "left_semi"))
    return x.select(F.col("group").alias("ledger_id"), F.array_join("members", ",").alias("members"))


# Health


@query("health_coverage", "SELECT * FROM {coverage}")
def health_coverage(spark, d):
    return health.coverage(view(spark, d, "surface"))


@query("health_lanes", "SELECT * FROM {lanes}")
def health_lanes(spark, d):
    return health.lane_scores(view(spark, d, "dimension"))


@query("health_overall", "SELECT * FROM {overall}")
def health_overall(spark, d):
    return health.overall(health.lane_scores(view(spark, d, "dimension")))


@query("health_baseline", "SELECT * FROM {baseline}")
def health_baseline(spark, d):
    return health.baseline(view(spark, d, "command"))


GRADE = lambda s: f"CASE WHEN {s} >= 90 THEN 0 WHEN {s} >= 75 THEN 1 WHEN {s} >= 50 THEN 2 WHEN {s} >= 25 THEN 3 ELSE 4 END"


@query(
    "health_grades",
    f"WITH x AS (SELECT o.repository, overall_raw, weighted_coverage, unavailable_core, {GRADE('overall_raw')} AS raw, CASE WHEN weakest_score IS NOT NULL THEN greatest(0, {GRADE('weakest_score')} - 1) END AS c1,"
    " CASE coalesce(state, 'not-run') WHEN 'trustworthy' THEN NULL WHEN 'partial' THEN CASE WHEN reason = 'no-test-command' THEN 1 ELSE 2 END ELSE 2 END AS c2,"
    " CASE WHEN weighted_coverage < 80 THEN 1 END AS c3, CASE WHEN weighted_coverage < 60 THEN 2 END AS c4"
    " FROM {overall} o JOIN {coverage} c ON c.repository = o.repository LEFT JOIN {baseline} b ON b.repository = o.repository), y AS (SELECT *, greatest(raw, coalesce(c1, 0), coalesce(c2, 0), coalesce(c3, 0), coalesce(c4, 0)) AS fin, weighted_coverage < 40 OR unavailable_core > 0 AS closed FROM x)"
    " SELECT repository, overall_raw, substr('ABCDF', raw + 1, 1) AS raw_grade, CASE WHEN closed THEN 'Not gradable' ELSE substr('ABCDF', fin + 1, 1) END AS final_grade,"
    " CASE WHEN closed THEN 0 ELSE (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT + (c4 IS NOT NULL)::INT END::BIGINT AS n_caps,"
    " CASE WHEN closed OR fin = raw THEN '' ELSE concat_ws(',', CASE WHEN c1 = fin THEN 'weakest-critical-lane' END, CASE WHEN c2 = fin THEN 'baseline' END, CASE WHEN c3 = fin THEN 'coverage-below-80' END, CASE WHEN c4 = fin THEN 'coverage-below-60' END) END AS binding FROM y",
)
def health_grades(spark, d):
    return health.graded(health.lane_scores(view(spark, d, "dimension")), view(spark, d, "surface"), view(spark, d, "command"))


@query(
    "health_confidence",
    "WITH x AS (SELECT c.repository, floor((weighted_coverage * 0.40 + evidence_strength * 0.20 + CASE coalesce(state, 'not-run') WHEN 'trustworthy' THEN 100 WHEN 'partial' THEN 50 ELSE 0 END * 0.15::DOUBLE + core_availability * 0.10::DOUBLE + 80 * 0.10::DOUBLE + 50 * 0.05::DOUBLE) * 10 + 0.5) / 10 AS confidence_index"
    " FROM {coverage} c LEFT JOIN {baseline} b ON b.repository = c.repository) SELECT *, CASE WHEN confidence_index >= 75 THEN 'high' WHEN confidence_index >= 50 THEN 'moderate' ELSE 'low' END AS confidence_band FROM x",
)
def health_confidence(spark, d):
    x = health.coverage(view(spark, d, "surface")).join(health.baseline(view(spark, d, "command")), "repository", "left")
    x = x.withColumn("baseline_factor", scalars.choice(F.coalesce("state", F.lit("not-run")), health.BASELINE_FACTOR)).withColumn("determinism_ratio", F.lit(80)).withColumn("freshness_factor", F.lit(50))
    return health.confidence(x)


@query("health_gaps", f"SELECT repository, place, surface, gap FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY gap DESC, surface) AS place FROM (SELECT repository, surface, weight * (1 - {COVER} * {WORTH}) AS gap FROM {{surface}} WHERE coverage <> 'not-applicable') WHERE gap > 0) WHERE place <= 5")
def health_gaps(spark, d):
    return health.coverage_gaps(view(spark, d, "surface"))


@query("health_missing_surfaces", "SELECT r.repository, s.surface FROM (SELECT DISTINCT repository FROM {surface}) r, (SELECT unnest(" + str(list(health.SURFACES)) + ") AS surface) s")
def health_missing_surfaces(spark, d):
    return health.missing_surfaces(view(spark, d, "surface"))


@query("health_determinism", "SELECT packet_id AS repository, floor(count(*) FILTER (status = 'confirmed') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS determinism_ratio FROM {claim} GROUP BY packet_id")
def health_determinism(spark, d):
    return health.determinism(view(spark, d, "claim").select(F.col("packet_id").alias("repository"), F.col("status").alias("verification")))


@query(
    "health_surface_rules",
    "WITH s AS (SELECT *, coverage <> 'seen' AS known FROM {surface_record}) SELECT surface AS subject_id, 'surface-weight-range' AS code FROM s WHERE weight < 1 OR weight > 5 UNION ALL SELECT surface, 'surface-state-unknown' FROM s WHERE NOT known"
    " UNION ALL SELECT surface, 'surface-evidence-missing' FROM s WHERE known AND evidence IS NULL UNION ALL SELECT surface, 'core-surface-not-applicable' FROM s WHERE coverage = 'not-applicable' AND surface IN ('runtime-code', 'verification')"
    " UNION ALL SELECT surface, 'surface-reason-missing' FROM s WHERE coverage IN ('not-applicable', 'unavailable') AND reason IS NULL UNION ALL SELECT surface, 'evidence-quality-unknown' FROM s WHERE known AND coverage <> 'not-applicable' AND quality = 'odd'"
    " UNION ALL SELECT surface, 'surface-evidence-weak' FROM s WHERE known AND coverage <> 'not-applicable' AND quality = 'strong' AND evidence = 'note' UNION ALL SELECT surface, 'coverage-evidence-mismatch' FROM s WHERE coverage = 'inspected' AND quality IN ('weak', 'none')",
)
def health_surface_rules(spark, d):
    x = view(spark, d, "surface_record").withColumn("evidence_kinds", F.when(F.col("evidence").isNotNull(), F.array("evidence")))
    return health_rules.surface_findings(x).select("subject_id", "code")


@query(
    "health_command_rules",
    "WITH c AS (SELECT *, result <> 'what' AS known FROM {command_record}) SELECT command_id AS subject_id, 'command-shape' AS code, 'command' AS path FROM c WHERE command IS NULL UNION ALL SELECT command_id, 'command-shape', 'kind' FROM c WHERE kind = 'odd' UNION ALL SELECT command_id, 'command-shape', 'result' FROM c WHERE NOT known"
    " UNION ALL SELECT command_id, 'command-metrics', 'exit_code' FROM c WHERE result = 'skipped' AND (exit_code IS NOT NULL OR elapsed IS NOT NULL) UNION ALL SELECT command_id, 'command-metrics', 'reason' FROM c WHERE result = 'skipped' AND reason IS NULL"
    " UNION ALL SELECT command_id, 'command-metrics', 'exit_code' FROM c WHERE known AND result <> 'skipped' AND exit_code IS NULL UNION ALL SELECT command_id, 'command-metrics', 'elapsed' FROM c WHERE known AND result <> 'skipped' AND elapsed IS NULL"
    " UNION ALL SELECT command_id, 'command-inconsistent', 'result' FROM c WHERE result = 'pass' AND exit_code <> 0 OR result = 'fail' AND exit_code = 0",
)
def health_command_rules(spark, d):
    return health_rules.command_findings(view(spark, d, "command_record")).select("subject_id", "code", "path")


@query(
    "health_dimension_rules",
    "WITH x AS (SELECT s.*, c.lane AS cl, result, lower(trim(coalesce(support, ''))) AS k FROM {support} s LEFT JOIN {health_claim} c ON c.claim_id = s.claim_id), g AS (SELECT * FROM x WHERE cl = lane),"
    " f AS (SELECT lane, claim_id, k, arg_min(dimension, ordinal) AS first FROM g GROUP BY ALL), p AS (SELECT lane, dimension, max(level) AS level, bool_or(result IN ('pass', 'partial')) AS any_good, bool_or(result = 'pass') AS passes, bool_and(result = 'unknown') AS unproved, bool_and(result = 'pass') AS clean FROM g GROUP BY ALL)"
    " SELECT lane, dimension, CASE WHEN cl IS NULL THEN 'dimension-claim-unknown' ELSE 'dimension-claim-foreign' END AS code, claim_id FROM x WHERE cl IS NULL OR cl <> lane UNION ALL SELECT lane, dimension, 'claim-ref-support-missing', claim_id FROM {support} WHERE trim(support) = ''"
    " UNION ALL SELECT DISTINCT g.lane, dimension, 'claim-ref-duplicate-support', g.claim_id FROM g JOIN f ON f.lane = g.lane AND f.claim_id = g.claim_id AND f.k = g.k WHERE dimension <> first"
    " UNION ALL SELECT lane, dimension, 'dimension-incoherent', NULL FROM p WHERE level >= 2 AND NOT any_good OR level >= 4 AND NOT passes OR level > 1 AND unproved OR level <= 1 AND clean",
)
def health_dimension_rules(spark, d):
    return health_rules.dimension_findings(view(spark, d, "support"), view(spark, d, "health_claim"))


@query("health_evidence_links", "SELECT surface, 'claim' AS kind, CAST(weight * 11 AS STRING) AS ref FROM {surface_record} WHERE CAST(weight * 11 AS STRING) NOT IN (SELECT claim_id FROM {health_claim})")
def health_evidence_links(spark, d):
    refs = view(spark, d, "surface_record").select("surface", F.lit("claim").alias("kind"), (F.col("weight") * 11).cast("string").alias("ref"))
    return health_rules.evidence_links(refs, view(spark, d, "health_claim"), view(spark, d, "command_record"))


# Changes between snapshots: of a key's rows the greatest counts


def _snapshots(spark, d, *values):
    keep = lambda n: view(spark, d, n).groupBy("owner", "item").agg(*[F.max(v).alias(v) for v in values])
    return keep("previous"), keep("current")


SNAP = "(SELECT owner, item, max(state) AS state, max(score) AS score FROM {%s} GROUP BY owner, item)"
PREVIOUS, CURRENT = SNAP % "previous", SNAP % "current"


@query(
    "delta_transitions",
    f"SELECT * FROM (SELECT coalesce(c.owner, p.owner) AS owner, coalesce(c.item, p.item) AS item, CASE WHEN p.owner IS NULL THEN 'new' WHEN c.owner IS NULL THEN 'dropped' WHEN p.state <> c.state THEN 'changed' END AS transition, p.state AS previous, c.state AS current"
    f" FROM {PREVIOUS} p FULL JOIN {CURRENT} c ON c.owner = p.owner AND c.item = p.item) WHERE transition IS NOT NULL",
)
def delta_transitions(spark, d):
    return delta.transitions(*_snapshots(spark, d, "state"), ["owner", "item"], "state")


@query("delta_numbers", f"SELECT owner, item, p.score AS previous, c.score AS current, floor((c.score - p.score) * 100 + 0.5) / 100 AS change FROM {PREVIOUS} p JOIN {CURRENT} c USING (owner, item)")
def delta_numbers(spark, d):
    return delta.number_changes(*_snapshots(spark, d, "score"), ["owner", "item"], "score")


@query("delta_states", f"SELECT owner, item, p.state AS previous, c.state AS current FROM {PREVIOUS} p JOIN {CURRENT} c USING (owner, item) WHERE p.state <> c.state")
def delta_states(spark, d):
    return delta.state_changes(*_snapshots(spark, d, "state"), ["owner", "item"], "state")


@query(
    "delta_candidates",
    f"SELECT owner, item, CASE WHEN p.state IS NULL THEN 'new' WHEN c.state IS NOT NULL AND p.state = '0' THEN 'reopened' WHEN c.state IS NOT NULL THEN 'carried' WHEN p.state = '1' THEN 'rejected' ELSE 'missing-from-current-run' END AS transition,"
    f" CASE WHEN c.state IS NULL AND p.state = '2' THEN 'candidate-resolution-missing' WHEN c.state IS NULL AND p.state NOT IN ('1', '2') THEN 'candidate-continuity' END AS problem FROM {PREVIOUS} p FULL JOIN {CURRENT} c USING (owner, item)",
)
def delta_candidates(spark, d):
    p, c = _snapshots(spark, d, "state")
    p = p.selectExpr("owner", "item", "CASE state WHEN '0' THEN 'completed' ELSE 'ready' END AS status", "CASE state WHEN '1' THEN 'rejected' WHEN '2' THEN 'deferred' END AS lifecycle_status", "CASE state WHEN '1' THEN 'why' END AS reason", "CAST(NULL AS STRING) AS completed_at", "0 AS n_refs", "CAST(NULL AS STRING) AS superseded_by")
    return delta.candidate_transitions(p, c, ["owner", "item"])


@query("delta_mismatches", f"SELECT ledger_id, candidate_id, 'priority_stored' AS field, priority_stored::DOUBLE AS stored, {PRIORITY}::DOUBLE AS computed FROM {{candidate}} WHERE priority_stored <> {PRIORITY}")
def delta_mismatches(spark, d):
    return delta.stored_mismatches(ledger.scored(view(spark, d, "candidate")), ["ledger_id", "candidate_id"], {"priority_stored": "priority"})


@query(
    "cache_reuse",
    "SELECT w.id, CASE WHEN c.id IS NULL THEN 'miss' WHEN c.input_fp = w.input_fp AND c.dep_fp = w.dep_fp AND c.env_fp = w.env_fp AND c.rev = w.rev THEN 'exact' WHEN c.input_fp = w.input_fp AND c.dep_fp = w.dep_fp AND c.env_fp = w.env_fp THEN 'content-stable'"
    " WHEN c.env_fp = w.env_fp THEN 'warm-only' ELSE 'miss' END AS reuse FROM {wanted} w LEFT JOIN {cached} c ON c.id = w.id",
)
def cache_reuse(spark, d):
    content = ["input_fp", "dep_fp", "env_fp"]
    return delta.reuse_class(view(spark, d, "cached"), view(spark, d, "wanted"), "id", [*content, "rev"], content, ["env_fp"])


@query("cache_keys", """SELECT id, sha256(concat('{"dep_fp":', dep_fp, ',"input_fp":', input_fp, '}')) AS key FROM {cached}""")
def cache_keys(spark, d):
    return view(spark, d, "cached").select("id", delta.cache_key("input_fp", "dep_fp").alias("key"))


@query("receipt_counters", "WITH r AS (SELECT w.id, c.id IS NOT NULL AS hit FROM {wanted} w LEFT JOIN {cached} c ON c.id = w.id) SELECT hit, count(*) AS n FROM r GROUP BY hit")
def receipt_counters(spark, d):
    x = view(spark, d, "wanted").select("id").join(view(spark, d, "cached").select("id", F.lit(True).alias("hit")), "id", "left")
    return x.groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


# Evidence


@query(
    "evidence_claims",
    r"WITH q AS (SELECT *, list_position(['none', 'weak', 'moderate', 'strong'], quality) AS ql FROM {claim}) SELECT claim_id AS subject_id, 'id-invalid' AS code FROM q WHERE starts_with(claim_id, '-') UNION ALL SELECT claim_id, 'quality-invalid' FROM q WHERE quality = 'odd'"
    " UNION ALL SELECT claim_id, 'confirmed-without-source' FROM q WHERE status = 'confirmed' AND n_sources = 0 UNION ALL SELECT claim_id, 'confirmed-weak' FROM q WHERE status = 'confirmed' AND coalesce(ql, 0) < 3 UNION ALL SELECT claim_id, 'unknown-high' FROM q WHERE status = 'unknown' AND confidence = 'high'",
)
def evidence_claims(spark, d):
    return evidence.claim_findings(view(spark, d, "claim")).select("subject_id", "code")


@query(
    "evidence_absence",
    "WITH q AS (SELECT * FROM {negative} WHERE supports_absence) SELECT claim_id AS subject_id, 'absence-coverage' AS code FROM q WHERE coverage <> 'inspected' UNION ALL SELECT claim_id, 'absence-quality' FROM q WHERE quality IN ('none', 'weak')"
    " UNION ALL SELECT claim_id, 'absence-completeness' FROM q WHERE completeness = 'representative' UNION ALL SELECT claim_id, 'absence-sources' FROM q WHERE n_sources = 0",
)
def evidence_absence(spark, d):
    return evidence.absence_findings(view(spark, d, "negative")).select("subject_id", "code")


HANDOFF = "SELECT packet_id, CASE WHEN ordinal % 2 = 0 THEN 'safe' ELSE 'unresolved' END AS part, claim_id AS ref FROM {claim} WHERE ordinal % 5 = 1 UNION ALL SELECT packet_id, 'safe', claim_id FROM {negative} UNION ALL SELECT packet_id, 'unresolved', concat('z', CAST(ordinal AS STRING)) FROM {claim} WHERE ordinal % 31 = 1"


@query(
    "evidence_handoff",
    f"WITH k AS (SELECT packet_id, claim_id AS ref, 'claim' AS kind, status = 'confirmed' AS settled FROM {{claim}} UNION ALL SELECT packet_id, claim_id, 'negative', supports_absence FROM {{negative}}), x AS (SELECT h.*, kind, settled FROM ({HANDOFF}) h LEFT JOIN k ON k.packet_id = h.packet_id AND k.ref = h.ref)"
    " SELECT * FROM (SELECT packet_id, part, ref, CASE WHEN kind IS NULL THEN concat('handoff-', part, '-ref-unknown') WHEN part = 'safe' AND NOT settled THEN CASE kind WHEN 'claim' THEN 'handoff-safe-not-confirmed' ELSE 'handoff-safe-negative-unsupported' END"
    " WHEN part = 'unresolved' AND settled THEN CASE kind WHEN 'claim' THEN 'handoff-unresolved-confirmed' ELSE 'handoff-unresolved-negative-settled' END END AS code FROM x) WHERE code IS NOT NULL",
)
def evidence_handoff(spark, d):
    c, n = view(spark, d, "claim"), view(spark, d, "negative")
    h = c.where("ordinal % 5 = 1").selectExpr("packet_id", "CASE WHEN ordinal % 2 = 0 THEN 'safe' ELSE 'unresolved' END AS part", "claim_id AS ref").unionByName(n.selectExpr("packet_id", "'safe' AS part", "claim_id AS ref"))
    h = h.unionByName(c.where("ordinal % 31 = 1").selectExpr("packet_id", "'unresolved' AS part", "concat('z', ordinal) AS ref"))
    return evidence.handoff_findings(h, c, n)


@query(
    "evidence_summary",
    "WITH a AS (SELECT packet_id, count(*) AS claims, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'inferred') AS inferred, count(*) FILTER (status = 'unknown') AS unknown FROM {claim} GROUP BY 1),"
    " b AS (SELECT packet_id, count(*) AS negative_claims, count(*) FILTER (supports_absence) AS absence_supported FROM {negative} GROUP BY 1) SELECT packet_id, coalesce(claims, 0) AS claims, coalesce(confirmed, 0) AS confirmed, coalesce(inferred, 0) AS inferred, coalesce(unknown, 0) AS unknown, coalesce(negative_claims, 0) AS negative_claims, coalesce(absence_supported, 0) AS absence_supported FROM a FULL JOIN b USING (packet_id)",
)
def evidence_summary(spark, d):
    return evidence.summary(view(spark, d, "claim"), view(spark, d, "negative"))


@query(
    "evidence_mode",
    "WITH x AS (SELECT id, list_filter([CASE WHEN surfaces >= 3 THEN 'independent-surfaces' END, CASE WHEN cross_source AND source_classes >= 3 THEN 'source-classes' END, CASE WHEN contradiction_risk IN ('high', 'critical') AND source_classes >= 2 THEN 'contradiction-risk' END,"
    " CASE WHEN completeness = 'exhaustive' AND false_negative_cost IN ('high', 'critical') AND surfaces >= 2 THEN 'exhaustive-completeness' END], lambda r: r IS NOT NULL) AS reasons, parallelizable FROM {profile}) SELECT id, coalesce(array_to_string(reasons, ','), '') AS reasons, CASE WHEN len(reasons) > 0 AND parallelizable THEN 'expedition' ELSE 'inline' END AS mode FROM x",
)
def evidence_mode(spark, d):
    return evidence.recommended_mode(view(spark, d, "profile")).select("id", F.array_join("reasons", ",").alias("reasons"), "mode")


LANES = "SELECT packet_id, origin_lane AS lane_id, 'claim' AS kind, claim_id AS id FROM {claim} WHERE origin_lane IS NOT NULL UNION ALL SELECT packet_id, 'a', 'claim', claim_id FROM {claim} WHERE ordinal % 61 = 1 AND origin_lane = 'b'"


def _lanes(spark, d):
    c = view(spark, d, "claim").where("origin_lane IS NOT NULL")
    return c.selectExpr("packet_id", "origin_lane AS lane_id", "'claim' AS kind", "claim_id AS id").unionByName(c.where("ordinal % 61 = 1 AND origin_lane = 'b'").selectExpr("packet_id", "'a' AS lane_id", "'claim' AS kind", "claim_id AS id"))


@query("evidence_collisions", f"SELECT packet_id, id, count(*) AS n FROM ({LANES}) GROUP BY packet_id, id HAVING count(*) > 1")
def evidence_collisions(spark, d):
    return evidence.collisions(_lanes(spark, d))


@query(
    "evidence_merge",
    f"WITH l AS ({LANES}), bad AS (SELECT DISTINCT packet_id FROM l GROUP BY packet_id, id HAVING count(*) > 1), few AS (SELECT packet_id FROM l GROUP BY packet_id HAVING count(DISTINCT lane_id) < 2) SELECT packet_id, lane_id AS origin_lane, kind, id FROM l WHERE packet_id % 3 <> 0 AND packet_id NOT IN (FROM bad) AND packet_id NOT IN (FROM few)",
)
def evidence_merge(spark, d):
    lanes = _lanes(spark, d)
    parents = lanes.select("packet_id").distinct().withColumn("mode", F.when(F.col("packet_id") % 3 == 0, "inline").otherwise("expedition"))
    return evidence.merged_lanes(lanes, parents)[0].select("packet_id", "origin_lane", "kind", "id")


@query(
    "evidence_projection",
    "WITH x AS (SELECT claim_id, status, n_sources, CASE WHEN quality IN ('none', 'weak', 'moderate', 'strong') THEN quality END AS q, n_sources > 1 AS direct FROM {claim}), y AS (SELECT *, CASE WHEN q IS NOT NULL THEN CASE WHEN status = 'confirmed' AND direct THEN 'strong' WHEN status = 'confirmed' AND q IN ('weak', 'none') AND n_sources > 0 THEN 'moderate'"
    " WHEN status IN ('inferred', 'unknown') AND n_sources > 0 THEN 'moderate' ELSE q END WHEN n_sources = 0 THEN 'none' WHEN status = 'inferred' THEN 'moderate' WHEN direct THEN 'strong' ELSE 'moderate' END AS quality FROM x)"
    " SELECT claim_id, quality, CASE WHEN n_sources = 0 THEN 'uninspected' WHEN direct THEN 'inspected' ELSE 'sampled' END AS coverage, CASE status WHEN 'unknown' THEN CASE quality WHEN 'none' THEN 'none' ELSE 'low' END WHEN 'inferred' THEN CASE quality WHEN 'none' THEN 'low' ELSE 'medium' END ELSE CASE quality WHEN 'strong' THEN 'high' ELSE 'medium' END END AS confidence FROM y",
)
def evidence_projection(spark, d):
    own = F.when(F.col("quality").isin(*evidence.QUALITIES), F.col("quality"))
    direct = F.col("n_sources") > 1
    x = view(spark, d, "claim").withColumn("q", evidence.projected_quality(F.col("status"), own, F.col("n_sources"), direct))
    return x.select("claim_id", F.col("q").alias("quality"), evidence.projected_coverage(F.lit(None).cast("string"), F.col("n_sources"), direct).alias("coverage"), evidence.projected_confidence(F.col("status"), F.col("q")).alias("confidence"))


@query("evidence_negatives", r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(no|none|without|absent|missing|unused|never)\b|\bdoes not exist\b|\bdo not exist\b|\bno recorded\b|\bno automated\b') AS negative FROM documents")
def evidence_negatives(spark, d):
    return table(spark, d, "documents").select("doc_id", evidence.is_negative(F.coalesce("text", F.lit(""))).alias("negative"))


# Graphs


def _graph(spark, d):
    nodes = view(spark, d, "task").withColumnRenamed("grp", "group")
    edges = view(spark, d, "task_edge").withColumnRenamed("grp", "group")
    return nodes, edges


@query(
    "graph_critical_paths",
    "WITH RECURSIVE p AS (SELECT grp, node, cost AS total, node AS start FROM {task} UNION ALL SELECT e.grp, e.node, p.total + t.cost, p.start FROM p JOIN {task_edge} e ON e.grp = p.grp AND e.needs = p.node JOIN {task} t ON t.grp = e.grp AND t.node = e.node) SELECT grp, start AS node, max(total) AS critical FROM p GROUP BY grp, start",
)
def graph_critical_paths(spark, d):
    return graph.critical_paths(*_graph(spark, d)).withColumnRenamed("group", "grp")


@query(
    "graph_waves",
    "WITH RECURSIVE p AS (SELECT grp, node, CAST(0 AS BIGINT) AS level FROM {task} UNION ALL SELECT e.grp, e.node, p.level + 1 FROM p JOIN {task_edge} e ON e.grp = p.grp AND e.needs = p.node) SELECT grp, node, max(level) AS level FROM p GROUP BY grp, node",
)
def graph_waves(spark, d):
    return graph.levels(*_graph(spark, d)).withColumnRenamed("group", "grp")


@query(
    "graph_blocked",
    "WITH RECURSIVE r AS (SELECT DISTINCT e.grp, e.node FROM {task_edge} e JOIN {task} t ON t.grp = e.grp AND t.node = e.needs WHERE t.cost < 5 UNION SELECT e.grp, e.node FROM r JOIN {task_edge} e ON e.grp = r.grp AND e.needs = r.node), f AS (SELECT grp, node FROM {task} WHERE cost < 5) SELECT DISTINCT grp, node FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.grp = r.grp AND f.node = r.node)",
)
def graph_blocked(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.blocked_by(edges, nodes.where("cost < 5")).withColumnRenamed("group", "grp")


@query(
    "graph_ready",
    "WITH done AS (SELECT grp, node FROM {task} WHERE cost > 20) SELECT grp, node FROM {task} t WHERE cost <= 20 AND NOT EXISTS (SELECT 1 FROM {task_edge} e WHERE e.grp = t.grp AND e.node = t.node AND NOT EXISTS (SELECT 1 FROM done WHERE done.grp = e.grp AND done.node = e.needs))",
)
def graph_ready(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.ready(nodes, edges, nodes.where("cost > 20")).withColumnRenamed("group", "grp")


@query("graph_flowchart", """SELECT t.grp, concat('flowchart TD', chr(10), string_agg(concat('n', t.node, '["', 'task ', t.node, '"]'), chr(10) ORDER BY t.node), coalesce((SELECT chr(10) || string_agg(concat('n', e.node, ' --> n', e.needs), chr(10) ORDER BY e.node, e.needs) FROM {task_edge} e WHERE e.grp = t.grp AND EXISTS (SELECT 1 FROM {task} z WHERE z.grp = e.grp AND z.node = e.needs)), '')) AS text FROM {task} t GROUP BY t.grp""")
def graph_flowchart(spark, d):
    nodes, edges = _graph(spark, d)
    nodes = nodes.select("group", F.col("node").alias("position"), F.concat(F.lit("task "), "node").alias("label"))
    edges = edges.select("group", F.col("node").alias("source"), F.col("needs").alias("target"))
    return graph.flowchart(nodes, edges).withColumnRenamed("group", "grp")


# Trackers


@query("tracker_frontier", "SELECT tracker, id, title FROM {ticket} t WHERE state = 'open' AND claimed_by IS NULL AND NOT EXISTS (SELECT 1 FROM {block} b LEFT JOIN {ticket} c ON c.tracker = b.tracker AND c.id = b.blocker AND c.state = 'closed' WHERE b.tracker = t.tracker AND b.id = t.id AND c.id IS NULL)")
def tracker_frontier(spark, d):
    return tracker.frontier(view(spark, d, "ticket"), view(spark, d, "block"))


@query("tracker_holders", "SELECT tracker, claimed_by, count(*) AS claims FROM {ticket} WHERE state = 'open' AND claimed_by IS NOT NULL GROUP BY tracker, claimed_by")
def tracker_holders(spark, d):
    return tracker.holders(view(spark, d, "ticket"))


@query(
    "tracker_findings",
    "SELECT CAST(id AS STRING) AS subject_id, 'state-invalid' AS code FROM {ticket} WHERE state = 'stuck' UNION ALL SELECT CAST(id AS STRING), 'type-invalid' FROM {ticket} WHERE type = 'odd' UNION ALL SELECT CAST(id AS STRING), 'closed-without-resolution' FROM {ticket} WHERE state = 'closed' AND NOT has_resolution UNION ALL SELECT CAST(id AS STRING), 'open-with-resolution' FROM {ticket} WHERE state = 'open' AND has_resolution",
)
def tracker_findings(spark, d):
    return tracker.ticket_findings(view(spark, d, "ticket")).select("subject_id", "code")


@query("tracker_missing_blockers", "SELECT tracker, id, blocker FROM {block} b WHERE NOT EXISTS (SELECT 1 FROM {ticket} t WHERE t.tracker = b.tracker AND t.id = b.blocker)")
def tracker_missing_blockers(spark, d):
    return tracker.missing_blockers(view(spark, d, "ticket"), view(spark, d, "block"))


@query(
    "tracker_index",
    "SELECT * FROM (SELECT tracker, id, CASE WHEN t.state IS NULL THEN 'link-missing' WHEN t.state = 'closed' AND l.linked IS NULL THEN 'closed-not-indexed' WHEN t.state = 'open' AND l.linked THEN 'open-indexed' END AS code FROM {ticket} t FULL JOIN (SELECT DISTINCT tracker, id, true AS linked FROM {link}) l USING (tracker, id)) WHERE code IS NOT NULL",
)
def tracker_index(spark, d):
    return tracker.index_findings(view(spark, d, "ticket"), view(spark, d, "link"))


# Scores and receipts


@query("score_weighted", "SELECT id, floor((interview * 0.25::DOUBLE + adaptation * 0.15::DOUBLE + swarm * 0.15::DOUBLE + map * 0.20::DOUBLE + evolution * 0.10::DOUBLE + integration * 0.10::DOUBLE + boundaries * 0.05::DOUBLE) * 1000 + 0.5) / 1000 AS weighted FROM {evaluation}")
def score_weighted(spark, d):
    return view(spark, d, "evaluation").select("id", scores.weighted().alias("weighted"))


@query("score_latest", "SELECT r.benchmark, r.run, s.file, s.score FROM (SELECT benchmark, max(run) AS run FROM {run} GROUP BY benchmark) r LEFT JOIN (SELECT benchmark, max(file) AS file, arg_max(score, file) AS score FROM {run} WHERE score % 3 = 0 GROUP BY benchmark) s ON s.benchmark = r.benchmark")
def score_latest(spark, d):
    runs = view(spark, d, "run")
    return scores.with_scores(runs, runs.where("score % 3 = 0"), "benchmark")


@query("receipt_merge", "SELECT stage, max(planned) AS planned, max(peak) AS peak, sum(wall_ms)::BIGINT AS wall_ms, sum(serial_ms)::BIGINT AS serial_ms, floor(sum(serial_ms) / sum(wall_ms) * 1000 + 0.5) / 1000 AS speedup FROM {receipt} GROUP BY stage")
def receipt_merge(spark, d):
    return scores.merged_receipts(view(spark, d, "receipt"), "stage")


@query("resource_use", "SELECT resource, coalesce(sum(permits) FILTER (mode = 'shared'), 0)::BIGINT AS permits, bool_or(mode = 'exclusive') AS exclusive FROM {hold} GROUP BY resource")
def resource_use(spark, d):
    return scores.resource_use(view(spark, d, "hold"))


@query("pool_statistics", "SELECT repository, max(e) - min(s) AS wall_ms, sum(e - s)::BIGINT AS serial_ms, bool_and(ok) AS succeeded FROM (SELECT user_id % 25 AS repository, event_id AS s, event_id + user_id AS e, event_type <> 'error' OR user_id % 25 > 12 AS ok FROM events) GROUP BY repository")
def pool_statistics(spark, d):
    x = table(spark, d, "events").selectExpr("user_id % 25 AS repository", "event_id AS started", "event_id + user_id AS ended", "CASE WHEN event_type <> 'error' OR user_id % 25 > 12 THEN 'succeeded' ELSE 'failed' END AS status")
    return scores.pool_statistics(x, "repository")


# Texts


LINE_SQL = "(SELECT doc_id, i AS line, l[i] AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"


@query(
    "lint_prompt",
    r"WITH l AS " + LINE_SQL + r", f AS (SELECT doc_id, min(line) FILTER (regexp_matches(content, '(?i)\b(?:password|passwd|pwd)\s*[:=]\s*\S{4,}')) AS a, min(line) FILTER (regexp_matches(content, '(?i)\b(?:api[_-]?key|secret|token)\s*[:=]\s*[''\x22]?[A-Za-z0-9_\-]{16,}')) AS b,"
    r" min(line) FILTER (regexp_matches(content, '(?i)\bAKIA[0-9A-Z]{16}\b')) AS c, min(line) FILTER (regexp_matches(content, '(?i)\bsk-[A-Za-z0-9_-]{8,}')) AS e FROM l GROUP BY doc_id) SELECT doc_id, 'CRED' AS rule, unnest(list_filter([a, b, c, e], lambda x: x IS NOT NULL)) AS line FROM f",
)
def lint_prompt(spark, d):
    return lint.prompt_findings(table(spark, d, "documents"), rules=["CRED"]).select("doc_id", "rule", "line")


@query("lint_contract", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '" + lint.CONTRACT + "')")
def lint_contract(spark, d):
    return lint.prompt_findings(table(spark, d, "documents"), rules=["FORMAT"]).select("doc_id")


@query("lint_all")
def lint_all(spark, d):
    return lint.prompt_findings(table(spark, d, "documents"))


@query(
    "lint_repeated_lines",
    r"WITH l AS (SELECT doc_id, line, lower(regexp_replace(content, '^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g')) AS key FROM " + LINE_SQL + "), m AS (SELECT *, min(line) OVER (PARTITION BY doc_id, key) AS first FROM l WHERE length(key) >= 40) SELECT doc_id, line, first FROM m WHERE line > first",
)
def lint_repeated_lines(spark, d):
    return lint.repeated_lines(table(spark, d, "documents"))


@query("lint_line_budget", "SELECT doc_id, n AS n_lines, CASE WHEN n > 400 THEN 'error' ELSE 'warning' END AS severity FROM (SELECT doc_id, count(*) AS n FROM " + LINE_SQL + " GROUP BY doc_id) WHERE n > 250")
def lint_line_budget(spark, d):
    return lint.line_budget(table(spark, d, "documents"))


@query("lint_handoff_lines")
def lint_handoff_lines(spark, d):
    return lint.line_findings(table(spark, d, "documents"))


@query("questions", r"SELECT doc_id, q.i - 1 AS place, trim(r[q.i]) AS question FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?m)^\s*>?\s*\d+\.\s+(.+?\?)\s*$', 1) AS r FROM documents), unnest(range(1, len(r) + 1)) AS q(i)")
def questions(spark, d):
    return lint.questions(table(spark, d, "documents"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in scalars.STOP_WORDS) + "]"


@query(
    "similar_titles",
    "WITH t AS (SELECT grp, k, list_distinct(list_filter(string_split(regexp_replace(lower(txt), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains(" + STOP_SQL + ", w))) AS s FROM (SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS grp, p_partkey AS k, concat(p_name, ' ', p_brand, ' ', p_type) AS txt FROM part)),"
    " p AS (SELECT a.grp, a.k AS a, b.k AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb FROM t a JOIN t b ON a.grp = b.grp AND a.k < b.k), q AS (SELECT *, greatest(i / (na + nb - i), i / least(na, nb)) AS v FROM p WHERE i > 0) SELECT grp, a, b, round(v, 6) AS similarity FROM q WHERE v >= 0.6",
)
def similar_titles(spark, d):
    x = table(spark, d, "part").selectExpr("CAST(floor(p_partkey / 100) AS BIGINT) AS grp", "p_partkey AS k", "concat(p_name, ' ', p_brand, ' ', p_type) AS txt")
    return similar.similar_pairs(x, "grp", "k", "txt")


@query("text_checks", "SELECT doc_id, check_id, len(bad) = 0 AS ok, coalesce(array_to_string(bad, ','), '') AS evidence FROM (SELECT doc_id, 1 AS check_id, list_sort(list_concat(list_filter(['the', 'and'], lambda w: NOT contains(lower(coalesce(text, '')), w)), list_filter(['token'], lambda w: contains(lower(coalesce(text, '')), w)))) AS bad FROM documents)")
def text_checks(spark, d):
    return lint.text_checks(table(spark, d, "documents"), [(1, ["the", "and"], ["token"])])


# State over time


@query("usage_latest", "SELECT session, max(pos) AS pos, arg_max(input_tokens + coalesce(cache_read, 0) + cache_creation, pos) AS tokens FROM {usage} WHERE kind = 'assistant' AND NOT sidechain AND input_tokens IS NOT NULL GROUP BY session")
def usage_latest(spark, d):
    u = view(spark, d, "usage")
    entry = F.to_json(F.struct(F.col("kind").alias("type"), F.col("sidechain").alias("isSidechain"), F.struct(F.struct(F.col("input_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_creation").alias("cache_creation_input_tokens")).alias("usage")).alias("message")))
    return readers.last_usage(u.select("session", "pos", F.parse_json(entry).alias("entry")), "session", "pos")


@query(
    "usage_nudges",
    """WITH RECURSIVE u AS (
        SELECT user_id AS session, CAST(ts AS TIMESTAMP) AS "at", CAST(event_id * 20 AS BIGINT) AS tokens, coalesce(event_type = 'error', false) AS silent,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
        FROM events
    ), walk AS (
        SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS last, CAST(NULL AS TIMESTAMP) AS "at", false AS fired FROM u
        UNION ALL
        SELECT session, n, CASE WHEN fires THEN tokens ELSE last END, "at", fires
        FROM (
            SELECT u.session, u.n, u."at", u.tokens, w.last, u.tokens >= 120000 AND NOT u.silent AND (w.last = 0 OR u.tokens >= w.last + 30000) AS fires
            FROM walk w JOIN u ON u.session IS NOT DISTINCT FROM w.session AND u.n = w.n + 1
        )
    ) SELECT session, "at", last AS tokens FROM walk WHERE fired""",
)
def usage_nudges(spark, d):
    x = table(spark, d, "events").selectExpr("user_id AS session", "CAST(ts AS TIMESTAMP) AS at", "CAST(event_id * 20 AS BIGINT) AS tokens", "CASE WHEN event_type = 'error' THEN CAST(ts AS TIMESTAMP) END AS handoff_at")
    return sessions.nudges(x)


@query(
    "lease_outcomes",
    """WITH RECURSIVE e AS (
        SELECT *, row_number() OVER (PARTITION BY assignment ORDER BY at_ms, action) AS n
        FROM (
            SELECT user_id AS assignment, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS at_ms, 'w' || (event_id % 3) AS worker, event_id % 4 AS told,
                CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'claim' ELSE 'completed' END AS action
            FROM events
        )
    ), walk AS (
        SELECT DISTINCT assignment, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_ms, '' AS action, '' AS worker, '' AS outcome, CAST(0 AS BIGINT) AS generation,
            'none' AS status, CAST(0 AS BIGINT) AS expires
        FROM e
        UNION ALL
        SELECT assignment, n, at_ms, action, worker, outcome, CASE WHEN outcome = 'CLAIMED' THEN generation + 1 ELSE generation END,
            CASE WHEN outcome = 'CLAIMED' THEN 'active' WHEN outcome = 'OK' AND action <> 'heartbeat' THEN action ELSE status END,
            CASE WHEN outcome = 'CLAIMED' OR (outcome = 'OK' AND action = 'heartbeat') THEN at_ms + 120000 WHEN outcome = 'OK' THEN at_ms ELSE expires END
        FROM (
            SELECT e.assignment, e.n, e.at_ms, e.action, e.worker, w.generation, w.status, w.expires,
                CASE
                    WHEN e.action = 'claim' AND w.status = 'active' AND w.expires > e.at_ms THEN 'LEASE_LIVE'
                    WHEN e.action = 'claim' THEN 'CLAIMED'
                    WHEN w.status <> 'active' OR e.told IS DISTINCT FROM w.generation THEN 'STALE_FENCE'
                    ELSE 'OK'
                END AS outcome
            FROM walk w JOIN e ON e.assignment IS NOT DISTINCT FROM w.assignment AND e.n = w.n + 1
        )
    ) SELECT assignment, at_ms, action, worker, outcome, generation FROM walk WHERE n > 0""",
)
def lease_outcomes(spark, d):
    action = "CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'claim' ELSE 'completed' END"
    x = table(spark, d, "events").selectExpr("user_id AS assignment", "unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms", f"{action} AS action", "concat('w', event_id % 3) AS worker", "event_id % 4 AS generation")
    return sessions.leases(x)


def _lease_events(x):
    action = "CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'recover' ELSE 'completed' END"
    return x.selectExpr("user_id AS assignment", "unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms", f"{action} AS action", "concat('w', event_id % 3) AS worker", "(event_id + user_id) % 2 + 1 AS generation")


#: Milliseconds without a heartbeat after which a lease lapses in these queries: events of a user are hours apart.
TTL_MS = 6 * 3_600_000
_WATCHED = f"""WITH RECURSIVE e AS (
        SELECT *, row_number() OVER (PARTITION BY assignment ORDER BY at_ms, action, worker, told) AS n
        FROM (
            SELECT user_id AS assignment, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS at_ms, 'w' || (event_id % 3) AS worker, (event_id + user_id) % 2 + 1 AS told,
                CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'recover' ELSE 'completed' END AS action
            FROM events
        )
    ), walk AS (
        SELECT DISTINCT assignment, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_ms, '' AS action, '' AS worker, '' AS outcome, CAST(0 AS BIGINT) AS generation,
            'none' AS status, CAST(0 AS BIGINT) AS expires, '' AS holder, false AS lapses, CAST(0 AS BIGINT) AS old_expires, '' AS old_holder, CAST(0 AS BIGINT) AS old_generation
        FROM e
        UNION ALL
        SELECT assignment, n, at_ms, action, worker, outcome, CASE WHEN outcome = 'CLAIMED' THEN generation + 1 ELSE generation END,
            CASE WHEN outcome = 'CLAIMED' THEN 'active' WHEN outcome = 'OK' AND action <> 'heartbeat' THEN action ELSE status END,
            CASE WHEN outcome = 'CLAIMED' OR action = 'heartbeat' AND outcome = 'OK' THEN at_ms + {TTL_MS} WHEN outcome = 'OK' THEN at_ms ELSE expires END,
            CASE WHEN outcome = 'CLAIMED' THEN worker ELSE holder END, lapses, expires, holder, generation
        FROM (
            SELECT *, CASE WHEN action IN ('claim', 'recover') THEN CASE WHEN status = 'active' THEN 'LEASE_LIVE' ELSE 'CLAIMED' END
                WHEN status <> 'active' OR told IS DISTINCT FROM generation THEN 'STALE_FENCE' ELSE 'OK' END AS outcome
            FROM (
                SELECT e.assignment, e.n, e.at_ms, e.action, e.worker, e.told, w.generation, w.expires, w.holder,
                    w.status = 'active' AND w.expires <= e.at_ms AS lapses, CASE WHEN w.status = 'active' AND w.expires <= e.at_ms THEN 'stale' ELSE w.status END AS status
                FROM walk w JOIN e ON e.assignment IS NOT DISTINCT FROM w.assignment AND e.n = w.n + 1
            )
        )
    )
    SELECT assignment, at_ms, action, worker, outcome, generation FROM walk WHERE n > 0
    UNION ALL SELECT assignment, old_expires, 'lapse', old_holder, 'STALE', old_generation FROM walk WHERE lapses
    UNION ALL SELECT assignment, expires, 'lapse', holder, 'STALE', generation
    FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY assignment ORDER BY n DESC) = 1), (SELECT max(at_ms) - {{DELAY}} AS until FROM e) WHERE status = 'active' AND expires <= until"""


@query("lease_watch", _WATCHED.replace("{DELAY}", "0"))
def lease_watch(spark, d):
    return sessions.watched_leases(_lease_events(table(spark, d, "events")), ttl=TTL_MS)


@query("lease_timers", _WATCHED.replace("{DELAY}", "600000"))
def lease_timers(spark, d):
    """The same as a stream over the table, where timers end leases as the watermark passes."""
    source = table(spark, d, "events")
    return sessions.streamed(sessions.lease_stream(_lease_events(spark.readStream.schema(source.schema).parquet(f"{d}/event[s].parquet")), TTL_MS, watch=True))


# Sources


@query(
    "source_tail_usage",
    """WITH e AS (SELECT user_id, event_id, event_type FROM events),
    told AS (SELECT user_id, event_id FROM e WHERE event_type NOT IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT coalesce(u.user_id, -1) AS session, t.event_id * 20 + coalesce(u.user_id, -1) % 7 AS tokens
    FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN told t ON t.user_id IS NOT DISTINCT FROM u.user_id""",
)
def source_tail_usage(spark, d):
    """Each user's events as a file of JSON lines, of which the source reads the end."""
    line = """to_json(named_struct('type', CASE event_type WHEN 'signup' THEN 'user' ELSE 'assistant' END, 'isSidechain', event_type = 'error',
        'message', named_struct('usage', named_struct('input_tokens', event_id * 20, 'cache_read_input_tokens', session % 7))))"""
    x = table(spark, d, "events").selectExpr("coalesce(user_id, -1) AS session", "event_id", "event_type").selectExpr("session", "event_id", f"{line} AS value")
    folder = f"{shared_folder(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    # files lie in as many folders as there are tasks, which the driver lists, not the files
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = x.repartition(n, "session").sortWithinPartitions("session", "event_id")
    files.write_files(x.selectExpr(f"concat('tasks/', pmod(hash(session), {n}), '/session=', session, '.jsonl') AS path", "value"), folder)
    session = F.regexp_extract("path", r"/session=(-?[0-9]+)\.jsonl$", 1).cast("long")
    return files.last_usages(spark, f"{folder}/tasks/*/").select(session.alias("session"), "tokens")


@query(
    "source_file_states",
    """SELECT 'segment=' || c_mktsegment AS folder, 'file' AS state, strlen(t) AS bytes, sha256(t) AS sha256
    FROM (SELECT c_mktsegment, string_agg(c_custkey || ' ' || c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY c_mktsegment)
    UNION ALL SELECT DISTINCT 'region=' || r_name, 'missing', NULL::BIGINT, NULL FROM region""",
)
def source_file_states(spark, d):
    """The customers of each segment as a file, and folders that nobody wrote: what is there and what is missing."""
    folder = f"{shared_folder(spark).rstrip('/')}/segments-{uuid.uuid4().hex}"
    x = table(spark, d, "customer").selectExpr("c_mktsegment AS segment", "c_custkey", "concat(c_custkey, ' ', c_name) AS value")
    x.repartition("segment").sortWithinPartitions("segment", "c_custkey").drop("c_custkey").write.partitionBy("segment").text(folder)
    asked = [".", *(f"region={r.r_name}" for r in table(spark, d, "region").select("r_name").distinct().collect())]  # a handful of regions
    states = files.file_states(spark, folder, asked).where("state = 'missing' OR path LIKE '%/part-%.txt'")
    return states.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), "state", "bytes", "sha256")


@query("source_text_fingerprints", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents")
def source_text_fingerprints(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))


@query("source_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(concat('--', p_name, ' / ', p_type, '!')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def source_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.slug(F.concat(F.lit("--"), "p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("finding_duplicates", "SELECT concat_ws('/', l_orderkey % 100, l_partkey) AS subject_id, CAST(count(*) AS STRING) AS n FROM lineitem GROUP BY l_orderkey % 100, l_partkey HAVING count(*) > 1")
def finding_duplicates(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("a"), F.col("l_partkey").alias("b"))
    return findings.duplicates(x, ["a", "b"], "dup-id", "line").select("subject_id", F.col("path").alias("n"))


@query("finding_severities", f"SELECT e AS errors, 0::BIGINT AS warnings, CASE WHEN e > 0 THEN 2 ELSE 0 END::BIGINT AS exit_code FROM (SELECT count(*) FILTER (status_stored = 'done') + count(*) FILTER (priority_stored <> {PRIORITY}) AS e FROM {{candidate}})")
def finding_severities(spark, d):
    return findings.severity_counts(ledger.shape_findings(view(spark, d, "candidate")))


from assaykit import trace_queries  # noqa: E402, F401  registers its queries here
