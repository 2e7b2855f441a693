"""Candidate ledgers: scores, ranks, gates and the queue of what can be worked on.

A candidate row has ledger_id, candidate_id, title, eight scores, effort, action, blocked_by (open blockers: boolean),
status_stored and ordinal; an edge row has ledger_id, candidate_id, depends_on. All windows are inside one ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalars import choice, clamped, has_text
from assaykit.operators.findings import Rule, run_rules

#: Scores that add to the priority, and those that subtract (fixed values).
VALUE = ("severity", "confidence", "leverage", "locality", "testability")
RISK = ("blast_radius", "regression_risk", "human_decision_risk")
#: The range of a priority; effort and its rank; stored statuses; bands with their floors, high to low (fixed values).
LOW, HIGH = -10, 22
EFFORTS = {"S": 0, "M": 1, "L": 2}
STATUSES = ("ready", "blocked", "needs-human-decision", "rejected", "completed")
BANDS = (("strong", 13), ("worth", 6), ("speculative", LOW))
#: Lifecycle states, and those that end a candidate without completing it (fixed values).
LIFECYCLE = ("discovered", "awaiting-selection", "designing", "ready", "active", "verifying", "completed", "blocked", "rejected", "deferred", "superseded", "out-of-scope")
CLOSED_WITH_REASON = ("rejected", "deferred", "out-of-scope")


def priority() -> Column:
    total = F.lit(0)
    for s in VALUE:
        total = total + F.col(s)
    for s in RISK:
        total = total - F.col(s)
    return total


def fill_percent(p: Column) -> Column:
    return clamped((p - LOW) * 100.0 / (HIGH - LOW), 0.0, 100.0)


def band(p: Column, bands: Sequence[tuple[str, int]] = BANDS) -> Column:
    """The first band whose floor is reached; the last one otherwise."""
    out = F.lit(bands[-1][0])
    for name, floor in reversed(bands):
        out = F.when(p >= floor, F.lit(name)).otherwise(out)
    return out


def band_stops(bands: Sequence[tuple[str, int]] = BANDS) -> list[float]:
    """Percents of the axis where bands meet: the lowest meets the next one below its floor, others at their floors."""
    floors = sorted(floor for _, floor in bands)
    at = [floors[1] - 1, *floors[2:]] if len(floors) > 1 else []
    return [max(0.0, min(100.0, (f - LOW) * 100.0 / (HIGH - LOW))) for f in at]


def scored(candidates: DataFrame) -> DataFrame:
    p = F.col("priority")
    return (
        candidates.withColumn("priority", priority())
        .withColumn("fill_percent", fill_percent(p))
        .withColumn("band", band(p))
        .withColumn("effort_rank", choice(F.col("effort"), EFFORTS, EFFORTS["M"]))
        .withColumn("judgment_heavy", F.col("human_decision_risk") >= 4)
    )


def ranked(candidates: DataFrame) -> DataFrame:
    """With rank 1..N in each ledger: priority, then cheap before dear, severity, confidence, id; input order last."""
    order = Window.partitionBy("ledger_id").orderBy(F.desc("priority"), "effort_rank", F.desc("severity"), F.desc("confidence"), "candidate_id", "ordinal")
    return scored(candidates).withColumn("rank", F.row_number().over(order).cast("long"))


def last_of_id(candidates: DataFrame) -> DataFrame:
    """Of rows with one id the last in input order, which is the one that references meet."""
    last = Window.partitionBy("ledger_id", "candidate_id").orderBy(F.desc("ordinal"))
    return candidates.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def unresolved(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """ledger_id, candidate_id, unresolved (sorted ids): dependencies that are absent or not completed; self edges not."""
    known = last_of_id(candidates).select("ledger_id", F.col("candidate_id").alias("depends_on"), "status_stored")
    open_edges = (
        edges.where("candidate_id <> depends_on")
        .join(known, ["ledger_id", "depends_on"], "left")
        .where(~F.col("status_stored").eqNullSafe("completed"))
    )
    return open_edges.groupBy("ledger_id", "candidate_id").agg(F.array_sort(F.collect_set("depends_on")).alias("unresolved"))


def gated(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked candidates with unresolved, status_derived, status and eligible.

    A stored status wins where it is valid; eligible needs both it and the derived one to be ready.
    """
    x = ranked(candidates).join(unresolved(candidates, edges), ["ledger_id", "candidate_id"], "left")
    waiting = F.coalesce(F.size("unresolved"), F.lit(0)) > 0
    derived = (
        F.when(F.col("action").eqNullSafe("reject"), "rejected")
        .when(F.col("judgment_heavy") | F.coalesce("blocked_by", F.lit(False)), "needs-human-decision")
        .when(waiting, "blocked")
        .otherwise("ready")
    )
    valid = F.col("status_stored").isin(*STATUSES)
    stored = F.when(valid, F.col("status_stored"))
    x = x.withColumn("status_derived", derived).withColumn("status", F.coalesce(stored, F.col("status_derived")))
    fine = F.col("status_stored").isNull() | valid
    return x.withColumn("eligible", fine & (F.col("status") == "ready") & (F.col("status_derived") == "ready"))


def counts(gated_candidates: DataFrame, *keys: str) -> DataFrame:
    """keys, band, action, n, n_blocked: how many candidates there are and how many of them wait for others."""
    waits = F.coalesce(F.size("unresolved"), F.lit(0)) > 0
    return gated_candidates.groupBy(*keys, "band", "action").agg(F.count(F.lit(1)).alias("n"), F.count_if(waits).alias("n_blocked"))


def queue(gated_candidates: DataFrame, human_order: DataFrame | None = None) -> DataFrame:
    """ledger_id, position, candidate_id of eligible candidates: those of human_order (ledger_id, candidate_id, place)
    first, by their first place, the others by rank."""
    x = gated_candidates.where("eligible").select("ledger_id", "candidate_id", "rank")
    place = F.lit(None).cast("long")
    if human_order is not None:
        x = x.join(human_order.groupBy("ledger_id", "candidate_id").agg(F.min("place").alias("_place")), ["ledger_id", "candidate_id"], "left")
        place = F.col("_place")
    order = Window.partitionBy("ledger_id").orderBy(place.asc_nulls_last(), "rank")
    return x.withColumn("position", F.row_number().over(order).cast("long")).select("ledger_id", "position", "candidate_id")


def skipped_orders(gated_candidates: DataFrame, human_order: DataFrame) -> DataFrame:
    """Entries of human_order that can't be followed: ledger_id, candidate_id, reason (ineligible or unknown)."""
    known = gated_candidates.groupBy("ledger_id", "candidate_id").agg(F.bool_or("eligible").alias("eligible"))
    x = human_order.select("ledger_id", "candidate_id").distinct().join(known, ["ledger_id", "candidate_id"], "left")
    return x.where("eligible IS NULL OR NOT eligible").select("ledger_id", "candidate_id", F.when(F.col("eligible").isNull(), "unknown").otherwise("ineligible").alias("reason"))


def reference_findings(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """ledger_id, candidate_id, code (dep-self, dep-unknown), ref."""
    known = candidates.select("ledger_id", F.col("candidate_id").alias("depends_on")).distinct()
    itself = edges.where("candidate_id = depends_on").select("ledger_id", "candidate_id", F.lit("dep-self").alias("code"), F.col("depends_on").alias("ref"))
    unknown = edges.where("candidate_id <> depends_on").join(known, ["ledger_id", "depends_on"], "left_anti")
    return itself.unionByName(unknown.select("ledger_id", "candidate_id", F.lit("dep-unknown").alias("code"), F.col("depends_on").alias("ref")))


def shape_findings(candidates: DataFrame) -> DataFrame:
    """Missing id or title, scores outside 1..5, unknown effort or status, a stored priority that doesn't hold."""
    out_of_range = [Rule("score-range", F.coalesce((F.col(s) < 1) | (F.col(s) > 5) | (F.col(s) % 1 != 0), F.lit(True)), s) for s in (*VALUE, *RISK)]
    rules = [
        Rule("missing-field", ~has_text(F.col("candidate_id")), "candidate_id"),
        Rule("missing-field", ~has_text(F.col("title")), "title"),
        *out_of_range,
        Rule("effort-range", F.col("effort").isNotNull() & ~F.col("effort").isin(*EFFORTS), "effort"),
        Rule("status-invalid", F.col("status_stored").isNotNull() & ~F.col("status_stored").isin(*STATUSES), "status"),
    ]
    if "priority_stored" in candidates.columns:
        rules.append(Rule("priority-mismatch", F.col("priority_stored") != priority(), "priority_score"))
    return run_rules(candidates, "candidate", "candidate_id", rules)


def lifecycle_findings(lifecycles: DataFrame) -> DataFrame:
    """lifecycles: candidate_id, state, owner_skill, owner_stage, completed_at, verification_refs, superseded_by, reason."""
    state = F.col("state")
    whole = state.isin(*LIFECYCLE) & F.col("owner_skill").isNotNull() & F.col("owner_stage").isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    done = has_text(F.col("completed_at")) & (F.coalesce(F.size("verification_refs"), F.lit(0)) > 0)
    return run_rules(
        lifecycles,
        "candidate",
        "candidate_id",
        [
            Rule("lifecycle-shape", ~whole, "candidate_lifecycle"),
            Rule("lifecycle-completion", whole & (state == "completed") & ~done, "completion"),
            Rule("lifecycle-superseded", whole & (state == "superseded") & ~has_text(F.col("superseded_by")), "resolution"),
            Rule("lifecycle-resolution", whole & state.isin(*CLOSED_WITH_REASON) & ~has_text(F.col("reason")), "resolution"),
        ],
    )


def out_of_order(cards: DataFrame) -> DataFrame:
    """Cards (ledger_id, place, rank) whose rank isn't above all ranks before them."""
    before = Window.partitionBy("ledger_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return cards.withColumn("highest_before", F.max("rank").over(before)).where("rank <= highest_before")
