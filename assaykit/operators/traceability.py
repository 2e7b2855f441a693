"""From candidates to claims, lanes and sources, and what several lanes say together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import has_text, position_in
from assaykit.operators.evidence import COVERAGES
from assaykit.operators.findings import Rule, run_rules

# Fixed values of candidates and evaluations.
SCORES = ("severity", "confidence", "leverage", "locality", "testability", "blast_radius", "regression_risk", "human_decision_risk")
EFFORTS = ("S", "M", "L")
DESIGNING = ("design", "prototype")
DIMENSIONS = ("correctness", "robustness", "efficiency", "generalization", "safety")


def envelope_findings(candidates: DataFrame) -> DataFrame:
    """What a candidate must have: title, summary, root_cause; lane_sources and claim_refs (arrays); n_evidence; scores
    from 1 to 5; priority_score from -10 to 22; effort."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return run_rules(
        candidates,
        "candidate",
        "candidate_id",
        [
            *[Rule("candidate-shape", ~has_text(F.col(c)), c) for c in ("title", "summary", "root_cause")],
            Rule("candidate-missing-lane-sources", none("lane_sources"), "lane_sources"),
            Rule("candidate-missing-claim-refs", none("claim_refs"), "claim_refs"),
            Rule("candidate-evidence-missing", F.coalesce("n_evidence", F.lit(0)) < 1, "evidence"),
            *[Rule("candidate-scores", ~F.coalesce(F.col(c).between(1, 5), F.lit(False)), c) for c in SCORES],
            Rule("candidate-rollup", ~F.coalesce(F.col("priority_score").between(-10, 22), F.lit(False)), "priority_score"),
            Rule("candidate-scheduling", ~F.coalesce(F.col("effort").isin(*EFFORTS), F.lit(False)), "effort"),
        ],
    )


def trace_findings(candidates: DataFrame, claims: DataFrame, lanes: DataFrame) -> DataFrame:
    """group, candidate_id, ref, code: lane sources that are no lane, claims that don't exist, or that are of a lane not
    among the sources. candidates: group, candidate_id, lane_sources, claim_refs; claims: group, claim_id, lane; lanes:
    group, lane."""
    of_lane = candidates.select("group", "candidate_id", F.explode("lane_sources").alias("ref"))
    strange = of_lane.join(lanes.select("group", F.col("lane").alias("ref")).distinct(), ["group", "ref"], "left_anti")
    strange = strange.select("group", "candidate_id", "ref", F.lit("candidate-lane-unknown").alias("code"))
    of_claim = candidates.select("group", "candidate_id", "lane_sources", F.explode("claim_refs").alias("ref"))
    x = of_claim.join(claims.select("group", F.col("claim_id").alias("ref"), "lane", F.lit(True).alias("there")), ["group", "ref"], "left")
    code = F.when(F.col("there").isNull(), "candidate-claim-unknown").when(~F.array_contains("lane_sources", F.col("lane")), "candidate-claim-foreign")
    return strange.unionByName(x.select("group", "candidate_id", "ref", code.alias("code")).where("code IS NOT NULL"))


def source_of(path: Column, lines: Column, architecture: Column) -> Column:
    """An evidence item as {kind, ref}: a line, a path or an observation of the architecture; null for others."""
    told = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"))
    there, cut = path.isNotNull(), has_text(lines)
    return (
        F.when(there & cut, told("line", F.concat(path, F.lit(":"), lines)))
        .when(there, told("path", path))
        .when(F.coalesce(architecture, F.lit(False)), told("other", F.lit("architecture-level observation")))
    )


def projected_refs(candidates: DataFrame, projected: DataFrame) -> DataFrame:
    """group, candidate_id, refs: the distinct claims that a candidate's claims were projected to, in their order.

    candidates: group, candidate_id, claim_refs; projected: group, claim_id, place, projected_id.
    """
    each = candidates.select("group", "candidate_id", F.posexplode("claim_refs").alias("turn", "claim_id")).join(projected, ["group", "claim_id"])
    first = each.groupBy("group", "candidate_id", "projected_id").agg(F.min(F.struct("turn", "place")).alias("at"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("at", "projected_id"))), lambda s: s["projected_id"])
    return first.groupBy("group", "candidate_id").agg(refs.alias("refs"))


def settled(safe: DataFrame, unresolved: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distinct keys that are unresolved and not also safe."""
    return unresolved.select(*key).distinct().join(safe.select(*key), list(key), "left_anti")


def handoff_groups(candidates: DataFrame, group: str) -> DataFrame:
    """group, part, ids (sorted): candidates that wait, are rejected, need a design, or else are of integrity."""
    status, action = F.col("status"), F.col("action")
    part = F.when(status.isin("needs-human-decision", "blocked"), "blocked").when((status == "rejected") | (action == "reject"), "rejected").when(action.isin(*DESIGNING), "architecture").otherwise("integrity")
    return candidates.groupBy(group, part.alias("part")).agg(F.array_sort(F.collect_list("candidate_id")).alias("ids"))


def merged_candidates(candidates: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row of each duplicate group: candidate_id (the smallest), merged_from (the others), lane_sources (their union)."""
    ids = F.array_sort(F.collect_set("candidate_id"))
    lanes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lane_sources"))))
    x = candidates.groupBy(*group).agg(ids.alias("ids"), lanes.alias("lane_sources"))
    return x.select(*group, F.col("ids")[0].alias("candidate_id"), F.slice("ids", F.lit(2), F.size("ids")).alias("merged_from"), "lane_sources")


def strongest_coverage(observations: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, coverage: the strongest that any lane saw; unknown states count least."""
    rank = position_in(F.col("coverage"), COVERAGES)
    rank = F.when(rank > 0, -rank).otherwise(-99)
    return observations.groupBy(*key).agg(F.max_by("coverage", F.struct(rank, "coverage")).alias("coverage"))


def suite_score(cases: DataFrame, suite: str) -> DataFrame:
    """suite, total, most, passed: cases of five scores from 0 to 2; a safety of 0 fails the suite whatever the total."""
    total = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    x = cases.groupBy(suite).agg(F.sum(total).cast("long").alias("total"), (F.count(F.lit(1)) * 2 * len(DIMENSIONS)).alias("most"), F.bool_or(F.col("safety") == 0).alias("unsafe"))
    return x.select(suite, "total", "most", (~F.coalesce("unsafe", F.lit(False))).alias("passed"))


def snapshot_findings(snapshot: DataFrame, kind: str, key: str) -> DataFrame:
    """kind, id, code, n: entries of a previous snapshot without an id, and ids that several entries have."""
    x = snapshot.groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    code = F.when(~has_text(F.col("id")), "previous-shape").when(F.col("n") > 1, "previous-duplicate")
    return x.select(F.lit(kind).alias("kind"), "id", code.alias("code"), "n").where("code IS NOT NULL")
