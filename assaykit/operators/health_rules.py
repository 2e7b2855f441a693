"""Rules over health records: surfaces, commands, dimension support, sprawl evidence and cross references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import has_text, stripped
from assaykit.operators.findings import Rule, run_rules
from assaykit.operators.health import COVERAGE, EVIDENCE, SURFACES

#: Kinds and results of commands, kinds of evidence that strong quality needs one of (fixed values).
KINDS = ("test", "build", "lint", "typecheck", "other")
RESULTS = ("pass", "fail", "error", "skipped")
DETERMINISTIC = ("claim", "command", "path", "inventory")
#: Sprawl evidence: what an entry of each kind needs, and whether it lists two members or more (fixed values).
SPRAWL = {
    "stale_reachable_paths": (("claim_id", "path", "note"), False),
    "competing_authoritative_implementations": (("claim_id", "group"), True),
    "duplicated_contract_representations": (("claim_id", "contract"), True),
    "unowned_compatibility_layers": (("claim_id", "path", "note"), False),
    "abandoned_reachable_experiments": (("claim_id", "path", "note"), False),
}


def surface_findings(surfaces: DataFrame) -> DataFrame:
    """surfaces: surface, weight, coverage, quality, reason, evidence_kinds (array)."""
    coverage, quality = F.col("coverage"), F.col("quality")
    known = F.coalesce(coverage.isin(*COVERAGE, "not-applicable"), F.lit(False))
    applies, rated = known & (coverage != "not-applicable"), F.coalesce(quality.isin(*EVIDENCE), F.lit(False))
    core = F.col("surface").isin(*[s for s, (_, core) in SURFACES.items() if core])
    evidence = F.coalesce("evidence_kinds", F.array().cast("array<string>"))
    whole = (F.col("weight") % 1 == 0) & F.col("weight").between(1, 5)
    return run_rules(
        surfaces,
        "surface",
        "surface",
        [
            Rule("surface-weight-range", ~F.coalesce(whole, F.lit(False)), "criticality_weight"),
            Rule("surface-state-unknown", ~known, "coverage"),
            Rule("surface-evidence-missing", known & (F.size(evidence) == 0), "evidence_refs"),
            Rule("core-surface-not-applicable", (coverage == "not-applicable") & core, "coverage"),
            Rule("surface-reason-missing", coverage.isin("not-applicable", "unavailable") & ~has_text(F.col("reason")), "reason"),
            Rule("evidence-quality-unknown", applies & ~rated, "evidence_quality"),
            Rule("surface-evidence-weak", applies & (quality == "strong") & (F.size(evidence) > 0) & ~F.arrays_overlap(evidence, F.array(*[F.lit(k) for k in DETERMINISTIC])), "evidence_refs"),
            Rule("coverage-evidence-mismatch", (coverage == "inspected") & quality.isin("weak", "none"), "coverage"),
        ],
    )


def command_findings(commands: DataFrame) -> DataFrame:
    """commands: command_id, command, kind, result, exit_code, elapsed, reason."""
    result = F.col("result")
    known = F.coalesce(result.isin(*RESULTS), F.lit(False))
    skipped, ran = result == "skipped", known & (result != "skipped")
    code = F.col("exit_code")
    return run_rules(
        commands,
        "command",
        "command_id",
        [
            Rule("command-shape", ~has_text(F.col("command_id")), "command_id"),
            Rule("command-shape", ~has_text(F.col("command")), "command"),
            Rule("command-shape", ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
            Rule("command-shape", ~known, "result"),
            Rule("command-metrics", skipped & (code.isNotNull() | F.col("elapsed").isNotNull()), "exit_code"),
            Rule("command-metrics", skipped & ~has_text(F.col("reason")), "reason"),
            Rule("command-metrics", ran & code.isNull(), "exit_code"),
            Rule("command-metrics", ran & F.col("elapsed").isNull(), "elapsed"),
            Rule("command-inconsistent", (result == "pass") & (code != 0) | (result == "fail") & (code == 0), "result"),
        ],
    )


#: How commands may be kept from the assessed files, and what keeps nothing from them (fixed values).
ISOLATIONS, NOT_ISOLATED = ("worktree", "copy", "container", "in-place", "none"), ("in-place", "none")


def isolation_findings(verifications: DataFrame, commands: DataFrame) -> DataFrame:
    """repository, code for repositories with recorded commands: baseline-isolation-unknown, baseline-not-isolated.

    verifications: repository, isolation; a repository without a row has no isolation.
    """
    ran = commands.select("repository").distinct().join(verifications.groupBy("repository").agg(F.max("isolation").alias("isolation")), "repository", "left")
    how = F.col("isolation")
    code = F.when(~F.coalesce(how.isin(*ISOLATIONS), F.lit(False)), "baseline-isolation-unknown").when(how.isin(*NOT_ISOLATED), "baseline-not-isolated")
    return ran.select("repository", code.alias("code")).where("code IS NOT NULL")


def dimension_findings(references: DataFrame, claims: DataFrame) -> DataFrame:
    """lane, dimension, code, claim_id. references: lane, dimension, level, claim_id, support, ordinal; claims: claim_id,
    lane, result.

    A reference needs a known claim of its own lane and a support line that no other dimension of the lane reuses; a
    level needs claims that can carry it.
    """
    x = references.join(claims.select("claim_id", F.col("lane").alias("claim_lane"), "result"), "claim_id", "left")
    own = F.col("claim_lane") == F.col("lane")
    code = F.when(F.col("claim_lane").isNull(), "dimension-claim-unknown").when(~own, "dimension-claim-foreign")
    linked = x.select("lane", "dimension", code.alias("code"), "claim_id").where("code IS NOT NULL")
    mute = references.where(~has_text(F.col("support"))).select("lane", "dimension", F.lit("claim-ref-support-missing").alias("code"), "claim_id")
    good = x.where(own)
    key = F.lower(stripped(F.coalesce("support", F.lit(""))))
    first = good.groupBy("lane", "claim_id", key.alias("key")).agg(F.min_by("dimension", "ordinal").alias("first"), F.collect_set("dimension").alias("dimensions"))
    reused = first.select("lane", "claim_id", F.explode(F.array_except("dimensions", F.array("first"))).alias("dimension")).select("lane", "dimension", F.lit("claim-ref-duplicate-support").alias("code"), "claim_id")
    result = F.col("result")
    per = good.groupBy("lane", "dimension").agg(F.max("level").alias("level"), F.bool_or(result.isin("pass", "partial")).alias("some"), F.bool_or(result == "pass").alias("passes"), F.bool_and(result == "unknown").alias("unknown"), F.bool_and(result == "pass").alias("clean"))
    level = F.col("level")
    odd = (level >= 2) & ~F.col("some") | (level >= 4) & ~F.col("passes") | (level > 1) & F.col("unknown") | (level <= 1) & F.col("clean")
    incoherent = per.where(odd).select("lane", "dimension", F.lit("dimension-incoherent").alias("code"), F.lit(None).cast("string").alias("claim_id"))
    return linked.unionByName(mute).unionByName(reused).unionByName(incoherent)


def sprawl_findings(entries: DataFrame) -> DataFrame:
    """entries: id, kind, fields (map of strings), members (array)."""
    missing = F.lit(False)
    for kind, (needed, several) in SPRAWL.items():
        lacks = F.lit(False)
        for f in needed:
            lacks = lacks | ~has_text(F.try_element_at("fields", F.lit(f)))
        if several:
            lacks = lacks | (F.size(F.array_distinct(F.coalesce("members", F.array().cast("array<string>")))) < 2)
        missing = F.when(F.col("kind") == kind, lacks).otherwise(missing)
    return run_rules(entries, "sprawl", "id", [Rule("sprawl-kind-unknown", ~F.coalesce(F.col("kind").isin(*SPRAWL), F.lit(False)), "kind"), Rule("sprawl-entry", missing, F.col("kind"))])


def evidence_links(surface_refs: DataFrame, claims: DataFrame, commands: DataFrame) -> DataFrame:
    """surface, kind, ref of surface evidence that names no claim or command. surface_refs: surface, kind, ref."""
    known = claims.select(F.lit("claim").alias("kind"), F.col("claim_id").alias("ref")).unionByName(commands.select(F.lit("command").alias("kind"), F.col("command_id").alias("ref"))).distinct()
    return surface_refs.where(F.col("kind").isin("claim", "command")).join(known, ["kind", "ref"], "left_anti").select("surface", "kind", "ref")


def optional_lanes(declared: DataFrame, scored: DataFrame) -> DataFrame:
    """lane, code: optional lanes that are declared but not scored, or scored but not declared."""
    x = declared.select("lane", F.lit(True).alias("d")).distinct().join(scored.select("lane", F.lit(True).alias("s")).distinct(), "lane", "full_outer")
    return x.select("lane", F.when(F.col("s").isNull(), "lane-declared-not-scored").when(F.col("d").isNull(), "lane-scored-not-declared").alias("code")).where("code IS NOT NULL")


def cap_differences(declared: DataFrame, fired: DataFrame) -> DataFrame:
    """repository, cap, code: caps that were declared and didn't fire, and the reverse."""
    keys = ["repository", "cap"]
    a = declared.select(*keys).distinct().join(fired.select(*keys), keys, "left_anti").withColumn("code", F.lit("cap-declared-not-fired"))
    return a.unionByName(fired.select(*keys).distinct().join(declared.select(*keys), keys, "left_anti").withColumn("code", F.lit("cap-fired-not-declared")))
