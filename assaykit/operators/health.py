"""Health arithmetic: weighted coverage, lane scores, capped grades and confidence, a repository a group.

Surfaces: repository, surface, weight, coverage, quality, core. Dimensions: repository, lane, dimension, level and
lane_weight. Commands: repository, kind, result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalars import choice, rounded

#: Credit of coverage states (not-applicable has none), worth of evidence (fixed values).
COVERAGE = {"inspected": 1.0, "sampled": 0.6, "inventory-only": 0.25, "uninspected": 0.0, "unavailable": 0.0}
EVIDENCE = {"strong": 1.0, "moderate": 0.9, "weak": 0.7, "none": 0.0}
#: Surfaces that every assessment lists: weight, and whether a grade needs it (fixed values).
SURFACES = {
    "runtime-code": (5, True),
    "domain-libraries": (4, True),
    "architecture-boundaries": (4, True),
    "contracts-and-wiring": (5, True),
    "data-lifecycle": (4, False),
    "verification": (4, True),
    "build-and-delivery": (3, False),
    "operational-behavior": (3, False),
    "generated-surfaces": (2, False),
    "specialized-paths": (3, False),
    "ownership-and-maintainability": (2, False),
}
#: Weights of the six dimensions, the highest level (fixed values).
DIMENSIONS = {"observed_soundness": 30, "automated_enforcement": 25, "verification_readiness": 20, "boundary_clarity": 10, "change_containment": 10, "operational_reproducibility": 5}
LEVELS = 4
#: Grades with their floors, best first; lane weight from which a lane is critical (fixed values).
GRADES = (("A", 90), ("B", 75), ("C", 50), ("D", 25), ("F", None))
CRITICAL = 4
#: Weights of the parts of the confidence index, and its bands (fixed values).
CONFIDENCE = {"weighted_coverage": 0.40, "evidence_strength": 0.20, "baseline_factor": 0.15, "core_availability": 0.10, "determinism_ratio": 0.10, "freshness_factor": 0.05}
BASELINE_FACTOR = {"trustworthy": 100, "partial": 50, "untrustworthy": 0, "not-run": 0}


def credit() -> Column:
    """A surface's credit; null where it isn't applicable or a state is unknown."""
    return choice(F.col("coverage"), COVERAGE) * choice(F.col("quality"), EVIDENCE)


def coverage(surfaces: DataFrame) -> DataFrame:
    """repository, weighted_coverage, evidence_strength, core_availability in percent, unavailable_core.

    Not-applicable surfaces leave the denominator; unavailable ones stay in it with no credit.
    """
    x = surfaces.withColumn("credit", F.when(F.col("coverage") != "not-applicable", credit())).withColumn("worth", choice(F.col("quality"), EVIDENCE))
    counted = F.when(F.col("credit").isNotNull(), F.col("weight"))
    core = F.when(F.col("core"), counted)
    percent = lambda of, weight: F.coalesce(rounded(F.try_divide(F.sum(weight * F.col(of)), F.sum(weight)) * 100, 1), F.lit(0.0))
    return x.groupBy("repository").agg(
        percent("credit", counted).alias("weighted_coverage"),
        percent("worth", counted).alias("evidence_strength"),
        percent("credit", core).alias("core_availability"),
        F.count_if(F.col("core") & (F.col("coverage") == "unavailable")).alias("unavailable_core"),
    )


def lane_scores(dimensions: DataFrame) -> DataFrame:
    """repository, lane, lane_weight, score: the sum of level / 4 * weight over the six dimensions."""
    part = F.col("level") / float(LEVELS) * choice(F.col("dimension"), DIMENSIONS)
    return dimensions.groupBy("repository", "lane").agg(F.max("lane_weight").alias("lane_weight"), rounded(F.sum(part), 2).alias("score"))


def overall(lanes: DataFrame) -> DataFrame:
    """repository, overall_raw (mean of lane scores by weight), weakest_lane, weakest_score (of critical lanes)."""
    critical = F.when(F.col("lane_weight") >= CRITICAL, F.struct("score", "lane"))
    raw = rounded(F.sum(F.col("score") * F.col("lane_weight")) / F.sum("lane_weight"), 2)
    return lanes.groupBy("repository").agg(raw.alias("overall_raw"), F.min(critical).alias("w")).select("repository", "overall_raw", F.col("w.lane").alias("weakest_lane"), F.col("w.score").alias("weakest_score"))


def grade_index(score: Column) -> Column:
    """0 for the best grade."""
    out = F.lit(len(GRADES) - 1)
    for i in range(len(GRADES) - 2, -1, -1):
        out = F.when(score >= GRADES[i][1], i).otherwise(out)
    return out


def letter(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g, _ in GRADES]), (index + 1).cast("int"))


def baseline(commands: DataFrame) -> DataFrame:
    """repository, state, reason from command results; a skipped command that is no test counts as documented."""
    test = F.col("kind") == "test"
    x = commands.groupBy("repository").agg(F.count_if(test).alias("tests"), F.count_if(test & (F.col("result") != "pass")).alias("bad_tests"), F.count_if(~test & ~F.col("result").isin("pass", "skipped")).alias("bad_others"))
    state = F.when(F.col("tests") == 0, "partial").when(F.col("bad_tests") > 0, "untrustworthy").when(F.col("bad_others") > 0, "partial").otherwise("trustworthy")
    reason = F.when(F.col("tests") == 0, "no-test-command").when(F.col("bad_tests") > 0, "test-not-passing").when(F.col("bad_others") > 0, "non-test-not-passing").otherwise("all-passing")
    return x.select("repository", state.alias("state"), reason.alias("reason"))


def baseline_ceiling(state: Column, reason: Column) -> Column:
    """The best grade index that a baseline allows; null for a trustworthy one. C but for a missing test command."""
    return F.when(state == "trustworthy", None).when((state == "partial") & (reason == "no-test-command"), 1).otherwise(2)


def graded(lanes: DataFrame, surfaces: DataFrame, commands: DataFrame) -> DataFrame:
    """repository, overall_raw, raw_grade, final_grade, n_caps, binding: the worst of the raw grade and all ceilings.

    Not gradable below 40 % coverage or with a core surface unavailable. A repository without commands wasn't run.
    """
    x = overall(lanes).join(coverage(surfaces), "repository").join(baseline(commands), "repository", "left")
    state, reason = F.coalesce("state", F.lit("not-run")), F.coalesce("reason", F.lit("no-commands"))
    raw = grade_index(F.col("overall_raw"))
    caps = {
        "weakest-critical-lane": F.when(F.col("weakest_score").isNotNull(), F.greatest(F.lit(0), grade_index(F.col("weakest_score")) - 1)),
        "baseline": baseline_ceiling(state, reason),
        "coverage-below-80": F.when(F.col("weighted_coverage") < 80, 1),
        "coverage-below-60": F.when(F.col("weighted_coverage") < 60, 2),
    }
    x = x.withColumn("raw", raw)
    for name, cap in caps.items():
        x = x.withColumn(name, cap)
    x = x.withColumn("final", F.greatest("raw", *caps))
    closed = (F.col("weighted_coverage") < 40) | (F.col("unavailable_core") > 0)
    binding = F.array_join(F.array_compact(F.array(*[F.when((F.col(n) == F.col("final")) & (F.col("final") > F.col("raw")), F.lit(n)) for n in caps])), ",")
    n_caps = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in caps), F.lit(0))
    return x.select(
        "repository",
        "overall_raw",
        letter(F.col("raw")).alias("raw_grade"),
        F.when(closed, "Not gradable").otherwise(letter(F.col("final"))).alias("final_grade"),
        F.when(closed, 0).otherwise(n_caps).cast("long").alias("n_caps"),
        F.when(closed, "").otherwise(binding).alias("binding"),
    )


def confidence(parts: DataFrame) -> DataFrame:
    """repository, confidence_index, confidence_band from the six parts in percent (null counts as 0)."""
    total = F.lit(0.0)
    for name, weight in CONFIDENCE.items():
        total = total + F.coalesce(F.col(name), F.lit(0)) * weight
    index = rounded(total, 1)
    return parts.select("repository", index.alias("confidence_index")).withColumn("confidence_band", F.when(F.col("confidence_index") >= 75, "high").when(F.col("confidence_index") >= 50, "moderate").otherwise("low"))


def missing_surfaces(surfaces: DataFrame) -> DataFrame:
    """repository, surface for each surface of the inventory that a repository doesn't list."""
    listed = surfaces.select("repository", "surface").distinct()
    wanted = surfaces.select("repository").distinct().select("repository", F.explode(F.array(*[F.lit(s) for s in SURFACES])).alias("surface"))
    return wanted.join(listed, ["repository", "surface"], "left_anti")


def coverage_gaps(surfaces: DataFrame, top: int = 5) -> DataFrame:
    """repository, place, surface, gap: the largest weight * (1 - credit) of each repository."""
    x = surfaces.where("coverage <> 'not-applicable'").withColumn("gap", F.col("weight") * (1 - credit())).where("gap > 0")
    order = Window.partitionBy("repository").orderBy(F.desc("gap"), "surface")
    return x.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top).select("repository", "place", "surface", "gap")


def determinism(claims: DataFrame) -> DataFrame:
    """repository, determinism_ratio: confirmed of all verified claims, in percent."""
    return claims.groupBy("repository").agg(rounded(F.count_if(F.col("verification") == "confirmed") * 100.0 / F.count(F.lit(1)), 1).alias("determinism_ratio"))
