"""Scorecards, receipts and traceability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import rounded

#: Weights of an evaluation's dimensions (fixed values).
WEIGHTS = {"interview": 0.25, "adaptation": 0.15, "swarm": 0.15, "map": 0.20, "evolution": 0.10, "integration": 0.10, "boundaries": 0.05}
#: Executor classes by what a task's kind says, the first that fits (fixed values).
CLASSES = (
    ("agent", "agent|evidence|explore|scout|lane"),
    ("command", "command|test|lint|build|coverage|static-tool|typecheck"),
    ("synthesis", "synth|merge|reconcile|compare"),
    ("report", "report|render|compile"),
    ("deterministic", "fingerprint|inventory|graph|cache|deterministic|parse|index"),
)


def weighted(weights: Mapping[str, float] = WEIGHTS, digits: int = 3) -> Column:
    """The weighted sum of the columns that weights name."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return rounded(total, digits)


def dimension_faults(scores: DataFrame, key: str, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """key, missing, extra: runs whose dimensions are not exactly the weighted ones. scores: key, dimension."""
    wanted = F.array(*[F.lit(w) for w in weights])
    x = scores.groupBy(key).agg(F.collect_set("dimension").alias("has"))
    x = x.select(key, F.array_join(F.array_sort(F.array_except(wanted, "has")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("has", wanted)), ",").alias("extra"))
    return x.where("missing <> '' OR extra <> ''")


def latest(runs: DataFrame, key: Sequence[str], by: str, *values: str) -> DataFrame:
    """key and the values of the row with the greatest `by` of each key: a partial maximum, without a sort."""
    return runs.groupBy(*key).agg(F.max_by(F.struct(by, *values), by).alias("r")).select(*key, "r.*")


def with_scores(runs: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """The latest run (run) of each key, and its latest score (score) if there is one."""
    return latest(runs, [key], "run").join(latest(scores, [key], "file", "score"), key, "left").select(key, "run", "file", "score")


def merged_receipts(receipts: DataFrame, key: str) -> DataFrame:
    """key, planned, peak, wall_ms, serial_ms, speedup: peaks by maximum, times summed, their ratio to 3 decimals."""
    x = receipts.groupBy(key).agg(F.max("planned").alias("planned"), F.max("peak").alias("peak"), F.sum("wall_ms").alias("wall_ms"), F.sum("serial_ms").alias("serial_ms"))
    return x.withColumn("speedup", F.when(F.col("wall_ms") > 0, rounded(F.col("serial_ms") / F.col("wall_ms"), 3)))


def stage_times(stages: DataFrame, key: str) -> DataFrame:
    """key, stage, elapsed: of each stage the sum of its timers; one that was never closed counts nothing."""
    return stages.groupBy(key, "stage").agg(F.sum(F.greatest(F.lit(0), F.col("ended") - F.col("started"))).alias("elapsed"))


def resource_use(holds: DataFrame) -> DataFrame:
    """resource, permits, exclusive: shared permits held, and whether anyone holds all of it. holds: resource, mode, permits."""
    return holds.groupBy("resource").agg(F.coalesce(F.sum(F.when(F.col("mode") == "shared", F.col("permits"))), F.lit(0)).cast("long").alias("permits"), F.bool_or(F.col("mode") == "exclusive").alias("exclusive"))


def pool_statistics(results: DataFrame, key: str) -> DataFrame:
    """key, wall_ms, serial_ms, succeeded. results: key, started, ended, status."""
    return results.groupBy(key).agg((F.max("ended") - F.min("started")).alias("wall_ms"), F.sum(F.col("ended") - F.col("started")).alias("serial_ms"), F.bool_and(F.col("status") == "succeeded").alias("succeeded"))


def normalized_tasks(tasks: DataFrame, most: int | None = None) -> DataFrame:
    """Tasks with defaults: owner, kind, executor_class, weight (from 1), priority, expected_ms (> 0), distinct needs and resources,
    retries (from 0), timeout_ms (null unless > 0), and two flags, which only true sets. Columns that tasks lack count as null.

    With `most`, a task of a greater weight gets that weight; task_findings() tells such tasks.
    """
    have = lambda c, kind: F.col(c) if c in tasks.columns else F.lit(None).cast(kind)
    number = lambda c, low, default, kind="long": F.when(have(c, kind) >= low, have(c, kind)).otherwise(default)
    distinct = lambda c: F.array_distinct(F.coalesce(have(c, "array<string>"), F.array().cast("array<string>")))
    flag = lambda c: F.coalesce(have(c, "boolean"), F.lit(False))
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("task"))
    executor = F.lit("general")
    for name, words in reversed(CLASSES):
        executor = F.when(F.lower(kind).rlike(words), F.lit(name)).otherwise(executor)
    weight = number("weight", 1, 1)
    return tasks.withColumns(
        {
            "owner": F.coalesce(F.nullif("owner", F.lit("")), F.lit("unowned")),
            "kind": kind,
            "executor_class": F.coalesce(F.nullif("executor_class", F.lit("")), executor),
            "weight": weight if most is None else F.least(F.lit(most), weight),
            "priority": F.coalesce("priority", F.lit(0)),
            "expected_ms": number("expected_ms", 1, 1),
            "depends_on": distinct("depends_on"),
            "resources": distinct("resources"),
            "retries": number("retries", 0, 0),
            "timeout_ms": number("timeout_ms", 1, None),
            "retry_on_timeout": flag("retry_on_timeout"),
            "allow_failed_dependencies": flag("allow_failed_dependencies"),
        }
    )


def task_findings(tasks: DataFrame, plan: str, most: int) -> DataFrame:
    """plan, id, code, detail: blank ids, weights over the budget `most` (none is cut), ids that a plan has more than once, and
    needs that it hasn't. tasks: plan, id, weight, depends_on. A plan with findings isn't to be run."""
    x = tasks.withColumn("id", F.trim(F.coalesce("id", F.lit(""))))
    told = lambda rows, code, detail: rows.select(plan, "id", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    repeated = x.where("id <> ''").groupBy(plan, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    need = x.select(plan, "id", F.explode(F.array_distinct("depends_on")).alias("need"))
    known = x.select(plan, F.col("id").alias("need")).distinct()
    return (
        told(x.where("id = ''"), "TASK_ID_INVALID", F.lit(""))
        .unionByName(told(x.where(F.col("weight") > most), "TASK_WEIGHT_EXCEEDS_BUDGET", F.col("weight")))
        .unionByName(told(repeated, "TASK_ID_DUPLICATE", F.col("n")))
        .unionByName(told(need.join(known, [plan, "need"], "left_anti"), "TASK_DEPENDENCY_UNKNOWN", F.col("need")))
    )


def traced(cases: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """key, covered: whether all anchor terms of a case occur in the case's own text and in its section's."""
    x = cases.join(sections.select(key, F.lower("body").alias("body")), key, "left")
    there = F.forall("anchors", lambda a: F.contains(F.lower("text"), F.lower(a)) & F.contains(F.coalesce("body", F.lit("")), F.lower(a)))
    return x.select(key, there.alias("covered"))
