"""Validation as a relation: rules over a table give rows, one for each fault."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """code names the fault; fails is true where a row has it (null counts as false); path says where."""

    code: str
    fails: Column
    path: Column | str = ""
    severity: str = "error"


def run_rules(rows: DataFrame, kind: str, subject: str, rules: Sequence[Rule]) -> DataFrame:
    """subject_kind, subject_id, code, severity, path for each rule that a row fails: one pass over the rows."""
    path = lambda r: F.lit(r.path) if isinstance(r.path, str) else r.path.cast("string")
    found = F.array_compact(F.array(*[F.when(r.fails, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), path(r).alias("path"))) for r in rules]))
    return rows.select(F.lit(kind).alias("subject_kind"), F.col(subject).cast("string").alias("subject_id"), F.inline(found))


def unknown_references(rows: DataFrame, subject: str, refs: str, known: DataFrame, code: str, kind: str) -> DataFrame:
    """Findings for the items of the array `refs` that are not in the one column of `known`."""
    key = known.columns[0]
    each = rows.select(F.col(subject).cast("string").alias("subject_id"), F.explode(refs).alias("path"))
    bad = each.join(known.select(F.col(key).alias("path")).distinct(), "path", "left_anti")
    return bad.select(F.lit(kind).alias("subject_kind"), "subject_id", F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col("path").cast("string").alias("path"))


def duplicates(rows: DataFrame, keys: Sequence[str], code: str, kind: str) -> DataFrame:
    """A finding for each key that occurs more than once; path has the number of occurrences."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.select(F.lit(kind).alias("subject_kind"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("subject_id"), F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col("n").cast("string").alias("path"))


def unknown_keys(rows: DataFrame, subject: str, raw: str, allowed: Sequence[str], kind: str) -> DataFrame:
    """A finding for each key of a JSON object that no schema names."""
    extra = F.array_except(F.json_object_keys(raw), F.array(*[F.lit(a) for a in allowed]))
    return rows.select(F.lit(kind).alias("subject_kind"), F.col(subject).cast("string").alias("subject_id"), F.lit("unknown-property").alias("code"), F.lit("error").alias("severity"), F.explode(extra).alias("path"))


def severity_counts(findings: DataFrame, strict: bool = False) -> DataFrame:
    """errors, warnings, exit_code: 2 with errors, 1 with warnings, else 0; strict counts warnings as errors."""
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    bad = F.col("errors") + (F.col("warnings") if strict else F.lit(0))
    return counts.withColumn("exit_code", F.when(bad > 0, 2).when(F.col("warnings") > 0, 1).otherwise(0).cast("long"))
