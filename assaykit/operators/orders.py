"""Orders that tools show or take work in, as positions within a group: windows over one group at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def ready_order(tasks: DataFrame, group: str = "group") -> DataFrame:
    """Tasks with position: the dearest critical path first, then priority, weight and id. tasks: id, critical, priority, weight."""
    return _placed(tasks, group, F.desc("critical"), F.desc("priority"), F.desc("weight"), F.asc("id"))


def admission_order(jobs: DataFrame, group: str = "group") -> DataFrame:
    """Jobs that are ready, with position: the highest priority first (none is 0), then as submitted, then by id."""
    return _placed(jobs.where("status = 'READY'"), group, F.desc(F.coalesce("priority", F.lit(0))), F.asc("submitted"), F.asc("id"))


def finding_order(findings: DataFrame, group: str) -> DataFrame:
    """Findings with position: errors, then warnings, then others; by path, line (none is 0) and code."""
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return _placed(findings, group, severity.asc(), F.asc("path"), F.coalesce("line", F.lit(0)).asc(), F.asc("code"))


def frontier_order(tickets: DataFrame, group: str = "tracker") -> DataFrame:
    """Tickets with position by id, those without one last."""
    return _placed(tickets, group, F.asc_nulls_last("id"))
