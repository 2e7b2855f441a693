"""Ticket trackers: what can be started, and whether tickets and their index agree.

Tickets: tracker, id, title, type, state, claimed_by, has_resolution; blocks: tracker, id, blocker; links: tracker, id
(tickets that the index names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalars import has_text
from assaykit.operators.findings import Rule, run_rules
from assaykit.operators.graph import cycles

#: States and types of tickets (fixed values).
STATES = ("open", "closed")
TYPES = ("research", "grilling", "design", "prototype", "task")


def frontier(tickets: DataFrame, blocks: DataFrame) -> DataFrame:
    """tracker, id, title of open, unclaimed tickets whose every blocker is closed; a missing blocker blocks."""
    closed = tickets.where("state = 'closed'").select("tracker", F.col("id").alias("blocker")).distinct()
    waiting = blocks.join(closed, ["tracker", "blocker"], "left_anti").select("tracker", "id").distinct()
    free = tickets.where((F.col("state") == "open") & ~has_text(F.col("claimed_by")))
    return free.join(waiting, ["tracker", "id"], "left_anti").select("tracker", "id", "title")


def holders(tickets: DataFrame) -> DataFrame:
    """tracker, claimed_by, claims over open tickets."""
    return tickets.where((F.col("state") == "open") & has_text(F.col("claimed_by"))).groupBy("tracker", "claimed_by").agg(F.count(F.lit(1)).alias("claims"))


def ticket_findings(tickets: DataFrame) -> DataFrame:
    state, resolved = F.col("state"), F.coalesce("has_resolution", F.lit(False))
    return run_rules(
        tickets,
        "ticket",
        "id",
        [
            Rule("id-missing", F.col("id").isNull(), "id"),
            Rule("state-invalid", ~F.coalesce(state.isin(*STATES), F.lit(False)), "state"),
            Rule("type-invalid", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "type"),
            Rule("closed-without-resolution", (state == "closed") & ~resolved, "resolution"),
            Rule("open-with-resolution", (state == "open") & resolved, "resolution"),
        ],
    )


def missing_blockers(tickets: DataFrame, blocks: DataFrame) -> DataFrame:
    """tracker, id, blocker for blockers that are no tickets."""
    return blocks.join(tickets.select("tracker", F.col("id").alias("blocker")).distinct(), ["tracker", "blocker"], "left_anti").select("tracker", "id", "blocker")


def index_findings(tickets: DataFrame, links: DataFrame) -> DataFrame:
    """tracker, id, code: closed tickets that the index lacks, links to no ticket, links to open ones."""
    state = tickets.groupBy("tracker", "id").agg(F.max("state").alias("state"))
    x = state.join(links.select("tracker", "id").distinct().withColumn("linked", F.lit(True)), ["tracker", "id"], "full_outer")
    code = F.when(F.col("state").isNull(), "link-missing").when((F.col("state") == "closed") & F.col("linked").isNull(), "closed-not-indexed").when((F.col("state") == "open") & F.col("linked"), "open-indexed")
    return x.select("tracker", "id", code.alias("code")).where("code IS NOT NULL")


def blocking_cycles(tickets: DataFrame, blocks: DataFrame) -> DataFrame:
    """tracker, members (sorted ids) of each set of open tickets that block one another in a ring."""
    open_ids = tickets.where("state = 'open' AND id IS NOT NULL").select(F.col("tracker").alias("group"), F.col("id").alias("node")).distinct()
    edges = blocks.select(F.col("tracker").alias("group"), F.col("id").alias("node"), F.col("blocker").alias("needs"))
    edges = edges.join(open_ids, ["group", "node"], "left_semi").join(open_ids.withColumnRenamed("node", "needs"), ["group", "needs"], "left_semi")
    return cycles(edges.select("group", "node", "needs")).withColumnRenamed("group", "tracker")
