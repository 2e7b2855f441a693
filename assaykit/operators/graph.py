"""Dependency graphs inside groups: cycles, longest paths, levels and what a failure blocks.

Edges: group, node, needs (node needs the other); rows with a null in one of them are no edges. Graphs are many and each has
a group. Groups of at most FITS rows are each walked once, in the task that their rows are dealt to, whatever their depth. The
others are iterated over by joins, all of them at once: a round offers new values along the edges from those nodes only whose
value has moved, and writes just what moved, so that plans don't grow and a chain costs its length, not its square. `rounds`,
where given, sends all groups by joins and bounds their number; what needs more raises an error.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from assaykit.functions.shared import table

#: Rows (nodes and edges) of a group that is walked in one task, at most.
FITS = 100_000
#: Rounds of a fixpoint after which what was written is merged.
MERGED = 16


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("group", "node", "needs").where("group IS NOT NULL AND node IS NOT NULL AND needs IS NOT NULL").distinct()


def _sides(rows: DataFrame, rounds: int | None, fits: int = FITS) -> tuple[DataFrame | None, DataFrame | None, int]:
    """The rows of groups that fit a task, those of the others, and the rows of the largest group; None for a side without rows."""
    sizes = table(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    if rounds is not None:
        return None, rows, most
    if most <= fits:
        return rows, None, most
    pick = lambda keep: rows.join(sizes.where(keep), "group", "left_semi")
    return pick(F.col("n") <= fits), pick(F.col("n") > fits), most


def _walked(rows: DataFrame, walk: Callable[[list[dict]], Iterable[tuple]], out: StructType) -> DataFrame:
    """group and what `walk` gives for the rows of each group, which a task holds one group at a time."""
    schema = to_arrow_schema(out)

    def told(group, held: list[dict]) -> list[tuple]:
        return [(group, *r) for r in walk(held)] if held else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != now:
                    ready += told(now, held)
                    now, held = row["group"], []
                held.append(row)
            yield batch_of(ready)
            ready = []
        yield batch_of(told(now, held))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, out)


def _like(rows: DataFrame, **columns) -> StructType:
    """A schema of the group and further columns, each of a type or like a column of rows."""
    kind = lambda x: rows.schema[x].dataType if isinstance(x, str) else x
    return StructType([StructField(c, kind(x)) for c, x in {"group": "group", **columns}.items()])


def _together(*sides: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, [s for s in sides if s is not None])


def _fixpoint(edges: DataFrame, start: DataFrame, offer: Callable[[Column], Column], rounds: int, what: str) -> DataFrame:
    """group, node, value: the greatest value of a node, its own or what `offer` makes of those before it.

    edges: group, source, node and what offer needs; start: group, node, value. Raises if `rounds` don't suffice.
    """
    written = [table(start.select("group", "node", "value"), "values")]
    moved = written[0]
    for done in count():
        offered = edges.join(moved.withColumnRenamed("node", "source"), ["group", "source"]).groupBy("group", "node").agg(F.max(offer(F.col("value"))).alias("value"))
        known = _together(*written).groupBy("group", "node").agg(F.max("value").alias("known"))
        moved = table(offered.join(known, ["group", "node"], "left").where("known IS NULL OR value > known").select("group", "node", "value"), "values")
        if moved.isEmpty():
            return known.withColumnRenamed("known", "value")
        if done >= rounds:
            raise ValueError(what)
        written.append(moved)
        if len(written) > MERGED:
            written = [table(_together(*written).groupBy("group", "node").agg(F.max("value").alias("value")), "values")]


# Cycles


def tied_sets(pairs: Iterable[tuple]) -> list[list]:
    """The sets of two nodes and more that reach one another, by one depth-first walk with its own stack."""
    after = defaultdict(list)
    for a, b in sorted(pairs):
        after[a].append(b)
    number, low, held, out = {}, {}, [], []
    on = set()
    for root in list(after):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        path = [(root, iter(after[root]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    held.append(other)
                    on.add(other)
                    path.append((other, iter(after.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], number[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(held.pop())
                    on.difference_update(members)
                    if len(members) > 1:
                        out.append(members)
    return out


def way_back(members: Iterable, after: dict) -> list:
    """The shortest closed path from the least member, by nodes in order; after: node to those it needs."""
    inside = set(members)
    start = min(inside)
    before, waiting = {start: None}, deque([start])
    while waiting:
        node = waiting.popleft()
        for other in sorted(x for x in after[node] if x in inside):
            if other == start:
                path = [start]
                while node is not None:
                    path.append(node)
                    node = before[node]
                return path[::-1]
            if other not in before:
                before[other] = node
                waiting.append(other)
    return []


def components(edges: DataFrame, rounds: int | None = None, fits: int = FITS) -> DataFrame:
    """group, node, component: the nodes on a cycle, and the least node of those that each reaches and is reached by.

    Self edges don't count. Groups by joins: nodes without an edge in, or out, go; each node takes the greatest node that
    reaches it, whose set is all of that colour which leads to it; the rest goes through the same again. Rounds follow the
    longest shortest path, the output is a row a node.
    """
    pairs = table(_edges(edges).where("node <> needs"), "pairs")
    small, large, _ = _sides(pairs, rounds, fits)
    walk = lambda rows: [(node, min(tied)) for tied in tied_sets((r["node"], r["needs"]) for r in rows) for node in tied]
    out = _like(pairs, node="node", component="node")
    return _together(small and _walked(small, walk, out), large and _coloured(large, rounds))


def _trimmed(core: DataFrame) -> DataFrame:
    """The edges that may be on a cycle: none starts at a node without an edge in, or leads to one without an edge out."""
    size = core.count()
    while size:
        sources = core.select("group", F.col("needs").alias("node")).distinct()
        sinks = core.select("group", F.col("node").alias("needs")).distinct()
        core = table(core.join(sources, ["group", "node"], "left_semi").join(sinks, ["group", "needs"], "left_semi").select("group", "node", "needs"), "core")
        size, before = core.count(), size
        if size == before:
            break
    return core


def _coloured(pairs: DataFrame, rounds: int | None) -> DataFrame:
    most = rounds if rounds is not None else pairs.count()
    what = f"a graph has walks of more than {rounds} rounds"
    core, found = _trimmed(pairs), []
    while not core.isEmpty():
        nodes = core.select("group", "node").union(core.select("group", "needs")).distinct()
        ahead = core.select("group", F.col("node").alias("source"), F.col("needs").alias("node"))
        colours = table(_fixpoint(ahead, nodes.withColumn("value", F.col("node")), lambda v: v, most, what), "colours")
        of = lambda c: colours.select("group", F.col("node").alias(c), F.col("value").alias(f"{c}_colour"))  # noqa: B023, E731
        same = table(core.join(of("node"), ["group", "node"]).join(of("needs"), ["group", "needs"]).where("node_colour = needs_colour").select("group", F.col("needs").alias("source"), "node"), "same")
        tied = _fixpoint(same, colours.where("node = value"), lambda v: v, most, what)
        sets = tied.groupBy("group", "value").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
        tied = table(tied.join(sets, ["group", "value"]).select("group", "node", "component", "n"), "tied")
        found.append(tied.where("n > 1").drop("n"))
        left = core.join(tied, ["group", "node"], "left_anti").join(tied.select("group", F.col("node").alias("needs")), ["group", "needs"], "left_anti")
        core = _trimmed(table(left.select("group", "node", "needs"), "core"))
    return _together(*found) if found else pairs.where(F.lit(False)).select("group", "node", F.col("node").alias("component"))


def cycles(edges: DataFrame, rounds: int | None = None, fits: int = FITS) -> DataFrame:
    """group, members (sorted nodes) of each set of nodes that reach one another, once; self edges don't count.

    A set is one row, so sets too large for a row are better asked for by components().
    """
    return components(edges, rounds, fits).groupBy("group", "component").agg(F.array_sort(F.collect_list("node")).alias("members")).drop("component")


def closed_paths(edges: DataFrame, rounds: int | None = None, fits: int = FITS) -> DataFrame:
    """group, path: of each set of nodes on cycles one witness, the shortest path from its least node back to it, and of
    such the first in order of nodes. Tasks without rows here are acyclic."""
    pairs = table(_edges(edges).where("node <> needs"), "pairs")
    small, large, _ = _sides(pairs, rounds, fits)

    def walk(rows: list[dict]) -> list[tuple]:
        after = defaultdict(list)
        for r in rows:
            after[r["node"]].append(r["needs"])
        return [(way_back(tied, after),) for tied in tied_sets((r["node"], r["needs"]) for r in rows)]

    out = _like(pairs, path=ArrayType(pairs.schema["node"].dataType))
    return _together(small and _walked(small, walk, out), large and _ways_back(large, rounds))


def _ways_back(pairs: DataFrame, rounds: int | None) -> DataFrame:
    """closed_paths() by joins: all sets at once walk from their least node, one edge a round, to nodes not seen before."""
    of = table(_coloured(pairs, rounds), "sets")
    inner = pairs.join(of, ["group", "node"]).join(of.select("group", F.col("node").alias("needs"), F.col("component").alias("other")), ["group", "needs"])
    inner = table(inner.where("component = other").select("group", "component", "node", "needs"), "inner")
    at = table(of.where("node = component").select("group", "component", "node", F.array("node").alias("path")), "walk")
    seen, found = [at.drop("path")], []
    for done in count():
        if at.isEmpty():
            break
        if rounds is not None and done > rounds:
            raise ValueError(f"a graph has walks of more than {rounds} rounds")
        step = at.join(inner, ["group", "component", "node"]).groupBy("group", "component", F.col("needs").alias("node")).agg(F.min("path").alias("before"))
        step = table(step.withColumn("path", F.concat("before", F.array("node"))).drop("before"), "walk")
        closed = step.where("node = component")
        found.append(closed.select("group", "path"))
        new = step.join(closed, ["group", "component"], "left_anti").join(_together(*seen), ["group", "component", "node"], "left_anti")
        at = table(new.select("group", "component", "node", "path"), "walk")
        seen.append(at.drop("path"))
    return _together(*found) if found else pairs.where(F.lit(False)).select("group", F.array("node").alias("path"))


# Paths


def levels(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """group, node, level: 0 for what needs nothing, else one more than the highest need: the waves of a plan.

    Raises if a graph has a cycle, or is deeper than `rounds` where they are given.
    """
    return _longest(nodes.select("group", "node", F.lit(1).cast("double").alias("cost")), edges, rounds).select("group", "node", (F.col("total") - 1).cast("long").alias("level"))


def critical_paths(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """group, node, critical: a node's cost and the dearest chain of what waits for it. nodes: group, node, cost."""
    waiting = edges.select("group", F.col("needs").alias("node"), F.col("node").alias("needs"))
    return _longest(nodes, waiting, rounds).withColumnRenamed("total", "critical")


def _totals(rows: list[dict]) -> list[tuple]:
    """Each node with its cost and the greatest total of its needs, none before its needs; a node on or behind a cycle has none."""
    total, waits, after = {}, defaultdict(int), defaultdict(list)
    for r in rows:
        if r["needs"] is None:
            total[r["node"]] = max(r["cost"], total.get(r["node"], r["cost"]))
    cost = dict(total)
    for r in rows:
        if r["needs"] is not None and r["node"] in cost and r["needs"] in cost:
            waits[r["node"]] += 1
            after[r["needs"]].append(r["node"])
    free, done = [n for n in cost if not waits[n]], set()
    while free:
        node = free.pop()
        done.add(node)
        for other in after[node]:
            total[other] = max(total[other], cost[other] + total[node])
            waits[other] -= 1
            if not waits[other]:
                free.append(other)
    return [(node, total[node] if node in done else None) for node in cost]


def _longest(nodes: DataFrame, edges: DataFrame, rounds: int | None) -> DataFrame:
    """group, node, total: a node's cost plus the greatest total of its needs."""
    edges = _edges(edges)
    nodes = nodes.select("group", "node", F.col("cost").cast("double").alias("cost"))
    rows = nodes.withColumn("needs", F.lit(None).cast(edges.schema["needs"].dataType)).unionByName(edges.withColumn("cost", F.lit(None).cast("double")), allowMissingColumns=True)
    small, large, most = _sides(table(rows.where("group IS NOT NULL"), "graph-rows"), rounds)
    what = f"a graph has a cycle or more than {rounds if rounds is not None else most} levels"
    if small is not None:
        small = table(_walked(small, _totals, _like(rows, node="node", total=DoubleType())), "totals")
        if not small.where("total IS NULL").isEmpty():
            raise ValueError(what)
    if large is not None:
        own = large.where("needs IS NULL").groupBy("group", "node").agg(F.max("cost").alias("cost"))
        known = own.select("group", F.col("node").alias("needs"))
        ahead = large.where("needs IS NOT NULL").drop("cost").join(own, ["group", "node"]).join(known, ["group", "needs"], "left_semi")
        ahead = table(ahead.select("group", F.col("needs").alias("source"), "node", "cost"), "ahead")
        totals = _fixpoint(ahead, own.withColumnRenamed("cost", "value"), lambda v: v + F.col("cost"), rounds if rounds is not None else most, what)
        large = totals.withColumnRenamed("value", "total")
    return _together(small, large)


def _behind(rows: list[dict]) -> list[tuple]:
    """The nodes that need a failed one (a row without needs), directly or not, but for the failed ones."""
    after = defaultdict(list)
    for r in rows:
        if r["needs"] is not None:
            after[r["needs"]].append(r["node"])
    failed = {r["node"] for r in rows if r["needs"] is None}
    found, waiting = set(), list(failed)
    while waiting:
        for other in after[waiting.pop()]:
            if other not in found and other not in failed:
                found.add(other)
                waiting.append(other)
    return [(n,) for n in found]


def blocked_by(edges: DataFrame, failed: DataFrame, rounds: int | None = None, fits: int = FITS) -> DataFrame:
    """group, node of all that needs a failed node, directly or not. failed: group, node.

    Raises if `rounds` are given and don't suffice.
    """
    edges = _edges(edges)
    rows = edges.unionByName(failed.where("group IS NOT NULL AND node IS NOT NULL").select("group", "node").distinct(), allowMissingColumns=True)
    small, large, _ = _sides(table(rows, "graph-rows"), rounds, fits)
    if large is not None:
        ahead = large.where("needs IS NOT NULL")
        first = table(large.where("needs IS NULL").select("group", "node"), "reached")
        seen, new = [first], first
        for done in count():
            step = ahead.join(new.select("group", F.col("node").alias("needs")), ["group", "needs"], "left_semi").select("group", "node").distinct()
            new = table(step.join(_together(*seen), ["group", "node"], "left_anti"), "reached")
            if new.isEmpty():
                break
            if done == rounds:
                raise ValueError(f"a graph has more than {rounds} levels of blocked nodes")
            seen.append(new)
            if len(seen) > MERGED:
                seen = [first, table(_together(*seen[1:]), "reached")]
        large = _together(*seen[1:]) if len(seen) > 1 else first.where(F.lit(False))
    return _together(small and _walked(small, _behind, _like(rows, node="node")), large)


def ready(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """group, node of nodes that aren't done and need nothing that isn't done."""
    open_edges = edges.join(done.select("group", F.col("node").alias("needs")), ["group", "needs"], "left_anti")
    return nodes.select("group", "node").join(done.select("group", "node"), ["group", "node"], "left_anti").join(open_edges.select("group", "node"), ["group", "node"], "left_anti")


def flowchart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """group, text: a flowchart with a line a node (position, label) and a line a valid edge (source, target positions).

    Edges that point at no node are left out; labels are cut to 60 characters with an ellipsis.
    """
    label = F.when(F.char_length("label") > 60, F.concat(F.substring("label", 1, 60), F.lit("…"))).otherwise(F.col("label"))
    label = F.regexp_replace(F.replace(label, F.lit("#"), F.lit("#35;")), '"', "#quot;")
    a = nodes.select("group", F.lit(0).alias("part"), F.col("position").alias("x"), F.lit(0).cast("long").alias("y"), F.concat(F.lit("n"), "position", F.lit('["'), label, F.lit('"]')).alias("line"))
    known = nodes.select("group", "position")
    e = edges.join(known.withColumnRenamed("position", "source"), ["group", "source"], "left_semi").join(known.withColumnRenamed("position", "target"), ["group", "target"], "left_semi")
    b = e.select("group", F.lit(1).alias("part"), F.col("source").alias("x"), F.col("target").alias("y"), F.concat(F.lit("n"), "source", F.lit(" --> n"), "target").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "x", "y", "line"))), lambda s: s["line"])
    return a.unionByName(b).groupBy("group").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(lines, "\n")).alias("text"))
