"""Graphs in one walk and by joins: components, closed paths, totals, and what a failure blocks."""

import random
from collections import defaultdict

import pytest

from assaykit.operators import graph

EDGES = "group int, node int, needs int"


def reach(edges):
    """All (group, from, to) with a path."""
    after = defaultdict(set)
    for g, a, b in edges:
        after[g, a].add(b)
    out = set()
    for g, a in list(after):
        todo, seen = [a], set()
        while todo:
            for b in after.get((g, todo.pop()), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(g, a, b) for b in seen}
    return out


def random_graphs(seed, groups=8, nodes=9):
    rnd = random.Random(seed)
    return [(g, rnd.randrange(nodes), rnd.randrange(nodes)) for g in range(groups) for _ in range(rnd.randrange(0, 16))]


@pytest.mark.parametrize("fits", [graph.FITS, 3], ids=["walked", "some joined"])
def test_components_and_paths(spark, fits):
    edges = random_graphs(1)
    r = {(g, a, b) for g, a, b in reach(edges) if a != b}
    want = {(g, a, min([a, *(x for h, y, x in r if (h, y) == (g, a) and (g, x, a) in r)])) for g, a, b in r if (g, b, a) in r}
    frame = spark.createDataFrame([*edges, (None, 1, 2), (1, None, 2), (1, 2, None)], EDGES)
    assert {tuple(x) for x in graph.components(frame, fits=fits).collect()} == want
    sets = defaultdict(set)
    for g, a, c in want:
        sets[g, c].add(a)
    got = {(x.group, tuple(x.members)) for x in graph.cycles(frame, fits=fits).collect()}
    assert got == {(g, tuple(sorted(m))) for (g, _), m in sets.items()}
    paths = {(x.group, tuple(x.path)) for x in graph.closed_paths(frame, fits=fits).collect()}
    assert {(g, p[0]) for g, p in paths} == set(sets) and len(paths) == len(sets)
    known = set(edges)
    for g, p in paths:
        assert p[0] == p[-1] == min(p) and all((g, a, b) in known for a, b in zip(p, p[1:]))
        # no shorter way back, and no other of that length before it
        layer = [(p[0],)]
        for _ in range(len(p) - 1):
            layer = [(*w, b) for w in layer for b in range(9) if (g, w[-1], b) in known and b != w[-1] and (b == p[0] or b not in w)]
            closed = sorted(w for w in layer if w[-1] == p[0])
            if closed:
                break
        assert closed[0] == p


def test_a_complete_graph_is_one_set(spark):
    for n, fits in ((200, graph.FITS), (60, 10)):
        edges = spark.range(n * n).selectExpr("1 AS group", f"CAST(id DIV {n} AS INT) AS node", f"CAST(id % {n} AS INT) AS needs")
        rows = graph.cycles(edges, fits=fits).collect()
        assert [r.members for r in rows] == [list(range(n))]
    assert [r.path for r in graph.closed_paths(edges).collect()] == [[0, 1, 0]]


def test_a_long_chain_and_a_large_group(spark, monkeypatch):
    n = 5_000
    chain = spark.range(n).selectExpr("'g' AS group", "id AS node", "id + 1 AS needs")
    nodes = spark.range(n + 1).selectExpr("'g' AS group", "id AS node", "1 AS cost")
    levels = graph.levels(nodes, chain).collect()
    assert sorted((r.node, r.level) for r in levels) == [(i, n - i) for i in range(n + 1)]
    assert graph.blocked_by(chain, spark.createDataFrame([("g", n)], "group string, node long")).count() == n
    monkeypatch.setattr(graph._sides, "__defaults__", (5,))
    nodes, chain = nodes.where("node <= 8"), chain.where("node < 8")
    assert sorted((r.node, r.level) for r in graph.levels(nodes, chain).collect()) == [(i, 8 - i) for i in range(9)]
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, chain.unionByName(spark.createDataFrame([("g", 8, 3)], "group string, node long, needs long"))).collect()
    assert graph.blocked_by(chain, spark.createDataFrame([("g", 6), (None, 1)], "group string, node long"), fits=5).count() == 6


def test_graphs_without_rows(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.components(none).count() == graph.cycles(none).count() == graph.closed_paths(none).count() == 0
    assert graph.blocked_by(none, none.select("group", "node")).count() == 0
    assert graph.levels(none.select("group", "node"), none).count() == 0
