"""Dependency closure on any graph."""

import random

import pytest

from fleetlens.operators import graph as G


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "component string, depends_on string")


def brute(edges):
    """(closure with longest paths over the edges that are on no cycle, cyclic edges), by depth-first search."""
    edges = set(edges)
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(start, graph):
        seen, todo = set(), [start]
        while todo:
            for y in graph.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    cyclic = {(a, b) for a, b in edges if a in reach(b, out) or a == b}
    rest = {}
    for a, b in edges - cyclic:
        rest.setdefault(a, set()).add(b)
    depth = {}

    def longest(a):
        if a not in depth:
            got = {}
            for b in rest.get(a, ()):
                got[b] = max(got.get(b, 0), 1)
                for c, n in longest(b).items():
                    got[c] = max(got.get(c, 0), n + 1)
            depth[a] = got
        return depth[a]

    return {(a, b, n) for a in list(rest) for b, n in longest(a).items()}, cyclic


def checked(spark, rows):
    closure, rejects = G.dependency_closure(edges_of(spark, rows))
    got = {tuple(r) for r in closure.select("component", "depends_on", "depth").collect()}, {tuple(r) for r in rejects.select("component", "depends_on").collect()}
    assert got == brute([r for r in rows if None not in r])
    return closure, rejects


@pytest.mark.parametrize("seed", range(3))
def test_against_depth_first_search(spark, seed):
    rng = random.Random(seed)
    n = 14
    rows = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(16 + 4 * seed)) if seed == 2 or a != b]
    checked(spark, rows)


def test_cycles_are_rejects(spark):
    _, rejects = checked(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "c"), ("x", "y"), ("x", "y"), (None, "a"), ("a", None)])
    assert {r.reason for r in rejects.collect()} == {G.CYCLE}
    closure, rejects = G.dependency_closure(edges_of(spark, []))
    assert closure.count() == rejects.count() == 0


def test_layers_are_not_walked_path_by_path(spark):
    """Thirty layers of twenty nodes, each with seventeen edges to the next: 17**29 paths, 174,000 pairs."""
    rows = [(f"{k}-{i}", f"{k + 1}-{(i * 7 + j) % 20}") for k in range(29) for i in range(20) for j in range(17)]
    assert len(rows) == 9860
    closure, rejects = G.dependency_closure(edges_of(spark, rows))
    assert rejects.count() == 0
    assert closure.count() == 29 * 20 * 17 + sum(30 - d for d in range(2, 30)) * 400
    levels = {r.component: r.level for r in G.start_levels(closure).collect()}
    assert levels["29-0"] == 0 and levels["0-0"] == 29 and len(levels) == 600


def test_graphs_of_one_table_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "b", "a"), (2, "c", "b"), (3, "a", "a")], "g int, component string, depends_on string")
    closure, rejects = G.dependency_closure(df, ["g"])
    assert {tuple(r) for r in closure.select("g", "component", "depends_on", "depth").collect()} == {
        (1, "a", "b", 1), (1, "b", "c", 1), (1, "a", "c", 2), (2, "b", "a", 1), (2, "c", "b", 1), (2, "c", "a", 2)}
    assert [tuple(r)[:3] for r in rejects.collect()] == [(3, "a", "a")]
