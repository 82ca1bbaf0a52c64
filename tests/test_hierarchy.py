"""Recursion over cyclic graphs against plain Python."""

import random

import pytest

from lodestream.operators import hierarchy


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    closed = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), [start]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        closed[start] = seen
    return closed


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_and_condensation(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(50, 50), (60, 61), (60, 61)]
    closed = reach(edges)
    want = {x: min([x, *(y for y in closed[x] if x in closed[y])]) for x in closed}
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    of = hierarchy.strong_components(df, "a", "b")
    assert dict(map(tuple, of.collect())) == want
    got = {tuple(r) for r in hierarchy.condensation(df, "a", "b", of).collect()}
    assert got == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}


def test_graphs_without_cycles_or_edges(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert dict(map(tuple, hierarchy.strong_components(df, "a", "b").collect())) == {"a": "a", "b": "b", "c": "c"}
    assert hierarchy.strong_components(df.limit(0), "a", "b").count() == 0


def walks(edges, starts):
    out, todo = [], [(s, s, (s,)) for s in starts]
    while todo:
        root, node, path = todo.pop()
        nexts = [b for a, b in edges if a == node and b is not None]
        out.append((root, node, len(path), path, int(all(n in path for n in nexts)), int(any(n in path for n in nexts))))
        todo += [(root, n, (*path, n)) for n in nexts if n not in path]
    return sorted(out)


def test_connect_by_nocycle(spark):
    edges = [(1, 2), (2, 3), (3, 1), (2, 4), (4, 4), (2, 5), (2, 5), (None, 1), (5, None), (3, 5)]
    got = hierarchy.connect_by(spark.createDataFrame(edges, "parent int, child int"), spark.createDataFrame([(1,), (9,), (None,), (4,)], "node int"))
    assert sorted((r.root, r.node, r.level, tuple(r.path), r.is_leaf, r.is_cycle) for r in got.collect()) == walks(edges, [1, 9, 4])


def test_a_cycle_is_an_error_where_it_is_not_allowed(spark):
    edges, starts = spark.createDataFrame([(1, 2), (2, 1)], "parent int, child int"), spark.createDataFrame([(1,)], "node int")
    with pytest.raises(Exception, match="cycle"):
        hierarchy.connect_by(edges, starts, nocycle=False).collect()
    assert hierarchy.connect_by(edges, starts.limit(0)).count() == 0


def test_interval_labels_tell_ancestors(spark):
    rng = random.Random(3)
    parent = {0: None, 1: None, 2: 0} | {n: rng.choice([2, 2, 0, rng.randrange(n)]) for n in range(3, 60)} | {90: 91, 91: 90}
    got = {r.node: r for r in hierarchy.interval_labels(spark.createDataFrame([*parent.items()], "node int, parent int")).collect()}
    assert got.keys() == parent.keys() - {90, 91}

    def above(n):
        while n is not None:
            yield n
            n = parent[n]

    for a in got:
        assert {b for b in got if got[a].low <= got[b].low < got[a].high} == {b for b in got if a in above(b)}
        assert got[a].level == len([*above(a)]) and got[a].root == [*above(a)][-1]
    assert hierarchy.interval_labels(spark.createDataFrame([], "node int, parent int")).count() == 0


def test_a_level_of_walks_is_written_once(spark, monkeypatch):
    written, keep = [], hierarchy._keep
    monkeypatch.setattr(hierarchy, "_keep", lambda df: written.append(df) or keep(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "parent int, child int")
    got = hierarchy.connect_by(edges, spark.createDataFrame([(0,)], "node int"))
    assert sorted((r.level, r.path, r.is_leaf) for r in got.collect()) == [(k + 1, list(range(k + 1)), int(k == 4)) for k in range(5)]
    assert len(written) <= 2 + 5
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()  # edges are read from their table
