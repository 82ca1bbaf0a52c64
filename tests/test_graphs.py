"""Graphs over whole tables against brute force on a small fixture."""

import datetime

import pytest

from lodestream.plans import graphs


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """250 customers of two orders each, more than 200 paths, and one of 13, beyond ten layers; none below 40."""
    root = str(tmp_path_factory.mktemp("graphs"))
    custs = [c for c in range(100, 350) for _ in range(2)] + [900] * 13
    orders = [(k, c, datetime.date(2020, 1, 1) + datetime.timedelta(days=(k * 7) % 50)) for k, c in enumerate(custs, 1)]
    lines = [(k, c % 40, 1.0, 0.0) for k, c, _ in orders]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{root}/lineitem.parquet")
    chains = {}
    for k, c, d in sorted(orders, key=lambda o: (o[2], o[0])):
        chains.setdefault(c, []).append(k)
    return root, list(chains.values()), {(c, c % 40 + 100000000) for c in custs}


def test_ways_of_all_orders(spark, small):
    root, chains, _ = small
    at = {(k, i) for chain in chains for i, k in enumerate(chain)}
    assert {tuple(r) for r in graphs.g_reach(spark, root).select("node", "distance").collect()} == at
    assert {tuple(r) for r in graphs.g_layers(spark, root).select("node", "layer").collect()} == {(k, min(i, 10)) for k, i in at}
    got = [tuple(r) for r in graphs.g_paths(spark, root).select("start", "goal", "path").collect()]
    assert sorted(got) == sorted((c[0], c[-1], ">".join(map(str, c))) for c in chains)


def test_links_of_all_lines(spark, small):
    root, _, links = small
    nodes = {n for e in links for n in e}
    degrees = {(n, sum(b == n for _, b in links), sum(a == n for a, _ in links)) for n in nodes}
    assert {tuple(r) for r in graphs.g_degrees(spark, root).collect()} == degrees
    low = {n: min([n, *(a for a, b in links if b == n), *(x for a, b in links if a == n for x, y in links if y == b)]) for n in nodes}
    assert {tuple(r) for r in graphs.g_components(spark, root).select("node", "component").collect()} == set(low.items())


def test_components_of_chains_stars_and_loops(spark):
    import random

    from lodestream.operators.graph import components

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(100)] + [(7, 7)]
    edges = [(f"n{a:05d}", f"n{b:05d}") for a, b in edges]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}


def test_loops_that_do_not_settle_are_errors(spark):
    from lodestream.operators.graph import reach

    chain = spark.createDataFrame([(i, i + 1) for i in range(10)], "s int, t int")
    with pytest.raises(RuntimeError):
        reach(spark.createDataFrame([(0,)], "node int"), chain, "s", "t", most_rounds=3)


def test_plans_of_long_chains_stay_small(spark):
    from lodestream.operators.graph import COMPACT_ROUNDS, reach

    n = 2 * COMPACT_ROUNDS + 3
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    out = reach(spark.createDataFrame([(0,)], "node long"), edges, "a", "b")
    assert sorted((r.node, r.distance) for r in out.collect()) == [(i, i) for i in range(n + 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= COMPACT_ROUNDS + 1


def test_rounds_shuffle_what_they_found_alone(spark, monkeypatch):
    """Edges and what is known lie in buckets: no join of a round shuffles them."""
    from lodestream.operators import graph

    plans, add = [], graph._Buckets.add

    def note(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        add(self, rows)

    monkeypatch.setattr(graph._Buckets, "add", note)
    monkeypatch.setattr(graph, "BUCKET_ROWS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "a long, b long")
        out = graph.reach(spark.createDataFrame([(0,)], "node long"), edges, "a", "b")
        assert sorted((r.node, r.distance) for r in out.collect()) == [(i, i) for i in range(11)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for p in plans if "LeftAnti" in p]
    # the front by node, what it found by node, and the rows to be written
    assert len(rounds) == 11 and all(p.count("Exchange hashpartitioning") <= 2 and p.count("Bucketed: true") == 2 for p in rounds)
