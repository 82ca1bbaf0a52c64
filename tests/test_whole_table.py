"""Whole-table windows and joins without an equality key against plain Python: nulls, ties, hot values, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import inequality, ordered


def values(seed, n, hot=0.3):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.05 else 7 if rng.random() < hot else rng.randint(-20, 50)) for i in range(n)]


def test_prefix_scan_over_many_ranges(spark):
    rows = values(1, 500)
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {(r.id, r.position, r.upto) for r in ordered.prefix_scan(df, ["v", "id"], {"upto": F.col("v")}).collect()}
    want, total = set(), 0
    for k, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1):
        total += v or 0
        want.add((i, k, total))
    assert got == want


def test_no_single_partition_in_the_plan(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("v"))
    for out in (ordered.prefix_scan(df, ["v", "id"], {"s": F.col("id")}), ordered.ranks(df, "v"), ordered.tiles(df, ["id"], 7), ordered.page(df, ["id"], 5, 5)):
        assert "SinglePartition" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_with_hot_ties_and_nulls(spark, descending):
    rows = values(2, 300)
    df = spark.createDataFrame(rows, "id long, v long").repartition(3)
    n = len(rows)
    key = (lambda v: (v is None, -(v or 0))) if descending else (lambda v: (v is not None, v or 0))
    ordered_keys = sorted(key(v) for _, v in rows)
    distinct = sorted(set(ordered_keys))
    want = {}
    for i, v in rows:
        less = sum(k < key(v) for k in ordered_keys)
        want[i] = (less + 1, distinct.index(key(v)) + 1, round(less / (n - 1), 9), round(sum(k <= key(v) for k in ordered_keys) / n, 9))
    got = {r.id: (r.rank, r.dense_rank, round(r.percent_rank, 9), round(r.cume_dist, 9)) for r in ordered.ranks(df, "v", descending).collect()}
    assert got == want


def test_rare_values_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_SHARE", 3)
    df = spark.createDataFrame([(i, i // 2 if i > 30 else 0) for i in range(80)], "id long, v long")
    assert sorted(r["rank"] for r in ordered.ranks(df, "v").collect()) == sorted(sum((j // 2 if j > 30 else 0) < (i // 2 if i > 30 else 0) for j in range(80)) + 1 for i in range(80))


def test_tiles_pages_and_quantiles(spark):
    for n in (0, 1, 3, 7, 50):
        df = spark.range(n).repartition(3)
        sizes = [[r.tile for r in ordered.tiles(df, ["id"], 7).orderBy("id").collect()].count(k) for k in range(1, 8)]
        assert sizes == [n // 7 + (k < n % 7) for k in range(7)]
        assert sorted(r.id for r in ordered.page(df, ["id"], 2, 3).collect()) == list(range(n))[2:5]
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (2.0,), (2.0,)], "v double").repartition(2)
    assert {r.share: r.value for r in ordered.quantile_cont(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()} == pytest.approx({0.0: 1.0, 0.5: 2.0, 0.9: 3.4, 1.0: 4.0})
    assert ordered.quantile_cont(df.limit(0), "v", [0.5]).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_inequalities_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(inequality, "BIN", 16)
    rng = random.Random(seed)
    side = lambda n: [(rng.choice([None, *range(8)]), rng.choice([None, *range(8)]), rng.choice("ab")) for _ in range(n)]
    a, b = side(60) + [(3, 3, "a")] * 30, side(50) + [(2, 5, "b")] * 30
    left, right = spark.createDataFrame(a, "x int, v int, s string"), spark.createDataFrame(b, "y int, w int, t string")
    pairs = sorted((l + r for l in a for r in b if None not in (l[0], l[1], r[0], r[1]) and r[0] < l[0] and r[1] > l[1]), key=str)
    assert sorted(map(tuple, inequality.inequality_join(left, right, ("x", "y"), ("v", "w")).collect()), key=str) == pairs
    counts = sorted((l + (sum(None not in (l[0], l[1], r[0], r[1]) and r[0] < l[0] and r[1] > l[1] for r in b),) for l in a), key=str)
    assert sorted(map(tuple, inequality.inequality_counts(left, right, ("x", "y"), ("v", "w")).collect()), key=str) == counts


def test_inequalities_of_empty_sides(spark):
    some, none = spark.createDataFrame([(1, 1)], "x int, v int"), spark.createDataFrame([], "y int, w int")
    assert inequality.inequality_join(some, none, ("x", "y"), ("v", "w")).count() == 0
    assert [tuple(r) for r in inequality.inequality_counts(some, none, ("x", "y"), ("v", "w")).collect()] == [(1, 1, 0)]
    assert inequality.inequality_counts(none, some, ("y", "x"), ("w", "v")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_of_any_length_come_once(spark, seed):
    rng = random.Random(seed)

    def spans(n):
        out = [(None, 5), (4, None), (9, 9), (8, 3), (-(1 << 61), 1 << 61), (-1, 1), (0, 1)]
        for _ in range(n):
            low = rng.randint(-2000, 2000)
            out.append((low, low + rng.choice([1, 2, 7, 100, 5000, 1_000_000])))
        return out + out[-3:]

    a, b = spans(60), spans(60)
    left, right = spark.createDataFrame([(i, *s) for i, s in enumerate(a)], "i int, a long, b long"), spark.createDataFrame([(i, *s) for i, s in enumerate(b)], "j int, c long, d long")
    real = lambda s: None not in s and s[0] < s[1]
    want = sorted((i, j) for i, s in enumerate(a) for j, t in enumerate(b) if real(s) and real(t) and s[0] < t[1] and t[0] < s[1])
    assert sorted((r.i, r.j) for r in inequality.overlap_join(left, right, ("a", "b"), ("c", "d")).collect()) == want
    assert inequality.overlap_join(left.limit(0), right, ("a", "b"), ("c", "d")).count() == 0


def test_no_nested_loop_in_the_plans(spark):
    a, b = spark.range(100).select("id", (-F.col("id")).alias("v")), spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("w"))
    for out in (inequality.inequality_counts(a, b, ("id", "k"), ("v", "w")), inequality.inequality_join(a, b, ("id", "k"), ("v", "w")), inequality.overlap_join(a, b, ("v", "id"), ("k", "w"))):
        plan = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_are_summed_without_pairs(spark, seed):
    rng = random.Random(seed)
    span = lambda: (low := rng.randint(-50, 50), low + rng.choice([-1, 0, 1, 2, 7, 100, 5000]))
    a, b = [span() for _ in range(40)] + [(None, 5), (4, None), (3, 9), (3, 9)], [span() for _ in range(40)] + [(None, 5), (2, 3), (9, 10), (-(1 << 50), 1 << 50)] * 2
    real = lambda s: None not in s and s[0] < s[1]
    want = []
    for i, s in enumerate(a):
        met = [(j, min(s[1], t[1]) - max(s[0], t[0])) for j, t in enumerate(b) if real(s) and real(t) and s[0] < t[1] and t[0] < s[1]]
        if met:
            want.append((i, len(met), min(met)[0], sum(m[1] for m in met)))
    left, right = spark.createDataFrame([(i, *s) for i, s in enumerate(a)], "i int, a long, b long"), spark.createDataFrame([(j, *s) for j, s in enumerate(b)], "j int, c long, d long")
    out = inequality.overlap_summary(left, right, ("a", "b"), ("c", "d"), "j")
    assert sorted((r.i, r.n, r.least, r.shared) for r in out.collect()) == want
    assert inequality.overlap_summary(left.limit(0), right, ("a", "b"), ("c", "d"), "j").count() == 0 == inequality.overlap_summary(left, right.limit(0), ("a", "b"), ("c", "d"), "j").count()


def _executed(df, name):
    """Nodes of this name of the plan that ran."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        if kind.startswith(name):
            found.append(node)
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_pairs_that_match_are_not_shuffled_each(spark, monkeypatch):
    """Every left row matches every right one: it asks once for each chunk of them, not once for each."""
    monkeypatch.setattr(inequality, "CHUNK", 16)
    left, right = spark.range(1000, 1100).selectExpr("id AS x", "0L AS v"), spark.range(100).selectExpr("id AS y", "id + 1 AS w")
    out = inequality.inequality_join(left, right, ("x", "y"), ("v", "w"))
    assert out.count() == 10_000
    asked = max(int(n.metrics().apply("numOutputRows").value()) for n in _executed(out, "Generate"))
    assert asked <= 100 * (100 // 16 + 8)


def test_overlaps_broadcast_no_rows_that_grow(spark):
    """A small file can hold many rows: what is broadcast is a row for each range of the scan, not the rows or what is known of them."""
    left = spark.range(3000).selectExpr("id AS i", "id % 50 AS a", "id % 50 + 3 AS b")
    right = spark.range(3000).selectExpr("id AS j", "id % 70 AS c", "id % 70 + 5 AS d")
    out = inequality.overlap_summary(left, right, ("a", "b"), ("c", "d"), "j")
    broadcast = [int(n.metrics().apply("numOutputRows").value()) for n in _executed(out, "BroadcastExchange")]
    assert out.count() == 3000 and max(broadcast, default=0) <= 50


def test_inequalities_broadcast_no_rows_that_grow(spark):
    left, right = spark.range(2000).selectExpr("id AS x", "id % 50 AS v"), spark.range(100).selectExpr("id * 20 AS y", "id % 70 AS w")
    for out in (inequality.inequality_join(left, right, ("x", "y"), ("v", "w")), inequality.inequality_counts(left, right, ("x", "y"), ("v", "w"))):
        assert not _executed(out, "BroadcastHashJoin")


def test_nodes_are_told_without_a_broadcast(spark):
    told = inequality._answers_before(inequality._nodes(*(spark.range(500).selectExpr(f"id AS {c}", f"-id AS {d}") for c, d in ("xv", "yw")), ("x", "y"), ("v", "w")))
    assert not _executed(told, "BroadcastHashJoin")


def test_counts_post_no_row_at_each_level(spark):
    """Each row goes once to a block by each order: no Generate, which gave it an entry for each level."""
    a, b = spark.range(100).select("id", (-F.col("id")).alias("v")), spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("w"))
    plan = inequality.inequality_counts(a, b, ("id", "k"), ("v", "w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 3 and "Generate" not in plan
