"""Groupings over a lattice against plain Python: nulls in dimensions and values, hot groups, empty tables, what is shuffled."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestream.operators import lattice

MEASURES = {"s": ("sum", "v"), "mean": ("avg", "v"), "var": ("variance", "v"), "d": ("distinct", "v"), "near": ("approx_distinct", "v"), "low": ("min", "v"), "n": ("count", "v")}


def made(n, seed=3):
    rng = random.Random(seed)
    hot = lambda k: None if rng.random() < 0.1 else 0 if rng.random() < 0.4 else rng.randrange(k)
    return [(hot(3), hot(4), hot(2), None if rng.random() < 0.2 else rng.randrange(1_000_000, 1_000_030)) for _ in range(n)]


def plain(rows, dims, sets):
    out = {}
    for g in sets:
        gid = sum((d not in g) << (len(dims) - 1 - i) for i, d in enumerate(dims))
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[i] if d in g else None for i, d in enumerate(dims)), []).append(r[-1])
        for k, vs in groups.items():
            v = [x for x in vs if x is not None]
            out[(*k, gid)] = (sum(v) if v else None, statistics.fmean(v) if v else None, statistics.variance(v) if len(v) > 1 else None, len(set(v)), len(set(v)), min(v, default=None), len(v))
    return out


@pytest.mark.parametrize("n", [0, 1, 400])
def test_cube_equals_plain_groups(spark, n):
    rows = made(n)
    df = spark.createDataFrame(rows, "a int, b int, c int, v long").repartition(5)
    sets = lattice.cube_sets("abc") if n else []
    got = {tuple(r[:4]): tuple(r[4:]) for r in lattice.cube(df, list("abc"), MEASURES).collect()}
    want = plain(rows, "abc", sets)
    assert got.keys() == want.keys()
    for k, w in want.items():
        # estimates of few values are exact in practice; a group without values has no sketch of any
        assert [x if x is None else pytest.approx(x, rel=1e-9, abs=1e-6) for x in w] == list(got[k]), k


def test_grouping_sets_without_a_common_parent(spark):
    rows = made(200, 5)
    df = spark.createDataFrame(rows, "a int, b int, c int, v long")
    sets = [("b", "a"), ("c",), ("a",), ("a",), ()]
    got = {tuple(r[:4]): r.n for r in lattice.grouping_sets(df, list("abc"), sets, {"n": ("count", "v")}).collect()}
    assert got == {k: w[-1] for k, w in plain(rows, "abc", [tuple(sorted(s)) for s in sets]).items()}
    with pytest.raises(ValueError):
        lattice.cube(df, ["a"], {"m": ("median", "v")})
    with pytest.raises(ValueError):
        lattice.cube(df, ["a"], {"a": ("sum", "v")})


def shuffled(spark, action):
    """Rows written to shuffles by an action."""
    store = spark.sparkContext._jsc.sc().statusStore()
    array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    none = spark.sparkContext._jvm.java.util.ArrayList

    def total():
        stages = store.stageList(none(), False, False, array, none())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_fewer_rows_are_shuffled_than_by_expand(spark):
    dims = list("abcde")
    df = spark.range(40_000).select(*((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(7)) + F.lit(0)).alias(d) for i, d in enumerate(dims)), "id")
    by_lattice = shuffled(spark, lambda: lattice.cube(df, dims, {"n": ("count", "id")}).count())
    by_expand = shuffled(spark, lambda: df.cube(*dims).agg(F.count("id")).write.format("noop").mode("overwrite").save())
    assert 0 < by_lattice < by_expand / 2
