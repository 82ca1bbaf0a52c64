import datetime as dt

from pyspark.sql import functions as F

from lodestream.operators import graph, relational


def sets(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_asof_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c"), (3, 1, "d")], "k int, u int, v string")
    assert sets(relational.asof_join(left, right, "k", "t", "u", ["v"])) == sorted([(1, 5, "b"), (1, 1, None), (2, 9, None), (None, 3, None)], key=str)


def test_merge_update_delete(spark):
    t = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    s = spark.createDataFrame([(2, 5.0), (3, 7.0)], "k int, v double")
    assert sets(relational.merge_into(t, s, "k", {"v": F.col("s.v")}, {"k": F.col("s.k"), "v": F.col("s.v")})) == [(1, 1.0), (2, 5.0), (3, 7.0)]
    assert sets(relational.update_rows(t, F.col("k") == 2, {"v": F.lit(0)})) == [(1, 1.0), (2, 0.0)]
    assert sets(relational.delete_rows(spark.createDataFrame([(1,), (None,)], "k int"), F.col("k") == 1)) == [(None,)]


def test_ranges_join_without_pairs(spark):
    points = spark.createDataFrame([(0.5,), (9.5,), (10.0,)], "x double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 9.0, 30.0)], "n string, lo double, hi double")
    assert sorted((r.x, r.n) for r in relational.range_join(points, ranges, "x", "lo", "hi", 4.0).collect()) == [(0.5, "a"), (9.5, "a"), (9.5, "b"), (10.0, "b")]


def test_salted_aggregate_equals_the_plain_one(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = relational.salted_aggregate(df, ["k"], [F.collect_set("v").alias("s")], [F.sum(F.size("s")).alias("n")])
    assert sets(got) == sets(df.groupBy("k").agg(F.countDistinct("v").alias("n")))


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 1, "a")], "k int, t int, v string")
    assert sets(relational.first_per_key(df, ["k"], ["t"], ["v"])) == [(1, "b"), (2, "a")]


def test_components_of_a_path_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(40)]
    got = dict(sets(graph.components(spark.createDataFrame([*path, (100, 101), (101, 102), (102, 100)], "a long, b long"), "a", "b")))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_layers_end_in_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "s string, t string")
    got = dict(sets(graph.layers(e.select(F.col("s").alias("node")).union(e.select("t")), e, "s", "t")))
    assert (got["a"], got["b"], got["c"]) == (0, 1, 2)


def test_streams_equal_batches(spark, tmp_path):
    from lodestream.streaming import events as stream

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.event_stream(spark, str(tmp_path / "in"), df.schema)
    got = stream.run_available(stream.tumbling(source, "1 hour"), "update").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
    assert sets(got) == sets(want)


def test_hot_keys_are_cut_into_bins(spark):
    import random

    from lodestream.operators.relational import asof_join, merge_ranges

    rng = random.Random(5)
    left = [(rng.choice("aab"), rng.randint(0, 1000), i) for i in range(300)]
    right = [(rng.choice("aac"), t, f"v{t}") for t in rng.sample(range(1000), 120)]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    whole = asof_join(df(left, "k string, t long, i long"), df(right, "k string, s long, v string"), "k", "t", "s", ["v"])
    cut = asof_join(df(left, "k string, t long, i long"), df(right, "k string, s long, v string"), "k", "t", "s", ["v"], width=37)
    want = sorted((k, t, i, max((s, v) for q, s, v in right if q == k and s <= t)[1] if any(q == k and s <= t for q, s, _ in right) else None) for k, t, i in left)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(want, key=str) == sorted(map(tuple, cut.collect()), key=str)
    ranges = df([(rng.choice(["a", "a", "b", None]), lo, lo + rng.choice([0, 3, 60])) for lo in (rng.randint(0, 2000) for _ in range(200))], "k string, lo long, hi long")
    assert sorted(map(tuple, merge_ranges(ranges, ["k"], "lo", "hi").collect()), key=str) == sorted(map(tuple, merge_ranges(ranges, ["k"], "lo", "hi", width=50).collect()), key=str)
