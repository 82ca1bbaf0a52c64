"""Merged sketches against exact counts, and exact percentiles of groups against plain Python: nulls, NaN, ties, hot groups, wrong bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import sketches


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else rng.choice("abc")
        v = None if rng.random() < 0.1 else math.nan if rng.random() < 0.05 else 7.0 if rng.random() < 0.3 else rng.uniform(-50, 50)
        out.append((key, v))
    return [*out, ("none", None)]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("slack", [0.01, 0.0])
def test_percentiles_are_exact(spark, monkeypatch, few, slack):
    monkeypatch.setattr(sketches, "SLACK", slack)  # without slack many ranks lie outside of their bounds
    monkeypatch.setattr(sketches, "BROADCAST_GROUPS", 1000 if few else 0)
    rows, shares = made(3000), [0.0, 0.3, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {(r.k, r.share): (r.value, r.n) for r in sketches.percentiles(df, ["k"], "v", shares).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = [x for g, x in rows if g == k and x is not None and not math.isnan(x)]
        want |= {(k, s): (pytest.approx(float(np.quantile(v, s)), rel=1e-9) if v else None, len(v)) for s in shares}
    assert got == want


def test_percentiles_of_an_empty_table(spark):
    assert sketches.percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).collect() == []


def test_stored_states_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("user"), F.col("id").cast("double").alias("v"))
    daily = sketches.sketch(df, ["day", "g"], "user", "v")
    steps = sketches.roll_up(sketches.roll_up(daily.withColumn("week", F.floor(F.col("day") / 7)), ["week", "g"]), ["g"])
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("user").alias("n")).collect()}
    for r in sketches.estimates(steps, [0.1, 0.5]).collect():
        assert r.n_states == 15 and abs(r.n_distinct - exact[r.g]) <= 4 * 0.0082 * exact[r.g]
        assert all(abs(q / 60_000 - s) <= 0.02 for q, s in zip(r.quantiles, (0.1, 0.5), strict=True))


def test_groups_without_values_have_states(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, 2.0)], "k string, u long, v double")
    got = {r.k: (r.n_distinct, r.quantiles) for r in sketches.estimates(sketches.roll_up(sketches.sketch(df, ["k"], "u", "v"), ["k"])).collect()}
    assert got == {"a": (0, None), "b": (1, [2.0])}
