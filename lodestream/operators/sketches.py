"""Distinct counts and percentiles as stored states that merge (HLL and KLL), and exact percentiles of groups for which a sketch bounds the rows to sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import prefix_scan
from lodestream.sources.writers import scratch_table

LG_CELLS = 14  # HLL: a standard error of 1.04 / sqrt(2^14), some 0.8 per cent
KLL_K = 800  # KLL: ranks off by 0.4 per cent at a confidence of 99 per cent
SLACK = 0.01  # share of ranks on each side of the wanted one that is sorted
BROADCAST_GROUPS = 50_000  # groups whose bounds are broadcast; beyond it they are joined by a shuffle


def sketch(df: DataFrame, keys: Sequence[str], distinct: str | None = None, quantiles: str | None = None) -> DataFrame:
    """(keys, n_states, distinct_state, quantile_state) of each group, to be stored; nulls and NaN count in neither. A column without a name has no state."""
    made = [F.count(F.lit(1)).alias("__rows")]
    if distinct:
        made.append(F.hll_sketch_agg(distinct, F.lit(LG_CELLS)).alias("distinct_state"))
    if quantiles:
        made.append(F.kll_sketch_agg_double(_number(quantiles), F.lit(KLL_K)).alias("quantile_state"))
    return df.groupBy(*keys).agg(*made).withColumn("n_states", F.lit(1).cast("long")).drop("__rows")


def roll_up(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser groups from stored ones, without the rows; ``n_states`` counts the stored states in each. Rolling up in steps gives the same groups."""
    merged = [F.sum("n_states").alias("n_states")]
    if "distinct_state" in states.columns:
        merged.append(F.hll_union_agg("distinct_state").alias("distinct_state"))
    if "quantile_state" in states.columns:
        merged.append(F.kll_merge_agg_double("quantile_state", F.lit(KLL_K)).alias("quantile_state"))
    return states.groupBy(*keys).agg(*merged)


def estimates(states: DataFrame, shares: Sequence[float] = (0.5,)) -> DataFrame:
    """The states' groups with ``n_distinct``, and with ``quantiles`` (an array in the order of ``shares``; null for a group without values)."""
    out = states
    if "distinct_state" in states.columns:
        out = out.withColumn("n_distinct", F.hll_sketch_estimate("distinct_state")).drop("distinct_state")
    if "quantile_state" in states.columns:
        out = out.withColumn("quantiles", _quantiles(shares)).drop("quantile_state")
    return out


def _number(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def _quantiles(shares: Sequence[float]) -> Column:
    some = F.kll_sketch_get_n_double("quantile_state") > 0
    return F.when(some, F.array(*(F.kll_sketch_get_quantile_double("quantile_state", F.lit(float(s))) for s in shares)))


def _with(rows: DataFrame, groups: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Rows joined with their group's columns; null keys meet."""
    told = groups.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys), F.lit(True))
    return rows.join(F.broadcast(told) if few else told, same).drop(*(f"__of_{k}" for k in keys))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, share, value, n): exact interpolated percentiles of each group (value null where it has none), n the group's values; nulls and NaN do not count.

    First pass: a KLL state a group gives, for each share, two values a per cent of the ranks below and above it. Second pass: values below are counted, values between
    are counted one by one, both before the shuffle; those between are the few that are sorted, by a prefix scan over all groups, so that no group lies in one task. Where the sketch was
    wrong, which its confidence allows, the wanted rank lies outside of the counted values, and these groups are counted whole. Bounds are broadcast up to ``BROADCAST_GROUPS``, counted first.
    """
    spark = df.sparkSession
    rows = df.select(*keys, _number(value).alias("__v"))
    first, _ = scratch_table(spark, rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.kll_sketch_agg_double("__v", F.lit(KLL_K)).alias("quantile_state")))
    bounds = [x for s in shares for x in (max(s - SLACK, 0.0), min(s + SLACK, 1.0))]
    asked = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(2 * i).alias("at")) for i, s in enumerate(shares)))
    wanted = first.withColumn("__q", _quantiles(bounds)).select(*keys, "__n", "__q", F.explode(asked).alias("__a"))
    place = F.col("__a.share") * (F.col("__n") - 1)
    wanted, _ = scratch_table(spark, wanted.select(*keys, "__n", F.col("__a.share").alias("share"), F.floor(place).alias("__low"), (place - F.floor(place)).alias("__part"), F.get("__q", F.col("__a.at")).alias("__from"), F.get("__q", F.col("__a.at") + 1).alias("__to")))
    group = [*keys, "share"]
    found, missed = _picked(rows, wanted.filter("__n > 0"), keys)
    if not missed.isEmpty():
        whole = missed.withColumn("__from", F.lit(float("-inf"))).withColumn("__to", F.lit(float("inf")))
        found = found.unionByName(_picked(rows, whole, keys)[0])
    empty = wanted.filter("__n = 0").select(*group, F.lit(None).cast("double").alias("value"), F.col("__n").alias("n"))
    return found.select(*group, "value", F.col("__n").alias("n")).unionByName(empty)


def _picked(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(groups with their value, groups whose ranks lie outside of their bounds)."""
    group = [*keys, "share"]
    few = wanted.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    near = _with(rows.filter("__v IS NOT NULL"), wanted.select(*group, "__from", "__to"), keys, few).filter("__v <= __to")
    # values below the bounds share one row a group
    counted, _ = scratch_table(rows.sparkSession, near.groupBy(*group, F.when(F.col("__v") >= F.col("__from"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__count")))
    scanned, _ = scratch_table(rows.sparkSession, prefix_scan(counted, [*group, "__v"], {"__upto": F.col("__count")}, "__at"))
    before = scanned.groupBy(*group).agg(F.min(F.col("__upto") - F.col("__count")).alias("__before"))
    placed = _with(scanned, _with(wanted, before, group, few), group, few)
    upto = F.col("__upto") - F.col("__before")
    from_ = upto - F.col("__count")
    holds = lambda rank: (from_ <= rank) & (upto > rank)
    high = F.least(F.col("__low") + 1, F.col("__n") - 1)
    ends = placed.groupBy(*group, "__n", "__low", "__part", "__from", "__to").agg(F.max(F.when(holds(F.col("__low")), F.col("__v"))).alias("__a"), F.max(F.when(holds(high), F.col("__v"))).alias("__b"))
    ends, _ = scratch_table(rows.sparkSession, ends)
    sure = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return ends.filter(sure).withColumn("value", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")), ends.filter(~sure).drop("__a", "__b")
