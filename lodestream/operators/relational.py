"""Operators that Spark has no single call for, composed of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows are few; else the planner chooses a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark prunes each task's groups to k before the shuffle (WindowGroupLimit)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def qualify(df: DataFrame, name: str, window: Column, condition: Column) -> DataFrame:
    """QUALIFY: a window value as a column, then the rows that meet a condition on it."""
    return df.withColumn(name, window).filter(condition)


def _before(rows: DataFrame, by: Sequence[str], value: Column, reduce: str, name: str, hint: str | None = None) -> DataFrame:
    """The rows with what the bins before theirs give their key (null keys are a key): the latest value, the greatest or the sum. Bins are few rows each, so no key is large. ``hint``: of the join, where keys are many."""
    per = rows.groupBy(*by, "__bin").agg(value.alias("__value"))
    w = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"last": F.last("__value", ignorenulls=True), "max": F.max("__value"), "sum": F.sum("__value")}[reduce].over(w)
    keys = [*by, "__bin"]
    told = per.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), carry.alias(name))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(told.hint(hint) if hint else told, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, columns: Sequence[str], width: float | None = None) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its key that is not after it; null where there is none, as for a null key.

    One sort of the union by key and time and a running last value: no range join, no pairs. With a ``width`` (in the time's
    unit, seconds for timestamps) keys are cut into bins of it that are sorted apart, and each bin is told the last row before it: so a hot key is no single task.
    """
    l = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in columns))
    r = right.select(F.col(on), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__r_{c}") for c in columns))
    both = l.unionByName(r, allowMissingColumns=True)
    time = F.col("__t").cast("timestamp").cast("double") if right.schema[right_time].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col("__t").cast("double")
    both = both.withColumn("__bin", F.lit(0) if width is None else F.floor(time / width))
    w = Window.partitionBy(on, "__bin").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.struct(*(F.col(f"__r_{c}") for c in columns))
    if width is not None:
        both = _before(both, [on], F.max_by(F.when(F.col("__side") == 0, row), F.when(F.col("__side") == 0, F.col("__t"))), "last", "__carry")
    hit = F.last(F.when(F.col("__side") == 0, row), ignorenulls=True).over(w)
    hit = hit if width is None else F.coalesce(hit, F.col("__carry"))
    out = both.withColumn("__hit", F.when(F.col(on).isNotNull(), hit)).filter(F.col("__side") == 1)
    return out.select(*left.columns, *(F.col("__hit")[f"__r_{c}"].alias(c) for c in columns))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high): an equi join on bins of ``width``, so no cross product; ranges are posted in each bin they touch."""
    p = points.withColumn("__bin", F.floor(F.col(value) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__bin").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__bin")


def salted_aggregate(df: DataFrame, by: Sequence[str], aggregates: Sequence[Column], merges: Sequence[Column], salts: int = 32) -> DataFrame:
    """Two-level aggregation for aggregates that do not combine before the shuffle: a hot key is split by salt first."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return salted.groupBy(*by, "__salt").agg(*aggregates).groupBy(*by).agg(*merges)


def merge_into(target: DataFrame, source: DataFrame, on: str, update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """MERGE ... WHEN MATCHED UPDATE / WHEN NOT MATCHED INSERT as a table: one full outer join.

    ``update`` and ``insert`` give target columns from ``t.`` and ``s.`` columns.
    """
    t, s = target.alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    joined = t.withColumn("__t", F.lit(True)).alias("t").join(s, F.col(f"t.{on}") == F.col(f"s.{on}"), "full_outer")
    matched, new = F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull(), F.col("t.__t").isNull()
    return joined.select(*(F.when(matched & F.lit(c in update), update.get(c, F.lit(None))).when(new, insert.get(c, F.lit(None))).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def update_rows(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE as a projection."""
    return target.select(*(F.when(condition, values[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns))


def delete_rows(target: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... WHERE: rows of which the condition is not true, unknown included."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def update_from(target: DataFrame, source: DataFrame, on: str, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... FROM source: ``values`` give target columns from ``t.`` and ``s.`` columns, for rows whose key the source has; a key that the source has twice is an error, as it is in a MERGE."""
    twice = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("several rows of the source for "), F.col(on).cast("string")))).otherwise(F.lit(True))
    single = source.join(source.groupBy(on).agg(twice.alias("__one")), on).filter("__one").alias("s")
    joined = target.alias("t").join(single, F.col(f"t.{on}") == F.col(f"s.{on}"), "left")
    hit = F.col("s.__one").isNotNull()
    return joined.select(*(F.when(hit, values[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in values else F.col(f"t.{c}") for c in target.columns))


def delete_using(target: DataFrame, source: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... USING source WHERE: target rows that meet the condition (on ``t.`` and ``s.``) with no row of the source."""
    return target.alias("t").join(source.alias("s"), condition, "left_anti")


def hash_sample(df: DataFrame, keys: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """A repeatable Bernoulli sample: rows whose hash of keys and seed lies in the lowest ``share``; equal keys go together, any partitioning gives the same rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *keys, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.filter(h < F.lit(int(share * (1 << 32))))


def merge_ranges(df: DataFrame, by: Sequence[str], low: str, high: str, gap: int = 1, width: float | None = None) -> DataFrame:
    """Overlapping or adjacent [low, high] of a group joined: islands by a running maximum of the ends.

    With a ``width`` a group is cut into bins of its lows that are sorted apart; each bin is told the greatest end and the number of islands before it.
    """
    rows = df.withColumn("__bin", F.lit(0) if width is None else F.floor(F.col(low) / width))
    w = Window.partitionBy(*by, "__bin").orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if width is not None:
        rows = _before(rows, by, F.max(high), "max", "__end")
        before = F.greatest(before, F.col("__end"))
    rows = rows.withColumn("__new", F.when(before + gap >= F.col(low), 0).otherwise(1))
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__island", island)
    if width is not None:
        rows = _before(rows, by, F.sum("__new"), "sum", "__carry").withColumn("__island", F.col("__island") + F.coalesce("__carry", F.lit(0)))
    return rows.groupBy(*by, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first row of each key by an aggregate of a struct, which combines before the shuffle, unlike a window."""
    head = F.min(F.struct(*order, *columns)).alias("__row")
    return df.groupBy(*by).agg(head).select(*by, *(F.col(f"__row.{c}").alias(c) for c in columns))
