"""Whole-table order in two passes: positions, running sums, ranks, tiles and pages, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources.writers import scratch_table

HOT_SHARE = 1000  # keys that hold at least one in so many rows are broadcast: there are at most so many of them


def prefix_scan(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column] | None = None, position: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in the order, and running sums of ``sums`` down to it (null counts as zero).

    First pass: rows are dealt over ranges of the order, cut at sampled points, and written with the number of their range. The driver gets a count and the sums of
    each range, a row a partition, and hands back what lies before it. Second pass: each range is sorted and numbered apart from the others. The order should be total: rows
    equal in all of it come in any order among themselves, and all in one range (``ranks`` takes ties of any number). Null keys come first in ascending order.
    """
    spark, sums = df.sparkSession, dict(sums or {})
    held = [f"__sum_{i}" for i in range(len(sums))]
    rows = df.select("*", *(F.coalesce(c, F.lit(0)).alias(h) for h, c in zip(held, sums.values(), strict=True)))
    ranged, _ = scratch_table(spark, rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    of_range = ranged.groupBy("__range").agg(F.count("*").alias("__n"), *(F.sum(h).alias(h) for h in held))
    per_range = sorted(of_range.collect())
    before, told = [type(x)(0) for x in per_range[0][1:]] if per_range else [], []
    for r in per_range:
        told.append((r[0], *before))
        before = [a + b for a, b in zip(before, r[1:], strict=True)]
    schema = ", ".join(["__range int", "__before long", *(f"__before{h} {of_range.schema[h].dataType.simpleString()}" for h in held)])
    offsets = F.broadcast(spark.createDataFrame(told, schema))  # one row a range
    here = Window.partitionBy("__range").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(offsets, "__range").withColumn(position, F.row_number().over(here) + F.col("__before"))
    out = out.withColumns({name: F.sum(h).over(upto) + F.col(f"__before{h}") for name, h in zip(sums, held, strict=True)})
    return out.drop("__range", "__before", *held, *(f"__before{h}" for h in held))


def ranks(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """``df`` with ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` of ``by`` over the whole table; nulls are peers and come first (last if descending).

    Distinct values are counted first and scanned, so ties of any number are one row there. The numbers go back to the rows by the value: those of values that hold a
    thousandth of the rows at least are broadcast (at most a thousand), others shuffled, so no join key is hot.
    """
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    counted = df.groupBy(by).agg(F.count("*").alias("__n"))
    scanned, _ = scratch_table(df.sparkSession, prefix_scan(counted, [order], {"__upto": F.col("__n")}, "dense_rank"))
    total = scanned.agg(F.sum("__n")).first()[0] or 0
    first = F.col("__upto") - F.col("__n")
    told = scanned.select(F.col(by).alias("__key"), "__n", (first + 1).alias("rank"), "dense_rank", (first / F.lit(max(total - 1, 1))).alias("percent_rank"), (F.col("__upto") / F.lit(max(total, 1))).alias("cume_dist"))
    hot = F.col("__n") * HOT_SHARE >= total
    same = F.col(by).eqNullSafe(F.col("__key"))
    frequent = F.broadcast(told.filter(hot))
    parts = [df.join(frequent, same), df.join(frequent.select("__key"), same, "left_anti").join(told.filter(~hot), same)]
    return parts[0].unionByName(parts[1]).drop("__key", "__n")


def tiles(df: DataFrame, order: Sequence[str | Column], n: int, name: str = "tile") -> DataFrame:
    """NTILE(n) over the whole table: sizes differ by one at most, the larger tiles come first."""
    placed, _ = scratch_table(df.sparkSession, prefix_scan(df, order, position="__at"))
    size, larger = divmod(placed.count(), n)
    at, edge = F.col("__at") - 1, larger * (size + 1)
    tile = F.when(at < edge, F.floor(at / F.lit(size + 1))).otherwise(larger + F.floor((at - edge) / F.lit(max(size, 1)))) + 1
    return placed.withColumn(name, tile.cast("int")).drop("__at")


def page(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int | None = None) -> DataFrame:
    """OFFSET and LIMIT in the order: rows that are skipped are not gathered."""
    at = F.col("__at") > offset
    if limit is not None:
        at &= F.col("__at") <= offset + limit
    return prefix_scan(df, order, position="__at").filter(at).drop("__at")


def quantile_cont(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): exact interpolated percentiles of the values that are not null, by their places; no rows where there is none."""
    rows = df.select(F.col(value).cast("double").alias("__v")).filter("__v is not null")
    placed, _ = scratch_table(df.sparkSession, prefix_scan(rows, ["__v"], position="__at"))
    last = placed.count() - 1
    wanted = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(s * max(last, 0)).alias("__place")) for s in shares))).alias("w")
    places = sorted({k for s in shares for k in (int(s * max(last, 0)) + 1, min(int(s * max(last, 0)) + 1, last) + 1)})
    near = placed.filter(F.col("__at").isin(places)).groupBy("__at").agg(F.first("__v").alias("__v"))
    low, high = F.floor("__place"), F.least(F.floor("__place") + 1, F.lit(last))
    asked = near.select(F.lit(1).alias("__one")).limit(1).select(wanted).select("w.*")
    both = asked.join(F.broadcast(near), (F.col("__at") == low + 1) | (F.col("__at") == high + 1))
    a, b = F.max(F.when(F.col("__at") == low + 1, F.col("__v"))), F.max(F.when(F.col("__at") == high + 1, F.col("__v")))
    return both.groupBy("share", "__place").agg(a.alias("a"), b.alias("b")).select("share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("__place") - F.floor("__place"))).alias("value"))
