"""The k nearest rows by a number, with no equality key: places in the order, blocks of k, and no pairs beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import HOT_SHARE, prefix_scan
from lodestream.operators.relational import broadcast_if_small
from lodestream.sources.writers import scratch_table

SMALL_BLOCKS = 10_000  # blocks of k rows that are broadcast; beyond it they are shuffled


def _number(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v + F.lit(0.0))


def _side(asked: DataFrame, right: DataFrame, k: int, up: bool) -> DataFrame:
    """(__v, __found): the first k of the right rows at or above each value (``up``), or below it; equal values in the order of ids.

    One prefix scan over values and right rows gives each right row its place and each value the number of right rows before it. Of the blocks of k places two at most hold the
    k places that follow.
    """
    sign = F.lit(1.0 if up else -1.0)
    rows = right.select((F.col("__r") * sign).alias("__at"), F.lit(1).alias("__right"), "__id", F.col("__r").alias("__v"))
    points = asked.select((F.col("__v") * sign).alias("__at"), F.lit(0).alias("__right"), F.lit(None).cast(right.schema["__id"].dataType).alias("__id"), "__v")
    first = F.col("__right") if up else -F.col("__right")  # going up equal values count as found, going down they were
    scanned, _ = scratch_table(asked.sparkSession, prefix_scan(rows.unionByName(points), ["__at", first, "__id"], {"__upto": F.col("__right").cast("long")}, "__place"))
    placed = scanned.filter("__right = 1").select((F.col("__upto") - 1).alias("__p"), F.col("__v").alias("__r"), "__id")
    blocks = placed.groupBy(F.floor(F.col("__p") / k).alias("__block")).agg(F.collect_list(F.struct("__p", "__r", "__id")).alias("__rows"))
    wanted = scanned.filter("__right = 0").select("__v", F.col("__upto").alias("__from"))
    wanted = wanted.withColumn("__block", F.explode(F.array_distinct(F.array(F.floor(F.col("__from") / k), F.floor((F.col("__from") + (k - 1)) / k)))))
    near = F.filter("__rows", lambda x: (x["__p"] >= F.col("__from")) & (x["__p"] < F.col("__from") + k))
    return wanted.join(broadcast_if_small(blocks, SMALL_BLOCKS), "__block").select("__v", near.alias("__found"))


def nearest(left: DataFrame, right: DataFrame, left_value: str, right_value: str, right_id: str, k: int) -> DataFrame:
    """``left`` with ``rank`` (from 1), ``neighbour`` and ``distance`` of the k rows of ``right`` whose values are nearest, ties by ``right_id``; fewer where ``right`` has fewer.

    Rows of the left whose value is null, NaN or infinite have no neighbours and are left out; such rows of the right are nobody's. Rows of one id are neighbours of their own. Values are compared as doubles.
    Equal values of the left are asked once; the answer goes back by the value, broadcast for values that hold a thousandth of the rows at least (a thousand at
    most), shuffled for the others. The k nearest lie among the k next at or above and the k next below, so no round is repeated.
    """
    spark = left.sparkSession
    rows = left.withColumn("__v", _number(left_value)).filter("__v IS NOT NULL")
    values, _ = scratch_table(spark, rows.groupBy("__v").agg(F.count("*").alias("__n")))
    total = values.agg(F.sum("__n")).first()[0] or 0
    told = right.select(_number(right_value).alias("__r"), F.col(right_id).alias("__id")).filter("__r IS NOT NULL")
    both = _side(values, told, k, True).unionByName(_side(values, told, k, False))
    gathered = both.groupBy("__v").agg(F.flatten(F.collect_list("__found")).alias("__found"))  # four blocks of k at most
    by_distance = F.array_sort(F.transform("__found", lambda x: F.struct(F.abs(x["__r"] - F.col("__v")).alias("distance"), x["__id"].alias("neighbour"))))
    answers, _ = scratch_table(spark, gathered.join(values, "__v").select(F.col("__v").alias("__key"), "__n", F.slice(by_distance, 1, k).alias("__near")))
    hot, same = F.col("__n") * HOT_SHARE >= total, F.col("__v") == F.col("__key")
    frequent = F.broadcast(answers.filter(hot))
    parts = rows.join(frequent, same).unionByName(rows.join(frequent.select("__key"), same, "left_anti").join(answers.filter(~hot), same))
    out = parts.select(*left.columns, F.posexplode("__near").alias("__rank", "__near"))
    return out.select(*left.columns, (F.col("__rank") + 1).alias("rank"), F.col("__near.neighbour").alias("neighbour"), F.col("__near.distance").alias("distance"))
