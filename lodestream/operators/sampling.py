"""Samples of an exact size a stratum, as states that merge: priority sampling by the bottom of a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = "__priority"


def unit_hash(keys: Sequence[str], seed: int = 0) -> Column:
    """A number above 0 and up to 1, from 32 bits of the MD5 of keys and seed: equal for equal keys, whatever the partitions. A null key counts as an empty text."""
    text = F.concat_ws("-", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / F.lit(float(1 << 32))


def sample_state(df: DataFrame, keys: Sequence[str], k: int, by: Sequence[str] = (), weight: Column | None = None, seed: int = 0) -> DataFrame:
    """The ``k + 1`` rows of each stratum with the greatest priority, weight / hash; ties in the order of keys. ``keys`` tell the rows of a stratum apart.

    The state of a union is that of the united states (``merge``), so it can be stored by day and rolled up. Rows whose weight is null or not above zero have no share in a total
    and are never drawn. Spark cuts each task's strata to ``k + 1`` rows before it shuffles them, so a hot stratum costs no more than tasks times ``k + 1``.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.withColumn("__weight", w).filter("__weight > 0 AND NOT isnan(__weight)").withColumn(PRIORITY, F.col("__weight") / unit_hash(keys, seed))
    return _cut(rows, keys, k, by)


def _cut(rows: DataFrame, keys: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    strata = [F.col(c) for c in by] or [F.lit(1)]
    order = Window.partitionBy(*strata).orderBy(F.col(PRIORITY).desc(), *keys)
    return rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k + 1)


def merge(states: Sequence[DataFrame], keys: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """The state of all rows from states of disjoint parts of them, each made with the same ``k``, weight and seed."""
    united = states[0]
    for other in states[1:]:
        united = united.unionByName(other)
    return _cut(united.drop("__rank"), keys, k, by)


def draw(state: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The sample: min(k, rows) of each stratum, with ``stands_for``, the weight that each stands for.

    That is the greater of its own weight and the priority of the first row left out (nothing where none was). Sums of ``stands_for`` over any part of the
    sample estimate that part's total weight without bias; for equal weights it is the number of rows stood for.
    """
    strata = [F.col(c) for c in by] or [F.lit(1)]
    left_out = F.max(F.when(F.col("__rank") == k + 1, F.col(PRIORITY))).over(Window.partitionBy(*strata))
    marked = state.withColumn("stands_for", F.greatest("__weight", F.coalesce(left_out, F.lit(0.0))))
    return marked.filter(F.col("__rank") <= k).drop("__rank", "__weight", PRIORITY)
