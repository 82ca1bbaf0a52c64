"""Joins without an equality key: two inequalities, and intervals that overlap."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import prefix_scan
from lodestream.operators.relational import _before
from lodestream.sources.package import ship
from lodestream.sources.writers import scratch_table

BIN = 1 << 16  # places in one order that one task sorts at once
CHUNK = 256  # answering rows that an asking row meets together
BROADCAST_ROWS = 200_000  # posted cells up to which they are broadcast
LEVELS = 62  # of dyadic cells over whole numbers of 64 bits, sign and one bit to spare


def _placed(left: DataFrame, right: DataFrame, earlier: tuple[str, str], larger: tuple[str, str]) -> DataFrame:
    """Rows of both sides with their places from 0: (__left, __right, __side, __at, __y), written.

    All rows are placed by x, then by y from the largest down; of equal values left rows come first, which makes both comparisons strict: a left row's partners are the right rows before it in both.
    """
    l = left.select(F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.schema).alias("__right"), F.col(earlier[0]).alias("__x"), F.col(larger[0]).alias("__v"), F.lit(0).alias("__side"))
    r = right.select(F.lit(None).cast(left.schema).alias("__left"), F.struct(*right.columns).alias("__right"), F.col(earlier[1]).alias("__x"), F.col(larger[1]).alias("__v"), F.lit(1).alias("__side"))
    both = l.unionByName(r).filter("__x is not null and __v is not null")
    by_x = prefix_scan(both, ["__x", "__side", F.xxhash64("__left", "__right")], position="__at").drop("__x")
    by_y = prefix_scan(by_x, [F.col("__v").desc(), "__side", "__at"], position="__y")
    return scratch_table(left.sparkSession, by_y.select("__left", "__right", "__side", (F.col("__at") - 1).alias("__at"), (F.col("__y") - 1).alias("__y")))[0]


def _nodes(left: DataFrame, right: DataFrame, earlier: tuple[str, str], larger: tuple[str, str]) -> DataFrame:
    """Rows of both sides at each level where they can meet: (__left, __right, __level, __node, __y).

    The places by x make a binary tree: a left row follows a right one in x exactly if in one node, at one level, it lies in the second half and the right one in the first. So a row has
    one entry a level, as one that asks (left row, second half) or one that answers (right row, first half), and in a node only y remains to be compared.
    """
    placed = _placed(left, right, earlier, larger)
    depth = max(1, int(placed.count() - 1).bit_length())
    half = F.call_function("shiftright", F.col("__at"), F.col("__level")).bitwiseAND(F.lit(1))
    posted = placed.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).filter(half == 1 - F.col("__side"))
    return posted.select("__left", "__right", "__level", F.expr("shiftright(__at, __level + 1)").alias("__node"), "__y")


def _answers_before(nodes: DataFrame) -> DataFrame:
    """The entries with the number of answering rows of their node down to their place by y: sorted in bins, each told what the bins before it hold."""
    answers = F.col("__right").isNotNull().cast("long")
    binned = nodes.withColumn("__bin", F.floor(F.col("__y") / BIN)).withColumn("__answer", answers)
    binned, _ = scratch_table(nodes.sparkSession, binned)
    told = _before(binned, ["__level", "__node"], F.sum("__answer"), "sum", "__carry", "merge")
    here = Window.partitionBy("__level", "__node", "__bin").orderBy("__y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told.withColumn("__k", F.sum("__answer").over(here) + F.coalesce("__carry", F.lit(0)))


def dominated(a: np.ndarray, y: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Of each row the number of answering rows that are less in both ``a`` (may be equal among rows) and ``y`` (differs): the tree of ``_nodes`` over one block."""
    by_y = np.argsort(y)
    rank = np.unique(a[by_y], return_inverse=True)[1]
    rank = rank.astype(np.uint16 if len(rank) <= 1 << 16 else np.uint32)  # narrow numbers are sorted by digits
    answers, out = answers[by_y], np.zeros(len(a), np.int64)
    for level in range(int(rank.max(initial=0)).bit_length()):
        second, node = rank >> level & 1 == 1, rank >> level >> 1
        order = np.argsort(node, kind="stable")
        node, told = node[order], np.cumsum(answers[order] & ~second[order])
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        before = np.repeat(np.r_[0, told][first], np.diff(np.r_[first, len(node)]))
        n = np.empty(len(a), np.int64)
        n[order] = told - before
        out += np.where(second, n, 0)
    back = np.empty(len(a), np.int64)
    back[by_y] = out
    return back


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _before_in_cells(columns: int) -> Callable[[pa.Table], pa.Table]:
    """Of a row of cells, for each column that follows one with rows: how many rows the columns before it hold."""

    def run(cells: pa.Table) -> pa.Table:
        x, n = _numbers(cells, "__xb", "__n")
        held = np.zeros(columns + 1, np.int64)
        held[x + 1] = n
        upto = np.cumsum(held)[:-1]
        at = np.flatnonzero(upto)
        return pa.table({"__xb": at, "__yb": np.full(len(at), cells["__yb"][0].as_py(), np.int64), "__n": upto[at]})

    return run


def _in_column(rows: pa.Table) -> pa.Table:
    """Of each asking row of a block by x: the answering rows before it in the block and in all cells before its own."""
    side, at, y, row, n = _numbers(rows, "__side", "__at", "__y", "__yb", "__n")
    cell = side == 2
    held = np.zeros(int(row.max()) + 2, np.int64)
    held[row[cell] + 1] = n[cell]
    side, at, y, row = (v[~cell] for v in (side, at, y, row))
    found = (dominated(at, y, side == 1) + np.cumsum(held)[row])[side == 0]
    return pa.table({"__at": at[side == 0], "__n": found})


def _in_row(rows: pa.Table) -> pa.Table:
    """Of each asking row of a block by y: the answering rows before it in the block that lie in an earlier block by x."""
    side, at, y, column = _numbers(rows, "__side", "__at", "__y", "__xb")
    return pa.table({"__at": at[side == 0], "__n": dominated(column, y, side == 1)[side == 0]})


def inequality_counts(left: DataFrame, right: DataFrame, earlier: tuple[str, str], larger: tuple[str, str], name: str = "n") -> DataFrame:
    """Each left row with the number of right rows whose first column is less (``earlier``: left's, right's) and whose second is greater (``larger``).

    Places by x and by y are cut into blocks, which make a grid of at most as many cells as rows. What a row asks for lies in its own block by x, in its own block by y and earlier by x, or in
    cells before its own in both; the blocks are counted each in a task, the cells by sums. So each row is shuffled a fixed number of times, whatever the number of pairs: no pair is made.
    Rows with a null in a compared column match nothing; repeated rows count each.
    """
    spark = left.sparkSession
    ship(spark)
    placed = _placed(left, right.select(earlier[1], larger[1]), earlier, larger)
    total = placed.count()
    block = max(BIN, math.isqrt(total) + 1)
    rows = placed.select("__side", "__at", "__y", F.expr(f"__at div {block}").alias("__xb"), F.expr(f"__y div {block}").alias("__yb"))
    cells = rows.filter("__side = 1").groupBy("__xb", "__yb").agg(F.count("*").alias("__n"))
    upto = cells.groupBy("__yb").applyInArrow(_before_in_cells(total // block + 1), "__xb long, __yb long, __n long")
    none = F.lit(0).cast("long")
    by_x = rows.withColumn("__n", none).unionByName(upto.select(F.lit(2).alias("__side"), none.alias("__at"), none.alias("__y"), "__xb", "__yb", "__n"))
    parts = by_x.groupBy("__xb").applyInArrow(_in_column, "__at long, __n long").unionByName(rows.groupBy("__yb").applyInArrow(_in_row, "__at long, __n long"))
    counts = parts.groupBy("__at").agg(F.sum("__n").alias(name))
    counted = placed.filter("__side = 0").select("__at", "__left").join(counts.hint("merge"), "__at").select("__left.*", name)
    unmatched = left.filter(F.col(earlier[0]).isNull() | F.col(larger[0]).isNull()).withColumn(name, none)
    return counted.unionByName(unmatched)


def inequality_join(left: DataFrame, right: DataFrame, earlier: tuple[str, str], larger: tuple[str, str]) -> DataFrame:
    """All pairs (left columns, right columns; their names must differ) where right's first column is less and its second greater.

    In a node of ``_nodes`` an asking row matches the first k answering rows by y, and nothing else. These are numbered and cut into chunks; an asking row goes once to each chunk that it
    reaches and makes its pairs there, so what is shuffled is the rows at each level and a ``CHUNK``-th of the pairs. In vain it meets fewer than ``CHUNK`` rows a level.
    """
    told, _ = scratch_table(left.sparkSession, _answers_before(_nodes(left, right, earlier, larger)))
    chunk = F.expr(f"(__k - 1) div {CHUNK}")
    answers = told.filter("__right is not null").select("__level", "__node", F.col("__k").alias("__number"), chunk.alias("__chunk"), "__right")
    asks = told.filter("__left is not null and __k > 0").select("__level", "__node", "__left", "__k", F.explode(F.sequence(F.lit(0).cast("long"), chunk)).alias("__chunk"))
    return asks.join(answers.hint("merge"), ["__level", "__node", "__chunk"]).filter("__number <= __k").select("__left.*", "__right.*")


def _cells(low: Column, high: Column, top: int = LEVELS) -> Column:
    """The dyadic cells (level, cell) that make up [low, high): at most two a level, none overlaps another.

    At a level the whole cells of its size that fit reach from the rounded-up low to the rounded-down high; the first of them belongs to this level if it is odd, and so does the last but one bound.
    """

    def at(level: Column) -> Column:
        first, end = -F.call_function("shiftright", -low, level), F.call_function("shiftright", high, level)
        odd_first, odd_end = first.bitwiseAND(F.lit(1)) == 1, end.bitwiseAND(F.lit(1)) == 1
        left = F.when((first < end) & odd_first, F.struct(level.alias("level"), first.alias("cell")))
        rest = first + F.when(odd_first, 1).otherwise(0)
        right = F.when((rest < end) & odd_end, F.struct(level.alias("level"), (end - 1).alias("cell")))
        return F.filter(F.array(left, right), lambda c: c.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))


def stab_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Points in [low, high), whole numbers of any size: an equality join of the point's cell at each level in use with the intervals' dyadic cells.

    An interval of any length has at most two cells a level, and a point lies in one cell of an interval at most, so a pair comes once. Empty and null intervals and null points match nothing.
    """
    posted = intervals.filter(F.col(low) < F.col(high)).withColumn("__c", F.explode(_cells(F.col(low).cast("long"), F.col(high).cast("long"))))
    posted = posted.withColumn("__level", F.col("__c.level")).withColumn("__cell", F.col("__c.cell")).drop("__c")
    posted, _ = scratch_table(points.sparkSession, posted)
    levels = sorted(r[0] for r in posted.select("__level").distinct().collect())  # at most LEVELS + 1 numbers
    level = F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.expr("array_remove(array(0), 0)")).alias("__level")
    asked = points.filter(F.col(at).isNotNull()).select("*", level).withColumn("__cell", F.call_function("shiftright", F.col(at).cast("long"), F.col("__level")))
    # a file's size says little of its rows in memory: a broadcast only of rows that were counted
    posted = posted.hint("broadcast" if posted.count() <= BROADCAST_ROWS else "merge")
    return asked.join(posted, ["__level", "__cell"]).drop("__level", "__cell")


def overlap_join(left: DataFrame, right: DataFrame, left_span: Sequence[str], right_span: Sequence[str]) -> DataFrame:
    """Pairs of intervals [low, high) of whole numbers that overlap, each once; column names must differ.

    Two intervals overlap if the right one begins within the left one, or the left one within the right one but not at its beginning.
    """
    (a, b), (c, d) = left_span, right_span
    begins = stab_join(right.filter(F.col(c) < F.col(d)), left, c, a, b)
    later = stab_join(left.filter(F.col(a) < F.col(b)), right.withColumn("__after", F.col(c).cast("long") + 1), a, "__after", d).drop("__after")
    return begins.select(*left.columns, *right.columns).unionByName(later.select(*left.columns, *right.columns))


def _top(spans: DataFrame, low: str, high: str) -> int:
    """The highest level at which intervals of these lengths have a cell."""
    longest = spans.agg(F.max(F.col(high).cast("decimal(38,0)") - F.col(low).cast("decimal(38,0)"))).first()[0] or 1
    return min(LEVELS, int(longest).bit_length() - 1)


def overlap_summary(left: DataFrame, right: DataFrame, left_span: Sequence[str], right_span: Sequence[str], value: str) -> DataFrame:
    """Each left interval [low, high) that right ones overlap, with their number ``n``, the ``least`` of a column of theirs and the summed lengths ``shared``; whole numbers, no pair is made.

    ``n``: those that begin before its end less those that end at its beginning at the latest. ``shared``: what all right intervals cover up to its end less what they cover up to its
    beginning. Both follow from running sums over all ends in order. ``least``: of the intervals that begin within it, over its dyadic cells, and of those whose dyadic cells hold its beginning.
    The cost is that of the ends and of their cells, however many overlap; both grow with the rows, so all joins sort and merge. Empty and null intervals overlap nothing; repeated rows count each.
    """
    spark, (a, b), (c, d) = left.sparkSession, left_span, right_span
    rows, _ = scratch_table(spark, left.filter(F.col(a) < F.col(b)).withColumn("__row", F.monotonically_increasing_id()))
    own = rows.select("__row", F.col(a).cast("long").alias("__low"), F.col(b).cast("long").alias("__high"))
    others, _ = scratch_table(spark, right.filter(F.col(c) < F.col(d)).select(F.col(c).cast("long").alias("__low"), F.col(d).cast("long").alias("__high"), F.col(value).alias("least")))
    end = lambda at, kind: F.struct(F.col(at).alias("t"), F.lit(kind).alias("kind"))
    # at one time: ends that ask, others' ends, beginnings that ask, others' beginnings
    posts = others.select(F.explode(F.array(end("__high", 1), end("__low", 3))).alias("e")).groupBy("e.t", "e.kind").agg(F.count("*").alias("k")).select("t", "kind", "k", F.lit(None).cast("long").alias("__row"))
    asks = own.select("__row", F.explode(F.array(end("__high", 0), end("__low", 2))).alias("e")).select("e.t", "e.kind", F.lit(0).cast("long").alias("k"), "__row")
    begins, t, k = F.col("kind") == 3, F.col("t").cast("decimal(20,0)"), F.col("k").cast("decimal(18,0)")
    sums = {"begun": F.when(begins, F.col("k")), "ended": F.when(F.col("kind") == 1, F.col("k")), "times": (F.when(begins, t * k).otherwise(-t * k)).cast("decimal(38,0)")}
    at = prefix_scan(posts.unionByName(asks), ["t", "kind", "__row"], sums, "__place").filter("__row is not null")
    covered = (t * (F.col("begun") - F.col("ended")).cast("decimal(18,0)")).cast("decimal(38,0)") - F.col("times")
    is_end = F.col("kind") == 0
    counted = at.select("__row", F.when(is_end, F.col("begun")).otherwise(-F.col("ended")).alias("n"), F.when(is_end, covered).otherwise(-covered).cast("decimal(38,0)").alias("shared"))
    # the least value
    cell = F.call_function("shiftright", F.col("__low"), F.col("__level")).alias("__cell")
    level = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top))).alias("__level")
    least, place = F.min("least").alias("least"), ["__level", "__cell"]
    of = lambda top: F.explode(_cells(F.col("__low"), F.col("__high"), top)).alias("__c")
    split = [F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")]
    top = _top(own, "__low", "__high")
    inside = others.groupBy("__low").agg(least).select("__low", "least", level(top)).select("__level", cell, "least").groupBy(place).agg(least)
    within = own.select("__row", of(top)).select("__row", *split).join(inside.hint("merge"), place).select("__row", "least")
    top = _top(others, "__low", "__high")
    held = others.select("least", of(top)).select("least", *split).groupBy(place).agg(least)
    points = own.select("__low").distinct().select("__low", level(top)).select("__low", "__level", cell).join(held.hint("merge"), place).groupBy("__low").agg(least)
    over = own.join(points.hint("merge"), "__low").select("__row", "least")
    told = counted.unionByName(within.unionByName(over), allowMissingColumns=True)
    found = told.groupBy("__row").agg(F.sum("n").alias("n"), least, F.sum("shared").cast("long").alias("shared")).filter("n > 0")
    return rows.join(found.hint("merge"), "__row").drop("__row")
