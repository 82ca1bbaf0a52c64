"""CUBE, ROLLUP and GROUPING SETS over a lattice: each grouping is aggregated from its smallest finished parent, not from the rows expanded once a grouping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.sources.writers import scratch_table

KINDS = ("count", "sum", "avg", "min", "max", "variance", "approx_distinct", "distinct")


def cube_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(dims), -1, -1) for c in combinations(dims, k)]


def rollup_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dims[:k]) for k in range(len(dims), -1, -1)]


def _partials(name: str, kind: str, shift: float) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """(states from rows, states from states, result) of one measure whose values stand in the column ``name``; states can be merged in any order."""
    v = F.col(name)
    n, s, q = f"{name}__n", f"{name}__s", f"{name}__q"
    add = lambda *names: {x: F.sum(x) for x in names}
    if kind == "count":
        return {n: F.count(v)}, add(n), F.col(n)
    if kind == "sum":
        return {s: F.sum(v)}, add(s), F.col(s)
    if kind == "avg":
        return {s: F.sum(v), n: F.count(v)}, add(s, n), F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n))
    if kind in ("min", "max"):
        f = getattr(F, kind)
        return {s: f(v)}, {s: f(s)}, F.col(s)
    if kind == "variance":
        d = v.cast("double") - F.lit(shift)
        spread = (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)
        return {n: F.count(v), s: F.sum(d), q: F.sum(d * d)}, add(n, s, q), F.when(F.col(n) > 1, F.greatest(spread, F.lit(0.0)))
    return {s: F.hll_sketch_agg(v, F.lit(14))}, {s: F.hll_union_agg(s, F.lit(False))}, F.hll_sketch_estimate(s)


def _number(grouping: tuple[str, ...], dims: Sequence[str]) -> int:
    """GROUPING_ID: a bit for each dimension that is rolled up, the last one lowest."""
    return sum((d not in grouping) << (len(dims) - 1 - i) for i, d in enumerate(dims))


def _levels(rows: DataFrame, dims: Sequence[str], groupings: set[tuple[str, ...]], also: Sequence[str], first: Mapping[str, Column], again: Mapping[str, Column]) -> DataFrame:
    """States of all groupings (``__g`` and the dimensions, null where rolled up). ``also``: columns that belong to every key.

    One job a level of the lattice, the most dimensions first; its groupings are written apart. A grouping without a finished superset is made of the rows, any other of the superset
    with the fewest rows, which are known by then: a count of the files written, one number a grouping.
    """
    size: dict[tuple[str, ...], int] = {}
    tables: dict[int, DataFrame] = {}
    types = None

    def made(g: tuple[str, ...]) -> DataFrame:
        parents = [p for p in size if set(g) < set(p)]
        best = min(parents, key=lambda p: (size[p], p), default=None)
        source = rows if best is None else tables[len(best)].filter(F.col("__g") == _number(best, dims))
        keys = [*g, *also]
        made_of = first if best is None else again
        # a key that is the same for all: without keys an empty table would give a row
        out = source.groupBy(*keys, F.lit(0).alias("__all")).agg(F.count(F.lit(1)).alias("__rows"), *(c.alias(x) for x, c in made_of.items()))
        shown = [(F.col(d) if d in g else F.lit(None).cast(rows.schema[d].dataType)).alias(d) for d in dims]
        states = [F.col(x) if types is None else F.col(x).cast(types[x].dataType).alias(x) for x in first]
        return out.select(F.lit(_number(g, dims)).alias("__g"), *shown, *also, *states)

    for k in sorted({len(g) for g in groupings}, reverse=True):
        here = sorted(g for g in groupings if len(g) == k)
        if types is None:
            types = made(here[0]).schema  # sums of decimals would widen from level to level
        tables[k], _ = scratch_table(rows.sparkSession, reduce(DataFrame.unionByName, map(made, here)), by=["__g"])
        counted = {r["__g"]: r["n"] for r in tables[k].groupBy("__g").agg(F.count("*").alias("n")).collect()}
        size |= {g: counted.get(_number(g, dims), 0) for g in here}
    return reduce(DataFrame.unionByName, tables.values())


def grouping_sets(df: DataFrame, dims: Sequence[str], groupings: Iterable[Sequence[str]], measures: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """``dims`` (null where rolled up), ``grouping_id`` and ``measures`` (name to kind and value) for each of ``groupings``.

    Kinds: count (of values that are not null), sum, avg, min, max, variance (of a sample), approx_distinct (HLL, 2^14 cells) and distinct. All are kept as states that can be merged, so
    only groupings that no other one contains read the rows; that is one of a cube or rollup. Sums shift by the mean before squares, for the variance. Exact distinct counts have a lattice
    of their own, of distinct (dimensions, value), and are exact at any number of values without a set in one task. All aggregates combine before their shuffle, so hot groups are no hot tasks.

    A dimension's own null is a group of its own, told from rolled-up nulls by ``grouping_id``. Repeated groupings come once. An empty table gives no rows, not even a total. The driver
    gets a count a grouping, and a mean for each variance. The states stay in the shared folder as the result reads them.
    """
    sets = {tuple(d for d in dims if d in g) for g in groupings}
    if unknown := {kind for kind, _ in measures.values()} - set(KINDS):
        raise ValueError(f"unknown kinds of measure: {sorted(unknown)}")
    if clash := {*dims, "grouping_id"} & {*measures}:
        raise ValueError(f"names of both a dimension and a measure: {sorted(clash)}")
    value = {name: F.col(c) if isinstance(c, str) else c for name, (_, c) in measures.items()}
    rows = df.select(*dims, *(c.alias(f"__{name}") for name, c in value.items()))
    shifted = [name for name, (kind, _) in measures.items() if kind == "variance"]
    means = rows.agg(*(F.avg(f"__{name}") for name in shifted)).first() if shifted else ()
    shift = {name: float(m or 0) for name, m in zip(shifted, means, strict=True)}
    first, again, result = {}, {}, {}
    for name, (kind, _) in measures.items():
        if kind != "distinct":
            a, b, result[name] = _partials(f"__{name}", kind, shift.get(name, 0.0))
            first |= a
            again |= b
    states = _levels(rows, dims, sets, [], first, again)
    out = states.select(*dims, F.col("__g").cast("long").alias("grouping_id"), *(c.alias(name) for name, c in result.items()))
    exact = [name for name, (kind, _) in measures.items() if kind == "distinct"]
    if exact:
        key = [*dims, "grouping_id"]
        parts = [out.withColumns({name: F.lit(0).cast("long") for name in exact})]
        for name in exact:
            held = _levels(rows.filter(F.col(f"__{name}").isNotNull()), dims, sets, [f"__{name}"], {}, {})
            counts = held.groupBy(*dims, "__g").agg(F.count("*").alias(name)).withColumn("grouping_id", F.col("__g").cast("long"))
            others = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in result] + [F.lit(0).cast("long").alias(c) for c in exact if c != name]
            parts.append(counts.select(*key, name, *others))
        merged = reduce(DataFrame.unionByName, parts).groupBy(*key)
        # a group has one row of each part, so its own value is the only one that is not null
        out = merged.agg(*(F.max(c).alias(c) for c in result), *(F.max(c).alias(c) for c in exact))
    return out.select(*dims, "grouping_id", *measures)


def cube(df: DataFrame, dims: Sequence[str], measures: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """``grouping_sets`` over all subsets of ``dims``."""
    return grouping_sets(df, dims, cube_sets(dims), measures)


def rollup(df: DataFrame, dims: Sequence[str], measures: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """``grouping_sets`` over all prefixes of ``dims``."""
    return grouping_sets(df, dims, rollup_sets(dims), measures)
