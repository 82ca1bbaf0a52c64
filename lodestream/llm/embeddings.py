"""Near-duplicate vectors by sign hashing with random hyperplanes in several tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, on_hubs
from lodestream.llm.components import components

SKETCH_BITS = 256
CODED_DDL = "node long, vec_id long, unit array<double>, posts array<long>, s0 long, s1 long, s2 long, s3 long"
CODED = pa.schema([("node", pa.int64()), ("vec_id", pa.int64()), ("unit", pa.list_(pa.float64())), ("posts", pa.list_(pa.int64())), *((f"s{k}", pa.int64()) for k in range(4))])
BLOCK = 256  # vectors of a block in the comparison of two groups


def table_plan(rows: int, least: float, miss: float) -> tuple[int, int]:
    """(bits a table, tables): about one chance pair a vector in two tables, and a pair of cosine ``least`` missed with chance ``miss``."""
    bits = max(4, math.ceil(math.log2(max(rows, 2))) + 1)
    same = 1 - math.acos(min(1.0, least)) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(same**bits))))


class Planes:
    """Hyperplanes of one dimension, made from a seed alike on every worker."""

    def __init__(self, dim: int, bits: int, tables: int):
        rng = np.random.default_rng([11, dim, bits, tables])
        self.bits, self.tables = bits, tables
        self.planes = rng.standard_normal((dim, bits * tables))
        self.sketch = rng.standard_normal((dim, SKETCH_BITS))
        self.weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        self.own = rng.integers(0, 1 << 63, tables, dtype=np.uint64)

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signs = (unit @ self.planes > 0).reshape(len(unit), self.tables, self.bits)
        key = (signs * self.weights).sum(axis=2, dtype=np.uint64)
        key = (key ^ self.own) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
        key = (key + self.own) * np.uint64(0x94D049BB133111EB)
        return key.view(np.int64), np.packbits(unit @ self.sketch > 0, axis=1).view("<i8")


def coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each vector: one that can link with its posts (a value for table and code) and a sketch of more signs, others with a null node."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, Planes] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
                alone = []
                for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if vec_id is not None and v.is_valid and len(v.values) and not v.values.null_count:
                        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                        if np.isfinite(x).all() and x.any():
                            by_dim.setdefault(len(x), []).append((vec_id, x))
                            continue
                    alone.append(vec_id)
                if alone:
                    yield pa.record_batch([pa.array([x if f.name == "vec_id" else None for x in alone], f.type) for f in CODED], schema=CODED)
                for dim, found in by_dim.items():
                    if dim not in planes:
                        planes[dim] = Planes(dim, bits, tables)
                    x = np.array([v for _, v in found])
                    unit = x / np.abs(x).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    keys, sketch = planes[dim].code(unit)
                    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                    yield pa.record_batch(
                        [pa.array(np.array([xxhash.xxh3_64_intdigest((v + 0.0).tobytes()) for v in x], np.uint64).view(np.int64)), pa.array([i for i, _ in found], pa.int64()), lists(unit), lists(keys), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4))],
                        names=["node", "vec_id", "unit", "posts", "s0", "s1", "s2", "s3"],
                    )

    return vectors.mapInArrow(code, CODED_DDL)


def cosines(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of rows (a, b, unit_a, unit_b), in double precision."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(2), batch.column(3)
            p, q = x.flatten().to_numpy(), y.flatten().to_numpy()
            n = np.diff(x.offsets.to_numpy())
            same = n == np.diff(y.offsets.to_numpy())
            if same.all():
                out = np.add.reduceat(p * q, np.r_[0, np.cumsum(n)[:-1]])
            else:
                a, b = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(np.diff(y.offsets.to_numpy()))]
                out = np.array([p[a[i] : a[i + 1]] @ q[b[i] : b[i + 1]] if same[i] else -2.0 for i in range(len(n))])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cosine"])

    return pairs.mapInArrow(dot, "a long, b long, cosine double")


def signs_apart(angle: Column, bits: int) -> Column:
    """Of ``bits`` signs, those in which vectors at this angle differ, and 6.5 deviations more."""
    chance = F.least(angle / math.pi, F.lit(0.5))
    return F.ceil(F.lit(bits) * chance + F.lit(6.5) * F.sqrt(F.lit(bits) * chance * (1 - chance)))


def differ(a: str, b: str, longs: int) -> Column:
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, longs)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def gather(posts: DataFrame, units: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node, leader, angle): vectors within half of the link's angle of a leader follow it; all others lead themselves.

    In each bucket the smallest node meets each other one, so a bucket costs its rows, not its pairs. Two followers
    of one leader are no further apart than the sum of their angles, so they link.
    """
    half = 0.49 * math.acos(least)
    hubs = posts.groupBy("post").agg(F.min(F.struct("node", "s0", "s1", "s2", "s3")).alias("h"), F.count("*").alias("n")).filter("n > 1")
    hubs = hubs.select("post", F.col("h.node").alias("a"), *(F.col(f"h.s{k}").alias(f"t{k}") for k in range(4)))
    stars = posts.join(hubs, "post").filter((F.col("node") != F.col("a")) & (differ("s", "t", 4) <= signs_apart(F.lit(half), SKETCH_BITS)))
    stars = scratch.keep(stars.select("a", F.col("node").alias("b")).distinct(), "stars")
    full = on_hubs(stars, units.select(F.col("node").alias("a"), F.col("unit").alias("unit_a")), scratch).join(units.select(F.col("node").alias("b"), F.col("unit").alias("unit_b")), "b")
    close = cosines(full.select("a", "b", "unit_a", "unit_b")).withColumn("angle", F.acos(F.least("cosine", F.lit(1.0)))).filter(F.col("angle") <= half)
    close = scratch.keep(close.select("a", "b", "angle"), "close")
    led = close.select(F.col("b").alias("a")).distinct()
    nearest = close.join(led, "a", "left_anti").groupBy("b").agg(F.min(F.struct("angle", "a")).alias("h"))
    found = nearest.select(F.col("b").alias("node"), F.col("h.a").alias("leader"), F.col("h.angle").alias("angle"))
    return scratch.keep(units.select("node").join(found, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "groups")


def _count_links(least: float):
    def count(group: pa.Table) -> pa.Table:
        """Of two blocks of vectors: each vector that links with some of the other block, and with how many rows."""
        group = group.combine_chunks()
        side = group["side"].to_numpy()
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        node, size, units = group["node"].to_numpy(), group["size"].to_numpy(), group["unit"].to_pylist()
        x, y = (np.array([units[i] for i in r]) for r in rows)
        near = (x @ y.T >= least) if x.ndim == y.ndim == 2 and x.shape[1] == y.shape[1] else np.zeros((len(x), len(y)), bool)
        both = np.r_[near @ size[rows[1]], near.T @ size[rows[0]]]
        at = np.concatenate(rows)[both > 0]
        first, n = group.slice(0, 1), int((both > 0).sum())
        return pa.table({"a": pa.array(first["a"].to_pylist() * n, pa.int64()), "b": pa.array(first["b"].to_pylist() * n, pa.int64()), "node": pa.array(node[at], pa.int64()), "near": pa.array(both[both > 0].astype(np.int64), pa.int64())})

    return count


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, miss: float = 1e-3) -> DataFrame:
    """Link vectors of cosine >= ``least``; one row per vector: vec_id, n_links, component_id, kept.

    1. Equal vectors fold into one class. 2. Class representatives are posted in tables of random-hyperplane
    sign codes; bits grow with the logarithm of the rows, tables so that a pair at the very threshold
    is missed with chance ``miss`` (closer pairs: far less). 3. Dense groups are gathered round leaders (``gather``): within
    a group all link, so its links are counted, not listed. 4. Leaders of a bucket meet once for all their groups; pairs pass a sketch of
    128 more signs (6.5 deviations are left), then their exact cosine and the groups' radii decide: nothing linked, all
    linked, or (where the angle lies between) blocks of the two groups are compared exactly by matrix products. n_links counts each linked
    vector of each linked class.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows of a null id, link
    with nothing (n_links 0, own component, kept); so do vectors of different lengths with each other.
    Rows that repeat an id count as vectors of their own under one name, valid or not; ties need no order; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bits, tables = table_plan(rows.count(), least, miss)
    hashed = scratch.keep(coded(rows, bits, tables), "coded")
    able = hashed.filter("node is not null")
    classes = scratch.keep(able.groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("size")), "classes")
    reps = scratch.keep(able.drop("vec_id").dropDuplicates(["node"]), "reps")
    units = reps.select("node", "unit")
    groups = gather(reps.select("node", "s0", "s1", "s2", "s3", F.explode("posts").alias("post")), units, least, scratch)
    wide = math.acos(least)
    # a group's weight in rows, its radius, and the blocks that it is compared in
    whole = groups.join(classes, "node").groupBy("leader").agg(F.sum("size").alias("weight"), F.max("angle").alias("radius"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    whole = scratch.keep(whole, "whole")

    posted = groups.select("node", "leader").join(reps.select("node", F.explode("posts").alias("post")), "node").select("post", "leader").distinct()
    marks = whole.select("leader", "radius").join(reps.select(F.col("node").alias("leader"), "s0", "s1"), "leader")
    posted = scratch.keep(posted.join(marks, "leader"), "posted")
    other = posted.select("post", F.col("leader").alias("b"), F.col("radius").alias("radius_b"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    reach = F.lit(wide) + F.col("radius") + F.col("radius_b")
    pairs = posted.join(other, "post").filter((F.col("leader") < F.col("b")) & (differ("s", "t", 2) <= signs_apart(reach, 128)))
    pairs = scratch.keep(pairs.select(F.col("leader").alias("a"), "b").distinct(), "pairs")
    full = on_hubs(pairs, units.select(F.col("node").alias("a"), F.col("unit").alias("unit_a")), scratch).join(units.select(F.col("node").alias("b"), F.col("unit").alias("unit_b")), "b")
    met = cosines(full.select("a", "b", "unit_a", "unit_b")).filter(F.col("cosine") >= -1)
    for x in ("a", "b"):
        met = met.join(whole.select(F.col("leader").alias(x), F.col("weight").alias(f"weight_{x}"), F.col("radius").alias(f"radius_{x}"), F.col("parts").alias(f"parts_{x}")), x)
    angle, radii, slack = F.acos(F.greatest(F.lit(-1.0), F.least("cosine", F.lit(1.0)))), F.col("radius_a") + F.col("radius_b"), F.lit(1e-7)
    alone = radii == 0
    every = F.when(alone, F.col("cosine") >= least).otherwise(angle + radii < F.lit(wide) - slack)
    some = ~alone & ~every & (angle - radii < F.lit(wide) + slack)
    met = scratch.keep(met.select("*", every.alias("every"), some.alias("some")).filter("every or some").drop("cosine"), "met")

    members = groups.join(classes, "node").join(units, "node").join(whole.select("leader", "parts"), "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "size", "unit")
    tasks = met.filter("some").select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)).alias("i"), "parts_b").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)).alias("j"))
    sides = [tasks.join(members.withColumnsRenamed({"leader": x, "part": k}), [x, k]).select("a", "b", "i", "j", F.lit(n).alias("side"), "node", "size", "unit") for n, (x, k) in enumerate((("a", "i"), ("b", "j")))]
    parts = sides[0].unionByName(sides[1]).groupBy("a", "b", "i", "j").applyInArrow(_count_links(least), "a long, b long, node long, near long")
    parts = scratch.keep(parts, "parts")

    edges = scratch.keep(met.filter("every").select("a", "b").union(parts.select("a", "b").distinct()), "edges")
    every = met.filter("every")
    by_leader = every.select(F.col("a").alias("leader"), F.col("weight_b").alias("near")).union(every.select(F.col("b").alias("leader"), F.col("weight_a").alias("near"))).groupBy("leader").agg(F.sum("near").alias("near"))
    by_node = parts.groupBy("node").agg(F.sum("near").alias("more"))
    named = components(edges, scratch).withColumnRenamed("node", "leader")
    label = groups.join(classes, "node").join(whole.select("leader", "weight"), "leader").join(by_leader, "leader", "left").join(by_node, "node", "left").join(named, "leader", "left")
    n_links = F.col("weight") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("more", F.lit(0))
    label = scratch.keep(label.select(F.coalesce("component", "leader").alias("a"), F.col("node").alias("b"), "low", n_links.alias("n_links")), "label")
    lowest = label.groupBy("a").agg(F.min("low").alias("component_id"))
    label = scratch.keep(on_hubs(label, lowest, scratch).select(F.col("b").alias("node"), "n_links", "component_id"), "label")
    scratch.release(hashed, label)
    out = hashed.select("node", "vec_id").join(label, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
