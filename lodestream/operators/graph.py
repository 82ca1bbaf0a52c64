"""Graphs as edge tables: components, reach, shortest paths, layers, degrees. All loops are over frontiers, never over rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.sources.writers import shared_dir


COMPACT_ROUNDS = 8  # rounds after which the files of what is known become one for each bucket; then after twice as many each time
BUCKET_ROWS = 250_000  # edges for a bucket of a loop's tables


def _keep(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: loops would else grow their plan each round."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Buckets:
    """A table in the shared folder that is written in buckets by ``by``: rounds that join it by these columns read it as it lies, and shuffle their own rows alone."""

    def __init__(self, rows: DataFrame, by: list[str], n: int):
        self.spark, self.by, self.n, self.schema = rows.sparkSession, by, n, rows.schema
        self._begin(rows)

    def _begin(self, rows: DataFrame) -> None:
        self.name = f"graph_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        self.add(rows)

    def add(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.n, *self.by)
        dealt.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.n, *self.by).saveAsTable(self.name)

    def compact(self) -> None:
        old, rows = self.name, self.rows()
        self._begin(rows)
        self.spark.sql(f"DROP TABLE {old}")  # the name alone: the files stay

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The rows by their files, of no catalogue."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def close(self) -> DataFrame:
        out = self.rows()
        self.spark.sql(f"DROP TABLE {self.name}")
        return out


def components(edges: DataFrame, source: str, target: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Each round every node points to the least of itself and its neighbours, pointers are followed to their ends by doubling, and the edges shrink to
    those between ends. An end is less than all its neighbours, so at most half of the nodes with edges stay. Labels follow. A node of loops alone is its own component.
    """
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    labels = _keep(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("component", F.col("node")))
    left = _keep(ends.filter("a <> b").distinct())
    for _ in range(most_rounds):
        if left.isEmpty():
            return labels
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jump, moved = _keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))), True
        while moved:
            onward = jump.select(F.col("a").alias("to"), F.col("to").alias("then"))
            further = _keep(jump.join(onward, "to").select("a", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")))
            jump, moved = further.select("a", "to"), not further.filter("moved").isEmpty()
        moved = labels.join(jump.withColumnRenamed("a", "component"), "component", "left")
        labels = _keep(moved.select("node", F.coalesce("to", "component").alias("component")))
        ahead = left.join(jump, "a").select("b", F.col("to").alias("p")).join(jump.select(F.col("a").alias("b"), F.col("to").alias("q")), "b")
        left = _keep(ahead.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def reach(seeds: DataFrame, edges: DataFrame, source: str, target: str, keys: list[str] | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(keys, node, distance) of all nodes that edges lead to from the seeds (keys, node); ``keys`` travel along, such as the script or the seed's name.

    Semi-naive: each round joins only what the last one found and drops what is known. Not to settle in ``most_rounds`` is an error.
    """
    keys = keys or []
    shared = [k for k in keys if k in edges.columns]
    steps, n = _steps(edges, shared, source, target)
    known = _Buckets(seeds.select(*keys, "node", F.lit(0).alias("distance")).distinct(), [*keys, "node"], n)
    try:
        compacted = COMPACT_ROUNDS
        for k in range(1, most_rounds + 1):
            front = known.rows().filter(F.col("distance") == k - 1)
            found = front.join(steps.table(), [*shared, "node"]).select(*keys, F.col("next").alias("node")).repartition(n, *keys, "node").distinct()
            new = found.join(known.table().select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("distance", F.lit(k)).select(*keys, "node", "distance")
            known.add(new)
            if known.rows().filter(F.col("distance") == k).isEmpty():
                return known.close()
            if k == compacted:
                known.compact()
                compacted *= 2
    finally:
        steps.close()
    raise RuntimeError(f"the reach did not settle in {most_rounds} rounds")


def _steps(edges: DataFrame, shared: list[str], source: str, target: str) -> tuple[_Buckets, int]:
    """Distinct edges (shared, node, next) in buckets by where they begin, and the number of buckets."""
    steps = _keep(edges.select(*shared, F.col(source).alias("node"), F.col(target).alias("next")).distinct())
    n = 1 + steps.count() // BUCKET_ROWS
    return _Buckets(steps, [*shared, "node"], n), n


def shortest_paths(seeds: DataFrame, goals: DataFrame, edges: DataFrame, source: str, target: str, most_rounds: int = 10_000, most_paths: int | None = 200) -> DataFrame:
    """(start, goal, path): one shortest path, the first in order, from each seed (node) to each goal (node) it reaches; the first ``most_paths``, or all."""
    steps, n = _steps(edges, [], source, target)
    known = _Buckets(seeds.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct().withColumn("round", F.lit(0)), ["start", "node"], n)
    try:
        compacted = COMPACT_ROUNDS
        for k in range(1, most_rounds + 1):
            front = known.rows().filter(F.col("round") == k - 1)
            found = front.join(steps.table(), "node").select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path")).repartition(n, "start", "node")
            new = found.join(known.table().select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
            known.add(new.withColumn("round", F.lit(k)))
            if known.rows().filter(F.col("round") == k).isEmpty():
                break
            if k == compacted:
                known.compact()
                compacted *= 2
        else:
            raise RuntimeError(f"the paths did not settle in {most_rounds} rounds")
    finally:
        steps.close()
    known = known.close().drop("round")
    ends = known.join(goals.select("node").distinct(), "node", "left_semi").filter("size(path) > 1")
    out = ends.select("start", F.col("node").alias("goal"), "path")
    return out if most_paths is None else out.orderBy("start", "goal").limit(most_paths)


def layers(nodes: DataFrame, edges: DataFrame, source: str, target: str, most: int = 10) -> DataFrame:
    """(node, layer): the longest way to a node from those without predecessors, at most ``most`` (cycles end there)."""
    steps = edges.select(F.col(source).alias("s"), F.col(target).alias("node")).filter("s <> node").distinct()
    now = _keep(nodes.select("node").distinct().withColumn("layer", F.lit(0)))
    for _ in range(most):
        up = steps.join(now.withColumnRenamed("node", "s"), "s").groupBy("node").agg(F.least(F.max("layer") + 1, F.lit(most)).alias("up"))
        new = _keep(now.join(up, "node", "left").select("node", F.col("layer").alias("before"), F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer")))
        now = new.select("node", "layer")
        if new.filter("layer <> before").isEmpty():
            break
    return now


def degrees(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, n_in, n_out) without loops."""
    e = edges.filter(F.col(source) != F.col(target)).select(F.col(source).alias("s"), F.col(target).alias("t"))
    ends = e.select(F.col("s").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("t", F.lit(1), F.lit(0)))
    n = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("node").distinct().join(n, "node", "left").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
