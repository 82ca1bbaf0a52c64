"""Connected components of an edge table by rounds of hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch


ROWS_IN_FILE = 200_000


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component: the smallest node reachable.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers to their ends (in
    doubling jumps), and rewrites the edges between these ends. Only nodes below all their neighbours are ends, at most half of those
    that have any, so rounds are few whatever the order of the nodes, and a chain takes one. Neighbours are reduced by a minimum that combines
    before the shuffle, so a node with a third of all edges is no hot spot. Nothing reaches the driver
    but one emptiness test a round. Null ends, loops and repeated edges have no effect.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct()
    links = scratch.keep(links, "links")
    # no table below has more than twice the rows: few files for few rows
    parts = 1 + links.count() // ROWS_IN_FILE
    keep = lambda df, name: scratch.keep(df.coalesce(parts), name)
    labels = None
    for _ in range(most_rounds):
        if links.isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "near")
        jumped, moved = near, True
        while moved:
            up = jumped.select(F.col("a").alias("p"), F.col("p").alias("q"))
            further = keep(jumped.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jumped")
            jumped, moved = further.select("a", "p"), not further.filter("moved").isEmpty()
        if labels is None:
            labels = jumped.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = jumped.select(F.col("a").alias("component"), "p")
            labels = keep(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        left = links.join(jumped, "a").select("b", F.col("p").alias("c"))
        left = left.join(jumped.select(F.col("a").alias("b"), F.col("p").alias("d")), "b")
        links = keep(left.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
