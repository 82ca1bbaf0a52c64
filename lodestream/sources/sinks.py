"""What an analysis leaves: indexes, graphs as JSON, and a bounded log."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEXES = ("table_index", "field_index", "pair_index", "orphan_fields")


def write_indexes(path: str, uses: DataFrame, resolved: DataFrame, kind: str = "json") -> None:
    """table_index, field_index, pair_index and orphan_fields below a folder of any file system that Spark writes; a folder that is there is replaced."""
    from lodestream.lineage import index

    made = (index.table_index(uses), index.field_index(uses), index.pair_index(uses), index.orphans(resolved))
    for name, df in zip(INDEXES, made, strict=True):
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, name: str, kind: str = "json") -> DataFrame:
    return spark.read.format(kind).load(f"{path}/{name}")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, graph): a script's graph as JSON in the form of drawing libraries: nodes and edges, each an object under ``data``.

    nodes: script, id and any columns; edges: script, source_id, target_id, relationship and any columns. Ends are named source and target, edges by their ends and type.
    """
    n = nodes.select("script", F.struct(F.struct(*(c for c in nodes.columns if c != "script")).alias("data")).alias("item"))
    rest = [c for c in edges.columns if c not in ("script", "source_id", "target_id")]
    name = F.format_string("%s->%s:%s", "source_id", "target_id", "relationship").alias("id")
    e = edges.select("script", F.struct(F.struct(name, F.col("source_id").alias("source"), F.col("target_id").alias("target"), *rest).alias("data")).alias("item"))
    gather = lambda df, what: df.groupBy("script").agg(F.sort_array(F.collect_list("item")).alias(what))
    both = gather(n, "nodes").join(gather(e, "edges"), "script", "left")
    return both.select("script", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(both.schema["edges"].dataType)).alias("edges"))).alias("graph"))


def write_graphs(path: str, nodes: DataFrame, edges: DataFrame) -> None:
    """One line of JSON a script: script and graph."""
    graph_json(nodes, edges).write.mode("overwrite").json(path)


class LogQueue:
    """The newest ``most`` entries (number, time, level, text); older ones go. Readers ask for what came after a number."""

    def __init__(self, most: int = 500):
        self.entries: deque[tuple[int, float, str, str]] = deque(maxlen=most)
        self.number = 0

    def put(self, level: str, text: str) -> int:
        self.number += 1
        self.entries.append((self.number, time.time(), level, text))
        return self.number

    def after(self, number: int = 0) -> list[tuple[int, float, str, str]]:
        return [e for e in self.entries if e[0] > number]

    def listen(self, spark: SparkSession):
        """Put the progress of all streaming queries of the session into the queue; gives the listener, to remove it again."""
        from pyspark.sql.streaming import StreamingQueryListener

        queue = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                queue.put("info", f"started {event.name or event.id}")

            def onQueryProgress(self, event) -> None:
                queue.put("info", f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                queue.put("error" if event.exception else "info", f"ended {event.id}")

        listener = Listener()
        spark.streams.addListener(listener)
        return listener
