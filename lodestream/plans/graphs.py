"""Graph operators over the whole graphs that the star tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.graph import components, degrees, layers, reach, shortest_paths
from lodestream.plans.registry import query
from lodestream.sources.tables import table

#: Customers and suppliers, linked where a customer's order has a supplier's line.
LINKS = "SELECT DISTINCT o_custkey AS a, l_suppkey + 100000000 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _links(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 100000000).alias("b")).distinct()


@query(f"""WITH RECURSIVE e AS ({LINKS}), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM w UNION SELECT w.a, min(cc.component) FROM cc JOIN w ON w.b = cc.node JOIN recurring.cc AS r ON r.node = w.a WHERE cc.component < r.component GROUP BY w.a)
SELECT node, component FROM cc""")
def g_components(spark, sf):
    return components(_links(spark, sf), "a", "b")


#: Orders by customer in time, each to the next; the place of each in its customer's row of two orders at least.
PLACES = "SELECT o_orderkey AS node, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


def _next(spark, sf) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("s"), F.lead("o_orderkey").over(w).alias("t")).filter("t is not null")


@query(f"SELECT node, CAST(k AS INT) AS distance FROM ({PLACES}) WHERE n > 1")
def g_reach(spark, sf):
    """From the first order of every customer with a later one."""
    e = _next(spark, sf)
    return reach(e.select(F.col("s").alias("node")).subtract(e.select("t")), e, "s", "t")


@query(f"SELECT node, CAST(least(k, 10) AS INT) AS layer FROM ({PLACES}) WHERE n > 1")
def g_layers(spark, sf):
    e = _next(spark, sf)
    return layers(e.select(F.col("s").alias("node")).union(e.select("t")), e, "s", "t")


@query(f"SELECT arg_min(node, k) AS start, arg_max(node, k) AS goal, string_agg(CAST(node AS VARCHAR), '>' ORDER BY k) AS path FROM ({PLACES}) WHERE n > 1 GROUP BY c")
def g_paths(spark, sf):
    e = _next(spark, sf)
    starts = e.select(F.col("s").alias("node")).subtract(e.select("t"))
    ends = e.select(F.col("t").alias("node")).subtract(e.select("s"))
    return shortest_paths(starts, ends, e, "s", "t", most_paths=None).select("start", "goal", F.concat_ws(">", "path").alias("path"))


@query(f"WITH e AS ({LINKS}) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT a AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e) GROUP BY node")
def g_degrees(spark, sf):
    e = _links(spark, sf)
    return degrees(e.select(F.col("a").alias("node")).union(e.select("b")), e, "a", "b")
