"""Recursion over cyclic graphs of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.hierarchy import condensation, connect_by, interval_labels, strong_components
from lodestream.operators.inequality import stab_join
from lodestream.plans.registry import query
from lodestream.sources.tables import table
from lodestream.sources.writers import scratch_table

SUPPLIER = 100_000_000  # what is added to a supplier's number to tell it from a customer's

#: Customers send goods back to suppliers, suppliers ship small parcels to customers: a directed graph with cycles.
TRADE = f"""SELECT DISTINCT o_custkey AS a, l_suppkey + {SUPPLIER} AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 48
  UNION SELECT DISTINCT l_suppkey + {SUPPLIER}, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND l_quantity <= 1"""

CLOSED = f"WITH RECURSIVE e AS ({TRADE}), r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e), c AS (SELECT node, least(node, coalesce(min(r.y), node)) AS component FROM nodes LEFT JOIN (r JOIN r AS s ON s.x = r.y AND s.y = r.x) ON r.x = node GROUP BY node)"


def _lines(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linenumber")
    return lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def _trade(spark, sf) -> DataFrame:
    lines = _lines(spark, sf).withColumn("s", F.col("l_suppkey") + SUPPLIER)
    back = lines.filter("l_returnflag = 'R' AND l_quantity >= 48").select(F.col("o_custkey").alias("a"), F.col("s").alias("b"))
    return back.union(lines.filter("l_returnflag = 'N' AND l_quantity <= 1").select("s", "o_custkey")).distinct()


@query(f"{CLOSED} SELECT node, component FROM c")
def g_strong_components(spark, sf):
    return strong_components(_trade(spark, sf), "a", "b")


@query(f"{CLOSED} SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN c x ON x.node = e.a JOIN c y ON y.node = e.b WHERE x.component <> y.component")
def g_condensation(spark, sf):
    """The same graph without its cycles."""
    edges = _trade(spark, sf)
    return condensation(edges, "a", "b", strong_components(edges, "a", "b"))


#: Everyone's main partner: whom a customer buys most from, and whom a supplier sells most to. Partners of each other are cycles.
PARTNERS = f"""q AS (SELECT o_custkey AS c, l_suppkey + {SUPPLIER} AS s, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT c AS child, arg_max(s, (n, -s)) AS parent FROM q GROUP BY c UNION ALL SELECT s, arg_max(c, (n, -c)) FROM q GROUP BY s)"""


def _partners(spark, sf) -> DataFrame:
    lines = _lines(spark, sf)
    pairs = lines.groupBy(F.col("o_custkey").alias("c"), (F.col("l_suppkey") + SUPPLIER).alias("s")).agg(F.sum("l_quantity").cast("long").alias("n"))
    pairs, _ = scratch_table(spark, pairs)  # read several times
    main = lambda of, with_: pairs.groupBy(F.col(of).alias("child")).agg(F.max_by(with_, F.struct("n", -F.col(with_))).alias("parent"))
    return main("c", "s").union(main("s", "c"))


WALKS = f"""WITH RECURSIVE {PARTNERS}, w AS (SELECT child AS root, child AS node, 1 AS level, [child] AS path FROM p WHERE child > {SUPPLIER}
  UNION ALL SELECT w.root, p.child, level + 1, list_append(path, p.child) FROM w JOIN p ON p.parent = w.node WHERE NOT list_contains(path, p.child))
SELECT root, node, level, array_to_string(path, '>') AS path, CAST(NOT EXISTS (SELECT 1 FROM p WHERE p.parent = w.node AND NOT list_contains(w.path, p.child)) AS INT) AS is_leaf,
  CAST(EXISTS (SELECT 1 FROM p WHERE p.parent = w.node AND list_contains(w.path, p.child)) AS INT) AS is_cycle FROM w"""


@query(WALKS)
def c04_connect_by_nocycle(spark, sf):
    """SELECT CONNECT_BY_ROOT node, node, LEVEL, SYS_CONNECT_BY_PATH(node, '>'), CONNECT_BY_ISLEAF, CONNECT_BY_ISCYCLE FROM partners START WITH a supplier CONNECT BY NOCYCLE PRIOR child = parent."""
    partners = _partners(spark, sf)
    out = connect_by(partners, partners.filter(F.col("child") > SUPPLIER).select(F.col("child").alias("node")))
    return out.select("root", "node", "level", F.concat_ws(">", "path").alias("path"), "is_leaf", "is_cycle")


@query(f"""WITH RECURSIVE {PARTNERS}, f AS (SELECT x.child AS node, CASE WHEN y.child IS NULL THEN x.parent END AS parent FROM p x LEFT JOIN p y ON y.child = x.parent AND y.parent = x.child),
up AS (SELECT node, node AS ancestor, 0 AS d FROM f UNION ALL SELECT up.node, f.parent, d + 1 FROM up JOIN f ON f.node = up.ancestor WHERE f.parent IS NOT NULL),
ok AS (SELECT up.node FROM up JOIN f ON f.node = up.ancestor WHERE f.parent IS NULL)
SELECT ancestor AS node, count(*) AS members, max(d)::INT AS height, max(up.node) AS greatest FROM up JOIN ok USING (node) GROUP BY ancestor""")
def c04_ancestors_by_intervals(spark, sf):
    """Everyone's following in the forest that is left where mutual partners are roots: members, height, greatest member; ancestors are found by joins of points with label intervals."""
    p = _partners(spark, sf)
    mutual = p.select(F.col("parent").alias("child"), F.col("child").alias("parent"), F.lit(True).alias("mutual"))
    forest = p.join(mutual, ["child", "parent"], "left").select(F.col("child").alias("node"), F.when(F.col("mutual").isNull(), F.col("parent")).alias("parent"))
    labels = interval_labels(forest)
    members = labels.select(F.col("node").alias("member"), F.col("low").alias("at"), F.col("level").alias("member_level"))
    found = stab_join(members, labels.select("node", "low", "high", "level"), "at", "low", "high")
    return found.groupBy("node").agg(F.count("*").alias("members"), F.max(F.col("member_level") - F.col("level")).alias("height"), F.max("member").alias("greatest"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rownum, count(*) OVER (PARTITION BY l_orderkey) AS n_rows FROM lineitem")
def p14_pseudocolumns(spark, sf):
    """ROWNUM within each order, over a table."""
    w = Window.partitionBy("l_orderkey")
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("rownum"), F.count("*").over(w).alias("n_rows"))
