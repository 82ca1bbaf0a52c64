"""Headline queries over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.relational import broadcast_if_small
from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query("""SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2""")
def revenue_by_nation(spark, sf) -> DataFrame:
    """Two large tables meet once on the order key; the small side is cut to one region before it is counted and hinted."""
    nations = table(spark, sf, "nation").join(broadcast_if_small(table(spark, sf, "region").filter("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    suppliers = table(spark, sf, "supplier").join(broadcast_if_small(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.expr("l_extendedprice * (1 - l_discount)").alias("net"))
    mine = lines.join(broadcast_if_small(suppliers), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "n_name", "net")
    joined = mine.join(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("n_name", "y").agg(F.round(F.sum("net"), 0).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 0) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 0).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(spark, sf) -> DataFrame:
    customers = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1995-03-15'").select("o_orderkey", "o_custkey", "o_orderdate").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, sf, "lineitem").filter("l_shipdate > TIMESTAMP_NTZ '1995-03-15'").select("l_orderkey", F.expr("l_extendedprice * (1 - l_discount)").alias("net"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("net"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)
