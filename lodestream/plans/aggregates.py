"""Aggregation, windows, order, set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators.relational import qualify, top_per_group
from lodestream.plans.registry import query
from lodestream.sources.tables import table, views


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS n_tax, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem GROUP BY 1, 2")
def a01_count_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 0).alias("revenue"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first_day FROM orders GROUP BY 1")
def a02_avg_min_max(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderdate").alias("first_day"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def a03_count_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, round(stddev_pop(p_retailprice), 6) AS sdp, round(var_samp(p_size), 6) AS v, round(var_pop(p_size), 6) AS vp FROM part GROUP BY 1")
def a04_deviation(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.round(F.stddev_pop("p_retailprice"), 6).alias("sdp"), F.round(F.var_samp("p_size"), 6).alias("v"), F.round(F.var_pop("p_size"), 6).alias("vp"))


@query("SELECT p_type, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM part GROUP BY 1")
def a05_bits(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.bit_and("p_size").alias("a"), F.bit_or("p_size").alias("o"), F.bit_xor("p_size").alias("x"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def a06_listagg(spark, sf):
    views(spark, sf, "nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")


@query("SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, quantile_disc(o_totalprice, 0.25) AS q1 FROM orders GROUP BY 1")
def a07_percentile(spark, sf):
    views(spark, sf, "orders")
    return spark.sql("SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1 FROM orders GROUP BY o_orderstatus")


FILTERED = "SELECT l_shipmode_class, count(*) FILTER (WHERE l_discount > 0.05) AS high, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM (SELECT l_discount, l_returnflag, l_linenumber % 3 AS l_shipmode_class FROM lineitem) x GROUP BY l_shipmode_class"


@query(FILTERED)
def a08_filter_where(spark, sf):
    views(spark, sf, "lineitem")
    return spark.sql(FILTERED)


@query("SELECT n_regionkey, CAST(list_sort(list(n_nationkey)) AS VARCHAR) AS keys FROM nation GROUP BY 1")
def a09_collect(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("n_nationkey")), ", "), F.lit("]")).alias("keys"))


@query("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
def a10_group_by(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def a11_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a12_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a13_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


SETS = "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())"


@query(SETS)
def a14_grouping_sets(spark, sf):
    views(spark, sf, "customer")
    return spark.sql(SETS)


@query("SELECT o_orderstatus, CAST(grouping(o_orderstatus) AS INT) AS g, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a15_grouping(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("g"), F.grouping_id().alias("gid"), F.count("*").alias("n")).select("o_orderstatus", "g", "gid", "n")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def a16_pivot(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0)


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS k FROM orders")
def w01_row_number(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("k"))


@query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS d FROM part")
def w02_rank(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf, "part").select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("SELECT p_partkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice)")
def w03_percent_rank(spark, sf):
    w = Window.partitionBy("p_type").orderBy("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS quartile FROM customer")
def w04_ntile(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.ntile(4).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).alias("quartile"))


@query("SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS before, lead(o_totalprice, 2) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w05_lag_lead(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_totalprice", 1, 0.0).over(w).alias("before"), F.lead("o_totalprice", 2).over(w).alias("later"))


@query("""SELECT event_id, first_value(event_type) OVER w AS first_type, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER w AS last_big, nth_value(event_id, 2) OVER w AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w06_first_last_nth(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "events").select("event_id", F.first("event_type").over(w).alias("first_type"), F.last(F.when(F.col("value") > 50, F.col("event_id")), ignorenulls=True).over(w).alias("last_big"), F.nth_value("event_id", 2).over(w).alias("second"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def w07_aggregate_over(spark, sf):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.count("*").over(w).alias("n"), F.max("o_totalprice").over(w).alias("top"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS mean FROM orders")
def w08_rows_frame(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("mean"))


INTERVAL_FRAME = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {i} PRECEDING AND CURRENT ROW) AS n FROM events"


@query(INTERVAL_FRAME.format(i="'3' DAY"))
def w09_range_interval(spark, sf):
    views(spark, sf, "events")
    return spark.sql(INTERVAL_FRAME.format(i="'3' DAY"))


@query("SELECT p_partkey, round(quantile_cont(p_retailprice, 0.5) OVER (PARTITION BY p_brand), 4) AS median FROM part")
def w10_percentile_over(spark, sf):
    # the group's percentile joined back: a window aggregate would hold each group whole
    m = table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.5), 4).alias("median"))
    return table(spark, sf, "part").join(m, "p_brand").select("p_partkey", "median")


NAMED = "SELECT s_suppkey, CAST(rank() OVER w AS INT) AS r, round(sum(s_acctbal) OVER w, 2) AS running FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)"


@query(NAMED)
def w11_named_window(spark, sf):
    views(spark, sf, "supplier")
    return spark.sql(NAMED)


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def p09_qualify(spark, sf):
    w = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")))
    return qualify(table(spark, sf, "orders"), "k", w, F.col("k") == 1).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def o01_order_limit(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("SELECT n_name, s_name FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey ORDER BY s_name NULLS LAST, n_name LIMIT 12")
def o02_nulls_last(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    return table(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "s_name").orderBy(F.col("s_name").asc_nulls_last(), "n_name").limit(12)


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 5 OFFSET 7")
def o04_offset(spark, sf):
    return table(spark, sf, "part").orderBy("p_retailprice", "p_partkey").offset(7).limit(5).select("p_partkey")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3")
def o05_top_n(spark, sf):
    from lodestream.plans.dialects import rewrite

    views(spark, sf, "supplier")
    return spark.sql(rewrite("SELECT TOP 3 s_suppkey, s_acctbal FROM supplier WITH (NOLOCK) ORDER BY s_acctbal DESC, s_suppkey"))


@query("SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 4")
def o06_fetch_first(spark, sf):
    from lodestream.plans.dialects import rewrite

    views(spark, sf, "supplier")
    return spark.sql(rewrite("SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey FETCH FIRST 4 ROWS ONLY"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def o07_group_top_k(spark, sf):
    return top_per_group(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def o08_sort_by(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 400000").select("o_orderkey").sortWithinPartitions("o_orderkey")


@query("""SELECT id, label, CAST(row_number() OVER (ORDER BY sort_key) AS INT) AS place FROM (
SELECT r_regionkey AS id, r_name AS label, r_name AS sort_key FROM region UNION ALL
SELECT n_nationkey + 100, n_name, concat(r_name, '/', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def o09_order_siblings(spark, sf):
    """Depth-first order of a two-level tree, siblings by name: a sort by the path as an array."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    roots = r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.array("r_name").alias("path"))
    leaves = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("label"), F.array("r_name", "n_name").alias("path"))
    return roots.union(leaves).select("id", "label", F.row_number().over(Window.orderBy("path")).alias("place"))


@query("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def u01_union_all(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")).unionAll(table(spark, sf, "region").select("r_regionkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct().union(table(spark, sf, "supplier").select("s_nationkey").distinct()).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def u03_intersect_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def u04_except(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").filter("s_acctbal > 3000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u04_except_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf, "supplier").select("s_nationkey"))


MINUS = "SELECT r_regionkey FROM region {op} SELECT n_regionkey FROM nation WHERE n_nationkey < 3"


@query(MINUS.format(op="EXCEPT"))
def u04_minus(spark, sf):
    views(spark, sf, "region", "nation")
    return spark.sql(MINUS.format(op="MINUS"))
