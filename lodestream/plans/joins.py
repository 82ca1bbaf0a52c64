"""Joins, semi-joins and subqueries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators.relational import asof_join, range_join, top_per_group
from lodestream.plans.registry import corpus_query, query
from lodestream.sources.tables import table, views


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def j01_inner(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 300000").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j02_left_outer(spark, sf):
    # counted before the join: the join then moves one row a customer
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000")
def j03_right_outer(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 8000")
    return s.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a
FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.k = b.k""")
def j04_full_outer(spark, sf):
    a = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full_outer")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j05_cross(spark, sf):
    return table(spark, sf, "region").crossJoin(table(spark, sf, "nation")).select("r_name", "n_name")


@query("SELECT n_name, count(*) AS n FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' GROUP BY n_name")
def j06_comma(spark, sf):
    views(spark, sf, "supplier", "nation", "region")
    return spark.sql("SELECT n_name, count(*) AS n FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' GROUP BY n_name")


BANDS = "SELECT * FROM (VALUES (0, 900.0, 1000.0), (1, 1000.0, 1300.0), (2, 1300.0, 1700.0), (3, 1700.0, 3000.0)) AS b(band, low, high)"


@query(f"SELECT band, count(*) AS n FROM part JOIN ({BANDS}) ON p_retailprice >= low AND p_retailprice < high GROUP BY band")
def j07_theta_range(spark, sf):
    bands = spark.createDataFrame([(0, 900.0, 1000.0), (1, 1000.0, 1300.0), (2, 1300.0, 1700.0), (3, 1700.0, 3000.0)], "band int, low double, high double")
    return range_join(table(spark, sf, "part").select("p_retailprice"), bands, "p_retailprice", "low", "high", 100.0).groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON concat('C', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) = concat('C', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) WHERE o_totalprice > 350000")
def j08_computed_key(spark, sf):
    key = lambda c: F.concat(F.lit("C"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 350000"), key("o_custkey") == key("c_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j09_self(spark, sf):
    a, b = table(spark, sf, "nation").alias("a"), table(spark, sf, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice,
row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') WHERE k <= 2""")
def j10_lateral_top(spark, sf):
    joined = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return top_per_group(joined, ["c_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name, d.total FROM nation JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey HAVING count(*) > 3) d ON d.c_nationkey = n_nationkey")
def j11_derived(spark, sf):
    d = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count("*").alias("n")).filter("n > 3")
    return table(spark, sf, "nation").join(d, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "total")


@query("SELECT n_nationkey, w.part FROM nation, LATERAL (SELECT unnest(string_split(n_name, 'N')) AS part) w WHERE length(w.part) > 3")
def j12_unnest(spark, sf):
    """JOIN UNNEST: an exploded array beside its row."""
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(F.split("n_name", "N")).alias("part"))
    return rows.filter(F.length("part") > 3)


@query("SELECT n_name, v.label FROM nation JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS v(k, label) ON n_regionkey = v.k")
def j12_values(spark, sf):
    views(spark, sf, "nation")
    return spark.sql("SELECT n_name, v.label FROM nation JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS v(k, label) ON n_regionkey = v.k")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def j13_semi(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 250000")
    return table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def j13_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


EXISTS = "SELECT p_partkey FROM part p WHERE p_size < 10 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_returnflag = 'R' AND l_discount > 0.09)"


@query(EXISTS)
def j14_exists(spark, sf):
    views(spark, sf, "part", "lineitem")
    return spark.sql(EXISTS)


IN_LISTS = "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08 AND l_suppkey IS NOT NULL)"


@query(IN_LISTS)
def j15_in_subquery(spark, sf):
    views(spark, sf, "supplier", "nation", "lineitem")
    return spark.sql(IN_LISTS)


@query("SELECT k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)")
def j16_using(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_cust"))
    return a.join(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supp")), on=["k"])


NATURAL = "SELECT k, a_n, b_n FROM (SELECT n_regionkey AS k, count(*) AS a_n FROM nation GROUP BY n_regionkey) NATURAL JOIN (SELECT r_regionkey AS k, CAST(length(r_name) AS INT) AS b_n FROM region)"


@query(NATURAL)
def j16_natural(spark, sf):
    views(spark, sf, "nation", "region")
    return spark.sql(NATURAL)


@query("""SELECT e.event_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts = (SELECT max(f.ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'click' AND f.ts <= e.ts)) AS click_id
FROM events e WHERE e.event_type = 'error'""")
def jx_asof(spark, sf):
    """As-of join (an extension): each error with the user's latest click up to it."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.filter("event_type = 'error'").drop("event_type")
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return asof_join(errors, clicks, "user_id", "ts", "ts", ["click_id"], width=86400.0).select("event_id", "click_id")


SCALAR = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)"


@query(SCALAR)
def c06_scalar_subquery(spark, sf):
    views(spark, sf, "orders")
    return spark.sql(SCALAR)


CORRELATED = "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > 1.7 * (SELECT avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)"


@query(CORRELATED)
def c07_correlated(spark, sf):
    # one pass: the part's mean over its window instead of a second scan and a join
    from pyspark.sql import Window

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return lines.withColumn("mean", F.avg("l_quantity").over(Window.partitionBy("l_partkey"))).filter("l_quantity > 1.7 * mean").select("l_orderkey", "l_linenumber")


CTES = """WITH recent AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
ranked AS (SELECT c_custkey, c_nationkey, n, total FROM customer JOIN recent ON c_custkey = o_custkey)
SELECT n_name, count(*) AS customers, sum(n) AS n_orders, round(sum(total), 0) AS total FROM ranked JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


@query(CTES.replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def c02_chained_cte(spark, sf):
    views(spark, sf, "orders", "customer", "nation")
    return spark.sql(CTES)


HIERARCHY = """WITH RECURSIVE tree AS (SELECT r_regionkey AS id, CAST(r_name AS {s}) AS path, 0 AS depth FROM region
UNION ALL SELECT n.n_nationkey + 100 AS id, concat(t.path, '/', n.n_name) AS path, t.depth + 1 AS depth FROM tree t JOIN nation n ON n.n_regionkey = t.id AND t.depth = 0)
SELECT id, path, depth FROM tree"""


@query(HIERARCHY.format(s="VARCHAR"))
def c03_recursive_cte(spark, sf):
    views(spark, sf, "region", "nation")
    return spark.sql(HIERARCHY.format(s="STRING"))


@corpus_query("WITH RECURSIVE c AS (SELECT 1 AS level, CAST('1' AS VARCHAR) AS path UNION ALL SELECT level + 1, concat(path, '>', CAST(level + 1 AS VARCHAR)) FROM c WHERE level < 6) SELECT level, path FROM c")
def c04_connect_by(spark, sf):
    """CONNECT BY LEVEL <= 6 with its path, as the rewriter makes it."""
    from lodestream.plans.dialects import rewrite

    return spark.sql(rewrite("SELECT LEVEL AS level, SYS_CONNECT_BY_PATH(LEVEL, '>') AS path FROM dual CONNECT BY LEVEL <= 6"))


DERIVED = "SELECT d.c_nationkey, d.best FROM (SELECT c_nationkey, max(c_acctbal) AS best FROM customer GROUP BY c_nationkey) d WHERE d.best > 9000"


@query(DERIVED)
def c05_derived_table(spark, sf):
    views(spark, sf, "customer")
    return spark.sql(DERIVED)
