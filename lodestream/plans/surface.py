"""Projection, predicates, scalar functions, statements that change tables, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import dialect
from lodestream.operators.relational import delete_rows, delete_using, hash_sample, merge_into, merge_ranges, update_from, update_rows
from lodestream.plans.registry import corpus_query, query
from lodestream.sources.tables import table, views


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_linenumber = 1")
def p01_project(spark, sf):
    return table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.round(F.expr("l_extendedprice * (1 - l_discount)"), 6).alias("net"))


@query("SELECT * FROM nation")
def p03_star(spark, sf):
    return table(spark, sf, "nation").select("*")


@query("SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")
def p04_qualified_star(spark, sf):
    return table(spark, sf, "nation").alias("n").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n.*", "r_name")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def p06_distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01' AND o_orderstatus <> 'P'")
def p07_where(spark, sf):
    return table(spark, sf, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1995-04-01' AND o_orderstatus <> 'P'").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_name LIKE '%a%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND p_type IS NOT NULL")
def p10_predicates(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_size").between(5, 9) & F.col("p_name").like("%a%") & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23", "Brand#34") & F.col("p_type").isNotNull()).select("p_partkey")


@query("SELECT n_name FROM nation WHERE n_name ILIKE '%A_I%' OR regexp_matches(n_name, '^[A-E].*A$')")
def p11_ilike_rlike(spark, sf):
    return table(spark, sf, "nation").filter(F.col("n_name").ilike("%A_I%") | F.col("n_name").rlike("^[A-E].*A$")).select("n_name")


@query("SELECT r_name, 7 AS seven, 'x' AS letter, NULL::INT AS nothing FROM region")
def p12_literals(spark, sf):
    return table(spark, sf, "region").select("r_name", F.lit(7).alias("seven"), F.lit("x").alias("letter"), F.lit(None).cast("int").alias("nothing"))


@query("SELECT x.k AS key, x.total FROM (SELECT o_custkey AS k, count(*) AS total FROM orders GROUP BY 1) AS x WHERE x.total >= 14")
def p13_alias(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("total")).alias("x").filter("x.total >= 14").select(F.col("x.k").alias("key"), "x.total")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), '-') AS status,
greatest(o_totalprice, 1000.0) AS g, least(o_totalprice, 1000.0) AS l, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done FROM orders""")
def f_conditional(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(price > 200000, "high").when(price > 100000, "mid").otherwise("low").alias("band"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("-")).alias("status"),
        F.greatest(price, F.lit(1000.0)).alias("g"), F.least(price, F.lit(1000.0)).alias("l"), F.expr("if(o_orderstatus = 'F', 1, 0)").alias("done"),
    )


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '?' END AS d FROM nation")
def f_decode(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", dialect.decode_oracle(F.col("n_regionkey"), 0, "a", 1, "b", "?").alias("d"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS d, TRY_CAST(p_brand AS INT) AS bad FROM part")
def f_cast(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("d"), F.col("p_brand").try_cast("int").alias("bad"))


@query("""SELECT n_nationkey, concat(lower(n_name), '-', upper(n_name)) AS both, lpad(n_name, 12, '*') AS padded, substr(n_name, 2, 3) AS part, length(n_name) AS n, replace(n_name, 'A', 'a') AS r, trim(concat(' ', n_name, ' ')) AS t,
regexp_replace(n_name, '[AEIOU]', '_', 'g') AS v, split_part(n_name, ' ', 1) AS head, reverse(n_name) AS back, n_name || '!' AS bang FROM nation""")
def f_string(spark, sf):
    name = F.col("n_name")
    return table(spark, sf, "nation").select(
        "n_nationkey", F.concat(F.lower(name), F.lit("-"), F.upper(name)).alias("both"), F.lpad(name, 12, "*").alias("padded"), F.substring(name, 2, 3).alias("part"), F.length(name).cast("long").alias("n"), F.replace(name, F.lit("A"), F.lit("a")).alias("r"),
        F.trim(F.concat(F.lit(" "), name, F.lit(" "))).alias("t"), F.regexp_replace(name, "[AEIOU]", "_").alias("v"), F.substring_index(name, " ", 1).alias("head"), F.reverse(name).alias("back"), F.expr("n_name || '!'").alias("bang"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS before, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, date_diff('month', DATE '1992-01-01', date_trunc('month', o_orderdate)) AS months,
date_trunc('quarter', o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m') AS ym, extract(year FROM o_orderdate) AS y, extract(dow FROM o_orderdate) + 1 AS dow FROM orders""")
def f_date(spark, sf):
    d = F.col("o_orderdate")
    ym = F.year(d) * 100 + F.month(d)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.to_date(d).alias("day"), F.date_sub(F.to_date(d), 30).cast("timestamp_ntz").alias("before"), F.datediff(d, F.lit("1992-01-01")).cast("long").alias("days"), dialect.period_diff(ym, F.lit(199201)).cast("long").alias("months"),
        F.expr("CAST(date_trunc('QUARTER', o_orderdate) AS TIMESTAMP_NTZ)").alias("quarter"), F.date_format(d, "yyyy-MM").alias("ym"), F.year(d).cast("long").alias("y"), F.dayofweek(d).cast("long").alias("dow"),
    )


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, c_custkey % 7 AS m, round(sqrt(abs(c_acctbal)), 6) AS s, round(exp(c_nationkey / 10.0), 6) AS e, round(ln(1 + abs(c_acctbal)), 6) AS l, round(power(c_nationkey, 2), 3) AS p FROM customer")
def f_math(spark, sf):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf, "customer").select("c_custkey", F.abs(b).alias("a"), F.round(b, 1).alias("r"), F.ceil(b).alias("c"), F.floor(b).alias("f"), (F.col("c_custkey") % 7).alias("m"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.round(F.exp(n / F.lit(10.0)), 6).alias("e"), F.round(F.ln(1 + F.abs(b)), 6).alias("l"), F.round(F.pow(n, F.lit(2)), 3).alias("p"))


@query("SELECT event_id, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.at.user') AS user FROM (SELECT event_id, concat('{\"type\":\"', event_type, '\",\"at\":{\"user\":', CAST(user_id AS VARCHAR), '}}') AS j FROM events)")
def f_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("at"))).alias("j"))
    return e.select("event_id", dialect.json_text(F.col("j"), "type").alias("type"), dialect.json_text(F.col("j"), "at", "user").alias("user"))


@query("SELECT n_nationkey, len(a) AS n, a[1] AS head, a[9] AS none, list_sum(list_transform(a, lambda x: x * 2))::BIGINT AS twice, len(list_filter(a, lambda x: x > 2))::BIGINT AS big FROM (SELECT n_nationkey, [n_regionkey, n_nationkey, n_nationkey % 3] AS a FROM nation)")
def f_array(spark, sf):
    a = F.col("a")
    rows = table(spark, sf, "nation").select("n_nationkey", F.array("n_regionkey", "n_nationkey", F.col("n_nationkey") % 3).alias("a"))
    return rows.select("n_nationkey", F.size(a).cast("long").alias("n"), dialect.safe_offset(a, 0).alias("head"), dialect.safe_offset(a, 8).alias("none"), F.aggregate(F.transform(a, lambda x: x * 2), F.lit(0), lambda s, x: s + x).cast("long").alias("twice"), F.size(F.filter(a, lambda x: x > 2)).cast("long").alias("big"))


@query("SELECT n_nationkey, n_name AS by_key, n_regionkey AS field FROM nation")
def f_map_struct(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.create_map(F.lit("name"), F.col("n_name")).alias("m"), F.struct(F.struct("n_regionkey").alias("in")).alias("s"))
    return rows.select("n_nationkey", F.col("m")["name"].alias("by_key"), F.col("s.in.n_regionkey").alias("field"))


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation")
def f_spatial(spark, sf):
    wkt = F.concat(F.lit("POINT("), F.col("n_nationkey"), F.lit(" "), F.col("n_regionkey"), F.lit(")"))
    return table(spark, sf, "nation").select("n_nationkey", dialect.point_x(wkt).alias("x"), dialect.point_y(wkt).alias("y"))


@query("SELECT r_regionkey, concat('{\"r_regionkey\":', CAST(r_regionkey AS VARCHAR), ',\"r_name\":\"', r_name, '\"}') AS row FROM region")
def f_row_to_json(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("row"))


@corpus_query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(id, letter)")
def s14_values(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(id, letter)")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def s15_unnest(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode(F.split("n_name", " ")).alias("word"))


@query("SELECT n_nationkey, CAST(p - 1 AS INT) AS pos, w[p] AS word FROM (SELECT n_nationkey, string_split(n_name, ' ') AS w, unnest(range(1, len(string_split(n_name, ' ')) + 1)) AS p FROM nation)")
def s16_lateral_view(spark, sf):
    views(spark, sf, "nation")
    return spark.sql("SELECT n_nationkey, pos, word FROM nation LATERAL VIEW posexplode(split(n_name, ' ')) x AS pos, word")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5(l_orderkey || '-' || l_linenumber || '-7'), 1, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)")
def s17_sample(spark, sf):
    """A tenth of the lines, drawn by a hash of the key and a seed: the feature is a sample, and this one can be told in SQL."""
    return hash_sample(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 0.1, 7).select("l_orderkey", "l_linenumber")


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def s08_cached_source(spark, sf):
    """Read through a Parquet table keyed by the content's hash, as the analysis cache is."""
    from lodestream.sources.cache import cached

    return cached(spark, "supplier-by-nation", [f"{sf}/supplier.parquet"], lambda: table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")))


PARTS = "SELECT p_brand, p_partkey, p_size FROM part WHERE p_size > 40"


@query(PARTS)
def m01_insert_select(spark, sf):
    from lodestream.sources.writers import scratch_table

    rows = table(spark, sf, "part").filter("p_size > 40").select("p_brand", "p_partkey", "p_size")
    with_rows = scratch_table(spark, rows.filter("p_size <= 45"), mode="error")
    return scratch_table(spark, rows.filter("p_size > 45"), mode="append", path=with_rows[1])[0].select("p_brand", "p_partkey", "p_size")


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_nationkey, s_suppkey, 0.0 FROM supplier WHERE s_nationkey = 3")
def m02_overwrite_partition(spark, sf):
    """INSERT OVERWRITE of one partition: dynamic partition overwrite leaves the others."""
    from lodestream.sources.writers import scratch_table

    rows = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    _, path = scratch_table(spark, rows, mode="error", by=["s_nationkey"])
    new = rows.filter("s_nationkey = 3").withColumn("s_acctbal", F.lit(0.0))
    return scratch_table(spark, new, mode="overwrite", path=path, by=["s_nationkey"])[0].select("s_nationkey", "s_suppkey", "s_acctbal")


@query("SELECT 'ship' AS arm, l_orderkey AS k FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'return', l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 2")
def m04_multi_insert(spark, sf):
    """FROM t INSERT ... INSERT ...: one scan, a row for each arm that its row meets."""
    arms = F.array(F.when(F.col("l_quantity") > 49, "ship"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 2), "return"))
    return table(spark, sf, "lineitem").select(F.explode(F.array_compact(arms)).alias("arm"), F.col("l_orderkey").alias("k"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def m05_update(spark, sf):
    return update_rows(table(spark, sf, "customer"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("DEBT")}).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("""SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def m05_update_from(spark, sf):
    """UPDATE customer SET c_acctbal = c_acctbal + n FROM (finished orders by customer)."""
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return update_from(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), done, "c_custkey", {"c_acctbal": F.col("t.c_acctbal") + F.col("s.n")})


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < o.o_totalprice / 1000)")
def m06_delete_using(spark, sf):
    """DELETE FROM orders USING customer WHERE key and balance meet."""
    t, c = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return delete_using(t, c, (F.col("t.o_custkey") == F.col("s.c_custkey")) & (F.col("s.c_acctbal") < F.col("t.o_totalprice") / 1000)).select("o_orderkey")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100, 'MOON'), (101, NULL)) AS v(r_regionkey, r_name)")
def m03_insert_values(spark, sf):
    """INSERT INTO region VALUES ...: an append to a written table."""
    from lodestream.sources.writers import scratch_table

    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    _, path = scratch_table(spark, rows, mode="error")
    return scratch_table(spark, spark.createDataFrame([(100, "MOON"), (101, None)], rows.schema), mode="append", path=path)[0]


@query("SELECT p_partkey FROM part WHERE NOT coalesce(p_size > 25 OR p_brand = 'Brand#11', false)")
def m06_delete(spark, sf):
    return delete_rows(table(spark, sf, "part"), (F.col("p_size") > 25) | (F.col("p_brand") == "Brand#11")).select("p_partkey")


@query("""SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN s.v WHEN s.k IS NULL THEN t.v ELSE t.v + s.v END AS v
FROM (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0) t FULL OUTER JOIN (SELECT s_suppkey AS k, 1.0 AS v FROM supplier WHERE s_suppkey % 2 = 0) s ON t.k = s.k""")
def m07_merge(spark, sf):
    s = table(spark, sf, "supplier")
    target = s.filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    source = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.lit(1.0).alias("v"))
    return merge_into(target, source, "k", {"v": F.col("t.v") + F.col("s.v")}, {"k": F.col("s.k"), "v": F.col("s.v")})


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def m08_view(spark, sf):
    table(spark, sf, "orders").filter("o_totalprice > 100000").createOrReplaceTempView("large_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM large_orders GROUP BY o_orderstatus")


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def m10_ctas(spark, sf):
    from lodestream.sources.writers import scratch_table

    return scratch_table(spark, table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total")), mode="error")[0]


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def m11_select_into(spark, sf):
    from lodestream.plans.dialects import into_target, rewrite

    views(spark, sf, "nation")
    text = "SELECT n_nationkey INTO asia FROM nation WHERE n_regionkey = 2"
    spark.sql(rewrite(text)).createOrReplaceTempView(into_target(text))
    return spark.table("asia")


@query("""SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY lo, hi) AS island FROM (
SELECT l_suppkey, lo, hi, CASE WHEN max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= lo THEN 0 ELSE 1 END AS new
FROM (SELECT l_suppkey, l_orderkey AS lo, l_orderkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem))) GROUP BY l_suppkey, island""")
def g18_merge_ranges(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return merge_ranges(rows, ["l_suppkey"], "lo", "hi", width=100_000.0)
