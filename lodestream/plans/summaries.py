"""Summaries that are merged from smaller ones: cubes over a lattice, sketches, exact percentiles of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators.lattice import cube, grouping_sets
from lodestream.operators.sketches import estimates, percentiles, roll_up, sketch
from lodestream.plans.registry import query
from lodestream.sources.tables import table
from lodestream.sources.writers import scratch_table

FIVE = "l_returnflag, l_linestatus, l_linenumber, ship_year, discount"


@query(f"""WITH l AS (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS ship_year, CAST(round(l_discount * 100) AS BIGINT) AS discount FROM lineitem)
SELECT {FIVE}, CAST(grouping({FIVE}) AS BIGINT) AS grouping_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, round(avg(CAST(l_quantity AS DECIMAL(18, 2))), 6) AS quantity,
round(sqrt(var_samp(l_extendedprice)), 2) AS spread, count(DISTINCT l_suppkey) AS suppliers, max(l_tax) AS tax, count(*) AS n FROM l GROUP BY CUBE ({FIVE})""")
def a13_cube_lattice(spark, sf):
    """Five dimensions of all line items: thirty-two groupings, one of them read from the rows."""
    rows = table(spark, sf, "lineitem").withColumns({"ship_year": F.year("l_shipdate").cast("long"), "discount": F.round(F.col("l_discount") * 100).cast("long")})
    measures = {
        "revenue": ("sum", F.col("l_extendedprice").cast("decimal(18,2)")), "quantity": ("avg", F.col("l_quantity").cast("decimal(18,2)")), "spread": ("variance", "l_extendedprice"),
        "suppliers": ("distinct", "l_suppkey"), "tax": ("max", "l_tax"), "n": ("count", F.lit(1)),
    }
    out = cube(rows, FIVE.split(", "), measures)
    return out.withColumns({"revenue": F.col("revenue").cast("double"), "quantity": F.round("quantity", 6), "spread": F.round(F.sqrt("spread"), 2)})


@query("""SELECT o_orderstatus, o_orderpriority, order_year, CAST(grouping(o_orderstatus, o_orderpriority, order_year) AS BIGINT) AS grouping_id, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS order_year FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (order_year, o_orderpriority), (o_orderpriority), (order_year), ())""")
def a14_grouping_sets_lattice(spark, sf):
    """Two groupings read the rows, the others their smaller parent."""
    rows = table(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate").cast("long"))
    sets = [("o_orderstatus", "o_orderpriority"), ("order_year", "o_orderpriority"), ("o_orderpriority",), ("order_year",), ()]
    return grouping_sets(rows, ["o_orderstatus", "o_orderpriority", "order_year"], sets, {"n": ("count", F.lit(1)), "customers": ("distinct", "o_custkey")})


@query("SELECT event_type, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY ALL")
def a03_sketched_users(spark, sf):
    """Distinct users by type and month from stored daily states, held against the exact count: off by four standard errors (3.3 per cent) and a half at most."""
    events = table(spark, sf, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    daily, _ = scratch_table(spark, sketch(events, ["event_type", "day"], distinct="user_id"))
    month = [F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month")]
    told = estimates(roll_up(daily.select("event_type", *month, "n_states", "distinct_state"), ["event_type", "year", "month"]))
    exact = events.select("event_type", "user_id", *month).groupBy("event_type", "year", "month").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("n_distinct") - F.col("users")) <= 4 * 0.0082 * F.col("users") + 0.5
    return exact.join(told, ["event_type", "year", "month"]).select("event_type", "year", "month", "users", near.alias("near"))


@query("SELECT o_orderpriority, share, true AS near FROM (SELECT DISTINCT o_orderpriority FROM orders), (VALUES (0.1), (0.5), (0.9)) AS s(share)")
def a07_sketched_percentiles(spark, sf):
    """Prices at three shares from stored monthly states: the true share of rows at or below is off by three per cent at most."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", F.trunc("o_orderdate", "month").alias("month"))
    monthly, _ = scratch_table(spark, sketch(orders, ["o_orderpriority", "month"], quantiles="o_totalprice"))
    told = estimates(roll_up(monthly, ["o_orderpriority"]), [0.1, 0.5, 0.9]).select("o_orderpriority", F.explode(F.map_from_arrays(F.array(*map(F.lit, (0.1, 0.5, 0.9))), "quantiles")).alias("share", "price"))
    at_or_below = F.avg((F.col("o_totalprice") <= F.col("price")).cast("double"))
    ranked = orders.join(told, "o_orderpriority").groupBy("o_orderpriority", "share").agg(at_or_below.alias("rank"))
    return ranked.select("o_orderpriority", "share", (F.abs(F.col("rank") - F.col("share")) <= 0.03).alias("near"))


@query("""SELECT l_returnflag, l_linenumber, unnest([0.25, 0.5, 0.99]) AS share, round(unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.99])), 4) AS price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def w10_exact_percentiles_by_group(spark, sf):
    """Exact percentiles of growing groups: a sketch bounds the rows that are sorted."""
    out = percentiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice", [0.25, 0.5, 0.99])
    return out.select("l_returnflag", "l_linenumber", "share", F.round("value", 4).alias("price"), "n")
