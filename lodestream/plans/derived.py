"""Answers from kept or derived structures: a view that follows its sources, a text index, nearest rows, samples of exact size."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestream.operators.incremental import JoinView, changes
from lodestream.operators.nearest import nearest
from lodestream.operators.sampling import draw, merge, sample_state
from lodestream.operators.text_index import TextIndex
from lodestream.plans.registry import query
from lodestream.sources.tables import table
from lodestream.sources.writers import shared_dir


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'H' ELSE o_orderstatus END AS status, year(o_orderdate) AS y FROM orders WHERE o_orderpriority <> '5-LOW'),
l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END AS price, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
SELECT status, CAST(y AS BIGINT) AS year, CAST(sum(price) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS n FROM o JOIN l ON l_orderkey = o_orderkey GROUP BY ALL""")
def m08_incremental_view(spark, sf):
    """Revenue by status and year: all orders and the lines shipped before 1997 first, then the other lines; then urgent orders are held and returned lines cost nothing; then low orders go."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag", "l_shipdate")
    view = JoinView(
        spark, f"{shared_dir(spark)}/view-{uuid.uuid4().hex}", orders.schema, lines.schema, ("o_orderkey", "l_orderkey"),
        {"status": F.col("o_orderstatus"), "year": F.year("o_orderdate").cast("long")}, {"revenue": F.col("price"), "quantity": F.col("quantity")}, parts=8,
    )
    early = F.coalesce(F.col("l_shipdate") < "1997-01-01", F.lit(False))
    view.apply(1, changes(orders), changes(lines.filter(early)))
    view.apply(2, right=changes(lines.filter(~early)))
    urgent, returned = orders.filter("o_orderpriority = '1-URGENT'"), lines.filter("l_returnflag = 'R'")
    held, free = urgent.withColumn("o_orderstatus", F.lit("H")), returned.withColumn("price", F.lit(0).cast("decimal(18,2)"))
    view.apply(3, changes(held, urgent), changes(free, returned))
    view.apply(3, changes(held, urgent), changes(free, returned))  # told twice, applied once
    view.apply(4, changes(deleted=orders.filter("o_orderpriority = '5-LOW'")))
    return view.read().withColumn("revenue", F.col("revenue").cast("double"))


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey) AS BIGINT) AS rank, s_suppkey AS neighbour, round(abs(s_acctbal - c_acctbal), 6) AS distance
FROM customer, supplier QUALIFY rank <= 5""")
def j10_nearest_suppliers(spark, sf):
    """Each customer's five nearest suppliers by balance."""
    out = nearest(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "supplier"), "c_acctbal", "s_acctbal", "s_suppkey", 5)
    return out.select("c_custkey", F.col("rank").cast("long").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


#: name: (kind, pattern); the same in SQL below
PATTERNS = {
    "like": ("like", "%river%"), "like_two": ("like", "%the%ing %"), "ilike": ("ilike", "%PLEASE%contact%"), "mail": ("rlike", r"[a-z]+@example\.(com|org)"), "number": ("rlike", r"version [0-9]+"),
    "nothing": ("like", "%qzxqzx%"), "short": ("like", "%qu%"),
}
SQL_OF = {"like": "text LIKE '{}'", "ilike": "text ILIKE '{}'", "rlike": "regexp_matches(text, '{}')"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS pattern, doc_id FROM documents WHERE {SQL_OF[kind].format(p)}" for name, (kind, p) in PATTERNS.items()))
def p11_indexed_search(spark, sf):
    """Seven patterns over all whole texts: five by their rarest pieces, two without pieces by a scan."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return TextIndex.build(documents, "text").search(PATTERNS).filter("matched").select("pattern", "doc_id")


PRIORITY_SQL = "(CAST('0x' || substr(md5(o_orderkey || '-5'), 1, 8) AS BIGINT)::DOUBLE + 1) / 4294967296.0::DOUBLE"


@query(f"""WITH p AS (SELECT o_orderkey, o_orderpriority, 1.0::DOUBLE / ({PRIORITY_SQL}) AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p DESC, o_orderkey) AS r FROM p),
t AS (SELECT *, greatest(1.0, coalesce(max(CASE WHEN r = 101 THEN p END) OVER (PARTITION BY o_orderpriority), 0.0)) AS s FROM r) SELECT o_orderpriority, o_orderkey, round(s, 6) AS stands_for FROM t WHERE r <= 100""")
def s17_exact_sample(spark, sf):
    """A hundred orders of each priority, from the merged samples of two years' halves: closed and open orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    closed = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    states = [sample_state(orders.filter(c), ["o_orderkey"], 100, ["o_orderpriority"], seed=5) for c in (closed, ~closed)]
    out = draw(merge(states, ["o_orderkey"], 100, ["o_orderpriority"]), 100, ["o_orderpriority"])
    return out.select("o_orderpriority", "o_orderkey", F.round("stands_for", 6).alias("stands_for"))


@query(f"""WITH p AS (SELECT o_orderkey, o_totalprice AS w, o_totalprice / ({PRIORITY_SQL}) AS p FROM orders WHERE o_totalprice > 0), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, o_orderkey) AS r FROM p),
t AS (SELECT *, greatest(w, coalesce((SELECT p FROM r WHERE r = 501), 0.0)) AS s FROM r) SELECT o_orderkey, round(s, 4) AS stands_for FROM t WHERE r <= 500""")
def s17_weighted_sample(spark, sf):
    """Five hundred orders drawn by price, with the price that each stands for."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = draw(sample_state(orders, ["o_orderkey"], 500, weight=F.col("o_totalprice"), seed=5), 500)
    return out.select("o_orderkey", F.round("stands_for", 4).alias("stands_for"))
