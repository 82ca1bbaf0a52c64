"""Event-time windows (extensions): the batch form of each query that streaming runs incrementally."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.plans.registry import query
from lodestream.sources.tables import table


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def x_tumbling(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1 day' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def x_sessions(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.session_window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
