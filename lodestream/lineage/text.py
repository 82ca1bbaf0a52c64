"""Script text as lines: counters, clause ranges, excerpts and highlights, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.relational import merge_ranges

CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT")


def lines(scripts: DataFrame) -> DataFrame:
    """(script, line, text), lines from 1."""
    return scripts.select("script", F.posexplode(F.split("sql_text", "\n")).alias("pos", "text")).select("script", (F.col("pos") + 1).alias("line"), "text")


def profile(scripts: DataFrame) -> DataFrame:
    """Counters of each script: lines, statements, joins, selects, cases, and how deep its parentheses nest."""
    count = lambda pattern: F.regexp_count("sql_text", F.lit(pattern)).cast("long")
    signs = F.split(F.regexp_replace("sql_text", r"[^()]", ""), "")
    depth = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda s, c: F.struct((s["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("now"), F.greatest(s["top"], s["now"] + F.when(c == "(", 1).otherwise(0)).alias("top")))["top"]
    return scripts.select("script", F.size(F.split("sql_text", "\n")).cast("long").alias("n_lines"), count(";").alias("statements"), count(r"(?i)\bJOIN\b").alias("joins"), count(r"(?i)\bSELECT\b").alias("selects"), count(r"(?i)\bCASE\b").alias("cases"), depth.cast("long").alias("depth"))


def clause_ranges(scripts: DataFrame) -> DataFrame:
    """(script, clause, low, high): from the first line that opens with a clause's words to before the next such line."""
    rows = lines(scripts)
    named = F.coalesce(*(F.when(F.upper(F.trim("text")).rlike(rf"^{c.replace(' ', '[ ]+')}\b"), c) for c in CLAUSES))
    first = rows.withColumn("clause", named).filter("clause is not null").groupBy("script", "clause").agg(F.min("line").alias("low"))
    last = rows.groupBy("script").agg(F.max("line").alias("last"))
    w = Window.partitionBy("script").orderBy("low")
    return first.join(last, "script").select("script", "clause", "low", F.coalesce(F.lead("low").over(w) - 1, "last").alias("high"))


def excerpts(scripts: DataFrame, ranges: DataFrame, around: int = 2) -> DataFrame:
    """(script, low, high, text, omitted): ranges (script, low, high) widened, joined where they meet, with their lines and the lines left out before."""
    rows = lines(scripts)
    last = rows.groupBy("script").agg(F.max("line").alias("last"))
    wide = ranges.join(last, "script").select("script", F.greatest(F.col("low") - around, F.lit(1)).alias("low"), F.least(F.col("high") + around, F.col("last")).alias("high"))
    merged = merge_ranges(wide, ["script"], "low", "high")
    inside = rows.join(merged, "script").filter("line BETWEEN low AND high")
    text = inside.groupBy("script", "low", "high").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    before = F.coalesce(F.lag("high").over(Window.partitionBy("script").orderBy("low")), F.lit(0))
    return text.withColumn("omitted", F.col("low") - before - 1)
