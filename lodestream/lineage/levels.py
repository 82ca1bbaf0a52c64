"""The view over all scripts: searches, the flow of one field through scripts and tables, and its layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.lineage import closure as walks
from lodestream.operators.graph import _keep, reach

RESULT = "⟐ result"
MOST_LAYERS = 10


def _links(io: DataFrame) -> DataFrame:
    """(source, target, script, table, role): tables read by scripts, and written by them."""
    reads = io.filter("direction = 'input'").select(F.col("table").alias("source"), F.col("script").alias("target"), "script", "table", F.lit("reads_from").alias("role"))
    return reads.union(io.filter("direction = 'output'").select(F.col("script").alias("source"), F.col("table").alias("target"), "script", "table", F.lit("writes_to").alias("role")))


def directional_flow(found: DataFrame, edges: DataFrame, io: DataFrame, table: str, field: str, direction: str = "upstream") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (source, target, role): scripts whose closure of the field in that direction is not empty, the whole tables that own a node
    of it, and what reads and writes tie them. Without any the flow is empty."""
    closure = _keep((walks.downstream if direction == "downstream" else walks.upstream)(found, edges, table, field))
    owned = _keep(closure.join(found.filter("kind = 'physical'").select("script", "id", F.col("key").alias("table")), ["script", "id"]).select("script", "table").distinct())
    links = _links(io).join(owned.select("script").distinct(), "script", "left_semi").join(owned.select("table").distinct(), "table", "left_semi")
    nodes = closure.select(F.col("script").alias("node"), F.lit("script").alias("kind")).distinct().union(owned.select(F.col("table").alias("node"), F.lit("table").alias("kind")).distinct())
    return nodes, links.select("source", "target", "role").distinct()


def pair_closure(fields: DataFrame, table: str, field: str) -> DataFrame:
    """(table, field): all pairs that production ties to the searched one, over any number of scripts and either way; names that one script alone knows carry the way but are not told."""
    seed = fields.sparkSession.createDataFrame([(f"{table}.{field}".lower(),)], "node string")
    both = fields.select("source", "target").union(fields.select("target", "source"))
    known = reach(seed, both, "source", "target").filter("node NOT LIKE '%#%'")
    return known.select(F.expr("substring_index(node, '.', size(split(node, '[.]')) - 1)").alias("table"), F.regexp_extract("node", r"([^.]+)$", 1).alias("field")).distinct()


def search(uses: DataFrame, found: DataFrame, edges: DataFrame, table: str, field: str | None = None, direction: str = "upstream") -> DataFrame:
    """One row (mode, scripts, flow_scripts) for a table and a field, or a table alone.

    With a field: the scripts that use both; no_matches without any, no_flow if the field's closure in that direction is empty in all, else
    exact. Of a table alone: its scripts, and all that tables in common tie to them: expanded if these are more.
    """
    spark = uses.sparkSession
    u = uses.filter(F.col("table") == table.lower())
    array = lambda df: F.array_sort(F.collect_set(df))
    if field is not None:
        hits = _keep(u.filter(F.col("field") == field.lower()).select("script").distinct())
        flow = (walks.downstream if direction == "downstream" else walks.upstream)(found, edges, table, field).select("script").distinct().join(hits, "script", "left_semi")
        both = hits.agg(array("script").alias("scripts")).crossJoin(flow.agg(array("script").alias("flow_scripts")))
        mode = F.when(F.size("scripts") == 0, "no_matches").when(F.size("flow_scripts") == 0, "no_flow").otherwise("exact")
        return both.select(mode.alias("mode"), "scripts", "flow_scripts")
    touch = uses.select("script", "table").distinct()
    steps = touch.select(F.concat(F.lit("s:"), "script").alias("a"), F.concat(F.lit("t:"), "table").alias("b"))
    reached = reach(spark.createDataFrame([(f"t:{table.lower()}",)], "node string"), steps.union(steps.select("b", "a")), "a", "b").filter("node LIKE 's:%'").select(F.substring("node", 3, 1 << 20).alias("script"))
    both = u.agg(array("script").alias("exact")).crossJoin(reached.agg(array("script").alias("scripts")))
    mode = F.when(F.size("exact") == 0, "no_matches").when(F.size("scripts") > F.size("exact"), "expanded").otherwise("exact")
    return both.select(mode.alias("mode"), F.when(F.size("exact") == 0, F.col("exact")).otherwise(F.col("scripts")).alias("scripts"), F.array().cast("array<string>").alias("flow_scripts"))


def pipeline(io: DataFrame, resolved: DataFrame, uses: DataFrame, pairs: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, parent, part) and edges (source, target, role, roles) of the scripts (script).

    Tables are source, intermediate or output; a table's fields are direct if they belong to the searched pair's closure, else indirect; a
    script that writes nothing ends in a result. An edge tells the clauses that the script uses the table in.
    """
    from lodestream.lineage.flow import table_roles

    here = _keep(io.join(scripts, "script", "left_semi"))
    tables = table_roles(here).select(F.col("table").alias("node"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("parent"), F.col("role").alias("part"))
    own = uses.join(scripts, "script", "left_semi").join(here.select("table").distinct(), "table", "left_semi").select("table", "field").distinct()
    part = F.when(F.col("known"), "direct").otherwise("indirect")
    fields = own.join(pairs.withColumn("known", F.lit(True)), ["table", "field"], "left").select(F.concat_ws(".", "table", "field").alias("node"), F.lit("field").alias("kind"), F.col("table").alias("parent"), part.alias("part"))
    ends = scripts.join(here.filter("direction = 'output'"), "script", "left_anti")
    nodes = scripts.select(F.col("script").alias("node"), F.lit("script").alias("kind"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("part")).unionByName(tables).unionByName(fields)
    nodes = nodes.unionByName(ends.select(F.concat("script", F.lit(f"#{RESULT}")).alias("node"), F.lit("result").alias("kind"), F.col("script").alias("parent"), F.lit("output").alias("part")))
    clauses = resolved.select("script", F.lower("table").alias("table"), "clause").groupBy("script", "table").agg(F.sort_array(F.collect_set("clause")).alias("roles"))
    links = _links(here).join(clauses, ["script", "table"], "left").select("source", "target", "role", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))
    return nodes, links.unionByName(ends.select(F.col("script").alias("source"), F.concat("script", F.lit(f"#{RESULT}")).alias("target"), F.lit("writes_to").alias("role"), F.array().cast("array<string>").alias("roles")))


def lineage_filter(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a pipeline: the direct fields; the tables that hold one, and those that a script with one of its tables left writes last; the scripts that an edge still ties."""
    fields = nodes.filter("kind = 'field' AND part = 'direct'")
    holding = _keep(fields.select(F.col("parent").alias("node")).distinct())
    touched = edges.join(holding.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("script")).union(edges.join(holding.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("script"))).distinct()
    read_on = edges.select(F.col("source").alias("node")).distinct()
    last = edges.filter("role = 'writes_to'").join(touched.withColumnRenamed("script", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct().join(read_on, "node", "left_anti")
    tables = nodes.filter("kind IN ('table', 'result')").join(holding.union(last).distinct(), "node", "left_semi")
    ends = _keep(tables.select("node").union(nodes.filter("kind = 'script'").select("node")))
    kept = edges.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")
    tied = kept.select(F.col("source").alias("node")).union(kept.select("target")).distinct()
    return nodes.filter("kind = 'script'").join(tied, "node", "left_semi").unionByName(tables).unionByName(fields), kept


def smooth(layers: DataFrame, edges: DataFrame, source: str, target: str, most_rounds: int = 20) -> DataFrame:
    """(node, layer): a node more than one layer behind its furthest neighbour moves up to one behind it; at most ``most_rounds`` such passes, by definition."""
    both = edges.select(F.col(source).alias("node"), F.col(target).alias("other")).union(edges.select(F.col(target), F.col(source)))
    now = layers.select("node", "layer")
    for _ in range(most_rounds):
        far = both.join(now.select(F.col("node").alias("other"), F.col("layer").alias("far")), "other").groupBy("node").agg(F.max("far").alias("far"))
        up = F.when(F.col("far") > F.col("layer") + 1, F.least(F.col("far") - 1, F.lit(MOST_LAYERS))).otherwise(F.col("layer"))
        new = _keep(now.join(far, "node", "left").select("node", F.col("layer").alias("before"), up.alias("layer")))
        now = new.select("node", "layer")
        if new.filter("layer <> before").isEmpty():
            break
    return now
