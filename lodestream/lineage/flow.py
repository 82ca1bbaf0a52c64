"""Which fields flow into which, over scripts; who reads and writes what; roles, pipelines, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.lineage.analysis import Analysis
from lodestream.lineage.resolve import resolve
from lodestream.operators.graph import degrees, layers, reach, shortest_paths

#: Edge types and how a walk treats them: whether a value passes, and whether it may be walked backwards.
EDGE_TYPES = (
    ("REF", True, False, "FIELD_WALKABLE"), ("TRANSFORM", True, False, "FIELD_WALKABLE"), ("AGGREGATE", True, False, "FIELD_WALKABLE"), ("WINDOW", True, False, "FIELD_WALKABLE"), ("COMPUTED", True, False, "FIELD_WALKABLE"),
    ("DML", True, False, "CONDITIONAL"), ("ALIAS", True, False, "CONDITIONAL"), ("TABLE_FLOW", False, True, "CONDITIONAL"), ("FILTER", False, False, "CONDITIONAL"), ("JOIN", False, False, "CONDITIONAL"),
    ("SCHEMA", False, False, "NEVER_WALKED"), ("SUBQUERY", False, True, "NEVER_WALKED"), ("SET_OP", False, True, "NEVER_WALKED"), ("CORRELATED", False, True, "NEVER_WALKED"), ("INDIRECT", False, True, "NEVER_WALKED"), ("SUBSET", False, False, "NEVER_WALKED"), ("ROW_FLOW", False, False, "NEVER_WALKED"),
)


def owner_of(context: Column) -> Column:
    """The table-like thing that a context's output columns belong to, branches of a set operation to the whole; null for a statement's own output."""
    whole = F.regexp_replace(context, r"(/union\d+)+$", "")
    return (
        F.when(whole.rlike(r"^CTE\{[^}]*\}$"), F.regexp_extract(whole, r"^CTE\{([^}]*)\}$", 1))
        .when(whole.rlike(r"(/subq/|:join:)[^/:]+$"), F.regexp_extract(whole, r"(?:/subq/|:join:)([^/:]+)$", 1))
        .when(whole.rlike(r"^(VIEW|CTAS):[^/]+$"), F.regexp_extract(whole, r"^(?:VIEW|CTAS):([^/]+)$", 1))
    )


def node_of(script: Column, table: Column, field: Column, local: Column) -> Column:
    """table.field in lower case; of a name that only the script knows, after the script and ``#``."""
    return F.lower(F.concat(F.when(local, F.concat(script, F.lit("#"))).otherwise(F.lit("")), table, F.lit("."), field))


def field_edges(analysis: Analysis) -> DataFrame:
    """(script, source, target, kind, line): each output column, by its sources' tables where these are resolved."""
    v = analysis.variables
    statements = analysis.statements.filter("target is not null AND kind IN ('INSERT', 'SELECT INTO')").select("script", "statement", F.posexplode(F.split("target", ",")).alias("arm", "written"))
    ctes = analysis.scopes.filter("kind IN ('cte', 'derived', 'unnest', 'values')").select("script", F.lower(F.when(F.col("kind") == "derived", F.col("alias")).otherwise(F.col("table"))).alias("local")).distinct()
    items = v.filter("defined_in IN ('SELECT', 'UPDATE SET', 'MERGE SET') AND variable_type <> 'literal'").withColumn("owner", owner_of(F.col("context")))
    whole = F.regexp_replace("context", r"(/union\d+)+$", "")
    arm = F.coalesce(F.regexp_extract(whole, r"^TOP\d+/hive_arm(\d+)$", 1).try_cast("int"), F.lit(0))
    items = items.withColumn("top", whole.rlike(r"^TOP\d+(/hive_arm\d+)?$")).withColumn("arm", arm)
    items = items.join(statements, ["script", "statement", "arm"], "left").withColumn("into", F.when(F.col("defined_in") == "SELECT", F.when(F.col("top"), F.coalesce("written", F.lit("⟐result"))).otherwise(F.col("owner"))).otherwise(F.expr("substring_index(name, '.', size(split(name, '[.]')) - 1)"))).filter("into is not null")
    field = F.regexp_extract("name", r"([^.]+)$", 1)
    items = items.select("script", "id", "context", F.col("defined_in").alias("clause"), "into", field.alias("field"), F.lower("variable_type").alias("kind"), F.col("line_start").alias("line"), F.explode("source_columns").alias("used"))
    refs = resolve(analysis).filter("table is not null AND strategy NOT IN ('pseudo', 'output')").withColumn("used", F.concat(F.when(F.col("qualifier") != "", F.concat("qualifier", F.lit("."))).otherwise(F.lit("")), F.col("column")))
    refs = refs.select("script", "context", "clause", "used", F.col("table").alias("source_table"), F.col("column").alias("source_field")).distinct()
    joined = items.join(refs, ["script", "context", "clause", "used"])
    local = lambda name, by: ctes.select("script", F.col("local").alias(by), F.lit(True).alias(name))
    joined = joined.withColumn("s", F.lower("source_table")).withColumn("t", F.lower("into"))
    joined = joined.join(local("s_local", "s"), ["script", "s"], "left").join(local("t_local", "t"), ["script", "t"], "left")
    t_local = F.coalesce("t_local", F.lit(False)) | (F.col("into") == "⟐result")
    source, target = node_of(F.col("script"), F.col("source_table"), F.col("source_field"), F.coalesce("s_local", F.lit(False))), node_of(F.col("script"), F.col("into"), F.col("field"), t_local)
    return joined.select("script", source.alias("source"), target.alias("target"), "kind", "line").filter("source <> target").distinct()


def field_flow(edges: DataFrame, fields: DataFrame, direction: str = "downstream") -> DataFrame:
    """(seed, node, distance): everything that the fields (node) flow into, or come from."""
    source, target = ("source", "target") if direction == "downstream" else ("target", "source")
    seeds = fields.select(F.lower("node").alias("seed"), F.lower("node").alias("node"))
    return reach(seeds, edges, source, target, ["seed"])


def walk(seeds: DataFrame, dependencies: DataFrame, direction: str = "downstream") -> DataFrame:
    """(script, node, distance) over variables: value edges one way, and edges that pass rows both ways."""
    spark = dependencies.sparkSession
    types = F.broadcast(spark.createDataFrame(EDGE_TYPES, "relationship string, value boolean, both boolean, class string"))
    e = dependencies.join(types, "relationship")
    forward = e.filter("value OR both").select("script", F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    back = e.filter("both").select("script", F.col("target_id").alias("s"), F.col("source_id").alias("t"))
    steps = forward.union(back) if direction == "downstream" else forward.select("script", F.col("t").alias("s"), F.col("s").alias("t")).union(back.select("script", F.col("t").alias("s"), F.col("s").alias("t")))
    return reach(seeds, steps, "s", "t", ["script"])


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes (script, node)."""
    n = nodes.select("script", "node").distinct()
    return edges.join(n.withColumnRenamed("node", "source_id"), ["script", "source_id"], "left_semi").join(n.withColumnRenamed("node", "target_id"), ["script", "target_id"], "left_semi")


def flow_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target or waypoint of each node by its degrees; structure edges and loops do not count."""
    e = edges.filter(~F.col("relationship").isin("ALIAS", "SCHEMA", "SUBSET"))
    d = degrees(nodes, e, "source_id", "target_id")
    return d.select("node", F.when(F.col("n_out") > F.col("n_in"), "source").when(F.col("n_in") > F.col("n_out"), "target").otherwise("waypoint").alias("role"))


def io_paths(analysis: Analysis, dependencies: DataFrame, outputs: DataFrame, most_paths: int = 200) -> DataFrame:
    """One shortest path from each input column (one without sources of its own) to each named output (script, name)."""
    v = analysis.variables
    inputs = v.filter("variable_type = 'column' AND (size(source_columns) = 0 OR (size(source_columns) = 1 AND source_columns[0] = name))").select(F.col("id").alias("node"))
    goals = v.join(outputs.select("script", F.lower("name").alias("n")), (v.script == outputs.script) & (F.lower(v.name) == F.col("n")), "left_semi").filter("is_output OR defined_in = 'SELECT'").select(F.col("id").alias("node"))
    e = dependencies.filter(F.col("relationship").isin("REF", "TRANSFORM", "AGGREGATE", "WINDOW", "COMPUTED"))
    return shortest_paths(inputs, goals, e, "source_id", "target_id", most_paths=most_paths)


def table_io(analysis: Analysis) -> DataFrame:
    """(script, table, direction): what a script reads and writes, by whole table names in lower case."""
    reads = analysis.scopes.filter("kind = 'physical'").select("script", F.lower("table").alias("table"), F.lit("input").alias("direction"))
    own = analysis.statements.filter("kind IN ('UPDATE', 'DELETE', 'MERGE')").select("script", F.lower("target").alias("table")).distinct()
    aliased = analysis.variables.filter("variable_type = 'table' AND defined_in IN ('FROM', 'JOIN')").select("script", F.lower("name").alias("table")).distinct()
    # a target alone in its scope is not read
    reads = reads.join(own.join(aliased, ["script", "table"], "left_anti"), ["script", "table"], "left_anti")
    writes = analysis.statements.filter("target is not null AND kind IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE', 'CTAS', 'SELECT INTO', 'CREATE VIEW', 'CREATE TABLE')").select("script", F.explode(F.split(F.lower("target"), ",")).alias("table"), F.lit("output").alias("direction"))
    return reads.union(writes).distinct()


def script_graph(io: DataFrame) -> DataFrame:
    """(source, target, relation, tables): a script's outputs that another reads; for pairs without any, inputs in common."""
    out, inp = io.filter("direction = 'output'").select(F.col("script").alias("source"), "table"), io.filter("direction = 'input'").select(F.col("script").alias("target"), "table")
    lineage = out.join(inp, "table").filter("source <> target").groupBy("source", "target").agg(F.sort_array(F.collect_set("table")).alias("tables"))
    both = inp.select(F.col("target").alias("source"), "table").join(inp, "table").filter("source < target").groupBy("source", "target").agg(F.sort_array(F.collect_set("table")).alias("tables"))
    linked = lineage.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    return lineage.withColumn("relation", F.lit("data_lineage")).unionByName(both.join(linked, ["source", "target"], "left_anti").withColumn("relation", F.lit("shared_input")))


def table_roles(io: DataFrame) -> DataFrame:
    """source: read and never written; output: written and never read; intermediate: both."""
    d = io.groupBy("table").agg(F.max(F.col("direction") == "input").alias("read"), F.max(F.col("direction") == "output").alias("written"))
    return d.select("table", F.when(F.col("read") & F.col("written"), "intermediate").when(F.col("read"), "source").otherwise("output").alias("role"))


def pipeline_layers(io: DataFrame) -> DataFrame:
    """(node, layer) of scripts and tables along reads and writes."""
    e = io.select(F.when(F.col("direction") == "input", F.col("table")).otherwise(F.col("script")).alias("s"), F.when(F.col("direction") == "input", F.col("script")).otherwise(F.col("table")).alias("t"))
    nodes = e.select(F.col("s").alias("node")).union(e.select("t"))
    return layers(nodes, e, "s", "t")
