"""The view into one script: compound nodes, writes routed through the statement's output, combined edges and ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.lineage import closure as walks
from lodestream.lineage.text import lines
from lodestream.operators.graph import _keep, reach, shortest_paths

LABEL_CHARS = 36


def direct_part(view: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script, id, part): direct is what leads to a target node or comes of one, along the edges; the rest is indirect."""
    e = view.filter("relationship <> 'SCHEMA'")
    seeds = targets.select("script", F.col("id").alias("node"))
    behind, ahead = reach(seeds, e, "target_id", "source_id", ["script"]), reach(seeds, e, "source_id", "target_id", ["script"])
    direct = behind.union(ahead).select("script", F.col("node").alias("id")).distinct().withColumn("known", F.lit(True))
    return nodes.select("script", "id").join(direct, ["script", "id"], "left").select("script", "id", F.when(F.col("known"), "direct").otherwise("indirect").alias("part"))


def compound(found: DataFrame) -> DataFrame:
    """(script, id, node, label, node_type, parent): what each variable is shown as.

    A table has one node whatever its occurrences, a container one; an alias of a line one under its table; fields of one name one under
    their table. Values that nothing owns lie under the script's first table. Outputs show without their mark, labels are cut at 36 characters.
    """
    first = found.filter("table_like AND kind = 'physical'").groupBy("script").agg(F.min_by("key", "ord").alias("first_key"))
    rows = found.join(first, "script", "left").withColumn("owner", F.coalesce("key", "first_key"))
    table = F.concat(F.lit("l2_tbl_"), F.substring(F.md5(F.concat_ws(":", "script", "owner")), 1, 10))
    is_alias = F.col("alias_of").isNotNull()
    shown = F.when(F.col("name") == "⟐ output", F.lit("output")).when(F.col("name").startswith("⟐ "), F.concat(F.lit("output("), F.substring("name", 3, 100), F.lit(")"))).otherwise(F.col("name"))
    plain = F.when(F.col("table_like"), shown).otherwise(F.col("field"))
    label = F.substring(F.when(is_alias, F.concat(F.lower("name"), F.lit("@"), "line")).when(F.col("table_like") & F.col("kind").isin("physical", "cte", "subquery"), F.col("owner")).otherwise(plain), 1, LABEL_CHARS)
    kind = F.when(is_alias, "alias_table").when(F.col("kind") == "cte", "cte_table").when(F.col("kind") == "virtual", "output_table").when(F.col("variable_type").isin("table", "view", "merge_target"), "source_table").otherwise("intermediate_table")
    rows = rows.withColumn("label", label).withColumn("table", table)
    inner = F.concat(F.lit("fld_"), F.substring(F.md5(F.concat_ws(":", "table", F.when(F.col("table_like"), F.lit("alias")).otherwise(F.lit("field")), "label")), 1, 10))
    own = F.col("table_like") & ~is_alias
    return rows.select("script", "id", F.when(own, F.col("table")).otherwise(inner).alias("node"), "label", F.when(F.col("table_like"), kind).otherwise(F.lit("field")).alias("node_type"), F.when(~own, F.col("table")).alias("parent"))


def trunk(found: DataFrame, view: DataFrame, targets: DataFrame) -> DataFrame:
    """The view with its writes routed through the statement's own output: x to output, output to the written table; a direct write of x goes.

    (script, source_id, target_id, relationship, operation, origin): origin is value for a routed edge from one of the target seeds (script, id), in for other ones, out for the
    write itself, null for edges as they were. A write whose statement has no output among the nodes stays.
    """
    writing = (F.col("relationship") == "DML") & (F.col("operation") != "WRITE_READ")
    place = found.select("script", F.col("id").alias("target_id"), "context")
    outputs = found.filter("variable_type = 'virtual_table' AND name = '⟐ output'").select("script", "context", F.col("id").alias("output"))
    legs = view.filter(writing).join(place, ["script", "target_id"]).join(outputs, ["script", "context"], "left")
    routed = _keep(legs.filter("output IS NOT NULL"))
    seed = targets.select("script", F.col("id").alias("source_id")).distinct().withColumn("seed", F.lit(True))
    into = routed.filter("source_id <> output").join(seed, ["script", "source_id"], "left").select("script", "source_id", F.col("output").alias("target_id"), F.lit("TABLE_FLOW").alias("relationship"), "operation", F.when(F.col("seed"), "value").otherwise("in").alias("origin"))
    out = routed.select("script", F.col("output").alias("source_id"), "target_id", F.lit("TABLE_FLOW").alias("relationship"), "operation", F.lit("out").alias("origin")).distinct()
    none = F.lit(None).cast("string").alias("origin")
    base = ["script", "source_id", "target_id", "relationship", "operation"]
    kept = view.filter(~writing).select(*base, none).unionByName(legs.filter("output IS NULL").select(*base, none))
    return kept.unionByName(into).unionByName(out)


def shown_edges(routed: DataFrame, nodes: DataFrame, targets: DataFrame, filtered: bool = True) -> DataFrame:
    """(script, source, target, relationship, labels, operations, origins): edges between shown nodes, one a pair and type.

    A field end is promoted to its table, but not that of a target seed and not in structure; what falls together is combined, loops go. Where nothing is
    filtered, a join stays only if its source is tied by something else.
    """
    seed = targets.select("script", "id").withColumn("seed", F.lit(True))
    at = nodes.join(seed, ["script", "id"], "left")
    end = lambda x: at.select("script", F.col("id").alias(f"{x}_id"), F.col("node").alias(f"{x}_own"), F.coalesce(F.when(F.col("seed") | (F.col("node_type") != "field"), F.col("node")), "parent", "node").alias(f"{x}_up"))
    e = routed.join(end("source"), ["script", "source_id"]).join(end("target"), ["script", "target_id"])
    structure = F.col("relationship") == "SCHEMA"
    side = lambda x: F.when(structure, F.col(f"{x}_own")).otherwise(F.col(f"{x}_up")).alias(x)
    e = e.select("script", side("source"), side("target"), "relationship", "operation", "origin").filter("source <> target")
    if not filtered:
        other = e.filter("relationship <> 'JOIN'").select("script", "source").union(e.filter("relationship <> 'JOIN'").select("script", "target")).distinct()
        e = e.filter("relationship <> 'JOIN'").unionByName(e.filter("relationship = 'JOIN'").join(other, ["script", "source"], "left_semi"))
    gather = lambda c: F.array_sort(F.collect_set(c))
    return e.groupBy("script", "source", "target", "relationship").agg(gather(F.coalesce("origin", "relationship")).alias("labels"), gather("operation").alias("operations"), gather("origin").alias("origins"))


def path_payload(shown: DataFrame, sources: DataFrame, goals: DataFrame) -> DataFrame:
    """(script, source, target, hops, own): for each shown edge the whole way from a flow source (script, node) over it to a goal (script, node): nodes in order, and the place of the edge's own.

    Ways up and down are the shortest, the first in order; without one the edge's own end stands.
    """
    e = shown.filter("relationship <> 'SCHEMA'").select(F.concat_ws("|", "script", "source").alias("s"), F.concat_ws("|", "script", "target").alias("t"), "script", "source", "target").distinct()
    node = lambda df: df.select(F.concat_ws("|", "script", "node").alias("node")).distinct()
    ends = e.select(F.col("s").alias("node")).union(e.select("t")).distinct()
    up = shortest_paths(node(sources), ends, e, "s", "t", most_rounds=1000, most_paths=None).groupBy("goal").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select(F.col("goal").alias("s"), F.col("p.path").alias("up"))
    down = shortest_paths(ends, node(goals), e, "s", "t", most_rounds=1000, most_paths=None).groupBy("start").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select(F.col("start").alias("t"), F.col("p.path").alias("down"))
    both = e.join(up, "s", "left").join(down, "t", "left").withColumn("up", F.coalesce("up", F.array("s"))).withColumn("down", F.coalesce("down", F.array("t")))
    name = lambda x: F.regexp_extract(x, r"([^|]+)$", 1)
    return both.select("script", "source", "target", F.transform(F.concat("up", "down"), name).alias("hops"), (F.size("up") - 1).alias("own"))


def response(nodes: DataFrame, edges: DataFrame, flow_nodes: DataFrame, flow_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole graph with marks of what lies in the flow, and what only the flow has; where a script's flow is empty, all of it unmarked with in_flow null."""
    some = flow_nodes.select("script").distinct().withColumn("any", F.lit(True))
    marked = nodes.select("script", "id").unionByName(flow_nodes.select("script", "id")).distinct().join(flow_nodes.select("script", "id").distinct().withColumn("hit", F.lit(True)), ["script", "id"], "left").join(some, "script", "left")
    key = ["script", "source_id", "target_id", "relationship"]
    both = edges.select(*key).unionByName(flow_edges.select(*key)).distinct().join(flow_edges.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").join(some, "script", "left")
    in_flow = F.when(F.col("any"), F.coalesce("hit", F.lit(False))).alias("in_flow")
    return marked.select("script", "id", in_flow), both.select(*key, in_flow)


def snippets(scripts: DataFrame, anchored: DataFrame, around: int = 2, most: int = 500) -> DataFrame:
    """(script, item, low, high, text): for each item (script, item, line) its lines and ``around`` more on each side; a script's first ``most`` items by line, as the feature states."""
    from pyspark.sql import Window

    ranked = anchored.withColumn("k", F.row_number().over(Window.partitionBy("script").orderBy("line", "item"))).filter(F.col("k") <= most)
    near = lines(scripts).withColumnRenamed("line", "at").join(ranked, "script").filter((F.col("at") >= F.col("line") - around) & (F.col("at") <= F.col("line") + around))
    return near.groupBy("script", "item").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))


def zoom(found: DataFrame, edges: DataFrame, table: str, field: str, direction: str = "downstream") -> tuple[DataFrame, DataFrame]:
    """The view of a field into each script: shown nodes (script, node, label, node_type, parent, part, role) and shown edges."""
    closure, view = walks.field_view(found, edges, table, field, direction)
    seeds = walks.occurrences_of(found, table, field).select("script", "id")
    targets = seeds if direction == "downstream" else walks.flow_targets(found, edges, closure)
    parts = direct_part(view, targets, closure)
    routed = _keep(trunk(found, view, seeds))
    ends = routed.select("script", F.col("source_id").alias("id")).union(routed.select("script", "target_id"))
    inside = found.join(closure.union(ends).distinct(), ["script", "id"], "left_semi")
    nodes = _keep(compound(inside))
    shown = _keep(shown_edges(routed, nodes, seeds))
    written = walks.flow_targets(found, edges, closure).join(nodes, ["script", "id"]).select("script", "node").distinct().withColumn("written", F.lit(True))
    origin = nodes.join(found.filter((F.col("key") == table.lower()) & F.col("table_like") & F.col("alias_of").isNull()), ["script", "id"], "left_semi").select("script", "node").distinct().withColumn("origin", F.lit(True))
    part = nodes.join(parts, ["script", "id"], "left").groupBy("script", "node").agg(F.min("label").alias("label"), F.min("node_type").alias("node_type"), F.min("parent").alias("parent"), F.min(F.coalesce("part", F.lit("indirect"))).alias("part"))
    role = F.when(F.col("written"), "target").when(F.col("origin"), "source").otherwise("waypoint")
    listed = part.join(written, ["script", "node"], "left").join(origin, ["script", "node"], "left").select("script", "node", "label", "node_type", "parent", "part", role.alias("role"))
    return listed, shown
