"""Closures of one field over each script's graph: what it flows into, where it comes from, what bears on it; and what a view of them shows.

All scripts are walked at once: the state is a table of visited nodes (script, id), and each round is a union of joins less what
is known. Rounds end when nothing is new; a loop that does not end in ``most_rounds`` is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.lineage.physical import short_name
from lodestream.operators.graph import _keep, components, reach, shortest_paths

VALUE = ("REF", "TRANSFORM", "AGGREGATE", "WINDOW", "COMPUTED")
KEY = ["script", "id"]


def grow(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 100) -> DataFrame:
    """(script, id): the seeds and all that ``step`` of the visited adds."""
    visited = _keep(seeds.select(*KEY).distinct())
    for _ in range(most_rounds):
        new = _keep(step(visited).select(*KEY).distinct().join(visited, KEY, "left_anti"))
        if new.isEmpty():
            return visited
        visited = _keep(visited.unionByName(new))
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def _steps(edges: DataFrame, where, both: bool = False) -> DataFrame:
    """(script, id, next) of the edges that meet a condition; both ways if asked."""
    e = edges.filter(where).select("script", F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    return e.union(e.select("script", F.col("next").alias("id"), F.col("id").alias("next"))) if both else e


def _follow(visited: DataFrame, steps: DataFrame) -> DataFrame:
    return visited.join(steps, KEY).select("script", F.col("next").alias("id"))


def is_value() -> F.Column:
    return F.col("relationship").isin(*VALUE) & (F.col("operation") != "READ")


def occurrences_of(found: DataFrame, table: str, field: str) -> DataFrame:
    """Occurrences of the field of a whole table name, without case."""
    return found.filter((F.col("key") == table.lower()) & (F.col("field") == field.lower()) & ~F.col("table_like"))


def seed_zone(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, id): all that value edges tie to the seeds, either way."""
    zone = reach(seeds.select("script", F.col("id").alias("node")), _steps(edges, is_value(), True), "id", "next", ["script"])
    return zone.select("script", F.col("node").alias("id"))


def downstream(found: DataFrame, edges: DataFrame, table: str, field: str) -> DataFrame:
    """(script, id): the closure of what a table's field flows into and bears on, by gated steps.

    Values go both ways; a read goes forward, and back where the read variable is that field. An alias is passed only to names of the
    searched table. A condition is passed where the zone of the seeds holds one of its ends. Writes go forward from values
    and from the output of a statement whose value is visited, back only to values of that field, and on to later readers
    of the written fields alone. Rows flow from tables of the chain (the searched one and those written) and from outputs whose query holds a visited value of the field.
    With a value come its holder, an alias's table of the chain, and the container of its body.
    """
    t, f = table.lower(), field.lower()
    seeds = _keep(occurrences_of(found, t, f).select(*KEY))
    zone = _keep(seed_zone(seeds, edges))
    rel, op = F.col("relationship"), F.col("operation")
    at = lambda name: found.select("script", F.col("id").alias(name), F.col("key").alias(f"{name}_key"), F.col("field").alias(f"{name}_field"), F.col("table_like").alias(f"{name}_table"), F.col("kind").alias(f"{name}_kind"), F.col("variable_type").alias(f"{name}_type"), F.col("context").alias(f"{name}_context"))
    e = _keep(edges.filter("NOT containment").join(at("source_id"), ["script", "source_id"]).join(at("target_id"), ["script", "target_id"]))
    read = (rel == "REF") & (op == "READ")
    free = _steps(e, is_value(), True).union(_steps(e, read)).union(_steps(e, read & (F.col("source_id_field") == f)).select("script", F.col("next").alias("id"), F.col("id").alias("next")))
    alias = _steps(e, (rel == "ALIAS") & (F.col("target_id_key") == t), True)
    conditions = e.filter(rel.isin("FILTER", "JOIN"))
    touched = zone.withColumnRenamed("id", "z")
    near = conditions.join(touched, (conditions["script"] == touched["script"]) & ((F.col("source_id") == F.col("z")) | (F.col("target_id") == F.col("z"))), "left_semi")
    condition = _steps(near, F.lit(True), True)
    writing = (rel == "DML") & (op != "WRITE_READ")
    value_write = _steps(e, writing & ~F.col("source_id_table"))
    output_write = e.filter(writing & (F.col("source_id_kind") == "virtual")).select("script", F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    back_write = _steps(e, writing & ~F.col("source_id_table") & (F.col("source_id_field") == f)).select("script", F.col("next").alias("id"), F.col("id").alias("next"))
    later = e.filter((rel == "DML") & (op == "WRITE_READ")).select("script", F.col("source_id").alias("id"), F.col("target_id").alias("next"), F.col("source_id_key").alias("key"), F.col("target_id_context").alias("context"))
    rows = e.filter((rel == "TABLE_FLOW") & F.col("source_id_table")).select("script", F.col("source_id").alias("id"), F.col("target_id").alias("next"), F.col("source_id_key").alias("key"), F.col("source_id_kind").alias("kind"), F.col("source_id_context").alias("context"))
    values = found.filter("NOT table_like").select("script", "id", "key", "field", "context")
    holders = edges.filter("relationship = 'SCHEMA' AND operation = 'TABLE_COLUMN'").select("script", F.col("target_id").alias("id"), F.col("source_id").alias("next"))
    originals = found.filter("alias_of IS NOT NULL").select("script", "id", F.col("alias_of").alias("next"), "key")
    bodies = found.filter("variable_type = 'cte' AND defined_in = 'CTE'").select("script", F.col("id").alias("next"), "context")
    names = found.select("script", "id", "key", "kind", "variable_type")
    field_names = found.filter("NOT table_like").select("script", "id", short_name().alias("given"))

    def step(visited: DataFrame) -> DataFrame:
        seen_values = visited.join(values, KEY)
        written = visited.join(value_write, KEY).select("script", F.col("id").alias("value"), F.col("next").alias("id")).join(visited, KEY)
        written_fields = written.join(field_names.withColumnRenamed("id", "value"), ["script", "value"]).select("script", "id", F.col("given").alias("field")).distinct()
        chain = visited.join(names.filter("kind = 'physical' AND variable_type IN ('table', 'view', 'merge_target')"), KEY).join(value_write.select("script", F.col("next").alias("id")).distinct(), KEY, "left_semi").select("script", "key").distinct()
        chain = chain.union(visited.select("script", F.lit(t).alias("key")).distinct()).distinct()
        outputs = visited.join(output_write, KEY).join(written.select("script", F.col("id").alias("next")).distinct(), ["script", "next"], "left_semi")
        readers = visited.join(later, KEY).join(written_fields, KEY).join(values.withColumnsRenamed({"id": "value"}), ["script", "key", "context", "field"])
        flowing = visited.join(rows, KEY)
        by_chain = flowing.join(chain, ["script", "key"], "left_semi")
        own = seen_values.filter(F.col("field") == f).select("script", F.col("context").alias("inner")).distinct()
        by_place = flowing.filter("kind = 'virtual'").join(own, "script").filter(F.expr("inner = context OR startswith(inner, concat(context, '/')) OR startswith(inner, concat(context, ':'))"))
        held = seen_values.join(holders, KEY).join(names.select("script", F.col("id").alias("next"), F.col("key").alias("k"), "kind"), ["script", "next"]).join(chain.withColumnRenamed("key", "k").withColumn("known", F.lit(True)), ["script", "k"], "left").filter("known OR kind <> 'physical'")
        tables = visited.join(originals, KEY).join(chain, ["script", "key"], "left_semi")
        inside = seen_values.join(bodies, ["script", "context"])
        out = _follow(visited, free.union(alias).union(condition).union(value_write).union(back_write))
        for more in (outputs, readers, by_chain, by_place, held, tables, inside):
            out = out.union(more.select("script", F.col("next").alias("id")))
        return out.union(readers.select("script", F.col("value").alias("id")))

    return grow(seeds, step)


def upstream(found: DataFrame, edges: DataFrame, table: str, field: str) -> DataFrame:
    """(script, id): where a field's value comes from: from the statements that write it backwards, over what produces values alone.

    Seeds are written tables with a value of that name; then value edges backwards, aliases to their tables, the output of the
    writing statement, and of tables those that the chain knows. Conditions, reads and structure are never passed; literals end the chain.
    """
    t, f = table.lower(), field.lower()
    given = short_name()
    targets = found.filter((F.col("key") == t) & F.col("table_like")).select("script", F.col("id").alias("target_id"))
    writing = edges.filter("relationship = 'DML' AND operation <> 'WRITE_READ'").join(targets, ["script", "target_id"])
    values = found.filter("NOT table_like").withColumn("given", given).filter(F.col("given") == f).select("script", F.col("id").alias("source_id"), "context")
    legs = _keep(writing.join(values, ["script", "source_id"]).select("script", "source_id", "target_id", "context").distinct())
    outputs = writing.join(found.filter("variable_type = 'virtual_table'").select("script", F.col("id").alias("source_id")), ["script", "source_id"], "left_semi").join(legs.select("script", "target_id").distinct(), ["script", "target_id"], "left_semi")
    seeds = legs.select("script", F.col("source_id").alias("id")).union(legs.select("script", "target_id")).union(outputs.select("script", "source_id"))
    back = _steps(edges, is_value()).select("script", F.col("next").alias("id"), F.col("id").alias("next"))
    alias = _steps(edges, F.col("relationship") == "ALIAS").select("script", F.col("next").alias("id"), F.col("id").alias("next"))
    return grow(seeds, lambda visited: _follow(visited, back.union(alias)))


def lineage(found: DataFrame, edges: DataFrame, table: str, field: str) -> DataFrame:
    """(script, id): the wider lineage of a field: production and flow both ways; containers of what is found; columns, writers and conditions only where a value ties them to it.

    A column comes with its table, a table's column only if a value edge ties it to the rest; so do the writers of a table, filters and join keys (a
    join's computed key always). Padding is never walked.
    """
    rel, op = F.col("relationship"), F.col("operation")
    read = (rel == "REF") & (op == "READ")
    seeds = _keep(occurrences_of(found, table, field).select(*KEY))
    both = _steps(edges, (rel.isin(*VALUE) & ~read) | rel.isin("TABLE_FLOW", "ALIAS", "SET_OP", "SUBQUERY", "INDIRECT", "CORRELATED"), True).union(_steps(edges, read | (rel == "DML")))
    computed = found.filter("NOT table_like AND variable_type <> 'column'").select("script", F.col("id").alias("target_id"))
    both = both.union(_steps(edges.filter(rel == "JOIN").join(computed, ["script", "target_id"], "left_semi"), F.lit(True)))
    up = _steps(edges, rel == "SCHEMA").select("script", F.col("next").alias("id"), F.col("id").alias("next"))
    gated = _steps(edges, rel == "SCHEMA").union(_steps(edges, rel == "DML").select("script", F.col("next").alias("id"), F.col("id").alias("next"))).union(_steps(edges, rel.isin("FILTER", "JOIN"), True))
    made = _steps(edges, rel.isin(*VALUE) & ~read, True).select("script", F.col("id").alias("next"), F.col("next").alias("tied"))

    def step(visited: DataFrame) -> DataFrame:
        tied = made.join(visited.withColumnRenamed("id", "tied"), ["script", "tied"], "left_semi").select("script", "next").distinct()
        return _follow(visited, both.union(up)).union(_follow(visited, gated.join(tied, ["script", "next"], "left_semi")))

    return grow(seeds, step)


def relevant(found: DataFrame, edges: DataFrame, table: str, field: str) -> DataFrame:
    """(script, id, by): per script the lineage; without one the names that hold the field's; without these all."""
    exact = _keep(lineage(found, edges, table, field).withColumn("by", F.lit("lineage")))
    rest = found.join(exact.select("script").distinct(), "script", "left_anti")
    named = _keep(rest.filter(F.lower("name").contains(field.lower())).select(*KEY, F.lit("name").alias("by")))
    return exact.unionByName(named).unionByName(rest.join(named.select("script").distinct(), "script", "left_anti").select(*KEY, F.lit("all").alias("by")))


def induced(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in the closure."""
    return edges.join(closure.withColumnRenamed("id", "source_id"), ["script", "source_id"], "left_semi").join(closure.withColumnRenamed("id", "target_id"), ["script", "target_id"], "left_semi")


def row_flow(found: DataFrame, edges: DataFrame, closure: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges ROW_FLOW from what a container holds, on the seeds' side, to the container, where nothing else ties it to that side."""
    inner = induced(closure, edges)
    flow = inner.filter("NOT containment")
    parts = components(flow, "source_id", "target_id").withColumnRenamed("node", "id")
    placed = _keep(closure.join(parts, "id", "left").select(*KEY, F.coalesce("component", "id").alias("part")))
    side = placed.join(seeds.select(*KEY), KEY, "left_semi").select("script", "part").distinct()
    here = placed.join(side, ["script", "part"], "left_semi").select("script", F.col("id").alias("target_id"))
    there = placed.join(side, ["script", "part"], "left_anti").select("script", F.col("id").alias("source_id"))
    crossing = inner.filter("containment").join(here, ["script", "target_id"], "left_semi").join(there, ["script", "source_id"], "left_semi")
    nested = crossing.join(found.filter("table_like").select("script", F.col("id").alias("target_id")), ["script", "target_id"], "left_semi")
    return nested.select("script", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("ROW_FLOW").alias("relationship"), F.lit("ROW_SELECTION").alias("operation"), F.lit(False).alias("containment"))


def field_view(found: DataFrame, edges: DataFrame, table: str, field: str, direction: str = "downstream") -> tuple[DataFrame, DataFrame]:
    """The nodes (script, id) of the field's closure, and its edges: none of nesting, no copies out of a query's output, and row flows."""
    closure = _keep((downstream if direction == "downstream" else upstream)(found, edges, table, field))
    outputs = found.filter("variable_type = 'virtual_table'").select("script", F.col("id").alias("source_id"))
    spurious = induced(closure, edges).filter("relationship = 'REF'").join(outputs, ["script", "source_id"], "left_semi").select("script", "source_id", "target_id", "relationship")
    shown = induced(closure, edges).filter("NOT containment").join(spurious, ["script", "source_id", "target_id", "relationship"], "left_anti").select("script", "source_id", "target_id", "relationship", "operation", "containment")
    if direction == "downstream":
        shown = shown.unionByName(row_flow(found, edges, closure, occurrences_of(found, table, field)))
    return closure, _keep(shown)


def flow_targets(found: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(script, id): written tables whose write from a statement's output lies in the closure with both ends."""
    outputs = found.filter("kind = 'virtual'").select("script", F.col("id").alias("source_id"))
    legs = induced(closure, edges).filter("relationship = 'DML' AND operation <> 'WRITE_READ'").join(outputs, ["script", "source_id"], "left_semi")
    return legs.select("script", F.col("target_id").alias("id")).distinct()


def flow_source(found: DataFrame, table: str) -> DataFrame:
    """(script, id): each script's first table or view of exactly that name."""
    return found.filter(F.col("variable_type").isin("table", "view") & (F.col("name") == table)).groupBy("script").agg(F.min_by("id", "ord").alias("id"))


def variable_search(variables: DataFrame, text: str = "", variable_type: str | None = None) -> DataFrame:
    """Variables whose name holds the text, without case, of one type if it is given."""
    found = variables.filter(F.lower("name").contains(text.lower()))
    return found if variable_type is None else found.filter(F.col("variable_type") == variable_type)


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script, id, side, other, relationship): edges into each node (upstream) and out of it (downstream)."""
    into = edges.join(nodes.withColumnRenamed("id", "target_id"), ["script", "target_id"], "left_semi").select("script", F.col("target_id").alias("id"), F.lit("upstream").alias("side"), F.col("source_id").alias("other"), "relationship")
    out = edges.join(nodes.withColumnRenamed("id", "source_id"), ["script", "source_id"], "left_semi").select("script", F.col("source_id").alias("id"), F.lit("downstream").alias("side"), F.col("target_id").alias("other"), "relationship")
    return into.unionByName(out)


def flow_cone(edges: DataFrame, clicked: DataFrame) -> DataFrame:
    """(script, id, side): from a clicked edge (script, source_id, target_id), all behind its source and all ahead of its target; structure does not count."""
    e = edges.filter(~F.col("relationship").isin("SCHEMA", "ALIAS", "SUBSET"))
    behind = reach(clicked.select("script", F.col("source_id").alias("node")), e, "target_id", "source_id", ["script"])
    ahead = reach(clicked.select("script", F.col("target_id").alias("node")), e, "source_id", "target_id", ["script"])
    side = lambda df, name: df.select("script", F.col("node").alias("id"), F.lit(name).alias("side"))
    return side(behind, "behind").union(side(ahead, "ahead"))


def io_graph(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, n_paths, place) and edges (source_id, target_id, n_paths) of paths (start, goal, path); place: input, output or between."""
    steps = paths.select("start", "goal", F.posexplode("path").alias("k", "id"), "path")
    place = F.when(F.col("id") == F.col("start"), "input").when(F.col("id") == F.col("goal"), "output").otherwise("between")
    nodes = steps.withColumn("place", place).groupBy("id").agg(F.countDistinct("start", "goal").alias("n_paths"), F.min(F.when(F.col("place") == "between", "z").otherwise(F.col("place"))).alias("p"))
    nodes = nodes.select("id", "n_paths", F.when(F.col("p") == "z", "between").otherwise(F.col("p")).alias("place"))
    edges = steps.filter(F.col("k") < F.size("path") - 1).select("start", "goal", F.col("id").alias("source_id"), F.col("path")[F.col("k") + 1].alias("target_id"))
    return nodes, edges.groupBy("source_id", "target_id").agg(F.countDistinct("start", "goal").alias("n_paths"))


def paths_between(edges: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(start, goal, path): one shortest way from each start (node) to each goal (node), all of them."""
    return shortest_paths(starts, goals, edges, "source_id", "target_id", most_rounds=1000, most_paths=None)
