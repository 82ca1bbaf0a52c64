"""Dependencies between a script's variables, each rule a join over the variables relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.lineage.flow import owner_of
from lodestream.lineage.physical import short_name
from lodestream.lineage.resolve import parent_of
from lodestream.operators.graph import components

EDGE = ["script", "source_id", "target_id", "relationship", "operation"]
TABLE_KINDS = ("table", "view")
MOST_SOURCES = 30


def _edge(df: DataFrame, source: str, target: str, relationship: str, operation: str | None = None) -> DataFrame:
    op = F.lit(operation) if operation is not None else F.col("op")
    kind = F.col("rel") if relationship == "" else F.lit(relationship)
    return df.filter(F.col(source) != F.col(target)).select("script", F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("relationship"), op.alias("operation"))


def anchors(v: DataFrame) -> DataFrame:
    """Where a context's rows go: the output of its query, or its common table expression."""
    out = v.filter("(variable_type = 'virtual_table' AND name = '⟐ output') OR (variable_type = 'cte' AND defined_in = 'CTE')")
    return out.select("script", "context", F.col("id").alias("anchor"), "variable_type")


def targets(v: DataFrame) -> DataFrame:
    """Tables that statements write, with the kind of write."""
    op = F.when(F.col("variable_type") == "merge_target", "MERGE").when(F.col("defined_in").isin("INSERT", "UPDATE", "DELETE"), F.col("defined_in")).when(F.col("defined_in").isin("CTAS", "SELECT INTO", "CREATE VIEW"), "CREATE")
    rows = v.filter("variable_type IN ('table', 'view', 'merge_target')").withColumn("op", op).filter("op is not null")
    return rows.select("script", "context", "statement", "ord", F.col("id").alias("target"), F.col("name").alias("target_name"), "op", F.col("line_start").alias("target_line"))


def table_flow(v: DataFrame) -> DataFrame:
    """Sources into the output of their context, inner outputs into the enclosing one, common table expressions into their readers."""
    a = anchors(v).select("script", "context", "anchor")
    reads = v.filter("variable_type IN ('table', 'view') AND size(source_tables) > 0 AND defined_in IN ('FROM', 'JOIN')")
    out = _edge(reads.join(a, ["script", "context"]), "id", "anchor", "TABLE_FLOW", "FROM")
    ctes = v.filter("variable_type = 'cte' AND size(source_tables) > 0")
    out = out.union(_edge(ctes.join(a, ["script", "context"]), "id", "anchor", "TABLE_FLOW", "REFERENCE"))
    derived = v.filter("variable_type = 'subquery' AND defined_in IN ('FROM', 'JOIN')")
    out = out.union(_edge(derived.join(a, ["script", "context"]), "id", "anchor", "SUBQUERY", "REFERENCE"))
    nested = anchors(v).withColumn("outer", parent_of(F.col("context"))).filter("outer is not null").select("script", "outer", F.col("anchor").alias("inner"))
    up = nested.join(a.withColumnRenamed("context", "outer"), ["script", "outer"])
    out = out.union(_edge(up, "inner", "anchor", "TABLE_FLOW", "SUBSELECT"))
    defined = v.filter("variable_type = 'cte' AND defined_in = 'CTE'").select("script", F.lower("name").alias("n"), F.col("id").alias("cte"))
    readers = ctes.select("script", F.lower("name").alias("n"), "context").join(defined, ["script", "n"]).join(a, ["script", "context"])
    return out.union(_edge(readers, "cte", "anchor", "TABLE_FLOW", "REFERENCE"))


def writes(v: DataFrame) -> DataFrame:
    """Data into written tables: the first columns of the statement, its sources, its output, and later readers of the table."""
    t = targets(v)
    own = v.join(t.select("script", "context", "target", "op"), ["script", "context"]).filter("id <> target")
    columns = own.filter("size(source_columns) > 0").withColumn("k", F.row_number().over(Window.partitionBy("script", "target").orderBy("ord"))).filter(F.col("k") <= MOST_SOURCES)
    out = _edge(columns, "id", "target", "DML")
    bare = own.join(columns.select("script", "target").distinct(), ["script", "target"], "left_anti").filter("variable_type IN ('table', 'view', 'cte', 'virtual_table', 'subquery')")
    first = bare.withColumn("k", F.row_number().over(Window.partitionBy("script", "target").orderBy("ord"))).filter("k = 1")
    out = out.union(_edge(first, "id", "target", "DML"))
    reads = own.filter("variable_type IN ('table', 'view') AND size(source_tables) > 0 AND defined_in IN ('FROM', 'JOIN')")
    out = out.union(_edge(reads, "id", "target", "TABLE_FLOW"))
    # a common table expression that no query of the statement reads under an alias flows into the target itself
    ctes = v.filter("variable_type = 'cte' AND defined_in = 'CTE'").select("script", "statement", F.lower("name").alias("n"), F.col("id").alias("cte"))
    read = v.filter("variable_type = 'cte' AND size(source_tables) > 0").select("script", "context", "statement", F.lower("name").alias("n"))
    direct = read.join(ctes, ["script", "statement", "n"]).join(t.select("script", "context", "target", "op"), ["script", "context"])
    out = out.union(_edge(direct, "cte", "target", "TABLE_FLOW"))
    output = anchors(v).filter("variable_type = 'virtual_table'").groupBy("script", "context").agg(F.count("*").alias("n"), F.first("anchor").alias("anchor")).filter("n = 1")
    out = out.union(_edge(t.join(output, ["script", "context"]), "anchor", "target", "DML"))
    name = F.lower(F.coalesce(F.get("source_tables", F.lit(0)), F.col("name")))
    later = v.filter("variable_type IN ('table', 'view') AND context LIKE 'TOP%'").select("script", name.alias("n"), "id", F.col("statement").alias("s"), "line_start")
    cross = t.select("script", F.lower("target_name").alias("n"), "target", "statement", "target_line").join(later, ["script", "n"]).filter("s <> statement AND line_start >= target_line AND id <> target")
    out = out.union(_edge(cross, "target", "id", "DML", "WRITE_READ"))
    selves = t.select("script", "context", "target", F.lower("target_name").alias("n")).join(v.filter("alias_of is not null").select("script", "context", F.lower(F.get("source_tables", F.lit(0))).alias("n"), "defined_in"), ["script", "context", "n"]).filter("defined_in IN ('FROM', 'JOIN')")
    loops = selves.select("script", F.col("target").alias("source_id"), F.col("target").alias("target_id"), F.lit("TABLE_FLOW").alias("relationship"), F.lit("SELF_JOIN").alias("operation"))
    return out.union(loops)


def set_operations(v: DataFrame) -> DataFrame:
    """Branches of a set operation into it, and it into the output of its context."""
    unions = v.filter("variable_type = 'union_branch'").select("script", "context", F.col("id").alias("u"))
    out = _edge(unions.join(anchors(v).select("script", "context", "anchor"), ["script", "context"]), "u", "anchor", "SET_OP", "SET")
    branches = anchors(v).filter("context LIKE '%/union%'").withColumn("outer", parent_of(F.col("context"))).select("script", "outer", "anchor")
    return out.union(_edge(branches.join(unions.withColumnRenamed("context", "outer"), ["script", "outer"]), "anchor", "u", "SET_OP", "BRANCH"))


def aliases(v: DataFrame) -> DataFrame:
    return _edge(v.filter("alias_of is not null"), "alias_of", "id", "ALIAS", "ALIAS")


def references(v: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns into what is computed of them, from occurrences and sources (see ``physical``). A source is, in this order: the column's own instance in the same
    context; what the query of its common table expression or derived table gives out under that name; the last value that an earlier statement of the script
    writes into that field of its table. Without any of these there is no edge: a like name elsewhere is no source."""
    kind = F.col("variable_type")
    rel = F.when(kind == "aggregate", "AGGREGATE").when(kind == "window", "WINDOW").when(kind == "case", "COMPUTED").when(kind.isin("transform", "cte_column"), "TRANSFORM").when((kind == "expression") & (F.col("defined_in") != "JOIN ON"), "TRANSFORM").otherwise("REF")
    uses = sources.join(v.select("script", "id", "context", "statement", rel.alias("rel")), ["script", "id"]).withColumnRenamed("id", "target")
    values = v.filter("variable_type NOT IN ('table', 'view', 'cte', 'subquery', 'virtual_table', 'merge_target', 'union_branch', 'literal')")
    instance = values.filter("variable_type = 'column'").select("script", "context", F.lower("name").alias("used"), F.col("id").alias("source"), F.lit(0).alias("far"), (-F.col("ord")).alias("place"))
    own = uses.join(instance, ["script", "context", "used"])
    given = values.filter("defined_in = 'SELECT'").select("script", F.lower(owner_of(F.col("context"))).alias("key"), short_name().alias("field"), F.col("id").alias("source"), F.lit(1).alias("far"), F.col("ord").alias("place")).filter("key IS NOT NULL")
    inner = uses.join(given, ["script", "key", "field"])
    written = targets(v).select("script", "context", F.lower("target_name").alias("key"), F.col("statement").alias("earlier"))
    into = values.filter("defined_in IN ('SELECT', 'UPDATE SET', 'MERGE SET')").withColumn("field", short_name()).join(written, ["script", "context"]).select("script", "key", "field", F.col("id").alias("source"), "earlier", F.lit(2).alias("far"), (-F.col("ord")).alias("place"))
    before = uses.join(into, ["script", "key", "field"]).filter("earlier < statement").drop("earlier")
    every = own.unionByName(inner).unionByName(before).filter("source <> target")
    rank = F.row_number().over(Window.partitionBy("script", "target", "used").orderBy("far", "place"))
    return _edge(every.withColumn("k", rank).filter("k = 1").withColumn("op", F.lit("REFERENCE")), "source", "target", "", None)


def schema_edges(v: DataFrame) -> DataFrame:
    """Containers to what they hold: an alias to its columns, a common table expression to its body, an output to its columns."""
    holders = v.filter("variable_type IN ('table', 'view', 'cte', 'subquery', 'virtual_table', 'merge_target') AND name NOT LIKE '⟐%'").select("script", "context", F.lower("name").alias("n"), F.col("id").alias("holder"))
    named = v.filter("variable_type = 'column' AND name LIKE '%.%'").select("script", "context", F.lower(F.expr("substring_index(name, '.', size(split(name, '[.]')) - 1)")).alias("n"), "id")
    out = _edge(named.join(holders, ["script", "context", "n"]), "holder", "id", "SCHEMA", "TABLE_COLUMN")
    cte = v.filter("variable_type = 'cte' AND defined_in = 'CTE'").select("script", F.col("context").alias("body"), F.col("id").alias("cte"))
    held = v.join(cte, "script").filter("context = body OR startswith(context, concat(body, '/')) OR startswith(context, concat(body, ':'))")
    out = out.union(_edge(held, "cte", "id", "SCHEMA", "CTE_BODY"))
    shown = v.filter("defined_in = 'SELECT'").join(anchors(v).select("script", "context", "anchor"), ["script", "context"])
    return out.union(_edge(shown, "anchor", "id", "SCHEMA", "OUTPUT"))


def predicates(v: DataFrame) -> DataFrame:
    """Qualified columns of WHERE, HAVING and QUALIFY, and of ON, into the output they filter or join."""
    a = anchors(v).select("script", "context", "anchor")
    where = v.filter("variable_type = 'column' AND name LIKE '%.%' AND defined_in IN ('WHERE', 'HAVING', 'QUALIFY')").join(a, ["script", "context"])
    on = v.filter("(variable_type = 'column' AND name LIKE '%.%' OR variable_type = 'expression') AND defined_in = 'JOIN ON'").join(a, ["script", "context"])
    # a computed key of one side, and the columns of the other side that it is compared with
    keys = v.filter("variable_type NOT IN ('column', 'literal') AND defined_in = 'JOIN ON' AND size(source_columns) > 0").select("script", "context", "line_start", F.col("id").alias("key"), F.col("source_columns").alias("made_of"))
    columns = v.filter("variable_type = 'column' AND name LIKE '%.%' AND defined_in = 'JOIN ON'").select("script", "context", "line_start", "id", "name")
    side = lambda c: F.lower(F.expr(f"substring_index({c}, '.', 1)"))
    crossed = columns.join(keys, ["script", "context", "line_start"]).filter(~F.array_contains(F.transform("made_of", lambda c: F.lower(F.substring_index(c, ".", 1))), side("name")))
    merge = v.filter("variable_type = 'column' AND defined_in = 'MERGE ON'").join(targets(v).select("script", "context", F.col("target").alias("anchor")), ["script", "context"])
    return _edge(where, "id", "anchor", "FILTER", "CONDITION").union(_edge(on, "id", "anchor", "JOIN", "JOIN_CONDITION")).union(_edge(merge, "id", "anchor", "JOIN", "JOIN_CONDITION")).union(_edge(crossed, "id", "key", "JOIN", "JOIN_KEY"))


def indirect(v: DataFrame) -> DataFrame:
    """A HAVING or ORDER BY name to the computed column of that name; an outer source used inside a nested query to its output."""
    bare = v.filter("variable_type = 'column' AND name NOT LIKE '%.%' AND defined_in IN ('HAVING', 'QUALIFY', 'ORDER BY')").select("script", "context", F.lower("name").alias("n"), F.col("id").alias("target"))
    made = v.filter("defined_in = 'SELECT' AND variable_type IN ('aggregate', 'window', 'case', 'transform', 'expression')").select("script", "context", F.lower("name").alias("n"), "id")
    out = _edge(made.join(bare, ["script", "context", "n"]), "id", "target", "INDIRECT", "NAME_MATCH")
    inner = v.filter("variable_type = 'column' AND name LIKE '%.%' AND defined_in IN ('WHERE', 'SELECT', 'HAVING', 'JOIN ON')").withColumn("outer", parent_of(F.col("context"))).filter("outer is not null").select("script", "context", "outer", F.lower(F.expr("substring_index(name, '.', 1)")).alias("n"))
    own = v.filter("variable_type IN ('table', 'subquery', 'cte')").select("script", "context", F.lower("name").alias("n"))
    outside = inner.join(own, ["script", "context", "n"], "left_anti").distinct()
    sources = v.filter("variable_type IN ('table', 'subquery', 'cte')").select("script", F.col("context").alias("outer"), F.lower("name").alias("n"), "id")
    linked = outside.join(sources, ["script", "outer", "n"]).join(anchors(v).select("script", "context", "anchor"), ["script", "context"])
    out = out.union(_edge(linked, "id", "anchor", "INDIRECT", "CORRELATED"))
    shown = v.filter("defined_in = 'SELECT'").select("script", F.col("context").alias("outer"), F.col("id").alias("given"))
    return out.union(_edge(linked.select("script", "outer", "anchor").distinct().join(shown, ["script", "outer"]), "anchor", "given", "INDIRECT", "CORRELATED_OUT"))


def reads(found: DataFrame) -> DataFrame:
    """Columns to the instance of their table in the same context, the first one: occurrences (see ``physical.occurrences``) with their keys."""
    tables = found.filter("table_like AND defined_in IN ('FROM', 'JOIN', 'UPDATE', 'DELETE', 'MERGE')").select("script", "context", "key", F.col("id").alias("table"), F.col("ord").alias("place"))
    columns = found.filter("variable_type = 'column' AND key IS NOT NULL AND kind IN ('physical', 'cte', 'subquery')").select("script", "context", "key", "id")
    first = columns.join(tables, ["script", "context", "key"]).groupBy("script", "id").agg(F.min_by("table", "place").alias("table"))
    return _edge(first, "id", "table", "REF", "READ")


PHASES = {"table_flow": table_flow, "writes": writes, "set_operations": set_operations, "aliases": aliases, "schema": schema_edges, "predicates": predicates, "indirect": indirect}


def dependencies(v: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """All phases, from variables, their occurrences and their sources (see ``physical``); a pair is linked once a relationship, by the first operation in the order of its name."""
    out = references(v, found, sources).unionByName(reads(found))
    for phase in PHASES.values():
        out = out.unionByName(phase(v))
    return out.groupBy("script", "source_id", "target_id", "relationship").agg(F.min("operation").alias("operation"))


def containment(edges: DataFrame) -> DataFrame:
    """Edges with a flag of those that only tell nesting: a common table expression to what its body holds."""
    return edges.withColumn("containment", (F.col("relationship") == "SCHEMA") & (F.col("operation") == "CTE_BODY"))


def stages(context: F.Column) -> F.Column:
    """The context and those around it, nearest first: without the last part after / or :join:, again and again."""
    parts = F.split(F.regexp_replace(context, "/subq/", "/subq~"), r"(?=/|:join:)")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), ""), "/subq~", "/subq/"))


def _owners(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(script, id, owner): for each wanted node (script, id, context, line) the table-like node of the nearest stage that is not it: at or before its line and as near as can be,
    a plain one before a virtual one, the earliest found."""
    tables = found.filter("table_like AND line >= 1").select("script", F.col("context").alias("stage"), F.col("id").alias("owner"), F.col("line").alias("owner_line"), (F.col("variable_type") == "virtual_table").alias("virtual"), F.col("ord").alias("place"))
    staged = wanted.select("script", "id", "line", F.posexplode(stages(F.col("context"))).alias("distance", "stage"))
    near = staged.join(tables, ["script", "stage"]).filter("owner <> id AND (line < 1 OR owner_line <= line)")
    order = F.struct("distance", F.when(F.col("line") >= 1, -F.col("owner_line")).otherwise(F.col("owner_line")).alias("by_line"), "virtual", "place")
    return near.groupBy("script", "id").agg(F.min_by("owner", order).alias("owner"))


def bridges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """What ties the smaller parts of a script's graph to the rest: each part's first node to its nearest owner of another part, else to the largest part's nearest table.

    A column reads its owner (REF, CROSS_COMP); other nodes are padding alone (SUBSET, BRIDGE).
    """
    ids = found.select("script", "id", "ord", "context", "line", "variable_type", "table_like")
    parts = components(edges.select("source_id", "target_id"), "source_id", "target_id").withColumnsRenamed({"node": "id"})
    placed = ids.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("script", "component").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by("id", "ord").alias("head"))
    ranked = sizes.withColumn("k", F.row_number().over(Window.partitionBy("script").orderBy(F.desc("n"), "first")))
    heads = ranked.filter("k > 1").select("script", F.col("head").alias("id"), F.col("component").alias("own")).join(ids.drop("ord"), ["script", "id"])
    owners = _owners(found, heads).join(placed.select("script", F.col("id").alias("owner"), "component"), ["script", "owner"]).join(heads.select("script", "id", "own"), ["script", "id"]).filter("component <> own").select("script", "id", "owner")
    main = placed.join(ranked.filter("k = 1").select("script", "component"), ["script", "component"]).filter("table_like").select("script", F.col("id").alias("far"), F.col("line").alias("far_line"), F.col("ord").alias("far_ord"))
    lost = heads.join(owners, ["script", "id"], "left_anti").join(main, "script").groupBy("script", "id").agg(F.min_by("far", F.struct(F.abs(F.col("far_line") - F.col("line")), "far_ord")).alias("owner"))
    tied = owners.unionByName(lost).join(ids.select("script", "id", "variable_type"), ["script", "id"])
    column = F.col("variable_type") == "column"
    tied = tied.withColumn("rel", F.when(column, "REF").otherwise("SUBSET")).withColumn("op", F.when(column, "CROSS_COMP").otherwise("BRIDGE"))
    return _edge(tied, "owner", "id", "", None)


def honest_bridges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges for nodes that lack a second real one, typed by what the node is, to its nearest owner; tables of a whole statement with a real edge get none.

    A column of WHERE, HAVING or QUALIFY filters, one of a join condition joins; another value feeds a written owner (DML, the kind of
    write) or reads it (REF, READ); a table flows into a query's container (TABLE_FLOW, REFERENCE), else pads (SUBSET, BRIDGE).
    """
    real = edges.filter("relationship <> 'SUBSET'")
    ends = real.select("script", F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(real.select("script", "target_id", "source_id")).distinct()
    degree = ends.groupBy("script", "id").agg(F.count("*").alias("degree"))
    poor = found.join(degree, ["script", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    plain = F.col("variable_type").isin("table", "view", "merge_target")
    poor = poor.filter((~F.col("table_like") & (F.col("degree") < 2)) | (plain & (F.col("degree") == 0)))
    owner = found.select("script", F.col("id").alias("owner"), F.col("variable_type").alias("owner_type"), F.col("defined_in").alias("owner_in"))
    tied = _owners(found, poor.select("script", "id", "context", "line")).join(poor.select("script", "id", "variable_type", "defined_in", "table_like"), ["script", "id"]).join(owner, ["script", "owner"])
    tied = tied.join(ends.withColumnRenamed("other", "owner"), ["script", "id", "owner"], "left_anti")
    column, word = F.col("variable_type") == "column", F.regexp_extract("owner_in", r"(INSERT|UPDATE|DELETE|MERGE)", 1)
    held = F.col("owner_type").isin("cte", "subquery", "virtual_table", "union_branch")
    rel = F.when(column & F.col("defined_in").isin("WHERE", "HAVING", "QUALIFY"), "FILTER").when(column & (F.col("defined_in") == "JOIN ON"), "JOIN").when(~F.col("table_like"), F.when(word != "", "DML").otherwise("REF")).when(held, "TABLE_FLOW").otherwise("SUBSET")
    op = F.when(F.col("rel") == "FILTER", "CONDITION").when(F.col("rel") == "JOIN", "JOIN_CONDITION").when(F.col("rel") == "DML", word).when(F.col("rel") == "REF", "READ").when(F.col("rel") == "TABLE_FLOW", "REFERENCE").otherwise("BRIDGE")
    return _edge(tied.withColumn("rel", rel).withColumn("op", op), "id", "owner", "", None)
