"""Views of scripts: the physical model, closures of a field, searches over scripts and zooms into one; checked by tests against rows written out there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.lineage import closure, edges, flow, index, levels, physical, zoom
from lodestream.lineage.analysis import Analysis, analyze
from lodestream.lineage.resolve import resolve
from lodestream.plans import scripts as base
from lodestream.plans.registry import corpus_query
from lodestream.sources.scripts import corpus, from_text

#: Scripts of one construct each.
CASES = {
    "apart.sql": "SELECT a.x FROM t a;\nSELECT b.y FROM u b;\nUPDATE w SET z = 1;\n",
    "correlated.sql": "SELECT o.id, (SELECT MAX(i.v) FROM items i WHERE i.oid = o.id) AS top\nFROM heads o;\n",
    "key.sql": "SELECT a.x, b.y\nFROM t a\nJOIN u b ON CONCAT(a.k, '-') = b.k;\n",
    "later.sql": "INSERT INTO mid (v) SELECT s.a AS v FROM src2 s;\nINSERT INTO fin (w) SELECT m.v AS w FROM mid m WHERE m.v > 0;\n",
    "picked.sql": "WITH picked AS (\n  SELECT q.id FROM q WHERE q.id IN (SELECT s.id FROM src s WHERE s.flag = 1)\n)\nINSERT INTO goal (id)\nSELECT p.id FROM picked p;\n",
    "star.sql": "INSERT INTO everything\nSELECT * FROM stg_customers;\n",
}


truth = corpus_query()  # their rows are written out in the tests


def _cases(spark) -> Analysis:
    return base._once(spark, "cases", lambda: analyze(from_text(spark, CASES)))


def _found(spark) -> DataFrame:
    return base._found(spark)


def _edges(spark) -> DataFrame:
    return base._once(spark, "flagged", lambda: edges.containment(base._edges(spark)))


def _case_parts(spark) -> tuple[DataFrame, DataFrame]:
    a = _cases(spark)
    resolved = base._once(spark, "case resolved", lambda: resolve(a))
    found = base._once(spark, "case found", lambda: physical.occurrences(a, resolved))
    return found, base._once(spark, "case edges", lambda: edges.containment(edges.dependencies(a.variables, found, physical.sources(a.variables, resolved))))


def _names(found: DataFrame, script: str | None = None) -> DataFrame:
    rows = found if script is None else found.filter(F.col("script") == script)
    return rows.select("script", "id", F.concat("name", F.lit("@"), "context").alias("name"))


def _named_edges(found: DataFrame, e: DataFrame, script: str | None = None) -> DataFrame:
    n = _names(found, script)
    joined = e.join(n.select("script", F.col("id").alias("source_id"), F.col("name").alias("source")), ["script", "source_id"]).join(n.select("script", F.col("id").alias("target_id"), F.col("name").alias("target")), ["script", "target_id"])
    return joined.select("script", "source", "target", "relationship", "operation").distinct()


def _text(column: str) -> F.Column:
    return F.concat_ws(",", column).alias(column)


# --- physical model and phases --------------------------------------------------------------------


@truth
def pm_entities(spark, sf):
    rows = physical.entities(_found(spark), _edges(spark)).filter("script IN ('c_join.sql', 'd_summary.sql', 'f_merge.sql')")
    return rows.select("script", "key", "kind", _text("roles"), _text("alias_views"), F.size("occurrence_ids").cast("long").alias("n_occurrences"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@truth
def pm_fields(spark, sf):
    rows = physical.fields(_found(spark), _edges(spark)).filter("script = 'c_join.sql'")
    return rows.select("key", "field", F.size("occurrence_ids").cast("long").alias("n_occurrences"), F.col("value_sources").cast("long").alias("value_sources"), _text("uses"))


@truth
def pm_edges(spark, sf):
    rows = physical.physical_edges(_found(spark), _edges(spark)).filter("script = 'c_join.sql' AND source_field IS NOT NULL AND target_field IS NOT NULL")
    return rows.select("source_key", "source_field", "target_key", "target_field", "relationship").distinct()


@truth
def dg_cases(spark, sf):
    """Reads, join keys, outer columns, direct flows of common table expressions, and sources by rule, on scripts of one construct each."""
    found, e = _case_parts(spark)
    rows = _named_edges(found, e)
    return rows.filter("operation IN ('READ', 'JOIN_KEY', 'CORRELATED', 'CORRELATED_OUT', 'WRITE_READ', 'SUBSELECT') OR relationship IN ('REF', 'AGGREGATE') OR script = 'picked.sql' AND relationship = 'TABLE_FLOW'")


@truth
def dg_bridges(spark, sf):
    found, e = _case_parts(spark)
    return _named_edges(found, edges.bridges(found, e))


@truth
def dg_honest_bridges(spark, sf):
    found, e = _case_parts(spark)
    return _named_edges(found, edges.honest_bridges(found, e))


# --- closures of a field ----------------------------------------------------------------------------


def _closure_rows(spark, nodes: DataFrame) -> DataFrame:
    return nodes.join(_names(_found(spark)), ["script", "id"]).select("script", "name").distinct()


@truth
def l01_field_lineage(spark, sf):
    return _closure_rows(spark, closure.lineage(_found(spark), _edges(spark), "sales", "place"))


@truth
def l02_induced(spark, sf):
    nodes = closure.upstream(_found(spark), _edges(spark), "sales", "place")
    return _named_edges(_found(spark), closure.induced(nodes, _edges(spark)))


@truth
def l03_relevant(spark, sf):
    rows = closure.relevant(_found(spark).filter("script IN ('c_join.sql', 'd_summary.sql', 'l_broken.sql')"), _edges(spark), "kept", "ok")
    return rows.groupBy("script", "by").agg(F.count("*").alias("n"))


@truth
def l04_gated_downstream(spark, sf):
    return _closure_rows(spark, closure.downstream(_found(spark), _edges(spark), "stg_orders", "amount"))


@truth
def l04_later_reads(spark, sf):
    found, e = _case_parts(spark)
    return closure.downstream(found, e, "src2", "a").join(_names(found), ["script", "id"]).select("script", "name").distinct()


@truth
def l05_gated_upstream(spark, sf):
    return _closure_rows(spark, closure.upstream(_found(spark), _edges(spark), "sales", "total"))


@truth
def l06_row_flow(spark, sf):
    """A container that only nesting ties to the seeds' side, and one that a value ties as well."""
    node = lambda i, like: (i, "s", like)
    found = spark.createDataFrame([node("seed", False), node("inner", True), node("outer", True), node("tied", True)], "id string, script string, table_like boolean")
    e = [("s", "seed", "inner", "FILTER", False), ("s", "outer", "inner", "SCHEMA", True), ("s", "tied", "inner", "SCHEMA", True), ("s", "inner", "tied", "TABLE_FLOW", False)]
    e = spark.createDataFrame(e, "script string, source_id string, target_id string, relationship string, containment boolean")
    return closure.row_flow(found, e, found.select("script", "id"), found.filter("id = 'seed'").select("script", "id")).select("source_id", "target_id", "relationship", "operation")


@truth
def l07_field_view(spark, sf):
    _, view = closure.field_view(_found(spark), _edges(spark), "stg_orders", "amount")
    return _named_edges(_found(spark), view, "c_join.sql")


@truth
def l09_flow_targets(spark, sf):
    found, e = _case_parts(spark)
    nodes = closure.downstream(found, e, "src2", "a")
    return closure.flow_targets(found, e, nodes).join(_names(found), ["script", "id"]).select("script", "name")


@truth
def l10_flow_source(spark, sf):
    rows = closure.flow_source(_found(spark), "stg_orders").join(_found(spark).select("script", "id", "context", "line"), ["script", "id"])
    return rows.select("script", "context", F.col("line").cast("long").alias("line"))


def _io_paths(spark) -> DataFrame:
    outputs = spark.createDataFrame([("c_join.sql", "total"), ("c_join.sql", "band"), ("d_summary.sql", "worst")], "script string, name string")
    return flow.io_paths(base._analysis(spark), base._edges(spark), outputs)


@truth
def l11_io_paths(spark, sf):
    n = _names(_found(spark)).select("id", "name")
    steps = _io_paths(spark).select("start", "goal", F.posexplode("path").alias("k", "id")).join(n, "id")
    return steps.groupBy("start", "goal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ">").alias("path")).select("path")


@truth
def l12_io_nodes(spark, sf):
    nodes, _ = closure.io_graph(_io_paths(spark))
    return nodes.join(_names(_found(spark)), "id").select("name", "n_paths", "place")


@truth
def l12_io_edges(spark, sf):
    _, e = closure.io_graph(_io_paths(spark))
    n = _names(_found(spark)).select("id", "name")
    return e.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id").select("source", "target", "n_paths")


@truth
def l13_variable_search(spark, sf):
    return closure.variable_search(base._analysis(spark).variables, "TOTAL", "column").select("script", "name", "context")


@truth
def l14_neighbours(spark, sf):
    one = _found(spark).filter("script = 'c_join.sql' AND name = 'total' AND variable_type = 'aggregate'").select("script", "id")
    rows = closure.neighbours(_edges(spark), one)
    return rows.join(_names(_found(spark)).select("script", F.col("id").alias("other"), "name"), ["script", "other"]).select("side", "name", "relationship")


@truth
def l15_flow_cone(spark, sf):
    clicked = _named_ids(spark, "c_join.sql", "t.total@CTE{ranked}", "place@CTE{ranked}")
    return closure.flow_cone(_edges(spark), clicked).join(_names(_found(spark)), ["script", "id"]).select("side", "name").distinct()


def _named_ids(spark, script: str, source: str, target: str) -> DataFrame:
    n = _names(_found(spark), script)
    return n.filter(F.col("name") == source).select("script", F.col("id").alias("source_id")).join(n.filter(F.col("name") == target).select("script", F.col("id").alias("target_id")), "script")


# --- over scripts --------------------------------------------------------------------------------------


@truth
def g04_upstream_scripts(spark, sf):
    nodes, links = levels.directional_flow(_found(spark), _edges(spark), base._io(spark), "sales", "total", "upstream")
    return nodes.select(F.col("node").alias("source"), F.lit("").alias("target"), F.col("kind").alias("role")).union(links)


@truth
def g04_downstream_scripts(spark, sf):
    nodes, links = levels.directional_flow(_found(spark), _edges(spark), base._io(spark), "sales", "total", "downstream")
    return nodes.select(F.col("node").alias("source"), F.lit("").alias("target"), F.col("kind").alias("role")).union(links)


def _pipeline(spark) -> tuple[DataFrame, DataFrame]:
    some = spark.createDataFrame([("c_join.sql",), ("d_summary.sql",), ("e_report.sql",)], "script string")
    pairs = levels.pair_closure(base._fields(spark), "stg_orders", "amount")
    return levels.pipeline(base._io(spark), base._resolved(spark), base._uses(spark), pairs, some)


@truth
def g05_pipeline_nodes(spark, sf):
    return _pipeline(spark)[0].select("node", "kind", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("part", F.lit("")).alias("part"))


@truth
def g05_pipeline_edges(spark, sf):
    return _pipeline(spark)[1].select("source", "target", "role", _text("roles"))


@truth
def g06_layers(spark, sf):
    return flow.pipeline_layers(base._io(spark)).select("node", F.col("layer").cast("long").alias("layer"))


@truth
def g06_smooth_layers(spark, sf):
    io = base._io(spark)
    e = io.select(F.when(F.col("direction") == "input", F.col("table")).otherwise(F.col("script")).alias("s"), F.when(F.col("direction") == "input", F.col("script")).otherwise(F.col("table")).alias("t"))
    return levels.smooth(flow.pipeline_layers(io), e, "s", "t").select("node", F.col("layer").cast("long").alias("layer"))


PAIRS = "WITH RECURSIVE {fields}, w AS (SELECT source, target FROM e UNION SELECT target, source FROM e), r AS (SELECT 'stg_orders.amount' AS node UNION SELECT w.target FROM r JOIN w ON w.source = r.node) SELECT regexp_extract(node, '^(.*)[.][^.]*$', 1) AS tbl, regexp_extract(node, '([^.]+)$', 1) AS field FROM r WHERE NOT contains(node, '#')"


@corpus_query(PAIRS.format(fields=base.TRUE_FIELDS))
def g07_pair_closure(spark, sf):
    return levels.pair_closure(base._fields(spark), "stg_orders", "amount").withColumnRenamed("table", "tbl")


@truth
def g08_search(spark, sf):
    asked = [("stg_orders", "amount", "downstream"), ("stg_orders", "amount", "upstream"), ("stg_customers", "nation", "downstream"), ("stg_orders", "nothing", "upstream"), ("logs", None, "upstream"), ("kept", None, "upstream"), ("nowhere", None, "upstream")]
    out = None
    for table, field, direction in asked:
        row = levels.search(base._uses(spark), _found(spark), _edges(spark), table, field, direction).select(F.lit(f"{table}.{field or ''}").alias("asked"), F.lit(direction).alias("direction"), "mode", _text("scripts"), _text("flow_scripts"))
        out = row if out is None else out.union(row)
    return out


@truth
def g09_lineage_filter(spark, sf):
    nodes, e = levels.lineage_filter(*_pipeline(spark))
    return nodes.select(F.col("node").alias("source"), F.lit("").alias("target"), F.col("kind").alias("role")).union(e.select("source", "target", "role"))


# --- into one script ---------------------------------------------------------------------------------------


def _zoom(spark, part: int) -> DataFrame:
    def make(k):
        return lambda: zoom.zoom(_found(spark), _edges(spark), "stg_orders", "amount")[k]

    return base._once(spark, f"zoom {part}", make(part))


@truth
def g10_zoom_nodes(spark, sf):
    rows = _zoom(spark, 0).filter("script = 'c_join.sql'")
    parents = rows.select("script", F.col("node").alias("parent"), F.col("label").alias("under"))
    return rows.join(parents, ["script", "parent"], "left").select("label", "node_type", F.coalesce("under", F.lit("")).alias("under"), "part", "role")


@truth
def g11_direct_part(spark, sf):
    nodes, view = closure.field_view(_found(spark), _edges(spark), "stg_orders", "amount")
    parts = zoom.direct_part(view, closure.occurrences_of(_found(spark), "stg_orders", "amount").select("script", "id"), nodes)
    return parts.join(_names(_found(spark), "c_join.sql"), ["script", "id"]).select("name", "part")


@truth
def g12_compound(spark, sf):
    rows = zoom.compound(_found(spark)).filter("script = 'd_summary.sql'")
    shown = rows.groupBy("node", "label", "node_type", "parent").agg(F.count("*").alias("n"))
    return shown.join(shown.select(F.col("node").alias("parent"), F.col("label").alias("under")), "parent", "left").select("label", "node_type", F.coalesce("under", F.lit("")).alias("under"), "n").distinct()


@truth
def g13_trunk(spark, sf):
    _, view = closure.field_view(_found(spark), _edges(spark), "stg_orders", "amount")
    routed = zoom.trunk(_found(spark), view, closure.occurrences_of(_found(spark), "stg_orders", "amount").select("script", "id")).filter("origin IS NOT NULL")
    n = _names(_found(spark))
    joined = routed.join(n.select("script", F.col("id").alias("source_id"), F.col("name").alias("source")), ["script", "source_id"]).join(n.select("script", F.col("id").alias("target_id"), F.col("name").alias("target")), ["script", "target_id"])
    return joined.select("script", "source", "target", "operation", "origin")


def _labelled(spark, e: DataFrame) -> DataFrame:
    labels = _zoom(spark, 0).select("script", "node", "label")
    return e.join(labels.select("script", F.col("node").alias("source"), F.col("label").alias("from_")), ["script", "source"]).join(labels.select("script", F.col("node").alias("target"), F.col("label").alias("to_")), ["script", "target"])


@truth
def g14_combined_edges(spark, sf):
    return _labelled(spark, _zoom(spark, 1).filter("script = 'c_join.sql'")).select("from_", "to_", "relationship", _text("labels"), _text("operations"))


@truth
def g15_path_payload(spark, sf):
    nodes = _zoom(spark, 0)
    payload = zoom.path_payload(_zoom(spark, 1).filter("script = 'c_join.sql'"), nodes.filter("role = 'source'").select("script", "node"), nodes.filter("role = 'target'").select("script", "node"))
    steps = payload.select("script", "source", "target", "own", F.posexplode("hops").alias("k", "node")).join(nodes.select("script", "node", "label"), ["script", "node"])
    ways = steps.groupBy("script", "source", "target", "own").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ">").alias("hops"))
    return _labelled(spark, ways).select("from_", "to_", "hops", F.col("own").cast("long").alias("own")).distinct()


@truth
def g17_response(spark, sf):
    nodes, view = closure.field_view(_found(spark), _edges(spark), "stg_orders", "amount")
    marked, e = zoom.response(_found(spark), _edges(spark), nodes, view)
    count = lambda df, what: df.groupBy("script", F.coalesce(F.col("in_flow").cast("string"), F.lit("no flow")).alias("in_flow")).agg(F.count("*").alias("n")).select("script", F.lit(what).alias("what"), "in_flow", "n")
    return count(marked, "nodes").union(count(e, "edges")).filter("script IN ('a_load.sql', 'c_join.sql', 'h_hive.sql')")


# --- indexes -------------------------------------------------------------------------------------------------


@truth
def i01_field_index(spark, sf):
    return index.field_index(base._uses(spark)).filter("field IN ('amount', 'ok', 'place', 'segment')").select("field", _text("tables"), _text("scripts"))


@truth
def i04_filter_payload(spark, sf):
    a = spark.createDataFrame([("steps/C_JOIN.sql", "STG_CUSTOMERS"), ("c_join", "stg_orders"), ("d_summary.sql", "Sales"), ("e_report", "nowhere")], "SCRIPT_NAME string, TABLE_NAME string")
    b = spark.createDataFrame([("stg_customers", ""), ("SALES", "PLACE"), ("elsewhere", "x"), ("", "orphan")], "TABLE_NAME string, COL_NAME string")
    return index.filter_payload(base._uses(spark), a, b).select("n_scripts", "n_tables", "n_fields", "n_dropped", _text("ignored"), "warning")


@truth
def i06_lookups(spark, sf):
    tables = index.tables_of(base._uses(spark), "Cust_ID").select(F.lit("tables of cust_id").alias("asked"), F.col("table").alias("found"))
    return tables.union(index.fields_of(base._uses(spark), "SALES").select(F.lit("fields of sales").alias("asked"), F.col("field").alias("found")))


@truth
def i09_accuracy_score(spark, sf):
    rows = spark.createDataFrame([("all", 1.0, 1.0, 1.0, 1.0), ("half", 0.5, 0.5, 0.5, 0.5), ("words", 1.0, 0.0, 0.0, 0.0), ("span", 0.0, 0.0, 0.0, 1.0)], "name string, k double, e double, s double, p double")
    return rows.select("name", F.round(index.accuracy_score(F.col("k"), F.col("e"), F.col("s"), F.col("p")), 4).alias("score"))


@truth
def i10_partition_metrics(spark, sf):
    """Of each script's clause ranges over its lines."""
    from lodestream.lineage.text import clause_ranges, lines

    rows = index.partition_metrics(clause_ranges(corpus(spark)), lines(corpus(spark)))
    return rows.select("script", "coverage", "overlap", "gap", "redundancy").filter("script IN ('a_load.sql', 'c_join.sql', 'e_report.sql')")


@truth
def p05_star_expansion(spark, sf):
    return index.star_expansion(_cases(spark), base._uses(spark)).select("script", "context", F.col("table").alias("tbl"), "field")


@truth
def r_workspace_schema(spark, sf):
    """One owner by the evidence of all scripts; two owners, which is no owner; and one revoked by what another script tells."""
    texts = {
        "one.sql": "SELECT f1, f2, f3 FROM p, q;",
        "two.sql": "INSERT INTO p (f1, f2) SELECT z.a, z.b FROM z;",
        "three.sql": "INSERT INTO q (f2) SELECT z.a FROM z;\nSELECT q.f3 FROM q;",
    }
    from lodestream.lineage.resolve import workspace

    rows = workspace(analyze(from_text(spark, texts)))
    return rows.select(F.col("column").alias("col"), F.coalesce("table", F.lit("")).alias("tbl"), "strategy", _text("owners"))


# --- sources and sinks ------------------------------------------------------------------------------------------


@truth
def s04_tree(spark, sf):
    from lodestream.sources.scripts import tree

    paths = [("b.sql",), ("A.sql",), ("steps/two.sql",), ("steps/deep/one.sql",), ("Ends/x.sql",)]
    return tree(spark.createDataFrame(paths, "script string")).select("path", "kind", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"))


@truth
def s07_output_columns(spark, sf):
    from lodestream.sources.scripts import output_columns
    from lodestream.sources.writers import shared_dir

    path = f"{shared_dir(spark)}/output-columns-csv"
    lines = ["table_name,data_type,column_name,explanation", "sales,DECIMAL, total ,what a customer paid", "sales,INT", "summary,VARCHAR,segment", '"a,b",INT,c,"d,e"']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    return output_columns(spark, path).select("table_name", "data_type", "column_name", F.coalesce("explanation", F.lit("")).alias("explanation"))


@truth
def s09_written_indexes(spark, sf):
    from lodestream.sources.sinks import INDEXES, read_index, write_indexes
    from lodestream.sources.writers import shared_dir

    path = f"{shared_dir(spark)}/indexes"
    write_indexes(path, base._uses(spark), base._resolved(spark))
    counts = [read_index(spark, path, name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in INDEXES]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@truth
def s11_graph_json(spark, sf):
    """A written graph, read as JSON again: how many nodes and edges of each script, and an edge's ends."""
    from lodestream.sources.sinks import write_graphs
    from lodestream.sources.writers import shared_dir

    path = f"{shared_dir(spark)}/graphs-json"
    write_graphs(path, _found(spark).select("script", "id", F.col("name").alias("label"), F.col("variable_type").alias("node_type")), _edges(spark).drop("containment"))
    data = "array<struct<data:struct<id:string,label:string,source:string,target:string,relationship:string>>>"
    read = spark.read.json(path).select("script", F.from_json("graph", f"nodes {data}, edges {data}").alias("g"))
    size = lambda x: F.size(f"g.{x}").cast("long")
    ends = F.size(F.filter("g.edges", lambda e: ~F.exists("g.nodes", lambda n: n["data"]["id"] == e["data"]["source"])))
    return read.select("script", size("nodes").alias("n_nodes"), size("edges").alias("n_edges"), ends.cast("long").alias("n_lost")).filter("script IN ('a_load.sql', 'c_join.sql', 'l_broken.sql')")


@truth
def s19_template_variables(spark, sf):
    from lodestream.sources.scripts import template_variables

    texts = {"t.sql": "SELECT a FROM t WHERE d = '${day}' AND e > ${low} AND f < ${low};", "u.sql": "SELECT 1"}
    return template_variables(from_text(spark, texts))


@truth
def f03_parse_fallback(spark, sf):
    """The dialect and statement that Spark's parser takes in the end; none of what no rewriting mends."""
    from lodestream.plans.dialects import parsed

    texts = [("SELECT a FROM t", "mysql"), ("SELECT TOP 3 a FROM t WITH (NOLOCK)", "tsql"), ("SELECT [x].[a] FROM [dbo].[t] AS [x]", "tsql"), ("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1", "snowflake"), ('SELECT "a" FROM "b"."t"', "postgres"), ("SELECT FROM WHERE (", "mysql")]
    rows = [(text, *(parsed(spark, text, d) or ("", ""))) for text, d in texts]
    return spark.createDataFrame(rows, "given string, dialect string, taken string")


# --- integrity -----------------------------------------------------------------------------------------------------


@truth
def i08_topology(spark, sf):
    """What the checks find; a check that finds nothing is well."""
    return index.topology(base._analysis(spark).variables, base._edges(spark)).filter("n > 0").select("script", "check", "n")


@truth
def dg_dependencies(spark, sf):
    return base._edges(spark).groupBy("script", "relationship", "operation").agg(F.count("*").alias("n"))


@truth
def l_walk(spark, sf):
    v = _found(spark).filter("script = 'c_join.sql' AND name = 'total' AND variable_type = 'aggregate'").select("script", F.col("id").alias("node"))
    rows = flow.walk(v, base._edges(spark)).withColumnRenamed("node", "id").join(_names(_found(spark)), ["script", "id"])
    return rows.groupBy("name").agg(F.min("distance").cast("long").alias("distance"))


@truth
def l08_flow_roles(spark, sf):
    rows = flow.flow_roles(_found(spark).select(F.col("id").alias("node")), base._edges(spark)).withColumnRenamed("node", "id")
    return rows.join(_names(_found(spark), "c_join.sql"), "id").select("name", "role").distinct()


@truth
def si_schema(spark, sf):
    a = base._analysis(spark)
    e = a.scopes.filter("kind = 'physical' AND alias <> table AND script IN ('a_load.sql', 'c_join.sql', 'k_window.sql')").select(F.col("table").alias("source"), F.concat("script", F.lit("#"), "alias").alias("target"))
    return index.schema_inference(e, a.evidence).filter("table LIKE '%#%'").groupBy(F.col("table").alias("tbl")).agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"))


# --- the parser's relations, on scripts of one construct each -----------------------------------------------------------

MORE = {
    "self.sql": "INSERT INTO staff\nSELECT a.id, b.boss FROM staff a JOIN staff b ON a.boss = b.id;\n",
    "having.sql": "SELECT c.seg, SUM(c.v) AS total FROM cust c GROUP BY c.seg HAVING total > 5 ORDER BY total;\n",
    "system.sql": "SELECT t.table_name, LEVEL FROM information_schema.tables t;\nSELECT orders FROM orders;\n",
    "writes.sql": "UPDATE acc SET bal = bal + 1 WHERE id = 2;\nDELETE FROM acc WHERE bal < 0;\nINSERT INTO log (n) SELECT a.bal FROM acc a;\n",
    "names.sql": "SELECT t.a, b AS c, 12345, 'a text that is longer than thirty characters', coalesce(d, 0), sum(e) OVER (PARTITION BY f) FROM t;\n",
}


def _more(spark) -> tuple[Analysis, DataFrame, DataFrame]:
    a = base._once(spark, "more", lambda: analyze(from_text(spark, MORE)))
    resolved = base._once(spark, "more resolved", lambda: resolve(a))
    found = base._once(spark, "more found", lambda: physical.occurrences(a, resolved))
    return a, found, base._once(spark, "more edges", lambda: edges.dependencies(a.variables, found, physical.sources(a.variables, resolved)))


@truth
def dg_writes(spark, sf):
    """Values, outputs and tables into written tables, loops of self joins, later readers, and names of clauses that mean a computed item."""
    _, found, e = _more(spark)
    return _named_edges(found, e).filter("script IN ('having.sql', 'self.sql', 'writes.sql') AND (relationship IN ('DML', 'INDIRECT') OR operation = 'SELF_JOIN')")


@truth
def p02_names(spark, sf):
    a, _, _ = _more(spark)
    return a.variables.filter("script = 'names.sql' AND defined_in = 'SELECT'").select("name", "variable_type", "is_output")


@truth
def f05_statements(spark, sf):
    return base._analysis(spark).statements.select("script", F.col("statement").cast("long").alias("statement"), "kind", F.coalesce("target", F.lit("")).alias("target"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@truth
def f06_lines(spark, sf):
    """The lines that variables are anchored at."""
    return _found(spark).filter("script IN ('c_join.sql', 'd_summary.sql')").select("script", "name", "context", F.col("line").cast("long").alias("line")).distinct()


@truth
def f01_preprocess(spark, sf):
    from lodestream.lineage.lexer import statements, without_settings

    texts = ["SET a = 1;\nSELECT 1;", "UPDATE t\nSET a = 1;\nset b = 2;\nSELECT 2", "-- a note\nSELECT '--no' AS x; # more\n/* and\nmore */ SELECT 3;"]
    return spark.createDataFrame([(k, without_settings(t).count("\n"), len(statements(without_settings(t)))) for k, t in enumerate(texts)], "text long, n_breaks long, n_statements long")


@truth
def m09_table_definitions(spark, sf):
    return base._analysis(spark).evidence.filter("source = 'DDL'").select("script", F.col("table").alias("tbl"), F.col("column").alias("col"), F.col("line").cast("long").alias("line"))


@truth
def r_rules(spark, sf):
    """System tables, pseudo columns, and a field named as its table, which belongs to none."""
    a, _, _ = _more(spark)
    rows = base._once(spark, "more resolved", lambda: resolve(a)).filter("script = 'system.sql'")
    return rows.select("qualifier", F.col("column").alias("col"), F.coalesce("table", F.lit("")).alias("tbl"), F.coalesce("strategy", F.lit("")).alias("strategy"))


@truth
def l16_uses(spark, sf):
    """The ways in which each script uses a field, by the edges out of its occurrences, and whether it writes it."""
    rows = physical.fields(_found(spark), _edges(spark)).filter("key = 'stg_orders' AND field IN ('amount', 'status')")
    return rows.select("script", "field", _text("uses"))


@truth
def s08_analysis_cache(spark, sf):
    """How many scripts are parsed: all at first, none again, one after it changed; and what the cache gives then."""
    import uuid

    from lodestream.sources.cache import cached_analysis
    from lodestream.sources.writers import shared_dir

    path = f"{shared_dir(spark)}/analysis-{uuid.uuid4().hex}"
    texts = {"a.sql": "SELECT a FROM t", "b.sql": "SELECT b FROM u"}
    rows = []
    for k, change in enumerate(({}, {}, {"b.sql": "SELECT b, c FROM u"})):
        texts |= change
        found, n = cached_analysis(spark, from_text(spark, texts), path)
        rows.append((k, n, found.variables.filter("variable_type = 'column'").count()))
    return spark.createDataFrame(rows, "run long, n_parsed long, n_columns long")
