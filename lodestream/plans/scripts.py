"""Analysis of the script corpus, checked against truth written by hand or against SQL over the parsed relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.lineage import edges as phases
from lodestream.lineage import flow, index, physical
from lodestream.lineage.analysis import Analysis, analyze
from lodestream.lineage.parser import expression_kind, parse_script
from lodestream.lineage.lexer import tokenize
from lodestream.lineage.resolve import coverage, resolve
from lodestream.plans.dialects import MARKERS, dialect_of
from lodestream.plans.registry import corpus_query, query
from lodestream.sources.scripts import CORPUS, corpus
from lodestream.sources.writers import scratch_table

_made: dict[tuple[str, str], DataFrame | Analysis] = {}


def _once(spark: SparkSession, name: str, make) -> DataFrame:
    """Relations that many queries read, written once an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        found = make()
        _made[key] = scratch_table(spark, found)[0] if isinstance(found, DataFrame) else found
    return _made[key]


def _analysis(spark: SparkSession) -> Analysis:
    return _once(spark, "analysis", lambda: analyze(corpus(spark)))


def _resolved(spark: SparkSession) -> DataFrame:
    return _once(spark, "resolved", lambda: resolve(_analysis(spark)))


def _fields(spark: SparkSession) -> DataFrame:
    return _once(spark, "fields", lambda: flow.field_edges(_analysis(spark)))


def _found(spark: SparkSession) -> DataFrame:
    return _once(spark, "found", lambda: physical.occurrences(_analysis(spark), _resolved(spark)))


def _edges(spark: SparkSession) -> DataFrame:
    return _once(spark, "edges", lambda: phases.dependencies(_analysis(spark).variables, _found(spark), physical.sources(_analysis(spark).variables, _resolved(spark))))


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, list):
        return "CAST([" + ", ".join(map(_literal, x)) + "] AS VARCHAR[])"
    return "'" + str(x).replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    """A WITH term of constant rows."""
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _variables_sql() -> str:
    rows = [(s, v.id, v.name, v.variable_type, v.source_columns, v.source_tables, v.alias_of, v.defined_in, v.context, v.statement, v.ord) for s, t in sorted(CORPUS.items()) for v in parse_script(s, t).variables]
    return _values("v", "script, id, name, variable_type, source_columns, source_tables, alias_of, defined_in, context, statement, ord", rows)


ANCHORS = "a AS (SELECT script, context, id AS anchor, variable_type FROM v WHERE (variable_type = 'virtual_table' AND name = '⟐ output') OR (variable_type = 'cte' AND defined_in = 'CTE'))"
OUTER = r"regexp_replace({c}, '(/subq/[^/:]+|/[^/:]+|:join:[^/:]+)$', '')"

SAMPLES = {
    "hive": "INSERT OVERWRITE TABLE t PARTITION (d='1') SELECT NVL(a, 0) FROM s LATERAL VIEW EXPLODE(x) e AS y",
    "oracle": "SELECT DECODE(a, 1, 'x'), NVL(b, 0) FROM dual CONNECT BY LEVEL <= 3",
    "postgres": "SELECT a::int FROM t WHERE b ILIKE '%x' RETURNING a",
    "bigquery": "SELECT STRUCT<x INT64>(1) FROM `p.d.t`",
    "tsql": "SELECT TOP 5 a FROM t WITH (NOLOCK)",
    "snowflake": "SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1",
    "mysql": "SELECT a FROM t LIMIT 5",
    "plain": "SELECT a FROM t",
    "brackets": "SELECT [x].[a] FROM [dbo].[t] AS [x]",
}


def _dialect_sql() -> str:
    names = list(dict.fromkeys(name for name, _, _ in MARKERS))
    points = {n: " + ".join(f"CASE WHEN regexp_matches(x, {_literal(p)}){' AND NOT contains(x, ' + chr(39) + '::=' + chr(39) + ')' if p == '::' else ''} THEN {w}.0 ELSE 0.0 END" for name, w, p in MARKERS if name == n) for n in names}
    cols = ", ".join(f"{points[n]} AS {n}" for n in names)
    best = f"greatest(hive + CASE WHEN hive > 0 THEN oracle * 0.5 ELSE 0 END, CASE WHEN hive > 0 THEN 0 ELSE oracle END, {', '.join(n for n in names if n not in ('hive', 'oracle'))})"
    cases = " ".join(f"WHEN {n if n not in ('hive', 'oracle') else ('hive + CASE WHEN hive > 0 THEN oracle * 0.5 ELSE 0 END' if n == 'hive' else 'CASE WHEN hive > 0 THEN 0 ELSE oracle END')} = best THEN '{n}'" for n in names)
    return f"WITH {_values('s', 'sample, x', SAMPLES.items())}, p AS (SELECT sample, {cols} FROM s), b AS (SELECT *, {best} AS best FROM p) SELECT sample, CASE WHEN best = 0 THEN 'mysql' {cases} END AS dialect FROM b"


@corpus_query(_dialect_sql())
def f02_dialect(spark, sf):
    return spark.createDataFrame(list(SAMPLES.items()), "sample string, x string").select("sample", dialect_of(F.col("x")).alias("dialect"))


KINDS = (("a", "column"), ("t.a", "column"), ("1", "literal"), ("'x'", "literal"), ("NULL", "literal"), ("-2", "literal"), ("sum(a)", "aggregate"), ("round(sum(a), 2)", "transform"), ("sum(a) / sum(b)", "expression"), ("count(*) FILTER (WHERE a > 1)", "aggregate"),
         ("rank() OVER (ORDER BY a)", "window"), ("a - lag(a) OVER (ORDER BY b)", "window"), ("CASE WHEN a THEN 1 END", "case"), ("CASE WHEN a THEN 1 END + 1", "expression"), ("(SELECT max(a) FROM t)", "subquery"), ("coalesce(a, 0)", "transform"), ("my_function(a)", "transform"),
         ("cast(a AS int)", "transform"), ("a::int", "transform"), ("a + b", "expression"), ("a || 'x'", "expression"), ("(a)", "column"), ("row_number()", "window"))


@corpus_query(f"WITH {_values('k', 'expression, kind', KINDS)} SELECT * FROM k")
def v_expression_kinds(spark, sf):
    return spark.createDataFrame([(e, expression_kind(tokenize(e))) for e, _ in KINDS], "expression string, kind string")


CLASSES = [(name, "schema" if name.endswith(".ddl") else "script") for name in sorted(CORPUS)]


@corpus_query(f"WITH {_values('c', 'script, file_class', CLASSES)} SELECT * FROM c")
def s05_file_class(spark, sf):
    return _analysis(spark).files


ERRORS = [("l_broken.sql", 0), ("l_broken.sql", 2)]


@corpus_query(f"WITH {_values('e', 'script, statement', ERRORS)} SELECT * FROM e")
def f04_errors(spark, sf):
    return _analysis(spark).errors.select("script", "statement")


def _phase(name: str, sql: str):
    def add(function):
        function.__name__ = f"dg_{name}"
        return corpus_query(f"WITH {_variables_sql()}, {ANCHORS} {sql}")(function)

    return add


COLUMNS = ("script", "source_id", "target_id", "relationship", "operation")


@_phase("aliases", "SELECT DISTINCT script, alias_of AS source_id, id AS target_id, 'ALIAS' AS relationship, 'ALIAS' AS operation FROM v WHERE alias_of IS NOT NULL")
def dg_aliases(spark, sf):
    return phases.aliases(_analysis(spark).variables).select(*COLUMNS).distinct()


@_phase(
    "table_flow",
    f""", n AS (SELECT script, {OUTER.format(c='context')} AS outer_context, context, anchor FROM a)
SELECT DISTINCT * FROM (
SELECT v.script, v.id AS source_id, a.anchor AS target_id, CASE WHEN v.variable_type = 'subquery' THEN 'SUBQUERY' ELSE 'TABLE_FLOW' END AS relationship, CASE WHEN v.variable_type IN ('table', 'view') THEN 'FROM' ELSE 'REFERENCE' END AS operation
FROM v JOIN a ON a.script = v.script AND a.context = v.context
WHERE v.id <> a.anchor AND v.defined_in IN ('FROM', 'JOIN') AND (v.variable_type = 'subquery' OR v.variable_type IN ('table', 'view', 'cte') AND len(v.source_tables) > 0)
UNION ALL SELECT n.script, n.anchor, a.anchor, 'TABLE_FLOW', 'SUBSELECT' FROM n JOIN a ON a.script = n.script AND a.context = n.outer_context WHERE n.outer_context <> n.context
UNION ALL SELECT d.script, d.id, a.anchor, 'TABLE_FLOW', 'REFERENCE' FROM v d JOIN v r ON r.script = d.script AND lower(r.name) = lower(d.name) AND r.variable_type = 'cte' AND len(r.source_tables) > 0 JOIN a ON a.script = r.script AND a.context = r.context
WHERE d.variable_type = 'cte' AND d.defined_in = 'CTE' AND d.id <> a.anchor)""",
)
def dg_table_flow(spark, sf):
    return phases.table_flow(_analysis(spark).variables).select(*COLUMNS).distinct()


@_phase(
    "predicates",
    """SELECT DISTINCT * FROM (SELECT v.script, v.id AS source_id, a.anchor AS target_id, CASE WHEN v.defined_in = 'JOIN ON' THEN 'JOIN' ELSE 'FILTER' END AS relationship, CASE WHEN v.defined_in = 'JOIN ON' THEN 'JOIN_CONDITION' ELSE 'CONDITION' END AS operation
FROM v JOIN a ON a.script = v.script AND a.context = v.context WHERE v.defined_in IN ('WHERE', 'HAVING', 'QUALIFY', 'JOIN ON') AND (v.variable_type = 'column' AND contains(v.name, '.') OR v.variable_type = 'expression' AND v.defined_in = 'JOIN ON')
UNION ALL SELECT v.script, v.id, t.id, 'JOIN', 'JOIN_CONDITION' FROM v JOIN v t ON t.script = v.script AND t.context = v.context AND t.variable_type = 'merge_target' WHERE v.defined_in = 'MERGE ON' AND v.variable_type = 'column')""",
)
def dg_predicates(spark, sf):
    return phases.predicates(_analysis(spark).variables).select(*COLUMNS).distinct()


@_phase(
    "set_operations",
    f"""SELECT DISTINCT * FROM (SELECT v.script, v.id AS source_id, a.anchor AS target_id, 'SET_OP' AS relationship, 'SET' AS operation FROM v JOIN a ON a.script = v.script AND a.context = v.context WHERE v.variable_type = 'union_branch'
UNION ALL SELECT a.script, a.anchor, v.id, 'SET_OP', 'BRANCH' FROM a JOIN v ON v.script = a.script AND v.variable_type = 'union_branch' AND v.context = {OUTER.format(c='a.context')} WHERE a.context LIKE '%/union%')""",
)
def dg_set_operations(spark, sf):
    return phases.set_operations(_analysis(spark).variables).select(*COLUMNS).distinct()


@_phase(
    "schema",
    r"""SELECT DISTINCT * FROM (SELECT v.script, h.id AS source_id, v.id AS target_id, 'SCHEMA' AS relationship, 'TABLE_COLUMN' AS operation FROM v JOIN v h ON h.script = v.script AND h.context = v.context AND lower(h.name) = lower(regexp_extract(v.name, '^(.*)\.[^.]*$', 1))
WHERE v.variable_type = 'column' AND contains(v.name, '.') AND h.variable_type IN ('table', 'view', 'cte', 'subquery', 'virtual_table', 'merge_target') AND NOT starts_with(h.name, '⟐')
UNION ALL SELECT v.script, c.id, v.id, 'SCHEMA', 'CTE_BODY' FROM v JOIN v c ON c.script = v.script AND c.variable_type = 'cte' AND c.defined_in = 'CTE' AND c.id <> v.id AND (v.context = c.context OR starts_with(v.context, c.context || '/') OR starts_with(v.context, c.context || ':'))
UNION ALL SELECT v.script, a.anchor, v.id, 'SCHEMA', 'OUTPUT' FROM v JOIN a ON a.script = v.script AND a.context = v.context WHERE v.defined_in = 'SELECT' AND a.anchor <> v.id)""",
)
def dg_schema(spark, sf):
    return phases.schema_edges(_analysis(spark).variables).select(*COLUMNS).distinct()


RESOLVED = [
    ("c_join.sql", "CTE{totals}", "SELECT", "", "amount", "stg_orders", "scope"), ("c_join.sql", "CTE{totals}", "SELECT", "", "cust_id", "stg_orders", "scope"), ("c_join.sql", "CTE{totals}", "GROUP BY", "", "cust_id", "stg_orders", "scope"),
    ("c_join.sql", "CTE{ranked}", "SELECT", "t", "cust_id", "totals", "alias"), ("c_join.sql", "CTE{ranked}", "SELECT", "t", "total", "totals", "alias"),
    ("c_join.sql", "TOP0", "SELECT", "c", "cust_id", "stg_customers", "alias"), ("c_join.sql", "TOP0", "SELECT", "c", "name", "stg_customers", "alias"), ("c_join.sql", "TOP0", "SELECT", "c", "segment", "stg_customers", "alias"),
    ("c_join.sql", "TOP0", "SELECT", "r", "place", "ranked", "alias"), ("c_join.sql", "TOP0", "SELECT", "r", "total", "ranked", "alias"), ("c_join.sql", "TOP0", "JOIN ON", "r", "cust_id", "ranked", "alias"), ("c_join.sql", "TOP0", "JOIN ON", "c", "cust_id", "stg_customers", "alias"),
    ("e_report.sql", "TOP0", "SELECT", "s", "segment", "summary", "alias"), ("e_report.sql", "TOP0", "SELECT", "s", "mean_total", "summary", "alias"), ("e_report.sql", "TOP0", "ORDER BY", "s", "mean_total", "summary", "alias"), ("e_report.sql", "TOP0/subq0", "SELECT", "x", "mean_total", "summary", "alias"),
    ("e_report.sql", "TOP0/exists1", "WHERE", "q", "segment", "sales", "alias"), ("e_report.sql", "TOP0/exists1", "WHERE", "s", "segment", "summary", "alias"), ("e_report.sql", "TOP0/exists1", "WHERE", "q", "total", "sales", "alias"),
    ("j_ambiguous.sql", "TOP0", "SELECT", "", "name", "stg_customers", "workspace"), ("j_ambiguous.sql", "TOP0", "SELECT", "", "amount", "stg_orders", "workspace"), ("j_ambiguous.sql", "TOP0", "SELECT", "", "status", "stg_orders", "workspace"),
    ("j_ambiguous.sql", "TOP0", "SELECT", "", "cust_id", None, None), ("j_ambiguous.sql", "TOP0", "SELECT", "", "LEVEL", "⟐pseudo", "pseudo"), ("j_ambiguous.sql", "TOP0", "WHERE", "", "segment", "stg_customers", "workspace"), ("j_ambiguous.sql", "TOP0", "WHERE", "", "mystery", None, None),
    ("k_window.sql", "TOP0", "SELECT", "o", "cust_id", "stg_orders", "alias"), ("k_window.sql", "TOP0", "SELECT", "o", "day", "stg_orders", "alias"), ("k_window.sql", "TOP0", "SELECT", "o", "amount", "stg_orders", "alias"), ("k_window.sql", "TOP0", "QUALIFY", "", "k", "⟐output", "output"),
]


@corpus_query(f"WITH {_values('r', 'script, context, clause, qualifier, col, tbl, strategy', RESOLVED)} SELECT * FROM r")
def r_resolution(spark, sf):
    rows = _resolved(spark).filter(F.col("script").isin("c_join.sql", "e_report.sql", "j_ambiguous.sql", "k_window.sql"))
    return rows.select("script", "context", "clause", "qualifier", F.col("column").alias("col"), F.col("table").alias("tbl"), "strategy").distinct()


COVERED = [("a_load.sql", 7, 7, 100.0), ("b_customers.sql", 9, 9, 100.0), ("c_join.sql", 13, 13, 100.0), ("d_summary.sql", 10, 10, 100.0), ("e_report.sql", 7, 7, 100.0), ("f_merge.sql", 10, 10, 100.0), ("g_union.sql", 8, 8, 100.0), ("h_hive.sql", 6, 6, 100.0), ("j_ambiguous.sql", 7, 5, 71.4), ("k_window.sql", 6, 6, 100.0)]


@corpus_query(f"WITH {_values('c', 'script, total, resolved, coverage_pct', COVERED)} SELECT script, total::BIGINT AS total, resolved::BIGINT AS resolved, coverage_pct::DOUBLE AS coverage_pct FROM c")
def r_coverage(spark, sf):
    return coverage(_resolved(spark)).select("script", "total", "resolved", "coverage_pct")


FIELD_EDGES = [
    ("a_load.sql", "raw.orders.o_orderkey", "stg_orders.order_id"), ("a_load.sql", "raw.orders.o_custkey", "stg_orders.cust_id"), ("a_load.sql", "raw.orders.o_totalprice", "stg_orders.amount"), ("a_load.sql", "raw.orders.o_orderdate", "stg_orders.day"), ("a_load.sql", "raw.orders.o_orderstatus", "stg_orders.status"),
    ("b_customers.sql", "raw.customer.c_custkey", "stg_customers.cust_id"), ("b_customers.sql", "raw.customer.c_name", "stg_customers.name"), ("b_customers.sql", "raw.customer.c_mktsegment", "stg_customers.segment"), ("b_customers.sql", "raw.nation.n_name", "stg_customers.nation"),
    ("c_join.sql", "stg_orders.cust_id", "c_join.sql#totals.cust_id"), ("c_join.sql", "stg_orders.amount", "c_join.sql#totals.total"), ("c_join.sql", "c_join.sql#totals.cust_id", "c_join.sql#ranked.cust_id"), ("c_join.sql", "c_join.sql#totals.total", "c_join.sql#ranked.total"), ("c_join.sql", "c_join.sql#totals.total", "c_join.sql#ranked.place"),
    ("c_join.sql", "stg_customers.cust_id", "sales.cust_id"), ("c_join.sql", "stg_customers.name", "sales.name"), ("c_join.sql", "stg_customers.segment", "sales.segment"), ("c_join.sql", "c_join.sql#ranked.total", "sales.total"), ("c_join.sql", "c_join.sql#ranked.place", "sales.place"), ("c_join.sql", "c_join.sql#ranked.total", "sales.band"),
    ("d_summary.sql", "sales.segment", "summary.segment"), ("d_summary.sql", "sales.total", "summary.mean_total"), ("d_summary.sql", "sales.place", "summary.worst"),
    ("e_report.sql", "summary.segment", "e_report.sql#⟐result.segment"), ("e_report.sql", "summary.mean_total", "e_report.sql#⟐result.mean_total"),
    ("f_merge.sql", "stg_orders.cust_id", "f_merge.sql#u.cust_id"), ("f_merge.sql", "stg_orders.amount", "f_merge.sql#u.amount"), ("f_merge.sql", "f_merge.sql#u.amount", "sales.total"),
    ("g_union.sql", "stg_customers.cust_id", "people.id"), ("g_union.sql", "stg_customers.name", "people.name"), ("g_union.sql", "raw.supplier.s_suppkey", "people.s_suppkey"), ("g_union.sql", "raw.supplier.s_name", "people.s_name"), ("g_union.sql", "g_union.sql#⟐ values.id", "people.id"), ("g_union.sql", "g_union.sql#⟐ values.name", "people.name"), ("g_union.sql", "people.id", "people_view.id"), ("g_union.sql", "people.name", "people_view.n"),
    ("h_hive.sql", "stg_orders.order_id", "open_orders.order_id"), ("h_hive.sql", "stg_orders.amount", "open_orders.amount"), ("h_hive.sql", "stg_orders.order_id", "done_orders.order_id"), ("h_hive.sql", "stg_orders.day", "done_orders.day"),
    ("j_ambiguous.sql", "stg_customers.name", "j_ambiguous.sql#⟐result.name"), ("j_ambiguous.sql", "stg_orders.amount", "j_ambiguous.sql#⟐result.amount"), ("j_ambiguous.sql", "stg_orders.status", "j_ambiguous.sql#⟐result.status"),
    ("k_window.sql", "stg_orders.cust_id", "k_window.sql#⟐result.cust_id"), ("k_window.sql", "stg_orders.cust_id", "k_window.sql#⟐result.k"), ("k_window.sql", "stg_orders.day", "k_window.sql#⟐result.k"), ("k_window.sql", "stg_orders.amount", "k_window.sql#⟐result.step"), ("k_window.sql", "stg_orders.cust_id", "k_window.sql#⟐result.step"), ("k_window.sql", "stg_orders.day", "k_window.sql#⟐result.step"),
]
TRUE_FIELDS = _values("e", "script, source, target", FIELD_EDGES)


@corpus_query(f"WITH {TRUE_FIELDS} SELECT * FROM e")
def l_field_edges(spark, sf):
    return _fields(spark).select("script", "source", "target").distinct()


@corpus_query(f"WITH RECURSIVE {TRUE_FIELDS}, r AS (SELECT 'stg_orders.amount' AS node, 0 AS distance UNION SELECT e.target, distance + 1 FROM r JOIN e ON e.source = r.node WHERE distance < 20) SELECT 'stg_orders.amount' AS seed, node, min(distance) AS distance FROM r GROUP BY node")
def l_downstream(spark, sf):
    return flow.field_flow(_fields(spark), spark.createDataFrame([("stg_orders.amount",)], "node string"))


@corpus_query(f"WITH RECURSIVE {TRUE_FIELDS}, r AS (SELECT 'summary.mean_total' AS node, 0 AS distance UNION SELECT e.source, distance + 1 FROM r JOIN e ON e.target = r.node WHERE distance < 20) SELECT 'summary.mean_total' AS seed, node, min(distance) AS distance FROM r GROUP BY node")
def l_upstream(spark, sf):
    return flow.field_flow(_fields(spark), spark.createDataFrame([("summary.mean_total",)], "node string"), "upstream")


IO = [("a_load.sql", "raw.orders", "input"), ("a_load.sql", "stg_orders", "output"), ("b_customers.sql", "raw.customer", "input"), ("b_customers.sql", "raw.nation", "input"), ("b_customers.sql", "blocked", "input"), ("b_customers.sql", "stg_customers", "output"),
      ("c_join.sql", "stg_orders", "input"), ("c_join.sql", "stg_customers", "input"), ("c_join.sql", "sales", "output"), ("d_summary.sql", "sales", "input"), ("d_summary.sql", "kept", "input"), ("d_summary.sql", "summary", "output"), ("e_report.sql", "summary", "input"), ("e_report.sql", "sales", "input"),
      ("f_merge.sql", "stg_orders", "input"), ("f_merge.sql", "sales", "output"), ("f_merge.sql", "stg_orders", "output"), ("g_union.sql", "stg_customers", "input"), ("g_union.sql", "raw.supplier", "input"), ("g_union.sql", "people", "output"), ("g_union.sql", "people", "input"), ("g_union.sql", "people_view", "output"),
      ("h_hive.sql", "stg_orders", "input"), ("h_hive.sql", "open_orders", "output"), ("h_hive.sql", "done_orders", "output"), ("i_tables.ddl", "stg_orders", "output"), ("i_tables.ddl", "stg_customers", "output"), ("i_tables.ddl", "kept", "output"), ("j_ambiguous.sql", "stg_orders", "input"), ("j_ambiguous.sql", "stg_customers", "input"), ("k_window.sql", "stg_orders", "input"), ("l_broken.sql", "logs", "output")]
TRUE_IO = _values("io", "script, tbl, direction", IO)


def _io(spark) -> DataFrame:
    return _once(spark, "io", lambda: flow.table_io(_analysis(spark)))


@corpus_query(f"WITH {TRUE_IO} SELECT * FROM io")
def g01_table_io(spark, sf):
    return _io(spark).withColumnRenamed("table", "tbl")


@corpus_query(f"""WITH {TRUE_IO}, l AS (SELECT o.script AS source, i.script AS target, string_agg(DISTINCT o.tbl, ',' ORDER BY o.tbl) AS tables FROM io o JOIN io i ON o.tbl = i.tbl AND o.direction = 'output' AND i.direction = 'input' AND o.script <> i.script GROUP BY 1, 2),
s AS (SELECT a.script AS source, b.script AS target, string_agg(DISTINCT a.tbl, ',' ORDER BY a.tbl) AS tables FROM io a JOIN io b ON a.tbl = b.tbl AND a.direction = 'input' AND b.direction = 'input' AND a.script < b.script GROUP BY 1, 2)
SELECT source, target, 'data_lineage' AS relation, tables FROM l UNION ALL SELECT source, target, 'shared_input', tables FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source = s.source AND l.target = s.target OR l.source = s.target AND l.target = s.source)""")
def g02_script_graph(spark, sf):
    return flow.script_graph(_io(spark)).select("source", "target", "relation", F.concat_ws(",", "tables").alias("tables"))


@corpus_query(f"WITH {TRUE_IO} SELECT tbl, CASE WHEN count(DISTINCT direction) = 2 THEN 'intermediate' WHEN min(direction) = 'input' THEN 'source' ELSE 'output' END AS role FROM io GROUP BY tbl")
def g03_table_roles(spark, sf):
    return flow.table_roles(_io(spark)).withColumnRenamed("table", "tbl")


USES_SQL = "u AS (SELECT DISTINCT script, lower(tbl) AS tbl, lower(fld) AS fld FROM uses)"


def _uses(spark) -> DataFrame:
    return _once(spark, "uses", lambda: index.field_uses(_resolved(spark), _analysis(spark).evidence, index.written_outputs(_analysis(spark))))


TABLES = [("blocked", "cust_id", "b_customers.sql"), ("kept", "cust_id,ok", "d_summary.sql,i_tables.ddl"), ("logs", "msg", "l_broken.sql"), ("raw.nation", "n_name,n_nationkey", "b_customers.sql"), ("raw.supplier", "s_name,s_suppkey", "g_union.sql"), ("stg_customers", "cust_id,name,nation,segment", "b_customers.sql,c_join.sql,g_union.sql,i_tables.ddl,j_ambiguous.sql")]


@corpus_query(f"WITH {_values('t', 'tbl, fields, scripts', TABLES)} SELECT * FROM t")
def i01_table_index(spark, sf):
    names = [t for t, _, _ in TABLES]
    return index.table_index(_uses(spark)).filter(F.col("table").isin(*names)).select(F.col("table").alias("tbl"), F.concat_ws(",", "fields").alias("fields"), F.concat_ws(",", "scripts").alias("scripts"))


@corpus_query(f"WITH {_values('p', 'pair, scripts', [('sales.place', 'c_join.sql,d_summary.sql'), ('kept.ok', 'd_summary.sql,i_tables.ddl'), ('stg_customers.nation', 'b_customers.sql,i_tables.ddl')])} SELECT * FROM p")
def i02_pair_index(spark, sf):
    return index.pair_index(_uses(spark)).filter(F.col("pair").isin("sales.place", "kept.ok", "stg_customers.nation")).select("pair", F.concat_ws(",", "scripts").alias("scripts"))


@corpus_query(f"WITH {_values('f', 'script, tbl, field', [('c_join.sql', 'stg_customers', 'name'), ('c_join.sql', 'stg_customers', 'cust_id'), ('c_join.sql', 'stg_customers', 'segment'), ('d_summary.sql', 'sales', 'place')])} SELECT * FROM f")
def i03_scope_filter(spark, sf):
    a = spark.createDataFrame([("steps/C_JOIN.sql", "STG_CUSTOMERS"), ("c_join", "stg_orders"), ("d_summary.sql", "Sales"), ("e_report", "nowhere")], "SCRIPT_NAME string, TABLE_NAME string")
    b = spark.createDataFrame([("stg_customers", ""), ("stg_customers", "name"), ("SALES", "PLACE"), ("", "orphan")], "TABLE_NAME string, COL_NAME string")
    return index.scope_filter(_uses(spark), a, b).withColumnRenamed("table", "tbl")


@query("SELECT n_name AS name, CASE WHEN lower(n_name) = 'nation_1' THEN 0 WHEN starts_with(lower(n_name), 'nation_1') THEN 1 ELSE 2 END AS rank FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY rank, name LIMIT 20")
def i05_complete(spark, sf):
    from lodestream.sources.tables import table

    return index.complete(table(spark, sf, "nation").select(F.col("n_name").alias("name")), "Nation_1")


@corpus_query(f"WITH {_values('o', 'field, n, scripts', [('cust_id', 1, 'j_ambiguous.sql'), ('mystery', 1, 'j_ambiguous.sql')])} SELECT field, n::BIGINT AS n, scripts FROM o")
def i07_orphans(spark, sf):
    return index.orphans(_resolved(spark)).select("field", "n", F.concat_ws(",", "scripts").alias("scripts"))


@corpus_query("SELECT 4::BIGINT AS n_found, 5::BIGINT AS n_truth, 3::BIGINT AS n_both, 0.6::DOUBLE AS recall, 0.75::DOUBLE AS precision")
def i11_recall_precision(spark, sf):
    make = lambda rows: spark.createDataFrame([(r,) for r in rows], "k string")
    return index.recall_precision(make("abcx"), make("abcde"), ["k"])


@corpus_query(f"WITH {_values('r', 'script, roles', [('a_load.sql', 'DML TARGET'), ('c_join.sql', 'SELECT'), ('f_merge.sql', 'SELECT'), ('h_hive.sql', 'SELECT'), ('j_ambiguous.sql', 'SELECT'), ('k_window.sql', 'SELECT')])} SELECT * FROM r")
def l16_roles(spark, sf):
    return index.roles(_resolved(spark), _analysis(spark), "stg_orders", "amount").select("script", F.concat_ws(",", "roles").alias("roles"))


TEXTS = _values("s", "script, sql_text", sorted(CORPUS.items()))
LINES = "l AS (SELECT script, unnest(string_split(sql_text, chr(10))) AS text, unnest(range(1, len(string_split(sql_text, chr(10))) + 1)) AS line FROM s)"


@corpus_query(f"""WITH {TEXTS}, c AS (SELECT script, unnest(string_split(regexp_replace(sql_text, '[^()]', '', 'g'), '')) AS c, unnest(range(1, length(regexp_replace(sql_text, '[^()]', '', 'g')) + 1)) AS k FROM s),
d AS (SELECT script, max(depth) AS depth FROM (SELECT script, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY script ORDER BY k) AS depth FROM c) GROUP BY script)
SELECT s.script, len(string_split(sql_text, chr(10)))::BIGINT AS n_lines, len(regexp_extract_all(sql_text, ';'))::BIGINT AS statements, len(regexp_extract_all(sql_text, '(?i)\\bJOIN\\b'))::BIGINT AS joins, len(regexp_extract_all(sql_text, '(?i)\\bSELECT\\b'))::BIGINT AS selects,
len(regexp_extract_all(sql_text, '(?i)\\bCASE\\b'))::BIGINT AS cases, greatest(coalesce(depth, 0), 0)::BIGINT AS depth FROM s LEFT JOIN d ON d.script = s.script""")
def f08_profile(spark, sf):
    from lodestream.lineage.text import profile

    return profile(corpus(spark))


@corpus_query(f"""WITH {TEXTS}, {LINES}, k(clause) AS (VALUES ('SELECT'), ('FROM'), ('WHERE'), ('GROUP BY'), ('HAVING'), ('ORDER BY'), ('LIMIT')),
f AS (SELECT script, clause, min(line) AS low FROM l JOIN k ON regexp_matches(upper(trim(text)), '^' || replace(clause, ' ', '[ ]+') || '\\b') GROUP BY 1, 2), e AS (SELECT script, max(line) AS last FROM l GROUP BY 1)
SELECT f.script, clause, CAST(low AS INT) AS low, CAST(coalesce(lead(low) OVER (PARTITION BY f.script ORDER BY low) - 1, last) AS INT) AS high FROM f JOIN e ON e.script = f.script""")
def f09_clause_ranges(spark, sf):
    from lodestream.lineage.text import clause_ranges

    return clause_ranges(corpus(spark))


@corpus_query(f"""WITH {TEXTS}, {LINES}, e AS (SELECT script, max(line) AS last FROM l GROUP BY 1), w AS (SELECT l.script, greatest(line - 1, 1) AS low, least(line + 1, last) AS high FROM l JOIN e ON e.script = l.script WHERE contains(text, 'stg_orders')),
m AS (SELECT script, min(low) AS low, max(high) AS high FROM (SELECT *, sum(new) OVER (PARTITION BY script ORDER BY low, high) AS island FROM (SELECT *, CASE WHEN max(high) OVER (PARTITION BY script ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= low THEN 0 ELSE 1 END AS new FROM w)) GROUP BY script, island)
SELECT m.script, CAST(low AS INT) AS low, CAST(high AS INT) AS high, string_agg(text, chr(10) ORDER BY line) AS text, CAST(any_value(low - before - 1) AS INT) AS omitted
FROM (SELECT *, coalesce(lag(high) OVER (PARTITION BY script ORDER BY low), 0) AS before FROM m) m JOIN l ON l.script = m.script AND l.line BETWEEN low AND high GROUP BY m.script, low, high""")
def s12_excerpts(spark, sf):
    from lodestream.lineage.text import excerpts, lines

    hits = lines(corpus(spark)).filter("contains(text, 'stg_orders')").select("script", F.col("line").alias("low"), F.col("line").alias("high"))
    return excerpts(corpus(spark), hits, 1)


@corpus_query(f"WITH {_values('t', 'relationship, passes, ways, class', flow.EDGE_TYPES)} SELECT class, count(*) AS n, count(*) FILTER (WHERE passes) AS n_value FROM t GROUP BY class")
def edge_types(spark, sf):
    types = spark.createDataFrame(flow.EDGE_TYPES, "relationship string, value boolean, both boolean, class string")
    return types.groupBy("class").agg(F.count("*").alias("n"), F.count(F.when(F.col("value"), 1)).alias("n_value"))
