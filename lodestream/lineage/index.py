"""Indexes over scripts, scope filters, lookups with typing errors, integrity checks and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.lineage.analysis import Analysis
from lodestream.operators.graph import components

MOST_CSV_BYTES = 20 << 20
NAMES = r"^[A-Za-z_][A-Za-z0-9_$.]*$"


def field_uses(resolved: DataFrame, evidence: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """(script, table, field) in lower case, from resolved references, from schema evidence and from outputs written without a list of columns (see ``written_outputs``); plain names alone."""
    used = resolved.filter("table is not null AND strategy NOT IN ('pseudo', 'output')").select("script", F.lower("table").alias("table"), F.lower("column").alias("field"))
    told = evidence.select("script", F.lower("table").alias("table"), F.lower("column").alias("field"))
    told = told if written is None else told.union(written.select("script", "table", "field"))
    return used.union(told).filter(F.col("table").rlike(NAMES) & F.col("field").rlike(NAMES)).distinct()


def written_outputs(analysis: Analysis) -> DataFrame:
    """(script, table, field): what an INSERT without a list of columns gives its target, by the names of its select items."""
    listed = analysis.evidence.filter("source = 'INSERT'").select("script", F.lower("table").alias("table")).distinct()
    targets = analysis.variables.filter("variable_type = 'table' AND defined_in = 'INSERT'").select("script", "context", F.lower("name").alias("table"))
    items = analysis.variables.filter("is_output AND defined_in = 'SELECT' AND variable_type <> 'literal'").select("script", "context", F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("field"))
    return targets.join(listed, ["script", "table"], "left_anti").join(items, ["script", "context"]).select("script", "table", "field").distinct()


def table_index(uses: DataFrame) -> DataFrame:
    return uses.groupBy("table").agg(F.sort_array(F.collect_set("field")).alias("fields"), F.sort_array(F.collect_set("script")).alias("scripts"))


def field_index(uses: DataFrame) -> DataFrame:
    return uses.groupBy("field").agg(F.sort_array(F.collect_set("table")).alias("tables"), F.sort_array(F.collect_set("script")).alias("scripts"))


def pair_index(uses: DataFrame) -> DataFrame:
    return uses.groupBy(F.concat_ws(".", "table", "field").alias("pair")).agg(F.sort_array(F.collect_set("script")).alias("scripts"))


def read_scope_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A header CSV in UTF-8 with or without mark, else GB 18030, else Latin-1: the first that all its bytes decode in. A file over ``MOST_CSV_BYTES`` is an error, as it is read on the driver."""
    file = spark.read.format("binaryFile").load(path)
    if (size := file.select("length").first()["length"]) > MOST_CSV_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {MOST_CSV_BYTES}")
    data = file.select("content").first()["content"]
    for encoding in ("utf-8-sig", "gb18030", "latin-1"):
        try:
            text = bytes(data).decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    import csv
    import io

    rows = [[(r.get(c) or "").strip() for c in columns] for r in csv.DictReader(io.StringIO(text))]
    return spark.createDataFrame([r for r in rows if any(r)], ", ".join(f"`{c}` string" for c in columns))


def scope_filter(uses: DataFrame, script_tables: DataFrame | None, table_columns: DataFrame | None) -> DataFrame:
    """Uses within file 1 (SCRIPT_NAME, TABLE_NAME) and file 2 (TABLE_NAME, COL_NAME): both where both are given.

    A blank column leaves its table open, whatever other rows say; a column without a table counts for nothing; names compare
    without case, scripts by path, base name or name without .sql. An empty intersection stays empty.
    """
    out = uses
    base = F.regexp_replace(F.regexp_extract(F.lower("script"), r"([^/]*)$", 1), r"\.sql$", "")
    if script_tables is not None:
        a = script_tables.select(F.regexp_replace(F.regexp_extract(F.lower("SCRIPT_NAME"), r"([^/]*)$", 1), r"\.sql$", "").alias("base"), F.lower("TABLE_NAME").alias("table")).distinct()
        out = out.withColumn("base", base).join(a, ["base", "table"], "left_semi").drop("base")
    if table_columns is not None:
        b = table_columns.filter("TABLE_NAME <> ''").select(F.lower("TABLE_NAME").alias("table"), F.lower(F.coalesce("COL_NAME", F.lit(""))).alias("field"))
        open_tables = b.filter("field = ''").select("table").distinct()
        listed = b.filter("field <> ''").distinct()
        out = out.join(open_tables, "table", "left_semi").unionByName(out.join(open_tables, "table", "left_anti").join(listed, ["table", "field"], "left_semi"))
    return out.select(*uses.columns)


def filter_payload(uses: DataFrame, script_tables: DataFrame | None, table_columns: DataFrame | None) -> DataFrame:
    """One row on a scope filter: n_scripts, n_tables and n_fields within it, n_dropped (columns without a table), ignored (tables of file 2 that file 1 has not), and a warning where nothing is left or something is ignored."""
    inside = scope_filter(uses, script_tables, table_columns)
    counts = inside.agg(F.countDistinct("script").alias("n_scripts"), F.countDistinct("table").alias("n_tables"), F.countDistinct("table", "field").alias("n_fields"))
    none = uses.sparkSession.createDataFrame([], "TABLE_NAME string, COL_NAME string, SCRIPT_NAME string")
    a, b = (script_tables if script_tables is not None else none), (table_columns if table_columns is not None else none)
    dropped = b.agg(F.count(F.when((F.coalesce("TABLE_NAME", F.lit("")) == "") & (F.coalesce("COL_NAME", F.lit("")) != ""), 1)).alias("n_dropped"))
    only = b.filter("TABLE_NAME <> ''").select(F.lower("TABLE_NAME").alias("table")).distinct()
    only = only.join(a.select(F.lower("TABLE_NAME").alias("table")), "table", "left_anti") if script_tables is not None else only.limit(0)
    row = counts.crossJoin(dropped).crossJoin(only.agg(F.array_sort(F.collect_set("table")).alias("ignored")))
    warning = F.when(F.col("n_scripts") == 0, "nothing is left").when(F.size("ignored") > 0, "tables of the second file are not in the first").otherwise("")
    return row.withColumn("warning", warning)


def tables_of(uses: DataFrame, field: str) -> DataFrame:
    """Tables that have the field."""
    return uses.filter(F.col("field") == field.lower()).select("table").distinct()


def fields_of(uses: DataFrame, table: str) -> DataFrame:
    """Fields that the table has."""
    return uses.filter(F.col("table") == table.lower()).select("field").distinct()


def star_expansion(analysis: Analysis, uses: DataFrame) -> DataFrame:
    """(script, context, table, field): what an unqualified star of a query gives, by what is known of the whole tables of its own FROM."""
    stars = analysis.scopes.filter("kind = 'star' AND table = '*'").select("script", "context").distinct()
    tables = analysis.scopes.filter("kind = 'physical'").select("script", "context", F.lower("table").alias("table")).distinct()
    return stars.join(tables, ["script", "context"]).join(uses.select("table", "field").distinct(), "table").select("script", "context", "table", "field")


def complete(names: DataFrame, text: str, most: int = 20) -> DataFrame:
    """(name, rank): names that hold the text; if fewer than two, also those alike in one change: exact, then beginning, then holding, then alike."""
    low, t = F.lower("name"), text.lower()
    rank = F.when(low == t, 0).when(low.startswith(t), 1).when(low.contains(t), 2).when(F.levenshtein(low, F.lit(t), 1) >= 0, 3)
    ranked = names.select("name").distinct().withColumn("rank", rank).filter("rank is not null")
    hits = ranked.agg(F.count(F.when(F.col("rank") < 3, 1)).alias("hits"))
    return ranked.crossJoin(F.broadcast(hits)).filter("rank < 3 OR hits < 2").select("name", "rank").orderBy("rank", "name").limit(most)


def orphans(resolved: DataFrame) -> DataFrame:
    """(field, n, scripts, lines): references that no rule gives a table."""
    rows = resolved.filter("table is null")
    return rows.groupBy(F.lower("column").alias("field")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("script")).alias("scripts"), F.min("line").alias("first_line"))


def schema_inference(edges: DataFrame, evidence: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(table, field): what tables hold, from evidence, and what alias and flow edges (source, target) pass on, until nothing is new."""
    from lodestream.operators.graph import _keep

    known = _keep(evidence.select(F.lower("table").alias("table"), F.lower("column").alias("field")).distinct())
    front = known
    steps = edges.select(F.lower("source").alias("table"), F.lower("target").alias("next")).distinct()
    for _ in range(most_rounds):
        new = front.join(steps, "table").select(F.col("next").alias("table"), "field").distinct()
        front = _keep(new.join(known, ["table", "field"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise RuntimeError(f"the inference did not settle in {most_rounds} rounds")


def topology(v: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, check, n, ok): integrity of each script's graph."""
    scripts = v.select("script").distinct()
    ends = edges.select("script", F.col("source_id").alias("id")).union(edges.select("script", "target_id")).distinct()
    parts = components(edges, "source_id", "target_id").withColumnRenamed("node", "id")
    by = lambda df, name: df.groupBy("script").agg(F.count("*").alias("n")).select("script", F.lit(name).alias("check"), "n")
    found = [
        by(v.join(ends, ["script", "id"], "left_anti"), "isolated nodes"),
        by(v.join(parts, "id").select("script", "component").distinct().withColumn("k", F.row_number().over(Window.partitionBy("script").orderBy("component"))).filter("k > 1"), "further components"),
        by(v.groupBy("script", "id").count().filter("count > 1"), "repeated nodes"),
        by(edges.groupBy("script", "source_id", "target_id", "relationship").count().filter("count > 1"), "repeated edges"),
        by(v.groupBy("script", F.lower("name").alias("n"), "variable_type", "context").count().filter("count > 1"), "repeated names"),
        by(edges.join(v.select("script", F.col("id").alias("source_id")), ["script", "source_id"], "left_anti"), "edges from nowhere"),
        by(edges.join(v.select("script", F.col("id").alias("target_id")), ["script", "target_id"], "left_anti"), "edges to nowhere"),
        by(edges.filter("relationship = 'SUBSET'").groupBy("script").count().filter("count > 20"), "too many bridges"),
        by(v.filter("variable_type = 'column' AND size(source_columns) = 0"), "columns without a source"),
        by(v.filter("alias_of is not null").join(v.select("script", F.col("id").alias("alias_of")), ["script", "alias_of"], "left_anti"), "aliases of nothing"),
        by(v.filter("alias_of is not null").join(edges.filter("relationship = 'ALIAS'").select("script", F.col("target_id").alias("id")), ["script", "id"], "left_anti"), "aliases without an edge"),
    ]
    checks = found[0]
    for more in found[1:]:
        checks = checks.unionByName(more)
    names = F.array(*(F.lit(x) for x in ("isolated nodes", "further components", "repeated nodes", "repeated edges", "repeated names", "edges from nowhere", "edges to nowhere", "too many bridges", "columns without a source", "aliases of nothing", "aliases without an edge")))
    every = scripts.select("script", F.explode(names).alias("check"))
    return every.join(checks, ["script", "check"], "left").select("script", "check", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("ok"))


def recall_precision(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(n_found, n_truth, n_both, recall, precision) of sets of rows."""
    f, t = found.select(*keys).distinct(), truth.select(*keys).distinct()
    both = f.join(t, keys, "left_semi")
    counts = f.agg(F.count("*").alias("n_found")).crossJoin(t.agg(F.count("*").alias("n_truth"))).crossJoin(both.agg(F.count("*").alias("n_both")))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("n_both") / F.col(n), 4))
    return counts.withColumns({"recall": share("n_truth"), "precision": share("n_found")})


def accuracy_score(keyword: Column, entity: Column, specificity: Column, span: Column) -> Column:
    """0.35 keyword + 0.25 entity + 0.25 specificity + 0.15 span."""
    return 0.35 * keyword + 0.25 * entity + 0.25 * specificity + 0.15 * span


def partition_metrics(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """By script: shares of lines (script, line) that parts (script, low, high) cover, cover more than once and leave, and parts a covered line."""
    covered = parts.select("script", F.explode(F.sequence("low", "high")).alias("line")).groupBy("script", "line").agg(F.count("*").alias("n"))
    all_lines = lines.select("script", "line").distinct().join(covered, ["script", "line"], "left")
    total, hit, more = F.count("*"), F.count("n"), F.count(F.when(F.col("n") > 1, 1))
    return all_lines.groupBy("script").agg(F.round(hit / total, 4).alias("coverage"), F.round(more / total, 4).alias("overlap"), F.round(1 - hit / total, 4).alias("gap"), F.round(F.try_divide(F.sum("n"), hit), 4).alias("redundancy"))


def roles(resolved: DataFrame, analysis: Analysis, table: str, field: str) -> DataFrame:
    """(script, roles): in which clauses a script uses table.field, and whether it writes it."""
    used = resolved.filter((F.lower("table") == table.lower()) & (F.lower("column") == field.lower())).select("script", "clause")
    written = analysis.evidence.filter((F.lower("table") == table.lower()) & (F.lower("column") == field.lower()) & F.col("source").isin("INSERT", "UPDATE SET", "MERGE SET", "MERGE INSERT", "PARTITION")).select("script", F.lit("DML TARGET").alias("clause"))
    return used.union(written).groupBy("script").agg(F.sort_array(F.collect_set("clause")).alias("roles"))
