"""The physical model of scripts: tables and fields behind the variables, who owns which occurrence, and edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.lineage.analysis import Analysis
from lodestream.lineage.flow import owner_of

TABLE_LIKE = ("table", "view", "merge_target", "cte", "subquery", "virtual_table", "union_branch")
FIELD_CHARS = 36


def short_name() -> F.Column:
    """A variable's name as a field: a column's and an assigned one's last part, a computed value's whole name, in lower case, at most 36 characters."""
    dotted = (F.col("variable_type") == "column") | F.col("defined_in").isin("PARTITION", "UPDATE SET", "MERGE SET")
    return F.substring(F.lower(F.when(dotted, F.regexp_extract("name", r"([^.]+)$", 1)).otherwise(F.col("name"))), 1, FIELD_CHARS)


def clause_of() -> F.Column:
    """The clause that a variable's references are noted under."""
    return F.when(F.col("defined_in") == "SELECT REF", "SELECT").otherwise(F.col("defined_in"))


def _resolved_names(resolved: DataFrame) -> DataFrame:
    """(script, context, clause, used, key): references by their whole text, with the table that they resolve to."""
    used = F.lower(F.concat(F.when(F.col("qualifier") != "", F.concat("qualifier", F.lit("."))).otherwise(F.lit("")), F.col("column")))
    refs = resolved.filter("strategy IS NULL OR strategy <> 'output'").select("script", "context", "clause", used.alias("used"), F.lower("table").alias("key"))
    return refs.groupBy("script", "context", "clause", "used").agg(F.min("key").alias("key"))


def sources(variables: DataFrame, resolved: DataFrame) -> DataFrame:
    """(script, id, used, key, field): each source column of each variable, with the table that it resolves to, if any."""
    uses = variables.select("script", "id", "context", clause_of().alias("clause"), F.explode("source_columns").alias("c")).select("script", "id", "context", "clause", F.lower("c").alias("used"))
    return uses.join(_resolved_names(resolved), ["script", "context", "clause", "used"], "left").select("script", "id", "used", "key", F.regexp_extract("used", r"([^.]+)$", 1).alias("field"))


def _like(name: str = "variable_type") -> str:
    return f"{name} IN ({', '.join(repr(x) for x in TABLE_LIKE)})"


def occurrences(analysis: Analysis, resolved: DataFrame) -> DataFrame:
    """Every variable with the entity that it is an occurrence of: script, id, name, variable_type, context, statement, ord, line, key, kind, field, table_like.

    A table, its aliases and its columns share a key, the whole name in lower case. Containers of one place (outputs, set operations) are
    keyed by name and context. A column belongs where its reference resolves, a computed value to its query's container; what
    nothing owns has no key. kind: physical, cte, subquery, virtual or union.
    """
    v = analysis.variables
    low = F.lower
    named = v.filter("variable_type = 'cte' AND defined_in = 'CTE'").select("script", low("name").alias("key"), F.lit("cte").alias("named"))
    named = named.union(v.filter("variable_type = 'subquery'").select("script", low("name"), F.lit("subquery")))
    named = named.groupBy("script", "key").agg(F.min("named").alias("named"))
    place = F.concat("name", F.lit("@"), "context")
    tables = v.filter(_like()).withColumn("key", F.when(F.col("variable_type").isin("virtual_table", "union_branch"), place).otherwise(low(F.coalesce(F.get("source_tables", F.lit(0)), F.col("name"))))).withColumn("field", F.lit(None).cast("string"))

    fields = v.filter(f"NOT ({_like()})").withColumn("part", short_name())
    single = fields.filter("variable_type = 'column' AND size(source_columns) = 1 AND defined_in NOT IN ('PARTITION', 'UPDATE SET', 'MERGE SET')").withColumn("used", low(F.col("source_columns")[0])).withColumn("clause", clause_of())
    single = single.join(_resolved_names(resolved), ["script", "context", "clause", "used"], "left").withColumn("field", F.regexp_extract("used", r"([^.]+)$", 1)).drop("used", "clause")
    rest = fields.join(single.select("script", "id"), ["script", "id"], "left_anti")
    prefix = low(F.expr("substring_index(name, '.', size(split(name, '[.]')) - 1)"))
    container = F.coalesce(low(owner_of(F.col("context"))), F.concat(F.lit("⟐ output@"), "context"))
    rest = rest.withColumn("key", F.when(F.col("defined_in").isin("PARTITION", "UPDATE SET", "MERGE SET"), prefix).otherwise(container)).withColumn("field", F.col("part"))

    columns = ["script", "id", "name", "variable_type", "context", "statement", "ord", F.col("line_start").alias("line"), "defined_in", "alias_of", "key", "field"]
    every = tables.select(*columns).unionByName(single.select(*columns)).unionByName(rest.select(*columns)).join(named, ["script", "key"], "left")
    kind = F.when(F.col("key").isNull(), None).when(F.col("variable_type") == "union_branch", "union").when(F.col("key").startswith("⟐"), "virtual").otherwise(F.coalesce("named", F.lit("physical")))
    return every.select("script", "id", "name", "variable_type", "context", "statement", "ord", "line", "defined_in", "alias_of", "key", kind.alias("kind"), "field", F.expr(_like()).alias("table_like"))


def entities(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, key, kind, roles, alias_views, occurrence_ids, line_start, line_end): one row a table or container.

    Roles: read, write, merge_target, cte_fed (a common table expression flows into it), partition.
    """
    role = F.when(F.col("variable_type") == "merge_target", "merge_target").when(F.col("defined_in").isin("INSERT", "UPDATE", "DELETE", "CTAS", "SELECT INTO", "CREATE VIEW"), "write").when(F.col("defined_in").isin("FROM", "JOIN"), "read").when(F.col("defined_in") == "PARTITION", "partition")
    tables = found.filter("key IS NOT NULL AND (table_like OR defined_in = 'PARTITION')").withColumn("role", role)
    ends = found.select("script", F.col("id").alias("node"), "key", "kind")
    fed = edges.filter("relationship IN ('TABLE_FLOW', 'DML')").join(ends.filter("kind = 'cte'").select("script", F.col("node").alias("source_id")), ["script", "source_id"], "left_semi")
    fed = fed.join(ends.select("script", F.col("node").alias("target_id"), "key"), ["script", "target_id"]).select("script", "key", F.lit("cte_fed").alias("role")).distinct()
    roles = tables.select("script", "key", "role").union(fed).groupBy("script", "key").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    out = tables.filter("table_like").groupBy("script", "key").agg(
        F.min("kind").alias("kind"), F.sort_array(F.collect_set(F.when(F.col("alias_of").isNotNull(), F.lower("name")))).alias("alias_views"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("occurrence_ids"), F.min("line").alias("line_start"), F.max("line").alias("line_end"),
    )
    return out.join(roles, ["script", "key"])


def fields(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, key, field, occurrence_ids, line_start, line_end, value_sources, uses): one row a field; what nothing owns has no key.

    value_sources: variables that a value comes from; uses: relationships that lead out of an occurrence.
    """
    rows = found.filter("NOT table_like AND field <> ''")
    base = rows.groupBy("script", "key", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("occurrence_ids"), F.min("line").alias("line_start"), F.max("line").alias("line_end"))
    value = edges.filter("relationship IN ('REF', 'TRANSFORM', 'AGGREGATE', 'WINDOW', 'COMPUTED') AND operation <> 'READ'")
    into = value.join(rows.select("script", F.col("id").alias("target_id"), "key", "field"), ["script", "target_id"]).groupBy("script", "key", "field").agg(F.countDistinct("source_id").alias("value_sources"))
    out = edges.join(rows.select("script", F.col("id").alias("source_id"), "key", "field"), ["script", "source_id"]).groupBy("script", "key", "field").agg(F.sort_array(F.collect_set("relationship")).alias("uses"))
    same = lambda a, b: (a["script"] == b["script"]) & a["key"].eqNullSafe(b["key"]) & (a["field"] == b["field"])
    joined = base.join(into.withColumnRenamed("script", "s"), (base["script"] == F.col("s")) & base["key"].eqNullSafe(into["key"]) & (base["field"] == into["field"]), "left").select(base["*"], F.coalesce("value_sources", F.lit(0)).alias("value_sources"))
    return joined.join(out, same(joined, out), "left").select(joined["*"], F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))


def physical_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(script, source_key, source_field, target_key, target_field, relationship, operation, source_id, target_id, source_line, target_line): dependencies between owners."""
    end = lambda x: found.select("script", F.col("id").alias(f"{x}_id"), F.col("key").alias(f"{x}_key"), F.col("field").alias(f"{x}_field"), F.col("line").alias(f"{x}_line"))
    joined = edges.join(end("source"), ["script", "source_id"]).join(end("target"), ["script", "target_id"])
    return joined.select("script", "source_key", "source_field", "target_key", "target_field", "relationship", "operation", "source_id", "target_id", "source_line", "target_line")
