"""Columns to tables, by rules that never guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.lineage.analysis import Analysis
from lodestream.lineage.parser import PSEUDO
from lodestream.sources.writers import scratch_table


def parent_of(context: Column) -> Column:
    """The enclosing scope: without the last part (/subq/name, /part or :join:name); null at the top."""
    cut = F.regexp_replace(context, r"(/subq/[^/:]+|/[^/:]+|:join:[^/:]+)$", "")
    return F.when(cut != context, cut)


def scope_chain(contexts: DataFrame) -> DataFrame:
    """(script, context, outer, distance) of each context and those that enclose it."""
    parts = F.split(F.regexp_replace("context", "/subq/", "/subq~"), r"(?=/|:join:)")
    outer = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("distance"), F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), ""), "/subq~", "/subq/").alias("outer")))
    return contexts.select("script", "context").distinct().select("script", "context", F.explode(outer).alias("x")).select("script", "context", "x.outer", "x.distance")


def resolve(analysis: Analysis) -> DataFrame:
    """(script, id, qualifier, column, context, clause, line, table, strategy) of every reference.

    alias: the qualifier names a source of the nearest scope that has it. cte: a bare name that one visible common table
    expression or derived table gives out. scope: the nearest scope with sources has a single physical table. schema: of
    several, exactly one is known to own the column, by what the script itself tells; workspace: by what all scripts tell. system, pseudo: by name. output: a clause after the select list names one of its columns. A field named as a visible table, and
    all else, stays unresolved. Names compare whole and without case.
    """
    low = F.lower
    # what several rules read is written once, else the plan would repeat it for each
    once = lambda df: scratch_table(df.sparkSession, df)[0]
    refs, scopes = once(analysis.refs), once(analysis.scopes)
    sources = scopes.filter("kind in ('physical', 'cte', 'derived', 'values', 'unnest', 'system')")
    outputs = scopes.filter("kind = 'output'").select("script", F.col("context").alias("given_in"), low("table").alias("given")).distinct()
    chain = scope_chain(refs.select("script", "context").distinct())
    # read by five rules below
    visible = once(chain.join(sources.withColumnRenamed("context", "outer"), ["script", "outer"]))
    keyed = refs.withColumn("q", low(F.regexp_extract("qualifier", r"([^.]*)$", 1))).withColumn("c", low("column"))
    key = ["script", "id"]

    by_alias = keyed.filter("q <> ''").join(visible.withColumn("q", low("alias")), ["script", "context", "q"])
    first = Window.partitionBy(*key).orderBy("distance", "line_")
    by_alias = by_alias.select(*key, visible["table"], visible["kind"], "distance", visible["line"].alias("line_")).withColumn("k", F.row_number().over(first)).filter("k = 1")
    by_alias = by_alias.select(*key, F.when(F.col("kind") == "derived", F.regexp_extract("table", r"([^/:]*)$", 1)).otherwise(F.col("table")).alias("table"), F.when(F.col("kind") == "system", "system").otherwise("alias").alias("strategy"))

    bare = keyed.filter("q = ''")
    named = bare.join(visible.withColumn("c", low("table")), ["script", "context", "c"], "left_semi").select(*key)
    pseudo = bare.filter(F.col("c").isin(*sorted(PSEUDO))).select(*key, F.lit("⟐pseudo").alias("table"), F.lit("pseudo").alias("strategy"))
    # a clause after the select list may name what it gives out; scopes come first in WHERE, FROM and the list itself
    own = bare.filter("clause IN ('QUALIFY', 'ORDER BY', 'SORT BY')").join(outputs.select("script", F.col("given_in").alias("context"), F.col("given").alias("c")), ["script", "context", "c"], "left_semi").select(*key, F.lit("⟐output").alias("table"), F.lit("output").alias("strategy"))
    open_refs = bare.join(named, key, "left_anti").join(pseudo.unionByName(own), key, "left_anti")

    seen = once(open_refs.select("script", "id", "context", "c").join(visible.select("script", "context", "distance", "alias", "table", "kind"), ["script", "context"]))
    given = seen.filter("kind = 'cte' OR kind = 'derived' AND NOT startswith(context, table)").withColumn("given_in", F.when(F.col("kind") == "cte", F.concat(F.lit("CTE{"), F.col("table"), F.lit("}"))).otherwise(F.col("table")))
    given = once(given.join(outputs.withColumnRenamed("given", "c"), ["script", "given_in", "c"]))
    nearest = given.groupBy(*key).agg(F.min("distance").alias("distance"))
    by_cte = given.join(nearest, [*key, "distance"]).groupBy(*key).agg(F.countDistinct("given_in").alias("n"), F.min(F.when(F.col("kind") == "cte", F.col("table")).otherwise(F.col("alias"))).alias("table")).filter("n = 1").select(*key, "table", F.lit("cte").alias("strategy"))

    rest = once(seen.join(given.select(*key).distinct(), key, "left_anti").filter("kind = 'physical'"))
    nearest = rest.groupBy(*key).agg(F.min("distance").alias("distance"))
    here = rest.join(nearest, [*key, "distance"]).groupBy(*key).agg(F.collect_set("table").alias("tables"), F.first("c").alias("c"))
    others = seen.filter("kind in ('cte', 'derived', 'unnest', 'values')").join(nearest, [*key, "distance"], "left_semi").select(*key).distinct()
    single = here.filter(F.size("tables") == 1).join(others, key, "left_anti").select(*key, F.element_at("tables", 1).alias("table"), F.lit("scope").alias("strategy"))
    # first the script's own evidence, then that of all scripts; where two of the visible tables are known to own the column, neither does
    told = once(evidence_of(analysis))
    here, single = once(here), once(single)
    several = once(here.join(single, key, "left_anti").select(*key, "c", F.explode("tables").alias("table")).withColumn("t", low("table")))
    one = lambda rows, name: rows.groupBy(*key).agg(F.countDistinct("t").alias("n"), F.min("table").alias("table")).select(*key, "n", "table", F.lit(name).alias("strategy"))
    in_script = once(one(several.join(told, ["script", "t", "c"], "left_semi"), "schema"))
    in_all = once(one(several.join(told.select("t", "c").distinct(), ["t", "c"], "left_semi"), "workspace"))
    # what the script alone tells is taken back if another script knows a second owner
    by_schema = in_script.filter("n = 1").drop("n").join(in_all.filter("n > 1").select(*key), key, "left_anti")
    by_schema = by_schema.unionByName(in_all.filter("n = 1").drop("n").join(in_script.select(*key), key, "left_anti"))

    found = by_alias.unionByName(pseudo).unionByName(own).unionByName(by_cte).unionByName(single).unionByName(by_schema)
    return refs.join(found, key, "left")


def evidence_of(analysis: Analysis) -> DataFrame:
    """(script, t, c): which table has which column: by lists, assignments and definitions, and by references under the name or alias of a single table."""
    low = F.lower
    told = analysis.evidence.select("script", low("table").alias("t"), low("column").alias("c"))
    qualified = analysis.refs.filter("qualifier <> ''").select("script", "context", low("qualifier").alias("q"), low("column").alias("c"))
    named = analysis.scopes.filter("kind = 'physical'").select("script", "context", low("alias").alias("q"), low("table").alias("t")).distinct()
    return told.union(qualified.join(named, ["script", "context", "q"]).select("script", "t", "c")).distinct()


def workspace(analysis: Analysis) -> DataFrame:
    """(script, column, table, strategy, owners) of bare references that see several whole tables: who is known to own the column among them, by the script and by all; strategy schema, workspace, or ambiguous for two owners (which give none) and unknown for none."""
    low, key = F.lower, ["script", "id"]
    refs = analysis.refs.filter("qualifier = ''").select("script", "id", "context", "column", low("column").alias("c"))
    tables = analysis.scopes.filter("kind = 'physical'").select("script", "context", low("table").alias("t")).distinct()
    seen = refs.join(tables, ["script", "context"])
    several = seen.join(seen.groupBy(*key).agg(F.countDistinct("t").alias("n")).filter("n > 1").select(*key), key, "left_semi")
    told = evidence_of(analysis)
    owners = several.join(told.select("t", "c").distinct(), ["t", "c"], "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set("t")).alias("owners"))
    rows = several.select(*key, "column").distinct().join(owners, key, "left").join(resolve(analysis).select(*key, "table", "strategy"), key, "left")
    owners = F.coalesce("owners", F.array().cast("array<string>"))
    found = F.when(F.size(owners) > 1, "ambiguous").when(F.size(owners) == 0, "unknown").otherwise(F.col("strategy"))
    return rows.select("script", "column", "table", found.alias("strategy"), owners.alias("owners"))


def coverage(resolved: DataFrame) -> DataFrame:
    """By script: references, how many have a table, in per cent (null without references), and by strategy."""
    n, yes = F.count("*"), F.count("table")
    by = [F.count(F.when(F.col("strategy") == s, 1)).alias(f"by_{s}") for s in ("alias", "cte", "scope", "schema", "workspace", "system", "pseudo", "output")]
    return resolved.groupBy("script").agg(n.alias("total"), yes.alias("resolved"), F.round(100 * yes / n, 1).alias("coverage_pct"), *by)
