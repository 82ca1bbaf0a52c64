"""Scripts parsed on the executors into relations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.lineage.parser import file_class, parse_script
from lodestream.sources.package import ship

VARIABLE = "struct<id:string,name:string,variable_type:string,sql_expression:string,source_columns:array<string>,source_tables:array<string>,alias_of:string,defined_in:string,line_start:int,line_end:int,context:string,statement:int,is_output:boolean,ord:int>"
PARSED = (
    f"struct<variables:array<{VARIABLE}>,scopes:array<struct<context:string,alias:string,table:string,kind:string,line:int>>,"
    "refs:array<struct<id:string,qualifier:string,column:string,context:string,clause:string,line:int>>,evidence:array<struct<table:string,column:string,line:int,source:string>>,"
    "errors:array<struct<statement:int,detail:string>>,statements:array<struct<statement:int,kind:string,target:string,line_start:int,line_end:int>>>"
)


@dataclass
class Analysis:
    """Relations of a set of scripts, each with the column ``script``."""

    parsed: DataFrame

    def relation(self, name: str) -> DataFrame:
        return self.parsed.select("script", F.explode(name).alias("r")).select("script", "r.*")

    @property
    def variables(self) -> DataFrame:
        return self.relation("variables")

    @property
    def scopes(self) -> DataFrame:
        return self.relation("scopes")

    @property
    def refs(self) -> DataFrame:
        return self.relation("refs")

    @property
    def evidence(self) -> DataFrame:
        return self.relation("evidence")

    @property
    def errors(self) -> DataFrame:
        return self.relation("errors")

    @property
    def statements(self) -> DataFrame:
        return self.relation("statements")

    @property
    def files(self) -> DataFrame:
        return self.parsed.select("script", "file_class")


def analyze(scripts: DataFrame) -> Analysis:
    """Parse each script once (script, sql_text); scripts are independent, so any number of executors share the work."""
    ship(scripts.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [json.dumps(parse_script(n or "", t or "").as_dict()) for n, t in zip(names, texts, strict=True)]
            kinds = [file_class(n or "", t or "") for n, t in zip(names, texts, strict=True)]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["script", "file_class", "j"])

    rows = scripts.select("script", "sql_text").mapInArrow(parse, "script string, file_class string, j string")
    # a column for each relation: what reads one does not unpack the others
    parsed = rows.select("script", "file_class", F.from_json("j", PARSED).alias("parsed")).select("script", "file_class", "parsed.*")
    return Analysis(parsed.persist())
