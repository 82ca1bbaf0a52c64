"""LIKE, ILIKE and RLIKE over many texts through an index of three-letter pieces: candidates by their rarest pieces, then the pattern itself."""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.relational import broadcast_if_small
from lodestream.sources.writers import scratch_table, shared_dir

N = 3
RAREST = 4  # pieces of a pattern whose postings are intersected
SMALL_CANDIDATES = 1_000_000  # (pattern, row) pairs that are broadcast to the texts; beyond it both are shuffled

# the letters whose lower case is, or begins with, an ASCII letter
KELVIN, DOTTED_I = "\u212a", "\u0130"


def _fold_text(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text).replace(KELVIN, "k").replace(DOTTED_I, "i\u0307")


def _fold(text: Column) -> Column:
    """Letter by letter, so that what a text holds its folded form holds folded."""
    return F.replace(F.translate(text, string.ascii_uppercase + KELVIN, string.ascii_lowercase + "k"), F.lit(DOTTED_I), F.lit("i\u0307"))


def _grams(rows: DataFrame) -> DataFrame:
    """(__row, grams): distinct pieces of three code points; the letters are a column of their own, so that they are cut once."""
    letters = rows.select("__row", F.split(_fold(F.col("__text")), "").alias("__l"))
    piece = F.transform(F.sequence(F.lit(0), F.size("__l") - N), lambda i: F.concat(*(F.get("__l", i + j) for j in range(N))))
    return letters.filter(F.size("__l") >= N).select("__row", F.array_distinct(piece).alias("grams"))


def literals(kind: str, pattern: str) -> list[str]:
    """Folded runs that every match must hold; none where that is not plain, and then all texts are looked at.

    LIKE: what stands between wildcards (a backslash takes the next letter as it is). ILIKE: the ASCII parts of that. RLIKE: runs of letters, digits and spaces outside of brackets, without one that a quantifier makes optional; expressions with alternatives,
    groups or an escape by number have none.
    """
    if kind == "rlike":
        if re.search(r"[|()]|\\[^dDsSwWbB.\-+*?\[\]{}^$/\\]", pattern):
            return []
        plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "\n", pattern)
        plain = re.sub(r"(?s).(?:[?*]|\{[^}]*\})[+?]?", "\n", plain)
        return [_fold_text(r) for r in re.findall(r"[^\n.^$+?*{}\[\]]+", plain)]
    runs, run = [], ""
    for m in re.finditer(r"(?s)\\(.)|([%_])|(.)", pattern):
        if m[2]:
            runs.append(run)
            run = ""
        else:
            run += m[1] or m[3]
    runs.append(run)
    if kind == "ilike":
        runs = [part for r in runs for part in re.split("[^\x00-\x7f]+", r.lower())]
    return [_fold_text(r) for r in runs if r]


def matches(text: Column, kind: str, pattern: str) -> Column:
    return {"like": text.like, "ilike": text.ilike, "rlike": text.rlike}[kind](pattern)


class TextIndex:
    """Stored rows and postings (gram, row) sorted by gram, so that a search reads the row groups of its few pieces alone; frequent pieces spread over many files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows, self.postings, self.counts = (spark.read.parquet(f"{path}/{t}") for t in ("rows", "postings", "counts"))

    @classmethod
    def build(cls, df: DataFrame, text: str, path: str | None = None) -> TextIndex:
        """Index every row by its whole text. Rows get a number of their own, so ids may repeat or be null; a null text matches nothing and is not stored."""
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
        rows, _ = scratch_table(spark, df.filter(F.col(text).isNotNull()).withColumnRenamed(text, "__text").withColumn("__row", F.monotonically_increasing_id()), path=f"{path}/rows")
        grams, _ = scratch_table(spark, _grams(rows), path=f"{path}/grams")  # written, as cutting ranges reads them twice
        postings = grams.select(F.explode("grams").alias("gram"), "__row")
        postings, _ = scratch_table(spark, postings.repartitionByRange("gram", "__row").sortWithinPartitions("gram", "__row"), path=f"{path}/postings")
        scratch_table(spark, postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram"), path=f"{path}/counts")
        return cls(spark, path)

    def candidates(self, patterns: Mapping[str, tuple[str, str]]) -> DataFrame:
        """(pattern, __row): rows that hold the rarest pieces of each pattern; all rows for a pattern without pieces.

        ``patterns``: (kind, pattern) by name. Only the counts of the patterns' own pieces come to the driver.
        """
        pieces = {name: sorted({r[i : i + N] for r in literals(*p) for i in range(len(r) - N + 1)}) for name, p in patterns.items()}
        asked = sorted({g for gs in pieces.values() for g in gs})
        held = dict(self.counts.filter(F.col("gram").isin(asked)).collect()) if asked else {}
        chosen = [(name, g, min(len(gs), RAREST)) for name, gs in pieces.items() for g in sorted(gs, key=lambda g: (held.get(g, 0), g))[:RAREST]]
        wanted = self.spark.createDataFrame(chosen, "pattern string, gram string, __pieces int")
        read = self.postings.filter(F.col("gram").isin(sorted({g for _, g, _ in chosen}))) if chosen else self.postings.limit(0)
        found = read.join(F.broadcast(wanted), "gram").groupBy("pattern", "__row", "__pieces").agg(F.count("*").alias("__n")).filter("__n = __pieces").select("pattern", "__row")
        for name in (n for n, gs in pieces.items() if not gs):
            found = found.unionByName(self.rows.select(F.lit(name).alias("pattern"), "__row"))
        return found

    def search(self, patterns: Mapping[str, tuple[str, str]]) -> DataFrame:
        """The stored columns, ``pattern`` and ``matched`` of each candidate: filter on ``matched`` for the answer, count the rest for what was looked at in vain."""
        found, _ = scratch_table(self.spark, self.candidates(patterns))
        text = F.col("__text")
        match = reduce(lambda rest, item: F.when(F.col("pattern") == item[0], matches(text, *item[1])).otherwise(rest), patterns.items(), F.lit(False))
        return self.rows.join(broadcast_if_small(found, SMALL_CANDIDATES), "__row").withColumn("matched", match).drop("__row", "__text")
