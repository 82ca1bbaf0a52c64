"""Results kept as Parquet under a hash of what they come from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from lodestream.sources.writers import shared_dir

if TYPE_CHECKING:
    from lodestream.lineage.analysis import Analysis

VERSION = "1"


def _signature(spark: SparkSession, paths: Sequence[str]) -> str:
    """Version, paths, and lengths and times of the files below them, by the file system that Spark reads them with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = [VERSION]
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            parts.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()


def cached(spark: SparkSession, name: str, paths: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make`` gives, written once for the state of the files at ``paths``; later calls read it."""
    path = f"{shared_dir(spark)}/cache/{name}-{_signature(spark, paths)[:24]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_analysis(spark: SparkSession, scripts: DataFrame, path: str) -> tuple[Analysis, int]:
    """The analysis of scripts, each parsed once for its name, text and the version of this code: those that the cache at ``path`` lacks are parsed and appended. Also gives how many these were.

    The key is md5 over version, name and text, so a changed script or a new version of the parser makes a row of its own and old rows are never read.
    """
    from pyspark.sql import functions as F

    from lodestream.lineage.analysis import Analysis, analyze

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    keyed = scripts.select("script", "sql_text", F.md5(F.concat_ws("|", F.lit(VERSION), "script", F.coalesce("sql_text", F.lit("")))).alias("key"))
    where = jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if where.getFileSystem(conf).exists(where) else None
    new = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    n = new.count()
    if n:
        analyze(new.select("script", "sql_text")).parsed.join(new.select("script", "key"), "script").write.mode("append").parquet(path)
    rows = spark.read.parquet(path).join(keyed.select("key"), "key", "left_semi").dropDuplicates(["key"]).drop("key")
    return Analysis(rows), n
