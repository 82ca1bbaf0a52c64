"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a session on a single machine has none (tests), a temporary folder that is then set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_table(spark: SparkSession, df: DataFrame, mode: str = "error", path: str | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Write rows (``by``: partition columns; overwriting replaces only the partitions present) and read the table."""
    path = path or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    # a partitioned table without rows has no file that tells its columns
    return (spark.read.schema(df.schema) if by else spark.read).parquet(path), path
