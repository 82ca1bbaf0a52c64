"""Structured Streaming over event tables: windows, sessions, deduplication, per-key state (extensions)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestream.sources.writers import shared_dir


def event_stream(spark: SparkSession, folder: str, schema, time: str = "ts", late: str = "1 hour", files_per_batch: int = 10) -> DataFrame:
    """Parquet files of a folder as a stream with a watermark on the event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, width: str, time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, time: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drop_repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote, with its checkpoint in the shared folder."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/out")
