"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


BROADCAST_IDS = 1_000_000  # rows of two numbers (16 MB) up to which a side is broadcast; beyond it the join is shuffled
HUB_ROWS = 256  # pairs of one row that one task joins with it
BATCH_ROWS = 1000  # rows of an Arrow batch: whole texts are long, and each batch is held in the JVM and in Python


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session (they need not have it installed) and bound its Arrow batches."""
    context = spark.sparkContext
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    if getattr(context, "_lodestream_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="lodestream-package-")) / "lodestream.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._lodestream_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset on a single machine (tests)
    a temporary folder is made once and set for the session; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run within delete their shuffle files when they end: what they gave is written, so no later job reads these files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder to cut lineage: any executor can be lost and they stay readable."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.kept = 0, {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def folder(self, name: str) -> str:
        """A folder for files that tasks write."""
        path = self.path(name)
        self.kept[path] = True
        return path

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """The table, written and read back; the shuffles that made it go."""
        path = self.path(name)
        with releasing_shuffles(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept[path] = True
        return out

    def drop(self, kept: DataFrame | str) -> None:
        """Delete a kept table or a folder that no later plan reads."""
        self._delete(kept if isinstance(kept, str) else kept._scratch_path)

    def release(self, *still: DataFrame) -> None:
        """Delete all kept tables but those that a later plan reads."""
        for path in [*self.kept]:
            if path not in {df._scratch_path for df in still}:
                self._delete(path)

    def _delete(self, where: str) -> None:
        if self.kept.pop(where, False):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def on_hubs(pairs: DataFrame, side: DataFrame, scratch: Scratch) -> DataFrame:
    """Kept ``pairs`` (a, b, ...) joined with ``side`` on a; the pairs of an a that has many are dealt over several tasks, each with a copy of its row."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_ROWS)).cast("int").alias("parts")).filter("parts > 1")
    many = scratch.keep(many.coalesce(1 + pairs.count() // (64 * HUB_ROWS)), "hubs")
    n = many.count()
    if not n:
        return pairs.join(side, "a")
    many = F.broadcast(many) if n <= BROADCAST_IDS else many
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(many, "a", "left").withColumn("part", part).drop("parts")
    copies = side.join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, ["a", "part"]).drop("part")


def giving_back(run: Callable) -> Callable:
    """A function of Arrow batches that hands the memory it no longer needs back to the system when it ends: workers live on between tasks, and what they hold counts."""

    def all_of(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return all_of


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; UTF-8 bytes.

    ``bytes.lower`` and ``bytes.split`` touch ASCII alone, which is that definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_of_id(value) -> int:
    """crc32 of the id as text; of an absent id, of the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode())
