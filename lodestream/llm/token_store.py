"""Token ids in ORC: integer run-length encoded stripes with row indexes and Bloom filters on the id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, releasing_shuffles, ship
from lodestream.llm.tokens import default_tokenizer, encoder

FLUSH_TOKENS = 1 << 20

STORED = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("segment_start", pa.int64()), ("ids", pa.list_(pa.int32()))])
READ = pa.schema([("doc_id", pa.int64()), ("segment", pa.int32()), ("segment_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, stripe_bytes: int = 64 << 20, index_rows: int = 1000
) -> None:
    """Encode each whole text, append ``end_id`` and write the ids as ORC in ascending order of the id.

    The id ranges of the files follow each other (``segment`` numbers them) and rows are sorted within
    a file, so readers prune files, stripes and row groups by the id from metadata and its Bloom filter
    and read stripes in parallel. A null text counts as empty (just the end id), null ids come first,
    repeated rows stay, ties of the id are ordered by a hash of the text, an empty table makes an empty
    folder of ORC with the schema. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end, start = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        segment = TaskContext.get().partitionId()

        def out(ids: list, starts: list, parts: list[bytes]) -> pa.RecordBatch:
            values = np.frombuffer(b"".join(parts), "<i4")
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array([segment] * len(ids), pa.int32()), pa.array(starts, pa.int64()), lists], schema=STORED)

        ids, starts, parts, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = codes.encode(text.as_py()) + end
                ids.append(doc_id)
                starts.append(start)
                parts.append(code)
                start += len(code) // 4
                held += len(code) // 4
                if held >= FLUSH_TOKENS:
                    yield out(ids, starts, parts)
                    ids, starts, parts, held = [], [], [], 0
        if ids:
            yield out(ids, starts, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ranges may cut within an id, and within equal rows by the row number
    rows = rows.withColumns({"__text": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "__text", "__row").sortWithinPartitions("doc_id", "__text").select("doc_id", "text")
    encoded = rows.mapInArrow(encode, "doc_id long, segment int, segment_start long, ids array<int>")
    writer = encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
    with releasing_shuffles(docs.sparkSession):
        writer.option("orc.row.index.stride", str(index_rows)).option("orc.stripe.size", str(stripe_bytes)).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, segment, segment_start, ids); filters on doc_id are pushed to the ORC metadata."""
    return spark.read.schema("doc_id long, segment int, segment_start long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are a segment's first id (a running sum over one row a segment) plus the place within it.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], schema=READ)

    rows = read_tokens(spark, path).mapInArrow(digest, "doc_id long, segment int, segment_start long, n_tokens long, ids_crc32 long")
    rows = Scratch(spark, "token-index").keep(rows, "digests")
    sizes = rows.groupBy("segment").agg(F.max(F.col("segment_start") + F.col("n_tokens")).alias("size"))
    before = F.sum("size").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("segment", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(bases, "segment").select("doc_id", (F.col("base") + F.col("segment_start")).alias("start"), "n_tokens", "ids_crc32")
