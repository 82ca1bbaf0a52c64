"""Best-fit packing of documents into sequences, repacked where a lower bound does not certify the bin count."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, giving_back
from lodestream.llm.tokens import default_tokenizer, encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CACHED_WORDS = 300_000  # words whose ids a worker remembers, in each of two generations
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The fewest bins of ``capacity`` that the lengths can need, by two families of dual-feasible functions.

    First family, for each t up to half of the capacity: lengths over capacity - t count as whole bins,
    lengths below t as nothing, others as themselves (t = 0 is the plain sum). Second family, for
    k = 1..30: floor((k + 1) x) / k of the fraction x, and x itself where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    n_up, s_up = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    t = np.arange(capacity // 2 + 1)
    over = np.append(n_up, 0)[capacity - t + 1]
    between = s_up[t] - np.append(s_up, 0)[capacity - t + 1]
    best = int((over + -(-between // capacity)).max())
    some = np.flatnonzero(count)
    for k in range(1, 31):
        scaled = (k + 1) * some
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(whole, k * some, capacity * (scaled // capacity))
        best = max(best, int(-(-int((value * count[some]).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in descending order: the bin of each, and the room left in each bin.

    Bins wait in stacks by the room left; a bit mask of the rooms in use gives the tightest fit.
    """
    waiting: dict[int, list[int]] = {}
    mask, bins, room = 0, np.empty(len(lengths), np.int64), []
    for i, length in enumerate(lengths.tolist()):
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            stack = waiting[left]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << left)
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = left = left - length
        if left:
            waiting.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins, np.array(room, np.int64)


def cut_pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode whole texts; documents over ``capacity`` are cut into pieces of it, others are one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end, step = encoder(tokenizer, CACHED_WORDS), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = codes.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(code), step)):
                    part = code[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(cut), PIECES_DDL)


def _filler(capacity: int, base: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one group; sequence ids count up from ``base``, the group's number and the bin's."""

    def fill(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, room = best_fit_decreasing(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        by, ends = bins[order], np.cumsum(lengths[order])
        starts, first = ends - lengths[order], np.r_[True, by[1:] != by[:-1]]
        offset = np.empty(len(lengths), np.int64)
        offset[order] = starts - starts[first][np.cumsum(first) - 1]
        done = np.ones(len(room), bool)
        if not final:
            gap = len(room) - lower_bound(lengths, capacity)
            emptiest = np.argsort(-room, kind="stable")[: max(1, 2 * gap + len(room) // 16 * (gap > 0))]
            done[emptiest[room[emptiest] > capacity // 64]] = False
        sequence = base + (rows["grp"][0].as_py() << 24) + bins
        columns = [*(rows[n] for n in PIECES.names), pa.array(sequence), pa.array(offset), pa.array(done[bins])]
        return pa.table(columns, names=[*PIECES.names, "sequence_id", "offset", "settled"])

    return fill


def pack(
    docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, bins_in_group: int = 512
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as it can.

    Each round deals the open pieces into groups of about ``bins_in_group`` bins by a hash of the piece and its row number, so equal rows spread too, packs each
    group by best-fit decreasing and bounds its bin count from below by dual-feasible functions. Full
    bins and, where the bound certifies the count, all bins but the emptiest are settled. A group with
    a gap gives up its emptiest bins, twice the gap at least; a certified one its emptiest bin if that
    is not nearly full. What was given up meets that of other groups in the next round, until a single
    group holds all of it; should a round give up as much as the one before, its packing stands. A group's size is bounded, so is a task's memory.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in a sequence).
    A null or empty text makes one piece of the end id alone; repeated rows are packed each, ties go by
    id, piece and checksum; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    scratch = Scratch(spark, "packing")
    todo, settled, number, before = scratch.keep(cut_pieces(docs, capacity, id_col, text_col, tokenizer, end_id), "pieces"), [], 0, None
    out = f"{PIECES_DDL}, sequence_id long, offset long, settled boolean"
    while True:
        tokens = todo.agg(F.sum("length")).first()[0] or 0
        groups = max(1, -(-tokens // (capacity * bins_in_group)))
        final = groups == 1 or before is not None and groups >= before
        base, before = number << 56, groups

        # the row number spreads equal rows; ``todo`` is a written table, so a task run again numbers its rows alike
        grp = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)).cast("long")
        packed = scratch.keep(todo.select(*PIECES.names, grp.alias("grp")).groupBy("grp").applyInArrow(_filler(capacity, base, final), out), "packed")
        settled.append(packed.filter("settled").drop("settled"))
        scratch.drop(todo) if not number else None
        if final:
            break
        todo, number = packed.filter("not settled").select(*PIECES.names), number + 1
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result
