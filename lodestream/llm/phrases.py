"""Collocations: phrases counted depth-first over position bitmaps of shards, scored by their weakest cut."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import BROADCAST_IDS, Scratch, giving_back, ship
from lodestream.llm.lm import get, put

SHARD_TOKENS = 1 << 21  # words of a shard, or one longer document
LONGEST = 5
FLUSH_ROWS = 1 << 16
BLOCK_POSITIONS = 1 << 18  # set bits of first words whose ways are walked together
SIGNS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
GAP = b"\n"
WORDS_A_FILE = 1 << 19  # frequent words of a file that workers map
PAIRS_A_FILE = 1 << 22  # and frequent pairs
CELL_LOAD = 16  # occurrences of frequent pairs a cell of the sieve
CELL_BITS = 25  # of its number at most: a worker holds 128 MB of cells
BLOCK_CELLS = 1 << 16
CELLS_DDL = "block long, cells binary"
SHARD_DDL = "lang string, words array<string>, n array<long>, bitmaps binary"
KEYS = ["k1", "k2", "k3"]  # words one and two, three and four, five; 0 stands for no word
PATH = [f"w{k}" for k in range(1, LONGEST + 1)]
ROW_OF_MEGABYTES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
PAGE_OF_MEGABYTES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def compress(positions: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of several bitmaps, each from its start on, as the gaps between set bits in seven-bit groups; and where each one's bytes end."""
    gaps = np.diff(positions, prepend=0)
    gaps[starts] = positions[starts]
    size = 1 + sum((gaps >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = (gaps[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, ends[np.append(starts[1:], len(positions)) - 1] if len(starts) else starts


def expand(maps: list[bytes], sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the set bits of compressed bitmaps, one after the other, and the number of each (``sizes``, where the maps come as one)."""
    raw = np.frombuffer(b"".join(maps), np.uint8).astype(np.int64)
    if not len(raw):
        return raw, np.zeros(len(maps), np.int64)
    last = raw < 128
    begin = np.flatnonzero(np.append(True, last[:-1]))
    shift = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    gaps = np.add.reduceat((raw & 127) << 7 * shift, begin)
    if sizes is None:
        sizes = np.diff(np.append(0, np.cumsum(last))[np.append(0, np.cumsum([len(m) for m in maps]))])
    upto = np.cumsum(gaps)
    before = np.append(0, upto)[np.cumsum(sizes) - sizes]
    return upto - np.repeat(before, sizes), sizes


class _Codes(dict):
    """Numbers of words in the order they are met; 0 is the gap between pieces."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def bitmaps(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, n, bitmaps): a row a shard, each word's positions in it. A position stays empty between two pieces, so no shift leads from one into the next."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        open_langs: dict[str, tuple[_Codes, list[np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, parts) in open_langs.items():
                code = np.concatenate(parts)
                order = np.argsort(code, kind="stable")
                order = order[np.searchsorted(code[order], 1) :]
                if not len(order):
                    continue
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                n = np.diff(np.append(starts, len(order)))
                data, _ = compress(order.astype(np.int64), starts)
                words = pa.array([w.decode("utf-8", "replace") for w in [*codes][1:]], pa.string())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), x) for x in (words, pa.array(n))]
                yield pa.record_batch([pa.array([lang], pa.string()), *lists, pa.array([data.tobytes()], pa.binary())], names=_names(SHARD_DDL))

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if not text:
                    continue
                codes, parts = open_langs.setdefault(lang, (_Codes({GAP: 0}), []))
                words = text.encode("utf-8", "replace").lower().translate(SIGNS).replace(GAP, b" \n ").split(b" ")
                words.append(GAP)
                found = np.fromiter(map(codes.__getitem__, filter(None, words)), np.int32)
                parts.append(found)
                held += len(found)
                if held >= SHARD_TOKENS:
                    yield from flush()
                    open_langs, held = {}, 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), SHARD_DDL)


def _numbers(uri: str, ddl: str, store: Callable) -> Callable:
    """A function of Arrow batches that writes all rows of its task as one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, None) if (batches := [*batches]) else None
        if rows is not None and rows.num_rows:
            file = f"{uri}/{TaskContext.get().partitionId():06d}"
            put(file, *store(rows))
            yield pa.record_batch([pa.array([file])], names=_names(ddl))

    return run


def store_words(rows: pa.Table) -> list[np.ndarray]:
    """Hashes of words (gid, lang, word), ascending, with their gids and the words themselves."""
    keys = [w.encode() + b" " + lang.encode() for w, lang in zip(rows["word"].to_pylist(), rows["lang"].to_pylist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    order = np.argsort(hashes, kind="stable")
    keys = [keys[i] for i in order]
    offsets = np.append(0, np.cumsum([len(k) for k in keys]))
    return [hashes[order], rows["gid"].to_numpy()[order].astype(np.uint64), offsets.astype(np.uint64), np.frombuffer(b"".join(keys), np.uint8)]


def store_pairs(rows: pa.Table) -> list[np.ndarray]:
    return [np.sort(rows["k1"].to_numpy()).astype(np.uint64)]


def find_words(files: list[list[np.ndarray]], lang: str, words: pa.Array) -> np.ndarray:
    """The gids of words of a language by the files that hold the frequent ones; 0 for the others. A hash finds a word, its bytes confirm it."""
    tail = b" " + lang.encode()
    keys = [w + tail for w in words.cast(pa.binary()).to_pylist()]
    hashes, texts = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), pa.array(keys, pa.large_binary())
    out = np.zeros(len(keys), np.int64)
    for known, gids, offsets, text in files:
        held = pa.Array.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        at = np.searchsorted(known, hashes)
        like = lambda some: some[(at[some] < len(known)) & (known[np.minimum(at[some], len(known) - 1)] == hashes[some])]  # noqa: B023, E731
        left = like(np.arange(len(keys)))
        while len(left):  # words of one hash stand one after the other
            same = pc.equal(held.take(pa.array(at[left])), texts.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[same]] = gids[at[left[same]]]
            at[left[~same]] += 1
            left = like(left[~same])
    return out


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two gids, of 31 bits each, as one number."""
    return first << 32 | second


class Shard:
    """The bitmaps of a shard's words of one language (gids, all set bits, the number of each).

    No two words share a position, so ``at``, which holds at each position the word whose bit is set there, stands for all bitmaps at once: reading it at a
    phrase's positions shifted by one is the AND with every word's bitmap, and counting equal values gives the popcounts.
    """

    def __init__(self, gids: np.ndarray, positions: np.ndarray, sizes: np.ndarray):
        self.gids, self.positions, self.sizes = gids, positions, sizes
        self.at = np.full(int(self.positions.max(initial=-1)) + 2, -1, np.int64)
        self.at[self.positions] = np.repeat(np.arange(len(gids)), self.sizes)

    def links(self, files: list[np.ndarray]) -> np.ndarray:
        """At each position whether its word and the next are one of the pairs of gids that the files hold."""
        out = np.zeros(len(self.at), bool)
        here = np.flatnonzero((self.at[:-1] >= 0) & (self.at[1:] >= 0))
        key = paired(self.gids[self.at[here]], self.gids[self.at[here + 1]])
        own = np.unique(key)
        linked = np.zeros(len(own), bool)
        for known in files:
            at = np.minimum(np.searchsorted(known, own.astype(known.dtype)), len(known) - 1)
            linked |= known[at] == own.astype(known.dtype)
        own = own[linked]
        if len(own):
            out[here] = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
        return out

    def phrases(self, shortest: int, longest: int, linked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(paths, popcounts) of phrases of ``shortest`` to ``longest`` words; where ``linked`` is given, by linked steps alone.

        Depth-first: a block of first words goes down to the longest phrases before the next one begins, so the bitmaps of one block's ways are held at a time.
        A step is that of all its phrases at once: shift by one, AND with all words, popcounts of what is equal.
        """
        n, ends = len(self.gids), np.cumsum(self.sizes)
        begin = 0
        while begin < n:
            done = ends[begin] - self.sizes[begin]
            stop = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_POSITIONS, "right")))
            here = self.positions[done : ends[stop - 1]]
            paths, way = np.arange(begin, stop)[:, None], np.repeat(np.arange(stop - begin), self.sizes[begin:stop])
            begin = stop
            for size in range(2, longest + 1):
                if linked is not None:
                    way, here = way[linked[here]], here[linked[here]]
                here = here + 1
                word = self.at[here]
                key, here = (way * n + word)[word >= 0], here[word >= 0]
                if not len(here):
                    break
                order = np.argsort(key, kind="stable")
                key, here = key[order], here[order]
                cuts = np.flatnonzero(np.diff(key, prepend=-1))
                counts = np.diff(np.append(cuts, len(key)))
                paths = np.column_stack([paths[key[cuts] // n], key[cuts] % n])
                if size >= shortest:
                    yield paths, counts
                way = np.repeat(np.arange(len(cuts)), counts)


def cell(keys: list[np.ndarray], bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits that phrases hash to."""
    out = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        out = (out ^ out >> np.uint64(29) ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def _walked(batches: Iterator[pa.RecordBatch], word_files: list[str], pair_files: list[str] | None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Keys and popcounts of all phrases of two frequent words; with files of pairs, of three to five words by these steps alone."""
    known = [get(f) for f in word_files]
    links = None if pair_files is None else [get(f)[0] for f in pair_files]
    for batch in batches:
        for lang, words, n, bitmaps in zip(*batch.columns, strict=True):
            gids = find_words(known, lang.as_py(), words.values)
            positions, sizes = expand([bitmaps.as_py()], n.values.to_numpy())
            some = gids > 0
            shard = Shard(gids[some], positions[np.repeat(some, sizes)], sizes[some])
            for paths, counts in shard.phrases(2, 2) if links is None else shard.phrases(3, LONGEST, shard.links(links)):
                for a in range(0, len(counts), FLUSH_ROWS):
                    part = shard.gids[paths[a : a + FLUSH_ROWS]]
                    part = np.column_stack([part, np.zeros((len(part), 6 - part.shape[1]), np.int64)])
                    yield [paired(part[:, 0], part[:, 1]), paired(part[:, 2], part[:, 3]), part[:, 4]][: 1 if links is None else 3], counts[a : a + FLUSH_ROWS].copy()


def _pairs(shards: DataFrame, word_files: list[str]) -> DataFrame:
    """(k1, n): popcounts of all phrases of two frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _walked(batches, word_files, None):
            yield pa.record_batch([*map(pa.array, keys), pa.array(counts)], names=["k1", "n"])

    return shards.mapInArrow(giving_back(run), "k1 long, n long")


def _cells(shards: DataFrame, word_files: list[str], pair_files: list[str], bits: int, least: int) -> DataFrame:
    """(block, cells): occurrences of phrases of three to five words by the cells they hash to; of a task each, ``least`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for keys, counts in _walked(batches, word_files, pair_files):
            np.add.at(total, cell(keys, bits), counts.astype(np.uint32))
        np.minimum(total, least, out=total)
        for k in range(0, len(total), BLOCK_CELLS):
            part = total[k : k + BLOCK_CELLS]
            if part.any():
                yield pa.record_batch([pa.array([k // BLOCK_CELLS]), pa.array([zlib.compress(part.astype("<u1" if least < 256 else "<u4").tobytes(), 1)], pa.binary())], names=_names(CELLS_DDL))

    return shards.mapInArrow(giving_back(run), CELLS_DDL)


def _sieve(cells: DataFrame, least: int, folder: str) -> list[str]:
    """Files of the cells of ``least`` occurrences and more over all tasks, a bit each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[int] = []
        bits, total = [], None
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(part.as_py()), "<u1" if least < 256 else "<u4").astype(np.int64)
                if blocks and blocks[-1] == block:
                    total += part
                    continue
                if blocks:
                    bits.append(np.packbits(total >= least))
                blocks.append(block)
                total = part
        if blocks:
            bits.append(np.packbits(total >= least))
            file = f"{folder}/{TaskContext.get().partitionId():06d}"
            put(file, np.array(blocks, np.uint64), np.concatenate(bits))
            yield pa.record_batch([pa.array([file])], names=["file"])

    return sorted(r.file for r in cells.repartition("block").sortWithinPartitions("block").mapInArrow(giving_back(run), "file string").collect())


def _longer(shards: DataFrame, word_files: list[str], pair_files: list[str], bits: int, sieve_files: list[str]) -> DataFrame:
    """(k1, k2, k3, n): popcounts of the phrases of three to five words by frequent pairs whose cells are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(1 << bits, BLOCK_CELLS) // 8
        passed = np.zeros(((1 << bits) // 8 // size, size), np.uint8)
        for blocks, part in map(get, sieve_files):
            passed[blocks.astype(np.int64)] = part.reshape(-1, size)
        passed = passed.ravel()
        for keys, counts in _walked(batches, word_files, pair_files):
            at = cell(keys, bits)
            some = np.flatnonzero(passed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if len(some):
                yield pa.record_batch([*(pa.array(k[some]) for k in keys), pa.array(counts[some])], names=[*KEYS, "n"])

    return shards.mapInArrow(giving_back(run), ", ".join(f"{k} long" for k in [*KEYS, "n"]))


@contextlib.contextmanager
def _rows_of_megabytes(spark: SparkSession) -> Iterator[None]:
    """Tables are read a row at a time within: a shard is a row of megabytes."""
    before = {k: spark.conf.get(k) for k in ROW_OF_MEGABYTES}
    for k, v in ROW_OF_MEGABYTES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files(table: DataFrame, key: str, each: int, folder: str, store: Callable) -> list[str]:
    """A written table's rows as files that workers map, some ``each`` rows in one; which row lies in which file depends on its key alone."""
    parts = 1 + table.count() // each
    return sorted(r.file for r in table.repartition(parts, key).mapInArrow(giving_back(_numbers(folder, "file string", store)), "file string").collect())


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def count_phrases(docs: DataFrame, least: int, scratch: Scratch, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): n of all words per lang; words (lang, word, gid, n) and phrases (lang, w1 to w5, n) of one to five words, of ``least`` occurrences and more.

    One pass over the texts writes the bitmaps, a shard and language as one row, which stays where it is written. What must be known of the whole corpus is written as
    sorted files that workers map: the frequent words, by which a first walk over the shards counts pairs, and the frequent pairs, by which a second one goes down to five
    words: every part of a frequent phrase is frequent. That one is taken twice: first all phrases of a cell of a hash are counted together, then those alone are counted
    apart whose cell has ``least`` occurrences; a frequent phrase's cell has. So counts alone are shuffled, each word, pair and phrase at most once a shard.
    """
    spark = docs.sparkSession
    shards = scratch.keep(bitmaps(docs, lang_col, text_col), "shards", **PAGE_OF_MEGABYTES)
    with _rows_of_megabytes(spark):
        counts = scratch.keep(shards.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), "n"))).groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    totals = scratch.keep(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = scratch.keep(counts.filter(F.col("n") >= least).withColumn("at", F.monotonically_increasing_id()), "words")
    scratch.drop(counts)
    # gids go round the tasks that wrote the words, so they have few bits
    task, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    most = words.agg(F.coalesce(F.max(task) + 1, F.lit(0)).alias("tasks"), F.coalesce(F.max(row) + 1, F.lit(0)).alias("rows")).first()
    if most.tasks * most.rows >= 1 << 31:
        raise ValueError("more than 2^31 numbers of frequent words")
    words = words.select("lang", "word", (row * most.tasks + task + 1).alias("gid"), "n")
    folder = scratch.folder("known")
    word_files = _files(words, "gid", WORDS_A_FILE, f"{folder}/words", store_words)
    with _rows_of_megabytes(spark):
        common = scratch.keep(_pairs(shards, word_files).groupBy("k1").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent-pairs")
    steps = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(CELL_BITS, max(10, (steps // CELL_LOAD).bit_length()))
    pair_files = _files(common, "k1", PAIRS_A_FILE, f"{folder}/pairs", store_pairs)
    with _rows_of_megabytes(spark):
        cells = scratch.keep(_cells(shards, word_files, pair_files, bits, least), "cells")
        sieve_files = _sieve(cells, least, f"{folder}/sieve")
        longer = scratch.keep(_longer(shards, word_files, pair_files, bits, sieve_files).groupBy(*KEYS).agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "longer")
    for used in (shards, cells, folder):
        scratch.drop(used)
    none = F.lit(0).cast("long")
    short = words.select("lang", F.col("gid").alias("w1"), *(none.alias(w) for w in PATH[1:]), "n")
    several = common.select("k1", none.alias("k2"), none.alias("k3"), "n").unionByName(longer)
    halves = [half for k in KEYS[:2] for half in (F.shiftright(k, 32), F.col(k).bitwiseAND((1 << 32) - 1))]
    several = several.select(*(x.alias(w) for x, w in zip([*halves, F.col("k3")], PATH, strict=True)), "n")
    several = several.join(_small(words.select("lang", F.col("gid").alias("w1"))), "w1")
    return totals, words, short.unionByName(several)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each lang's ``top`` phrases of two to five words by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Scores are exact: products are decimals of up to 38 digits (counts of up to 16 and 18; beyond them is an error). Null texts have no words, null lang is ``und``, texts of any length are read whole, repeated rows count
    as often as they are there, ties end in the phrase's bytes, an empty table gives no rows; other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    totals, words, phrases = count_phrases(docs, least, scratch, lang_col, text_col)
    phrases = scratch.keep(phrases, "phrases")
    many = phrases.filter("w2 <> 0").withColumn("size", sum((F.col(w) != 0).cast("int") for w in PATH))
    # a phrase goes if a longer one by one word at either end occurs as often: any still longer one has such a part
    zero = F.lit(0).cast("long")
    ends = many.filter("size > 2")
    heads = ends.select("lang", *(F.when(F.col("size") > k + 1, F.col(w)).otherwise(zero).alias(w) for k, w in enumerate(PATH)), F.col("n").alias("more"))
    tails = ends.select("lang", *(F.col(w).alias(PATH[k]) for k, w in enumerate(PATH[1:])), zero.alias(PATH[-1]), F.col("n").alias("more"))
    within = heads.unionByName(tails).groupBy("lang", *PATH).agg(F.max("more").alias("more"))
    kept = scratch.keep(many.join(within, ["lang", *PATH], "left").filter(F.coalesce(F.col("more") * 100 < F.col("n") * 100, F.lit(True))).drop("more"), "kept")
    # each cut with the counts of its parts
    cut = kept.select("lang", *PATH, "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    path = F.array(*PATH)
    part = lambda k, after: F.coalesce(F.get(path, F.lit(k) + F.col("cut")), zero) if after else F.when(F.col("cut") > k, F.col(PATH[k])).otherwise(zero)
    cut = cut.select("*", *(part(k, False).alias(f"l{k}") for k in range(LONGEST)), *(part(k, True).alias(f"r{k}") for k in range(LONGEST)))
    table = _small(phrases)
    for side, name in (("l", "l"), ("r", "r")):
        known = table.select(F.col("lang"), *(F.col(w).alias(f"{side}{k}") for k, w in enumerate(PATH)), F.col("n").alias(name))
        cut = cut.join(known, ["lang", *(f"{side}{k}" for k in range(LONGEST))]).drop(*(f"{side}{k}" for k in range(LONGEST)))
    cut = cut.join(F.broadcast(totals), "lang") if totals.count() <= BROADCAST_IDS else cut.join(totals, "lang")
    cut = cut.withColumn("score", F.expr("CAST(n AS DECIMAL(16,0)) * CAST(1000 AS DECIMAL(4,0)) * CAST(total AS DECIMAL(16,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
    worst = cut.groupBy("lang", *PATH).agg(F.min(F.struct("score", "cut", "l", "r", F.col("n").alias("a"), F.col("total").alias("n"))).alias("x")).select("lang", *PATH, "x.*")
    worst = scratch.keep(worst, "scored").withColumn("phrase_id", F.monotonically_increasing_id())
    worst = scratch.keep(worst, "numbered")
    each = worst.select("phrase_id", F.posexplode(path).alias("k", "gid")).filter("gid <> 0")
    named = each.join(_small(words.select("gid", "word")), "gid").groupBy("phrase_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    out = worst.join(named, "phrase_id").withColumn("rank", best).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
