"""Interpolated modified Kneser-Ney model of order two or three in memory-mapped sorted hash arrays."""

from __future__ import annotations

import mmap
import resource
import sys
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, crc_of_id, releasing_shuffles, words

END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word holds a space
MIX = 0x9E3779B97F4A7C15
FLUSH = 1 << 21  # tokens counted together in a worker
SCORED = 1 << 20  # tokens scored together
BUCKET_CHARS = 1 << 22  # characters of the corpus a bucket
REMOTE_BYTES = 256 << 20  # bytes of model files that a worker holds where the shared folder cannot be mapped
MAPPED = 24_576  # files that a worker keeps mapped: the kernel allows a process 65,530 maps
KEEPS_NO_FILE = {"trackfd": False} if sys.version_info >= (3, 13) else {}  # a map then holds no file open
BLOCK_DDL = "bucket int, block binary"
SIZES_DDL = "bucket int, n0 long, n1 long, tokens long, c1 long, c2 long, c3 long, c4 long"
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

# --- files of the shared folder -------------------------------------------------------------------


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, *arrays: np.ndarray) -> None:
    """Write a file of arrays whole: under another name first, so a task that is lost leaves no part of it, and one that is repeated finds it done."""
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{np.random.default_rng().integers(1 << 60):x}"
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], "<i8")
    with system.open_output_stream(part) as out:
        out.write(head.tobytes())
        for a in arrays:
            out.write(a.astype(f"<u{a.dtype.itemsize}", copy=False).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    try:
        system.move(part, path)
    except OSError:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(part)


_remote: OrderedDict[str, bytes] = OrderedDict()


def get(uri: str) -> list[np.ndarray]:
    """The arrays of a file (none of an absent one): mapped into memory, or, where the folder is remote, from a bounded number of bytes held."""
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        try:
            with open(path, "rb") as file:
                buffer = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **KEEPS_NO_FILE)
        except FileNotFoundError:
            return []
    else:
        if uri not in _remote:
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return []
            with system.open_input_stream(path) as file:
                _remote[uri] = file.read()
            while len(_remote) > 1 and sum(map(len, _remote.values())) > REMOTE_BYTES:
                _remote.popitem(last=False)
        _remote.move_to_end(uri)
        buffer = _remote[uri]
    n = int(np.frombuffer(buffer, "<i8", 1)[0])
    shapes = np.frombuffer(buffer, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, length in shapes.tolist():
        out.append(np.frombuffer(buffer, f"<u{size}", length, at))
        at += size * length + -(size * length) % 8
    return out


def most_mapped() -> int:
    """How many files a worker keeps mapped; where each map holds its file open, half of those that it may open at most."""
    return MAPPED if KEEPS_NO_FILE else max(1, min(MAPPED, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2))


def small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and the places and values of those that a byte does not hold."""
    over = np.flatnonzero(n >= 255)
    return np.minimum(n, 255).astype(np.uint8), np.r_[over, n[over]].astype(np.uint64)


def stored(keys: np.ndarray, n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of keys and their counts in its order."""
    table, order = table_of(keys, span)
    return table, *small(n[order])


class Counts:
    """Counts written by ``small``."""

    def __init__(self, low: np.ndarray, over: np.ndarray):
        self.low, self.at, self.n = low, over[: len(over) // 2], over[len(over) // 2 :]

    def of(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.n[np.searchsorted(self.at, at[big].astype(np.uint64))]
        return out

    def all(self) -> np.ndarray:
        out = self.low.astype(np.int64)
        out[self.at.astype(np.int64)] = self.n
        return out


def head_bits(span: int) -> int:
    return max(span - 32, min(span, 14))


def mixed(keys: np.ndarray, span: int) -> np.ndarray:
    """A one-to-one hash of numbers of ``span`` bits, whose first bits depend on all."""
    return keys * np.uint64(MIX) & np.uint64((1 << span) - 1)


def unmixed(keys: np.ndarray, span: int) -> np.ndarray:
    return keys * np.uint64(pow(MIX, -1, 1 << 64)) & np.uint64((1 << span) - 1)


def table_of(keys: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below 2**span, in the order of their hashes, as one array: where each value of the first bits starts, then the last bits of each hash. And that order."""
    hashed, low = mixed(keys, span), span - head_bits(span)
    order = np.argsort(hashed)
    hashed = hashed[order]
    starts = np.searchsorted(hashed, np.arange((1 << head_bits(span)) + 1, dtype=np.uint64) << np.uint64(low))
    return np.r_[starts.astype(np.uint32), (hashed & np.uint64((1 << low) - 1)).astype(np.uint32)], order


class Table:
    """Keys written by ``table_of``; as their hashes are even, few lie between two starts."""

    def __init__(self, array: np.ndarray, span: int):
        n = (1 << head_bits(span)) + 1
        self.span, self.bits, self.index, self.low = span, np.uint64(span - head_bits(span)), array[:n], array[n:]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there; by bisection between the starts of its first bits."""
        keys = mixed(keys, self.span)
        slot = (keys >> self.bits).astype(np.int64)
        want = (keys & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.uint32)
        at, end = self.index[slot].astype(np.int64), self.index[slot + 1].astype(np.int64)
        if not len(self.low):
            return at, np.zeros(len(keys), bool)
        last, length = len(self.low) - 1, end - at
        # as many halvings as the longest stretch takes
        for _ in range(int(length.max(initial=0)).bit_length()):
            half = length >> 1
            less = (self.low[np.minimum(at + half, last)] < want) & (length > 0)
            at += np.where(less, half + 1, 0)
            length = np.where(less, length - half - 1, half)
        return at, (at < end) & (self.low[np.minimum(at, last)] == want)

    def keys(self, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            slot, low = np.repeat(np.arange(len(self.index) - 1, dtype=np.uint64), np.diff(self.index.astype(np.int64))), self.low
        else:
            slot, low = (np.searchsorted(self.index, at, "right") - 1).astype(np.uint64), self.low[at]
        return unmixed(slot << self.bits | low.astype(np.uint64), self.span)


# --- blocks of the shuffle ------------------------------------------------------------------------


def counted(a: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each is there (summing ``n``)."""
    if n is None:
        return np.unique(a, return_counts=True)
    order = np.argsort(a, kind="stable")
    a, n = a[order], n[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return a[first], np.add.reduceat(n, first) if len(a) else n


def cut(a: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of the sorted array for each bucket that has some, by the buckets' first values."""
    ends = np.r_[np.searchsorted(a, edges), len(a)]
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), slice(ends[k], ends[k + 1])


def pack(kind: int, keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """A block of sorted keys with counts: last halves of the keys as they are, steps of their first halves and counts deflated."""
    high = np.diff(keys >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32)
    parts = [(keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), *(zlib.compress(x.tobytes(), 1) for x in (high, *(c.astype(np.uint64) for c in counts)))]
    return bytes([kind]) + np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack(block: bytes) -> list[np.ndarray]:
    n = int.from_bytes(block[1:5], "little")
    sizes = np.frombuffer(block, "<u4", n, 5).tolist()
    at, parts = 5 + 4 * n, []
    for size in sizes:
        parts.append(block[at : at + size])
        at += size
    high = np.cumsum(np.frombuffer(zlib.decompress(parts[1]), "<u4"), dtype=np.uint64)
    keys = np.frombuffer(parts[0], "<u4").astype(np.uint64) | high << np.uint64(32)
    return [keys, *(np.frombuffer(zlib.decompress(p), "<u8") for p in parts[2:])]


def blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block"])


def gathered(group: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """Keys of a group's blocks of one kind, added up."""
    parts = [unpack(b) for b in (x.as_py() for x in group["block"]) if b[0] == kind]
    if not parts:
        return [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * width]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return [keys[first], *(np.add.reduceat(np.concatenate([p[j] for p in parts])[order].astype(np.int64), first) if len(keys) else np.empty(0, np.int64) for j in range(1, width + 1))]


def sizes_row(k: int, n0: int, n1: int, tokens: int, counts: np.ndarray) -> pa.Table:
    c = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist() if len(counts) else [0] * 4
    return pa.table([pa.array([k], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (n0, n1, tokens, *c))], names=[f.split()[0] for f in SIZES_DDL.split(", ")])


def hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


# --- the model ------------------------------------------------------------------------------------


class Layout:
    """Where things lie: numbers of buckets and bits, and the sizes of all buckets, from files that are written as they get known.

    Words are numbered in order of their hashes, V stands for a text's start. A pair (v, w) lies in the bucket of its
    context v in the order of both, but where v has more than ``heavy`` tokens: then in a bucket by a one-to-one hash of
    the pair, so that no frequent word makes a large bucket. A pair's rank counts all buckets through. A triple is a pair's rank
    and a word; it lies in that pair's bucket, or, where the pair is heavy, in one by a one-to-one hash of the triple.
    """

    def __init__(self, root: str, bits: int, heavy: int, n_docs: int):
        self.root, self.bits, self.heavy, self.n_docs = root, bits, heavy, n_docs
        self.files: OrderedDict[str, object] = OrderedDict()

    def arrays(self, name: str) -> list[np.ndarray]:
        return self.named(name, list) or []

    def named(self, name: str, make: Callable) -> object:
        """What ``make`` gives of the file, remembered where it is mapped (the files used last, as many as a worker may map); None without it."""
        key = f"{name} {make.__name__}"
        if key in self.files:
            self.files.move_to_end(key)
            return self.files[key]
        found = get(f"{self.root}/{name}")
        out = make(found) if found else None
        if isinstance(_open(self.root)[0], fs.LocalFileSystem):
            self.files[key] = out
            if len(self.files) > most_mapped():
                self.files.popitem(last=False)
        return out

    def words_known(self) -> None:
        """The numbers that follow from the vocabulary."""
        self.base = np.r_[0, np.cumsum(self.arrays("vocabulary-sizes")[0].astype(np.int64))]
        self.size = int(self.base[-1])
        self.b = max(self.size.bit_length(), self.bits)
        self.width = -(-(self.size + 1) // (1 << self.bits))
        self.pair_span = max(1, (self.width - 1).bit_length()) + self.b
        self.pair_all = 2 * self.b
        self.pair_edges = (np.arange(1 << self.bits, dtype=np.uint64) * np.uint64(self.width)) << np.uint64(self.b)

    def pairs_known(self) -> None:
        """The numbers that follow from the sizes of the pairs' buckets."""
        n0, n1 = (x.astype(np.int64) for x in self.arrays("pair-sizes"))
        self.plain, self.pair_base = n0, np.r_[0, np.cumsum(n0 + n1)]
        self.pairs = int(self.pair_base[-1])
        self.triple_span = max(1, int((n0 + n1).max()).bit_length()) + self.b
        self.triple_all = self.pairs.bit_length() + self.b

    def ready(self) -> Layout:
        if not hasattr(self, "base"):
            self.words_known()
        if not hasattr(self, "pairs") and get(f"{self.root}/pair-sizes"):
            self.pairs_known()
        return self

    def __getstate__(self) -> dict:
        return {"root": self.root, "bits": self.bits, "heavy": self.heavy, "n_docs": self.n_docs, "files": OrderedDict()}

    # the first values of buckets by the first bits

    def spread_edges(self, span: int) -> np.ndarray:
        return np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(span - self.bits)

    # words

    def find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        for k, part in cut(distinct, self.spread_edges(64)):
            if self.base[k + 1] > self.base[k]:
                keys, numbers = self.arrays(f"words-{k:05d}")
                at = np.minimum(np.searchsorted(keys, distinct[part]), len(keys) - 1)
                known = keys[at] == distinct[part]
                ids[part] = np.where(known, self.base[k] + at, -1)
                counts[part] = np.where(known, numbers[at].astype(np.int64), 0)
        return ids, counts

    def tokens_of(self, ids: np.ndarray) -> np.ndarray:
        """Training tokens of sorted ids; of the start, the documents."""
        out = np.full(len(ids), self.n_docs, np.int64)
        for k, part in cut(ids, self.base[:-1]):
            inside = ids[part] < self.size
            if inside.any():
                out[part][inside] = self.arrays(f"words-{k:05d}")[1][ids[part][inside] - self.base[k]].astype(np.int64)
        return out

    # pairs

    def pair_parts(self, k: int) -> list[tuple[Table, Counts]] | None:
        def parts(f: list) -> list:
            return [(Table(f[0], self.pair_span), Counts(f[1], f[2])), (Table(f[3], self.pair_all - self.bits), Counts(f[4], f[5]))]

        return self.named(f"pairs-{k:05d}", parts)

    def pair_keys(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Pairs (context and word) of a bucket in rank order; of all of it or at some places."""
        plain, spread = (t for t, _ in self.pair_parts(k))
        first = np.uint64(k * self.width << self.b)
        whole = lambda keys: unmixed(np.uint64(k << (self.pair_all - self.bits)) | keys, self.pair_all)
        if at is None:
            return np.r_[plain.keys() + first, whole(spread.keys())]
        out, n = np.empty(len(at), np.uint64), int(self.plain[k])
        out[at < n] = plain.keys(at[at < n]) + first
        out[at >= n] = whole(spread.keys(at[at >= n] - n))
        return out

    def ranks(self, context: np.ndarray, word: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: none) and count of each pair."""
        rank, times = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
        able = (context >= 0) & (word >= 0)
        for kind in (0, 1):
            rows = np.flatnonzero(able & (heavy == bool(kind)))
            if not len(rows):
                continue
            keys = context[rows].astype(np.uint64) << np.uint64(self.b) | word[rows].astype(np.uint64)
            keys, back = np.unique(mixed(keys, self.pair_all) if kind else keys, return_inverse=True)
            r, t = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
            edges = self.spread_edges(self.pair_all) if kind else self.pair_edges
            for k, part in cut(keys, edges):
                if (files := self.pair_parts(k)) is not None:
                    at, there = files[kind][0].find(keys[part] - edges[k])
                    base = self.pair_base[k] + (self.plain[k] if kind else 0)
                    r[part] = np.where(there, base + at, -1)
                    n = np.zeros(len(at), np.int64)
                    n[there] = files[kind][1].of(at[there])
                    t[part] = n
            rank[rows], times[rows] = r[back], t[back]
        return rank, times

    def by_rank(self, ranks: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(bucket, slice, places in it) of sorted ranks."""
        for k, part in cut(ranks, self.pair_base[:-1]):
            yield k, part, ranks[part] - self.pair_base[k]

    def triples(self, rank: np.ndarray, word: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """Count of each triple of a pair's rank (-1: none) and a word."""
        out = np.zeros(len(word), np.int64)
        able = (rank >= 0) & (word >= 0)
        for kind in (0, 1):
            rows = np.flatnonzero(able & (heavy == bool(kind)))
            if not len(rows):
                continue
            keys = rank[rows].astype(np.uint64) << np.uint64(self.b) | word[rows].astype(np.uint64)
            keys, back = np.unique(mixed(keys, self.triple_all) if kind else keys, return_inverse=True)
            edges = self.spread_edges(self.triple_all) if kind else self.pair_base[:-1].astype(np.uint64) << np.uint64(self.b)
            n = np.zeros(len(keys), np.int64)
            for k, part in cut(keys, edges):
                if (files := self.triple_parts(k)) is not None:
                    at, there = files[kind][0].find(keys[part] - edges[k])
                    n[part][there] = files[kind][1].of(at[there])
            out[rows] = n[back]
        return out

    def triple_parts(self, k: int) -> list[tuple[Table, Counts]] | None:
        def parts(f: list) -> list:
            return [(Table(f[0], self.triple_span), Counts(f[1], f[2])), (Table(f[3], self.triple_all - self.bits), Counts(f[4], f[5]))]

        return self.named(f"triples-{k:05d}", parts)

    # tokens of documents

    def places(self, hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the distinct tokens of the documents, each with its end; which of them each token is; and each document's first place.

        An unknown word has id -1."""
        ends = np.cumsum([len(h) + 1 for h in hashed])
        tokens = np.empty(ends[-1], np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[ends - 1] = False
        tokens[ends - 1] = END
        tokens[inside] = np.concatenate(hashed)
        distinct, which = np.unique(tokens, return_inverse=True)
        return *self.find(distinct), which, np.r_[0, ends[:-1]]

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The id before each token; V before a document's first."""
        context = np.r_[0, ids[:-1]]
        context[starts] = self.size
        return context

    def heavy_contexts(self, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether each token's context word is heavy, as a start always is."""
        before = np.r_[0, counts[:-1]]
        before[starts] = self.heavy + 1
        return before > self.heavy


_layouts: dict[str, Layout] = {}


def worker_layout(layout: Layout, step: str) -> Layout:
    """This worker's copy, with its mapped files; anew for each step, as files come to be."""
    key = f"{layout.root} {step}"
    if key not in _layouts:
        _layouts.clear()
        _scorers.clear()  # a model scored before stays mapped no longer
        _layouts[key] = layout.ready()
    return _layouts[key]


# --- counting -------------------------------------------------------------------------------------


def _flushed(batches: Iterator[pa.RecordBatch], out: Callable) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(hashes(text.as_py()))
            n += len(held[-1]) + 1
            if n >= FLUSH:
                yield out(held)
                held, n = [], 0
    if held:
        yield out(held)


def _count_words(layout: Layout) -> Callable:
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = counted(np.concatenate([*held, np.full(len(held), END)]))
        return blocks([(k, pack(0, values[s], counts[s])) for k, s in cut(values, layout.spread_edges(64))])

    return lambda batches: _flushed(batches, out)


def _store_words(layout: Layout) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        k = group["bucket"][0].as_py()
        values, counts = gathered(group, 0, 1)
        put(f"{layout.root}/words-{k:05d}", values, counts.astype(np.uint64))
        return sizes_row(k, len(values), 0, int(counts.sum()), counts)

    return run


def _count_pairs(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = worker_layout(layout, "pairs")

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            ids, counts, which, starts = here.places(held)
            ids, counts = ids[which], counts[which]
            context = here.contexts(ids, starts)
            keys = context.astype(np.uint64) << np.uint64(here.b) | ids.astype(np.uint64)
            heavy = here.heavy_contexts(counts, starts)
            rows = []
            for kind, edges in ((0, here.pair_edges), (1, here.spread_edges(here.pair_all))):
                some = keys[heavy == bool(kind)]
                found, n = counted(mixed(some, here.pair_all) if kind else some)
                rows += [(k, pack(kind, found[s] - edges[k], n[s])) for k, s in cut(found, edges)]
            return blocks(rows)

        yield from _flushed(batches, out)

    return run


def _store_pairs(layout: Layout) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        here = worker_layout(layout, "pairs")
        k = group["bucket"][0].as_py()
        (plain, n0), (spread, n1) = gathered(group, 0, 1), gathered(group, 1, 1)
        put(f"{here.root}/pairs-{k:05d}", *stored(plain, n0, here.pair_span), *stored(spread, n1, here.pair_all - here.bits))
        return sizes_row(k, len(plain), len(spread), int(n0.sum() + n1.sum()), np.r_[n0, n1])

    return run


def _count_triples(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = worker_layout(layout, "triples")

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            ids, counts, which, starts = here.places(held)
            ids, counts = ids[which], counts[which]
            rank, times = here.ranks(here.contexts(ids, starts), ids, here.heavy_contexts(counts, starts))
            later = np.ones(len(ids), bool)
            later[starts] = False
            at = np.flatnonzero(later)
            keys = rank[at - 1].astype(np.uint64) << np.uint64(here.b) | ids[at].astype(np.uint64)
            heavy = times[at - 1] > here.heavy
            rows = []
            for kind, edges in ((0, here.pair_base[:-1].astype(np.uint64) << np.uint64(here.b)), (1, here.spread_edges(here.triple_all))):
                some = keys[heavy == bool(kind)]
                found, n = counted(mixed(some, here.triple_all) if kind else some)
                for k, s in cut(found, edges):
                    rows.append((k, pack(kind, found[s] - edges[k], n[s])))
            return blocks(rows)

        yield from _flushed(batches, out)

    return run


def _store_triples(layout: Layout) -> Callable:
    """The triples of a bucket, and for each of its pairs how many words follow it once, twice and more often (0 for heavy pairs)."""

    def run(group: pa.Table) -> pa.Table:
        here = worker_layout(layout, "triples")
        k = group["bucket"][0].as_py()
        (plain, n0), (spread, n1) = gathered(group, 0, 1), gathered(group, 1, 1)
        put(f"{here.root}/triples-{k:05d}", *stored(plain, n0, here.triple_span), *stored(spread, n1, here.triple_all - here.bits))
        place = (plain >> np.uint64(here.b)).astype(np.int64)
        n = int(here.pair_base[k + 1] - here.pair_base[k])
        put(f"{here.root}/after-{k:05d}", *(x for j in (1, 2, 3) for x in small(np.bincount(place[np.minimum(n0, 3) == j], minlength=n))))
        return sizes_row(k, len(plain), len(spread), int(n0.sum() + n1.sum()), np.r_[n0, n1])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[int]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _adjust(layout: Layout) -> Callable:
    """Of the triples of each bucket: for each pair that ends one, how many start it (kind 0); for heavy pairs, the words that follow (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = worker_layout(layout, "adjust")
        mask = np.uint64((1 << here.b) - 1)
        for k in _buckets(batches):
            rows = [(k, pack(0, np.empty(0, np.uint64), np.empty(0, np.int64)))]
            if (files := here.triple_parts(k)) is not None:
                plain, spread = (t.keys() for t, _ in files)
                plain = plain + (np.uint64(here.pair_base[k]) << np.uint64(here.b))
                spread = unmixed(np.uint64(k << (here.triple_all - here.bits)) | spread, here.triple_all)
                keys = np.r_[plain, spread]
                ranks, back = np.unique((keys >> np.uint64(here.b)).astype(np.int64), return_inverse=True)
                middle = np.empty(len(ranks), np.int64)
                for j, part, at in here.by_rank(ranks):
                    middle[part] = (here.pair_keys(j, at) & mask).astype(np.int64)
                middle, word = middle[back], (keys & mask).astype(np.int64)
                distinct, back = np.unique(middle, return_inverse=True)
                heavy = (here.tokens_of(distinct) > here.heavy)[back]
                found, n = np.unique(here.ranks(middle, word, heavy)[0], return_counts=True)
                rows += [(j, pack(0, at.astype(np.uint64), n[part])) for j, part, at in here.by_rank(found)]
                if len(spread):
                    of = (spread >> np.uint64(here.b)).astype(np.int64)
                    times = np.minimum(files[1][1].all(), 3)
                    ranks, back = np.unique(of, return_inverse=True)
                    n = [np.bincount(back[times == j], minlength=len(ranks)) for j in (1, 2, 3)]
                    rows += [(j, pack(1, at.astype(np.uint64), *(x[part] for x in n))) for j, part, at in here.by_rank(ranks)]
            yield blocks(rows)

    return run


def _store_adjusted(layout: Layout) -> Callable:
    """For each pair of a bucket how many words come before it (a pair at a text's start: how often), and what follows its heavy pairs."""

    def run(group: pa.Table) -> pa.Table:
        here = worker_layout(layout, "adjust")
        k = group["bucket"][0].as_py()
        n = np.zeros(int(here.pair_base[k + 1] - here.pair_base[k]), np.int64)
        at, counts = gathered(group, 0, 1)
        n[at.astype(np.int64)] = counts
        if len(n):
            first = (here.pair_keys(k) >> np.uint64(here.b)).astype(np.int64) == here.size
            n[first] = np.r_[tuple(c.all() for _, c in here.pair_parts(k))][first]
        put(f"{here.root}/adjusted-{k:05d}", *small(n))
        put(f"{here.root}/heavy-{k:05d}", *(x.astype(np.uint64) for x in gathered(group, 1, 3)))
        return sizes_row(k, len(n), 0, int(n.sum()), n)

    return run


def _word_stats(layout: Layout, order: int) -> Callable:
    """Of the pairs of each bucket: contexts of each word (kind 0); of each context its total and the words that follow it once, twice and more often (kinds 1 to 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = worker_layout(layout, "stats")
        edges = here.base[:-1].astype(np.uint64)
        for k in _buckets(batches):
            if (files := here.pair_parts(k)) is None:
                continue
            keys = here.pair_keys(k)
            n = np.r_[tuple(c.all() for _, c in files)] if order == 2 else here.named(f"adjusted-{k:05d}", _counts).all()
            context, word = keys >> np.uint64(here.b), keys & np.uint64((1 << here.b) - 1)
            rows = []
            for kind, ids, by in ((0, word, np.ones(len(n), np.int64)), (1, context, n), *((j + 1, context[np.minimum(n, 3) == j], np.ones(int((np.minimum(n, 3) == j).sum()), np.int64)) for j in (1, 2, 3))):
                values, total = counted(ids, by)
                for j, s in cut(values, edges):
                    rows.append((j, pack(kind, values[s] - edges[j], total[s])))
            if rows:
                yield blocks(rows)

    return run


def _counts(f: list) -> Counts:
    return Counts(f[0], f[1])


def _store_stats(layout: Layout) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        here = worker_layout(layout, "stats")
        k = group["bucket"][0].as_py()
        n = int(here.base[k + 1] - here.base[k]) + 1  # the last bucket's last row is the start's
        stats = np.zeros((5, n), np.uint64)
        for kind in range(5):
            at, total = gathered(group, kind, 1)
            stats[kind, at.astype(np.int64)] = total
        put(f"{here.root}/stats-{k:05d}", stats[0].astype(np.uint32), stats[1], *stats[2:].astype(np.uint32))
        follows = stats[0].astype(np.int64)
        return sizes_row(k, n, 0, int(follows.sum()), follows)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more, from the numbers of things counted 1, 2, 3 and 4 times.

    Where too few are counted for the estimate, the middle of its range stands in."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [0.0]
    for j, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = j - (j + 1) * y * b / a if a else j / 2
        out.append(d if 0 < d < j else j / 2)
    return np.array(out)


# --- scoring --------------------------------------------------------------------------------------


class Scorer:
    def __init__(self, layout: Layout, order: int, train: int, off: list[np.ndarray], rest: float):
        self.layout, self.order, self.train, self.off, self.rest = layout, order, train, off, rest

    def _stats(self, ids: np.ndarray) -> np.ndarray:
        """Stats of sorted distinct ids: contexts, total, followers."""
        here, out = self.layout, np.zeros((len(ids), 5), np.float64)
        for k, part in cut(ids, here.base[:-1]):
            at = ids[part] - here.base[k]
            if found := here.arrays(f"stats-{k:05d}"):
                for j in range(5):
                    out[part, j] = found[j][at]
        return out

    def _pair_stats(self, ranks: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted distinct ranks: adjusted count, and the weight that their discounted followers leave."""
        here, adjusted, left = self.layout, np.zeros(len(ranks), np.int64), np.zeros(len(ranks))
        for k, part, at in here.by_rank(ranks):
            adjusted[part] = here.named(f"adjusted-{k:05d}", _counts).of(at)
            n = np.zeros((3, len(at)), np.int64)
            if after := here.arrays(f"after-{k:05d}"):
                for j in range(3):
                    n[j] = Counts(*after[2 * j : 2 * j + 2]).of(at)
            big = np.flatnonzero(heavy[part])
            if len(big) and (found := here.arrays(f"heavy-{k:05d}")) and len(found[0]):
                place = np.minimum(np.searchsorted(found[0], at[big].astype(np.uint64)), len(found[0]) - 1)
                for j in range(3):
                    n[j, big] = np.where(found[0][place] == at[big].astype(np.uint64), found[j + 1][place].astype(np.int64), 0)
            left[part] = self.off[2][1:] @ n
        return adjusted, left

    def score(self, hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each document."""
        here, off1, off2 = self.layout, self.off[0], self.off[1]
        size = here.size
        distinct, numbers, which, starts = here.places(hashed)
        base = np.log10((numbers + 0.1) / (self.train + 0.1 * (size + 1)))[which]
        known = np.flatnonzero(distinct >= 0)
        stats = np.zeros((len(distinct) + 1, 5))  # the last row is the start's
        stats[np.r_[known, len(distinct)]] = self._stats(np.r_[distinct[known], size])
        follows = stats[:-1, 0]
        p = ((follows - off1[np.minimum(follows, 3).astype(np.int64)]) / max(here.pairs, 1) + self.rest)[which]
        before = np.r_[0, which[:-1]]
        before[starts] = len(distinct)
        total, left = stats[before, 1], (stats[:, 2:] @ off2[1:])[before]
        ids, counts = distinct[which], numbers[which]
        rank, times = here.ranks(here.contexts(ids, starts), ids, here.heavy_contexts(counts, starts))
        heavy = times > here.heavy
        if self.order == 2:
            n = times
        else:
            ranks, first, back = np.unique(rank, return_index=True, return_inverse=True)
            unknown = int(len(ranks) and ranks[0] < 0)
            adjusted, pair_left = np.zeros(len(ranks), np.int64), np.zeros(len(ranks))
            adjusted[unknown:], pair_left[unknown:] = self._pair_stats(ranks[unknown:], heavy[first[unknown:]])
            n, pair_left = adjusted[back], pair_left[back]
        p = np.where(total > 0, (np.maximum(n - off2[np.minimum(n, 3)], 0) + left * p) / np.maximum(total, 1), p)
        if self.order == 3:
            later = np.ones(len(ids), bool)
            later[starts] = False
            at = np.flatnonzero(later)
            n, seen = here.triples(rank[at - 1], ids[at], heavy[at - 1]), times[at - 1]
            more = (np.maximum(n - self.off[2][np.minimum(n, 3)], 0) + pair_left[at - 1] * p[at]) / np.maximum(seen, 1)
            p[at] = np.where(seen > 0, more, p[at])
        return np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


_scorers: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, order: int = 3) -> DataFrame:
    """Score all whole texts by a model of those whose crc32(id as text) mod ``folds`` is not ``held_fold``.

    Counted in passes that combine before each shuffle and write sorted arrays, one file a bucket (``Layout``): words, pairs, triples,
    then for each pair the words before it and for each word its contexts. Frequent words and pairs are spread over all
    buckets. The files lie in the shared folder; workers map them into memory. Nothing is pruned; a file is no larger than
    a bucket, whose number grows with the corpus. A shuffle's files go once its pass is written. Probabilities: modified Kneser-Ney;
    triples (``order`` 3) interpolated with pairs, those with words, by continuation counts below the highest order (but of pairs that start a
    text), and words with the uniform share of the vocabulary and one unknown word.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null or empty text: the end token
    alone; a null id counts as held out by the crc32 of the empty text; repeated rows count each; without
    training rows every token has the unknown word's share; an empty table gives no rows; other columns are not read.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    root = scratch.path("model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    training = rows.filter(crc % folds != held_fold)
    n_docs, chars = training.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bits = max(6, int(np.ceil(np.log2(max(chars, 1) / BUCKET_CHARS))))
    layout, texts = Layout(root, bits, 0, n_docs), training.select("text")

    def counted_by(source: DataFrame, count: Callable, store: Callable) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """Sizes of both parts of each bucket, tokens, and how many things are counted 1 to 4 times."""
        with releasing_shuffles(spark):
            found = source.mapInArrow(count, BLOCK_DDL).groupBy("bucket").applyInArrow(store, SIZES_DDL).collect()
        n = np.zeros((2, 1 << bits), np.uint64)
        for r in found:
            n[0, r.bucket], n[1, r.bucket] = r.n0, r.n1
        return n[0], n[1], sum(r.tokens for r in found), np.array([sum(r[f"c{j}"] for r in found) for j in (1, 2, 3, 4)])

    buckets = spark.range(0, 1 << bits, 1, min(1 << bits, 4 * spark.sparkContext.defaultParallelism + (1 << bits) // 64))
    n_words, _, train, _ = counted_by(texts, _count_words(layout), _store_words(layout))
    put(f"{root}/vocabulary-sizes", n_words)
    layout.heavy = train // (4 << bits)
    layout.words_known()
    if layout.size >= 1 << 31:
        raise ValueError("over 2**31 distinct words: two ids no longer fit a number")
    plain, spread, _, of_pairs = counted_by(texts, _count_pairs(layout), _store_pairs(layout))
    put(f"{root}/pair-sizes", plain, spread)
    layout.pairs_known()
    off = [np.zeros(4)] * 3
    off[1] = discounts(of_pairs)
    if order == 3:
        if layout.triple_all > 63:
            raise ValueError("over 2**63 possible triples: a pair and a word no longer fit a number")
        off[2] = discounts(counted_by(texts, _count_triples(layout), _store_triples(layout))[3])
        off[1] = discounts(counted_by(buckets, _adjust(layout), _store_adjusted(layout))[3])
    _, _, _, contexts = counted_by(buckets, _word_stats(layout, order), _store_stats(layout))
    off[0] = discounts(contexts)
    # words of three contexts and more are those that the smaller numbers leave
    more = max(0, layout.size - int(contexts[:2].sum()))
    left = float(off[0][1] * contexts[0] + off[0][2] * contexts[1] + off[0][3] * more)
    rest = (left / layout.pairs if layout.pairs else 1.0) / (layout.size + 1)
    scorer_of = Scorer(layout, order, train, off, rest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if root not in _scorers:
            _scorers.clear()
            scorer_of.layout = worker_layout(layout, "score")
            _scorers[root] = scorer_of
        scorer = _scorers[root]
        ids, held = [], []

        def out() -> pa.RecordBatch:
            known, base, model = scorer.score(held)
            return pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([crc_of_id(i) % folds == held_fold for i in ids]), pa.array([len(h) + 1 for h in held], pa.int64()), pa.array(known), pa.array([train] * len(ids), pa.int64()), pa.array(base), pa.array(model)],
                names=[c.split()[0] for c in SCORE_DDL.split(", ")],
            )

        n = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                held.append(hashes(text.as_py()))
                n += len(held[-1]) + 1
                if n >= SCORED:
                    yield out()
                    ids, held, n = [], [], 0
        if ids:
            yield out()

    return rows.mapInArrow(score, SCORE_DDL)
