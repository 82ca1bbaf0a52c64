"""SentencePiece BPE in vectorised merge rounds: flat symbol arrays of many words at once, and the way back to text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import giving_back, ship

SPACE = "▁"  # the sign that stands for a space in pieces
NONE = np.int32(np.iinfo(np.int32).max)  # rank of symbols that do not merge
LONG = 24  # symbols of a word from which on merges that nothing can prevent are made ahead of their turn
SLICE = 1 << 20  # characters of words that are merged together
CACHED_WORDS = 1_000_000  # words that a worker remembers; beyond them it begins anew
CHUNK = 1 << 20  # characters of a text whose words are listed at once
UNIT = re.compile(" *[^ ]+| +")
TRIALS = ("", " ", "  ", "a", "the theatre", "  two   spaces ", "语言 \U0001f600▁x", "aaaaaaaaaaaaa", "\ttab\nline 12345", " " * 37 + "x" + " " * 18, "naïve façade ẞ", "<s> </s> <0x41> <unk>", "\x00\x7f", *(" " * n + "x" for n in range(40)))


class _Table:
    """A map of non-negative integer keys to integers, looked up for whole arrays: open addressing, a few probes at most."""

    def __init__(self, found: dict[int, int], missing: int):
        bits = max(4, (8 * len(found)).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int32)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for a slot one stays
            settled = self.keys[at] == keys
            self.values[at[settled]] = values[settled]
            keys, values, at = keys[~settled], values[~settled], (at[~settled] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.missing).astype(np.int32)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at_left = (at[left] + 1) & self.mask
            at[left] = at_left
            there = self.keys[at_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[at_left[hit]]
            left = left[~hit & (there >= 0)]
        return out


class _Index(dict):
    """Units numbered as they are met; ``fresh`` lists the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        k = self[unit] = len(self)
        self.fresh.append(unit)
        return k


def _room(values: np.ndarray, n: int) -> np.ndarray:
    return values if n <= len(values) else np.concatenate([values, np.empty(max(n, 2 * len(values)) - len(values), values.dtype)])


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class PieceModel:
    """Encoder and decoder of a byte-fallback BPE model file without normalization but the prefixed space.

    No piece holds a space sign after another character, so a text falls into words (one sign and what follows it) that merge apart
    from each other; signs beyond one before a word merge last, among themselves. The constructor checks both, and trial texts, against the library.
    """

    def __init__(self, path: str, cache_words: int = CACHED_WORDS):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        pieces = [library.id_to_piece(i) for i in range(size)]
        if any(library.is_unused(i) for i in range(size)) or any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}+[^{SPACE}]", p) for i, p in enumerate(pieces) if not special[i]):
            raise ValueError("the model has pieces across words")
        self.size, self.space = size, pieces.index(SPACE)
        self.ids = ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(pieces):
            if library.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
        order = sorted({-library.get_score(i) for p, i in ids.items() if len(p) > 1})
        place = {s: k for k, s in enumerate(order)}
        self.rank = np.full(size + 1, NONE, np.int32)
        pairs, ahead, behind = {}, {}, {}
        base = self.base = size + 1
        merged = {p: place[-library.get_score(i)] for p, i in ids.items() if len(p) > 1 and p.strip(SPACE)}
        for piece, rank in merged.items():
            self.rank[ids[piece]] = rank
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * base + right] = ids[piece]
                for near, inner, cuts in ((behind, right, range(k)), (ahead, left, range(k + 1, len(piece) + 1))):
                    for cut in cuts if inner is not None else ():
                        other = ids.get(piece[cut:k] if near is behind else piece[k:cut])
                        if other is not None:
                            key = other * base + inner if near is behind else inner * base + other
                            if near.get(key, rank) >= rank:
                                near[key] = rank
        if len({*merged.values()}) < len(merged) or not all(c in ids for p in merged for c in p):
            raise ValueError("the model has pieces of one score or of unknown characters")
        self.pairs, self.ahead, self.behind = _Table(pairs, size), _Table(ahead, int(NONE)), _Table(behind, int(NONE))
        self.chars = _Table({ord(p): i for p, i in ids.items() if len(p) == 1}, size)
        names = [f"{i},".encode() for i in range(size)]
        self.names, self.name_sizes = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names])
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        surfaces = [b"" if library.is_control(i) else library.decode([i]).encode() if library.is_unknown(i) else bytes([int(p[1:-1], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.unknown = next((i for i in range(size) if library.is_unknown(i)), -1)
        self.is_byte = np.array([library.is_byte(i) for i in range(size)])
        self.is_control = np.array([library.is_control(i) for i in range(size)])
        self.surfaces = surfaces
        self.surface_bytes, self.surface_sizes = np.frombuffer(b"".join(surfaces), np.uint8), np.array([len(x) for x in surfaces])
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.longest_run = max(len(p) for p in ids if not p.strip(SPACE))
        self.most = cache_words
        self._forget()
        if any(self.encode(t) != library.encode(t) or self.decode(library.encode(t)) != library.decode(library.encode(t)) for t in TRIALS):
            raise ValueError("the model normalizes texts or splits them in another way")

    # --- merge rounds ---------------------------------------------------------------------------

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's begin (and the last one's end). Ids of a word (a space sign and characters other than it), all words in the same rounds.

        A round finds each pair's rank and the least of each word (a segmented minimum), merges all occurrences of it at once, the left one
        where two overlap, and compacts the arrays; words without a pair leave. Where that gives rise to a better-ranked pair, the word's
        leftmost occurrence merges alone. In long words a pair merges ahead of its turn if no better-ranked piece that holds the neighbouring symbols
        can take either half or the whole: nothing can then prevent it, and all that it becomes part of comes after it, so the outcome is the same.
        """
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        length = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), length)
        symbol, place = self.chars[points].astype(np.int64), np.arange(len(points))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(symbol):
            piece = np.append(np.where(word[1:] == word[:-1], self.pairs[symbol[:-1] * self.base + symbol[1:]], self.size), self.size)
            rank = self.rank[piece]
            touched = np.ones(len(symbol), bool)
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            least_of = np.minimum.reduceat(rank, starts)
            least = np.repeat(least_of, sizes)
            live = least < NONE
            if not live.all():
                done.append((word[~live], symbol[~live], place[~live]))
                word, symbol, place, piece, rank, least, touched = (x[live] for x in (word, symbol, place, piece, rank, least, touched))
                sizes, least_of = sizes[least_of < NONE], least_of[least_of < NONE]
                if not len(symbol):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            new_word = np.append(True, word[at[1:]] != word[at[:-1]])
            # of hits side by side every other one merges, counted from the left
            fresh = new_word | np.append(True, at[1:] != at[:-1] + 1)
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            hit[at[since % 2 == 1]] = False
            sure = self._certain(symbol, word, piece, rank, touched & np.repeat(sizes >= LONG, sizes)) if sizes.max() >= LONG else None
            after = self._apply(symbol, word, place, piece, hit if sure is None else hit | sure)
            # a merge that gives rise to a better-ranked pair than its own has to come before the word's other occurrences
            starts = np.flatnonzero(np.append(True, after[1][1:] != after[1][:-1]))
            early = np.minimum.reduceat(after[4], starts) <= least_of
            if early.any():
                again = np.repeat(early, sizes)
                first = np.zeros(len(symbol), bool)
                first[at[new_word]] = True
                hit = np.where(again, first, hit)
                after = self._apply(symbol, word, place, piece, hit if sure is None else hit | sure)
            symbol, word, place, piece, rank, touched = after
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, symbol, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        word, symbol = word[order], symbol[order]
        odd = np.flatnonzero(symbol == self.size)
        if len(odd):  # characters that are no piece, as the ids of their bytes
            kinds, which = np.unique(points[place[order[odd]]], return_inverse=True)
            coded = [self.byte_ids[[*chr(c).encode("utf-8", "replace")]] for c in kinds.tolist()]
            counts = np.ones(len(symbol), np.int64)
            counts[odd] = np.array([len(c) for c in coded])[which]
            begins, word, symbol = np.cumsum(counts) - counts, np.repeat(word, counts), np.repeat(symbol, counts)
            for k in range(4):
                longer = counts[odd] > k
                symbol[begins[odd[longer]] + k] = np.array([c[k] if k < len(c) else 0 for c in coded])[which[longer]]
        return symbol.astype(np.int32), np.searchsorted(word, np.arange(len(words) + 1))

    def _apply(self, symbol: np.ndarray, word: np.ndarray, place: np.ndarray, piece: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """The arrays after the merges, compacted; of each symbol the piece that it makes with the next one of its word, its rank, and whether a merge is near."""
        at = np.flatnonzero(hit)
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        merged = piece[at]
        at = at - np.arange(len(at))  # each merge before it took one symbol away
        symbol, word, place, piece = symbol[stay], word[stay], place[stay], piece[stay]
        symbol[at] = merged
        fresh = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
        fresh, ends = fresh[fresh + 1 < len(symbol)], fresh[fresh + 1 == len(symbol)]
        piece[ends] = self.size
        piece[fresh] = np.where(word[fresh + 1] == word[fresh], self.pairs[symbol[fresh] * self.base + symbol[fresh + 1]], self.size)
        touched = np.zeros(len(symbol), bool)
        for k in (-2, -1, 0, 1):
            touched[np.clip(at + k, 0, len(symbol) - 1)] = True
        return symbol, word, place, piece, self.rank[piece], touched

    def _certain(self, symbol: np.ndarray, word: np.ndarray, piece: np.ndarray, rank: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Pairs, of those asked for, of which no better-ranked piece can take a half, and that become part of none."""
        out = np.zeros(len(symbol), bool)
        at = np.flatnonzero((rank < NONE) & where)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
        has_before, has_after = (at > 0) & (word[before] == word[at]), (at + 2 < len(symbol)) & (word[after] == word[at])
        c, d = symbol[before] * self.base, symbol[after]
        left = np.where(has_before, np.minimum(self.behind[c + symbol[at]], self.behind[c + piece[at]]), NONE)
        right = np.where(has_after, self.ahead[symbol[at + 1] * self.base + d], NONE)
        whole = np.where(has_after, self.ahead[piece[at] * np.int64(self.base) + d], NONE)
        out[at[(left > rank[at]) & (right >= rank[at]) & (whole > rank[at])]] = True
        return out

    def _run(self, n: int) -> list[int]:
        """Ids of n space signs alone. All their pieces have one score, so the leftmost pair merges first: the longest pieces form from the left, and the rest is short."""
        full, rest = divmod(n, self.longest_run)
        parts, at = [1] * rest, 0
        while at + 1 < len(parts):
            if SPACE * (parts[at] + parts[at + 1]) in self.ids:
                parts[at : at + 2], at = [parts[at] + parts[at + 1]], 0
            else:
                at += 1
        return [self.ids[SPACE * k] for k in [self.longest_run] * full + parts]

    def _learn(self) -> None:
        """Merge the words that were met since the last call and put them after those known."""
        fresh, at = self.index.fresh, 0
        self.index.fresh = []
        while at < len(fresh):
            part, held = [], 0
            while at < len(fresh) and (not part or held + len(fresh[at]) <= SLICE):
                held += len(fresh[at]) + 1
                part.append(fresh[at])
                at += 1
            spaced = [k for k, u in enumerate(part) if u[:1] == " "]
            bodies = [SPACE + u for u in part]
            for k in spaced:
                bodies[k] = SPACE + body if (body := part[k].lstrip(" ")) else ""
            ids, cuts = self._merge(bodies)
            if spaced:
                listed = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                for k in spaced:
                    extra, found = len(part[k]) - max(0, len(bodies[k]) - 1), listed[k].tolist()
                    alone = bool(found) and found[0] == self.space
                    listed[k] = np.array(self._run(extra + alone) + found[alone:], np.int32)
                ids, cuts = np.concatenate(listed), np.append(0, np.cumsum([len(x) for x in listed]))
            n, k = len(ids), len(part)
            self.flat, self.starts, self.sizes = _room(self.flat, self.n_ids + n), _room(self.starts, self.n_units + k), _room(self.sizes, self.n_units + k)
            self.flat[self.n_ids : self.n_ids + n] = ids
            self.starts[self.n_units : self.n_units + k] = self.n_ids + cuts[:-1]
            self.sizes[self.n_units : self.n_units + k] = np.diff(cuts)
            self.n_ids, self.n_units = self.n_ids + n, self.n_units + k

    def _forget(self) -> None:
        self.index = _Index()
        self.flat, self.starts, self.sizes = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n_ids = self.n_units = 0

    # --- texts ----------------------------------------------------------------------------------

    def units(self, text: str | None) -> Iterator[list[str]]:
        """Words of a text, listed for a chunk of it at a time: a word stands for one space sign before it, more are spaces of its own; a run of signs that ends the text is spaces alone."""
        if not text:
            return
        text = " " + text.replace(SPACE, " ")
        at = 0
        while at < len(text):
            cut = len(text)
            if cut - at > CHUNK:
                cut = text.find(" ", at + CHUNK)
                while cut > 0 and text[cut - 1] == " ":
                    cut = text.find(" ", cut + 1)
                cut = cut if cut > 0 else len(text)
            part = text[at:cut]
            at = cut
            if "  " not in part and part[-1] != " ":
                yield part[1:].split(" ")
            else:
                yield [u[1:] if u[-1] != " " else u for u in UNIT.findall(part)]

    def ids_of(self, listed: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of units, one after the other, and where each list's begin (and the last one's end)."""
        if self.n_units > self.most:
            self._forget()
        known = self.index.__getitem__
        unit = np.concatenate([np.fromiter(map(known, units), np.int64, len(units)) for units in listed]) if listed else np.empty(0, np.int64)
        self._learn()
        sizes = self.sizes[unit]
        ends = np.cumsum(sizes)
        flat = _gather(self.flat, self.starts[unit], sizes)
        cuts = np.append(0, ends)[np.append(0, np.cumsum([len(units) for units in listed])).astype(np.int64)] if listed else np.zeros(1, np.int64)
        return flat, cuts

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of([*self.units(text)])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: a space sign that begins it goes, bytes that are no UTF-8 give the replacement character each, control ids give nothing."""
        parts, run, begun, seen = [], bytearray(), False, False
        for i in ids:
            if self.is_byte[i]:
                run += self.surfaces[i]
                continue
            if run:
                parts.append(_replacing(bytes(run)))
                run, seen = bytearray(), True
            piece = self.surfaces[i].decode()
            if seen or begun:
                pass
            elif not self.is_control[i] and i != self.unknown and piece[:1] == " ":
                piece, begun = piece[1:], True
            seen = seen or bool(piece)
            parts.append(piece)
        return "".join(parts) + _replacing(bytes(run))


def _replacing(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as wrong:
            out.append(data[at : at + wrong.start].decode() + "�")
            at += wrong.start + 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model a Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


HELD_UNITS = 1 << 20  # words of a batch's texts that are learnt together
DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(column: pa.Array, codes: PieceModel) -> Iterator[tuple[int, str, str]]:
    """Number of ids and both digests of each text."""
    listed, n_lists, held = [], [], 0
    for value in column:
        text = value.as_py()
        if text and len(text) > CHUNK:
            yield from _digests(codes, listed, n_lists)
            listed, n_lists, held = [], [], 0
            yield _long(codes, text)
            continue
        units = [*codes.units(text)]
        listed += units
        n_lists.append(len(units))
        held += sum(map(len, units))
        if held > HELD_UNITS:
            yield from _digests(codes, listed, n_lists)
            listed, n_lists, held = [], [], 0
    yield from _digests(codes, listed, n_lists)


def _bytes(codes: PieceModel, ids: np.ndarray, cuts: np.ndarray) -> tuple[memoryview, np.ndarray, memoryview, np.ndarray]:
    """Of ids in parts: their decimals, each with a comma, and the bytes that they decode to; and where each part's begin."""
    names, surfaces = codes.name_sizes[ids], codes.surface_sizes[ids]
    named = _gather(codes.names, codes.name_starts[ids], names)
    surfaced = _gather(codes.surface_bytes, codes.surface_starts[ids], surfaces)
    return named.data, np.append(0, np.cumsum(names))[cuts], surfaced.data, np.append(0, np.cumsum(surfaces))[cuts]


def _digests(codes: PieceModel, listed: list[list[str]], n_lists: list[int]) -> Iterator[tuple[int, str, str]]:
    if n_lists:
        ids, cuts = codes.ids_of(listed)
        cuts = cuts[np.append(0, np.cumsum(n_lists))]
        named, at, surfaced, on = _bytes(codes, ids, cuts)
        for k in range(len(n_lists)):
            # without the comma after the last id and the space that was put before the text
            yield int(cuts[k + 1] - cuts[k]), hashlib.sha256(named[at[k] : max(at[k], at[k + 1] - 1)]).hexdigest(), hashlib.sha256(surfaced[min(on[k] + 1, on[k + 1]) : on[k + 1]]).hexdigest()


def _long(codes: PieceModel, text: str) -> tuple[int, str, str]:
    n, sha, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for units in codes.units(text):
        ids, _ = codes.ids_of([units])
        named, _, surfaced, _ = _bytes(codes, ids, np.array([0, len(ids)]))
        sha.update(b"," if n else b"")
        sha.update(named[:-1])
        decoded.update(surfaced if n else surfaced[1:])
        n += len(ids)
    return n, sha.hexdigest(), decoded.hexdigest()


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: number of ids, sha256 of the ids in decimals joined by commas, sha256 of the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. Any length is read whole: a text's words are listed a chunk at a time, and
    a word of any length takes rounds over its own symbols. Repeated rows and null ids pass through, an empty table gives no rows,
    other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    path = path or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = model(path)
        for batch in batches:
            n, ids, decoded = zip(*_texts(batch.column(1), codes), strict=True) if batch.num_rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[f.split()[0] for f in DIGEST_DDL.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), DIGEST_DDL)


def encode_pieces(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with a column of ids (an array, empty for null and empty texts); a column of that name is replaced."""
    ship(docs.sparkSession)
    path = path or default_pieces()
    rest = docs.drop(ids_col)
    schema = rest.select("*", F.array(F.lit(0)).alias(ids_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = model(path)
        for batch in batches:
            found = pa.array([codes.encode(t) for t in batch.column(text_col).to_pylist()], pa.list_(pa.int32()))
            yield batch.append_column(ids_col, found)

    return rest.mapInArrow(giving_back(run), schema)


def decode_pieces(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the text of a column of ids (empty for null and empty arrays); a column of that name is replaced."""
    ship(docs.sparkSession)
    path = path or default_pieces()
    rest = docs.drop(text_col)
    schema = rest.select("*", F.lit("").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = model(path)
        for batch in batches:
            yield batch.append_column(text_col, pa.array([codes.decode(i or []) for i in batch.column(ids_col).to_pylist()], pa.string()))

    return rest.mapInArrow(giving_back(run), schema)
