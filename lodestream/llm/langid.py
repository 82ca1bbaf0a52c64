"""Language identification: scripts narrow the candidates, per-word scores and a switching penalty label spans by Viterbi."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import crc_of_id, ship

WORD = re.compile(r"[^\W\d_]+")
#: First code points of script blocks, in order, and their scripts.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2DE0, 0x2E00, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "cyrillic", "other", "kana", "other", "han", "other", "hangul", "other", "han", "latin", "arabic", "other")
FEATURES = 1 << 17
SLICES = 64
UNDETERMINED = "und"
MOST_LANGUAGES = 1000  # values of the language column that a model may have: each takes half a megabyte in every worker


def script(word: str) -> str:
    return SCRIPT_NAMES[bisect_right(SCRIPT_STARTS, ord(word[0])) - 1]


MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - FEATURES.bit_length() + 1)


def word_features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words: each run of one to four letters, the ends marked, and the word itself.

    Gives arrays (features, word numbers), all words at once.
    """
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    inside = (text != 60) & (text != 62)
    h = np.zeros(len(text), np.uint64)
    for n in range(1, 5):
        m = len(text) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ h[:m] >> np.uint64(29)) * MIX + text[n - 1 :]
        valid = inside if n == 1 else word[:m] == word[n - 1 :]
        yield ((h[valid] ^ h[valid] >> np.uint64(31)) * MIX + np.uint64(n)) * MIX >> SHIFT, word[:m][valid]
    yield np.fromiter(map(xxhash.xxh3_64_intdigest, (w.encode("utf-8", "surrogatepass") for w in words)), np.uint64, len(words)) >> SHIFT, np.arange(len(words))


def _count(batches: Iterator[pa.RecordBatch], most_words: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Of each language of the rows (lang, text): counts of features and of letters by script, in slices."""
    features: dict[str, np.ndarray] = {}
    scripts: Counter = Counter()
    words: dict[str, Counter] = {}

    def settle() -> None:
        for lang, found in words.items():
            table = features.setdefault(lang, np.zeros(FEATURES, np.int64))
            names, counts = list(found), np.fromiter(found.values(), np.int64, len(found))
            for i in range(0, len(names), 50_000):
                for at, of in word_features(names[i : i + 50_000]):
                    table += np.bincount(at.astype(np.int64), counts[i : i + 50_000][of], FEATURES).astype(np.int64)
            for word, n in found.items():
                scripts[lang, script(word)] += n * len(word)
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall((text.as_py() or "").lower()))
            if sum(map(len, words.values())) > most_words:
                settle()
    settle()
    part = TaskContext.get().partitionId()
    rows = [(k, part % 64, lang, zlib.compress(piece.tobytes(), 1)) for lang, table in features.items() for k, piece in enumerate(np.split(table, SLICES))]
    rows += [(-1, part % 64, f"{lang}\t{name}", zlib.compress(np.array([n], np.int64).tobytes())) for (lang, name), n in scripts.items()]
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["slice", "part", "lang", "counts"])


def _add(group: pa.Table) -> pa.Table:
    total: dict[str, np.ndarray] = {}
    for lang, block in zip(group["lang"].to_pylist(), group["counts"], strict=True):
        found = np.frombuffer(zlib.decompress(block.as_py()), np.int64)
        total[lang] = total[lang] + found if lang in total else found
    n = len(total)
    return pa.table([pa.array([group["slice"][0].as_py()] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(list(total), pa.string()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["slice", "part", "lang", "counts"])


class LanguageModel:
    """Log-probabilities of features by language (a table of bounded size) and the languages of each script."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, dict[str, int]], penalty: float = 8.0, most_words: int = 200_000):
        self.langs = sorted(counts)
        table = np.stack([counts[x] for x in self.langs], axis=1).astype(float) if self.langs else np.zeros((FEATURES, 0))
        self.table = np.log((table + 0.05) / (table.sum(axis=0) + 0.05 * FEATURES)).astype(np.float32)
        self.allowed: dict[str, np.ndarray] = {}
        for name in {*SCRIPT_NAMES}:
            share = np.array([scripts.get(x, {}).get(name, 0) / max(1, sum(scripts.get(x, {}).values())) for x in self.langs])
            self.allowed[name] = share >= 0.001 if (share >= 0.001).any() else np.ones(len(self.langs), bool)
        self.penalty, self.most = penalty, most_words
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.langs)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.clear()

    def _learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > self.most:
            self.clear()
        while len(self.place) + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        found = sorted(words)
        for i in range(0, len(found), 20_000):
            part = found[i : i + 20_000]
            total, n = np.zeros((len(part), len(self.langs))), np.zeros(len(part))
            for at, of in word_features(part):
                n += np.bincount(of, minlength=len(part))
                rows = self.table[at.astype(np.int64)]
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(of, rows[:, k], len(part))
            # features overlap, so their mean counts as a few independent ones
            score = total / n[:, None] * np.minimum([*map(len, part)], 4)[:, None]
            score = np.maximum(score - score.max(axis=1, keepdims=True), -6)
            allowed = np.stack([self.allowed[script(w)] for w in part])
            first = len(self.place)
            self.rows[first : first + len(part)] = np.where(allowed, score, -12)
            self.place.update(zip(part, range(first, first + len(part)), strict=True))

    def scores(self, words: list[str]) -> np.ndarray:
        missing = {*words}.difference(self.place)
        if missing:
            if len(self.place) + len(missing) > self.most:
                missing = {*words}
            self._learn(missing)
        return self.rows[[*map(self.place.__getitem__, words)]]

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word under the switching penalty; exact.

        Let one language be the best for all words alone. Any path with others holds a stretch between its words (or an end of the
        text) that costs a switch at least and gains no more than the words' best others do over it; if no
        stretch gains more than a switch by that bound, the one language is the path. Else the recursion runs over all languages.
        """
        total = s.sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        if s.shape[1] < 2:
            return np.full(len(s), best)
        others = s.copy()
        others[:, best] = -np.inf
        gain = np.cumsum(others.max(axis=1).astype(np.float64) - s[:, best])
        low = np.minimum.accumulate(np.r_[0.0, gain])[:-1]
        if (gain - low).max() <= self.penalty:
            return np.full(len(s), best)
        return self._recursion(s)

    def _recursion(self, s: np.ndarray) -> np.ndarray:
        rows = s.astype(np.float64).tolist()
        here, back, penalty = rows[0], [], self.penalty
        for row in rows[1:]:
            top = max(here)
            least, k = top - penalty, here.index(top)
            back.append([k if h < least else -1 for h in here])
            here = [(least if h < least else h) + x for h, x in zip(here, row)]  # noqa: B905
        k = here.index(max(here))
        out = [k]
        for row in reversed(back):
            k = row[k] if row[k] >= 0 else k
            out.append(k)
        return np.array(out[::-1])

    def predict(self, text: str | None) -> tuple[str, float, int, np.ndarray | None]:
        """(language of most letters, score, number of spans, the path)."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNDETERMINED, 0.0, 0, None
        s = np.concatenate([self.scores(words[i : i + 50_000]) for i in range(0, len(words), 50_000)])
        path = self.path(s)
        if (path == path[0]).all():
            best, share, spans, inside = int(path[0]), 1.0, 1, s
        else:
            letters = np.bincount(path, weights=[*map(len, words)], minlength=len(self.langs))
            best = int(letters.argmax())
            share, spans, inside = float(letters[best] / letters.sum()), int((path[1:] != path[:-1]).sum()) + 1, s[path == best]
        odds = inside.sum(axis=0, dtype=np.float64)
        sure = 1 / np.exp(np.clip(odds - odds[best], -700, 50)).sum()
        return self.langs[best], float(share * min(1.0, sure)), spans, path

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, start, end) in code points of the lower-cased text's words, runs of one language joined."""
        _, _, _, path = self.predict(text)
        out: list[tuple[str, int, int]] = []
        if path is not None:
            for m, k in zip(WORD.finditer(text.lower()), path, strict=True):
                if out and out[-1][0] == self.langs[k]:
                    out[-1] = (out[-1][0], out[-1][1], m.end())
                else:
                    out.append((self.langs[k], m.start(), m.end()))
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """Count features over all rows of non-null language; tables of bounded size are added up in two levels and reach the driver. More than MOST_LANGUAGES languages are an error."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    if rows.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: their tables would not fit the workers")
    ddl = "slice int, part int, lang string, counts binary"
    added = rows.mapInArrow(_count, ddl).groupBy("slice", "part").applyInArrow(_add, ddl).groupBy("slice").applyInArrow(_add, ddl).collect()
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, dict[str, int]] = {}
    for r in added:
        found = np.frombuffer(zlib.decompress(r.counts), np.int64)
        if r.slice < 0:
            lang, name = r.lang.rsplit("\t", 1)
            scripts.setdefault(lang, {})[name] = int(found[0])
        else:
            size = FEATURES // SLICES
            counts.setdefault(r.lang, np.zeros(FEATURES, np.int64))[r.slice * size : (r.slice + 1) * size] = found
    return LanguageModel(counts, scripts, **options)


PREDICTED_DDL = "doc_id long, held_out boolean, lang_pred string, score double, n_spans int"


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Per document: whether crc32(id as text) mod ``folds`` is ``held_fold``, the language of most letters, its score, the number of spans.

    The score is the language's share of the letters times its probability there; of languages that tie the first by name counts. Null texts and those without a letter: ``und``,
    score 0, as everything is when nothing was learned. Whole texts of any length; repeated rows each; a null id has the crc32 of
    the empty text; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([crc_of_id(i) % folds == held_fold for i in ids], pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32())],
                names=[c.split()[0] for c in PREDICTED_DDL.split(", ")],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, PREDICTED_DDL)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Learn from the rows outside the held fold and predict all."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary"))
    return predict_languages(docs, train(docs.filter(crc % folds != held_fold), text_col, lang_col), id_col, text_col, folds, held_fold)
