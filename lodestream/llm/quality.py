"""Weak-label quality model: EM over heuristic labellers, hashed linear scorers on the posterior labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, giving_back

MISSING, GOOD, BAD, UNSURE = 0, 1, 2, 3  # a labeller that cannot judge a text is missing; one that does and sees neither is unsure
LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"([^\w\s])\1(?=\s|$)")
#: English insults.
INSULTS = frozenset("idiot stupid moron loser pathetic worthless disgusting scum trash clown".split())
FORMAT_SAMPLE = 8_000  # posterior-labelled documents that the format scorer is fitted on, at most
TOXIC_SAMPLE = 8_000  # documents with a toxic label or vote that the word scorer is fitted on, at most
LEXICON_SAMPLE = 8_000  # documents with a toxic label that the word beginnings are learned from, at most
BUCKETS = 1 << 20
BEGINNINGS = range(4, 8)  # letters of a word's beginning


def measures(text: str) -> np.ndarray:
    """Shares in [0, 1] that tell prose from noise, the number of words and the characters a word."""
    found = text.split()
    n = len(found)
    if not n:
        return np.zeros(9)
    lines = [x for x in text.split("\n") if x.strip()]
    loud = sum(map(str.isupper, found)) / n
    signs = sum(1 for _ in SIGNS.finditer(text)) / n
    bars = (text.count(" | ") + text.count("\t") + text.count(";;")) / n
    stutter = sum(map(eq, found, found[1:])) / n
    variety = len({*found}) / n
    repeats = 1 - len({*lines}) / len(lines) if len(lines) > 1 else 0.0
    ends = sum(text.count(c) for c in (". ", ".\n", "! ", "? ", "!\n", "?\n")) / n
    return np.array([min(loud, 1), min(signs, 1), min(bars, 1), stutter, variety, repeats, min(ends, 1), n, len(text) / n])


def votes(m: np.ndarray, known: int | None) -> list[int]:
    """Of each labeller on a document: loud, signs, bars, stutter, variety, repeated lines, sentences, length, length of words, and a human label where there is one."""
    loud, signs, bars, stutter, variety, repeats, ends, n, length = m
    return [
        BAD if loud > 0.3 else GOOD if loud < 0.05 else UNSURE,
        BAD if signs > 0.3 else GOOD if signs < 0.02 else UNSURE,
        BAD if bars > 0.2 else GOOD if bars < 0.02 else UNSURE,
        BAD if stutter > 0.2 else GOOD if stutter < 0.03 else UNSURE,
        MISSING if n < 50 else BAD if variety < 0.1 else GOOD if variety > 0.3 else UNSURE,
        BAD if repeats > 0.5 else MISSING if n < 50 else GOOD if repeats < 0.1 else UNSURE,
        MISSING if n < 30 else GOOD if 0.02 < ends < 0.4 else BAD if ends < 0.004 else UNSURE,
        BAD if n < 8 else GOOD if n >= 50 else UNSURE,
        MISSING if n < 50 else BAD if length > 12 or length < 3.5 else GOOD if 4.5 < length < 9 else UNSURE,
        MISSING if known is None else GOOD if known else BAD,
    ]


#: For each kind of noise, the labellers that see it (numbers in ``votes``): loud, signs, lists, stutter, no sentences.
JUNK_KINDS = ((0,), (1,), (2,), (3, 4, 5), (6,))
JUNK_LABELLERS, HUMAN = 10, -1


def toxic_votes(insults: int, words: int, begun: tuple[int, int], known: int | None) -> list[int]:
    """Any insult, insults of a share, several of them, beginnings of words of two lexicons learned from labels, and a human label where there is one."""
    seen = [BAD if n > 1 and n > 0.005 * words else GOOD for n in begun]
    return [BAD if insults else GOOD, BAD if insults > 0.005 * words else UNSURE if insults else GOOD, BAD if insults > 2 else UNSURE if insults else GOOD, *seen, MISSING if known is None else BAD if known else GOOD]


#: Kinds of toxic text: by insults known beforehand, by beginnings of words learned from labels.
TOXIC_KINDS = ((0, 1, 2), (3,), (4,))
TOXIC_LABELLERS = 6


class LabelModel:
    """Dawid-Skene with a good class and several kinds of bad: each labeller's rates of saying good, bad or being unsure given the class, and the class shares, by EM over counted vote patterns.

    Noise comes in kinds that exclude each other, so each kind is a class of its own, which starts from the labellers that
    are meant for it. Being unsure is an outcome with rates of its own; only a labeller that cannot judge (a text too short, no human
    label) is left out. All rates are estimated: the prior is worth ``strength`` documents, no rate is held.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, kinds: tuple[tuple[int, ...], ...], rounds: int = 500, strength: float = 20.0):
        labellers = patterns.shape[1]
        prior = np.empty((1 + len(kinds), labellers, 3))  # good, bad, unsure
        prior[0] = 0.955, 0.005, 0.04
        for k, own in enumerate(kinds, 1):
            prior[k] = 0.92, 0.03, 0.05
            prior[k, list(own)] = 0.1, 0.8, 0.1
            prior[k, HUMAN] = 0.1, 0.85, 0.05
        share = np.array([0.9, *[0.1 / len(kinds)] * len(kinds)])
        self.rates, self.shares = prior, share
        said = np.stack([patterns == o for o in (GOOD, BAD, UNSURE)], axis=2).astype(float)
        weight = counts.astype(float)
        self.rounds = 0
        while self.rounds < rounds and len(patterns):
            p = self.classes(patterns)
            of = p * weight[:, None]
            self.shares = (of.sum(axis=0) + strength * share) / (weight.sum() + strength)
            counted = np.einsum("pc,pjo->cjo", of, said) + strength * prior
            self.rates = counted / counted.sum(axis=2, keepdims=True)
            self.rounds += 1
            if np.abs(self.classes(patterns) - p).max() < 1e-7:
                break

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class, good first."""
        said = np.stack([patterns == o for o in (GOOD, BAD, UNSURE)], axis=2).astype(float)
        odds = np.einsum("pjo,cjo->pc", said, np.log(self.rates)) + np.log(self.shares)
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of any of the bad classes."""
        return 1 - self.classes(patterns)[:, 0] if len(patterns) else np.empty(0)

    def accuracies(self) -> list[tuple[float, float]]:
        """Of each labeller: how often it says bad of a bad document (of any kind) and good of a good one, when it judges."""
        bad = self.shares[1:] / self.shares[1:].sum()
        return [(float(bad @ self.rates[1:, j, 1]), float(self.rates[0, j, 0])) for j in range(self.rates.shape[1])]


def lexicon(texts: list[tuple[bool, set[str]]]) -> tuple[frozenset[str], frozenset[str]]:
    """From rows (toxic, beginnings of words) of labelled documents: the beginnings that toxic documents hold far more often, dealt by a hash into two lexicons of which none tells what the other does."""
    counts, n = (Counter(), Counter()), [1, 1]
    for toxic, begun in texts:
        n[toxic] += 1
        counts[toxic].update(begun)
    found = {w for w, k in counts[1].items() if k >= 5 and k / n[1] > 12 * (counts[0][w] + 0.5) / n[0]}
    # a beginning of one that is found tells all that it does
    found = {w for w in found if not any(w[:k] in found for k in range(1, len(w)))}
    return tuple(frozenset(w for w in found if xxhash.xxh3_64_intdigest(w.encode()) % 2 == half) for half in (0, 1))


def beginnings(words: set[str]) -> set[str]:
    """Beginnings that two words at least share, each longer than it."""
    n = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) > k)
    return {w for w, k in n.items() if k > 1}


@lru_cache(256)
def _words_begun(found: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<![^\W\d_])({'|'.join(map(re.escape, found))})[^\W\d_]+")


def begun(low: str, lexicons: tuple[frozenset[str], frozenset[str]]) -> tuple[int, int]:
    """For each lexicon, how many distinct words of the lower-case text have the beginning of it that most of them have."""
    out = []
    for known in lexicons:
        found = tuple(w for w in sorted(known) if w in low)
        words = {(m[0], m[1]) for m in _words_begun(found).finditer(low)} if found else ()
        out.append(max(Counter(w for _, w in words).values(), default=0))
    return out[0], out[1]


class HashedLinear:
    """Logistic regression over hashed features by follow-the-regularised-leader; the L1 term leaves few weights."""

    def __init__(self, l1: float, l2: float = 1.0, alpha: float = 0.3, passes: int = 4):
        self.l1, self.l2, self.alpha, self.passes = l1, l2, alpha, passes

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3) -> HashedLinear:
        """rows: (bucket, value); bucket 0 is the constant. Without rows everything is of class 0."""
        z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        order = np.random.default_rng(seed)
        for _ in range(self.passes if rows else 0):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                w = self._weights(z[at], n[at], at)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - y[i]) * x
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - step * w
                n[at] += g * g
        if not rows:
            z[0], n[0] = 1e9, 1e-9
        at = np.flatnonzero(n)
        w = self._weights(z[at], n[at], at)
        w = np.clip(w, -20, 20)
        self.at, self.w = at[w != 0].astype(np.uint32), w[w != 0]
        return self

    def _weights(self, z: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((1 + np.sqrt(n)) / self.alpha + self.l2))

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.at] = self.w
        return out


def bucket(feature: str) -> int:
    return 1 + xxhash.xxh3_64_intdigest(feature.encode()) % (BUCKETS - 1)


CUTS = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
LENGTHS = np.array([1, 5, 20, 50, 100, 300, 1000, 5000])


def format_features(m: np.ndarray) -> np.ndarray:
    """Hashed: each measure over each threshold that it passes, and the class of length with the sentence share."""
    out = [0]
    for k in range(7):
        out += [bucket(f"m{k}>{j}") for j in range(int(np.searchsorted(CUTS, m[k], "right")))]
    size = int(np.searchsorted(LENGTHS, m[7], "right"))
    return np.array([*out, bucket(f"n{size}"), bucket(f"n{size}v{int(np.searchsorted(CUTS, m[4]))}")])


def word_features(word: str) -> list[str]:
    """The word and its beginnings of four to seven letters."""
    return [f"w {word}", *(f"p{k} {word[:k]}" for k in BEGINNINGS if len(word) >= k)]


class WordWeights:
    """Sum of a word's weights, remembered for the words and beginnings met; dropped and met anew when they are many."""

    def __init__(self, model: HashedLinear, most: int = 150_000):
        self.weights, self.most = dict(zip(model.at.tolist(), model.w.tolist(), strict=True)), most
        self.known: dict[str, float] = {}
        self.begun: dict[str, float] = {}

    def of(self, words: set[str]) -> float:
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > self.most:
                self.known, self.begun = {}, {}
            for word in words.difference(self.known):
                start = word[: BEGINNINGS[-1]]
                if (w := self.begun.get(start)) is None:
                    w = self.begun[start] = sum(self.weights.get(bucket(x), 0.0) for x in word_features(start)[1:])
                self.known[word] = w + self.weights.get(bucket(f"w {word}"), 0.0)
            return sum(map(self.known.__getitem__, words))


class QualityModel:
    """Fitted parts, small enough to send to workers: sparse weights of two scorers."""

    def __init__(self, form: HashedLinear, words: HashedLinear, junk: LabelModel, toxic: LabelModel):
        self.form, self.words, self.junk, self.toxic = form, words, junk, toxic

    def ready(self) -> QualityModel:
        if not hasattr(self, "form_table"):
            self.form_table, self.weights = self.form.table(), WordWeights(self.words)
            self.constant = self.weights.weights.get(0, 0.0)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("form_table", "weights", "constant")}

    def score(self, text: str) -> tuple[float, float]:
        """(quality, toxicity), probabilities."""
        if not text.strip():
            return 0.0, 0.0
        bad = self.form_table[format_features(measures(text))].sum()
        toxic = self.constant + self.weights.of({*LETTERS.findall(text.lower())})
        return float(1 / (1 + np.exp(np.clip(bad, -40, 40)))), float(1 / (1 + np.exp(-np.clip(toxic, -40, 40))))


VOTED_DDL = "doc_id long, junk string, toxic string, hash long"


def text_hash(text: str, doc_id: int | None) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=(doc_id or 0) & 0xFFFFFFFFFFFFFFFF)).view(np.int64))


def below(most: int, of: int) -> int:
    """The bound under which hashes of ``of`` rows lie for ``most`` of them, less a twentieth."""
    return min((1 << 63) - 1, -(1 << 63) + (19 * most << 64) // (20 * max(of, 1)))


def _learn_lexicon(rows: DataFrame, labels: DataFrame | None, sample: int) -> tuple[frozenset[str], frozenset[str]]:
    """Word beginnings of toxic documents by the labels, from a sample of the labelled documents chosen by a hash of the id."""
    if labels is None:
        return frozenset(), frozenset()
    told = labels.filter("toxic_label is not null and doc_id is not null").select("doc_id", "toxic_label", F.xxhash64("doc_id").alias("hash"))
    told = told.filter(F.col("hash") <= below(sample, told.count()))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ["\n".join(sorted(beginnings({*LETTERS.findall((t.as_py() or "").lower())}))) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.string())], names=["toxic", "begun"])

    found = rows.join(F.broadcast(told.select("doc_id", "toxic_label")), "doc_id").select((F.col("toxic_label") == 1).alias("toxic"), "text")
    found = found.mapInArrow(begin, "toxic boolean, begun string").toLocalIterator(prefetchPartitions=True)
    return lexicon([(r.toxic, {*r.begun.split("\n")} - {""}) for r in found])


def _voted(docs: DataFrame, labels: DataFrame | None, known: tuple[frozenset[str], frozenset[str]]) -> DataFrame:
    """doc_id, the votes on junk and on toxicity as digits, and a hash of text and id; null and blank texts have none."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                if not t or not t.strip():
                    continue
                low = t.lower()
                insults = sum(w in INSULTS for w in LETTERS.findall(low)) if any(map(low.__contains__, INSULTS)) else 0
                held = begun(low, known)
                m = measures(t)
                digits = ("".join(map(str, v)) for v in (votes(m, None), toxic_votes(insults, int(m[7]), held, None)))
                out.append((doc_id, *digits, text_hash(t, doc_id)))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "junk", "toxic", "hash"])

    voted = docs.mapInArrow(giving_back(vote), VOTED_DDL)
    if labels is None:
        return voted
    human = lambda c, good, bad: F.when(F.col(c) == good, str(GOOD)).when(F.col(c) == bad, str(BAD)).otherwise(str(MISSING))
    joined = voted.join(labels, "doc_id", "left")
    return joined.select("doc_id", F.concat(F.substring("junk", 1, JUNK_LABELLERS - 1), human("quality", 1, 0)).alias("junk"), F.concat(F.substring("toxic", 1, TOXIC_LABELLERS - 1), human("toxic_label", 0, 1)).alias("toxic"), "hash")


def _patterns(voted: DataFrame, column: str, labellers: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct vote patterns (at most four to the power of the labellers) and their counts."""
    rows = sorted((r[0], r[1]) for r in voted.groupBy(column).agg(F.count("*")).collect())
    return np.array([[int(c) for c in r[0]] for r in rows], np.int64).reshape(len(rows), labellers), np.array([r[1] for r in rows], np.int64), [r[0] for r in rows]


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", format_sample: int = FORMAT_SAMPLE, toxic_sample: int = TOXIC_SAMPLE, lexicon_sample: int = LEXICON_SAMPLE) -> QualityModel:
    """Vote on all documents, estimate the labellers from all votes (a count per pattern reaches the driver), fit the scorers on bounded samples.

    ``labels`` (the id, quality, toxic; a part of the documents) acts as one more labeller that is missing elsewhere, and
    tells the beginnings of words that two toxic labellers look for.
    The samples are the documents whose hash lies lowest, chosen by a threshold from the counts; what is broadcast is no larger.
    Null labels and ids tell nothing; of labels that repeat an id the worse one holds; without documents or labels all is held good.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if labels is not None:
        labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", F.col("toxic").alias("toxic_label")).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic_label").alias("toxic_label"))
        labels = scratch.keep(labels, "labels")
    voted = scratch.keep(_voted(rows, labels, _learn_lexicon(rows, labels, lexicon_sample)), "votes")
    junk_patterns, junk_counts, junk_names = _patterns(voted, "junk", JUNK_LABELLERS)
    toxic_patterns, toxic_counts, toxic_names = _patterns(voted, "toxic", TOXIC_LABELLERS)
    junk, toxic = LabelModel(junk_patterns, junk_counts, JUNK_KINDS), LabelModel(toxic_patterns, toxic_counts, TOXIC_KINDS)
    p_junk = dict(zip(junk_names, junk.posterior(junk_patterns).tolist(), strict=True))
    p_toxic = dict(zip(toxic_names, toxic.posterior(toxic_patterns).tolist(), strict=True))
    total, told = int(junk_counts.sum()), int(sum(n for p, n in zip(toxic_patterns, toxic_counts, strict=True) if BAD in p or p[HUMAN] != MISSING))
    chosen_form = voted.filter(F.col("hash") <= below(format_sample, total)).select("doc_id", "junk", F.lit("").alias("toxic"))
    able = F.col("toxic").contains(str(BAD)) | (F.substring("toxic", TOXIC_LABELLERS, 1) != str(MISSING))
    chosen_toxic = voted.filter(able & (F.col("hash") <= below(toxic_sample, told))).select("doc_id", F.lit("").alias("junk"), "toxic")
    chosen = chosen_form.union(chosen_toxic).filter("doc_id is not null").groupBy("doc_id").agg(F.max("junk").alias("junk"), F.max("toxic").alias("toxic"))
    chosen = scratch.keep(chosen, "chosen")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            junk_votes, toxic_votes_, form, word = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for j, t, text in zip(junk_votes, toxic_votes_, batch.column(2), strict=True):
                text = text.as_py() or ""
                form.append(format_features(measures(text)).astype("<u4").tobytes() if j else b"")
                got = [0]
                for w in {*LETTERS.findall(text.lower())} if t else ():
                    got += map(bucket, word_features(w))
                word.append(np.array(got, "<u4").tobytes())
            yield pa.record_batch([pa.array(junk_votes), pa.array(toxic_votes_), pa.array(form, pa.binary()), pa.array(word, pa.binary())], names=["junk", "toxic", "form", "word"])

    sample = rows.join(F.broadcast(chosen), "doc_id").select("junk", "toxic", "text").mapInArrow(features, "junk string, toxic string, form binary, word binary")
    form_rows, form_y, word_rows, word_y = [], [], [], []
    for r in sample.toLocalIterator(prefetchPartitions=True):
        if r.junk:
            at = np.frombuffer(r.form, "<u4")
            form_rows.append((at, np.ones(len(at), np.float32)))
            form_y.append(p_junk[r.junk])
        if r.toxic:
            at, n = np.unique(np.frombuffer(r.word, "<u4"), return_counts=True)
            word_rows.append((at, n.astype(np.float32)))
            word_y.append(p_toxic[r.toxic])
    form = HashedLinear(l1=0.5).fit(form_rows, np.array(form_y))
    words = HashedLinear(l1=1.5, alpha=0.2).fit(word_rows, np.array(word_y))
    return QualityModel(form, words, junk, toxic)


SCORED_DDL = "doc_id long, quality double, toxicity double, keep boolean"


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per document: quality, toxicity (0 to 1), keep (quality >= ``least`` and toxicity < ``least``).

    Null, empty and blank texts have quality 0 and are not kept; texts are read whole; repeated rows and null ids are scored each;
    an empty table gives no rows; other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.ready()
        for batch in batches:
            found = [model.score(t.as_py() or "") for t in batch.column(1)]
            quality, toxicity = np.array([f[0] for f in found]), np.array([f[1] for f in found])
            yield pa.record_batch([batch.column(0), pa.array(quality), pa.array(toxicity), pa.array((quality >= least) & (toxicity < least))], names=["doc_id", "quality", "toxicity", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(score), SCORED_DDL)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with all their columns, without the rows that the model rejects."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.ready()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [model.score(t.as_py() or "") for t in texts]
            yield batch.filter(pa.array([q >= least and t < least for q, t in found], pa.bool_()))

    return docs.mapInArrow(giving_back(sift), docs.schema)
