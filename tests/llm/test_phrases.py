"""Collocations against counters of all phrases."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang in f:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * found[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def ours(spark, rows, least, top, parts=5):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "text string, lang string, word string, n int").repartition(parts)
    return sorted(map(tuple, phrases.collocations(df, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("seed", range(2))
def test_equals_counters_over_many_shards(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "SHARD_TOKENS", 50)
    monkeypatch.setattr(phrases, "BLOCK_POSITIONS", 7)
    rng = random.Random(seed)
    rows = [("".join(rng.choice(["a ", "b ", "C\t", "dé ", ". ", "e", "\n", "a b c "]) for _ in range(rng.randint(0, 40))) if rng.random() < 0.9 else None, rng.choice(["x", "y", None])) for _ in range(200)]
    assert ours(spark, rows, 5, 20) == brute(rows, 5, 20)


def test_one_lang_and_one_passage_hold_most_rows(spark):
    rows = [("the very same words again and again here", "en")] * 300 + [(f"word{i} of", "en") for i in range(200)] + [("", "en"), (None, None), ("!?", "de")]
    assert ours(spark, rows, 100, 50) == brute(rows, 100, 50)


def test_shared_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_IDS", 0)
    rows = [("a b c a b, c a b", "x"), ("b c a", "y")] * 10
    assert ours(spark, rows, 5, 9) == brute(rows, 5, 9)


def test_no_rows_and_no_phrases(spark):
    assert ours(spark, [], 1, 5, 1) == [] == ours(spark, [("a b", "x")], 2, 5, 1)


def test_bitmaps_come_back_from_their_bytes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, m, k)) for m, k in ((5, 3), (300, 40), (1 << 33, 50), (1, 1))]
    starts = np.cumsum([0, *map(len, sets[:-1])])
    data, ends = phrases.compress(np.concatenate(sets), starts)
    maps = [data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    positions, sizes = phrases.expand([*maps, b""])
    assert positions.tolist() == np.concatenate(sets).tolist() and sizes.tolist() == [*map(len, sets), 0]


def shuffled(spark, what="shuffleWriteBytes"):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def test_bitmaps_stay_where_they_are_written(spark):
    rng = random.Random(3)
    rows = [(" . ".join(f"w{rng.randrange(60)}" for _ in range(5000)) + " ! a b c", "x") for _ in range(60)]
    before = shuffled(spark)
    assert len(ours(spark, rows, 50, 5, 2)) == 1
    whole = sum(len(r[0]) for r in rows)  # dealing the rows out shuffles them once
    held = shuffled(spark) - before
    spark.createDataFrame([(*r, "clash", 0) for r in rows], "text string, lang string, word string, n int").repartition(2).write.format("noop").mode("overwrite").save()
    dealt = shuffled(spark) - before - held
    assert whole > dealt and held - dealt < 60 * 5000 / 4


def test_rows_written_follow_what_is_counted_not_the_shards_that_hold_it(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_TOKENS", 100)
    keep, rows = phrases.Scratch.keep, {}

    def counting(scratch, df, name, **options):
        out = keep(scratch, df, name, **options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(phrases.Scratch, "keep", counting)
    rng = random.Random(4)
    texts = [(" ".join(rng.choice("abcdefgh") for _ in range(100)), "x") for _ in range(10)]
    sums = []
    for times in (1, 5):
        rows.clear()
        found = ours(spark, texts * times, 5 * times, 20, 1)
        assert found == brute(texts * times, 5 * times, 20)
        sums.append((rows.pop("shards"), sum(rows.values())))
    assert sums[0][0] == 10 and sums[1][0] == 50 and sums[0][1] == sums[1][1]


def test_words_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(phrases, "xxhash", SimpleNamespace(xxh3_64_intdigest=len))
    known = pa.table({"gid": [5, 6, 7, 8], "lang": ["x", "y", "x", "x"], "word": ["ab", "ab", "cd", "é"]})
    files = [phrases.store_words(known.slice(0, 3)), phrases.store_words(known.slice(3))]
    assert phrases.find_words(files, "x", pa.array(["cd", "ef", "ab", "é", "a", "long"])).tolist() == [7, 0, 5, 8, 0, 0]
    assert phrases.find_words(files, "y", pa.array(["cd", "ab"])).tolist() == [0, 6] and phrases.find_words([], "y", pa.array(["ab"])).tolist() == [0]


def test_what_is_known_lies_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WORDS_A_FILE", 2)
    monkeypatch.setattr(phrases, "PAIRS_A_FILE", 2)
    rows = [("a b c a b, c a b d e f a", "x"), ("b c a d e", "y"), ("a b c d e", None)] * 10
    assert ours(spark, rows, 5, 9) == brute(rows, 5, 9)


@pytest.mark.parametrize("bits", (3, 12))
def test_a_sieve_of_few_cells_loses_no_phrase(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "CELL_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_CELLS", 1 << 10)
    monkeypatch.setattr(phrases, "CELL_LOAD", 1)
    rng = random.Random(bits)
    rows = [(" ".join(rng.choice("abcde") for _ in range(30)), rng.choice(["x", "y"])) for _ in range(100)]
    assert ours(spark, rows, 9, 300) == brute(rows, 9, 300)
    assert ours(spark, rows, 300, 300) == brute(rows, 300, 300)


def test_rare_phrases_of_frequent_pairs_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(400)) + " . u v w x y", "x") for _ in range(100)]
    before = shuffled(spark, "shuffleWriteRecords")
    assert ours(spark, rows, 50, 500, 2) == brute(rows, 50, 500)
    assert shuffled(spark, "shuffleWriteRecords") - before < 20_000
