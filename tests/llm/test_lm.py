import math
import os
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestream.llm import lm
from lodestream.llm.lm import Counts, Table, get, mixed, pack, put, score_documents, small, table_of, unmixed, unpack

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, order):
    """The model by dictionaries of words."""
    tokens = {i: [*((text or "").encode().lower().split()), "</s>"] for i, (_, text) in enumerate(rows)}
    held = {i: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for i, (d, _) in enumerate(rows)}
    uni, grams = Counter(), [None, None, Counter(), Counter()]
    for i, t in tokens.items():
        if not held[i]:
            uni.update(t)
            grams[2].update(zip(["<s>", *t], t))
            grams[3].update(zip(["<s>", *t], t, t[1:]))
    n, v = sum(uni.values()), len(uni)

    def off(counts):
        c = Counter(counts)
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        out = [0.0]
        for j in (1, 2, 3):
            d = j - (j + 1) * y * c[j + 1] / c[j] if c[j] else j / 2
            out.append(d if 0 < d < j else j / 2)
        return out

    pair = grams[2]
    if order == 3:
        before = Counter((b, c) for _, b, c in grams[3])
        pair = Counter({g: k if g[0] == "<s>" else before[g] for g, k in grams[2].items()})
    follow = Counter(w for _, w in grams[2])
    d1 = off(follow.values())
    rest = sum(d1[min(c, 3)] for c in follow.values()) / max(1, len(grams[2])) / (v + 1) if grams[2] else 1 / (v + 1)
    p1 = lambda w: max(follow[w] - d1[min(follow[w], 3)], 0) / max(1, len(grams[2])) + rest
    levels = []
    for counts in (pair, grams[3]):
        d, context, left = off(counts.values()), Counter(), defaultdict(float)
        for g, c in counts.items():
            context[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        levels.append((counts, d, context, left))

    def p(history, w):
        if not history:
            return p1(w)
        counts, d, context, left = levels[len(history) - 1]
        lower = p(history[1:], w)
        c = counts[*history, w]
        return (max(c - d[min(c, 3)], 0) + left[history] * lower) / context[history] if context[history] else lower

    if grams[2]:
        for history in [(), *list(levels[0][2])[:5], *(list(levels[1][2])[:5] if order == 3 else [])]:
            assert math.isclose(sum(p(history, w) for w in uni) + p(history, "an unknown word"), 1, rel_tol=1e-9)
    for i, t in tokens.items():
        history = ["<s>", *t]
        likely = sum(math.log10(p(tuple(history[max(0, k + 2 - order) : k + 1]), w)) for k, w in enumerate(t))
        yield (held[i], len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), likely)


def check(spark, rows, order):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = [tuple(r) for r in score_documents(df, order=order).collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute(rows, order))]
    key = lambda r: (r[0] is None, r[0] or 0, r[2:5], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert np.allclose(g[5:], w[5:], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_the_plain_model(spark, order):
    table = pq.read_table(DOCS, columns=["doc_id", "text"])
    check(spark, list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())), order)


@pytest.mark.parametrize("order", [2, 3])
def test_odd_rows(spark, order):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, " \t\n"), (None, "b a"), (5, "É é A a " * 3000), (6, "the the the a b c"), (7, "the a"), (8, "x")]
    check(spark, rows, order)


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_held_out(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.held_out and math.isfinite(r.score) for r in got)


def test_spread_is_one_to_one():
    rng = np.random.default_rng(1)
    for span in (12, 45, 63):
        keys = rng.integers(0, 1 << span, 1000, dtype=np.uint64)
        assert (unmixed(mixed(keys, span), span) == keys).all() and (mixed(keys, span) < 1 << span).all()


def test_tables_and_counts_hold_what_they_were_given():
    rng = np.random.default_rng(2)
    for span, n in ((6, 20), (14, 0), (33, 5000), (45, 3000)):
        keys = np.unique(np.r_[rng.integers(0, 1 << span, n, dtype=np.uint64), rng.integers(0, min(1 << span, 300), n, dtype=np.uint64)])
        array, order = table_of(keys, span)
        table = Table(array, span)
        assert (table.keys() == keys[order]).all() and (table.keys(np.arange(len(keys))) == keys[order]).all()
        at, there = table.find(keys)
        assert there.all() and (keys[order][at] == keys).all()
        other = np.setdiff1d(rng.integers(0, 1 << span, 200, dtype=np.uint64), keys)
        assert not table.find(other)[1].any()
        if len(keys):
            assert (unpack(pack(1, keys, keys % 7))[0] == keys).all() and (unpack(pack(1, keys, keys % 7))[1] == keys % 7).all()
    n = np.array([1, 255, 3, 254, 70_000, 0, 1 << 40])
    held = Counts(*small(n))
    assert (held.all() == n).all() and (held.of(np.array([4, 0, 1])) == [70_000, 1, 255]).all()


def test_parts_left_by_lost_tasks_are_not_read(tmp_path):
    (tmp_path / "words-00001.3fa9").write_bytes(b"x" * 40)
    put(f"{tmp_path}/words-00001", np.arange(3, dtype=np.uint64))
    put(f"{tmp_path}/words-00001", np.arange(3, dtype=np.uint64))
    assert get(f"{tmp_path}/words-00001")[0].tolist() == [0, 1, 2] and get(f"{tmp_path}/words-00002") == []


@pytest.mark.parametrize("most", [None, 40])
def test_a_model_of_more_files_than_may_be_open(tmp_path, monkeypatch, most):
    """Each bucket has seven files: at some thousand buckets a worker maps more than it may open."""
    if most:
        monkeypatch.setattr(lm, "MAPPED", most)
    layout = lm.Layout(str(tmp_path), 6, 0, 1)
    for k in range(300):
        put(f"{tmp_path}/words-{k:05d}", np.array([k], np.uint64))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 100, hard))
    try:
        for _ in range(2):
            assert [int(layout.arrays(f"words-{k:05d}")[0][0]) for k in range(300)] == list(range(300))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(layout.files) == (most or 300)
