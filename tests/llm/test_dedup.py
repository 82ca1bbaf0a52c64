"""Near-duplicates of texts and of vectors against brute force."""

import itertools
import random

import numpy as np

from lodestream.llm.common import Scratch, words
from lodestream.llm.components import components
from lodestream.llm.embeddings import near_vectors, table_plan
from lodestream.llm.minhash import drop_near_duplicates, near_duplicates, sketch_matches, sketch_of

TEXTS = "doc_id long, text string"


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in classes(sets, linked).items()}


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == brute(rows)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([4, 9, 11, 60, 200]))
        rows.append(text)
        for _ in range(rng.randint(0, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.6, 1)))]
            rows.append(copy)
        if base % 3 == 0:
            rows.append(passage + rng.choices(vocabulary, k=40))
    rng.shuffle(rows)
    return [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(rows)]


def test_texts_equal_brute_force(spark):
    check(spark, corpus())


def test_odd_texts(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d e"), (7, "A  b\nC d E"), (8, "é É"), (9, "É é"), (10, "x y " * 20000), (11, "x y " * 20000 + "z")])


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (None, "a b c d e f", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").withColumnRenamed("n_shingles", "component_id")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)], key=str)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, None, None]


def test_rows_of_one_id_and_unlike_texts_lose_no_text(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b)], TEXTS)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False)]
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()) == [(3, a), (5, b)]
    near = "a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(5, near), (5, near + " z"), (5, near), (5, b), (5, b), (6, ""), (6, "")], TEXTS)
    kept = sorted((r.doc_id, r.text[:1]) for r in drop_near_duplicates(df).collect())
    assert kept == [(5, "a"), (5, "q"), (6, ""), (6, "")]


def test_a_column_of_any_name_passes(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8)], "doc_id long, text string, text_key int, row int")
    assert [tuple(r) for r in drop_near_duplicates(df).collect()] == [(1, "a b c d e f", 5, 6)]


def test_a_hub_with_many_copies(spark, monkeypatch):
    from lodestream.llm import common

    monkeypatch.setattr(common, "HUB_ROWS", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(90):
        copy = list(base)
        copy[rng.randrange(80)] = f"x{rng.randrange(3000)}"
        rows.append((i, " ".join(copy)))
    check(spark, rows)


def test_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sketch_counts_equal_coordinates(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 32, 64, dtype=np.uint32), rng.integers(0, 1 << 32, 64, dtype=np.uint32)
    b[:20] = a[:20]
    df = spark.createDataFrame([(sketch_of(a).tolist(), sketch_of(b).tolist())], "a array<long>, b array<long>")
    assert df.select(sketch_matches("a", "b", 64)).first()[0] == int(((a & 15) == (b & 15)).sum()) >= 20


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + i, 501 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == classes(sorted(ids), [e for e in edges if e[0] != e[1]])


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    rows = [v for b in base for v in (b, b + 0.2 * rng.standard_normal(32), b + 0.42 * rng.standard_normal(32))] + [base[0] * 3, base[1]]
    x = np.array(rows, np.float32)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32, [1.0] * 8]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"), miss=1e-6).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    linked = [(int(a), int(b)) for a, b in zip(*np.nonzero(d @ d.T >= 0.9), strict=True) if a != b]
    want = classes(range(len(x)), linked)
    assert {i: got[i] for i in want} == {i: (sum(a == i for a, _ in linked), c) for i, c in want.items()}
    assert all(got[1000 + i] == (0, 1000 + i) for i in range(len(odd)))


def vector_truth(data):
    """(id, n_links, component) of each row by all pairs of valid rows."""
    able = [k for k, (i, v) in enumerate(data) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    units = {k: np.array(data[k][1]) / np.linalg.norm(data[k][1]) for k in able}
    linked = [(a, b) for a, b in itertools.combinations(able, 2) if len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    of = classes(range(len(data)), linked)
    low = {}
    for k, c in of.items():
        low[c] = min(low.get(c, data[k][0]), data[k][0]) if data[k][0] is not None else None
    n = [sum(k in e for e in linked) for k in range(len(data))]
    return sorted(((i, n[k], low[of[k]]) for k, (i, _) in enumerate(data)), key=str)


def test_dense_groups_equal_brute_force(spark, monkeypatch):
    from lodestream.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(8)
    data = []
    for base in rng.standard_normal((4, 24)):
        for noise in (0.05, 0.12, 0.25, 0.35):
            data += [(base + noise * rng.standard_normal(24)).tolist() for _ in range(15)]
    data += data[:9] + [data[3]] * 5
    data = [(k * 17 % 401, v) for k, v in enumerate(data)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), miss=1e-7).collect()]
    assert sorted(got, key=str) == vector_truth(data)


def test_repeated_ids_and_invalid_rows_keep_all_rows(spark):
    x = [1.0, 2.0, 3.0]
    data = [(1, x), (1, None), (1, [0.0] * 3), (2, x), (2, [None, 1.0, 1.0]), (None, x), (None, None), (4, [3.0, -1.0, 0.0])]
    got = near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == vector_truth(data)
    assert all(r.kept for r in got if r.vec_id is None or r.component_id == r.vec_id)


def test_tables_grow_with_the_logarithm():
    (b1, t1), (b2, t2) = table_plan(10_000, 0.9, 1e-3), table_plan(100_000_000, 0.9, 1e-3)
    assert b2 - b1 == 13 or b2 - b1 == 14
    assert t1 < t2 < 20 * t1
