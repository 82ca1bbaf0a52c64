"""Views by signed changes, nearest rows, text search and samples against plain Python: nulls, ties, hot keys, repeated rows, empty tables, broken batches."""

import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestream.operators import nearest as nearest_module
from lodestream.operators.incremental import JoinView, changes
from lodestream.operators.nearest import nearest
from lodestream.operators.sampling import draw, merge, sample_state
from lodestream.operators.text_index import TextIndex, literals

LEFT, RIGHT = "ok long, status string", "lk long, price decimal(12,2), q long"


def view_of(spark, path):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    return JoinView(spark, path, left.schema, right.schema, ("ok", "lk"), {"status": F.col("status")}, {"price": F.col("price"), "q": F.col("q")}, parts=6)


def full(left, right):
    groups = {}
    for ok, status in left:
        for lk, price, q in right:
            if ok is not None and ok == lk:
                groups.setdefault(status, []).append((price, q))
    total = lambda values: sum(v for v in values if v is not None) if any(v is not None for v in values) else None
    return {s: (total([p for p, _ in g]), total([q for _, q in g]), len(g)) for s, g in groups.items()}


def test_view_follows_random_changes(spark, tmp_path):
    rng = random.Random(3)
    view = view_of(spark, str(tmp_path / "view"))
    left, right = [], []
    new_left = lambda: (rng.choice([None, 1, 1, 1, *range(2, 9)]), rng.choice([None, "a", "b", "c"]))
    new_right = lambda: (rng.choice([None, 1, 1, 1, *range(2, 9)]), rng.choice([None, Decimal(rng.randrange(-999, 999)) / 100]), rng.choice([None, *range(5)]))
    assert view.read().collect() == []
    for batch in range(4):
        told = {}
        for name, rows, new, schema in (("left", left, new_left, LEFT), ("right", right, new_right, RIGHT)):
            gone = rng.sample(rows, len(rows) // 3)
            come = [new() for _ in range(12)] + gone[:2]  # repeated rows, and rows that go and come at once
            for r in gone:
                rows.remove(r)
            rows += come
            told[name] = changes(spark.createDataFrame(come, schema), spark.createDataFrame(gone, schema))
        assert view.apply(batch, **told)
        assert not view.apply(batch, **told)
        assert {r.status: (r.price, r.q, r.n) for r in view.read().collect()} == full(left, right)
    assert view.vacuum() > 0
    assert {r.status: (r.price, r.q, r.n) for r in view.read().collect()} == full(left, right)


def test_view_rewrites_what_changed_and_empties(spark, tmp_path):
    view = view_of(spark, str(tmp_path / "view"))
    rows = [(i, f"s{i}") for i in range(40)]
    lines = [(i, Decimal(i), 1) for i in range(40)]
    view.apply(0, changes(spark.createDataFrame(rows, LEFT)), changes(spark.createDataFrame(lines, RIGHT)))
    before = view._manifest()
    view.apply(1, right=changes(spark.createDataFrame([(7, Decimal(1), 1)], RIGHT)))
    after = view._manifest()
    assert after["left"] == before["left"]
    assert [sum(before[t][p] != f for p, f in after[t].items()) for t in ("right", "states")] == [1, 1]
    view.apply(2, changes(deleted=spark.createDataFrame(rows, LEFT)))
    assert view.read().collect() == [] and view._manifest()["left"] == {} == view._manifest()["states"]


def test_view_survives_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    view = view_of(spark, str(tmp_path / "view"))
    told = [changes(spark.createDataFrame([(1, "a"), (2, "b")], LEFT)), changes(spark.createDataFrame([(1, Decimal(5), 1), (2, None, 3)], RIGHT))]
    view.apply(0, *told)
    seen = sorted(view.read().collect())
    more = changes(spark.createDataFrame([(1, Decimal(2), 1)], RIGHT))
    with monkeypatch.context() as m:
        m.setattr(JoinView, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            view.apply(1, right=more)
    assert sorted(view.read().collect()) == seen  # nothing of it is visible
    assert view.apply(1, right=more)
    assert {r.status: (r.price, r.q, r.n) for r in view.read().collect()} == {"a": (Decimal(7), 2, 2), "b": (None, 3, 1)}


def test_view_refuses_what_it_cannot_take_back(spark, tmp_path):
    view = view_of(spark, str(tmp_path / "view"))
    with pytest.raises(Exception, match="not in left"):
        view.apply(0, changes(deleted=spark.createDataFrame([(1, "a")], LEFT)))
    left, right = spark.createDataFrame([], LEFT).schema, spark.createDataFrame([], "lk long, v double").schema
    with pytest.raises(ValueError):
        JoinView(spark, str(tmp_path / "v"), left, right, ("ok", "lk"), {}, {"v": F.col("v")})


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_all_pairs(spark, monkeypatch, small, k):
    monkeypatch.setattr(nearest_module, "SMALL_BLOCKS", small)
    rng = random.Random(k)
    value = lambda: None if rng.random() < 0.05 else math.nan if rng.random() < 0.05 else 3.0 if rng.random() < 0.4 else float(rng.randrange(-20, 20))
    left, right = [(i, value()) for i in range(120)], [(i % 50, value()) for i in range(60)]
    got = {}
    for r in nearest(spark.createDataFrame(left, "a long, x double").repartition(3), spark.createDataFrame(right, "b long, y double").repartition(3), "x", "y", "b", k).collect():
        got.setdefault(r.a, []).append((r["rank"], r.distance, r.neighbour))
    usable = [(b, y) for b, y in right if y is not None and not math.isnan(y)]
    want = {a: [(i + 1, d, b) for i, (d, b) in enumerate(sorted((abs(y - x), b) for b, y in usable)[:k])] for a, x in left if x is not None and not math.isnan(x)}
    assert {a: sorted(v) for a, v in got.items()} == want


def test_nearest_of_few_and_none(spark):
    left, right = spark.createDataFrame([(1, 5.0)], "a long, x double"), spark.createDataFrame([(9, 1.0)], "b long, y double")
    assert [(r.neighbour, r.distance) for r in nearest(left, right, "x", "y", "b", 3).collect()] == [(9, 4.0)]
    assert nearest(left, right.limit(0), "x", "y", "b", 3).collect() == [] == nearest(left.limit(0), right, "x", "y", "b", 3).collect()


PATTERNS = {
    "a": ("like", "%River_bank%"), "b": ("ilike", "%rIVER%"), "c": ("rlike", r"colou?r [0-9]{2,}"), "d": ("like", "%100\\%%"), "e": ("ilike", "%kelvin%"), "f": ("like", "ab"), "g": ("rlike", "(cat|dog)"), "h": ("ilike", "%straße%"), "i": ("rlike", r"x[abc]+yz\.w"),
    "j": ("ilike", "%i̇stan%"), "k": ("like", "%"), "l": ("like", "%zzzz%"), "m": ("like", "%\U0001f600ab%"),
}
WORDS = ["River bank", "riverbank", "RIVER", "color 12", "colour 345", "colo", "100%", "100x", "Kelvin", "ab", "dog", "STRASSE", "Straße", "xabyz.w", "xyzw", "İstan", "\U0001f600ab", "", " "]


def test_search_equals_a_scan(spark):
    rng = random.Random(8)
    rows = [(i % 90, rng.choice([None, *[" ".join(rng.choices(WORDS, k=n)) for n in (0, 1, 1, 2, 30)]])) for i in range(200)] + [(None, "ab"), (5, "a b" * 40_000 + "River bank")]
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    index = TextIndex.build(df, "body")
    out = index.search(PATTERNS).collect()
    got = sorted(((r.pattern, r.id) for r in out if r.matched), key=str)
    want = []
    for name, (kind, p) in PATTERNS.items():
        c = F.col("body")
        want += [(name, r.id) for r in df.filter({"like": c.like, "ilike": c.ilike, "rlike": c.rlike}[kind](p)).collect()]
    assert got == sorted(want, key=str)
    looked = {n: sum(r.pattern == n for r in out) for n in PATTERNS}
    assert looked["l"] == 0 and looked["b"] < len(rows) and looked["k"] == sum(b is not None for _, b in rows)


def test_search_of_no_rows(spark):
    index = TextIndex.build(spark.createDataFrame([], "id long, body string"), "body")
    assert index.search({"a": ("like", "%abc%"), "b": ("like", "%")}).collect() == []


def test_literals_of_expressions_are_in_every_match():
    rng = random.Random(1)
    pieces = ["abc", "a", " ", "b?", "c*", "d+", "[xyz]", "[^q]", r"\d", r"\.", "e{0,2}", "f{2}", ".", "gh", "^", r"[\]a]", "[]a]"]
    for _ in range(3000):
        p = "".join(rng.choices(pieces, k=rng.randrange(1, 6)))
        text = re.sub(r"\^", "", p)
        for t in ("abc", "abcdffgh", "aabcx1.ghe", text, "a1.", "aaabc dddff", " ab]gh", "]a", "x.gh"):
            if re.search(p, t):
                assert all(r in t.lower() for r in literals("rlike", p)), (p, t)
    assert literals("rlike", "(?i)abc") == literals("rlike", "abc|def") == literals("rlike", r"\x41bc") == []
    assert literals("like", "%a\\%b_cd%") == ["a%b", "cd"] and literals("rlike", "version [0-9]+") == ["version "]


def test_samples_have_exact_sizes_and_merge(spark):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else "ab"[i % 2], float(i % 7)) for i in range(3000)] + [(9000, "few", 1.0), (9001, "few", None), (9002, "few", -1.0), (9003, "few", math.nan)]
    df = spark.createDataFrame(rows, "id long, g string, w double").repartition(5)
    for weight in (None, F.col("w")):
        whole = sorted(map(tuple, draw(sample_state(df, ["id"], 40, ["g"], weight), 40, ["g"]).collect()))
        parts = [sample_state(df.filter(F.col("id") % 3 == i), ["id"], 40, ["g"], weight) for i in range(3)]
        merged = sorted(map(tuple, draw(merge([merge(parts[:2], ["id"], 40, ["g"]), parts[2]], ["id"], 40, ["g"]), 40, ["g"]).collect()))
        assert repr(whole) == repr(merged)
        sizes = {g: sum(r[1] == g for r in whole) for g in (None, "hot", "a", "b", "few")}
        assert sizes == {None: 40, "hot": 40, "a": 40, "b": 40, "few": 4 if weight is None else 1}


def test_totals_are_without_bias(spark):
    df = spark.range(2000).select("id", (F.pmod(F.hash("id"), F.lit(100)) + 1).cast("double").alias("w"))
    total, odd = 2000 * 50.5, df.filter("id % 2 = 1").agg(F.sum("w")).first()[0]
    found = []
    for seed in range(12):
        s = draw(sample_state(df, ["id"], 150, weight=F.col("w"), seed=seed), 150).agg(F.sum("stands_for"), F.sum(F.when(F.col("id") % 2 == 1, F.col("stands_for"))), F.count("*")).first()
        assert s[2] == 150 and abs(s[0] / total - 1) < 0.25
        found.append(s[1])
    assert abs(sum(found) / len(found) / odd - 1) < 0.06


def test_sample_of_no_rows(spark):
    assert draw(sample_state(spark.createDataFrame([], "id long"), ["id"], 3), 3).collect() == []


def test_a_batch_is_dealt_once(spark, tmp_path, monkeypatch):
    """The rows of a side are netted and written as one shuffle deals them."""
    plans, write = {}, JoinView._write

    def note(self, manifest, name, folder, rows, parts):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        write(self, manifest, name, folder, rows, parts)

    monkeypatch.setattr(JoinView, "_write", note)
    left, right = spark.createDataFrame([(1, "a")], "ok long, status string"), spark.createDataFrame([(1, 2), (1, 3)], "lk long, v long")
    v = JoinView(spark, str(tmp_path / "once"), left.schema, right.schema, ("ok", "lk"), {"status": F.col("status")}, {"v": F.col("v")}, parts=2)
    v.apply(1, changes(left), changes(right))
    assert [tuple(r) for r in v.read().collect()] == [("a", 5, 2)]
    assert all(plans[side].count("Exchange") == 1 for side in ("left", "right"))
