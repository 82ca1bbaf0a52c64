"""Extraction, language, quality, decontamination and the pipeline."""

import random
import re

import pandas as pd
import pytest

from lodestream.llm.decontam import MASKS, decontaminate, overlaps
from lodestream.llm.html_template import extract, main_text, parse
from lodestream.llm.langid import LanguageModel, identify, predict_languages, train
from lodestream.llm.quality import LabelModel, fit, keep_good, score_quality

SF = "/root/testdata/sf0.001"


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("<p>a&amp;b &lt; &eacute;&nbsp;c", "a&b < é c"), ("<p>one<p>two<br>three<div>four</div>", "one two three four"), ("x<b>y</b>z", "xyz"), ("<!-- no --><p>yes", "yes"),
        (page("<nav>menu</nav><header>head</header><article><h1>T</h1><p>body</p><aside>side</aside><form><input>f</form><div class='ad'>ad</div><section id=comments><p>c</p></section></article><footer>foot</footer>"), "T body"),
        (page("<div class='cookie-notice'>ok?</div><main><p>main text</p><ul class=menu><li>m</li></ul></main>"), "main text"),
        (page("<article><p>a <span style='display:none'>hidden</span> b</p><template><p>t</p></template></article>"), "a b"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p title=\"a>b\">q</p>", "q"), ("<p>open <b>bold", "open bold"), ("<script>x</script", ""), ("<p>a</p><style>p{}</style><p>b</p>", "a b"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>a<!--", "a"), ("<", "<"),
    ],
)
def test_blocks(source, text):
    assert main_text(source, None, None, None) == text


def test_hosts_without_an_article_element(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):
        text = " ".join(rng.choices(words, k=60))
        links = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rng.choices(words, k=5))
        body = f"<div class=x1><ul>{links}</ul></div><div class=x2><div class=x3><p>{text}</p><p>Always the same line.</p></div></div><div class=x4><p>About us {rng.choice(words)}</p></div>"
        rows.append((i, f"http://h.example/{i}", page(body), text))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, _, _, text in rows}


def test_copies_of_a_page_are_not_its_template(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(3)
    equal = page("<article><h1>Head</h1><p>The one text of this host.</p></article>")
    rows = [(i, "http://one.example/", equal) for i in range(10)]
    fixed = "<p>Always the same line.</p>"
    own = [" ".join(rng.choices(words, k=20)) for _ in range(12)]
    rows += [(100 + i, f"http://many.example/{i}", page(f"<nav>{rng.choice(words)}</nav><article><p>{own[max(0, i - 48)]}</p>{fixed}</article>")) for i in range(60)]
    near = [" ".join(rng.choices(words, k=20)) for _ in range(4)]
    rows += [(200 + i, f"http://near.example/{i}", page(f"<article><p>{near[0]}</p><p>{near[1]}</p><p>{near[2]} {i}</p></article>")) for i in range(20)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[200 + i] == f"{near[0]} {near[1]} {near[2]} {i}" for i in range(20))
    assert all(got[i] == "Head The one text of this host." for i in range(10))
    assert all(got[100 + i] == own[max(0, i - 48)] for i in range(60))


def test_the_template_chooses_the_text(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(20):
        text, more = say(60), say(50)
        rows += [
            # an article element that is a teaser; the text is elsewhere
            (i, "http://teaser.example/", page(f"<article><p>{say(6)}</p></article><div class=x><p>{text}</p><p>{more}</p></div><div class=y><p>{say(4)}</p></div>"), f"{text} {more}"),
            # names on the way to the text that would set it aside
            (100 + i, "http://form.example/", page(f"<form class=with-sidebar><div class=y><p>{say(4)}</p></div><div class=x><p>{text}</p><div class=ad>{say(3)}</div><p>{more}</p></div></form><div class=z>{say(3)}</div>"), f"{text} {more}"),
            # two layouts, each on half of the pages
            (200 + i, "http://two.example/", page(f"<div class={'ab'[i % 2]}><p>{text}</p><p>{more}</p></div><div class=y><p>{say(4)}</p></div>"), f"{text} {more}"),
            # repeated articles are all of the text
            (300 + i, "http://list.example/", page(f"<div class=y><p>{say(4)}</p></div>" + f"<article><p>{text}</p></article><article><p>{more}</p></article>"), f"{text} {more}"),
        ]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {i: text for i, _, _, text in rows}


@pytest.mark.parametrize("n", [2, 3, 5, 7, 8, 30])
def test_templates_of_hosts_of_any_size(spark, n):
    """Shapes without article elements or telling names: the deduced template alone finds the text, from two pages on."""
    rng = random.Random(n)
    say = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    shapes = {
        "plain": lambda text, more: f"<div><p>Home News About us</p></div><div><p>{text}</p><p>{more}</p></div><div><p>All rights kept by us</p></div>",
        "table": lambda text, more: f"<table><tr><td>Home News</td></tr><tr><td><div><p>{text}</p><p>{more}</p></div></td></tr><tr><td>Imprint</td></tr></table>",
        "classes": lambda text, more: f"<div class=q1><a href=/>one</a> <a href=/2>two</a></div><div class=q2><div class=q3><p>{text}</p></div><div class=q3><p>{more}</p></div></div><div class=q4>The end of it</div>",
        "list": lambda text, more: f"<div><ul><li><a href=/>one</a></li><li><a href=/x>two</a></li></ul></div><div><h1>{more}</h1><ul><li>{text}</li><li>{say(30)}</li></ul></div><div>same on all</div>",
        "quote": lambda text, more: f"<p>Welcome to our pages</p><section><blockquote><p>{text}</p></blockquote><p>{more}</p></section><p>Bye</p>",
        "deep": lambda text, more: "<div>" * 6 + f"<p>{text}</p><p>{more}</p>" + "</div>" * 6 + "<div><p>foot of the page</p></div>",
    }
    rows, want = [], {}
    for k, (name, shape) in enumerate(shapes.items()):
        for i in range(n):
            body = shape(say(40), say(25))
            rows.append((100 * k + i, f"http://{name}.example/{i}", page(body)))
            texts = re.findall(r"(?:w[0-9]+ ?)+", body)
            want[100 * k + i] = " ".join(t.strip() for t in texts)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_copies_of_a_page_keep_its_text(spark):
    article = page("<nav>menu</nav><article><p>The same article body.</p></article><footer>foot</footer>")
    other = [(100 + i, "http://h/", page(f"<nav>menu</nav><article><p>Another body number {i} of some length.</p></article><footer>foot</footer>")) for i in range(5)]
    rows = [(i, "http://h/", article) for i in range(40)] + other
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "The same article body." for i in range(40)) and got[103] == "Another body number 3 of some length."
    alone = extract(spark.createDataFrame(rows[:10], "page_id long, url string, html string")).collect()
    assert {r.text for r in alone} == {"The same article body."}


def test_pages_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "<p>a", 1), (None, "http://x/", None, 2), (1, None, "<p>a", 1)], "page_id long, url string, html string, n_chars int").withColumnRenamed("n_chars", "text")
    assert sorted((r.text, r.n_chars) for r in extract(df).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000, None, None, None) == "x"
    assert len(parse("<p>" + "a " * 200_000 + "</p>")[0]) == 1


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_spans_and_odd_texts(spark):
    en, de = "the house and the water of this people with their words ", "das haus und die strasse mit einem kleinen hund auf dem weg "
    df = spark.createDataFrame([(i, t * 20, lang) for i in range(6) for lang, t in (("en", en), ("de", de))] + [(100, "привет мир " * 20, "ru"), (101, "x", None)], "doc_id long, text string, lang string")
    model = train(df)
    mixed = en * 3 + de * 3
    spans = model.spans(mixed)
    assert [s[0] for s in spans] == ["en", "de"] and abs(spans[1][1] - len(en * 3)) < 25
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "Привет"), (4, "Привет"), (None, en), (5, de * 3000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.lang_pred) for r in predict_languages(odd, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "ru"), (4, "ru"), (None, "en"), (5, "de")], key=str)
    nothing = LanguageModel({}, {})
    assert nothing.predict("words")[0] == "und"
    assert predict_languages(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_path_is_the_best_of_all():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    model = LanguageModel({}, {}, penalty=3.0)

    def worth(s, path):
        return s[np.arange(len(s)), path].sum() - 3.0 * (np.diff(path) != 0).sum()

    for _ in range(150):
        s = rng.normal(0, 2, (7, 3)).astype(np.float32)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -6)
        most = max(worth(s, np.array(p)) for p in itertools.product(range(3), repeat=7))
        assert abs(worth(s, model.path(s)) - most) < 1e-5
    for _ in range(400):
        s = rng.normal(0, 2, (40, 5)).astype(np.float32)
        s = np.maximum(s - s.max(axis=1, keepdims=True), -6)
        s[:, 1] = np.minimum(s[:, 1] + rng.choice([0, 4]), 0)
        assert abs(worth(s, model.path(s)) - worth(s, model._recursion(s))) < 1e-4


def test_languages_that_tie(spark):
    text = "one two three four five "
    df = spark.createDataFrame([(i, text, lang) for i in range(4) for lang in ("b", "a")], "doc_id long, text string, lang string")
    model = train(df)
    assert model.predict(text)[0] == "a" and 0.4 < model.predict(text)[1] <= 0.51


def plain_em(patterns, counts, kinds, rounds, strength=20.0):
    """The same estimates document by document, without arrays."""
    n = len(patterns[0])
    prior = [[[0.955, 0.005, 0.04] for _ in range(n)]]
    for own in kinds:
        prior.append([[0.1, 0.8, 0.1] if j in own else [0.1, 0.85, 0.05] if j == n - 1 else [0.92, 0.03, 0.05] for j in range(n)])
    first = [0.9] + [0.1 / len(kinds)] * len(kinds)
    docs = [p for p, k in zip(patterns, counts) for _ in range(k)]  # noqa: B905
    rates, shares = prior, first

    def classes(p):
        likely = []
        for c, share in enumerate(shares):
            for j, o in enumerate(p):
                share *= rates[c][j][o - 1] if o else 1.0
            likely.append(share)
        return [x / sum(likely) for x in likely]

    for _ in range(rounds):
        of = [classes(p) for p in docs]
        new = []
        for c in range(len(shares)):
            new.append([])
            for j in range(n):
                said = [sum(q[c] for q, p in zip(of, docs) if p[j] == o) + strength * prior[c][j][o - 1] for o in (1, 2, 3)]  # noqa: B905
                new[c].append([x / sum(said) for x in said])
        shares = [(sum(q[c] for q in of) + strength * first[c]) / (len(docs) + strength) for c in range(len(shares))]
        rates = new
    return [1 - classes(p)[0] for p in patterns]


def test_label_model_equals_plain_em():
    import numpy as np

    patterns = [[1, 1, 1, 0], [2, 1, 1, 0], [1, 2, 1, 2], [1, 1, 2, 1], [0, 0, 3, 0], [3, 1, 1, 0], [2, 1, 1, 1], [2, 1, 1, 2], [1, 2, 0, 0]]
    counts = [300, 20, 15, 9, 4, 12, 2, 6, 11]
    kinds = ((0,), (1, 2))
    for rounds in (1, 2, 7):
        got = LabelModel(np.array(patterns), np.array(counts), kinds, rounds=rounds)
        assert got.rounds == rounds
        assert np.abs(got.posterior(np.array(patterns)) - plain_em(patterns, counts, kinds, rounds)).max() < 1e-9


def test_label_model_learns_which_labellers_to_trust():
    import numpy as np

    rng = np.random.default_rng(6)
    bad = rng.random(4000) < 0.1
    kind = rng.integers(0, 2, 4000)
    say = lambda hit, alarm: np.where(rng.random(4000) < np.where(hit, 0.9, alarm), 2, 1)
    seen = np.stack([say(bad & (kind == 0), 0.01), say(bad & (kind == 1), 0.01), say(bad, 0.3), np.where(rng.random(4000) < 0.3, np.where(bad, 2, 1), 0)], axis=1)
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    model = LabelModel(patterns, counts, ((0,), (1,)))
    p = dict(zip(map(tuple, patterns), model.posterior(patterns), strict=True))
    told = np.array([p[tuple(r)] >= 0.5 for r in seen])
    any_bad = (seen == 2).any(axis=1)
    assert (told == bad).mean() > 0.97 > 0.8 > (any_bad == bad).mean()
    accuracies = model.accuracies()
    assert abs(accuracies[2][1] - 0.7) < 0.05 and accuracies[3][1] > 0.97


def test_quality_on_labels_left_out_of_training(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.filter("doc_id % 2 = 0")
    scored = score_quality(docs, fit(docs, seen)).toPandas().merge(labels.filter("doc_id % 2 = 1").toPandas(), on="doc_id")
    good = scored[(scored.quality_y == 1) & (scored.toxic == 0)]
    assert good.keep.mean() > 0.98
    assert (scored[scored.quality_y == 0].quality_x < 0.5).mean() > 0.95
    assert (scored[scored.toxic == 1].toxicity >= 0.5).mean() > 0.9


def test_quality_of_odd_rows(spark):
    prose = "This is a sentence of some words. It goes on for a while, and then it ends. "
    rows = [(i, prose * 3 + f"Number {i} says so. ") for i in range(40)] + [(100 + i, "LOUD!! NOISE!! " * 20) for i in range(10)] + [(200, None), (201, ""), (202, " \n"), (None, prose * 4), (0, prose * 3), (203, prose * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS keep", "'k' AS quality")
    model = fit(df)
    got = pd.DataFrame([r.asDict() for r in score_quality(df, model).collect()])
    assert len(got) == len(rows) and not got[got.doc_id.between(100, 202)].keep.any() and got[got.doc_id < 40].keep.all()
    kept = keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == int(got.keep.sum())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_quality(empty, fit(empty)).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_substituted_passages_are_found(spark):
    changed = list(ITEM)
    changed[3], changed[9], changed[15] = "X", "Y", "Z"
    filler = [f"f{i}" for i in range(50)]
    rows = [(1, " ".join(filler + ITEM + filler)), (2, " ".join(filler + changed).upper()), (3, " ".join(filler + ITEM[:6] + filler)), (4, None), (5, ""), (6, " ".join(ITEM[5:] + filler)), (7, "alpha beta gamma"), (None, " ".join(ITEM)), (1, " ".join(filler + ITEM + filler)), (8, " ".join(filler * 2000 + ITEM))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id", "2 AS h")
    bench = spark.createDataFrame([(10, " ".join(ITEM)), (11, None), (12, "too short"), (10, " ".join(ITEM))], "item_id long, text string").selectExpr("*", "'d' AS doc_id")
    got = {(r.doc_id, r.item_id): (r.n_match, r.n_words, r.first_at) for r in overlaps(docs, bench).collect()}
    assert got == {(1, 10): (20, 20, 50), (2, 10): (17, 20, 50), (6, 10): (15, 20, -5), (8, 10): (20, 20, 100_000)}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 4, 5, 7, None], key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert overlaps(docs, none).count() == 0 and decontaminate(docs, none).count() == len(rows)


def plain_overlaps(docs, items):
    """All diagonals, no seeds."""
    import re

    cut = lambda t: [w for w in re.split(r"[!-/:-@\\[-`{-~\t-\r ]+", (t or "").lower()) if w]
    out = {}
    for i, text in docs:
        d = cut(text)
        for j, item in items:
            b = cut(item)
            for start in range(1 - len(b), len(d)) if b else ():
                places = [k for k in range(len(b)) if 0 <= start + k < len(d) and d[start + k] == b[k]]
                close = any(places[x + 16] - places[x] < 24 for x in range(len(places) - 16))
                if len(places) >= max(-(-3 * len(b) // 5), min(len(b), 7)) or close:
                    n, _, first = out.get((i, j), (0, 0, start))
                    out[i, j] = (max(n, len(places)), len(b), min(first, start))
    return out


def test_overlaps_equal_all_diagonals(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [(j, " ".join(rng.choices(words, k=n))) for j, n in enumerate([1, 3, 7, 8, 9, 12, 16, 20, 30, 45, 59])] + [(50, None), (51, "?!"), (52, "w1 w2, W3")]
    docs = []
    for i in range(120):
        text = rng.choices(words, k=rng.choice([3, 20, 80]))
        source = rng.choice(items[:11])[1].split()
        part = [w if rng.random() < 0.85 else "other" for w in source]
        docs.append((i, " ".join(text[:10] + part + text[10:])))
    docs += [(900, None), (901, ""), (902, "w1 W2 w3!"), (903, items[3][1])]
    got = {(r.doc_id, r.item_id): (r.n_match, r.n_words, r.first_at) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_overlaps(docs, items)
    assert len(want) > 100 and {k: v for k, v in want.items() if k[1] in (0, 1, 2, 52)} == {k: v for k, v in got.items() if k[1] in (0, 1, 2, 52)}
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("n", [8, 10, 12, 16, 20, 30, 59])
def test_masks_carry_the_rule(n):
    """At the least agreement that counts, nine in ten placements of the agreeing tokens hold a seed."""
    need = max(-(-3 * n // 5), min(n, 7))
    rng = random.Random(n)
    hits = 0
    for _ in range(2000):
        agree = {*rng.sample(range(n), need)}
        hits += any(all(at + o in agree for o in mask) for mask in MASKS for at in range(n - mask[-1]))
    assert hits >= 0.97 * 2000


def test_decontamination_runs_no_python(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = overlaps(docs, bench)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == start
            now = {r.doc_id for r in docs.select("doc_id").collect()}
            assert kept is None or now <= kept
            kept = now
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_stages_against_brute_force(spark):
    """The fitted stages: each document judged or redacted one by one, in plain Python, with the same fitted model."""
    import corpus_pipeline
    from lodestream.llm.pii import train as train_spans

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    model, rows = fit(docs, labels).ready(), docs.collect()
    kept = {r.doc_id for r in rows if r.text and r.text.strip() and (s := model.score(r.text))[0] >= 0.5 and s[1] < 0.5}
    assert 0 < len(kept) < len(rows) and {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == kept

    spans = train_spans(docs)

    def redacted(text):
        out = text
        for kind, start, end in sorted(spans.spans(text), key=lambda s: (-s[1], s[2])):
            if not any(a < end and start < b and (a, -b) < (start, -end) for _, a, b in spans.spans(text)):
                out = out[:start] + f"[{kind.upper()}]" + out[end:]
        return out

    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    for r in rows:
        found = spans.spans(r.text or "")
        if all(a[2] <= b[1] for a, b in zip(found, found[1:])):  # noqa: RUF007
            want = redacted(r.text) if r.text else r.text
            assert got[r.doc_id] == (want, None if want is None else len(want))
    assert sum("[EMAIL]" in (t or "") for t, _ in got.values()) > 0


def test_stages_of_empty_and_odd_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    odd = [(None, None, None, None, None), (1, None, "en", None, 3), (1, "", None, "s", None), (2, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11)]
    odd = spark.createDataFrame(odd, docs.schema).selectExpr("*", "1 AS row", "2 AS text_key", "3 AS component")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, SF)
        n = out.count()
        assert n == {"near_duplicates": 5, "decontamination": 6, "personal_data": 6, "packing": 6}[name]


@pytest.mark.parametrize(("shell", "n", "holding"), [("<article>{}</article>", 2, 2), ("<article>{}</article>", 7, 7), ("<article>{}</article>", 10, 9), ("<div>{}</div>", 10, 9)])
def test_a_paragraph_that_pages_share_stays(spark, shell, n, holding):
    from lodestream.llm.html_template import extract

    body = lambda i: f"<h1>Title {i}</h1>" + ("<p>a shared quotation</p>" if i < holding else "") + f"<p>the own paragraph of page {i}, which nobody else has</p>"
    pages = [(i, "http://x.example/a", f"<html><body>{shell.format(body(i))}<div class='legal'>All rights reserved by the publisher</div></body></html>") for i in range(n)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(n):
        assert f"the own paragraph of page {i}," in got[i] and ("a shared quotation" in got[i]) == (i < holding) and got[i].startswith(f"Title {i}")
        assert "All rights reserved" not in got[i]
