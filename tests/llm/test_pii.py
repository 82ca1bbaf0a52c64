"""Personal data: the rules against plain regular expressions, the model on planted cases, redaction."""

import hashlib
import random
import re
import time

import pytest

from lodestream.llm import pii
from lodestream.llm.pii import ORDER, SpanModel, Taken, candidates, find_pii, join_spans, luhn, redact, rule_spans

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


@pytest.fixture(scope="module")
def model():
    return SpanModel("the of and is onand thwh ou, that. est der die la de que".split())


def test_rules_equal_plain_expressions():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("a@.-+ 1234567890()%_é@.12\n") for _ in range(rng.randint(0, 40)))
        assert rule_spans(text) == brute(text), repr(text)


@pytest.mark.parametrize("few", [0, 48])
def test_windows_by_arrays_and_one_by_one_are_the_same(monkeypatch, few):
    """Candidates and features of arrays against the plain functions of one span."""
    rng = random.Random(8)
    parts = ["1", "23", "456", "7890", " ", "-", "(", ")", "+", ".", "/", "a", "call ", "card ", "é", "٣", "\n", "= ", "4918187128635271"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        base, taken = rule_spans(text), Taken(rule_spans(text))
        runs = [m.span() for m in pii.DIGIT_RUN.finditer(text) if m.end() - m.start() >= 9]
        want = sorted((s for s in pii._windows(text, runs) if not taken.meets(s[1], s[2], s[0])), key=lambda s: (s[1], s[2], s[0]))
        monkeypatch.setattr(pii, "FEW_GROUPS", few)
        found = {(pii.KINDS[k], a, b): x.tolist() for kind, start, end, rows in pii.described(text, base) for k, a, b, x in zip(kind.tolist(), start.tolist(), end.tolist(), rows, strict=True)}
        assert candidates(text, base) == sorted(found, key=lambda s: (s[1], s[2], s[0])) == want
        assert all(found[s] == pii.features(text, s) for s in want)


def test_long_texts_take_linear_time(model):
    start = time.time()
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000, "a@" * 100_000, "+1 " * 60_000, "1 " * 100_000, "1:" * 100_000, "(at) " * 40_000):
        model.spans(text)
    assert time.time() - start < 30


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call +1 (578) 555-6437 4918187128635271 now", [("phone", 5, 22), ("card", 23, 39)]),
        ("of 4451718024887799 27.65.93.188 Arrr", [("card", 3, 19), ("ip", 20, 32)]),
        ("write to jo.doe (at) example (dot) org now", [("email", 9, 38)]),
        ("ISBN 978-3-1234-1234-5 the", []),
        ('token = "8824c3a463b8b0d68516db48c461547d5799bf8b" and', []),
        ("the 2019-11-12 10:20:33 of", []),
        ("", []),
    ],
)
def test_added_spans(model, text, want):
    assert model.spans(text) == want


def test_many_real_spans_take_linear_time(model):
    """Twice the spans in about twice the time."""
    took = []
    for n in (4000, 8000):
        text = " ".join(f"call +1 (578) 555-{i % 9000 + 1000} or 10.{i % 200}.3.4, ana{i}@ex.org, 212-555-{i % 9000 + 1000}" for i in range(n))
        start = time.time()
        spans = model.spans(text)
        took.append(time.time() - start)
        assert sum(s[0] == "phone" for s in spans) >= n and sum(s[0] == "email" for s in spans) == n
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]) if (a[0], a[1]) != (b[0], b[1]))  # noqa: RUF007
    assert took[1] < 4 * took[0] + 1


def test_numbers_of_many_groups_are_candidates(model):
    text = "phone 5 5 5 1 2 3 4 5 6 7 and mail jo (at) a (dot) b1 (dot) c1 (dot) d1 (dot) e1 (dot) org"
    found = candidates(text, [])
    assert ("phone", 6, 25) in found
    assert ("email", text.index("jo"), len(text)) in found and ("email", text.index("jo"), text.index(" (dot) c1")) in found


def test_overlap_look_up_equals_all_pairs():
    rng = random.Random(4)
    for _ in range(2000):
        base, at = [], 0
        for kind in ("card", "phone"):
            at = 0
            while at < 60:
                at += rng.randint(0, 9)
                end = at + rng.randint(1, 9)
                base.append((kind, at, end))
                at = end
        a = rng.randint(0, 60)
        b, kind = a + rng.randint(1, 12), rng.choice(["card", "phone", "ip"])
        assert Taken(base).meets(a, b) == any(a < y and x < b for _, x, y in base)
        assert Taken(base).meets(a, b, kind) == any(a < y and x < b and (k == kind or (x, y) != (a, b)) for k, x, y in base)


def test_base_spans_stay(model):
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("a@.-+ 1234567890()") for _ in range(60))
        assert set(rule_spans(text)) <= set(model.spans(text))


def test_operator_and_redaction(spark, model):
    rows = [(1, "mail a.b@c.de or 10.0.0.1", "x"), (2, None, "y"), (None, "", None), (3, "clean text", "z"), (3, "clean text", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in find_pii(df, model=model).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:5:13,ip:17:25")
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:13,ip:17:25").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = redact(df, model=model)
    assert clean.columns == df.columns and sorted((r.text or "-" for r in clean.collect())) == ["-", "-", "clean text", "clean text", "mail [EMAIL] or [IP]"]
    assert {r.doc_id: r.text for r in clean.collect()}[1] == "mail [EMAIL] or [IP]" and {r.doc_id: r.text for r in clean.collect()}[2] is None


def test_training_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(df).count() == 0 and redact(df).count() == 0
    assert join_spans([]) == ""
