"""Personal data: rule spans, further candidate spans scored by boosted trees, and redaction."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.boosting import BoostedTrees
from lodestream.llm.common import giving_back, ship

KINDS = ("email", "ip", "card", "phone")
ORDER = {kind: k for k, kind in enumerate(KINDS)}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A possessive run and the look-behind keep long runs of digits linear; neither changes which spans match.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
GROUP = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d += d - 9 if d > 4 else d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, ``@`` and dotted domain, in linear time.

    A match holds one ``@``, so it starts where the run of local characters before it does.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def rule_spans(text: str) -> list[Span]:
    """The base spans, by start, then kind as in KINDS."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if text.count(".") > 2:
            for m in IP.finditer(text):
                if all(int(part[-400:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m[0].split(".")):
                    found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return found


# --- candidates that the rules miss -------------------------------------------------------------

#: The possessive runs and the look-behind keep long runs linear.
SPOKEN_EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]) ?[A-Za-z0-9-]{2,}+)+")
AT = re.compile(r"[^\[({<]*+[\[({<][^\])}>]*+[\])}>] ?[A-Za-z0-9-]++")
LABEL = re.compile(r"(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]) ?[A-Za-z0-9-]{2,}+")
DIGIT_RUN = re.compile(r"[+(]?[0-9](?:[\x20().\x2d/]{0,2}[0-9])+")
COLON_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
CUES = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "login", "from"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "ruf", "appel", "llam"),
}
AGAINST = ("isbn", "issn", "version", "token", "password", "sha", "md5", "key", "order", "id", "doi", "page", "no.", "ref", "date", "uuid")


class Taken:
    """Spans kept by kind and place: those of one kind do not overlap, so both ends are in order and a look-up is a bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: dict[str, list[int]] = {k: [] for k in (*KINDS, "added")}
        self.ends: dict[str, list[int]] = {k: [] for k in self.starts}
        for kind, a, b in spans:
            self.starts[kind].append(a)
            self.ends[kind].append(b)

    def add(self, a: int, b: int) -> None:
        """A span that overlaps none."""
        at = bisect_left(self.starts["added"], a)
        self.starts["added"].insert(at, a)
        self.ends["added"].insert(at, b)

    def meets(self, a: int, b: int, but: str | None = None) -> bool:
        """Whether [a, b) overlaps a span; spans equal to it are passed over unless of the kind ``but``, where that is named."""
        for kind, starts in self.starts.items():
            ends = self.ends[kind]
            at = bisect_right(ends, a)
            if at < len(starts) and starts[at] < b and (but is None or kind == but or (starts[at], ends[at]) != (a, b)):
                return True
        return False


def _spoken(text: str) -> list[Span]:
    """Spelt-out mail addresses and colon-separated ip numbers."""
    out: set[Span] = set()
    if ("at" in text or "AT" in text or "@" in text) and any(c in text for c in "[({<"):
        for m in SPOKEN_EMAIL.finditer(text):
            out.update(("email", m.start(), x.end()) for x in LABEL.finditer(text, AT.match(text, m.start()).end(), m.end()))
    if text.count(":") > 1:
        out.update(("ip", m.start(), m.end()) for m in COLON_IP.finditer(text) if m[0].count(":") == 7 or "::" in m[0])
    return [*out]


MOST_DIGITS = 19  # of a card number, the longest kind
GROUPS_AT_ONCE = 4096  # groups of digits whose windows are described together


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags))


class _Characters:
    """A text's characters as arrays: properties are asked once for each distinct character."""

    def __init__(self, text: str):
        self.text = text
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, self.which = np.unique(self.points, return_inverse=True)
        self.kinds = [chr(c) for c in kinds.tolist()]
        digit = (self.points >= 48) & (self.points <= 57)
        value = np.where(digit, self.points.astype(np.int64) - 48, 0)
        self.n_digits = _sums(digit)
        # of Luhn sums: each digit plain or doubled, by the parity of its place among all digits
        odd = (self.n_digits[:-1] % 2).astype(bool)
        double = np.where(value > 4, 2 * value - 9, 2 * value)
        self.luhn = [[_sums(np.where(digit & (odd == parity), v, 0)) for v in (value, double)] for parity in (False, True)]
        self.value = value
        self.count = {c: _sums(self.points == ord(c)) for c in "().- /"}
        self.n_any_digits = _sums(self.has(str.isdigit))

    def has(self, asked) -> np.ndarray:
        return np.array([bool(asked(c)) for c in self.kinds], bool)[self.which]

    def passes_luhn(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = (self.n_digits[end] - 1) % 2
        between = lambda sums: sums[end] - sums[start]
        total = np.where(last == 1, between(self.luhn[1][0]) + between(self.luhn[0][1]), between(self.luhn[0][0]) + between(self.luhn[1][1]))
        return total % 10 == 0


class _Base:
    """Base spans of each kind in order, to ask for overlaps of whole arrays."""

    def __init__(self, base: list[Span]):
        self.of = [(k, *np.array(found).T) for k in KINDS if (found := [(a, b) for x, a, b in base if x == k])]

    def meets(self, kind: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether spans of a kind overlap a base span; one equal to a base span of another kind passes that."""
        out = np.zeros(len(start), bool)
        for k, starts, ends in self.of:
            at = np.searchsorted(ends, start, "right")
            near = np.minimum(at, len(starts) - 1)
            meets = (at < len(starts)) & (starts[near] < end)
            out |= meets if k == kind else meets & ~((starts[near] == start) & (ends[near] == end))
        return out


def _context(text: str, start: int) -> tuple[float, float, float]:
    last = text[max(0, start - 40) : start].lower().split()[-3:]
    near = " ".join(last)
    return (*(float(any(c in w for w in last for c in CUES[k])) for k in ("card", "phone")), float(any(a in near for a in AGAINST)))


def _numbers(text: str, base: list[Span], describe: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Candidates for cards and phones, windows of up to MOST_DIGITS digits over the groups of a run: (kind, start, end, features), a bounded number at a time.

    All windows over a stretch of groups are made together; what depends on all of a window (its longest group, its distinct signs) accumulates from the shorter windows.
    """
    runs = [(m.start(), m.end()) for m in DIGIT_RUN.finditer(text) if m.end() - m.start() >= 9]
    if not runs:
        return
    chars, taken = _Characters(text), _Base(base)
    groups = np.array([(g.start(), g.end(), k) for k, (a, b) in enumerate(runs) for g in GROUP.finditer(text, a, b)], np.int64)
    first_of_run = np.array([a for a, _ in runs], np.int64)
    points = np.append(chars.points, 0)
    names: dict[str, int] = {}
    whole = [names.setdefault(text[a:b], len(names)) for a, b in zip(groups[:-1, 1].tolist(), groups[1:, 0].tolist(), strict=True)]
    sign = np.array([*whole, -1], np.int64)  # between a group and the next one
    lead_of = groups[:, 0].copy()
    for _ in range(3):
        may = lead_of > first_of_run[groups[:, 2]]
        before = points[np.maximum(lead_of - 1, 0)]
        lead_of = np.where(may & ((before == 43) | (before == 40)), lead_of - 1, lead_of)
    lead_sign = np.array([names.get(text[a:b], -2) if a < b else -1 for a, b in zip(lead_of.tolist(), groups[:, 0].tolist(), strict=True)], np.int64)
    plus = (groups[:, 0] > 0) & (points[np.maximum(groups[:, 0] - 1, 0)] == 43)
    if describe:
        alnum, space = chars.has(str.isalnum), chars.has(str.isspace)
        among = lambda signs: chars.has(lambda c: c in signs)
        quoted, joined, goes_on, ends = among("\"'=#_"), among(".-/,"), among("-/_%"), among(".,;!?)")
        known: dict[int, tuple[float, float, float]] = {}
    for g0 in range(0, len(groups), GROUPS_AT_ONCE):
        part = groups[g0 : g0 + GROUPS_AT_ONCE + MOST_DIGITS]
        n_first = min(GROUPS_AT_ONCE, len(groups) - g0)
        size = part[:, 1] - part[:, 0]
        signs = sign[g0 : g0 + len(part)]
        previous, seen = np.full(len(part), -1, np.int64), {}
        for k, x in enumerate(signs.tolist()):
            previous[k] = seen.get(x, -1)
            seen[x] = k
        # a row for each first group, a column for each number of groups; what a window takes over from shorter ones accumulates along the row
        first = np.arange(n_first)[:, None]
        width = int(np.bincount(part[:, 2] - part[0, 2]).max(initial=1))
        last = first + np.arange(min(MOST_DIGITS, width))
        there = last < len(part)
        last = np.minimum(last, len(part) - 1)
        there &= part[last, 2] == part[first, 2]
        sizes = np.where(there, size[last], MOST_DIGITS + 1)
        total = np.cumsum(sizes, axis=1)
        longest, shortest = np.maximum.accumulate(sizes, axis=1), np.minimum.accumulate(sizes, axis=1)
        steps = np.arange(last.shape[1]) > 0
        kinds_of_sign = np.cumsum(steps & (previous[last - 1] < first), axis=1)
        led = np.logical_or.accumulate(steps & (signs[last - 1] == lead_sign[g0 + first]), axis=1)
        fits = np.nonzero(total <= MOST_DIGITS)
        last, total, longest, shortest, kinds_of_sign, led = (x[fits] for x in (last, total, longest, shortest, kinds_of_sign, led))
        first, w = fits[0], fits[1] + 1
        begin, end, lead = part[first, 0], part[last, 1], lead_of[g0 + first]
        right = chars.passes_luhn(begin, end)
        balanced = chars.count["("][end] - chars.count["("][lead] == chars.count[")"][end] - chars.count[")"][lead]
        for kind, yes, start in (("card", (total >= 12) & right, begin), ("phone", (total >= 9) & (total <= 15) & ((w > 1) | plus[g0 + first]) & balanced, lead)):
            yes = np.flatnonzero(yes)
            yes = yes[~taken.meets(kind, start[yes], end[yes])]
            if not len(yes):
                continue
            a, b, f, z = start[yes], end[yes], first[yes], last[yes]
            if not describe:
                yield np.full(len(yes), ORDER[kind]), a, b, None
                continue
            for k in a.tolist():
                if k not in known:
                    known[k] = _context(text, k)
            context = np.array([known[k] for k in a.tolist()])
            inside = lambda c: (chars.count[c][b] > chars.count[c][a]).astype(float)  # noqa: B023, E731
            previous_at, next_at, has_previous, has_next = np.maximum(a - 1, 0), np.minimum(b, len(text) - 1), a > 0, b < len(text)
            lead_new = (a < part[f, 0]) & ~led[yes]
            x = np.column_stack([
                *(np.full(len(a), float(kind == k)) for k in KINDS),
                b - a, total[yes], w[yes], longest[yes], shortest[yes], size[f], size[z],
                right[yes], chars.points[a] == 43, inside("("), inside("."), inside("-"), inside(" "), inside("/"),
                kinds_of_sign[yes] + lead_new, chars.value[part[f, 0]], has_previous & alnum[previous_at], has_next & alnum[next_at], has_previous & quoted[previous_at], has_previous & joined[previous_at], has_next & goes_on[next_at],
                ~has_previous | space[previous_at], ~has_next | space[next_at] | ends[next_at], chars.n_any_digits[a] - chars.n_any_digits[np.maximum(a - 12, 0)], chars.n_any_digits[np.minimum(b + 12, len(text))] - chars.n_any_digits[b],
                context[:, 0 if kind == "card" else 1], context[:, 2], np.zeros(len(a)), inside("."),
            ]).astype(float)
            yield np.full(len(yes), ORDER[kind]), a, b, x
        if describe and len(known) > 4 * GROUPS_AT_ONCE:
            known.clear()


FEW_GROUPS = 48  # groups of digits of a text up to which windows are taken one by one: arrays pay for more


def _windows(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    """The spans of ``_numbers``, one by one."""
    for low, high in runs:
        groups = [g.span() for g in GROUP.finditer(text, low, high)]
        for i, (start, _) in enumerate(groups):
            lead, n = start, 0
            while lead > low and text[lead - 1] in "+(":
                lead -= 1
            for j in range(i, len(groups)):
                end = groups[j][1]
                n += end - groups[j][0]
                if n > MOST_DIGITS:
                    break
                if n >= 12 and luhn(NOT_DIGIT.sub("", text[start:end])):
                    yield "card", start, end
                if 9 <= n <= 15 and (j > i or text[max(0, start - 1) : start] == "+") and text.count("(", lead, end) == text.count(")", lead, end):
                    yield "phone", lead, end


def _few(text: str, base: list[Span]) -> tuple[list[Span], bool]:
    """Candidates that are found one by one, and whether these are all."""
    runs = [m.span() for m in DIGIT_RUN.finditer(text) if m.end() - m.start() >= 9]
    few = sum(high - low for low, high in runs) <= 2 * FEW_GROUPS or sum(1 for low, high in runs for _ in GROUP.finditer(text, low, high)) <= FEW_GROUPS
    found = _spoken(text) + ([*_windows(text, runs)] if few else [])
    if found and base:
        taken = Taken(base)
        found = [s for s in found if not taken.meets(s[1], s[2], s[0])]
    return found, few


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of high recall that overlap each other and no base span of their kind."""
    found, few = _few(text, base)
    for kind, start, end, _ in () if few else _numbers(text, base, describe=False):
        found += zip([KINDS[k] for k in kind.tolist()], start.tolist(), end.tolist(), strict=True)
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def described(text: str, base: list[Span]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The candidates with their features: (kind, start, end, features), a bounded number at a time."""
    found, few = _few(text, base)
    for i in range(0, len(found), SCORED):
        part = found[i : i + SCORED]
        yield np.array([ORDER[s[0]] for s in part]), np.array([s[1] for s in part]), np.array([s[2] for s in part]), np.array([features(text, s) for s in part])
    if not few:
        yield from _numbers(text, base)


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context; numbers alone."""
    kind, start, end = span
    body = text[start:end]
    groups = [len(g) for g in GROUP.findall(body)]
    digits = NOT_DIGIT.sub("", body)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    last = left.lower().split()[-3:]
    near = " ".join(last)
    return [
        *(float(kind == k) for k in KINDS),
        len(body), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(luhn(digits)) if digits else 0.0, float(body[:1] == "+"), float("(" in body), float("." in body), float("-" in body), float(" " in body), float("/" in body),
        len(set(NOT_DIGIT.findall(body))), float(digits[:1] or 0), float(before.isalnum()), float(after.isalnum()), float(before in ('"', "'", "=", "#", "_")), float(before in (".", "-", "/", ",") and before != ""), float(after in ("-", "/", "_", "%") and after != ""),
        float(before.isspace() or not before), float(after.isspace() or not after or after in ".,;!?)"), sum(c.isdigit() for c in left[-12:]), sum(c.isdigit() for c in right[:12]),
        float(any(w.startswith(c) or c in w for w in last for c in CUES[kind])), float(any(a in near for a in AGAINST)), float("::" in body), float("dot" in body.lower() or "." in body),
    ]


# --- training examples ---------------------------------------------------------------------------


def _number(rng: np.random.Generator, n: int, first: str = "123456789") -> str:
    return str(rng.choice(list(first))) + "".join(map(str, rng.integers(0, 10, n - 1)))


def _card(rng: np.random.Generator) -> str:
    body = _number(rng, 15, "3456")
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _phone(rng: np.random.Generator) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4, "0123456789")
    return [f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+{rng.integers(1, 99)}-{a}-{b}-{c}"][rng.integers(6)]


def _example(rng: np.random.Generator, words: list[str]) -> tuple[str, list[Span]]:
    """A text of corpus words with true spans and decoys, and its true spans."""
    parts: list[str] = []
    true: list[Span] = []

    def say(n: int) -> None:
        parts.extend(words[k] for k in rng.integers(0, len(words), n))

    def put(kind: str | None, body: str) -> None:
        start = len(" ".join(parts)) + (len(parts) > 0)
        parts.append(body)
        if kind:
            true.append((kind, start, start + len(body)))

    say(int(rng.integers(1, 6)))
    for _ in range(int(rng.integers(1, 4))):
        roll = int(rng.integers(0, 16))
        if roll == 0:
            put("phone", _phone(rng))
        elif roll == 1:
            put("phone", f"+1 ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}")
            put("card", _card(rng))
        elif roll == 2:
            put("card", _card(rng))
            put("ip", ".".join(str(x) for x in rng.integers(1, 255, 4)))
        elif roll == 3:
            card = _card(rng)
            put("card", str(rng.choice([" ", "-", "."])).join(card[i : i + 4] for i in range(0, 16, 4)))
        elif roll == 4:
            name = "".join(rng.choice(list("abcdefgh"), 6))
            put("email", [f"{name} [at] mail{rng.integers(9)} [dot] com", f"{name}(at)example.org", f"{name} (at) example (dot) net"][rng.integers(3)])
        elif roll == 5:
            put("ip", ":".join(format(int(x), "x") for x in rng.integers(4096, 65536, 8)))
        elif roll == 6:
            put("card", _card(rng))
            put("phone", _phone(rng))
        elif roll == 7:
            put(None, f"{rng.integers(1900, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)} {rng.integers(10, 23)}:{rng.integers(10, 59)}:{rng.integers(10, 59)}")
        elif roll == 8:
            put(None, 'token = "' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"')
        elif roll == 9:
            put(None, "ISBN " + f"978-{rng.integers(1, 9)}-{_number(rng, 4)}-{_number(rng, 4)}-{rng.integers(0, 9)}")
        elif roll == 10:
            put(None, " ".join(_number(rng, int(rng.integers(1, 5))) for _ in range(int(rng.integers(3, 9)))))
        elif roll == 11:
            put(None, "order " + _number(rng, int(rng.integers(9, 19))))
        elif roll == 12:
            put(None, ".".join(str(x) for x in rng.integers(0, 40, int(rng.integers(5, 7)))))
        elif roll == 13:
            put(None, f"{_number(rng, 3)}.{_number(rng, 3)}.{_number(rng, 3)},{rng.integers(10, 99)} / {_number(rng, 3)}.{_number(rng, 3)}")
        elif roll == 14:
            put(None, "".join(rng.choice(list("0123456789abcdef"), 8)) + "-" + _number(rng, 4) + "-" + _number(rng, 4) + "-" + _number(rng, 12))
        else:
            put(None, "password=" + "".join(rng.choice(list("0123456789abcdef"), 18)))
        say(int(rng.integers(1, 5)))
    return " ".join(parts), true


SCORED = 8192  # candidates found one by one of a text whose features are held at once


class SpanModel:
    """Boosted trees over candidate spans with a threshold per kind set for precision on examples held out of training."""

    def __init__(self, words: list[str], examples: int = 6000, precision: float = 0.98, seed: int = 5):
        rng = np.random.default_rng(seed)
        words = [w for w in words if not DIGIT.search(w) and "@" not in w] or ["word"]
        x: list[list[np.ndarray]] = [[], []]
        y: list[list[bool]] = [[], []]
        kinds: list[str] = []
        for i in range(examples):
            text, true = _example(rng, words)
            held = i % 3 == 0
            rows = [(KINDS[k], a, b, f) for kind, start, end, found in described(text, rule_spans(text)) for k, a, b, f in zip(kind.tolist(), start.tolist(), end.tolist(), found, strict=True)]
            for *span, f in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
                x[held].append(f)
                y[held].append(tuple(span) in true)
                if held:
                    kinds.append(span[0])
        self.trees = BoostedTrees().fit(np.array(x[0]), np.array(y[0], float))
        scores, truth, of = self.trees.score(np.array(x[1])), np.array(y[1]), np.array(kinds)
        self.least = {}
        for kind in KINDS:
            s, t = scores[of == kind], truth[of == kind]
            order = np.argsort(-s, kind="stable")
            good = np.flatnonzero(np.cumsum(t[order]) >= precision * np.arange(1, len(s) + 1))
            self.least[kind] = max(0.5, float(s[order][good[-1]])) if len(good) else 2.0

    def spans(self, text: str) -> list[Span]:
        """Base spans and the added ones: by score, none that overlaps another chosen one."""
        base = rule_spans(text)
        if not (DIGIT.search(text) or "@" in text or "at" in text):
            return base
        least = np.array([self.least[k] for k in KINDS])
        good = []
        for kind, start, end, x in described(text, base):
            score = self.trees.score(x)
            good += [(-v, a, b, KINDS[k]) for v, a, b, k, yes in zip(score.tolist(), start.tolist(), end.tolist(), kind.tolist(), (score >= least[kind]).tolist(), strict=True) if yes]
        if not good:
            return base
        chosen, taken = list(base), Taken(base)
        for _, a, b, kind in sorted(good):
            if not taken.meets(a, b):
                chosen.append((kind, a, b))
                taken.add(a, b)
        return sorted(chosen, key=lambda s: (s[1], ORDER[s[0]], s[2]))


CONTEXT_DOCS = 64  # documents, the first by a hash of the text in as many classes of it, whose words surround the training examples
CONTEXT_LENGTH = 30  # characters from which on a word is no context word
CONTEXT_WORDS = 100  # words of each such document, those of the lowest hashes


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Fit on generated examples in the words of a bounded sample of documents (CONTEXT_DOCS, CONTEXT_WORDS of each); without any text, of one word."""
    rows = docs.select(F.col(text_col).cast("string").alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    # hashes alone are aggregated, and the texts of those chosen read again
    chosen = [r.h for r in rows.groupBy(F.pmod("h", F.lit(CONTEXT_DOCS))).agg(F.min("h").alias("h")).collect()]
    hashed = F.transform(F.array_distinct(F.split("t", r"\s+")), lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))
    words = rows.filter(F.col("h").isin(chosen)).select("h", F.slice(F.array_sort(hashed), 1, CONTEXT_WORDS)["w"].alias("w")).dropDuplicates(["h"])
    return SpanModel(sorted({w for r in words.collect() for w in r.w if w and len(w) < CONTEXT_LENGTH}))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """Per document: base counts of each kind, sha256 of the base spans, and all spans as kind:start:end in code points.

    Null and empty texts have no spans (sha256 of the empty text); any length is read whole, in time linear in it (a run of single digits, where each has windows of up to nineteen, takes some 20 microseconds a character);
    repeated rows and null ids pass through; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    model = model or train(docs, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts = {k: [] for k in KINDS}
            digests, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = rule_spans(text)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base) if base else 0)
                digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest() if base else empty)
                spans.append(join_spans(model.spans(text)))
            yield pa.record_batch([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[f.split()[0] for f in FOUND_DDL.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(giving_back(find), FOUND_DDL)


def redact(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; all other columns as they were, null texts stay null."""
    ship(docs.sparkSession)
    model = model or train(docs, text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            out = []
            for value in batch.column(k):
                text = value.as_py()
                if text:
                    parts, at = [], 0
                    for kind, start, end in model.spans(text):
                        if start >= at:
                            parts += [text[at:start], f"[{kind.upper()}]"]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return docs.mapInArrow(giving_back(clean), docs.schema)
