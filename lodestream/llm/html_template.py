"""Main text of web pages: templates deduced per host from equivalence classes of tokens, and the slots that remain."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch

#: Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title iframe xmp noframes noembed noscript template svg math canvas object".split())
EXCLUDED = frozenset("head nav header footer aside form menu dialog button select option fieldset audio video frameset".split())
KEPT_WHOLE = frozenset("html body main article".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "head": frozenset(["body"]),
}
LIMITS = frozenset("html body article main section div table ul ol dl td th nav aside footer header form blockquote".split())
#: Words of class, id and role that name what is not the article.
SIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar trending widget widgets".split())
CONTENT_WORDS = frozenset("article articlebody content entry post story".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Block:
    """A stretch of text between block borders: its slot (the path of its element), the text, link characters, the path of the innermost element that sets it aside, and the nearest article."""

    __slots__ = ("linked", "outer", "scope", "side", "slot", "text")

    def __init__(self, slot: str, text: str, linked: int, side: str, scope: int, outer: tuple[str, ...]):
        self.slot, self.text, self.linked, self.side, self.scope, self.outer = slot, text, linked, side, scope, outer


def _attributes(name: str, rest: str) -> tuple[str, bool, int]:
    """(path step, set aside, scope 2 for a declared main part and 1 for a class that tells of content)."""
    step, side, scope = name, name in EXCLUDED, 2 if name in ("article", "main") else 0
    if "=" in rest or "hidden" in rest:
        for m in ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id", "role"):
                found = [w.lower() for w in NAME_WORD.findall(value)]
                if key == "role" and "main" in found:
                    scope = 2
                if not SIDE_WORDS.isdisjoint(found):
                    side = True
                elif not scope and not CONTENT_WORDS.isdisjoint(found):
                    scope = 1
                if key == "class" and found:
                    step = f"{name}.{'.'.join(found)}"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN_STYLE.search(value)):
                side = True
    return step, side and name not in KEPT_WHOLE or name == "article" and "comment" in step, scope


def parse(source: str) -> tuple[list[Block], dict[str, int]]:
    """Blocks in page order, and how often each element path starts."""
    blocks: list[Block] = []
    paths: dict[str, int] = {}
    # open elements: (name, path, innermost path set aside, scope, link)
    stack: list[tuple[str, str, str, int, bool]] = [("", "", "", 0, False)]
    pieces: list[tuple[str, str, bool]] = []

    def close_block() -> None:
        if pieces:
            k = len(stack) - 1
            while k and stack[k][0] in INLINE:
                k -= 1
            top = stack[k]
            for side in dict.fromkeys(s for _, s, _ in pieces):
                text = " ".join("".join(p for p, s, _ in pieces if s == side).split())
                if text:
                    linked = sum(len(p.strip()) for p, s, link in pieces if s == side and link)
                    blocks.append(Block(top[1], text, linked, side, top[3], tuple(e[1] for e in stack[1 : k + 1] if e[0] not in INLINE)))
            pieces.clear()

    def pop_to(k: int) -> None:
        if any(e[0] not in INLINE for e in stack[k:]):
            close_block()
        del stack[k:]

    def add(text: str) -> None:
        if text:
            pieces.append((entities.unescape(text) if "&" in text else text, stack[-1][2], stack[-1][4]))

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        add(source[at:lt])
        m = TAG.match(source, lt)
        if not m:
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif source.startswith(("<!", "<?", "</"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        end = TAG_END.match(source, m.end())
        at = end.end() if end else (source.find(">", m.end()) + 1 or n)
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in LIMITS and name not in LIMITS:
                    break
            continue
        rest = source[m.end() : at]
        if name in RAW:
            if name not in ("svg", "math", "object", "canvas", "noscript", "iframe") or not rest.endswith("/>"):
                close = _raw_end[name].search(source, at)
                end_at = source.find(">", close.end()) if close else -1
                at = end_at + 1 if end_at >= 0 else n
            if name not in ("svg", "math", "canvas"):
                close_block()
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            close_block()
        if name in VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):
            if name in CLOSED_BY.get(stack[k][0], ()):
                pop_to(k)
                break
            if stack[k][0] in LIMITS and not (stack[k][0] in ("td", "th") and name in ("td", "th", "tr")):
                break
        step, side, scope = _attributes(name, rest)
        parent = stack[-1]
        path = f"{parent[1]}/{step}"
        if name not in INLINE:
            paths[path] = paths.get(path, 0) + 1
        stack.append((name, path, path if side else parent[2], max(parent[3], scope), parent[4] or name == "a"))
    close_block()
    return blocks, paths


def key_of(slot: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{slot}\n{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


MOST_LINKED = 0.6
TOKENS_DDL = "host string, vote long, tokens array<struct<kind string, token string, n int, chars long, linked long>>"
TOKENS = pa.list_(pa.struct([("kind", pa.string()), ("token", pa.string()), ("n", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64())]))


def vote_of(blocks: list[Block]) -> int:
    """A hash of the set of the page's blocks (of those that are neither set aside nor links, if any): copies of a page have one vote together."""
    own = [b for b in blocks if not b.side and b.linked < MOST_LINKED * len(b.text)] or blocks
    return xxhash.xxh3_64_intdigest(np.array(sorted({key_of(b.slot, b.text) for b in own}), np.int64).tobytes()) - (1 << 63)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page that has text: host, vote, and its tokens: element paths (n), slots with their characters (s; x for what is set aside), texts in their slot (t)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch, hosts, votes, tokens = whole.slice(at, 500), [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks, paths = parse(source.as_py() or "")
                if not blocks:
                    continue
                slots: dict[str, list[int]] = {}
                aside: dict[str, list[int]] = {}
                texts: dict[str, list[int]] = {}
                for b in blocks:
                    s = (aside if b.side else slots).setdefault(b.slot, [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + 1, s[1] + len(b.text), s[2] + b.linked
                    t = texts.setdefault(f"{key_of(b.slot, b.text)} {b.slot}", [0, 0, 0])
                    t[0], t[1], t[2] = t[0] + 1, t[1] + len(b.text), t[2] + (len(b.text) if b.side else 0)
                found = {"n": {path: (n, 0, 0) for path, n in paths.items()}, "s": slots, "x": aside, "t": texts}
                hosts.append(host)
                votes.append(vote_of(blocks))
                tokens.append([{"kind": kind, "token": token, "n": n, "chars": chars, "linked": linked} for kind, of in found.items() for token, (n, chars, linked) in of.items()])
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(votes, pa.int64()), pa.array(tokens, TOKENS)], names=["host", "vote", "tokens"])


TEMPLATE_DDL = "host string, content array<string>, constant array<long>, linked array<string>"
TEMPLATE = pa.schema([("host", pa.string()), ("content", pa.list_(pa.string())), ("constant", pa.list_(pa.int64())), ("linked", pa.list_(pa.string()))])
CONTENT_SHARE, CONSTANT_SHARE = 0.75, 0.5
FIXED_SHARE = 0.8  # share of a host's pages that have a template's own text, and share of a slot's blocks that are such texts
DECLARED_PAGES = 8  # distinct pages that it takes to leave texts out of a declared article or main part
#: Hints: the share that a declared article or main part needs, and the weight of text that an element name, class, id or role sets aside.
DECLARED_SHARE, SIDE_WEIGHT = 0.3, 0.1


def _under(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def _declared(path: str) -> bool:
    """Whether the element's own name is that of a declared part; one with a class as well."""
    return path[path.rfind("/") + 1 :].split(".", 1)[0] in ("article", "main")


def _nest(rows: list[dict], pages: int) -> dict[str, tuple[int, bool]]:
    """The elements of the template: path to (pages that have it, whether it repeats on a page).

    Tokens of one occurrence vector make a class. A root class has a count of one on (nearly) every page and two elements at
    least. Other classes, optional or repeated, nest where all their elements lie under one element of the template.
    """
    classes: dict[tuple, list[str]] = {}
    for r in rows:
        if r["kind"] == "n":
            classes.setdefault((r["vector"]["low"], r["vector"]["high"], r["pages"], r["total"]), []).append(r["token"])
    template: dict[str, tuple[int, bool]] = {}
    for (_, _, n, total), paths in sorted(classes.items(), key=lambda c: (not c[0][3] == c[0][2] >= 0.9 * pages, min(p.count("/") for p in c[1]), min(c[1]))):
        once = total == n >= 0.9 * pages
        if once and len(paths) > 1 or all(any(p[:k] in template for k in range(1, len(p)) if p[k] == "/") for p in paths):
            template.update((p, (n, total > n)) for p in paths)
    return template


def _deduce(group: pa.Table) -> pa.Table:
    """The template of one host from its frequent tokens with their occurrence vectors' fingerprints.

    Slots hold what lies in no token: their text without links and the template's own texts. content: the elements
    of the template that hold three quarters of that text on the pages that have them (optional elements: one for each layout), each the
    innermost such. Repeated elements give their text to the element that they nest in. Names are hints: a declared
    part needs less of the text, may repeat, and is not narrowed further but by another; text set aside weighs less.
    """
    rows = group.to_pylist()
    pages = rows[0]["host_pages"]
    template = _nest(rows, pages)
    slots: dict[str, list[float]] = {}
    for r in rows:
        if r["kind"] in ("s", "x"):
            s = slots.setdefault(r["token"], [0, 0, 0.0])
            s[0], s[1], s[2] = s[0] + r["chars"], s[1] + r["linked"], s[2] + r["chars"] * (1 if r["kind"] == "s" else SIDE_WEIGHT)
    linked = sorted(slot for slot, (chars, links, _) in slots.items() if links >= MOST_LINKED * chars)
    weight = {slot: w for slot, (chars, links, w) in slots.items() if links < MOST_LINKED * chars}
    blocks: dict[str, list[int]] = {}
    for r in rows:
        if r["kind"] in ("s", "x", "t"):
            b = blocks.setdefault(r["token"].split(" ", 1)[1] if r["kind"] == "t" else r["token"], [0, 0])
            b[r["kind"] == "t"] += r["total"] if r["kind"] != "t" or r["pages"] >= FIXED_SHARE * pages else 0
    # a slot with few other texts is the template's; in one that varies, only what no page lacks
    fixed = {slot for slot, (n, constant) in blocks.items() if constant >= FIXED_SHARE * n}
    same = [(*r["token"].split(" ", 1), r["chars"], r["linked"]) for r in rows if r["kind"] == "t" and r["pages"] >= (FIXED_SHARE if r["token"].split(" ", 1)[1] in fixed else 1) * pages]
    own = [(slot, chars - side + side * SIDE_WEIGHT) for _, slot, chars, side in same if slot in weight]
    # a template's own texts are the lesser part: beyond it they are an article in near copies
    if sum(w for _, w in own) >= CONSTANT_SHARE * sum(weight.values()):
        same = []
    else:
        for slot, w in own:
            weight[slot] -= w
    whole, content = sum(weight.values()) / pages, []
    for path, (n, repeats) in sorted(template.items(), key=lambda e: (e[0].count("/"), e[0])):
        declared = _declared(path)
        if whole <= 0 or repeats and not declared or any(_under(path, c) and _declared(c) and not declared for c in content):
            continue
        if sum(w for slot, w in weight.items() if _under(slot, path)) >= (DECLARED_SHARE if declared else CONTENT_SHARE) * whole * n:
            content = [c for c in content if not _under(path, c)] + [path]
    # a few pages cannot tell a template's text in a declared article from a quotation
    spared = [c for c in content if _declared(c)] if pages < DECLARED_PAGES else []
    constant = sorted(int(key) for key, slot, *_ in same if not any(_under(slot, c) for c in spared))
    return pa.table({"host": [rows[0]["host"]], "content": [content], "constant": [constant], "linked": [linked]}, schema=TEMPLATE)


def templates(pages: DataFrame, least_pages: int = 2) -> DataFrame:
    """A row for each host of ``least_pages`` distinct pages at least (two can be compared), from rows (host, html).

    Pages of one host and vote count once, so neither copies of a page nor repeated rows make a text or an element frequent.
    An occurrence vector (how often a token is on each page) is told by a fingerprint, the sum of a hash of vote
    and count, which adds up before the shuffle, as do the counts; so a host with a third of all pages is no hot
    group. Tokens on half of a host's pages stay: no more than twice the tokens of a mean page.
    """
    scratch = Scratch(pages.sparkSession, "template")
    voters = pages.select("host", "html").mapInArrow(_tokens, TOKENS_DDL).groupBy("host", "vote").agg(F.min("tokens").alias("tokens"))
    here = F.expr("struct('h' AS kind, '' AS token, 1 AS n, 0L AS chars, 0L AS linked)")
    tokens = voters.select("host", "vote", F.explode(F.array_append("tokens", here)).alias("t")).select("host", "vote", "t.*")
    # two sums of halves of a hash of vote and count: neither overflows below two thousand million pages of a host
    told = F.xxhash64("vote", "n")
    vector = F.struct(F.sum(told.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(told, 32)).alias("high")).alias("vector")
    added = tokens.groupBy("host", "kind", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), vector, F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    added = scratch.keep(added.filter(F.col("pages") * 2 >= least_pages), "frequent")
    hosts = added.filter("kind = 'h'").select("host", F.col("pages").alias("host_pages")).filter(F.col("host_pages") >= least_pages)
    frequent = added.filter("kind <> 'h'").join(hosts, "host").filter(F.col("pages") * 2 >= F.col("host_pages"))
    return frequent.groupBy("host").applyInArrow(_deduce, TEMPLATE_DDL)


def main_text(source: str | None, content: list[str] | None, constant: list[int] | None, linked: list[str] | None) -> str:
    """The page's blocks in the slots of its host's content elements, joined by a space.

    What a name sets aside within a content element stays out; names on the way to it do not matter. A page with no text there, or
    of a host without a template, is judged by its own names.
    """
    if not source:
        return ""
    blocks = parse(source)[0]
    roots = {*content} if content else set()
    chosen = [b for b in blocks if any(e in roots and len(b.side) <= len(e) for e in b.outer)]
    if not chosen:
        blocks = [b for b in blocks if not b.side]
        best = max((b.scope for b in blocks), default=0)
        chosen = [b for b in blocks if b.scope == best]
    # a list of links in a declared part is left out if its slot holds links on the whole host
    chosen = [b for b in chosen if (b.scope == 2 or b.linked < MOST_LINKED * len(b.text)) and not (linked and b.slot in linked)]
    if constant:
        fixed = {*constant}
        chosen = [b for b in chosen if key_of(b.slot, b.text) not in fixed] or chosen
    return " ".join(b.text for b in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    1. Pages are cut into blocks (text between block elements, references decoded, white space folded), each with
    its slot, the path of its element. 2. ``templates`` deduces each host's nested classes, their slots and the content
    elements. 3. A page keeps the blocks under its content elements, without what is set aside within them (menus, headers,
    footers, sidebars, notices, adverts, forms, hidden parts and comments, by element, class, id or role), link lists and
    texts of the template, unless nothing else remains: those of 80 per cent of the host's distinct pages in a slot that hardly holds others, and those of all its pages in one
    that does; within a declared article or main part it takes eight distinct pages to tell. A paragraph that no page lacks there is thus left out. Pages without text there, and those
    of a host with one distinct page, which has nothing to compare, fall back on the declared article or main part, else on names of classes.

    A null or empty page has the empty text; a null url is a host of its own; pages of any length are read whole; broken markup
    is read as browsers do, roughly; repeated rows and null ids pass through; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), "//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    found = scratch.keep(templates(rows.select("host", "html")), "templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, constants, links = (batch.column(k).to_pylist() for k in (3, 4, 5))
            texts = [main_text(h.as_py(), *rest) for h, *rest in zip(batch.column(2), contents, constants, links, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([*map(len, texts)], np.int64))], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "content", "constant", "linked")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
