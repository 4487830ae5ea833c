"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a tag holds after its name. A "<" outside quotes ends it unclosed, and nothing is
#: given back, so that a page of broken tags is one pass too.
_INSIDE_TAG = r"""(?:"[^"]*+"|'[^']*+'|[^'"<>])*+"""
_RAW = "script style template textarea title iframe noscript svg math select head"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<({_RAW.replace(' ', '|')})(?=[\s/>]){_INSIDE_TAG}>|<(/?)([a-zA-Z][^\s/><]*+)({_INSIDE_TAG})>",
    re.S | re.I,
)
_SHUT = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split()}
#: One attribute, its value consumed whole.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

#: Elements whose text stands apart from what is around them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these names that stands nearest.
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CLOSES_P = BLOCKS - {"body", "html", "button", "label", "legend", "caption", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that never hold article text.
APART = frozenset("nav aside footer form button dialog menu fieldset label option optgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that mark what is around an article, and beginnings of such words.
AROUND = frozenset(
    "ad ads banner consent disqus disclaimer footer gdpr masthead menu modal nav notice notices notification pager pagination paywall popup promo related replies reply"
    " respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert copyright".split()
)
STARTS = ("advert", "breadcrumb", "comment", "cookie", "discuss", "navbar", "navig", "newsletter", "promo", "recommend", "sidebar", "sponsor", "subscri", "widget")
#: Words that tell of another element's presence: "with-sidebar" is no sidebar.
ELSEWHERE = frozenset("has with no without".split())
#: Words in a class or id that mark the article.
INSIDE = frozenset("article body content entry main post story text".split())
#: Words that say nothing of what an element holds: "top-menu" is a menu, "share-price" need not share.
LAYOUT = frozenset(
    "area article bar block bottom box buttons col column container entry global header icons inner item items left links list outer page panel post primary right row"
    " secondary section site small top unit wrap wrapper zone".split()
)

#: Weights of the block classifier, in favour of content.
WORDS, SHORT, LINKS, ARTICLE, HINT, OUTSIDE, HEADING, SUSPECT, BARRED = 0.8, -2.0, -4.0, 3.0, 2.0, -4.0, 1.0, -3.0, -40.0
#: Costs of labelling neighbours apart: next in page order; same parent; same grandparent.
NEXT, SIBLINGS, COUSINS = 0.3, 1.0, 0.3


class Block(NamedTuple):
    text: str
    words: int
    linked: float
    barred: bool
    suspect: bool
    inside: bool
    hint: bool
    heading: bool
    parent: int
    grandparent: int


def _named(value: str, held: bool) -> tuple[bool, bool, bool]:
    """Whether a class or id bars an element, makes it suspect, or hints at the article.

    A name bars if all it says is what stands around an article. A name that says more, as
    ``share-price`` does, only counts against the text: the cut decides.
    """
    barred = suspect = hint = False
    for name in value.split():
        parts = {p.lower() for p in _PART.findall(name)}
        if ELSEWHERE.isdisjoint(parts):
            said = {p for p in parts if p not in LAYOUT and not p.isdigit()}
            around = said & AROUND
            barred |= any(p.startswith(STARTS) for p in parts) or bool(around) and around == said
            barred |= "header" in parts and not held and INSIDE.isdisjoint(parts)
            suspect |= bool(around)
        hint |= not INSIDE.isdisjoint(parts)
    return barred, suspect, hint


def _marks(name: str, attributes: str, held: bool) -> tuple[bool, bool, bool]:
    """Whether an element's name and attributes bar its text, make it suspect, or hint at the article."""
    barred = name in APART or (name == "header" and not held)
    suspect = hint = False
    if attributes and name not in ("html", "body", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what not in _NAMED:
                continue
            if what == "hidden" or (what == "aria-hidden" and value == "true"):
                barred = True
            elif what == "role":
                barred |= value.lower() in ROLES
            else:
                found = _named(value, held)
                barred, suspect, hint = barred | found[0], suspect | found[1], hint | found[2]
    return barred, suspect, hint


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; markup may be unclosed or wrongly nested."""
    out: list[Block] = []
    # Open elements: name, number, barred, suspect, inside an article, hint.
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    open_to_end: set[str] = set()
    numbers, linked, links, at = 0, 0, 0, 0
    opened: Counter[str] = Counter()
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            _, number, barred, suspect, inside, hint = stack[-1]
            whole = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in BLOCKS), 0)
            heading = stack[whole][0] in ("h1", "h2", "h3")
            out.append(Block(text, text.count(" ") + 1, min(1.0, linked / len(text)), barred, suspect, inside, hint, heading,
                             stack[max(whole - 1, 0)][1], stack[max(whole - 2, 0)][1]))
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        if any(s[0] in BLOCKS for s in stack[depth:]):
            flush()
        links -= sum(s[0] == "a" for s in stack[depth:])
        opened.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    def nearest(name: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name) if opened[name] > 0 else 0

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if m[1]:
            raw = m[1].lower()
            if raw in ("svg", "math") and m[0].endswith("/>"):
                continue
            # Only scripts and styles run to the end of a page that doesn't close them; of others the tag goes.
            shut = None if raw in open_to_end else _SHUT[raw].search(page, at)
            if shut:
                at = shut.end()
            else:
                open_to_end.add(raw)
                at = end if raw in ("script", "style") else at
            continue
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            depth = nearest(name)
            if depth:
                close(depth)
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES_P:
                depth = nearest("p")
                if depth and not any(s[0] in ("td", "th", "button") for s in stack[depth:]):
                    close(depth)
            if any(opened[other] > 0 for other in IMPLIED.get(name, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in IMPLIED[name]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
        elif name == "br":
            parts.append(" ")
        if name in VOID or m[4].endswith("/") and name not in BLOCKS:
            continue
        _, _, barred, suspect, inside, hint = stack[-1]
        barred_here, suspect_here, hint_here = _marks(name, m[4], inside)
        numbers += 1
        inside = inside or name in ("article", "main")
        # The main element is never part of what surrounds it.
        barred, suspect = barred and name != "main", suspect and name != "main"
        stack.append((name, numbers, barred or barred_here, suspect or suspect_here, inside, hint or hint_here))
        opened[name] += 1
        links += name == "a"
    flush()
    return out


def leaning(block: Block, has_article: bool) -> float:
    """The classifier's log odds that a block is content."""
    if block.barred:
        return BARRED
    score = SHORT + WORDS * log2(1 + block.words) + LINKS * block.linked + HEADING * block.heading + HINT * block.hint + SUSPECT * block.suspect
    return score + (ARTICLE if block.inside else OUTSIDE if has_article else 0.0)


def minimum_cut(leanings: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least cost: a block's leaning is paid where its label goes
    against it, an edge where its ends differ. Of equal cuts, the one with most content.

    Max-flow by shortest augmenting paths over level graphs; what the sink cannot be
    reached from is cut off as content.
    """
    n = len(leanings)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, lean in enumerate(leanings):
        if lean >= 0:
            link(source, k, lean, 0.0)
        else:
            link(k, sink, -lean, 0.0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        tried = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[first] ^ 1]
                del path[first:]
            elif tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    tried[v] += 1
            elif path:
                v = to[path.pop() ^ 1]
                tried[v] += 1
            else:
                break
    # Blocks that still reach the sink are boilerplate.
    cut = [False] * (n + 2)
    cut[sink] = True
    queue = deque([sink])
    while queue:
        v = queue.popleft()
        for e in out[v]:
            if not cut[to[e]] and room[e ^ 1] > 1e-9:
                cut[to[e]] = True
                queue.append(to[e])
    return [not c for c in cut[:n]]


def main_text(page: str) -> str:
    """The text of the blocks labelled content, one to a line."""
    found = blocks(page)
    has_article = any(b.inside and not b.barred for b in found)
    leanings = [leaning(b, has_article) for b in found]
    edges: list[tuple[int, int, float]] = []
    last: dict[tuple[str, int], int] = {}
    for k, b in enumerate(found):
        weights: dict[int, float] = {k - 1: NEXT} if k else {}
        for kin, number, weight in (("parent", b.parent, SIBLINGS), ("grandparent", b.grandparent, COUSINS)):
            before = last.get((kin, number))
            if before is not None:
                weights[before] = weights.get(before, 0.0) + weight
            last[kin, number] = k
        # No smoothness holds between barred text and the rest.
        edges += [(j, k, w) for j, w in weights.items() if not found[j].barred and not b.barred]
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(leanings, edges)) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    Each page is labelled by itself in one pass, with nothing shuffled. A null or
    empty page, and one without article text, give an empty text. Repeated rows give
    repeated results; an empty table gives no rows; other columns are not read,
    whatever their names.
    """

    @F.arrow_udf("string")
    def text(found: pa.Array) -> pa.Array:
        return pa.array([main_text(page) if page else "" for page in found.to_pylist()], pa.string())

    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return named.withColumn("n_chars", F.char_length("text").cast("long"))
