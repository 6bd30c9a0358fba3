"""Main text of web pages by wrappers inferred from the pages of each host.

A page is a token stream of tags and texts, nested by its tags. Runs of siblings of one kind (or of a short cycle
of kinds) fold into repeated groups. Pages of a host are then aligned one after the other: what both have is
merged, a text that differs becomes a slot, a kind that one side lacks becomes optional, one that repeats on
either side becomes repeated. What results is a union-free regular expression, the host's wrapper. The place of
the main text in it is its article or main element with the most text, or else the deepest element that holds
most of the text outside of menus, notices, adverts, forms and the like. A page is matched against the expression
from that place on, and its text is read but for what the expression has as template: an element that says the same
on more than half of the host's different pages, wherever it says just that. A page that does not match is read by
a wrapper of its own.

Every page takes part: a task merges its pages host by host, and the tasks' wrappers are merged in a tree of two
levels, first by host and salt, then by host. All that decides is a sum, a mergeable heavy-hitter count, or a set
of least hashes (exact up to ``BODIES`` different pages, estimated beyond), so a wrapper stays small however many
pages a host has. Pages whose text is a copy of another's are one page as evidence.

Names of class, id and role tell asides only if each part of a name is a known word (``comment-list``, not
``share-price``); a name with other parts counts only where most of the text is links. A paragraph that all pages
share is text of the article and stays, as passages that many documents share do.

Defined cases: null or empty html gives an empty text; pages without a url belong to one nameless host; cut-off
markup ends what is open; a tag whose quote never ends stops at its next ``>``; an svg, math, object, select or title without end
takes nothing with it; nesting and siblings may be as deep and as many as they like; repeated rows are read alike;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, save, tune

#: Element names by their part in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "xmp"}
SWALLOW = {"script", "style", "textarea", "xmp", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = RAW | {"head", "nav", "footer", "aside", "form", "button", "fieldset", "dialog", "menu", "canvas", "audio", "video", "map", "input", "label", "option"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element of the first name ends an open one of the second names, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Words of class, id and role that name what is not the article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "adslot", "promo", "promotion", "sponsor", "sponsored", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "signin", "login", "sidebar", "sidenav", "menu", "submenu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "comment", "comments", "commentlist", "respond", "replies", "reply", "disqus", "share", "sharing", "social", "related",
    "recommended", "recommendations", "widget", "widgets", "toolbar", "pagination", "pager", "skip", "hidden", "complementary", "contentinfo", "search", "dialog",
}
#: Words that go with those in a name and say nothing of their own.
PLAIN = {
    "list", "box", "area", "wrap", "wrapper", "container", "section", "block", "item", "items", "bar", "inner", "outer", "left", "right", "top", "bottom", "main", "primary", "secondary", "site",
    "page", "global", "form", "link", "links", "button", "buttons", "icon", "icons", "text", "title", "content", "body", "thread", "group", "row", "column", "panel", "post", "posts", "entry",
    "article", "blog", "sticky", "fixed", "mobile", "desktop", "small", "large", "the", "user", "reader",
}
#: First parts of names that tell a state of something else.
STATES = {"has", "with", "no", "without", "js"}
#: Elements that may be template inside the main text.
TEMPLATE = {"div", "section", "span", "ul", "ol", "table", "small"}
#: Of these, what articles are made of too: template only where nearly all of many pages say the same.
LISTS = {"ul", "ol", "table"}
#: Elements of running text: a name alone never drops them.
PROSE = HEADINGS | {"p", "blockquote", "pre", "dl", "dt", "dd", "figure", "figcaption", "caption"}

LEAD = 60  # characters outside of links from which on a paragraph in the article's header is no byline
TEXTS = 8  # texts that an element's heavy-hitter count holds, and eight times as many if it repeats on a page
BODIES = 32  # least hashes that stand for the different pages of a host
SHOWN = 60  # characters of a fixed text that a wrapper holds, beside its hash
WIDE = 512  # siblings from which on rare kinds of one tag count as one kind
NODES = 200_000  # elements that a task merges before it hands on its wrappers

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|/|$)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: How sure a name is: nothing, only with many links, for containers alone; and what is not shown at all.
NONE, WEAK, SURE, UNSEEN = 0, 1, 2, 3


class Node:
    """An element of a page."""

    __slots__ = ("aside", "chars", "gone", "hash", "holds", "item", "kids", "kind", "links", "tag")

    def __init__(self, tag: str, kind: str, aside: int):
        self.tag, self.kind, self.aside, self.kids, self.item = tag, kind, aside, [], None


def _sure(name: str) -> int:
    """What one name of a class, an id or a role says."""
    parts = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())) - {""}
    if not parts & NAMES or re.split(r"[^a-z0-9]+", name.lower())[0] in STATES:
        return NONE
    return SURE if all(p in NAMES or p in PLAIN or p.isdigit() for p in parts) else WEAK


@lru_cache(maxsize=20_000)
def _describe(tag: str, attrs: str) -> tuple[str, int]:
    """(kind, how surely attributes say that it is not the article)."""
    if not attrs.strip(" /\n\t"):
        return tag, NONE
    extra, sure, hidden = "", NONE, False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            hidden = True
        elif name in ("class", "id", "role"):
            sure = max([sure, *map(_sure, value.split())])
            extra += {"class": ".", "id": "#", "role": "@"}[name] + re.sub(r"\d+", "0", value)
    return tag + extra, UNSEEN if hidden else NONE if tag in ("html", "body", "main") else sure


def parse(html: str) -> Node:
    """Lenient nesting of the token stream; never fails."""
    root = Node("#page", "#page", NONE)
    stack, at, find = [root], 0, TOKEN.search
    opened: dict[str, int] = {}
    endless: set[str] = set()

    def cut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    while True:
        m = find(html, at)
        if m is None:
            if at < len(html):
                stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3] if m[3] is not None else m[4] or ""
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag not in LARGE and stack[i].tag in WALLS:
                    break
            continue
        kind, aside = _describe(tag, attrs)
        if tag in BLOCK and (opened.get("p") or opened.get("option")):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ("p", "option"):
                    cut(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS and any(opened.get(t) for t in ENDS[tag][0]):
            ends, upto = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in upto:
                    break
                if stack[i].tag in ends:
                    cut(i)
                    break
        node = Node(tag, kind, aside)
        stack[-1].kids.append(node)
        closed = attrs.rstrip().endswith("/")
        if tag in RAW:
            if not closed:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                endless |= set() if end else {tag}
                at = end.end() if end else len(html) if tag in SWALLOW else (html.find("<", at) if tag == "title" else at)
                at = len(html) if at < 0 else at
        elif tag not in VOID and not (closed and tag == "path"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


#: An end tag of another name than the first ones does not reach over one of the second.
LARGE = {"article", "main", "body", "html", "nav", "footer", "header", "aside", "section", "div", "form"}
WALLS = {"article", "td", "th", "nav", "aside", "table"}


def _chain(h: int, t: str) -> int:
    return xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), h)


def _headless(kids: list) -> None:
    """A heading with such a name goes where the section right after it does: ``Comments`` above the comments."""
    after = None
    for k in reversed(kids):
        if isinstance(k, str):
            after = k if k.strip() else after
            continue
        if k.tag in HEADINGS and k.aside == SURE and isinstance(after, Node) and after.gone and after.tag not in RAW:
            k.gone = True
            if k.item is not None:
                k.item.gone, k.item.chars = True, 0
        after = k


def measure(root: Node, with_items: bool = False) -> Node:
    """Fills in every element's text length, length of link texts, hash of its text, and whether it is no article;
    ``with_items`` its wrapper part too. Elements before their parents, without recursion."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if not isinstance(k, str)]
    for n in reversed(order):
        chars = links = h = 0
        holds, parts = False, []
        _headless(n.kids)
        for k in n.kids:
            if isinstance(k, str):
                t = " ".join((unescape(k) if "&" in k else k).split())
                if t:
                    chars += len(t)
                    h = _chain(h, t)
                    if with_items:
                        parts.append(Item("#text", "#text", False, [], t if len(t) <= SHOWN else t[:SHOWN] + hex(_chain(0, t)), len(t), 0))
            else:
                holds |= k.holds or k.tag in ("article", "main")
                if not k.gone:
                    chars, links = chars + k.chars, links + k.links
                    h = (h * 0x9E3779B97F4A7C15 + k.hash + 1) & 0xFFFFFFFFFFFFFFFF if k.chars + k.links else h
                if with_items:
                    parts.append(k.item)
                    k.item = None
        if n.tag == "a":
            chars, links = 0, links + chars
        n.chars, n.links, n.hash, n.holds = chars, links, h, holds
        # elements that hold an article or main element are not taken for its surroundings
        n.gone = n.tag in ASIDE or (not holds and (n.aside == UNSEEN or (n.aside == SURE and n.tag not in PROSE) or (n.aside != NONE and links >= chars)))
        if with_items:
            n.item = Item(n.kind, n.tag, n.gone, fold(parts), None, 0 if n.gone else chars, n.links)
            if n.tag in TEMPLATE and not n.gone and chars + links:
                n.item.said = {h: [1, []]}
    if with_items:
        body = root.hash
        root.item.bodies = [body]
        todo = [root.item]
        while todo:
            x = todo.pop()
            todo += x.kids
            if x.said:
                x.said = {t: [1, [body]] for t in x.said}
    return root


class Item:
    """Part of a wrapper: an element kind (or a cycle of kinds), or a text; optional, repeated, or a slot.

    ``said``: texts that the element often has, each with a lower bound of its count and the least hashes of the
    pages that say it; ``bodies``: the least hashes of all pages, at the top element only."""

    __slots__ = ("bodies", "chars", "fixed", "gone", "kids", "kind", "links", "optional", "repeated", "said", "tag")

    def __init__(self, kind: str, tag: str, gone: bool, kids: list, fixed: str | None, chars: int, links: int):
        self.kind, self.tag, self.gone, self.kids, self.fixed, self.chars, self.links = kind, tag, gone, kids, fixed, chars, links
        self.optional = self.repeated = False
        self.said, self.bodies = None, None


def walk(top: Item):
    """(depth, item) of all parts, parents first."""
    stack = [(0, top)]
    while stack:
        d, x = stack.pop()
        yield d, x
        stack += [(d + 1, k) for k in reversed(x.kids)]


def expression(top: Item) -> str:
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        tail = f"){'*' if x.optional and x.repeated else '+' if x.repeated else '?'}" if x.optional or x.repeated else ""
        head = "(" if tail else ""
        if x.kind == "#text":
            out.append(head + ("#SLOT" if x.fixed is None else json.dumps(x.fixed[:40])) + tail)
            continue
        cycle = x.tag == "#cycle"
        out.append(head + ("(" if cycle else f"<{x.kind}>"))
        stack.append((")" if cycle else f"</{x.tag}>") + tail)
        for i, k in enumerate(reversed(x.kids)):
            stack += ([" "] if i else []) + [k]
    return "".join(out)


def pack(top: Item) -> str:
    """A wrapper as flat JSON, a row a part."""
    return json.dumps([[d, x.kind, x.tag, x.gone, x.fixed, x.chars, x.links, x.optional, x.repeated, x.said and list(x.said.items()), x.bodies] for d, x in walk(top)], ensure_ascii=False)


def unpack(text: str) -> Item:
    path: list[Item] = []
    for d, kind, tag, gone, fixed, chars, links, optional, repeated, said, bodies in json.loads(text):
        x = Item(kind, tag, gone, [], fixed, chars, links)
        x.optional, x.repeated, x.bodies, x.said = optional, repeated, bodies, dict(said) if said else None
        del path[d:]
        if path:
            path[-1].kids.append(x)
        path.append(x)
    return path[0]


def fold(kids: list[Item], widen: bool = True) -> list[Item]:
    """Merge adjacent repeats of one kind, or of a cycle of two or three kinds, into one repeated item."""
    for q in (1, 2, 3):
        if len(kids) < 2 * q:
            break
        kinds, out, i = [k.kind for k in kids], [], 0
        while i < len(kids):
            j = i + q
            if kinds[i:j] == kinds[j : j + q] and len(set(kinds[i:j])) == q and "#text" not in kinds[i:j]:
                while kinds[i : i + q] == kinds[j : j + q] and j + q <= len(kids):
                    j += q
            if j == i + q:
                out.append(kids[i])
                i += 1
                continue
            if q == 1:
                one = kids[i]
                for k in kids[i + 1 : j]:
                    merge(one, k, widen)
            else:
                cycle = kids[i : i + q]
                for x in range(i + q, j):
                    merge(cycle[(x - i) % q], kids[x], widen)
                one = _cycle(cycle)
            one.repeated = True
            out.append(one)
            i = j
        kids = out
    return kids


def _cycle(parts: list[Item]) -> Item:
    return Item("(" + " ".join(k.kind for k in parts) + ")", "#cycle", False, parts, None, sum(k.chars for k in parts), sum(k.links for k in parts))


def _least(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[:BODIES]


def different(hashes: list[int]) -> float:
    """How many different pages a set of least hashes stands for."""
    return len(hashes) if len(hashes) < BODIES else (BODIES - 1) * 2.0**64 / (max(hashes) + 1)


def _texts(a: dict | None, b: dict | None, most: int) -> dict | None:
    """Heavy hitters of both: of N texts one that occurs over N / (most + 1) times is never lost. Texts of one page,
    which have no pages yet, are held all."""
    for t, (n, who) in (b or {}).items():
        a = a or {}
        a[t] = [a[t][0] + n, _least(a[t][1], who)] if t in a else [n, who]
    if a and len(a) > most and all(who for _, who in a.values()):
        less = sorted((n for n, _ in a.values()), reverse=True)[most]
        a = {t: [n - less, who] for t, (n, who) in a.items() if n > less}
    return a


def merge(a: Item, b: Item, widen: bool = True) -> Item:
    """Make ``a`` the least wrapper part that both are instances of."""
    todo, wide = [(a, b)], []
    while todo:
        x, y = todo.pop()
        x.gone = x.gone and y.gone
        x.fixed = x.fixed if x.fixed == y.fixed else None
        x.chars, x.links = x.chars + y.chars, x.links + y.links
        x.optional, x.repeated = x.optional or y.optional, x.repeated or y.repeated
        x.said = _texts(x.said, y.said, TEXTS * 8 if x.repeated else TEXTS)
        if x.bodies is not None and y.bodies is not None:
            x.bodies = _least(x.bodies, y.bodies)
        if x.kids or y.kids:
            x.kids = align(x.kids, y.kids, todo)
            if len(x.kids) > max(WIDE, len(y.kids)):
                wide.append(x)
    for x in wide if widen else ():
        x.kids = _widened(x.kids)
    return a


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of long lists, of a common subsequence."""
    if not a or not b:
        return []
    out: list[tuple[int, int]] = []
    if len(a) * len(b) > 40_000:
        places: dict[str, list[int]] = {}
        for i, k in enumerate(a):
            places.setdefault(k, []).append(i)
        at = 0
        for j, k in enumerate(b):
            p = places.get(k, ())
            n = bisect_left(p, at)
            if n < len(p):
                out.append((p[n], j))
                at = p[n] + 1
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        below, row = best[i + 1], best[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _grouped(a: list[Item], b: list[Item]) -> list[Item]:
    """``b`` with each run of the kinds of a cycle of ``a`` as that cycle."""
    for c in (x for x in a if x.tag == "#cycle"):
        kinds, q = [k.kind for k in c.kids], len(c.kids)
        if any(x.kind == c.kind for x in b):
            continue
        for i in range(len(b) - q + 1):
            if b[i].kind == kinds[0] and [x.kind for x in b[i : i + q]] == kinds:
                b = [*b[:i], _cycle(b[i : i + q]), *b[i + q :]]
                break
    return b


def align(a: list[Item], b: list[Item], todo: list[tuple[Item, Item]]) -> list[Item]:
    """The siblings of both, in order; pairs to merge go to ``todo``, what one side lacks becomes optional."""
    ka, kb = [x.kind for x in a], [x.kind for x in b]
    if ka == kb:
        todo += zip(a, b, strict=True)
        return a
    a, b = _grouped(b, a), _grouped(a, b)
    ka, kb = [x.kind for x in a], [x.kind for x in b]
    head, tail, most = 0, 0, min(len(a), len(b))
    while head < most and ka[head] == kb[head]:
        head += 1
    while tail < most - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    pairs += [(i + head, j + head) for i, j in _common(ka[head : len(a) - tail], kb[head : len(b) - tail])]
    pairs += [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        for x in [*a[i:p], *b[j:q]]:
            x.optional = True
            out.append(x)
        if p < len(a):
            todo.append((a[p], b[q]))
            out.append(a[p])
        i, j = p + 1, q + 1
    return out


def _widened(kids: list[Item]) -> list[Item]:
    """Of very many siblings, those of a tag in very many kinds become one kind."""
    kinds: dict[str, set[str]] = {}
    for x in kids:
        kinds.setdefault(x.tag, set()).add(x.kind)
    for x in kids:
        if len(kinds[x.tag]) > WIDE // 8 and x.tag != "#cycle":
            x.kind = x.tag + ".*"
    return fold(kids, widen=False)


def page(html: str) -> Item:
    """A page as the wrapper of itself."""
    return measure(parse(html), with_items=True).item


def decide(top: Item) -> dict:
    """What reading a page needs of its wrapper: the path of kinds to the main text, and the parts that are template
    in it, as flat rows (depth, kind, place among the siblings, texts)."""
    total, best, parts, path = max(1, top.chars), 0, [], []
    root: list[str] = []
    at, inside = top, None
    for d, x in walk(top):
        del path[d:]
        path.append(x)
        if inside is not None and d > inside:
            continue
        inside = d if x.gone or x.kind == "#text" else None
        if inside is None and x.tag in ("article", "main"):
            inside = d if x.tag == "article" else None
            if x.chars > best:
                best, at, root = x.chars, x, [k.kind for k in path[1:] if k.tag != "#cycle"]
    if best < 0.1 * total:
        root, at = [], top
        while True:
            inner = max((k for k in at.kids if not k.gone and k.kind != "#text" and k.tag in BLOCK and not k.repeated and k.tag != "p"), key=lambda k: k.chars, default=None)
            if inner is None or inner.chars < 0.7 * at.chars:
                break
            root.append(inner.kind)
            at = inner
    if len(top.bodies or []) >= 3 and root:
        parts = _template(at, top.bodies)
    runs: list[list] = []
    for k in root:
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    return {"root": runs, "drop": parts}


def _template(top: Item, bodies: list[int]) -> list[list]:
    """Flat rows of the parts below ``top`` that are template or lead to such."""
    rows: list[list] = []
    lead: list[list] = []
    written = 0  # how many of ``lead`` are among the rows
    stack = [(0, i, k) for i, k in reversed(list(enumerate(top.kids)))]
    while stack:
        d, place, x = stack.pop()
        del lead[d:]
        written = min(written, d)
        if x.gone or x.kind == "#text":
            continue
        if x.tag == "#cycle":
            stack += [(d, place, k) for k in reversed(x.kids)]
            continue
        # the same hashes stand for the host's pages and for those that say a text
        least, share = (8, 0.9) if x.tag in LISTS else (3, 0.5)
        said = [t for t, (_, who) in (x.said or {}).items() if (n := sum(w <= bodies[-1] for w in who)) >= least and n > share * len(bodies)]
        lead.append([d, x.kind, place, said])
        if said:
            rows += lead[written:]
            written = len(lead)
        stack += [(d + 1, i, k) for i, k in reversed(list(enumerate(x.kids)))]
    return rows


class Part:
    """A part of the expression that pages are matched against: places of kids by kind, texts of a template."""

    __slots__ = ("kids", "said")

    def __init__(self):
        self.kids: dict[str, tuple[list[int], list[Part]]] = {}
        self.said: set[int] = set()


def matcher(model: dict) -> tuple[list[str], Part | None]:
    """The model in the form that pages are read by."""
    root = [k for k, n in model["root"] for _ in range(n)]
    if not model["drop"]:
        return root, None
    path = [Part()]
    for d, kind, place, said in model["drop"]:
        part = Part()
        part.said = set(said)
        del path[d + 1 :]
        places, parts = path[-1].kids.setdefault(kind, ([], []))
        places.append(place)
        parts.append(part)
        path.append(part)
    return root, path[0]


def partners(node: Node, part: Part | None) -> list[Part | None]:
    """For each kid, the part of the expression that it is an instance of: the next of its kind, or else the first."""
    if part is None or not part.kids:
        return [None] * len(node.kids)
    out, at = [], 0
    for k in node.kids:
        found = None if isinstance(k, str) else part.kids.get(k.kind) or part.kids.get(k.tag + ".*")
        if found is None:
            out.append(None)
            continue
        i = bisect_left(found[0], at)
        i = 0 if i == len(found[0]) else i
        at = found[0][i]
        out.append(found[1][i])
    return out


def infer(pages: list[str]) -> dict:
    """Wrapper of pages: its expression, its number of different pages, and the model that reads by it."""
    top = None
    for html in pages:
        one = page(html)
        top = one if top is None else merge(top, one)
    if top is None:
        return {"wrapper": "", "root": [], "drop": [], "pages": 0}
    return {"wrapper": expression(top), "pages": round(different(top.bodies)), **decide(top)}


def _find(node: Node, path: list[str]) -> list[Node]:
    now = [node]
    for kind in path:
        now = [k for n in now for k in n.kids if not isinstance(k, str) and k.kind == kind and not k.gone]
        if not now:
            break
    return now


def text_of(nodes: list[Node], part: Part | None) -> str:
    """The blocks of elements, in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        t = " ".join("".join(line).split())
        line.clear()
        if t:
            blocks.append(t)

    stack: list = [x for n in reversed(nodes) for x in (None, (n, part, False), None)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
            continue
        if isinstance(x, str):
            line.append(x)
            continue
        node, p, head = x
        todo: list = []
        for k, q in zip(node.kids, partners(node, p), strict=True):
            if isinstance(k, str):
                if not head:
                    todo.append(unescape(k) if "&" in k else k)
            elif k.gone or k.tag == "br" or (q is not None and k.hash in q.said):
                todo.append(" ")
            elif k.tag in ("td", "th"):
                todo += [" ", (k, q, head), " "]
            elif k.tag in BLOCK:
                # a header has the title, often a lead, and bylines and the like beside them
                todo += [None, (k, q, k.tag == "header" or (head and k.tag not in HEADINGS and not (k.tag == "p" and k.chars >= LEAD))), None]
            else:
                todo.append((k, q, head))
        todo.reverse()
        stack += todo
    flush()
    return "\n".join(blocks)


def extract(html: str | None, model: dict | tuple | None) -> str:
    """Main text of one page, along its host's wrapper or else one of its own."""
    if not html:
        return ""
    tree = measure(parse(html))
    if model:
        root, part = matcher(model) if isinstance(model, dict) else model
        nodes = _find(tree, root) if root else []
        if nodes:
            return text_of(nodes, part)
    return text_of(_find(tree, matcher(decide(page(html)))[0]), None)


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(url_col, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _handed(part: int, held: dict[str, Item]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32()), pa.array([pack(x) for x in held.values()], pa.string())], names=["host", "part", "tree"])


def _joined(rows: DataFrame, *by: str) -> DataFrame:
    """Wrappers of equal ``by`` merged one after the other, a wrapper at a time in memory."""

    @lean
    def run(batches):
        now, key, part = None, None, 0
        for b in batches:
            for host, g, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                mine = (host, g) if len(by) > 1 else (host,)
                if mine != key and now is not None:
                    yield _handed(part, {key[0]: now})
                    now = None
                one = unpack(tree.as_py())
                now, key, part = one if now is None else merge(now, one), mine, g
        if now is not None:
            yield _handed(part, {key[0]: now})

    return rows.repartition(*by).sortWithinPartitions(*by, F.xxhash64("tree"), "tree").mapInArrow(run, "host string, part int, tree string")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper, model): a row per host; ``pages``: its different pages, about, where they are many."""
    tune(pages.sparkSession)
    thin = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).where("html <> ''")

    @lean
    def run(batches):
        part, held, nodes = TaskContext.get().partitionId() % 64, {}, 0
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one, text = None, html.as_py()
                one = page(text)
                nodes += text.count("<")
                held[host] = merge(held[host], one) if host in held else one
                if nodes > NODES:
                    yield _handed(part, held)
                    held, nodes = {}, 0
        if held:
            yield _handed(part, held)

    each = save(thin.mapInArrow(run, "host string, part int, tree string"), "pages-of-tasks")
    some = save(_joined(each, "host", "part"), "wrappers-of-salts")
    discard(each)

    @lean
    def told(batches):
        for b in batches:
            tops = [unpack(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([round(different(t.bodies)) for t in tops], pa.int64()), pa.array([expression(t) for t in tops], pa.string()), pa.array([json.dumps(decide(t)) for t in tops], pa.string())], names=["host", "pages", "wrapper", "model"])

    return _joined(some, "host").mapInArrow(told, "host string, pages bigint, wrapper string, model string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, text) of every row."""
    models = save(wrappers(pages, url_col, html_col).select("host", "model"), "wrappers")
    thin = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    joined = thin.join(models, "host", "left").select("id", "url", "host", "html", "model")

    @lean
    def run(batches):
        known: dict[str | None, tuple | None] = {None: None}
        for b in batches:
            out = []
            for html, model in zip(b.column(3), b.column(4), strict=True):
                m = model.as_py()
                if m not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[m] = matcher(json.loads(m))
                out.append(extract(html.as_py(), known[m]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], names=["id", "url", "host", "text"])

    return joined.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, url string, host string, text string")
