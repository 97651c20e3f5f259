"""Main text of web pages by wrapper inference.

A page becomes a tree of block elements with text slots (inline markup belongs to the text). The token streams of all different pages
of a host are aligned one after the other: equal neighbours become a repeated group, what only some pages
have becomes an optional group, text that differs becomes a slot. The result is a union-free regular
expression over tags (:func:`expression` prints it), the host's wrapper. The wrapper's content element is
the one that holds the main text of most of the pages. Pages of a host whose content elements have one path are of one
template; blocks within them, of any length, whose text is the same on nearly all pages of a template are its notices. Within
an article or main element only boxes count as notices: elements of their own that hold nothing else, while a
paragraph among others (a series' opening line) is the author's. Every page is then matched against its host's wrapper; where
that finds no content element, the page's own structure decides.

Wrappers are fitted on all pages; copies count once. Each page is reduced to its outline before a shuffle. Outlines
of a host are dealt to groups by their hashes, more of them for hosts of more pages, and stream through in a fixed order, so neither
the order of rows nor the partitions change a wrapper. A task holds wrappers and, per template, counts of texts that lag at most ``LAG`` of
its pages behind; long texts count by their hashes. Cases: null or empty html gives an empty text; a null URL has the empty host; a null
page_id stays null; broken and truncated markup is closed at the end; very long pages are read whole, in one pass; repeated rows give equal
rows; of content elements that tie the first on the page is taken; other columns of pages are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

_TAG = re.compile(r"""<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>|[^>]*\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_RAW = {n: re.compile(rf"</{n}[\s/>]", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math")}
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg link meta noscript script style template area map object picture source video audio canvas embed param track".split())
#: Elements that never belong to a main text.
_NEVER = frozenset("head script style noscript template nav aside footer form button select option textarea input iframe svg math canvas object video audio dialog menu title map embed applet noframes noembed frameset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class and id values that mark what surrounds a main text.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs "
    "sidebar sidenav aside rail footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices banner popup popover modal overlay newsletter subscribe subscription "
    "signup signin login share sharing social related recommended recommendations comment comments commentlist respond disqus discussion reply replies feedback widget pagination pager "
    "skip hidden alert paywall header disclaimer toc tagcloud".split()
)
#: Within an article, names that may as well be its author's.
_OWN = frozenset("toc feedback skip header discussion".split())
#: Words that stand beside a mark in names of boxes; any other word makes a name the author's (``alert-level``, ``social-history``).
_BESIDE = frozenset(
    "box block bar container wrapper wrap section list inline main top bottom left right link links button buttons unit slot area item items content inner outer holder panel group "
    "row col column module component region body post posts article articles stories page site web form thread message small large mobile desktop media this now reading google policy count".split()
)
#: Last words of names of boxes, whatever stands before them.
_LAST = frozenset("ad ads advert adverts advertisement adsense adslot sponsored nav navbar navigation breadcrumb breadcrumbs sidebar comment comments replies newsletter signup pagination popup modal paywall".split())
_CONTENT = frozenset("article content post entry story main body text articlebody".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are parts of a text rather than boxes.
_PARTS = _HEADINGS | frozenset("p li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr hgroup".split())
#: Form controls amid a sentence: they are left out and don't end its block.
_CONTROLS = {n: re.compile(rf"<(/?){n}(?=[\s/>])[^>]*>?", re.I) for n in ("button", "select")}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def boxed(names: str) -> frozenset:
    """The marks among class and id values of an element within an article: those of names that say nothing but what surrounds a text."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        hit = _MARKS.intersection(words) - _OWN
        if hit and (words[-1] in _LAST or all(w in _MARKS or w in _BESIDE or len(w) == 1 for w in words)):
            found |= hit
    return frozenset(found)


class Page:
    """Block elements in page order (0 is the root) and the text blocks between their tags."""

    __slots__ = ("anchors", "before", "blocks", "dropped", "heads", "key", "last", "name", "parent", "prior")

    def __init__(self, source: str) -> None:
        self.name, self.parent, self.key, self.dropped, self.prior, self.last = ["#root"], [-1], ["#root"], [False], [0], [0]
        #: Whether an element is an article or main, or within one.
        self.heads = [False]
        #: (element, text, share of it in links)
        self.blocks: list[tuple[int, str, float]] = []
        #: Per block: how many links it has, and how many elements stand before it.
        self.anchors: list[int] = []
        self.before: list[int] = []
        self._read(source)

    def _open(self, name: str, attrs: str, parent: int) -> int:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if "=" in attrs or "hidden" in attrs else {}
        classes = found.get("class", "")
        marks = {w.lower() for w in _WORDS.findall(f"{classes} {found.get('id', '')}")} if classes or "id" in found else frozenset()
        structural = name in ("html", "body", "article", "main")
        drop = self.dropped[parent] or name in _NEVER or found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if marks and not drop and name not in ("html", "body", "main"):
            hit = boxed(f"{classes} {found.get('id', '')}") if self.heads[parent] else marks & _MARKS
            drop = bool(hit - {"header"} if structural or name in _HEADINGS or name == "header" else hit)
            if structural:
                drop = bool(hit & {"comment", "comments", "reply", "related", "recommended", "ad", "ads", "advert", "sponsored", "promo"})
        if name == "header" and not drop:  # a site's header, unless it heads an article
            drop = not self.heads[parent]
        self.name.append(name)
        self.heads.append(self.heads[parent] or name in ("article", "main"))
        self.parent.append(parent)
        self.key.append(name + ("." + re.sub(r"\d+", "0", " ".join(sorted(classes.split()))) if classes else ""))
        self.dropped.append(drop)
        self.prior.append(3 if name == "article" or found.get("itemprop") == "articleBody" else 2 if name == "main" or found.get("role") == "main" else 1 if marks & _CONTENT else 0)
        self.last.append(len(self.name) - 1)
        return len(self.name) - 1

    def _read(self, source: str) -> None:
        stack, at, buffer, links, anchors, in_link = [0], 0, [], 0, 0, False
        bare = dict.fromkeys(_CONTROLS, False)  # controls that nothing closes any more
        blocks, name_of, opened = self.blocks, self.name, Counter()

        def text(raw: str) -> None:
            nonlocal links
            if raw and not self.dropped[stack[-1]]:
                decoded = htmllib.unescape(raw) if "&" in raw else raw
                buffer.append(decoded)
                if in_link:
                    links += len(decoded)

        def flush() -> None:
            nonlocal links, anchors
            if buffer:
                joined = " ".join("".join(buffer).split())
                if joined:
                    blocks.append((stack[-1], joined, min(1.0, links / len(joined))))
                    self.anchors.append(anchors)
                    self.before.append(len(name_of))
                buffer.clear()
            links = anchors = 0

        def close(n: int) -> None:
            while len(stack) > n:
                e = stack.pop()
                opened[name_of[e]] -= 1
                self.last[e] = len(name_of) - 1

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name, attrs = name.lower(), m.group(3)
            closing = bool(m.group(1))
            if not closing and name in _RAW:
                if name not in _INLINE:
                    flush()
                if not attrs.endswith("/>") or name not in ("svg", "math"):
                    stop = _RAW[name].search(source, at)
                    at = source.find(">", stop.start()) + 1 or end if stop else end
                continue
            if name in _INLINE and name not in _NEVER:
                if name == "br":
                    text("\n")
                elif name == "a":
                    in_link = not closing
                    anchors += in_link
                continue
            if name in _CONTROLS and not closing and not bare[name] and not attrs.endswith("/>"):
                stop = _CONTROLS[name].search(source, at)
                if stop and stop.group(1):
                    at = stop.end()
                    text(" ")
                    continue
                bare[name] = stop is None
            flush()
            if closing:
                if opened[name]:
                    depth = len(stack) - 1
                    while name_of[stack[depth]] != name:
                        depth -= 1
                    close(depth)
                in_link = False
                continue
            # A block element ends an open paragraph, and an item ends the one before it.
            if name_of[stack[-1]] == "p":
                close(len(stack) - 1)
            for other in _CLOSES.get(name, ()):
                if name_of[stack[-1]] == other:
                    close(len(stack) - 1)
            if name not in _VOID:
                stack.append(self._open(name, attrs, stack[-1]))
                opened[name] += 1
        flush()
        close(0)

    def content(self) -> int:
        """The element that holds the main text, by the page's own structure."""
        n = len(self.name)
        size, linked = [0] * n, [0.0] * n
        for e, t, links in self.blocks:
            size[e] += len(t)
            linked[e] += len(t) * links
        own = size[:]
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
        total = size[0]
        if not total:
            return 0
        for prior, least in ((3, 0.0), (2, 0.1), (1, 0.4)):
            found = [e for e in range(n) if self.prior[e] == prior and not self.dropped[e] and size[e] > least * total]
            if found:
                return max(found, key=lambda e: (size[e] - linked[e], -e) if prior > 1 else (size[e] * (0.5 + 0.5 * e / n) - linked[e], -e))
        # The deepest element with most of the text that is not links.
        best, whole = 0, size[0] - linked[0]
        for e in range(1, n):
            if not self.dropped[e] and self.parent[e] == best and size[e] - linked[e] >= 0.7 * whole and own[e] < size[e]:
                best = e
        return best

    def path(self, e: int) -> str:
        keys = []
        while e > 0:
            keys.append(self.key[e])
            e = self.parent[e]
        return "/".join(reversed(keys))

    def within(self, root: int) -> list[int]:
        """The text blocks of an element, by their places; if it is the whole page, blocks that are mostly links are menus and left out, but for a paragraph that is one link."""
        last = self.last[root]
        bare = root == 0 or self.name[root] in ("html", "body")
        return [i for i, (e, t, links) in enumerate(self.blocks) if root <= e <= last and not (bare and links > 0.6 and (self.anchors[i] != 1 or self.name[e] != "p"))]

    def box(self, e: int, root: int) -> int | None:
        """The smallest box below root that an element stands in or is; None if it is a part of root's own text."""
        while e > root and self.name[e] in _PARTS:
            e = self.parent[e]
        return e if e > root else None

    def notices(self, root: int, names: frozenset) -> frozenset:
        """The blocks of an element, by their places, that are notices of these :func:`names <counted_as>`."""
        within = self.within(root)
        hit = {i for i in within if counted_as(self.blocks[i][1]) in names}
        if not hit or not self.heads[root]:
            return frozenset(hit)
        box = {i: self.box(self.blocks[i][0], root) for i in within}
        mixed = {box[i] for i in within if i not in hit}
        alike = {(self.parent[b], self.key[b]) for b in mixed if b is not None}  # boxes like these hold the article's text
        return frozenset(i for i in hit if (b := box[i]) is not None and b not in mixed and (self.parent[b], self.key[b]) not in alike)

    def text(self, root: int, skip: frozenset = frozenset()) -> str:
        return "\n\n".join(self.blocks[i][1] for i in self.within(root) if i not in skip)


def counted_as(text: str) -> str:
    """What a text is counted as: itself, or its hash and length if it is long (or starts like one)."""
    return text if len(text) < 200 and text[:1] != "\0" else f"\0{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()} {len(text)}"


def length_of(name: str) -> int:
    return int(name.rpartition(" ")[2]) if name.startswith("\0") else len(name)


class Node:
    """A wrapper element: children are Nodes or text slots (a constant, or None where pages differ)."""

    __slots__ = ("children", "content", "key", "optional", "repeated")

    def __init__(self, key: str, children: list | None = None, optional: bool = False, repeated: bool = False, content: int = 0) -> None:
        self.key, self.children, self.optional, self.repeated, self.content = key, children or [], optional, repeated, content

    def dump(self) -> list:
        return [self.key, int(self.optional), int(self.repeated), self.content, [c.dump() if isinstance(c, Node) else c for c in self.children]]

    @staticmethod
    def load(x: list) -> Node:
        return Node(x[0], [Node.load(c) if isinstance(c[0], str) and len(c) == 5 else c for c in x[4]], bool(x[1]), bool(x[2]), x[3])


def _slot(text: str | None, seen: int = 1) -> list:
    return [text, seen]


def _key(c) -> str:
    return c.key if isinstance(c, Node) else "#text"


DEEPEST = 150


def tree(page: Page, content: int) -> Node:
    """The page as a wrapper of its own, equal neighbours folded into repeated groups; dropped elements are left out.

    Elements below ``DEEPEST`` are not part of wrappers (whose functions are recursive); a content element there is found by its page's own structure.
    """
    nodes = [Node(k) for k in page.key]
    level = [0] * len(nodes)
    for e in range(1, len(nodes)):
        level[e] = level[page.parent[e]] + 1
    nodes[content].content = 1
    # Slots and elements of each element in page order: a block stands before the elements that open after it.
    parts: dict[int, list] = {}
    for i, (e, text, _) in enumerate(page.blocks):
        parts.setdefault(e, []).append((page.before[i], 0, i, _slot(text)))
    for e in range(len(nodes) - 1, -1, -1):  # children come after their parents, so from the end
        nodes[e].children = fold([x for *_, x in sorted(parts.pop(e, ()), key=lambda p: p[:3])])
        if e and not page.dropped[e] and level[e] < DEEPEST:
            parts.setdefault(page.parent[e], []).append((e, 1, e, nodes[e]))
    return nodes[0]


def fold(children: list) -> list:
    """Neighbours of one key become one repeated group; neighbouring slots one slot that differs."""
    out: list = []
    for c in children:
        if out and _key(out[-1]) == _key(c):
            if isinstance(c, Node):
                out[-1] = merge(out[-1], c)
                out[-1].repeated = True
            else:
                out[-1] = _slot(None)
        else:
            out.append(c)
    return out


def merge(a: Node, b: Node) -> Node:
    """Align the children of two elements of one key; what only one has becomes optional."""
    out: list = []
    left, right = a.children, b.children
    keys, others = [_key(c) for c in left], [_key(c) for c in right]
    same = [("equal", 0, len(left), 0, len(right))]
    for op, i, j, k, m in same if keys == others else SequenceMatcher(None, keys, others, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(left[i:j], right[k:m], strict=True):
                if isinstance(x, Node):
                    out.append(merge(x, y))
                else:
                    out.append(_slot(x[0] if x[0] == y[0] else None, x[1] + y[1]))
        else:
            for c in [*left[i:j], *right[k:m]]:
                if isinstance(c, Node):
                    out.append(Node(c.key, c.children, True, c.repeated, c.content))
                else:
                    out.append(c)
    return Node(a.key, fold(out) if len(out) > 1 else out, a.optional or b.optional, a.repeated or b.repeated, a.content + b.content)


def expression(node: Node) -> str:
    """The wrapper as a union-free regular expression."""
    inner = "".join(expression(c) if isinstance(c, Node) else "#PCDATA" if c[0] is None else re.escape(c[0]) for c in node.children)
    whole = f"<{node.key}>{inner}</{node.key.split('.')[0]}>"
    mark = ("+" if node.repeated else "") if not node.optional else ("*" if node.repeated else "?")
    return f"({whole}){mark}" if mark else whole


#: Texts on this share of a template's pages are its notices; counts may be short by the share LAG.
NOTICE, LAG = 0.95, 0.05


def outline(source: str) -> tuple[str, str, list[str], int] | None:
    """A page's template (path of its content element), its tree (JSON), the blocks of its content that may be notices (:func:`counted_as`), and the length of its text."""
    page = Page(source)
    if not page.blocks:
        return None
    root = page.content()
    blocks = [page.blocks[i] for i in page.within(root)]
    inside = {counted_as(t) for e, t, _ in blocks if page.name[e] not in _HEADINGS and not (page.heads[root] and page.box(e, root) is None)}
    return page.path(root), json.dumps(tree(page, root).dump(), separators=(",", ":")), sorted(inside), len(page.text(root))


class Counts:
    """On how many pages of a template each text stands, by lossy counting: short by ``LAG`` of the pages at most, exact up to 1 / LAG pages."""

    def __init__(self, n: int = 0, size: int = 0, texts: dict | None = None) -> None:
        self.n, self.size, self.texts, self.low = n, size, texts or {}, {}

    def add(self, texts: Iterable[str], size: int) -> None:
        self.n, self.size = self.n + 1, self.size + size
        window = int((self.n - 1) * LAG)  # what a text may have missed and been dropped with
        for t in texts:
            if t in self.texts:
                self.texts[t] += 1
            else:
                self.texts[t], self.low[t] = 1, window
        if int(self.n * LAG) > window:
            for t in [t for t, c in self.texts.items() if c + self.low[t] <= window + 1]:
                del self.texts[t], self.low[t]

    def join(self, other: Counts) -> None:
        self.n, self.size = self.n + other.n, self.size + other.size
        for t, c in other.texts.items():
            self.texts[t] = self.texts.get(t, 0) + c

    def notices(self, least: int) -> list[str]:
        found = sorted(t for t, c in self.texts.items() if c >= (NOTICE - LAG) * self.n) if self.n >= least else []
        return found if 2 * self.n * sum(map(length_of, found)) <= self.size else []  # near copies of one page share what is no notice


class Host:
    """What some pages of a host have in common; ``join`` adds other pages of it."""

    def __init__(self) -> None:
        self.wrapper: Node | None = None
        self.counts: dict[str, Counts] = {}

    def add(self, template: str, node: Node, texts: Iterable[str], size: int) -> None:
        self.wrapper = node if self.wrapper is None else merge(self.wrapper, node)
        self.counts.setdefault(template, Counts()).add(texts, size)

    def dump(self) -> str:
        return json.dumps([self.wrapper.dump(), {k: [c.n, c.size, c.texts] for k, c in self.counts.items()}])

    def join(self, part: str) -> None:
        node, counts = json.loads(part)
        node = Node.load(node)
        self.wrapper = node if self.wrapper is None else merge(self.wrapper, node)
        for k, c in counts.items():
            self.counts.setdefault(k, Counts()).join(Counts(*c))

    def spec(self, least: int = 4) -> dict:
        templates = {k: found for k, c in sorted(self.counts.items()) if (found := c.notices(least))}
        return {"wrapper": self.wrapper.dump(), "notices": sorted({t for found in templates.values() for t in found}), "templates": templates}


def infer(sources: list[str], least: int = 4) -> dict | None:
    """A host's wrapper from its pages, and the notices of its templates; None without pages."""
    host = Host()
    for template, node, texts, size in filter(None, map(outline, dict.fromkeys(sources))):
        host.add(template, Node.load(json.loads(node)), texts, size)
    return host.spec(least) if host.wrapper else None


class Wrapper:
    def __init__(self, spec: dict) -> None:
        self.root, self.notices = Node.load(spec["wrapper"]), {k: frozenset(t) for k, t in spec["templates"].items()}
        #: Per wrapper element: its children, and where each key stands among them.
        self._options: dict[int, tuple[list[Node], dict[str, list[int]]]] = {}

    def options(self, node: Node) -> tuple[list[Node], dict[str, list[int]]]:
        if id(node) not in self._options:
            children, at = [c for c in node.children if isinstance(c, Node)], {}
            for j, c in enumerate(children):
                at.setdefault(c.key, []).append(j)
            self._options[id(node)] = children, at
        return self._options[id(node)]

    def content(self, page: Page) -> int | None:
        """The page's element that stands at the wrapper's content element; None if the page has none there."""
        children: dict[int, list[int]] = {}
        for e in range(1, len(page.name)):
            if not page.dropped[e]:
                children.setdefault(page.parent[e], []).append(e)
        at, found, todo = {0: self.root}, Counter(), [0]
        size = Counter()
        for e, t, _ in page.blocks:
            size[e] += len(t)
        for e in range(len(page.name) - 1, 0, -1):
            size[page.parent[e]] += size[e]
        while todo:
            e = todo.pop()
            node, i = at[e], 0
            if node.content:
                found[e] = node.content
            options, places = self.options(node)
            for child in children.get(e, ()):
                known = places.get(page.key[child], ())
                k = bisect_left(known, i)
                if k == len(known):
                    continue  # not in the wrapper
                match = known[k]
                i = match if options[match].repeated else match + 1
                at[child] = options[match]
                todo.append(child)
        if not found:
            return None
        return max(found, key=lambda e: (found[e], size[e], -e))


def extract(source: str | None, wrapper: Wrapper | None) -> str:
    if not source:
        return ""
    page = Page(source)
    if not page.blocks:
        return ""
    root = wrapper.content(page) if wrapper else None
    own = page.content()
    if root is None or root != own and not page.text(root):
        root = own
    notices = wrapper.notices.get(page.path(own)) if wrapper and wrapper.notices else None
    skip = page.notices(root, notices) if notices else frozenset()
    return page.text(root, skip) or page.text(own)


def host_of(url: str):
    """Host of a URL column, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


PARTS = 65_536


def large_hosts(pages: DataFrame, url: str = "url", together: int = 128) -> DataFrame:
    """``part, salts``: the parts of hosts (by hash) that have more than ``together`` pages and more than four times the mean, and among how many groups each is dealt.

    Counts of PARTS parts go to the driver. Fewer than a quarter of them can have over four times the mean, so the result has under
    16,384 rows at any size of the input and may be broadcast.
    """
    counts = pages.select(part_of(host_of(url)).alias("part")).groupBy("part").count().collect()
    most = max(together, 4 * sum(r[1] for r in counts) / PARTS)
    return pages.sparkSession.createDataFrame([(r[0], math.ceil(r[1] / most)) for r in counts if r[1] > most], "part int, salts int")


def part_of(host):
    return F.pmod(F.xxhash64(host), F.lit(PARTS)).cast("int")


def salted(rows: DataFrame, large: DataFrame, least: int = 1) -> DataFrame:
    """rows with a column ``salts``: among how many groups the pages of a row's ``host`` are dealt."""
    both = rows.withColumn("part", part_of("host")).join(F.broadcast(large), "part", "left")
    return both.withColumn("salts", F.greatest(F.col("salts"), F.lit(least))).drop("part")


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", buckets: int = 16, large: DataFrame | None = None) -> DataFrame:
    """``host, wrapper`` (JSON), each from all different pages of the host. Outlines are shuffled, not pages; one host's are spread over
    ``buckets``, or as many groups as :func:`large_hosts` gives it, whose parts are joined 64 at a time first."""
    large = large_hosts(pages, url) if large is None else large
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where(F.length("html") > 0).withColumn("h", F.xxhash64("html"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [(i, *o) for i, source in enumerate(batch.column(1).to_pylist()) if (o := outline(source))]
                at_row, template, node, texts, size = zip(*found, strict=True) if found else ((),) * 5
                kept = batch.take(pa.array(at_row, pa.int64()))
                yield pa.record_batch({"host": kept.column(0), "h": kept.column(2), "template": pa.array(template, pa.string()), "node": pa.array(node, pa.string()), "texts": pa.array(texts, pa.list_(pa.string())), "size": pa.array(size, pa.int64())})

    outlines = rows.mapInArrow(reduce, "host string, h long, template string, node string, texts array<string>, size long")
    dealt = salted(outlines, large, buckets).withColumn("bucket", F.pmod("h", "salts").cast("int")).drop("salts").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "h")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part() -> pa.RecordBatch:
            return pa.record_batch({"host": pa.array([at[0]], pa.string()), "bucket": pa.array([at[1]], pa.int32()), "part": pa.array([host.dump()], pa.string())})

        at, last, host = None, None, Host()
        for batch in batches:
            for name, h, template, node, texts, size, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, bucket) != at:
                    if at:
                        yield part()
                    at, last, host = (name, bucket), None, Host()
                if h != last:  # copies count once
                    host.add(template, Node.load(json.loads(node)), texts, size)
                last = h
        if at:
            yield part()

    def joined(pdf: pd.DataFrame) -> Host:
        host = Host()
        for part in pdf.sort_values("bucket")["part"]:
            host.join(part)
        return host

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "bucket": [pdf["bucket"].min()], "part": [joined(pdf).dump()]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(joined(pdf).spec())]})

    schema = "host string, bucket int, part string"
    parts = dealt.mapInArrow(align, schema)
    parts = parts.groupBy("host", F.floor(F.col("bucket") / 64).alias("group")).applyInPandas(some, schema)
    return parts.groupBy("host").applyInPandas(fit, "host string, wrapper string")


def extract_main(pages: DataFrame, wrappers: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", large: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text`` of every page; a host is dealt among as many groups as :func:`large_hosts` gives it, since one may have a third of
    all pages. A wrapper is read once per group, then its pages stream past it."""
    large = large_hosts(pages, url) if large is None else large
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    rows = salted(rows, large).select("host", F.pmod(F.xxhash64("html", "page_id"), "salts").cast("int").alias("salt"), F.lit(1).alias("page"), "page_id", "url", "html")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("page_id", "long"), ("url", rows.schema["url"].dataType))]
    heads = salted(wrappers, large).select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("page"), *none, F.col("wrapper").alias("html"))
    dealt = heads.unionByName(rows).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wrapper = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out, kept = [], []
                for i, (host, page, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                    if page == 0:
                        at, wrapper = host, Wrapper(json.loads(source))
                        continue
                    kept.append(i)
                    out.append(extract(source, wrapper if host == at else None))
                rest = batch.select([3, 4]).take(pa.array(kept, pa.int64()))
                yield pa.record_batch({"page_id": rest.column(0), "url": rest.column(1).cast(pa.string()), "text": pa.array(out, pa.string())})

    return dealt.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    large = large_hosts(pages)
    found = extract_main(pages, infer_wrappers(pages, large=large), large=large)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
