"""Main text of web pages by composite text density.

A page becomes a tree of elements (end tags may be missing, pages may be cut off). Elements that are never
part of an article are taken out: scripts, styles, menus, page headers and footers, sidebars, forms, adverts,
notices and reader comments, by tag, role, class and id. Those that go by such a hint only stay if they hold an article,
or on pages without one over half of the text outside links (reader comments go at any size); inside an article its header
stays, and of a name made of several words all must say so. Of each remaining element the density is

    C/T * log(base: ln(C * LC/(C - LC) + C * LC_body/C_body + e)) of (C/LC * T/LT)

with C characters, T tags, LC characters and LT tags inside links, and its density sum is that of its
children's densities. The element of the largest sum is the core; the least density on its path up to the body
is the threshold. From the body down, an element that reaches the threshold contributes the part
of largest density sum below it, with the headings beside that part; a core inside an ``article`` stands for
the whole of it. Text outside those parts is dropped, and so are lists of links outside articles that no heading
introduces. If nothing is left, the page is read again with scripts, styles, menus and the like taken out only. Densities
are those of block elements: inline elements other than links count as text of the block they stand in.

Defined results: a null or empty page, or one without text, gives an empty text; a repeated row gives its
text again; of equal density sums the outer, then the first element counts; an empty table gives an empty
table. Only the named columns are read, so other columns cannot clash. Pages stay in their partition, and
a page costs time in proportion to its length.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.lean import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head script style noscript template nav button select textarea input iframe svg canvas object embed video audio map menu dialog title".split())
HINTS = frozenset("header footer aside form".split())  # tags that go unless they hold what the page is about
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside comment "
    "comments disqus replies reply responses share sharing social related recommended breadcrumb breadcrumbs menu nav navbar "
    "navigation footer header masthead toolbar widget pagination pager skip hidden".split())
COMMENTS = frozenset("comment comments disqus".split())
#: Words of names that also title parts of an article.
TITLES = frozenset("related social responses replies reply notice notices alert promo share sharing banner hidden".split())
#: Words that say where or what kind of box it is, not what is in it.
BOXES = frozenset(
    "area bar block body bottom box btn button buttons col column container content group holder icon icons inner item items left link links list "
    "main message outer page panel post right row section site slot top unit user wrap wrapper x".split())
LISTS = frozenset("ul ol dl div section table tbody tr".split())
LAYOUT = frozenset("no has with without".split())  # "with-sidebar" says how a page is laid out
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if it is still open, up to the nearest element that holds such parts.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_SCOPE = frozenset("article section div body td th li main blockquote table button html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[\s​]+")


class Node:
    __slots__ = ("block_parent", "blocks", "chars", "children", "density", "drop", "hint", "holds", "link_chars", "link_tags", "names", "parent",
                 "plain", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.block_parent = parent
        self.blocks: list[Node] = []
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.plain = 0
        self.density = self.sum = 0.0
        self.holds = False
        self.names: list[list[str]] = []  # of class and id, the words of each name
        self.drop, self.hint = self._read(attrs)

    def _read(self, attrs: str) -> tuple[bool, bool]:
        """Whether the element goes for certain, and whether something hints at it."""
        if self.tag in DROPPED:
            return True, False
        hint = self.tag in HINTS
        if not attrs or self.tag in ("html", "body", "main"):
            return False, hint
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                for word in value.split():
                    parts = re.split(r"[^a-z]+", word)
                    if not DROPPED_NAMES.isdisjoint(parts) and LAYOUT.isdisjoint(parts):
                        self.names.append([x for x in parts if x])
            if self.tag == "article":
                continue
            if name == "role" and value.strip() in DROPPED_ROLES or name == "hidden":
                return True, False
            if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, False
        return False, hint or bool(self.names) and self.tag != "article"


class _Open:
    """The open elements, with the places of each tag and of the scopes among them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.scopes = [root], {}, []

    def add(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in _SCOPE:
                self.scopes.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def first_after(self, tags: set[str], limit: int) -> int:
        """The outermost open element of ``tags`` behind ``limit``, 0 if there is none."""
        found = []
        for tag in tags:
            places = self.places.get(tag, ())
            at = bisect_right(places, limit)
            if at < len(places):
                found.append(places[at])
        return min(found, default=0)


def parse(page: str) -> Node:
    """The tree of a page below a root."""
    root = Node("#root", None)
    open_, at = _Open(root), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        here = open_.nodes[-1]
        if not m:
            tail = page[at:]
            cut = re.search(r"<(?:/?[a-zA-Z][^>]*|!-{0,2})\Z", tail)
            here.children.append(tail[:cut.start()] if cut else tail)
            break
        if m.start() > at:
            here.children.append(page[at:m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            place = open_.last(tag)
            if place and not (tag in INLINE and open_.scope() > place):
                open_.close(place)
            continue
        if not m["close"]:
            continue
        if tag not in INLINE and open_.last("p") > open_.scope():  # a block ends an open paragraph
            open_.close(open_.last("p"))
        if tag in CLOSES:
            parts, limits = CLOSES[tag]
            if place := open_.first_after(parts, max(map(open_.last, limits))):
                open_.close(place)
        here = open_.nodes[-1]
        node = Node(tag, here, m["attrs"])
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m["attrs"].endswith("/"):
            open_.add(node)
    return root


def _goes(node: Node, in_article: bool, half: float) -> bool:
    """Whether an element with a hint is no part of the page's text."""
    if any(not COMMENTS.isdisjoint(n) and BOXES.union(DROPPED_NAMES).issuperset(n) for n in node.names):
        return not node.holds
    if node.holds or node.plain > half and node.tag not in ("footer", "aside"):
        return False
    if not in_article:
        return True
    if node.tag in HINTS and node.tag != "header":
        return True
    titles = TITLES if node.tag == "section" else frozenset()
    return any(BOXES.union(DROPPED_NAMES).issuperset(n) and not DROPPED_NAMES.difference(titles).isdisjoint(n) for n in node.names)


def _take_out(root: Node) -> None:
    """Settle which of the elements with a hint are dropped."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        node.holds = node.tag == "article" and not node.names
        if not linked:
            node.plain = sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        stack += [(c, linked) for c in node.children if isinstance(c, Node) and not c.drop]
    for node in reversed(order):
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.holds |= node.holds
    half = math.inf if root.holds else root.plain / 2  # an article says what the page is about, else size does
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.hint and _goes(node, inside, half):
            node.drop = True
            continue
        inside = inside or node.tag == "article"
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and not c.drop]


def _measure(root: Node) -> list[Node]:
    """Counts of all kept elements; inline elements count for the block they stand in, links apart.
    Returns the blocks, parents first, each with its blocks in ``blocks``."""
    order: list[tuple[Node, Node, bool]] = []
    stack = [(root, root, False)]
    while stack:
        node, parent, linked = stack.pop()
        linked = linked or node.tag == "a"
        if node.tag in INLINE:
            if node.tag == "a":
                parent.tags += 1
                parent.link_tags += 1
        else:
            node.block_parent = parent
            order.append((node, parent, linked))
            parent = node
            node.tags += 1
            node.link_tags += linked
        for child in node.children:
            if isinstance(child, str):
                size = len(_SPACE.sub("", html.unescape(child)))
                parent.chars += size
                parent.link_chars += size * linked
        stack += [(c, parent, linked) for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    for node, parent, _ in reversed(order):
        if node is not root:
            parent.blocks.append(node)
            parent.chars += node.chars
            parent.link_chars += node.link_chars
            parent.tags += node.tags
            parent.link_tags += node.link_tags
    for node, _, _ in order:
        node.blocks.reverse()
    return [node for node, _, _ in order]


def _densities(nodes: list[Node], body: Node) -> None:
    whole = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if node.chars:
            c, lc, t, lt = node.chars, max(1, node.link_chars), node.tags, max(1, node.link_tags)
            base = math.log(c * lc / max(1, c - lc) + whole * c + math.e)
            node.density = max(0.0, c / t * math.log(c / lc * t / lt) / math.log(base))
    for node in nodes:
        node.sum = sum(c.density for c in node.blocks)


def _content(nodes: list[Node], body: Node) -> set[int]:
    """The roots of the content parts."""
    core = max(nodes, key=lambda n: n.sum)  # the first of equals is the outermost
    if not core.sum:
        return {id(body)}
    threshold, node, article = core.density, core, None
    while node is not body and node.parent is not None:
        article = node if node.tag == "article" else article
        threshold, node = min(threshold, node.density), node.block_parent
    if article is not None:
        return {id(article)}
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        best[id(node)] = max((best[id(c)] for c in node.blocks), key=lambda n: n.sum, default=node)
        if node.sum >= best[id(node)].sum:
            best[id(node)] = node
    chosen = {id(best[id(n)]): best[id(n)] for n in nodes if n.chars and n.density >= min(threshold, body.density)}
    for node in list(chosen.values()):  # headings beside a part belong to it
        if node is not body and node.parent is not None:
            chosen |= {id(c): c for c in node.block_parent.blocks if c.tag in HEADINGS}
    return set(chosen)


def main_text(page: str | None) -> str:
    """The blocks of a page's content, one per line."""
    root = parse(page or "")
    _take_out(root)
    text = _text(root)
    if not text and page:
        text = _text(parse(page))  # the hints took everything
    return text


def _text(root: Node) -> str:
    nodes = _measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    _densities(nodes, body)
    inside = _content(nodes, body)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append(text)

    heading = None  # the heading that no text has followed yet: its number of blocks
    stack: list[tuple[Node | str, bool, bool] | Node] = [(root, False, False)]
    while stack:
        entry = stack.pop()
        if isinstance(entry, Node):
            flush()
            if entry.tag in HEADINGS:
                heading = len(blocks)
            continue
        node, kept, article = entry
        if isinstance(node, str):
            if kept:
                run.append(node)
            continue
        if node.drop:
            if node.tag not in INLINE:
                flush()
            continue
        kept, article = kept or id(node) in inside, article or node.tag == "article"
        if node.tag in LISTS and not article and node.link_tags > 1 and node.link_chars * 10 >= node.chars * 9 and not (
                heading == len(blocks) and not node.chars - node.link_chars):
            flush()  # a menu
            continue
        block = node.tag not in INLINE
        if block:
            flush()
            stack.append(node)
        if node.tag in ("br", "hr"):
            run.append(" ")
        stack += [(c, kept, article) for c in reversed(node.children)]
    flush()
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("page").to_pylist()]
        kept = [c for c in batch.schema.names if c != "page"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=[*kept, "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Key, url, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("address"), F.col(page).alias("page"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = rows.mapInArrow(lean(_extracted), f"key {kinds['key']}, address {kinds['address']}, text string, n_chars long")
    return done.select(F.col("key").alias(key), F.col("address").alias(url), "text", "n_chars")
