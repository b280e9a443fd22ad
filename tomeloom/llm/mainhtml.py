"""Main text of web pages by composite text density over the DOM.

A page becomes a tree of elements. Every node gets its characters, tags, link characters and
link tags; its composite density is characters per tag, scaled down by the share of links. What
the page itself names a menu, header, footer, sidebar, notice, advert, form or comment, by element,
role or class, has a thousandth of the density (a form, which may hold the whole page, a twentieth),
and so has all that is in it; names drop nothing by themselves. A node's density sum adds up its children. The node of the largest sum is the article,
together with the elements around it that are about as dense or that the page names its article;
the least density on the path from it to below the body is the threshold. Subtrees outside it that
reach the threshold are kept by their largest sum, all else goes; of what is inside, named parts
and menus (blocks of several links) below the threshold go.

Defined results: null and empty html give an empty text; broken markup is closed as browsers
close it; a page of nothing but named parts and menus gives an empty text, an article of nothing
but a link its text; a part that holds an article isn't one; repeated rows get equal results; an
empty table gives an empty result. A page is one row and is handled by itself, however long, in time
that grows with its length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements without text of the page: what isn't shown, and controls.
UNSHOWN = frozenset("head script style noscript template select textarea iframe svg canvas title input button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
# The parts that are not the article, as elements, roles and words in classes and ids.
PARTS = frozenset("nav menu header footer aside form fieldset label object dialog".split())
PART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PART_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner comment comments commentlist consent cookie cookies footer header masthead menu nav navbar navigation notice notices promo promotion replies sidebar sidebars sponsor sponsored".split())
NEVER_PARTS = frozenset("html body article main".split())
#: Words that may follow one of these in a class or id without changing what it names.
PLAIN_WORDS = frozenset("area bar block body bottom box col column container content entry form group inner item left link links list main outer panel region right section site slot thread top unit widget wrap wrapper".split())
#: Share of its characters that links hold in a block that is a menu, and its least number of links.
MENU_SHARE, MENU_LINKS = 0.8, 3
#: What names take a density down to, those of elements that may hold a whole page, and the least share that links leave.
NAMED, WRAPPED, LINKED = 0.001, 0.05, 0.02
WRAPPERS = frozenset("form fieldset label object dialog".split())
#: Elements around the article that reach this share of its density belong to it.
AROUND = 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "part", "parent", "children", "own", "chars", "tags", "link_chars", "link_tags", "links", "block", "weight", "density", "total", "best", "marked")

    def __init__(self, tag: str, parent: Node | None, part: float = 0.0):
        self.tag, self.parent, self.part = tag, parent, part
        self.children: list[Node | str] = []
        self.own = self.chars = self.tags = self.link_chars = self.link_tags = self.links = 0
        self.block = tag not in INLINE
        self.weight = 1.0
        self.density = self.total = 0.0
        self.best: Node = self
        self.marked = False


def _attributes(raw: str) -> Iterator[tuple[str, str]]:
    for name, value in _ATTRIBUTE.findall(raw):
        yield name.lower(), entities.unescape(value.strip("\"'"))


def _is_hidden(raw: str) -> bool:
    return any(n == "hidden" or n == "aria-hidden" and v.lower() == "true" or n == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I) for n, v in _attributes(raw))


def _names_part(name: str) -> bool:
    """Whether a class or id names a part: by itself or its last word, or by its first with plain words after it."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and (words[-1] in PART_WORDS or words[0] in PART_WORDS and all(w in PLAIN_WORDS or w.isdigit() for w in words[1:]))


def _part(tag: str, raw: str, within_article: bool) -> float:
    """What is left of the density of an element that the page names as one of the parts that are not the article, 0 for others.

    Inline elements belong to their text, whatever their class.
    """
    if tag in NEVER_PARTS:
        return 0.0
    classes = tag not in INLINE
    if any(n == "role" and v.lower() in PART_ROLES or classes and n in ("class", "id") and any(map(_names_part, v.split())) for n, v in _attributes(raw)):
        return NAMED
    return WRAPPED if tag in WRAPPERS else NAMED if tag in PARTS and not (tag == "header" and within_article) else 0.0


class _Path:
    """The open elements from the root down, and the depths at which each tag is open."""

    def __init__(self):
        self.root = Node("#root", None)
        self.nodes, self.depths = [self.root], {}

    @property
    def node(self) -> Node:
        return self.nodes[-1]

    def open(self, child: Node) -> None:
        self.depths.setdefault(child.tag, []).append(len(self.nodes))
        self.nodes.append(child)

    def close(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()

    def nearest(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        """Depth of the innermost open element of these tags, 0 if there is none or a stop is further in."""
        deepest = lambda names: max((d[-1] for t in names if (d := self.depths.get(t))), default=0)
        found = deepest(tags)
        return found if found > deepest(stop) else 0

    def within(self, *tags: str) -> bool:
        return any(self.depths.get(t) for t in tags)


def parse(page: str) -> Node:
    """The page's tree; text is decoded, comments, declarations and what isn't shown are dropped."""
    path, at, n, last = _Path(), 0, len(page), page.rfind(">")

    def text(raw: str) -> None:
        if raw:
            decoded = entities.unescape(raw)
            path.node.children.append(decoded)
            path.node.own += len(" ".join(decoded.split()))

    while at < n:
        m = _TOKEN.search(page, at) if at <= last else _COMMENT.search(page, at)  # beyond the last > no tag ends
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m.re.groups or m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if found := path.nearest((tag,)):
                path.close(found)
            continue
        if tag in BLOCK_CLOSES_P and (found := path.nearest(("p",), ("button", "td", "th", "table"))):
            path.close(found)
        if tag in CLOSED_BY:
            while found := path.nearest(CLOSED_BY[tag], SCOPES[tag]):
                path.close(found)
        attributes = m[3].strip()
        child = Node(tag, path.node, _part(tag, attributes, path.within("article", "main")))
        shown = not (tag in UNSHOWN or attributes and _is_hidden(attributes))
        path.node.children.append(child if shown else " ")  # opened and closed like any other, but hung nowhere
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        path.open(child)
    return path.root


def _preorder(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def _measure(order: list[Node]) -> None:
    """Counts of each subtree, the text of a link once, and the weights that names leave."""
    holds = {id(n) for n in order if n.tag in ("article", "main")}
    for node in reversed(order):
        node.chars += node.own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, max(node.link_tags, node.tags)
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.block |= node.block  # marks around blocks are a block, too
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
            up.links += node.links + (node.tag == "a")
            if id(node) in holds:
                holds.add(id(up))
    for node in order:
        if id(node) in holds:
            node.part = 0.0
        node.weight = (1.0 if node.parent is None else node.parent.weight) * (node.part or 1.0)


def _densities(order: list[Node], body: Node) -> None:
    link_share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + link_share * node.chars + math.e)
            odds = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            left = math.log(max(odds, 1.0)) / math.log(max(base, math.e))
            node.density = node.weight * node.chars / max(node.tags, 1) * max(left, LINKED)
        # A block of text is a leaf: marks such as <b> inside it don't make it a container.
        node.best, node.total = node, 0.0
        blocks = [c for c in node.children if isinstance(c, Node) and c.block]
        for c in blocks:
            node.total += c.density
        for c in blocks:
            if c.best.total > node.best.total:
                node.best = c.best


def _is_menu(node: Node) -> bool:
    return node.links >= MENU_LINKS and node.tag not in INLINE and node.tag != "p" and node.link_chars >= MENU_SHARE * node.chars


def _left_out(node: Node, threshold: float) -> bool:
    """Whether a block is below the threshold and is a named part or a menu."""
    return node.density < threshold and (node.part > 0 or _is_menu(node))


def _blocks(body: Node, threshold: float) -> list[str]:
    """Texts of the marked subtrees, block by block in page order."""
    out, parts = [], []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append(line)

    stack: list[tuple[Node | str | None, bool]] = [(body, False)]
    while stack:
        item, marked = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if marked:
                parts.append(item)
        elif _left_out(item, threshold):
            parts.append(" ")
            if item.tag not in INLINE:
                flush()
        else:
            marked = marked or item.marked
            if item.tag == "br":
                parts.append(" ")
            block = item.tag not in INLINE
            if block:
                flush()
                stack.append((None, False))
            stack.extend((c, marked) for c in reversed(item.children))
    flush()
    return out


def article_of(body: Node) -> float:
    """Marks the subtrees that are kept and returns the threshold."""
    article = node = body.best
    while node.parent is not None and node is not body:  # to the outermost element that belongs to it
        node = node.parent
        if node is not body and (node.tag in ("article", "main") or node.density >= AROUND * body.best.density):
            article = node
    threshold, node = article.density, article
    while node is not body and node.parent is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    article.marked = True
    stack = [body]
    while stack:
        node = stack.pop()
        if node is article:
            continue
        if node is not body and node.density >= threshold:
            node.best.marked = True
        stack.extend(c for c in node.children if isinstance(c, Node) and c is not node.best)
    return threshold


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty if the page has none."""
    if not page:
        return ""
    root = parse(page)
    order = _preorder(root)
    body = next((n for n in order if n.tag == "body"), root)
    if any(n.tag in ("p", "div", "article", "main") for n in order if n.parent is root):
        body = root  # content beside or without the body element
    body.parent = None
    order = _preorder(body)
    _measure(order)
    _densities(order, body)
    article, around = body.best, []
    while article is not None:
        around.append(article)
        article = article.parent
    if not body.chars or any(n.part == NAMED for n in around) or _is_menu(body.best) and not any(n.tag in ("article", "main") for n in around):
        return ""  # nothing but named parts and menus
    return "\n".join(_blocks(body, article_of(body)))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars in place of html."""
    rows = pages.select("page_id", "url", "html")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"page_id {kind}, url string, text string, n_chars long").withColumn("text", F.coalesce("text", F.lit("")))
