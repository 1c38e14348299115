"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrahaz.llm.frames import text_slices

# fixed values: element names of HTML and the usual names of page parts that are not the article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr dt dd li option optgroup legend".split()) | {"li", "dd", "dt"}
DROPPED = frozenset(
    "aside button canvas dialog footer head iframe input map menu nav noembed noframes noscript object script select "
    "style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay popup promo promos related responses share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget header topbar siteheader pageheader".split())
# what such names are put together with; another word makes a name that may come from a heading
JOINED = PARTS | frozenset(
    "area bar block bottom box button buttons container content element form global icons inner item items left links list main media "
    "mobile outer page panel post posts primary reader readers right secondary section site slot thread top unit user users widgets wrap "
    "wrapper".split())
# names that mean a part which is never the article, alone or joined; "comment" only joined, for one alone may be a remark
CERTAIN = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments consent cookie cookies disqus gdpr menu modal nav navbar "
    "navigation newsletter notice notices overlay popup promo promos responses sidebar signup sponsor sponsored subscribe toolbar".split())
JOINED_COMMENT = frozenset("area form list section thread item items box block container wrap wrapper content".split())
IDS = frozenset("comments disqus newsletter responses sidebar advert advertisement".split())  # of sections, whose ids else come from headings
HEADINGS = frozenset("h1 h2 h3 header hgroup".split())
NAMELESS = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre dt dd td th tr tbody thead tfoot caption figcaption".split())
HALF = 0.5
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
            "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
            "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"""(?<![\w:-])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "named", "certain", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, False
        self.certain = False
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it cannot be article text; ``inside``: it lies in an article or main element."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" and not value and not re.search(r"[\w-]hidden|hidden[\w-]", attributes):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether class or id is the name of a page part (a known word, alone or joined with words that say nothing else), and of a certain one.

    Headings, paragraphs and parts of tables have no such names, and sections few by their id, which is often made from a heading.
    """
    if not attributes or tag in NAMELESS:
        return False, False
    named = certain = False
    for name, a, b, c in NAMED.findall(attributes):
        name = name.lower()
        if name not in ("class", "id"):
            continue
        for token in (a or b or c).lower().split():
            parts = [x.rstrip("0123456789") for x in re.split("[_-]+", token)]
            if name == "id" and tag == "section":
                if len(parts) == 1 and parts[0] in IDS:
                    named = certain = True
            elif not PARTS.isdisjoint(parts) and all(x in JOINED or not x for x in parts):
                named = True
                certain |= not CERTAIN.isdisjoint(parts) or "comment" in parts and not JOINED_COMMENT.isdisjoint(parts)
    return named, certain


def parse(html: str) -> Node:
    """The element tree, with the implied ends of p, li, table parts and the like."""
    root = Node("#root", None, False)
    node, at = root, 0
    for token in TOKEN.finditer(html):
        start = token.start()
        if start < at:
            continue
        if start > at:
            node.children.append(html[at:start])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "br":
                node.children.append(" ")
                continue
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in CLOSES_P:
            up = node
            while up.parent is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in SIBLINGS:
            ended, scope = SIBLINGS[tag]
            up, last = node, None
            while up.parent is not None and up.tag not in scope:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        if tag == "br" or tag == "wbr":
            if tag == "br":
                node.children.append(" ")
            continue
        child = Node(tag, node, node.dropped or _dropped(tag, token[3], node.inside))
        if not child.dropped:
            child.named, child.certain = (True, False) if tag == "form" else _named(tag, token[3])
        node.children.append(child)
        if tag in VOID or token[3].endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            ended_at = RAW_END[tag].search(html, at)
            end = ended_at.start() if ended_at else len(html)
            child.children.append(html[at:end])
            at = end
            close = html.find(">", at)
            at = len(html) if close < 0 else close + 1
            continue
        node = child
    if at < len(html):
        node.children.append(html[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Characters and tags below each kept node; nodes come children first."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                n = len("".join(child.split()))
                node.chars += n
                node.link_chars += n * linked
            elif not child.dropped:
                stack.append((child, linked))
    order.reverse()
    for node in order:
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    return order


REST = 25
"""Characters beside certain page parts that make a page of their own."""


def _drop_named(order: list[Node], body: Node) -> bool:
    """Drop measured elements that are page parts by their name; where names can mislead, place and text decide.

    Certain parts go, unless they hold most of their article or main element or, elsewhere, nearly all text of the
    page. A form goes unless it holds more than half of the text, as forms around whole pages do. Other names need, in an
    article or main element, more than half of the text to be links; elsewhere the element stays when it holds the main
    element or the longest article or, on pages without these, more than half of the text of the body and few links.
    """
    named = [n for n in order if n.named and n.chars]
    if not named:
        return False
    around = set()
    longest = max((n for n in order if n.tag == "article" and not _under_certain(n)), key=lambda n: n.chars, default=None)
    for node in [longest, *(n for n in order if n.tag == "main")]:
        while node is not None:
            around.add(id(node))
            node = node.parent
    outside = sum(n.chars for n in named if n.certain and not n.inside and not _under_certain(n) and id(n) not in around)
    alone = not around and body.chars - outside < REST
    for node in named:
        linked = node.link_chars > HALF * node.chars
        if node.tag == "form":
            node.dropped = node.chars <= HALF * body.chars
        elif node.certain and node.inside:
            home = node.parent
            while home.tag not in ("article", "main"):
                home = home.parent
            node.dropped = linked or node.chars <= HALF * home.chars or home.chars - node.chars >= REST
        elif node.certain:
            node.dropped = id(node) not in around and not alone
        else:
            node.dropped = linked if node.inside else id(node) not in around and (bool(around) or linked or node.chars <= HALF * body.chars)
    return any(n.dropped for n in named)


def _under_certain(node: Node) -> bool:
    node = node.parent
    while node is not None:
        if node.certain:
            return True
        node = node.parent
    return False


def _densities(order: list[Node], body: Node) -> None:
    """Characters per tag, lowered by the share of links, and its sum over the children.

    density = C/T * log(C/L * T/LT) to the base ln(C*L/(C-L) + Lb*C/Cb + e),
    C and L all and linked characters, T and LT all and linked tags (each at
    least 1), b the body.
    """
    share = body.link_chars / max(1, body.chars)
    for node in order:
        if node.chars:
            c, t, l, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c * l / max(1, c - l) + share * c + math.e)
            node.density = max(0.0, c / t * math.log(max(1.0, c / l * t / lt)) / math.log(max(base, 1.0 + 1e-9))) if base > 1 else 0.0
        if node.parent is not None:
            node.parent.total += node.density


def _blocks(top: Node) -> list[str]:
    blocks, run = [], []

    def close():
        if run:
            text = "".join(run)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(text)
            run.clear()

    stack: list[Node | str | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped or item is top:
            if item.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
    close()
    return blocks


def main_text(html: str) -> str:
    """Text blocks of the densest subtree, joined by line ends ('' when there is none)."""
    root = parse(html)
    order = _measure(root)
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    if _drop_named(order, body):
        for node in order:
            node.chars = node.tags = node.link_chars = node.link_tags = 0
        order = _measure(root)
    if not root.chars:
        return ""
    _densities(order, body)
    best = max(reversed(order), key=lambda n: n.total)
    # the path to the body: what is at least as dense as its thinnest node belongs to the same content
    path, up = [], best
    while up is not None and up is not body.parent:
        path.append(up)
        up = up.parent
    threshold = min((n.density for n in path if n.density > 0), default=0.0)
    article = next((n for n in reversed(path) if n.tag == "article"), None) or next((n for n in path if n.tag == "main"), None)
    top = article or best
    if article is None:
        while top.parent is not None and top is not body and any(
                isinstance(c, Node) and not c.dropped and c is not top and c.density >= threshold and c.chars for c in top.parent.children):
            top = top.parent
    else:
        main = next((n for n in path if n.tag == "main"), None)
        while main is not None and top is not main and main in path[path.index(top):]:
            top = _widened(top, threshold)
    return "\n".join(_blocks(top))


def _widened(node: Node, threshold: float) -> Node:
    """The parent of a node on the way to the main element, without the siblings that are neither headings nor as dense as the path."""
    for other in node.parent.children:
        if isinstance(other, Node) and other is not node and not (
                other.tag in HEADINGS or other.density >= threshold and other.link_chars <= HALF * other.chars):
            other.dropped = True
    return node.parent


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``html`` and with the main text of each page as ``out``.

    Boilerplate elements (by tag or role, and by class or id where text and links
    do not speak against it) never count as content;
    among the rest the node whose children have the greatest sum of composite
    densities is taken, widened to its article (or main) element or, where
    there is none, along the path to the body while siblings reach the
    least density on that path. Null or empty pages give ''. Rows, their order and
    other columns stay; an existing column ``out`` is replaced. No shuffle.
    """
    kept = [f for f in df.schema.fields if f.name not in (html, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in text_slices(batches, html):
            texts = pa.array([main_text(page) for page in pages.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [texts],
                names=[f.name for f in kept] + [out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType(), False)]))
