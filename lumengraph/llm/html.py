"""Main text of web pages by composite text density."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import trimmed

#: A comment, a declaration, or a tag. Attribute values are quoted, or reach to the next white space; nothing is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose text no reader sees, or that are not text.
UNSEEN = {"head", "svg", "canvas", "object", "audio", "video", "datalist"} | RAW
#: Elements that are seldom part of an article; words that class, id and role name such parts by, and words beside them that
#: change nothing. A name of other words too, such as "with-sidebar", tells little.
BESIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "search"}
BESIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "complementary", "contentinfo", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "pagination", "pager", "toolbar", "widget", "masthead", "skip"}
PLAIN_WORDS = {"", "area", "article", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "entry", "form", "global", "group", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "media", "message", "outer", "page", "panel", "policy", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "story", "stories", "text", "thread", "title", "to", "top", "unit", "wrap", "wrapper"}
#: Elements and names of what an article stands in.
WHOLE = {"article", "main"}
#: Weights of densities: of parts that are named as standing beside, that may be, and of all others.
SURE, MAYBE, NONE = 0.01, 0.5, 1.0
#: A part of so many links at least that makes up this share of its characters is a list of links.
LINKS, LINK_SHARE = 3, 0.5
#: A part beside the chosen one counts as its continuation from this share of its density sum on.
CONTINUES = 0.1
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header"}
#: A start tag closes an open element of the first kind when it is of the second.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
CLOSED_BY = {new: {old for old, by in CLOSES.items() if new in by} for new in set().union(*CLOSES.values())}
#: No implied end reaches beyond these.
WALLS = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "html", "blockquote", "select"}


class Node:
    __slots__ = ("chars", "density", "items", "link_chars", "link_tags", "name", "parent", "plain", "sum", "tags", "unseen", "weighed", "weight", "within")

    def __init__(self, name: str, parent: Node | None, weight: float = NONE, unseen: bool = False):
        self.name, self.parent, self.weight, self.unseen = name, parent, weight, unseen
        #: Whether an article or main element stands around the node, or is the node.
        self.within = name in WHOLE or bool(parent and parent.within)
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.weighed = self.plain = self.density = self.sum = 0.0

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and not x.unseen]


def _named(value: str) -> float:
    """What a class, id or role says about a part's weight."""
    weight = NONE
    for token in value.lower().split():
        words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", "-", token)))
        if words & BESIDE_WORDS:
            weight = min(weight, SURE if words <= BESIDE_WORDS | PLAIN_WORDS else MAYBE)
    return weight


def _weight(name: str, attributes: str, parent: Node) -> tuple[float, bool]:
    """A new element's weight, and whether no reader sees it."""
    weight, unseen = (SURE if name in BESIDE or name == "header" and not parent.within else NONE), name in UNSEEN
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role") and (name not in WHOLE | {"html", "body"} or name in WHOLE and "comment" in value.lower()):
            weight = min(weight, _named(value))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            unseen = unseen or name not in ("html", "body")
    return weight, unseen


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)


def parse(html: str) -> Node:
    """A tree of the elements with their texts, in one pass; unclosed and stray tags are read as browsers do, roughly."""
    root = here = Node("#root", None)
    opened: Counter[str] = Counter()
    at, n = 0, len(html)

    while at < n:
        m = TOKEN.search(html, at)
        if text := html[at : m.start() if m else n]:
            here.items.append(unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                here = _closed(here, name, opened)
            continue
        if olds := [x for x in CLOSED_BY.get(name, ()) if opened[x]]:
            node = here
            while node.parent and node.name not in olds and node.name not in WALLS:
                node = node.parent
            if node.name in olds:
                here = _closed(here, node.name, opened)
        weight, unseen = _weight(name, m[3], here)
        new = Node(name, here, weight, unseen or here.unseen)
        here.items.append(new)
        if name in RAW:
            end = _end_of(name).search(html, at)
            at = end.end() if end else n
        elif name not in VOID:
            here = new
            opened[name] += 1
    return root


def _closed(here: Node, name: str, opened: Counter[str]) -> Node:
    """Where text goes on after the innermost open element of a name is closed, and all within it."""
    while True:
        opened[here.name] -= 1
        here, ended = here.parent, here.name
        if ended == name:
            return here


def _nodes(root: Node) -> list[Node]:
    """All nodes that are seen, parents before their children."""
    out = [root]
    for node in out:
        out += node.children()
    return out


def measure(root: Node) -> list[Node]:
    """Fills in characters, tags, densities and their sums, from the leaves up.

    The composite text density of a node is its characters a tag, times the logarithm, to a base that grows with the share of
    links in the node and in the body, of how much more text than links and tags than link tags there is. It is plain if all
    characters count alike; for the density they count by the weights of the parts that they stand in, up to the node.
    """
    nodes = _nodes(root)
    for node in reversed(nodes):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        node.chars += own
        node.weighed = (node.weighed + own) * node.weight
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if up := node.parent:
            up.chars += node.chars
            up.weighed += node.weighed
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    top = next((x for x in nodes if x.name == "body"), root)
    whole = top.link_chars / max(1, top.chars)
    for node in nodes:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + whole * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.plain = node.chars / max(1, node.tags) * math.log(max(ratio, 1.0000001)) / base
            node.density = node.plain * node.weighed / node.chars
    for node in nodes:
        node.sum = sum(x.density for x in node.children())
    return nodes


def chosen(root: Node) -> tuple[Node | None, list[Node], float]:
    """The node with the greatest density sum (a leaf counts by its density, if no sum is above it), weighed by all that stands
    around it; the path from it up to the body; and the least density on that path, which is the threshold for others."""
    nodes = measure(root)
    if not root.chars:
        return None, [], 0.0
    weight = {id(root): root.weight}
    best, most = root, -1.0
    for node in nodes:
        own = weight.setdefault(id(node), weight[id(node.parent)] * node.weight if node.parent else node.weight)
        if node.chars and (value := own * (node.sum or node.density * 1e-6)) > most:
            best, most = node, value
    path = [best]
    while path[-1].parent and path[-1].name != "body":
        path.append(path[-1].parent)
    return best, path, min(x.plain for x in path)


def _dropped(node: Node, threshold: float) -> bool:
    """Whether a part within what is chosen is none of the article: it is named so, or is a list of links, and is not dense."""
    links = node.name in BLOCK and node.name not in HEADINGS | {"p"} and node.link_tags >= LINKS and node.link_chars > LINK_SHARE * node.chars
    return node.density < threshold and (node.weight <= SURE or links)


def main_nodes(root: Node) -> tuple[list[Node], set[int]]:
    """The subtrees that make up the article, in page order, and what of them is left out (by identity).

    The node with the greatest density sum is chosen. On the path from it to the body more is taken: within an article or main
    element all that is not dropped; further out headings in front, and parts that reach the threshold and have a share of the
    chosen sum. Of what is taken, parts that ``_dropped`` names are left out, but never one that the chosen node stands in.
    """
    best, path, threshold = chosen(root)
    if best is None:
        return [], set()
    taken = [best]
    for inner, outer in zip(path, path[1:], strict=False):
        before = True
        for x in outer.items:
            if x is inner:
                before = False
            elif isinstance(x, str):
                if outer.within and x.strip():
                    taken.append(outer)  # text of its own: all of it is taken
                    break
            elif not x.unseen and x.chars and not _dropped(x, threshold) and (outer.within or before and x.name in HEADINGS and x.weight > SURE or x.density >= threshold and x.sum >= CONTINUES * best.sum and x.name in BLOCK):
                taken.append(x)
    held = {id(x) for x in taken}
    left = {id(x) for x in _nodes(root) if _dropped(x, threshold)} - {id(x) for x in path}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in held:
            out.append(node)
        elif not node.unseen:
            stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out, left


def blocks(node: Node, left: set[int] = frozenset()) -> Iterator[str]:
    """The blocks of a subtree in page order, white space collapsed, none empty; without the nodes that are left out."""
    line: list[str] = []
    stack: list = [("in", node)]
    while stack:
        what, x = stack.pop()
        if what == "text":
            line.append(x)
            continue
        block = x.name in BLOCK
        if block and line:
            if text := " ".join("".join(line).split()):
                yield text
            line = []
        if what == "in" and not x.unseen and id(x) not in left:
            if x.name == "br":
                line.append(" ")
            stack.append(("out", x))
            stack += [("text", y) if isinstance(y, str) else ("in", y) for y in reversed(x.items)]
    if text := " ".join("".join(line).split()):
        yield text


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes, left = main_nodes(parse(html))
    return "\n".join(t for node in nodes for t in blocks(node, left))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    text holds the article's blocks, joined by line feeds, and is empty for a null or empty page and for one without any;
    n_chars counts its code points. Unclosed and cut-off markup is read as far as it goes, and pages are read whole, in time
    that grows with their length. Of parts with equal density sums the outer or earlier one is chosen. Null ids and urls are kept,
    a repeated row gives a row each time, and other columns are not looked at; an empty table gives an empty table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": list(map(len, texts))})
        trimmed()

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
