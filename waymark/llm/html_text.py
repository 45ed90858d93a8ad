"""Main text of HTML pages by composite text density.

A page becomes a tree of elements; inline elements (but for links) count as text. For every node with C characters,
T tags, LC link characters and LT link tags, and the body's LCb and Cb, the composite density is

    C / T * log_base(C * T / (max(LC, 1) * LT)),  base = ln(C * LC / max(C - LC, 1) + LCb * C / Cb + e)

(log as in ln x / ln base), which is low for link lists. A node's density sum is that of its block children (a leaf's own
density). The node with the largest sum is the article's. The smallest density on its path up to the body, which itself
only counts if it is that node, is the threshold: siblings on the path that are not doubtful, of the same element name and as it with or without blocks in
them, join the article if their density reaches it.

What pages say of an element only weighs: densities of elements whose class or id holds a word of WORDS, or that are made
of repeated bylines with texts (readers' comments, by whatever name), unless they hold the first h1, count a DOUBT of theirs, and so do their parts; those
of main and article elements count BOOST times, and the element with the page's first h1 BOOST times as a child. Inside the article an element goes if it is a
list of links (MENU or more and no other words), a list of bylines, or doubtful and has no line of BYLINE characters, or
its characters stand in less than DOUBTFUL of the density that the article's do. Never taken are elements that HTML itself defines as something else than text (BOILERPLATE, by
tag or role) and hidden ones; a header in the article keeps its headings.

Defined results: null or empty html gives empty text; broken markup is closed where its parent ends; character
references are decoded, white space within a block becomes one space, blocks are joined in page order by one space;
equal sums go to the outermost, first node; rows that repeat are extracted each; an empty table gives an empty table;
other columns pass through.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import add_columns

# Element names and words by which pages mark what is not the article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILERPLATE = {"head", "nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "select", "option", "datalist", "label", "svg", "math", "canvas", "object", "audio", "video", "map", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "warning",
    "sidebar", "side", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus",
    "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "widgets", "pagination", "pager", "toolbar", "copyright", "disclaimer",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are not doubtful by the words of their class: they would take the whole page with them.
FRAME = {"html", "body"}
#: Weights of doubtful and of named elements; the part of the article's density that a doubtful element in it must have.
DOUBT, BOOST, DOUBTFUL = 0.1, 10.0, 0.25
#: Links that make a menu; repeats that make a list of comments, and the most characters of a byline.
MENU, REPEATS, BYLINE = 3, 2, 60
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
#: An element that begins closes an open one of these names, up to the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "kids", "skip", "doubt", "list", "link", "chars", "tags", "link_chars", "links", "density", "weight", "sum", "mass", "longest", "titled")

    def __init__(self, tag: str, parent: "Node | None", link: bool = False):
        self.tag, self.parent, self.link = tag, parent, link
        self.kids: list[Node | tuple[str, bool]] = []
        self.skip = self.doubt = self.list = self.titled = False
        self.chars = self.tags = self.link_chars = self.links = self.longest = 0
        self.density = self.sum = self.mass = 0.0
        self.weight = 1.0

    @property
    def typical(self) -> float:
        """The density in which a character of the node's leaves stands, in the mean."""
        return self.mass / max(self.chars, 1)

    def blocks(self) -> list["Node"]:
        """Its parts with text that are blocks of their own and may count."""
        return [k for k in self.kids if isinstance(k, Node) and k.chars and k.tag not in INLINE and not k.skip]


def _doubtful(value: str) -> bool:
    return any(w in WORDS for w in _WORD.findall(value))


def _judge(node: Node, attrs: str) -> None:
    """Whether the element never counts (skip), or is doubtful."""
    if node.tag in BOILERPLATE:
        node.skip = True
    if not attrs or node.tag in FRAME:
        return
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            node.skip = True
        elif name == "role" and value.strip() in ROLES:
            node.skip = True
        elif name in ("class", "id") and _doubtful(value):
            node.doubt = True


def tree(page: str) -> Node:
    """Blocks and their texts; a text is (string, whether a link holds it)."""
    root = Node("#root", None)
    stack, at, n = [root], 0, len(page)
    link = 0  # open <a> elements

    def pop_to(k: int) -> None:
        nonlocal link
        for x in stack[k:]:
            link -= x.link
        del stack[k:]

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append((s, link > 0))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare <
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if end:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k and tag in INLINE and any(x.tag not in INLINE for x in stack[k + 1 :]):
                k = 0  # a stray inline end tag doesn't close blocks
            if k:
                pop_to(k)
            elif tag == "p":
                stack[-1].kids.append(Node("p", stack[-1]))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            low = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    low = k
                if stack[k].tag in bounds:
                    break
            if low:
                pop_to(low)
        if tag in VOID:
            stack[-1].kids.append(Node(tag, stack[-1]))
            continue
        node = Node(tag, stack[-1], link=tag == "a")
        _judge(node, m[3] or "")
        stack[-1].kids.append(node)
        if not (m[3] or "").rstrip().endswith("/") or tag in INLINE or tag in CLOSES_P:
            stack.append(node)
            link += node.link
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        found.append(x)
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return found


def _count(nodes: list[Node]) -> None:
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, Node):
                x.chars += k.chars
                x.link_chars += k.link_chars
                x.links += k.links + k.link
                x.tags += k.tags + (k.tag not in INLINE and k.tag != "br" or k.link)
            else:
                c = len("".join(html.unescape(k[0]).split())) if "&" in k[0] else len("".join(k[0].split()))
                x.chars += c
                x.link_chars += c * k[1]


def _unit(x: Node) -> bool:
    """Whether a node is a byline with a text: first something short that names (a link, time, bold or small text), then more."""
    inner = x
    while len(b := inner.blocks()) == 1 and not any(isinstance(k, tuple) and k[0].strip() for k in inner.kids):
        inner = b[0]
    parts = [k for k in inner.kids if isinstance(k, Node) and k.chars or isinstance(k, tuple) and k[0].strip()]
    if len(parts) < 2 or not isinstance(parts[0], Node) or parts[0].tag in HEADINGS or parts[0].chars > BYLINE:
        return False
    names, rest = [parts[0]], sum(k.chars if isinstance(k, Node) else len(k[0].strip()) for k in parts[1:])
    for n in names:
        if n.link or n.tag in ("b", "strong", "cite", "time", "small", "address", "em", "i"):
            return rest > 0
        names += [k for k in n.kids if isinstance(k, Node)]
    return False


def _density(chars: int, tags: int, link_chars: int, links: int, part: float) -> float:
    """Composite density; part: the link characters of the body's characters."""
    if not chars:
        return 0.0
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + part * chars + math.e)
    ratio = chars * max(tags, 1) / (max(link_chars, 1) * max(links, 1))
    return chars / max(tags, 1) * max(0.0, math.log(max(ratio, 1.0)) / math.log(max(base, 1.05)))


def _weigh(nodes: list[Node], body: Node) -> None:
    """Densities and their weights; nodes: parents first."""
    part = body.link_chars / max(body.chars, 1)
    title, within = None, set()
    for x in nodes:
        if x.tag in ("main", "article") or id(x.parent) in within:
            within.add(id(x))
        if x.parent and x.parent.skip and not (x.parent.tag == "header" and id(x) in within):
            x.skip = True
        if x.tag == "h1" and x.chars and not x.skip and title is None:
            title = x
    x = title
    while x is not None:  # what holds the title holds the article, whatever its name
        x.titled, x.doubt, x = True, False, x.parent
    for x in reversed(nodes):
        x.density = _density(x.chars, x.tags, x.link_chars, x.links, part)
        blocks = x.blocks()
        named = blocks[1:] if blocks and blocks[0].tag in HEADINGS else blocks  # such a list may be headed
        x.list = len(named) >= REPEATS and x.tag not in FRAME and not x.titled and len({k.tag for k in named}) == 1 and all(_unit(k) for k in named)
    for x in nodes:
        above = x.parent.weight if x.parent else 1.0
        x.weight = above * (DOUBT if x.doubt or x.list else 1.0)
    for x in reversed(nodes):
        blocks = x.blocks()
        inside = [k for k in x.kids if isinstance(k, Node) and k.tag not in INLINE]
        chars, link_chars = x.chars - sum(k.chars for k in inside), x.link_chars - sum(k.link_chars for k in inside)
        own = x.density if not blocks else _density(chars, 1, link_chars, 1, part)  # text of its own beside blocks is a leaf
        x.sum = own * x.weight + sum(k.density * k.weight * (BOOST if k is title else 1.0) for k in blocks if not (k.doubt or k.list))
        x.mass, x.longest = own * chars + sum(k.mass for k in blocks), max([chars, *(k.longest for k in blocks)])
        if x.tag in ("main", "article"):
            x.sum *= BOOST


def _menu(x: Node) -> bool:
    return x.links >= MENU and x.link_chars >= x.chars


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    nodes = _order(root)
    _count(nodes)
    body = next((x for x in nodes if x.tag == "body"), root)
    _weigh(nodes, body)
    best, todo = body, [body]
    while todo:  # parents first, so that the outermost of equal sums stays
        x = todo.pop()
        if x.tag not in INLINE and x.chars and (x.sum > best.sum or best is body and not x.skip and x.sum >= best.sum > 0 and x is not body and len(body.blocks()) == 1):
            best = x
        todo += reversed(x.blocks())
    taken, path = {id(best)}, best
    threshold = best.density
    while path is not body and path.parent not in (None, body):
        path = path.parent
        threshold = min(threshold, path.density)
    path = best
    while path is not body and path.parent is not None:
        for k in path.parent.blocks():
            if k is not path and k.tag == path.tag and not (k.doubt or k.list) and k.chars and bool(k.blocks()) == bool(path.blocks()) and k.density >= threshold:
                taken.add(id(k))
        path = path.parent
    least = DOUBTFUL * best.typical
    blocks: list[list[str]] = [[]]
    #: (node or text or end of a block, whether it is taken, whether only headings are)
    todo2: list[tuple[Node | tuple[str, bool] | None, bool, bool]] = [(body, id(body) in taken, False)]
    while todo2:
        x, inside, heads = todo2.pop()
        if x is None:
            blocks.append([])
            continue
        if isinstance(x, tuple):
            if inside and not heads:
                blocks[-1].append(x[0])
            continue
        if x.skip and x is not body:
            if not (inside and x.tag == "header"):
                continue
            heads = True
        if inside and x is not best and id(x) not in taken and x.tag not in INLINE and x.tag not in HEADINGS and (_menu(x) or x.list or x.doubt and (x.typical < least or x.longest < BYLINE)):
            continue
        inside, heads = inside or id(x) in taken, heads and x.tag not in HEADINGS
        if x.tag not in INLINE and x.tag != "wbr":
            blocks.append([])
            todo2.append((None, False, False))
        todo2 += [(k, inside, heads) for k in reversed(x.kids)]
    return " ".join(t for b in blocks if b and (t := " ".join(html.unescape("".join(b)).split())))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (names get _ if taken)."""

    def make():
        def values(pages: list) -> list[list]:
            texts = [main_text(x) for x in pages]
            return [texts, [len(x) for x in texts]]

        return values

    return add_columns(pages, html_col, [("text", T.StringType()), ("n_chars", T.LongType())], make)
