"""Main-text extraction from web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations and tags. A quote counts only after an equals sign, and nothing is tried again, so that a page of
#: any shape is read in time linear in its length. PLAIN takes the rest of a page whose last tag never ends.
OTHER = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)"
TOKEN = re.compile(OTHER + r"|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*+|[^=>]|=)*+)(>|\Z)", re.S)
PLAIN = re.compile(OTHER + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What is never the article: scripts and styles, forms, menus, footers and sidebars.
DROP = {"script", "style", "noscript", "template", "svg", "math", "canvas", "iframe", "object", "form", "button", "select", "input", "textarea", "label", "nav", "menu", "footer", "aside", "head", "title", "dialog", "video", "audio"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
ARTICLE = {"article", "main"}
TOP = {"body", "html", "#root"}
#: What a start tag closes, of the open elements above the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words in class, id or role that mark adverts and reader comments, and other parts outside articles.
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "disqus"}
NOISE = ADVERTS | {"banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "sidebar", "sidenav", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "share", "sharing", "social", "related", "recommended", "widget", "reply", "replies", "respond", "contentinfo", "complementary", "search", "login", "toolbar", "skip"}
WORDS = re.compile(r"[a-z]+")
#: Whole names of adverts and comment lists, which go inside articles as well: such a word, or with what kind of block it is.
WHOLE = re.compile(rf"(?:{'|'.join(sorted(ADVERTS))})s?(?:[-_ ]?(?:list|section|area|thread|box|slot|unit|block|wrapper|container|body|form|banner))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self

    def elements(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]


def build(page: str) -> Node:
    """A DOM good enough for pages as they are: void and raw-text elements, implied end tags, stray end tags, cut-off ends.

    A tag that the page's end cuts off counts up to its first >, or to the end if there is none.
    """
    root = top = Node("#root", "", None)
    opened, pattern, at, size = Counter(), TOKEN, 0, len(page)

    def close(node: Node) -> Node:
        nonlocal top
        while top is not node.parent:
            opened[top.tag] -= 1
            top = top.parent
        return top

    while at < size:
        token = pattern.search(page, at)
        if token is None:
            top.kids.append(page[at:])
            break
        if token.start() > at:
            top.kids.append(page[at : token.start()])
        if token[2] and not token[4] and pattern is TOKEN:
            at, pattern = token.start(), PLAIN
            continue
        at = token.end()
        if not (tag := (token[2] or "").lower()) or not token[4]:
            continue
        if token[1]:
            node = top if opened[tag] else root
            while node is not root and node.tag != tag:
                node = root if tag in INLINE and node.tag not in INLINE else node.parent
            if node is not root:
                close(node)
            continue
        closing = {"p"} if tag in NO_P else CLOSES.get(tag, ())
        if any(opened[t] for t in closing):
            node = top
            while node is not root and node.tag in INLINE and node.tag not in closing:
                node = node.parent
            while node is not root and node.tag in closing:
                node = close(node)
        node = Node(tag, token[3], top)
        top.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not token[3].endswith("/"):
            opened[tag] += 1
            top = node
    return root


def walk(root: Node) -> Iterator[Node]:
    """All elements in page order, parents first; iterative, so depth does not matter."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.elements())


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs else {}


def prune(root: Node) -> None:
    """Take out scripts, forms, menus and the like by their tags, and what hides itself.

    Headers of the page go as well, those of an article stay.
    """
    inside = {root: False}
    for node in walk(root):
        within = inside[node] or node.tag in ARTICLE
        kept = []
        for k in node.kids:
            if not isinstance(k, str):
                if k.tag in DROP or k.tag == "header" and not within:
                    continue
                if k.attrs and k.tag not in TOP:
                    said = attributes(k)
                    if said.get("hidden", "until-found") != "until-found" or said.get("aria-hidden") == "true" or INVISIBLE.search(said.get("style", "")):
                        continue
                inside[k] = within
            kept.append(k)
        node.kids = kept


def prune_named(root: Node, order: list[Node]) -> None:
    """Take out adverts, reader comments, notices and sidebars that class, id or role name as such.

    Outside articles any word of a name counts. Inside, nothing goes but what is by its whole name adverts or a list of
    comments, so sections called search, promotion-history or comment-syntax stay. What holds an article is not noise,
    whatever its name; on a page without any, nor is what holds the largest density sum (of order, the measured nodes).
    """
    holds, articles = set(), [n for n in order if n.tag in ARTICLE]
    for node in articles or [max(order, key=lambda n: n.total)]:
        node = node.parent if articles else node
        while node is not None and node not in holds:
            holds.add(node)
            node = node.parent
    inside = {root: False}
    for node in walk(root):
        within = inside[node] or node.tag in ARTICLE
        kept = []
        for k in node.kids:
            if not isinstance(k, str):
                if k.attrs and k.tag not in INLINE and k.tag not in HEADINGS and k.tag not in TOP and k.tag != "main":
                    said = attributes(k)
                    names = " ".join(said.get(a, "") for a in ("class", "id", "role", "aria-label")).split()
                    if any(WHOLE.fullmatch(n) for n in names) and (k not in holds or not articles):
                        continue
                    words = [] if within or k.tag == "article" or k in holds else [w for n in names for w in WORDS.findall(n)]
                    if any(w in NOISE or w == "header" for w in words):
                        continue
                inside[k] = within
            kept.append(k)
        node.kids = kept


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags and links of every node, its composite density, and the sum of its children's densities."""
    order = [*walk(root)]
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(order):
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len(" ".join(kid.split()))
            else:
                node.chars, node.tags = node.chars + kid.chars, node.tags + kid.tags + 1
                node.link_chars += kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    whole = max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        node.density = 0.0
        if c:
            base = math.log(c / max(c - lc, 1) * lc + root.link_chars / whole * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1) + 1) / math.log(base + 1)
    for node in order:
        node.total = sum(k.density for k in node.elements() if k.tag not in INLINE and k.tag not in VOID)
    return order


def article(node: Node) -> Node:
    """The outermost article or main around a node, itself included, or else the node."""
    out, at = node, node
    while at is not None:
        if at.tag in ARTICLE:
            out = at
        at = at.parent
    return out


def select(order: list[Node]) -> list[Node]:
    """The subtrees of the main text in page order, by the threshold of the path from the largest density sum to the body.

    The first is the subtree with the largest density sum (the first of equal ones), raised below the body while siblings
    reach the threshold. To it comes every other block that reaches the threshold, wherever it stands, with its own subtree
    of the largest density sum, and the headings that stand before a part among its siblings or those of its ancestors. A
    part inside an article or main stands for all of it: of the outermost one nothing is left out.
    """
    best = max(order, key=lambda n: n.total)
    if best.total == 0:
        return [order[0]]
    path = [best]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    reaches = lambda k: k.chars and k.density >= threshold and k.link_chars * 2 < k.chars
    for node in path[1:]:
        if node.tag in TOP or not any(reaches(k) for k in node.elements() if k is not best):
            break
        best = node
    for node in reversed(order):
        node.best = max([node, *(k.best for k in node.elements())], key=lambda n: n.total)
    above, kept, stack = set(path), {article(best)}, [order[0]]
    while stack:
        node = stack.pop()
        if node not in kept and node not in above and reaches(node) and node.tag not in INLINE and node.tag not in VOID:
            kept.add(article(node.best))
        if node not in kept:
            stack += node.elements()
    for node in [*kept]:
        while node.parent is not None and node.tag not in TOP:
            near = node.parent.elements()
            kept.update(k for k in near[: near.index(node)] if k.tag in HEADINGS)
            node = node.parent
            if node in kept:
                break
    out, stack = [], [order[0]]
    while stack:
        node = stack.pop()
        if node in kept:
            out.append(node)
        else:
            stack += reversed(node.elements())
    return out


def blocks(node: Node) -> str:
    """All text below a node, block by block."""
    out, run, stack = [], [], [node]

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    while stack:
        kid = stack.pop()
        if kid is None:
            flush()
        elif isinstance(kid, str):
            run.append(kid)
        elif kid.tag == "br":
            run.append(" ")
        elif kid.tag in INLINE:
            stack += reversed(kid.kids)
        else:
            flush()
            stack += [None, *reversed(kid.kids)]
    flush()
    return " ".join(out)


def main_text(page: str | None) -> str:
    """The article of one whole page; empty if there is none. Null pages are empty ones."""
    if not page:
        return ""
    root = build(page)
    body = next((k for h in [root, *root.elements()] for k in h.elements() if k.tag == "body"), root)
    prune(body)
    prune_named(body, measure(body))
    return " ".join(filter(None, map(blocks, select(measure(body)))))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the page's main text and its code points. Other columns are left out.

    Null or empty html, pages without text, and an empty table give empty texts or no rows; repeated rows give repeated
    results. Of subtrees with equal density sums the first in page order counts. Pages of any length and depth are read to
    their end, in time linear in them. Rows are independent, so the work is one scan without a shuffle.
    """

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages.array], dtype=object)

    text = F.pandas_udf(run, "string")(F.col(html_col))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
