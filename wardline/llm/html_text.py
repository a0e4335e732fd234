"""Main text of web pages by composite text density.

A page becomes a tree without its menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments. Where only a class, id or role says so, the last piece of one of its names must ("cookie-notice", but not
"notice-text" or "has-banner"), and the element must not hold the article or most of the text; if nothing is left
the names are not heeded. Every node gets its characters per tag, adjusted by the characters and tags inside links; a
node's density sum is that of its children. The node with the largest sum is found; the least density between
it and the body is the threshold, and in every node above it the largest sum marks content. The text is that
of the smallest subtree that holds all marks, or of the article or main element around it.

Pages are independent, so nothing is shuffled and a task holds one page's tree at a time.

Defined results: a null or empty page, or one without any text, gives an empty string; markup that never ends
is dropped to the end of the page; extra columns are dropped; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: first pieces of names that speak of something else on the page
ABOUT = frozenset("has no with without not is show hide open".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: elements that are never part of the article
OUTSIDE = RAW | frozenset(
    "head nav header footer aside button select option input svg canvas object audio video menu map applet".split()
)
#: elements that are none unless they hold the article, as a form around the whole page does
HOLDERS = frozenset("form fieldset dialog template".split())
#: words of a class, id or role that say the same
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended recommendations comment comments commentlist respond disqus "
    "widget toolbar pagination pager search contentinfo complementary copyright dialog form".split()
)
#: pieces that may follow such a word, or come before it, and say only where or how it stands
LAYOUT = frozenset(
    "list area container wrapper wrap box bar left right top bottom links section block inner outer content item "
    "items body main group panel unit slot posts stories articles thread children entry row col column".split()
)
PLACES = frozenset("site page post entry global wp blog".split())
WHOLE = frozenset("html body article main".split())  # their own names never exclude them
#: an opening tag ends these open elements, up to the nearest of the others
ENDS = {
    **dict.fromkeys(
        "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 "
        "h4 h5 h6 header hr main menu nav ol p pre section table ul".split(),
        ({"p"}, {"td", "th", "button", "object", "body", "div", "article", "li", "section", "main"}),
    ),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
    "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "up", "parts", "never", "named", "out", "plain", "chars", "tags", "link_chars", "links", "density", "sum")

    def __init__(self, tag: str, up: Node | None, never: bool, named: bool = False):
        self.tag, self.up, self.never, self.named, self.out = tag, up, never, named, never
        self.parts: list[str | Node] = []


def _outside(tag: str, attributes: str) -> bool:
    """Do class, id or role say that it is no part of the article?

    A name does if its last piece is such a word, or if it begins with one and only places follow: ``comment-list``
    and ``sidebar-left`` do, ``related-work`` does not.
    """
    if not attributes or tag in WHOLE:
        return False
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            pieces = _PIECES.findall(_CAMEL.sub("-", name).lower())
            if not pieces or pieces[0] in ABOUT:
                continue
            if pieces[-1] in OUTSIDE_NAMES:
                return True
            while len(pieces) > 1 and pieces[0] in PLACES:
                del pieces[0]
            if pieces[0] in OUTSIDE_NAMES and all(x in OUTSIDE_NAMES or x in LAYOUT for x in pieces):
                return True
    return False


def tree(page: str) -> Node:
    root = now = Node("body", None, False)
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            now.parts.append(page[at:])
            break
        if m.start() > at:
            now.parts.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m[1]:
            node = now
            while node is not root and node.tag != tag:
                node = node.up
            if node is not root:
                now = node.up
            continue
        if tag in ENDS:
            closed, held = ENDS[tag]
            node = now
            while node is not root and node.tag not in closed and node.tag not in held:
                node = node.up
            if node.tag in closed:
                now = node.up
        child = Node(tag, now, now.never or tag in OUTSIDE, _outside(tag, m[3]))
        now.parts.append(child)
        if tag in RAW:  # not markup inside
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
            child.never = child.out = True
        elif tag not in VOID and not m[3].endswith("/"):
            now = child
        elif tag not in VOID:
            now = child if tag not in ("svg", "path") else now
    return root


def judge(root: Node, by_name: bool) -> None:
    """Marks what is left out: ``OUTSIDE`` elements, ``HOLDERS`` and, with ``by_name``, what is named so.

    Never a node with the largest article or main element of the page in it, nor, on a page without such an element
    elsewhere, one with more than half of the text outside links. A form needs a paragraph for that, too.
    """
    nodes, i = [root], 0
    while i < len(nodes):
        nodes += [c for c in nodes[i].parts if type(c) is Node and not c.never]
        i += 1
    prose: set[int] = set()
    for n in reversed(nodes):
        if n.up is not None and (n.tag == "p" or id(n) in prose):
            prose.add(id(n.up))
        n.plain = 0 if n.tag == "a" else sum(len(p.strip()) if type(p) is str else 0 if p.never else p.plain for p in n.parts)
    wholes = [n for n in nodes if n.tag in ("article", "main") and n.plain]
    n = max(wholes, key=lambda n: n.plain, default=None)
    held = set()
    while n is not None:
        held.add(id(n))
        n = n.up
    for n in nodes[1:]:
        most = not wholes and 2 * n.plain > root.plain
        holder = n.tag in HOLDERS
        said = holder or (by_name and n.named)
        n.out = n.up.out or (said and id(n) not in held and not (most and (not holder or id(n) in prose)))


def _order(root: Node) -> list[Node]:
    """Nodes inside the article candidates, parents first."""
    nodes, i = [root], 0
    while i < len(nodes):
        nodes += [c for c in nodes[i].parts if type(c) is Node and not c.out]
        i += 1
    return nodes


def measure(nodes: list[Node]) -> None:
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.links = 0
    for n in reversed(nodes):
        for p in n.parts:
            if type(p) is str:
                n.chars += len(p.strip())
            elif not p.out:
                n.chars += p.chars
                n.tags += p.tags + 1
                n.link_chars += p.link_chars
                n.links += p.links + (p.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body = nodes[0]
    ratio = body.link_chars / (body.chars or 1)
    for n in nodes:
        c, t, lc = n.chars, n.tags or 1, n.link_chars
        n.density = c / t
        if c and ratio:
            base = math.log(c / ((c - lc) or 1) * lc + ratio * c + math.e)
            if base > 1:
                n.density *= max(0.0, math.log(c / (lc or 1) * t / (n.links or 1))) / math.log(base)
        n.sum = 0.0
    for n in nodes[1:]:
        n.up.sum += n.density


def article(root: Node) -> Node | None:
    nodes = _order(root)
    measure(nodes)
    if not root.chars:
        return None
    best = max(nodes, key=lambda n: n.sum)  # the first of equals
    if best.sum <= 0:
        return root
    least, n = best.density, best
    while n.up is not None:
        n = n.up
        least = min(least, n.density)
    # the largest sum in every subtree, then the marks
    top: dict[int, Node] = {}
    for n in reversed(nodes):
        own = top.setdefault(id(n), n)
        if own.sum < n.sum:
            own = top[id(n)] = n
        if n.up is not None and top.setdefault(id(n.up), n.up).sum < own.sum:
            top[id(n.up)] = own
    marks = {id(m): m for n in nodes if n.density >= least and n.density > 0 for m in (top[id(n)],)}
    held: dict[int, int] = dict.fromkeys(marks, 1)
    for n in reversed(nodes):
        if id(n) in held and n.up is not None:
            held[id(n.up)] = held.get(id(n.up), 0) + held[id(n)]
    found = next(n for n in reversed(nodes) if held.get(id(n)) == len(marks))
    whole, n = found, found
    while n is not None:
        if n.tag in ("article", "main"):
            whole = n
        n = n.up
    return whole


def text_of(node: Node) -> str:
    """Blocks in page order, white space as one space, character references decoded."""
    out: list[str] = []
    todo: list[str | Node] = [node]
    while todo:
        x = todo.pop()
        if type(x) is str:
            out.append(html.unescape(x) if "&" in x else x)
        elif not x.out or x is node:
            inline = x.tag in INLINE
            if not inline:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.parts)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    root = tree(page or "")
    for by_name in (True, False):  # names do not empty a page
        judge(root, by_name)
        found = article(root)
        text = "" if found is None else text_of(found)
        if text:
            return text
    return ""


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of each page."""
    rows = pages.select(*keep, html_column)
    kept = rows.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            chars = pa.array([len(x) for x in texts], pa.int64())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), chars], [*keep, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
