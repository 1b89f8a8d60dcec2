"""Main text of web pages by tree scoring.

A page becomes a tree; menus, adverts, forms and the like are cut off. Every
paragraph earns points for its length and commas, passes them to its ancestors
(less to farther ones), and an ancestor's points are discounted by its link
density. The best container and those siblings that look like part of it are
the article.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A comment, a declaration or a tag; in a tag a quote counts after an equals sign only.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that start and end a block.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes: (tags to close, tags beyond which nothing is closed).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_STOPS = frozenset("button table td th caption object html body".split())

DROPPED = frozenset("nav aside form footer button select input textarea script style noscript iframe template dialog svg canvas object embed head title menu datalist map video audio".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Names of what isn't the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation navlinks newsletter notice notices notification pager pagination popup promo promoted "
    "promotion recommended related reply replies respond share sharing shoutbox sidebar signup skip skiplink social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split()
)
#: What such a name may be combined with and still mean the same.
PARTS = frozenset(
    "area aside bar block body bottom box buttons column container content div footer form global header inner item items left links list main menu mobile nav page panel "
    "popup post primary right row secondary section site slot text thread top unit wrap wrapper".split()
)
#: Names in a compound that may stand for an article's own part: such an element goes only if it is made of links.
LINKED = 0.5
KEPT = frozenset("html body article main".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCORED = frozenset("p pre td blockquote li dd figcaption div section article main h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.score = tag, attrs, parent, [], 0.0


def parse(page: str) -> Node:
    """The tree of a page: children are nodes or raw text. Unclosed and stray tags are forgiven."""
    root = Node("html", "", None)
    at, now = 0, root
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            now.children.append(page[at:])
            return root
        if m.start() > at:
            now.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                now = node.parent
            elif tag == "p":
                now.children.append(Node("p", "", now))
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            now = _closed(now, {"p"}, P_STOPS)
        if tag in CLOSES:
            now = _closed(now, *CLOSES[tag])
        node = Node(tag, m[3] or "", now)
        now.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            if end is None:
                return root
            at = page.find(">", end.end())
            if at < 0:
                return root
            at += 1
        elif tag not in VOID and not (foreign(now) and (m[3] or "").endswith("/")):
            now = node


def foreign(node: Node | None) -> bool:
    """Whether a tag here closes itself by a final slash, as it does inside of formulas and drawings only."""
    while node is not None and node.tag not in BLOCK:
        if node.tag in ("math", "svg"):
            return True
        node = node.parent
    return False


def _closed(now: Node, tags: set[str], stops: frozenset[str] | set[str]) -> Node:
    node = now
    while node is not None and node.tag not in stops:
        if node.tag in tags:
            return node.parent or node
        node = node.parent
    return now


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def named(names: str) -> tuple[bool, bool]:
    """Whether one of an element's names says that it isn't the article, and whether one merely holds such a word.

    The first takes a whole name: a word of the list, or several of which all
    others say only where or what kind of a box it is (``site-footer``, but not
    ``has-sidebar`` or ``related-work``).
    """
    surely = perhaps = False
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        held = sum(w in DROPPED_WORDS for w in words)
        perhaps |= held > 0
        surely |= held > 0 and all(w in DROPPED_WORDS or w in PARTS for w in words)
    return surely, perhaps


def _contents(root: Node) -> dict[int, tuple[int, int, bool]]:
    """For each element, by id: its text's length, that inside links, and whether the article lies in it."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        order.append((node, link))
        stack += [(c, link) for c in node.children if not isinstance(c, str)]
    out: dict[int, tuple[int, int, bool]] = {}
    for node, link in reversed(order):
        size, linked, article = 0, 0, False
        for c in node.children:
            if not isinstance(c, str):
                n, k, held = out[id(c)]
                size, linked, article = size + n, linked + k, article or held or c.tag in ARTICLE
            elif node.tag not in RAW:
                n = len(c.strip())
                size, linked = size + n, linked + n * link
        out[id(node)] = size, linked, article
    return out


def unwanted(node: Node, inside: bool, contents: dict[int, tuple[int, int, bool]]) -> bool:
    """Whether an element can't be part of an article; ``inside`` tells that one has begun.

    A name drops an element unless the page's article or main part lies in it;
    one that only holds a listed word drops it if it is made of links.
    """
    tag = node.tag
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not node.attrs or node.attrs.isspace():
        return False
    a = _attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in DROPPED_ROLES:
        return True
    if tag in KEPT:
        return False
    names = a.get("class", "") + " " + a.get("id", "")
    surely, perhaps = named(names)
    size, linked, article = contents[id(node)]
    if not inside and "header" in names.lower().split():
        surely = True
    if surely:
        return inside or not article
    return perhaps and linked >= LINKED * size


def prune(root: Node) -> None:
    """Cut off unwanted elements; of a header inside an article only headings stay."""
    stack, contents = [(root, False, False)], _contents(root)
    while stack:
        node, inside, header = stack.pop()
        inside = inside or node.tag in ("article", "main")
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if not header or node.tag in HEADINGS:
                    kept.append(c)
            elif not unwanted(c, inside, contents):
                kept.append(c)
                stack.append((c, inside, (header or c.tag == "header") and c.tag not in HEADINGS))
        node.children = kept


def _measure(root: Node) -> dict[int, tuple[str, int, int, bool]]:
    """For each element, by id: its own run of text, all its text's length, its link text's length, whether it holds blocks."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.tag == "a"
        order.append((node, link))
        stack += [(c, link) for c in node.children if not isinstance(c, str)]
    out: dict[int, tuple[str, int, int, bool]] = {}
    for node, link in reversed(order):
        own, size, linked, blocks = [], 0, 0, False
        for c in node.children:
            if isinstance(c, str):
                t = html.unescape(c) if "&" in c else c
                own.append(t)
                n = len(t.strip())
                size += n
                linked += n * link
            else:
                text, n, k, b = out[id(c)]
                size, linked = size + n, linked + k
                if c.tag in BLOCK or b:
                    blocks = True
                else:
                    own.append(" " if c.tag == "br" else text)
        out[id(node)] = ("".join(own), size, linked, blocks)
    return out


def best_container(root: Node) -> list[Node]:
    """The best container and its kept siblings, in page order; empty for a page without text."""
    measured = _measure(root)
    every, stack = [], [root]
    while stack:
        node = stack.pop()
        every.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    for node in every:
        if node.tag == "article" or node.tag == "main":
            node.score += 25
        if node.tag not in SCORED:
            continue
        text = SPACE.sub(" ", measured[id(node)][0]).strip()
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up, level = node.parent, 0
        while up is not None:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
            if level > 6:
                break

    def density(node: Node) -> float:
        _, size, linked, _ = measured[id(node)]
        return linked / size if size else 0.0

    final = {id(n): n.score * (1 - density(n)) for n in every}
    holds = [n for n in every if measured[id(n)][1]]
    if not holds:
        return []
    top = max(holds, key=lambda n: (final[id(n)], n.tag == "article"))
    if final[id(top)] <= 0:  # no paragraph of some length: the lowest blocks whose text isn't mostly links
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            own = SPACE.sub(" ", measured[id(node)][0]).strip()
            if not measured[id(node)][3] or own:
                if measured[id(node)][1] and density(node) < LINKED:
                    out.append(node)
                continue
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
        return out
    if top.parent is None or top.tag == "body":
        return [top]
    least = max(10.0, 0.2 * final[id(top)])
    kept = []
    before = True
    for c in top.parent.children:
        if c is top:
            kept.append(c)
            before = False
        elif not isinstance(c, str):
            text, size, _, _ = measured[id(c)]
            prose = c.tag == "p" and size and (density(c) < 0.25 if size > 80 else density(c) == 0 and re.search(r"[.!?。](\s|$)", text))
            heading = c.tag in ("h1", "h2") and before and density(c) == 0
            if final[id(c)] >= least or prose or heading:
                kept.append(c)
    return kept


def blocks_of(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below ``nodes``, in page order, white space folded."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[tuple[object, bool]] = [(n, False) for n in reversed(nodes)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            run.append(node)
            continue
        cell = node.tag in ("td", "th")
        if node.tag in BLOCK and not cell:
            end()
        elif node.tag == "br" or cell:
            run.append(" ")
        if not done and node.children:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children)]
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n\n".join(blocks_of(best_container(root)))


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the main text of each whole page.

    Null and empty pages, pages without text and pages of links only give an
    empty string. Very long pages are read whole. Of containers with equal
    points an article goes first, then the one that the search meets first,
    which goes by the page's tree alone. Rows are independent, so
    repeated rows and null keys keep their own result, and an empty table gives
    an empty table; a column already called ``out`` is replaced, all others pass
    through.
    """
    return pages.withColumn(out, _main_text(F.col(html_col)))
