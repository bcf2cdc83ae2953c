"""Main text of web pages by tree scoring.

One pass over the markup builds the tree of block elements, leaving out what is never main text
(navigation, page headers, footers, asides, forms, scripts, adverts, notices, comments, hidden parts).
Every text block passes points for its length and commas to its ancestors, less the farther away they
are; a container's points are discounted by the share of its text that is links. The best container is
kept whole (as part of the article around it, if there is one), with those of its siblings that score or
read like text.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkboard.llm.shared import column, valid_text

# Names of HTML elements, roles, and words of class names and ids.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img br".split()
)
NEVER = set(
    "head script style textarea title iframe noembed noframes noscript template svg canvas object nav footer aside "
    "button select option datalist dialog menu search audio video map".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = set("p pre blockquote ul ol dl table figure".split()) | HEADINGS
#: Whose own text is a paragraph beside its children.
CONTAINERS = set("html body div section article main center td th details fieldset form blockquote figure dd li".split())
SCOPES = set("html body table td th caption article section div main".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promoted promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup popover modal overlay lightbox newsletter "
    "subscribe subscription signup login paywall sidebar sidebars rail aside comment comments commentlist disqus respond replies reply "
    "related recommended recommendations recirc trending popular share sharing social sharebar follow menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pager pagination footer header masthead topbar toolbar skip skiplink widget widgets "
    "toc tags taglist outbrain taboola disclaimer copyright hidden visuallyhidden offscreen announcement survey feedback".split()
)
#: Of these, the words by which an article is not the page's own.
ASIDE = set("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
#: A word after one of these says what a container has around it, not what it is.
BESIDE = set("with has no without hide show is".split())

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'>/=]+)""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Characters of attributes up to which the judgement on them is remembered.
REMEMBERED = 300


@functools.lru_cache(20_000)
def _unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """(hidden or of an unwanted role, unwanted by its class or id)."""
    found = {m[1].lower() if m[1] else m[5].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    hidden |= bool(ROLES & set(found.get("role", "").lower().split()))
    words = set() if tag in ("html", "body", "main", "h1") else ASIDE if tag == "article" else WORDS
    return hidden, any(_is_named(x, words) for x in (found.get("class", "") + " " + found.get("id", "")).split())


def _is_named(name: str, words: set[str]) -> bool:
    parts = [p.lower() for p in NAME.findall(name)]
    return any(p in words and not (k and parts[k - 1] in BESIDE) for k, p in enumerate(parts))


@dataclass
class Node:
    tag: str
    parent: int
    last: int = 0  # the last node inside
    points: float = 0.0
    length: int = 0
    linked: int = 0


@dataclass
class Block:
    """A run of text in one block element."""

    node: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str, int]]  # (node, text, characters of links)


def parse(markup: str, forms: bool, names: bool) -> Page:
    """The tree of wanted block elements and their text. `forms`, `names`: leave out forms, elements by name."""
    nodes, blocks = [Node("html", -1)], []
    # Open elements: (tag, its node or that of the block around it, is a node, is a link, starts what is left out)
    stack: list[tuple[str, int, bool, bool, bool]] = []
    at, skipping, links, articles = 0, 0, 0, 0
    now = Block(0)
    # Where on the stack elements are by tag, and scopes of any tag: what is not open costs no search.
    places: dict[str, list[int]] = {}
    scopes = [-1]

    def flush(node: int) -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.parts)).split()) if now.parts else ""
        if text:
            blocks.append((now.node, text, min(now.linked, len(text))))
        now = Block(node)

    def pop() -> None:
        nonlocal skipping, links, articles
        tag, node, is_node, is_link, skips = stack.pop()
        places[tag].pop()
        if tag in SCOPES:
            scopes.pop()
        skipping -= skips
        links -= is_link
        articles -= tag == "article"
        if is_node:
            nodes[node].last = len(nodes) - 1
            flush(stack[-1][1] if stack else 0)

    def last(*tags: str) -> int:
        """The place of the innermost open element of these tags, -1 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def end(k: int) -> None:
        while len(stack) > k:
            pop()

    def add(text: str) -> None:
        if not skipping and text:
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())

    while at < len(markup):
        token = TOKEN.search(markup, at)
        if token is None:
            add(markup[at:])
            break
        add(markup[at:token.start()])
        at = token.end()
        if token[1] is not None:
            add(token[1])
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        if token[2] or token[5]:
            if tag == "br":
                add(" ")
            elif tag == "p" and last("p") < 0:
                flush(stack[-1][1] if stack else 0)
            elif (k := last(tag)) >= (scopes[-1] if tag in INLINE else 0) and k >= 0:
                end(k)
            continue
        attributes = token[4] if token[3] else token[7]
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(markup, at)
            at = close.end() if close else len(markup)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
            continue
        if tag in ENDS_PARAGRAPH and (k := last("p")) > scopes[-1]:
            end(k)
        if tag in CLOSED_BY:
            ended, within = CLOSED_BY[tag]
            while (k := last(*ended)) > last(*within):
                end(k)
                if not any(t[0] in ended for t in stack[max(0, k - 2):k]):
                    break
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        judge = _unwanted if len(attributes) <= REMEMBERED else _unwanted.__wrapped__
        hidden, named = judge(tag, attributes) if attributes.strip() else (False, False)
        skips = tag in NEVER or hidden or (named and names) or (tag == "form" and forms) or (tag == "header" and not articles)
        is_node = tag not in INLINE
        around = stack[-1][1] if stack else 0
        if is_node:
            nodes.append(Node(tag, around))
            node = len(nodes) - 1
            flush(node)
        else:
            node = around
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append((tag, node, is_node, tag == "a", skips))
        skipping += skips
        links += tag == "a"
        articles += tag == "article"
    while stack:
        pop()
    flush(0)
    nodes[0].last = len(nodes) - 1
    return Page(nodes, blocks)


def score(page: Page) -> None:
    """Points of every element from the text blocks inside: less the more elements lie between."""
    nodes = page.nodes
    for at, text, linked in page.blocks:
        points = 1 + len(text) / 100 + sum(map(text.count, ",،、，"))
        if nodes[at].tag in HEADINGS:
            points = 1
        points *= 1 - linked / len(text)
        above = at if nodes[at].tag in CONTAINERS else nodes[at].parent
        share = 1
        while above >= 0 and share <= 6:
            nodes[above].points += points / share
            above, share = nodes[above].parent, share + 1
        nodes[at].length += len(text)
        nodes[at].linked += linked
    # Lengths go up to all elements around: parents come before what is in them.
    for n in reversed(nodes[1:]):
        nodes[n.parent].length += n.length
        nodes[n.parent].linked += n.linked


def chosen(page: Page) -> list[tuple[int, int]]:
    """The ranges of nodes which make up the main text, in page order."""
    nodes = page.nodes

    def value(k: int) -> float:
        return nodes[k].points * (1 - nodes[k].linked / nodes[k].length) if nodes[k].length else 0.0

    best = max(range(len(nodes)), key=lambda k: (value(k), -k))
    around, article = best, -1
    while around >= 0:
        if nodes[around].tag in ("article", "main") and (article < 0 or nodes[around].tag == "article"):
            article = around
        around = nodes[around].parent
    if article >= 0:
        best = article
    kept = [best]
    parent = nodes[best].parent
    if article < 0 and parent >= 0:
        least = max(2.0, 0.2 * value(best))
        for k in range(parent + 1, nodes[parent].last + 1):
            n = nodes[k]
            if n.parent == parent and k != best and n.length:
                plain = n.linked / n.length < 0.25
                if value(k) >= least or (n.tag in TEXTUAL and plain):
                    kept.append(k)
    elif parent >= 0:
        # Further articles beside the best one are parts of it only if they read like it.
        kept += [
            k for k in range(parent + 1, nodes[parent].last + 1)
            if nodes[k].parent == parent and k != best and nodes[k].tag == nodes[best].tag and value(k) >= 0.5 * value(best)
        ]
    return sorted((k, nodes[k].last) for k in kept)


def main_text(markup: str | None) -> str:
    """The page's main text: blocks in page order, one space between them and for each white space inside."""
    if not markup:
        return ""
    # A page which lies in one form, or whose names mislead, is read again with less left out.
    for forms, names in ((True, True), (False, True), (False, False)):
        page = parse(markup, forms, names)
        if page.blocks:
            score(page)
            ranges = chosen(page)  # in order and apart from each other
            firsts = [a for a, _ in ranges]
            within = lambda at: (k := bisect_right(firsts, at)) > 0 and at <= ranges[k - 1][1]
            return " ".join(text for at, text, _ in page.blocks if within(at))
    return ""


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, the columns of `keep`, text, n_chars) per row; text is empty where there is none or the page is null.

    Bytes which are not UTF-8 are U+FFFD.
    """
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*names, "text", "n_chars"])

    rows = pages.select(valid_text(html_col).alias("__html"), *[column(c) for c in names])
    schema = rows.drop("__html").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
