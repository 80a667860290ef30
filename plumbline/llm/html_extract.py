"""Main text of web pages by wrapper induction.

Pages of one host share a template. One small page of each host is the host's pivot;
every page's DOM tree is aligned with it by simple tree matching (the largest set of
node pairs that keeps parents and order; runs of equal siblings count as one repeated
node, so lists and paragraphs of any length align). A text that the same node of the
pivot has on most pages of the host is template; all else stands in varying slots. The
counts cover all different pages, copies of one having one vote together: (host, node,
text) triples are aggregated map-side, and only triples of most pages of a host are
kept, so a host has few however many pages it has. Trees of any depth are walked
without recursion.

Content is then the text in varying slots outside of what isn't an article by its
element or its class: menus, headers, footers, sidebars, forms, adverts, notices,
comments. A class or id counts as a whole: each of its words must name such a part or
be neutral (`site-header`, not `has-sidebar` or `article-search`), and an element that
holds the page's main part or article body is never outside by its class. Content is
looked for in the main part or article body only, or else in the articles if they hold
most of the text.

Blocks are joined by one space, white space inside a block is one space, character
references are decoded. Defined results: NULL and empty html give an empty text; a page
that is cut off is read as far as it goes; pages without a host are one host. Rows that
repeat are read alike. A host with fewer than MIN_PAGES different pages has no template.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.llm.common import map_batches

MIN_PAGES = 5
SUPPORT = 0.6
PIVOT_CHARS = 2048
#: Hosts up to this number have their pivots broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 2_000
#: The same for pages that have copies, without their text.
BROADCAST_COPIES = 500_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

#: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that don't end a block of text
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: elements that a new one of the same group closes: (what opens) -> what it closes, up to the nearest of the limits
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: block elements end an open paragraph
CLOSE_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: elements that are never part of an article's text
OUTSIDE = frozenset("nav footer aside form button dialog head fieldset menu input".split())
#: roles with the same meaning
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: words of classes and ids that name what isn't an article
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu topbar toolbar breadcrumb "
    "breadcrumbs sidebar side rail aside widget widgets footer foot header masthead cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond discussion disqus share sharing social "
    "related recommended recommendations trending pagination pager tags taglist skip hidden form search paywall disclaimer copyright".split()
)
#: words that may stand beside them in one class or id
NEUTRAL_WORDS = frozenset(
    "site page global main primary secondary top bottom left right upper lower sticky fixed mobile desktop post posts entry wrapper wrap container holder "
    "inner outer box block area section zone region slot unit panel group row column col list item items link links button buttons icon icons bar strip text "
    "title label js id module component cmp the my user view".split()
)
#: how much of an article an element is: none, an article, the main part or an article's body
NONE, ARTICLE, MAIN = 0, 1, 2


class Node:
    """An element: its tag, the nodes and texts in it, whether it is outside of articles (for sure, or by its class), and which part of one it is."""

    __slots__ = ("tag", "kids", "outside", "named", "article")

    def __init__(self, tag: str, outside: bool, named: bool, article: int):
        self.tag, self.outside, self.named, self.article = tag, outside, named, article
        self.kids: list[Node | str] = []


def names_outside(value: str) -> bool:
    """Whether one of the blank-separated names of a class or id consists of outside words, neutral ones aside."""
    for name in value.split():
        words = [w.rstrip("0123456789") for w in re.split(r"[^a-z0-9]+", name)]
        words = [w for w in words if w]
        if any(w in OUTSIDE_WORDS for w in words) and all(w in OUTSIDE_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


def _describe(tag: str, attributes: str) -> tuple[bool, bool, int]:
    """Whether an element is outside of articles, whether its class or id says so, and which part of an article it is."""
    outside, named = tag in OUTSIDE or tag == "header", False
    article = MAIN if tag == "main" else ARTICLE if tag == "article" else NONE
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            named |= names_outside(value)
        elif name == "role":
            outside |= value in OUTSIDE_ROLES
            article = max(article, MAIN if value == "main" else ARTICLE if value == "article" else NONE)
        elif name == "itemprop":
            article = max(article, MAIN if value == "articlebody" else NONE)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            outside = True
    page = tag in ("body", "html")
    return outside and not page, named and not page, article


def parse(page: str) -> Node:
    """The page's tree. What is missing at the end is closed there; stray end tags are skipped."""
    root = Node("#", False, False, NONE)
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag in INLINE | {"p", "li"}:
                    break
        elif m[3] or m[5]:
            tag = (m[3] or m[5]).lower()
            attributes = m[4] if m[3] else m[6]
            if tag in CLOSE_P:
                # a paragraph and the inline elements in it end here
                i = len(stack) - 1
                while i > 0 and stack[i].tag in INLINE:
                    i -= 1
                if i > 0 and stack[i].tag == "p":
                    del stack[i:]
            if tag in CLOSES:
                closed, limits = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in limits:
                        break
                    if stack[i].tag in closed:
                        del stack[i:]
                        break
            node = Node(tag, *_describe(tag, attributes))
            stack[-1].kids.append(node)
            if node.article == MAIN:
                for holder in stack:
                    holder.named = False
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


def plain(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """The element children, runs of the same tag as one."""
    out: list[tuple[str, list[Node]]] = []
    for k in node.kids:
        if isinstance(k, Node):
            if out and out[-1][0] == k.tag:
                out[-1][1].append(k)
            else:
                out.append((k.tag, [k]))
    return out


class Template:
    """A pivot tree as nested runs with numbers; all members of a run are one node."""

    __slots__ = ("number", "kids")

    def __init__(self, number: int):
        self.number = number
        self.kids: list[tuple[str, Template]] = []


def _runs_of(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    merged: list[tuple[str, list[Node]]] = []
    for n in nodes:
        merged = _merge(merged, runs(n))
    return merged


def template_of(root: Node) -> Template:
    top, count = Template(0), 1
    todo = [(top, [root])]
    while todo:
        node, members = todo.pop()
        for tag, group in _runs_of(members):
            kid = Template(count)
            count += 1
            node.kids.append((tag, kid))
            todo.append((kid, group))
    return top


def _merge(a: list[tuple[str, list[Node]]], b: list[tuple[str, list[Node]]]) -> list[tuple[str, list[Node]]]:
    """One list of runs for all members of a run: runs of the same tag in the same order come together."""
    out, at = [], 0
    for tag, members in b:
        found = next((i for i in range(at, len(a)) if a[i][0] == tag), None)
        if found is None:
            out.append((tag, list(members)))
        else:
            out += [*a[at:found], (tag, a[found][1] + members)]
            at = found + 1
    return out + a[at:]


def match(template: Template, nodes: list[Node], numbers: dict[int, int]) -> int:
    """Simple tree matching of a run of page nodes with a template node; numbers: id of page node -> template node."""
    waiting = [_matching(template, nodes, numbers)]
    score: int | None = None
    while waiting:
        try:
            below = waiting[-1].send(score)
        except StopIteration as done:
            waiting.pop()
            score = done.value
        else:
            waiting.append(_matching(*below))
            score = None
    return score or 0


def _matching(template: Template, nodes: list[Node], numbers: dict[int, int]):
    """One level of the matching: asks for its children's by yielding their arguments, and returns its score."""
    for n in nodes:
        numbers[id(n)] = template.number
    a, b = template.kids, _runs_of(nodes)
    if not a or not b:
        return 1
    if [t for t, _ in a] == [t for t, _ in b]:
        total = 1
        for (_, kid), (_, members) in zip(a, b):
            total += yield kid, members, numbers
        return total
    trial: dict[tuple[int, int], dict[int, int]] = {}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (tag, kid) in enumerate(a, 1):
        for j, (other, members) in enumerate(b, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if tag == other:
                own: dict[int, int] = {}
                score = yield kid, members, own
                trial[i, j] = own
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + score)
    i, j = len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            numbers.update(trial[i, j])
            i, j = i - 1, j - 1
    return 1 + best[len(a)][len(b)]


def blocks(root: Node) -> list[tuple[str, Node, bool, int]]:
    """(text, innermost block element, outside, which part of an article it is in) of each block of text, in page order."""
    out: list[tuple[str, Node, bool, int]] = []
    piece: list[str] = []
    state: list[tuple[Node, bool, int]] = [(root, False, NONE)]

    def close() -> None:
        text = plain("".join(piece))
        piece.clear()
        if text:
            out.append((text, *state[-1]))

    todo: list[tuple[Node, int, bool, int]] = [(root, 0, False, NONE)]
    while todo:
        node, at, outside, article = todo.pop()
        if at == len(node.kids):
            if node.tag not in INLINE or outside != state[-1][1]:
                close()
                state.pop()
                if not state:
                    state.append((root, False, NONE))
            continue
        todo.append((node, at + 1, outside, article))
        kid = node.kids[at]
        if isinstance(kid, str):
            piece.append(kid)
        elif kid.tag in VOID:
            if kid.tag in ("br", "hr"):
                piece.append("\n")
        else:
            inner = max(article, kid.article)
            # the head of an article isn't the page's
            away = outside or kid.named or (kid.outside and not (kid.tag == "header" and article))
            if kid.tag not in INLINE or away != outside:
                close()
                state.append((kid, away, inner))
                todo.append((kid, 0, away, inner))
            else:
                todo.append((kid, 0, away, inner))
    return out


def text_of(page: str, pivot: Template | None, constant: set[tuple[int, int]]) -> str:
    root = parse(page)
    numbers: dict[int, int] = {}
    if pivot is not None and constant:
        match(pivot, [root], numbers)
    found = [b for b in blocks(root) if not b[2]]
    sizes = [sum(len(text) for text, _, _, part in found if part >= level) for level in (NONE, ARTICLE, MAIN)]
    least = MAIN if sizes[MAIN] else ARTICLE if 2 * sizes[ARTICLE] >= sizes[NONE] else NONE
    return " ".join(text for text, node, _, part in found if part >= least and (numbers.get(id(node), -1), _hash(text)) not in constant)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class _Pivots(dict):
    """Pivot trees of a task's hosts."""

    def of(self, page: str) -> Template:
        if page not in self:
            if len(self) >= 256:
                self.clear()
            self[page] = template_of(parse(page))
        return self[page]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce(pages: DataFrame, url: str, html: str, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, pivot, constant) by host: the pivot page, and (node, text hash) pairs of its template."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("page")).where("page is not null").withColumn("h", F.xxhash64("page"))
    copies = cut(rows.groupBy("host", "h").agg(F.count("*").alias("copies")))
    different = copies.groupBy("host").agg(F.count("*").alias("n"))
    distance = F.struct(F.abs(F.length("page") - PIVOT_CHARS), F.xxhash64("page"))
    pivots = cut(rows.groupBy("host").agg(F.min_by("page", distance).alias("pivot")).join(different, "host"))

    def run(batches):
        trees = _Pivots()
        for b in batches:
            counts: dict[tuple[str, int, int], float] = defaultdict(float)
            for host, page, pivot, copies in zip(b["host"], b["page"], b["pivot"], b["copies"]):
                root = parse(page)
                numbers: dict[int, int] = {}
                match(trees.of(pivot), [root], numbers)
                for k in {(host, numbers[id(node)], _hash(text)) for text, node, _, _ in blocks(root) if id(node) in numbers}:
                    counts[k] += 1 / (copies or 1)
            keys = list(counts)
            yield {"host": [k[0] for k in keys], "node": [k[1] for k in keys], "text": [k[2] for k in keys], "c": [counts[k] for k in keys]}

    # all copies of a page have one vote together
    voting = rows.join(_few(pivots.where(F.col("n") >= min_pages).select("host", "pivot")), "host").join(_few(copies.where("copies > 1"), BROADCAST_COPIES), ["host", "h"], "left")
    seen = map_batches(voting.select("host", "page", "pivot", "copies"), run, "host string, node int, text bigint, c double")
    often = seen.groupBy("host", "node", "text").agg(F.sum("c").alias("c")).join(pivots.select("host", "n"), "host").where(F.col("c") >= support * F.col("n") - 1e-6)
    # at most nodes / support pairs by host
    constant = often.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("constant"))
    return pivots.join(constant, "host").select("host", "pivot", "constant")


def _few(rows: DataFrame, most: int = BROADCAST_HOSTS) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) for every row of `pages`."""
    hosts = cut(induce(pages, url, html))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(html).alias("page"), host_of(F.col(url)).alias("host"))

    def run(batches):
        trees = _Pivots()
        for b in batches:
            out = []
            for page, pivot, constant in zip(b["page"], b["pivot"], b["constant"]):
                known = {(c["node"], c["text"]) for c in constant or ()}
                out.append(text_of(page or "", trees.of(pivot) if known else None, known))
            yield {"k": b["k"], "url": b["url"], "text": out}

    return map_batches(rows.join(_few(hosts), "host", "left").select("k", "url", "page", "pivot", "constant"), run, "k bigint, url string, text string").withColumnRenamed("k", key)
