"""Main text of web pages by tag-path ratios.

Text nodes are gathered by their root-to-leaf tag path. A path's text ratio is its characters per node, its
punctuation ratio its sentence marks per node; both are smoothed over neighbouring paths in page order and fused as
their geometric mean. Paths whose weight, fused ratio x length, reaches a share of the heaviest one's are content; <article>
and <main> only count their paths' weights more. If all content lies in those tags, the text outside them goes. What shares the content's
place is kept, except link lists and, beside content, plain boxes whose own ratio is poor.

Marks of page furniture (tags, and class, id or role names) are priors too: a marked element's text goes unless it
outweighs the rest of the page by far.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw content, that end a paragraph, and that are page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object select title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("aside form fieldset search".split())
#: Never the wrapper of a page: their text stays only if it is of an article or main element within.
HARD = frozenset("nav footer button menu dialog label".split())
IMPLIED = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
STOPS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: A paragraph outside of the innermost of these stays open when a block begins in it.
HOLDS = ("td", "th", "li", "div", "article", "section", "main", "body")
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
GROUPS = frozenset("ul ol dl menu table div section article main body center".split())
SIDE = frozenset("div center".split())
WHOLE = frozenset("article main div center body html".split())
#: A box with one of these is more than a plain one.
FORMED = TITLES | frozenset("table blockquote pre figure ul ol dl section".split())
#: Words of class, id and role names that mark page furniture.
MARKS = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments discussion respond replies reply disqus widget toolbar search form complementary contentinfo dialog hidden".split())
#: Words that may stand beside them in one name, as in ad-slot; any other word makes it another name, as in search-results.
BESIDE = frozenset("site page top bottom left right list item items box bar block slot unit link links button buttons posts icons".split())

#: Those that on a paragraph, heading or table of an article rather say what it is about.
TOPICS = frozenset("search form alert notice header footer menu dialog toolbar widget banner overlay login hidden".split())
PROSE = TITLES | frozenset("p table tbody thead tr td th caption blockquote pre figure figcaption li dt dd em strong b i span code".split())

#: A name, then perhaps = and a value; a quote opens a value only right after =.
_ONE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
_ATTR = re.compile(_ONE)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ONE.replace('(', '(?:').replace('(?:?:', '(?:')})*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.,;:!?。，،]")


@dataclass
class Settings:
    """share: of the heaviest path's weight that another content path needs, and of its ratio that a plain box outside the content's
    common ancestor needs (half of it within). links: share of link text from which a path in a list is a menu. prior: what a mark of furniture
    multiplies a weight by, and an article or main element divides it by. rival: of the heaviest marked element's weight that another needs to stay."""

    share: float = 0.3
    links: float = 0.6
    smooth: float = 0.5
    prior: float = 0.25
    rival: float = 0.5


@dataclass(slots=True)
class Element:
    """Numbers of its parent, its path, the innermost article or main element and the list or box that hold it; mark: 1 of furniture, 2 of a HARD kind."""

    tag: str
    parent: int = 0
    path: int = 0
    main: int = 0
    group: int = 0
    title: bool = False
    mark: int = 0


@dataclass(slots=True)
class Node:
    at: int
    path: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    marks: int = 0


def _marked(tag: str, attrs: str, main: bool) -> int:
    if tag in HARD:
        return 2
    if tag in FURNITURE:
        return 1
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    soft, names = 0, MARKS - TOPICS if main and tag in PROSE else MARKS
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style":
            if re.search(r"display\s*:\s*none", value):
                return 2
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _NAMES.findall(token)]
                if any(w in names for w in words) and all(w in names or w in BESIDE for w in words):
                    soft = 1
    return soft


def blocks(html: str) -> tuple[list[Node], list[Element]]:
    """Text nodes, one a block, in page order, and the elements, parents first; number 0 is the page.

    Unclosed elements end with their parent, the head where something else begins, end tags without a start are skipped, a paragraph ends where a block begins.
    No step looks through the open elements one by one, so the time is linear whatever is left open.
    """
    stack: list[tuple[str, int]] = []  # tag, number
    places: dict[str, list[int]] = {}  # of each open tag, where on the stack
    walls: list[int] = []  # where open blocks are
    tree = [Element("")]
    paths: dict[tuple[int, str], int] = {}
    out: list[Node] = []
    node, at, size = None, 0, len(html)
    low = None
    anchors = places.setdefault("a", [])

    def last(tags) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=-1)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in BLOCK:
                walls.pop()

    def put(raw: str) -> None:
        nonlocal node
        if node is None:
            if not raw.strip():
                return
            if stack and stack[-1][0] == "head":
                pop_to(len(stack) - 1)
            e = stack[-1][1] if stack else 0
            node = Node(e, tree[e].path)
            out.append(node)
        node.parts.append(raw)
        if anchors:
            node.linked += len(raw)

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                node = None
            here = last((tag,))
            if here >= 0 and (tag in BLOCK or not walls or here > walls[-1]):
                pop_to(here)
            continue
        if tag in RAW:
            low = html.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            if len(low) != size:  # lower-casing changed lengths
                e = re.compile(f"</{tag}", re.I).search(html, at)
                end = e.start() if e else -1
            at = size if end < 0 else end
            continue
        if tag == "br":
            if node is not None:
                node.parts.append(" ")
            continue
        if stack and stack[-1][0] == "head" and tag not in VOID:
            pop_to(len(stack) - 1)
        if tag in BLOCK:
            node = None
            if (here := last(("p",))) > last(HOLDS):
                pop_to(here)
            if tag in IMPLIED:
                stop = last(STOPS[tag].split())
                closed = [places[t][i] for t in IMPLIED[tag].split() if t in places and (i := bisect_right(places[t], stop)) < len(places[t])]
                if closed:
                    pop_to(min(closed))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        up = stack[-1][1] if stack else 0
        of, e = tree[up], len(tree)
        mark = _marked(tag, m[3], bool(of.main)) or int(tag == "header" and not of.main)
        tree.append(Element(tag, up, paths.setdefault((of.path, tag), len(paths) + 1), e if tag in ("article", "main") else of.main, e if tag in GROUPS else of.group, tag in TITLES or of.title and tag not in BLOCK, mark))
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            walls.append(len(stack))
        stack.append((tag, e))
    return out, tree


@dataclass
class Ratios:
    """Of each path the fused ratio as it is and smoothed; of each node whether it is of a menu."""

    raw: dict[int, float]
    fused: dict[int, float]
    menus: list[bool]


def fuse(chars: float, marks: float, nodes: float) -> float:
    return (chars / nodes * (marks + 1) / nodes) ** 0.5


def ratios(nodes: list[Node], tree: list[Element], s: Settings) -> Ratios:
    paths: dict[int, list[int]] = {}
    groups: dict[int, list[int]] = {}
    for n in nodes:
        size = len(n.text)
        for p in (paths.setdefault(n.path, [0, 0, 0, 0]), groups.setdefault(tree[n.at].group, [0, 0, 0, 0])):
            p[0] += size
            p[1] += n.marks
            p[2] += 1
            p[3] += min(n.linked, size)
    both = [(p[0] / p[2], (p[1] + 1) / p[2]) for p in paths.values()]
    fused = {}
    for i, path in enumerate(paths):
        near = [both[j] for j in (i - 1, i + 1) if 0 <= j < len(both)]
        t, q = both[i]
        if near:
            t = (1 - s.smooth) * t + s.smooth * max(t, sum(x for x, _ in near) / len(near))
            q = (1 - s.smooth) * q + s.smooth * max(q, sum(x for _, x in near) / len(near))
        fused[path] = (t * q) ** 0.5
    linked = [{k for k, p in sums.items() if p[3] > s.links * p[0]} for sums in (paths, groups)]
    linked[1] -= {k for k, p in groups.items() if tree[k].tag == "table" and p[3] < p[0]}  # a table with other text is no menu
    menus = [n.linked > s.links * len(n.text) and n.path in linked[0] and tree[n.at].group in linked[1] for n in nodes]
    for i in range(len(nodes) - 2, -1, -1):  # a linked title of what follows is not of a menu
        if menus[i] and tree[nodes[i].at].title and not menus[i + 1]:
            menus[i] = False
    return Ratios({k: fuse(*p[:3]) for k, p in paths.items()}, fused, menus)


def weigh(nodes: list[Node], tree: list[Element], r: Ratios, s: Settings) -> list[float]:
    return [0.0 if menu else r.fused[n.path] * len(n.text) / (s.prior if tree[n.at].main else 1) for n, menu in zip(nodes, r.menus)]


def unmarked(nodes: list[Node], tree: list[Element], s: Settings) -> list[Node]:
    """The nodes without those of page furniture. A marked element is furniture unless its weight, times s.prior, is over that of all unmarked text."""
    near = [0] * len(tree)  # the innermost marked element
    for e in range(1, len(tree)):
        near[e] = e if tree[e].mark else near[tree[e].parent]
    if not any(near[n.at] for n in nodes):
        return nodes
    clean, own, inner = 0.0, {}, {}
    for n, x in zip(nodes, weigh(nodes, tree, ratios(nodes, tree, s), s)):
        m = near[n.at]
        if not m:
            clean += x
        own[m] = own.get(m, 0) + x
        if tree[n.at].main > m:
            inner[m] = inner.get(m, 0) + x
    own.pop(0, 0)
    marked = [e for e in range(len(tree)) if tree[e].mark]
    free = {0}
    for m in reversed(marked):  # inner ones first
        support = (inner if tree[m].mark == 2 else own).get(m, 0)
        if support and s.prior * support > clean and support >= s.rival * max(own.values()):
            free.add(m)
            up = near[tree[m].parent]
            if up:
                own[up] = own.get(up, 0) + own[m]
                inner[up] = inner.get(up, 0) + inner.get(m, 0)
    for m in marked:
        if near[tree[m].parent] not in free:
            free.discard(m)
    return [n for n in nodes if near[n.at] in free]


def beside(nodes: list[Node], tree: list[Element], r: Ratios, seeds: list[Node], best: float, s: Settings) -> set[int]:
    """Elements that are outermost plain boxes without content paths and of poor ratio, with all that they hold."""
    count = [0] * len(tree)
    for n in seeds:
        count[n.at] += 1
    for e in range(len(tree) - 1, 0, -1):
        count[tree[e].parent] += count[e]
    common = max(e for e, c in enumerate(count) if c == len(seeds))
    while common and tree[common].tag not in WHOLE:
        common = tree[common].parent
    side, formed, outside = [0] * len(tree), [False] * len(tree), [True] * len(tree)
    outside[0] = common != 0
    for e in range(1, len(tree)):
        up = tree[e].parent
        outside[e] = outside[up] and e != common if count[e] else outside[up]
        if not count[e]:
            side[e] = side[up] or (e if tree[e].tag in SIDE else 0)
            formed[e] = formed[up] or tree[e].tag in FORMED
    sums: dict[int, list] = {}
    for n, menu in zip(nodes, r.menus):
        if side[n.at] and not menu:
            p = sums.setdefault(side[n.at], [0, 0, 0, False])
            p[0] += len(n.text)
            p[1] += n.marks
            p[2] += 1
            p[3] |= formed[n.at]
    poor = {e for e, p in sums.items() if not p[3] and fuse(*p[:3]) < best * s.share / (1 if outside[e] else 2)}
    return {e for e in range(len(tree)) if side[e] in poor}


def extract(html: str, s: Settings = Settings()) -> str:
    """The page's main text: blocks joined by two newlines, white space in a block as one space; empty if there is none."""
    nodes, tree = blocks(html)
    for n in nodes:
        n.text = " ".join(unescape("".join(n.parts)).split())
        n.marks = len(_SENTENCE.findall(n.text))
    nodes = unmarked([n for n in nodes if n.text], tree, s)
    r = ratios(nodes, tree, s)
    w = weigh(nodes, tree, r, s)
    if not any(w):
        return ""
    total: dict[int, float] = {}
    for n, x in zip(nodes, w):
        total[n.path] = total.get(n.path, 0) + x
    top = max(total, key=total.__getitem__)
    seeds = [n for n, x in zip(nodes, w) if x and total[n.path] >= s.share * total[top]]
    gone = beside(nodes, tree, r, seeds, r.raw[top], s)
    main = all(tree[n.at].main for n in seeds)
    return "\n\n".join(n.text for n, menu in zip(nodes, r.menus) if not menu and n.at not in gone and (tree[n.at].main or not main))


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each input row, without a shuffle.

    Null or empty html, and a page without main text, give an empty text. Identifiers and urls pass through, nulls
    and repeats included. A page is parsed whole whatever its length; an empty table gives an empty result.
    """

    def rows(batches):
        for b in batches:
            got = [extract(h) for h in b[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    return picked.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
