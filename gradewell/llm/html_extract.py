"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is read into blocks: runs of text between block-level tags, with their
place in the tree. A hand-weighted classifier looks at each block (semantic
ancestors, names of classes and ids, share of link text, length, sentence marks)
and its log-odds become the capacities to the two terminals: what is lost if
the block is cut off from "content" or from "boilerplate". Neighbours in page
order and siblings below one parent are joined by smoothness edges, stronger the
closer they stand in the tree; a block with clear evidence against it (its place, a name, a list of links)
is joined to its like only, so an advert between two paragraphs takes nothing from them and
they are joined across it. The minimum cut (shortest augmenting paths, found from one source
at a time; a region that reaches no sink any more is settled) is the labelling that loses least.

The weights and word lists are fixed values of this operator, not learned.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by a line feed. Scripts, styles, templates, comments, the
head, menus of choice and what only stands in for a player or drawing hold no text; formulas and what
stands in noscript or object do. Tags left open are closed by what cannot stand inside them
(a block tag closes an open paragraph or heading; an end tag closes down to its match; stray end
tags are ignored).

Nulls and ties: a null or empty page has the empty text. Pages are independent
of each other, so repeated pages give the same text. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
#: Their content is raw text up to the end tag and no text of the page.
RAW = frozenset("script style textarea title".split())
#: Their content is no text of the page if their end tag is there; left open they hide nothing.
HIDDEN = frozenset("template svg select iframe canvas audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the next block tag when left open.
OPEN_ENDED = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())
#: Log-odds of content for a block below such a tag.
TAG_ODDS = {"article": 2.5, "main": 2.0, "nav": -8.0, "footer": -8.0, "header": -5.0, "aside": -8.0, "form": -8.0,
            "button": -8.0, "menu": -8.0, "dialog": -6.0, "fieldset": -6.0, "label": -3.0,
            "noscript": -3.0, "object": -3.0}
#: A block below one of these is content whatever stands around it.
TEXT_TAGS = frozenset(("article", "main"))
#: Tags that may stand around a whole page as well as around a part of it.
WRAPPERS = frozenset(("form", "fieldset", "noscript", "object"))
FALLBACKS = frozenset(("noscript", "object"))
#: With one of these a name tells how the page is, not what the block is ("no-sidebar", "comments-open", "ad-free").
STATES = frozenset("no not non has have with without free less open closed on off enabled disabled hide hidden".split())
#: Log-odds for words in the class, id or role of a block's ancestors.
NAME_ODDS = {w: -7.0 for w in """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments
cookie cookies consent contentinfo copyright disclaimer footer menu nav navbar navigation newsletter notice notices pagination pager
popup promo promotion related reply replies respond share sharing sidebar social sponsor sponsored subscribe
toolbar widget complementary alert modal overlay discussion feedback masthead search login signup""".split()} | {
    w: 2.0 for w in "article body content entry main post story text".split()}
SMOOTH = 1.2
AGAINST = -4.0          # log-odds of clear evidence against a block
#: In running text a block may be one link; elsewhere such blocks are lists of links.
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 dd figcaption".split())


class Block:
    __slots__ = ("text", "link", "path", "marks", "odds", "head", "top", "prose")

    def __init__(self, text: str, link: int, path: tuple, marks: list, head: bool, top: bool, prose: bool = False):
        self.text, self.link, self.path, self.marks, self.head, self.top = text, link, path, marks, head, top
        self.prose = prose
        self.odds = 0.0


class Mark:
    """What an element says of the blocks below it: log-odds, and those that
    stay if it turns out to stand around the whole page."""
    __slots__ = ("odds", "around", "text")

    def __init__(self, tag: str, attributes: str, in_text: bool):
        own = 0.0 if tag == "header" and in_text else TAG_ODDS.get(tag, 0.0)    # an article's own head
        good = bad = 0.0
        for value in _ATTR.findall(attributes) if tag not in ("html", "body") else ():
            for name in value.strip("\"'").lower().split():
                words = _NAME.findall(name)
                state = len(words) > 1 and not STATES.isdisjoint(words)
                for w in words:
                    o = NAME_ODDS.get(w, 0.0)
                    good = max(good, o)
                    if not state:
                        bad = min(bad, o)
        self.odds = min(own, bad) or max(own, good)
        self.around = max(own, good) if own >= 0 or tag in WRAPPERS else own
        self.text = tag in TEXT_TAGS and self.odds > 0


def _verdict(marks: list[Mark], around=frozenset()) -> float:
    """The nearest element that speaks against a block decides, unless an
    article stands nearer; else the one that speaks most for it."""
    best = 0.0
    for m in reversed(marks):
        o = m.around if m in around else m.odds
        if o < 0:
            return o
        best = max(best, o)
        if m.text:
            break
    return best


def _weigh(blocks: list[Block]) -> None:
    """Log-odds of all blocks from their ancestors. One that holds most of the
    page's text, while no article, content or title stands outside it, stands
    around the page: its names say nothing against a block."""
    held: dict[Mark, int] = {}
    sure: dict[Mark, int] = {}
    total = anchors = 0
    for b in blocks:
        b.odds = _verdict(b.marks)
        total += len(b.text)
    for b in blocks:
        anchor = b.odds > 0 or (b.top and b.odds == 0)
        anchors += anchor
        for m in b.marks:
            if m.around != m.odds:
                held[m] = held.get(m, 0) + len(b.text)
                sure[m] = sure.get(m, 0) + anchor
    around = {m for m, n in held.items() if 2 * n > total and sure[m] == anchors}
    if around:
        for b in blocks:
            b.odds = _verdict(b.marks, around)


def _hidden(page: str) -> dict[int, int]:
    """Where the hidden elements that are closed end, by where their start tags do."""
    ends, opened, at = {}, {}, 0
    for m in _TAG.finditer(page):
        if m.start() < at or m.group(2) is None:
            continue
        at, name = m.end(), m.group(2).lower()
        if name in RAW and not m.group(1):
            at = _raw_end(page, name, m)
        elif name in HIDDEN:
            if m.group(1):
                if opened.get(name):
                    ends[opened[name].pop()] = m.end()
            elif not m.group(3).endswith("/"):
                opened.setdefault(name, []).append(m.end())
    return ends


def _raw_end(page: str, name: str, m: re.Match) -> int:
    if m.group(3).endswith("/"):
        return m.end()
    end = re.compile(rf"</{name}\s*>", re.I).search(page, m.end())
    return end.end() if end else len(page)


def parse(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, Mark]] = []         # tag, number of the element, what it says
    hidden = None
    fallback, inside = None, 0                      # the last of FALLBACKS with text, characters in such since the last block
    buf: list[str] = []
    link = serial = 0

    def flush():
        nonlocal link, inside
        if buf:
            text = _SPACE.sub(" ", _html.unescape("".join(buf))).strip()
            if text:
                tags = [t for t, _, _ in stack]
                marks = [m for _, _, m in stack if m.odds or m.around]
                if 2 * inside > len(text) and fallback not in marks:
                    marks.append(fallback)           # an inline element that is closed by now
                out.append(Block(text, min(link, len(text)), tuple(n for _, n, _ in stack), marks,
                                 any(t[0] == "h" and t[1:].isdigit() for t in tags), "h1" in tags,
                                 next((t for t in reversed(tags) if t in BLOCKS), "") in PROSE))
            buf.clear()
        link = inside = 0

    at, in_head, links, seen = 0, False, 0, False
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if not in_head and m.start() > at:
            piece = page[at:m.start()]
            buf.append(piece)
            if links:
                link += len(piece)
            if seen:
                open_one = next((m for t, _, m in reversed(stack) if t in FALLBACKS), None)
                if open_one:
                    fallback, inside = open_one, inside + len(piece)
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name, closing = name.lower(), bool(m.group(1))
        if name == "head":
            in_head = not closing
            continue
        if name == "body" or (in_head and name in BLOCKS and not closing):
            in_head = False
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if any(t == name for t, _, _ in stack):
                if name in BLOCKS:
                    flush()
                while stack.pop()[0] != name:
                    pass
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            at = _raw_end(page, name, m)
            buf.append(" ")
            continue
        if name in HIDDEN:
            if hidden is None:
                hidden = _hidden(page)
            at = hidden.get(at, at)
            buf.append(" ")
            continue
        if name in BLOCKS:
            flush()
            links = 0
            while stack and (stack[-1][0] in OPEN_ENDED or stack[-1][0] not in BLOCKS and
                             any(t in OPEN_ENDED for t, _, _ in stack)):
                stack.pop()                          # an open paragraph ends, with the inline tags open in it
            if name in ("li", "td", "th", "tr", "option"):
                while stack and stack[-1][0] not in BLOCKS:
                    stack.pop()
                if stack and stack[-1][0] == name:
                    stack.pop()
        elif name in ("br", "img", "input"):
            buf.append(" ")
        if name == "a":
            links += 1
        seen = seen or name in FALLBACKS
        if name not in VOID and not m.group(3).endswith("/"):
            serial += 1
            stack.append((name, serial, Mark(name, m.group(3), name == "header" and any(t in TEXT_TAGS for t, _, _ in stack))))
    if at < len(page) and not in_head:
        buf.append(page[at:])
    flush()
    _weigh(out)
    return out


def _links(b: Block) -> float:
    """Log-odds of a block's share of link text."""
    share = b.link / len(b.text)
    return -(1.0 if b.prose else 6.0) * share * share


def log_odds(b: Block) -> float:
    """Log-odds that a block is content."""
    words = b.text.count(" ") + 1
    ends = b.text[-1] in ".!?…\"”»:;)" or b.head
    form = min(3.5, 1.6 * math.log((words + 1) / 6) * (1.0 if words > 5 else 0.4)) + (0.8 if ends else -0.4)
    if b.prose:
        form = max(form, -0.3)                       # a paragraph may be short
    return b.odds + form + _links(b) + (0.8 if b.head else 0.0)


def _near(a: tuple, b: tuple) -> float:
    """Closeness of two places in the tree: 1 for siblings, less the more steps apart."""
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return 1.0 / max(1.0, (len(a) + len(b)) / 2 - k)


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: node i pays max(gain, 0) if false, max(-gain, 0)
    if true, and an edge pays its weight if its ends differ. Of several such
    labellings, the one with the fewest true nodes."""
    graph: list[dict[int, float]] = [{} for _ in gain]
    for i, j, w in edges:
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    sink = [max(-g, 0.0) for g in gain]
    label = [False] * len(gain)
    for i, g in enumerate(gain):
        left = g
        while left > 1e-9 and not label[i]:
            back, queue, end = {i: i}, [i], None
            for u in queue:
                if sink[u] > 1e-9:
                    end = u
                    break
                for v, c in graph[u].items():
                    if c > 1e-9 and v not in back and not label[v]:
                        back[v] = u
                        queue.append(v)
            if end is None:                          # nothing here reaches a sink, now or later
                for u in queue:
                    label[u] = True
                break
            room, v = min(left, sink[end]), end
            while v != i:
                room = min(room, graph[back[v]][v])
                v = back[v]
            v = end
            while v != i:
                u = back[v]
                graph[u][v] -= room
                graph[v][u] = graph[v].get(u, 0.0) + room
                v = u
            left -= room
            sink[end] -= room
    return label


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and to the sibling before, among blocks with clear evidence
    against them and among the others."""
    against = [b.odds <= AGAINST or _links(b) <= AGAINST for b in blocks]
    edges = [(i, i + 1, SMOOTH * _near(blocks[i].path, blocks[i + 1].path))
             for i in range(len(blocks) - 1) if against[i] == against[i + 1]]
    last: dict[tuple, int] = {}
    for i, b in enumerate(blocks):                   # the sibling before, where it is not the neighbour already
        parent = b.path[:-1], against[i]
        j = last.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, SMOOTH / 2))
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    blocks = parse(page or "")
    keep = minimum_cut([log_odds(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    def run(batches):
        for t in batches:
            yield pa.RecordBatch.from_arrays(
                [t.column("page_id"), t.column("url"),
                 pa.array([main_text(h) for h in t.column("html").to_pylist()], pa.string())],
                names=["page_id", "url", "text"])
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string")
