"""HTML extraction by wrapper induction: same-host pages are aligned by simple tree matching."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import guarded, materialise, small_batches
from quillon.llm.urls import url_host

#: Pages of one host that one task reads; a larger host is spread over such groups, which share a template and its verdict.
GROUP_PAGES = 64
#: Largest table kept to read a matching back; longer lists are halved by Hirschberg's method, with the same matching size.
TABLE_CELLS = 1_000_000
#: Sizes of shape pairs kept between pages; they are only remembered, so forgetting them changes nothing.
KEPT_SIZES = 1_000_000
#: Shapes that an aligner, and hosts that a task, keeps between pages, on the same terms.
KEPT_SHAPES, KEPT_DESKS = 50_000, 256
#: In an alignment a matched node outweighs any number of equal texts, which decide between matchings of one size.
NODE_WEIGHT = 1 << 24
#: Distinct pages that template text needs at least, and words it needs inside article or main, where labels recur by chance.
LEAST_PAGES, LEAST_WORDS = 3, 3

# Element names of the HTML standard, and words that sites give to parts that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre".split())
#: Elements that a thread or a list of links repeats; what makes a header that of an article or section, not of the page.
RECORDS = frozenset("article dd div dl li section tr".split())
SECTIONS = frozenset("article main section".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
HOLDERS = BLOCK - frozenset("p h1 h2 h3 li td".split())
NOT_TEXT = frozenset("""head script style noscript template nav footer aside form button input select option textarea iframe
object embed svg canvas audio video dialog menu title xmp noembed noframes""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
         "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo
promotion cookie cookies consent gdpr notice notices alert sidebar sidebars widget widgets menu menus nav navbar navigation
breadcrumb breadcrumbs toolbar footer comment comments commentlist disqus respond reply replies discussion share sharing social
related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager masthead topbar skip""".split())
#: Of these words the ones that say by themselves what an element is: it goes with all its prose.
FIRM_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies
consent gdpr sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond
newsletter subscribe subscription signup pagination pager masthead""".split())
#: Words beside a firm one by which a wrapper says what it holds or leaves out; words after `related` that make it a list of links.
WRAPPER_WORDS = frozenset("has have with without no not hide show is on off open".split())
LINKED_WORDS = frozenset("articles content items links list news posts reading stories topics".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: A group's pages in an order that no shuffle changes: of copies the first is heard.
ORDER = [("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")]
READING_ORDER = [("page_id", "ascending"), ("url", "ascending"), ("whole", "ascending")]
READ = pa.schema([("aligned", pa.bool_()), ("met", pa.list_(pa.int32())), ("whole", pa.int64()),
                  ("lines", pa.list_(pa.struct([("text", pa.string()), ("digest", pa.int64()), ("near", pa.int32()), ("flow", pa.int64()),
                                                ("size", pa.int32()), ("words", pa.int32()), ("own", pa.bool_())])))])
READ_SQL = """aligned boolean, met array<int>, whole bigint,
lines array<struct<text: string, digest: bigint, near: int, flow: bigint, size: int, words: int, own: boolean>>"""
FOUND = pa.schema([("host", pa.string()), ("node", pa.int32()), ("slot", pa.int64()), ("flow", pa.int64()), ("words", pa.int32()), ("weight", pa.int64())])
FOUND_SQL = "host string, node int, slot bigint, flow bigint, words int, weight bigint"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "aside", "soft", "firm", "children", "shape", "text")

    def __init__(self, tag: str, aside: bool = False, soft: bool = False, firm: bool = False):
        self.tag, self.aside, self.soft, self.firm, self.children, self.shape, self.text = tag, aside, soft, firm, [], -1, ""

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _aside(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether the element's name, role or hiding say that it is no part of an article; whether class or id do; and whether firmly."""
    if tag in NOT_TEXT:
        return True, False, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False, False
    soft = firm = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ASIDE_ROLES):
            return True, False, False
        if name in ("class", "id") and not ASIDE_WORDS.isdisjoint(PARTS.findall(value)):
            soft = True
            firm |= tag not in HEADINGS and (name == "class" or tag not in PROSE) and any(_is_firm(PARTS.findall(x)) for x in value.split())
    return False, soft, firm


def _is_firm(parts: list[str]) -> bool:
    """Whether one class or id, as its words, names an aside beyond doubt: `post-comments` does, `with-sidebar` and `related-work` do not."""
    if not WRAPPER_WORDS.isdisjoint(parts):
        return False
    links = parts[:1] in (["related"], ["recommended"]) and (len(parts) == 1 or parts[1] in LINKED_WORDS)
    return links or not FIRM_WORDS.isdisjoint(parts)


def _records(node: Node) -> bool:
    """Whether an element is nothing but a heading and asides, or a list of items alike: two or more of one name that is no prose."""
    inner = [c for c in node.elements() if c.tag not in HEADINGS and not c.aside]
    alone = not inner and any(c.aside for c in node.elements())
    if len(inner) == 1 and inner[0].tag in ("ul", "ol", "div", "section"):
        inner = [c for c in inner[0].elements() if not c.aside]
    loose = any(isinstance(c, str) and c.strip() for c in node.children)
    return not loose and (alone or len(inner) > 1 and len({c.tag for c in inner}) == 1 and inner[0].tag in RECORDS)


def _settle(root: Node) -> None:
    """Which named elements are asides.

    A firm name is one, with all its prose, unless it holds the article, the main part or a first heading. A name
    that articles use too is one if it holds no heading or prose block, or only records alike, as a thread does.
    """
    todo: list[tuple[Node, bool]] = [(root, False)]
    prose: set[int] = set()
    holds: set[int] = set()
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(c, False) for c in node.elements()]
        elif not node.aside:
            inner = [c for c in node.elements() if not c.aside]
            if node.tag in ("article", "main", "h1") or any(id(c) in holds for c in inner):
                holds.add(id(node))
            if node.firm and id(node) not in holds:
                node.aside = True
            elif node.tag in PROSE or any(id(c) in prose for c in inner):
                if node.soft and node.tag not in PROSE and id(node) not in holds and _records(node):
                    node.aside = True
                else:
                    prose.add(id(node))
            else:
                node.aside = node.soft


def parse(html: str) -> Node:
    """The tree of a page. Bad markup never fails: stray end tags are skipped, open elements end with their parents."""
    root = Node("html")
    stack, at, end = [root], 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(4) == "" and m.end() == end:
            break  # the page ends inside a tag
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "td", "th", "table") and tag not in BLOCK:
                    break  # an inline end tag does not close what stands around it
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            _close(stack, {"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "main", "aside", "table", "button"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], SCOPE[tag])
        node = Node(tag, *_aside(tag, m.group(3)))
        node.aside |= tag == "header" and SECTIONS.isdisjoint(x.tag for x in stack)
        stack[-1].children.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.children.append(html[at:close.start() if close else end])
            at = close.end() if close else end
            continue
        stack.append(node)
    _settle(root)
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    """End the innermost open element of tags, unless an element of scope stands between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, without asides; white space is one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list[tuple[Node | str | None, bool]] = [(node, True)]
    while todo:  # no recursion: trees can be deep
        x, first = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.aside and not first:
            continue
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((None, False))
            todo += [(c, False) for c in reversed(x.children)]
    flush()
    return out


class Aligner:
    """Simple tree matching: the largest ordered matching of two trees' equal-named nodes, top down.

    A subtree's shape (its names and nesting) is numbered, and the matching's size is kept for
    each pair of shapes, so repeated paragraphs cost one look-up. Of matchings of one size that
    with most equal texts among the siblings is read back. Nothing recurses, so depth is no limit.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.of: list[tuple[str, tuple[int, ...]]] = []
        self.nodes: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        todo = [(root, False)]
        while todo:
            node, done = todo.pop()
            inner = node.elements()
            if not done:
                todo.append((node, True))
                todo += [(c, False) for c in inner]
                continue
            node.text = _flow(node)
            key = (f"{node.tag}{'-' if node.aside else ''}", tuple(c.shape for c in inner))
            node.shape = self.shapes.setdefault(key, len(self.of))
            if node.shape == len(self.of):
                self.of.append(key)
                self.nodes.append(1 + sum(self.nodes[c] for c in key[1]))

    def size(self, a: int, b: int) -> int:
        """Matched nodes of two shapes; 0 if their names differ."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is None:
                xs, ys = _middle(self.of[x][1], self.of[y][1])
                open_ = [(c, d) for c in set(xs) for d in set(ys) if self._known(c, d) is None]
                if open_:
                    todo += open_
                    continue
                same = sum(self.nodes[c] for c in self.of[x][1]) - sum(self.nodes[c] for c in xs)
                self.sizes[x, y] = 1 + same + int(_last_row(self._weights(xs, ys), len(ys))[-1])
            todo.pop()
        return self._known(a, b)

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.nodes[a]
        return 0 if self.of[a][0] != self.of[b][0] else self.sizes.get((a, b))

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]):
        """Rows of sizes of each of xs with all of ys; equal shapes share a row."""
        shapes = sorted(set(ys))
        place = np.searchsorted(shapes, ys) if ys else np.zeros(0, int)
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in rows:
                rows[x] = np.array([self._known(x, y) for y in shapes], np.int64)
            yield rows[x][place] if ys else place

    def _match(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """The largest ordered matching of two lists of siblings, in memory of TABLE_CELLS and the lists' own length."""
        out: list[tuple[Node, Node]] = []
        codes: dict[str, int] = {}
        todo = [(xs, ys)]
        while todo:
            xs, ys = todo.pop()
            same = lambda c, d: c.shape == d.shape and c.text == d.text
            while xs and ys and same(xs[0], ys[0]):
                out.append((xs[0], ys[0]))
                xs, ys = xs[1:], ys[1:]
                k = next((i for i, (c, d) in enumerate(zip(xs, ys)) if not same(c, d)), min(len(xs), len(ys)))
                out += zip(xs[:k], ys[:k])
                xs, ys = xs[k:], ys[k:]
            k = next((i for i, (c, d) in enumerate(zip(reversed(xs), reversed(ys))) if not same(c, d)), min(len(xs), len(ys)))
            if k:
                out += zip(xs[-k:], ys[-k:])
                xs, ys = xs[:-k], ys[:-k]
            if not xs or not ys:
                continue
            if len(xs) > 1 and len(xs) * len(ys) > TABLE_CELLS:
                half = len(xs) // 2
                head = _last_row(self._scored(xs[:half], ys, codes), len(ys))
                tail = _last_row(self._scored(xs[:half - 1:-1], ys[::-1], codes), len(ys))
                cut = int(np.argmax(head + tail[::-1]))
                todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
                continue
            table = [np.zeros(len(ys) + 1, np.int64)]
            for w in self._scored(xs, ys, codes):
                table.append(_next_row(table[-1], w))
            i, j = len(xs), len(ys)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((xs[i], ys[j]))
        return out

    def _scored(self, xs: list[Node], ys: list[Node], codes: dict[str, int]):
        """As _weights, with the texts' bonus."""
        texts = np.array([codes.setdefault(y.text, len(codes)) for y in ys])
        for x, w in zip(xs, self._weights(tuple(x.shape for x in xs), tuple(y.shape for y in ys))):
            yield w * NODE_WEIGHT + ((w > 0) & (texts == codes.get(x.text, -1)))

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched nodes of two trees, read back from the tables."""
        self.size(a.shape, b.shape)
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            xs, ys = x.elements(), y.elements()
            for c in {c.shape for c in xs}:
                for d in {d.shape for d in ys}:
                    if self._known(c, d) is None:
                        self.size(c, d)
            todo += self._match(xs, ys)
        if len(self.sizes) > KEPT_SIZES:
            self.sizes.clear()
        return out


def _next_row(last: np.ndarray, w: np.ndarray) -> np.ndarray:
    row = last.copy()
    np.maximum(last[1:], last[:-1] + w, out=row[1:])
    return np.maximum.accumulate(row)


def _last_row(rows, width: int) -> np.ndarray:
    last = np.zeros(width + 1, np.int64)
    for w in rows:
        last = _next_row(last, w)
    return last


def _middle(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Two lists without their equal ends: nothing matches a shape better than itself."""
    most = min(len(xs), len(ys))
    head = next((k for k in range(most) if xs[k] != ys[k]), most)
    tail = next((k for k in range(most - head) if xs[-1 - k] != ys[-1 - k]), most - head)
    return xs[head:len(xs) - tail], ys[head:len(ys) - tail]


def _flow(node: Node) -> str:
    """The text that stands directly in an element: its strings and inline elements, without blocks and asides."""
    out, todo = [], list(reversed(node.children))
    if not any(isinstance(c, str) and c.strip() for c in node.children) and node.tag not in BLOCK:
        return ""
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif not x.aside and x.tag not in BLOCK:
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def _marked(root: Node) -> list[Node]:
    """The page's own outermost article and main elements outside asides, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.aside:
            continue
        if node.tag in ("article", "main"):
            out.append(node)
        else:
            todo += reversed(node.elements())
    return out


def _walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.aside:
            yield node
            todo += node.elements()


def _voices(readings: list[Reading]) -> list[int]:
    """Places of pages that are no copies: of each kept page less than half of the text stands in another kept one."""
    kept: list[tuple[int, Counter, int]] = []
    for k, r in enumerate(readings):
        long = {x.digest: len(x.text) for x in r.lines}
        found = Counter(x.digest for x in r.lines)
        length = sum(long[b] * n for b, n in found.items())
        if all(sum(long[b] * n for b, n in (found & f).items()) * 2 < min(length, m) for _, f, m in kept):
            kept.append((k, found, length))
    return [k for k, _, _ in kept]


def extract_group(htmls: list[str | None]) -> list[str]:
    """Main texts of pages of one host.

    The page of the median size becomes the template; every other page is aligned with it. Of
    each template node it is noted how its text differs over the pages: what most distinct pages
    have alike is template, the rest are slots. Pages count as distinct if they share less than
    half of their text, so copies of an article are never taken for a template. The content root
    is the deepest node that holds most of the slots' text outside asides. If article and main
    elements hold most of it, an aligned page's text is that of all its outermost ones, else of
    its node aligned with the root; either way without asides and without template text. Inside
    article and main template text has at least LEAST_WORDS words or an aside's class or id, as
    labels like Introduction recur in articles too. A page that does not align (less than half of the smaller tree), is
    alone, or stands in a group without enough distinct pages to tell, is read by its own marks.
    """
    trees = [parse(h or "") for h in htmls]
    template = _median(trees)
    desk = Desk(template)
    readings = [desk.read(t) for t in trees]
    found = evidence(readings, bool(_marked(template)))
    whole = sum(e.weight for e in found if e.node < 0)
    verdict = decide(template, {e.node: e.slot for e in found if e.flow is None and e.node >= 0},
                     [(e.node, e.flow, e.words) for e in found if e.flow is not None and 2 * e.weight >= whole])
    return ["\n\n".join(r.compose(verdict)) for r in readings]


class Line(NamedTuple):
    """A block's text and its digest; the template node it stands in or below; whether the page's own marks hold it.

    If its element is matched itself, also the digest, length and words of all text that stands directly there.
    """

    text: str
    digest: int
    near: int
    flow: int | None
    size: int
    words: int
    own: bool


class Evidence(NamedTuple):
    """What a group says of a template node: the length of its varying text, or a text most distinct pages have, by their weight.

    Node -1 carries the weight of the whole group.
    """

    node: int
    slot: int
    flow: int | None
    words: int
    weight: int


class Verdict(NamedTuple):
    """The root's place among the template's nodes (first, past the last), whether marks hold it, and (node, flow) of template text."""

    start: int
    end: int
    own: bool
    drop: frozenset[tuple[int, int]]


class Reading(NamedTuple):
    """A page's lines, whether it aligns, and the template's blocks that it has."""

    lines: list[Line]
    aligned: bool
    met: list[int]

    def compose(self, v: Verdict | None) -> list[str]:
        """The blocks that stay; _spread() states the same as an expression."""
        if v is None or not self.aligned:
            return [x.text for x in self.lines if x.own]
        inside = not v.own and v.start in self.met
        return [x.text for x in self.lines if (v.start <= x.near < v.end if inside else x.own) and (x.near, x.flow) not in v.drop]


def _median(trees: list[Node]) -> Node:
    """The tree with the median number of nodes, the first of equals."""
    sizes = [sum(1 for _ in _all(t)) for t in trees]
    return trees[sorted(range(len(trees)), key=lambda k: (sizes[k], k))[len(trees) // 2]]


def _all(root: Node):
    """All nodes in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.elements())


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _lines(root: Node, place: dict[int, int]) -> list[Line]:
    """The blocks of a page as blocks() gives them, with the template nodes (place, by id) they belong to."""
    out: list[Line] = []
    line: list[str] = []
    marked = {id(n) for n in _marked(root)}
    owners = [(root, place.get(id(root), -1), not marked)]

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            owner, near, own = owners[-1]
            digest, matched = _digest(text), id(owner) in place
            flow = None if not matched else digest if owner.text == text else _digest(owner.text)
            out.append(Line(text, digest, near, flow, len(owner.text) * matched, owner.text.count(" ") + 1, own))

    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
            owners.pop()
        elif isinstance(x, str):
            line.append(x)
        elif x.aside:
            continue
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                owners.append((x, place.get(id(x), owners[-1][1]), owners[-1][2] or id(x) in marked))
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


class Desk:
    """Reads pages against one template. What it remembers between pages changes no reading."""

    def __init__(self, template: Node) -> None:
        self.template = template
        self.aligner = Aligner()
        self.aligner.number(template)
        seen = {id(x) for x in _walk(template)}
        self.number = {id(x): k for k, x in enumerate(_all(template)) if id(x) in seen}

    def read(self, page: Node) -> Reading:
        if len(self.aligner.of) > KEPT_SHAPES:
            self.__init__(self.template)
        a = self.aligner
        a.number(page)
        pairs = a.pairs(self.template, page)
        fits = 2 * len(pairs) >= min(a.nodes[self.template.shape], a.nodes[page.shape])
        place = {id(y): self.number[id(x)] for x, y in pairs if id(x) in self.number} if fits else {}
        return Reading(_lines(page, place), fits, sorted(place[id(y)] for _, y in pairs if id(y) in place and y.tag in BLOCK))


def evidence(readings: list[Reading], marks: bool) -> list[Evidence]:
    """What a group's pages say of their template; marks: it has article or main.

    A group with fewer than LEAST_PAGES distinct pages says nothing, or, without marks, only
    where text varies.
    """
    heard = _voices(readings)
    few = len(heard) < LEAST_PAGES
    if len(readings) < 2 or few and marks:
        return []
    if len(heard) < 2:
        heard = list(range(len(readings)))
    texts: dict[int, Counter] = {}
    aligned = 0
    for r in (readings[k] for k in heard):
        aligned += r.aligned
        said = {x.near: (x.flow, x.size, x.words) for x in r.lines if x.flow is not None}
        for node in r.met:
            texts.setdefault(node, Counter())[said.get(node, (None, 0, 0))] += 1
    found = [Evidence(-1, 0, None, 0, aligned)]
    for node, c in texts.items():
        if len(c) > 1:
            found.append(Evidence(node, sum(size * n for (_, size, _), n in c.items()), None, 0, 0))
        found += [Evidence(node, 0, flow, words, aligned) for (flow, _, words), n in c.items() if flow is not None and not few and n >= max(LEAST_PAGES, aligned / 2)]
    return found


def decide(template: Node, slots: dict[int, int], common: list[tuple[int, int, int]]) -> Verdict | None:
    """The content root and the template text of a host, from the summed evidence of its groups."""
    nodes = list(_all(template))
    number = {id(x): k for k, x in enumerate(nodes)}
    held = _slots(template, {id(nodes[k]): n for k, n in slots.items()})
    root = _content_root(template, held)
    if root is None:
        return None
    marks = _marked(template)
    inside = {id(n) for m in marks for n in _walk(m)}
    below = {id(n) for n in _walk(root)}
    own = id(root) in inside or sum(held.get(id(m), 0) for m in marks) > 0.6 * held[id(root)] and all(id(m) in below for m in marks)
    named = {id(n) for m in _walk(template) if m.soft for n in _walk(m)}
    said = sorted({k for k, _, _ in common} | {k for k, n in slots.items() if n})
    after = dict(zip(said, said[1:]))
    # inside marked articles a heading of the pages' own text is theirs, however many have it
    heads = {k for k in said if nodes[k].tag in HEADINGS and id(nodes[k]) not in named and slots.get(after.get(k, -1))}
    drop = frozenset((k, flow) for k, flow, words in common if id(nodes[k]) not in inside or id(nodes[k]) in named or words >= LEAST_WORDS and k not in heads)
    start = number[id(root)]
    return Verdict(start, start + sum(1 for _ in _all(root)), own, drop)


def _slots(template: Node, own: dict[int, int]) -> dict[int, int]:
    """Of each node outside asides, the length of the text in and below it that varies; own: that in it."""
    held: dict[int, int] = {}
    todo = [(template, False)]
    while todo:
        node, done = todo.pop()
        if node.aside:
            continue
        if not done:
            todo.append((node, True))
            todo += [(c, False) for c in node.elements()]
            continue
        held[id(node)] = own.get(id(node), 0) + sum(held.get(id(x), 0) for x in node.elements())
    return held


def _content_root(template: Node, held: dict[int, int]) -> Node | None:
    """From the top down, as long as one child holds most of the text that varies."""
    node = template
    while held.get(id(node)):
        inner = [(held[id(c)], c) for c in node.elements() if not c.aside and c.tag in HOLDERS]
        best = max(inner, key=lambda x: x[0], default=(0, node))
        if best[0] <= 0.6 * held[id(node)]:
            return node
        node = best[1]
    return None


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, url, text) of every page by its whole html.

    Pages are grouped by host. A host of more than group_pages pages is spread over groups of
    about that many, by a hash, so that one with a third of all pages makes many tasks of bounded
    size; its groups share one template and one verdict, the sum of what all of them found. Null
    html gives an empty text; pages without a host form hosts of their own name. Repeated rows
    give equal texts. Pages of any length are read whole; other columns, whatever their names, are not
    read. Empty tables give empty results.
    """
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    named = pages.select("page_id", "url", "html").withColumn("host", url_host(F.col("url")))
    sizes = materialise(named.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count("*") / group_pages).cast("int").alias("cuts")))
    dealt = named.join(guarded(sizes), named["host"] == F.col("h")).drop("h")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(ORDER)
        return pa.table([t.column("page_id"), t.column("url"), pa.array(extract_group(t.column("html").to_pylist()), pa.string())], names=["page_id", "url", "text"])

    small = dealt.where("cuts = 1").select("host", "page_id", "url", "html").groupBy("host").applyInArrow(run, f"page_id {kind}, url string, text string")
    large = sizes.where("cuts > 1")
    return small if large.isEmpty() else small.unionByName(_spread(dealt.where("cuts > 1"), kind))


def _spread(dealt: DataFrame, kind: str) -> DataFrame:
    """Pages of hosts in several groups: read where they lie, heard in groups, judged by host, composed row by row.

    Whole pages are not shuffled: groups see digests and lengths of a page's blocks.

    The host's template is the page whose html has the median length (by steps of a quarter
    octave, so that the exact median needs a few counts a host), of those the one with the least hash.
    """
    step = F.floor(4 * F.log2(F.coalesce(F.length("html"), F.lit(0)) + 1)).cast("int")
    middle = materialise(dealt.groupBy(F.col("host").alias("mh")).agg(F.floor(F.percentile(step, F.lit(0.5))).alias("middle")))
    near = F.struct(F.abs(step - F.col("middle")), F.xxhash64("html"), "page_id", F.xxhash64("url"))
    templates = materialise(dealt.join(guarded(middle), F.col("host") == F.col("mh")).groupBy("host").agg(F.min_by(F.coalesce("html", F.lit("")), near).alias("template")))
    asked = dealt.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("cuts")).cast("int")).drop("cuts").join(
        guarded(templates.withColumnRenamed("host", "th")), F.col("host") == F.col("th")).select("host", "part", "page_id", "url", "html", "template")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        desks: dict[str, Desk] = {}
        for t in batches:
            if len(desks) > KEPT_DESKS:
                desks.clear()
            out = []
            for row in t.to_pylist():
                if row["host"] not in desks:
                    desks[row["host"]] = Desk(parse(row["template"]))
                r = desks[row["host"]].read(parse(row["html"] or ""))
                out.append({"aligned": r.aligned, "met": r.met, "whole": _digest(row["html"] or ""), "lines": [x._asdict() for x in r.lines]})
            kept = t.select(["host", "part", "page_id", "url"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *pa.RecordBatch.from_pylist(out, schema=READ).columns], names=[*kept.schema.names, *READ.names])

    with small_batches(dealt.sparkSession):
        readings = materialise(asked.mapInArrow(read, f"host string, part int, page_id {kind}, url string, {READ_SQL}"))
    marked = templates.select("host", F.col("template").alias("t"))

    def hear(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = [Reading([Line(" " * x["chars"], x["digest"], x["near"], x["flow"], x["size"], x["words"], False) for x in r["said"]], r["aligned"], r["met"])
                for r in t.sort_by(READING_ORDER).to_pylist()]
        found = [{"host": key[0].as_py(), **e._asdict()} for e in evidence(rows, t.column("marks")[0].as_py())]
        return pa.Table.from_pylist(found, schema=FOUND)

    said = F.transform("lines", lambda x: F.struct(F.length(x["text"]).alias("chars"), *[x[n].alias(n) for n in ("digest", "near", "flow", "size", "words")]))
    voices = readings.join(guarded(materialise(_with_marks(marked))), F.col("host") == F.col("th")).select("host", "part", "page_id", "url", "whole", "aligned", "met", "marks", said.alias("said"))
    found = materialise(voices.groupBy("host", "part").applyInArrow(hear, FOUND_SQL).groupBy("host", "node", "flow").agg(
        F.sum("slot").alias("slot"), F.max("words").alias("words"), F.sum("weight").alias("weight")))
    whole = found.where("node < 0").select(F.col("host").alias("wh"), F.col("weight").alias("whole"))
    strong = found.join(guarded(materialise(whole)), F.col("host") == F.col("wh")).where("node >= 0 and (flow is null or 2 * weight >= whole)").select("host", "node", "flow", "slot", "words")

    def judge(t: pa.Table, shared: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        v = decide(parse(shared.column("template")[0].as_py()), {r["node"]: r["slot"] for r in rows if r["flow"] is None},
                   [(r["node"], r["flow"], r["words"]) for r in rows if r["flow"] is not None]) if rows else None
        told = [] if v is None else [{"vh": shared.column("host")[0].as_py(), "start": v.start, "end": v.end, "marks": v.own, "gone": [{"near": n, "flow": f} for n, f in sorted(v.drop)]}]
        return pa.Table.from_pylist(told, schema=pa.schema([("vh", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("marks", pa.bool_()),
                                                            ("gone", pa.list_(pa.struct([("near", pa.int32()), ("flow", pa.int64())])))]))

    verdicts = materialise(strong.groupBy("host").cogroup(templates.groupBy("host")).applyInArrow(
        judge, "vh string, start int, end int, marks boolean, gone array<struct<near: int, flow: bigint>>"))
    judged = F.col("aligned") & F.col("vh").isNotNull()
    inside = judged & ~F.col("marks") & F.array_contains("met", F.col("start"))
    lines = F.filter("lines", lambda x: F.when(inside, (x["near"] >= F.col("start")) & (x["near"] < F.col("end"))).otherwise(x["own"])
                     & ~F.coalesce(judged & F.exists("gone", lambda g: (g["near"] == x["near"]) & (g["flow"] == x["flow"])), F.lit(False)))
    return (readings.join(guarded(verdicts), F.col("host") == F.col("vh"), "left")
            .select("page_id", "url", F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("text")))


def _with_marks(templates: DataFrame) -> DataFrame:
    """(th, marks): whether a host's template has article or main elements of its own."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column("host"), pa.array([bool(_marked(parse(x))) for x in t.column("t").to_pylist()], pa.bool_())], names=["th", "marks"])

    return templates.mapInArrow(look, "th string, marks boolean")


def op3(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
