"""Main-text extraction by minimum cuts.

A page becomes a row of text blocks.  A classifier gives each block log-odds of being content: a linear discriminant of the
block's shape (length, links, punctuation, tag), trained here on pages whose markup tells content from boilerplate, plus
what the elements around it say (sections, roles, names of classes and ids).  These costs are the terminal capacities;
neighbours in page order and in the DOM are tied by smoothness edges of the same scale, so that blocks whose own shape says
little go with those around them.  The maximum flow of that graph separates content (the source's side) from boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import tune, type_of

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SKIPPED = frozenset("script style noscript template iframe object canvas audio video head title textarea select option datalist button defs symbol clippath mask pattern filter marker lineargradient radialgradient metadata desc annotation annotation-xml".split())
#: Of these the content is not markup either.
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas and drawings: their text is part of the block around them.
INLINE |= frozenset("math semantics mrow mi mo mn ms mtext mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose mmultiscripts mprescripts none mspace svg g path circle rect line polyline polygon ellipse use text tspan textpath image switch stop animate defs symbol clippath mask pattern filter marker lineargradient radialgradient metadata desc annotation annotation-xml".split())
#: Of these, the ones that stand apart from what is before them.
APART = frozenset("text mtr mtd".split())
#: An opening tag of the key ends open elements of the value, within the innermost of STOPS.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol menu dl table article section main aside nav header footer form div body".split())
CLOSED_WITHIN = INLINE | {"p", "li", "dt", "dd"}
ENDS_P = frozenset("p div article section main aside nav header footer form ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote figure hr address fieldset details body".split())
#: Log-odds that sections and roles around a block add.  AROUND: inside an article or main; beside it, on a page that has one.
SECTIONS = dict.fromkeys("nav footer aside form menu dialog".split(), -7.0) | {"fieldset": -2.0, "header": -5.0}
ROLES = dict.fromkeys("navigation contentinfo complementary search dialog alert menu banner".split(), -7.0)
INSIDE, BESIDE = 2.5, -2.5
#: A class or id says what an element is by its last word, or by a first one of BAD_FIRST; one that begins with a word of
#: APART_FROM says what the element has or lacks.
GOOD_WORDS = frozenset("article content post entry story body main text prose".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer header masthead toolbar search comment comments reply replies respond discussion disqus reactions copyright legal disclaimer skip hidden".split()
)
BAD_FIRST = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer menu modal nav navbar navigation newsletter pagination popup promo recommended related replies reply share sharing sidebar sponsored subscribe toolbar".split())
APART_FROM = frozenset("has with no without not is show hide enable disable".split())
GOOD, BAD = 2.5, -7.0
#: Names of content: neither classes nor sections around them say that they are none.
OWN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Ties of neighbouring blocks (by their distance in the DOM), of blocks under one parent, and between nested parents.
NEXT, SIBLING, NESTED = 1.0, 0.5, 0.25
#: Costs are held within this bound, so that no single one outweighs all neighbours.
MOST_ODDS = 8.0
#: Pages that train the classifier, about, and labelled blocks that weigh as much as the weights it starts with.
SAMPLE, PRIOR = 5_000, 2_000.0

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:main|article)\b""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


@dataclass
class Node:
    name: str
    up: "Node | None"
    odds: float
    skipped: bool
    link: bool
    depth: int
    #: Whether the node is in an article or main, and what bad class words of wrappers around none have taken.
    inside: bool = False
    doubt: float = 0.0
    #: The block that holds it, and how many elements of each name are open since the innermost of STOPS.
    holder: "Node | None" = None
    scope: "dict[str, int]" = field(default_factory=dict)


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    in_links: int = 0
    text: str = ""


def _inside(node: Node | None, name: str) -> bool:
    while node is not None and node.name != name:
        node = node.up
    return node is not None


def _named(value: str) -> float:
    """What the names in a class or id say of the element that bears them."""
    good = bad = False
    for name in value.split():
        words = _WORDS.findall(name)
        if words and words[0] not in APART_FROM:
            own_header = words[-1] == "header" and set(words) & GOOD_WORDS  # an article's own header holds its title
            bad |= words[0] in BAD_FIRST or words[-1] in BAD_WORDS and not own_header
            good |= words[-1] in GOOD_WORDS
    return BAD if bad else GOOD if good else 0.0


def _odds(name: str, attributes: str, up: Node) -> tuple[float, bool, float]:
    """What the element adds for the blocks below it, whether it is hidden, and the doubt below it."""
    odds, hidden, doubt = SECTIONS.get(name, 0.0), False, up.doubt
    if name in OWN:  # wrappers of content say nothing of it, nor does a form around the whole page
        odds, doubt = odds - doubt - (SECTIONS["form"] if _inside(up, "form") else 0.0), 0.0
    if name == "header" and up.inside:  # an article's own header holds its title
        odds = 0.0
    if attributes.strip():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), unescape(a or b or c).lower()
            if key in ("class", "id"):
                said = 0.0 if name in OWN or name in HEADINGS or name in ("html", "body") else _named(value)
                odds += said
                doubt += min(0.0, said)
            elif key == "role":
                odds += ROLES.get(value, 0.0)
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return odds, hidden, doubt


def _tags(html: str) -> Iterator[tuple[str, str | None, bool]]:
    """The page's parts in order: (text, None, False), or of a tag what stands behind its name, the name in lower case, and
    whether it closes.  Text between CDATA marks has its references escaped; what RAW elements hold is left out.

    Every character is looked at a bounded number of times: what has been found to have no end is not sought again.  A tag that
    its quotes would keep open to the end of the page ends at the next >, and quotes do not count from there on.
    """
    last, cdata_ends, quoted = html.rfind(">"), True, True
    start = at = 0  # of the text so far, and where to look
    while (lt := html.find("<", at)) >= 0:
        if html.startswith("<!--", lt) or lt < last and html.startswith(("<!", "<?"), lt):
            if start < lt:
                yield html[start:lt], None, False
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else -3
            if end == -3 and cdata_ends and html.startswith("<![CDATA[", lt):
                close = html.find("]]>", lt + 9)
                cdata_ends = close >= 0
                if cdata_ends:
                    yield html[lt + 9 : close].replace("&", "&amp;"), None, False
                    start = at = close + 3
                    continue
            start = at = html.find(">", lt) + 1 if end == -3 else end + 3 if end >= 0 else len(html)
            continue
        m = _NAME.match(html, lt + 1) if lt < last else None
        if m is None or m.end() > last:
            if html.startswith(("<!", "<?"), lt):  # it has no end, so nothing follows it
                break
            at = lt + 1
            continue
        end = _tag_end(html, m.end()) if quoted else html.find(">", m.end())
        if end < 0:
            quoted, end = False, html.find(">", m.end())
        if start < lt:
            yield html[start:lt], None, False
        name = m[2].lower()
        start = at = end + 1
        yield html[m.end() : end], name, m[1] == "/"
        if not m[1] and name in RAW:
            close = _CLOSE[name].search(html, at) if at < last else None
            start = at = close.end() if close else len(html)
    text = html[start:] if lt < 0 else html[start:lt]
    if text:
        yield text, None, False


def _tag_end(html: str, at: int) -> int:
    """Where the > stands that ends a tag, not counting quoted ones; -1 if there is none."""
    while (m := _QUOTE_OR_END.search(html, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = html.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks of a page, in order; references decoded, white space collapsed."""
    top = Node("", None, 0.0, False, False, 0)
    top.holder = top
    here, out, now, names = top, [], Block(top), Counter()

    def close_block():
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        now = Block(here)

    def add(text: str):
        if text and not here.skipped:
            if not now.parts or not "".join(now.parts[-1:]).strip():
                now.node = here.holder
            text = unescape(text)
            now.parts.append(text)
            if here.link:
                now.in_links += len(text)

    def enter(node: Node) -> None:
        nonlocal here
        node.holder = here.holder if node.name in INLINE else node
        node.scope = {} if node.name in STOPS else here.scope
        node.scope[node.name] = node.scope.get(node.name, 0) + 1
        names[node.name] += 1
        here = node

    def up_to(node: Node) -> None:
        """Close all that is open up to the node, and the node."""
        nonlocal here
        while here is not node.up:
            here.scope[here.name] -= 1
            names[here.name] -= 1
            here = here.up

    def leave(some: frozenset | set) -> None:
        """Close the innermost of these within the innermost of STOPS."""
        if any(here.scope.get(n) for n in some):
            node = here
            while node.up is not None and node.name not in STOPS:
                if node.name in some:
                    return up_to(node)
                node = node.up

    for text, name, closing in _tags(html):
        if name is None:
            add(text)
            continue
        attributes = text
        if name not in INLINE:
            close_block()
        elif name in APART:
            add(" ")
        if closing:
            # An end tag without a start tag ends nothing, nor does one of these end what is around a block.
            within = name in CLOSED_WITHIN
            if here.scope.get(name) if within else names[name]:
                node = here
                while node.name != name and not (within and node.name in STOPS):
                    node = node.up
                if node.name == name:
                    up_to(node)
        elif name not in VOID and not (name in INLINE and attributes.rstrip().endswith("/")):
            if name in ENDS_P:
                leave({"p"})
            if name in ENDS:
                leave(ENDS[name])
            odds, hidden, doubt = _odds(name, attributes, here)
            enter(Node(name, here, here.odds + odds, here.skipped or hidden or name in SKIPPED, here.link or name == "a", here.depth + 1, here.inside or name in OWN or _MAIN_ROLE.search(attributes) is not None, doubt))
            if name in RAW:
                up_to(here)
        if name not in INLINE:
            now.node = here.holder
    close_block()
    return out


def shape(block: Block) -> list[float]:
    """What the classifier sees of a block itself: parts of 64, so that sums are exact."""
    words = block.text.count(" ") + 1
    links = min(1.0, block.in_links / max(1, len(block.text)))
    name = block.node.name
    part = lambda x: round(64 * x) / 64
    return [part(min(words, 40) / 40), part(links), float(block.text[-1] in ".!?\"'”»"), float(name in ("p", "pre", "blockquote", "figcaption")), float(name in HEADINGS), float(name in ("li", "td", "th", "dt", "dd"))]


@dataclass(frozen=True)
class Shape:
    """A linear classifier of shapes.  The weights it starts with count as PRIOR labelled blocks."""

    weights: tuple[float, ...] = (2.0, -4.0, 1.0, 1.0, 1.0, 0.0)
    bias: float = -1.5

    def odds(self, block: Block) -> float:
        return self.bias + sum(w * x for w, x in zip(self.weights, shape(block)))


def told(found: list[Block]) -> list[int | None]:
    """What the markup says of the blocks of a page with an article or main: 1 content, 0 boilerplate, else None."""
    if not any(b.node.inside for b in found):
        return [None] * len(found)
    return [(1 if b.node.odds >= 0 else None) if b.node.inside else 0 for b in found]


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Shape:
    """The linear discriminant of two classes, given of each the number, the sum and the sum of outer products of shapes;
    log-odds for equally many of either."""
    start, n = Shape(), counts.sum()
    if counts.min() < 10:
        return start
    means = sums / counts[:, None]
    spread = sum(squares[k] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)) / n
    w = np.linalg.solve(spread + 0.05 * np.eye(len(spread)), means[1] - means[0])
    bias = -float(w @ (means[0] + means[1])) / 2
    scale = min(1.0, 5.0 / float(np.abs(w).max()))  # costs of the scale of the others
    own = n / (n + PRIOR)
    mixed = own * scale * w + (1 - own) * np.array(start.weights)
    return Shape(tuple(np.round(mixed, 4).tolist()), round(float(own * scale * bias + (1 - own) * start.bias), 4))


def train(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE) -> Shape:
    """The classifier of about `sample` pages, chosen by a hash of the id and the html.  Only sums reach the driver."""
    rows = pages.count()
    kept = pages.select(html_col).filter(F.col(html_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col), F.col(html_col)), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / max(1, rows))))
    size = len(Shape().weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 1 + size + size * size))
        for b in batches:
            for html in b.column(0):
                found = blocks(html.as_py())
                for x, y in zip(found, told(found)):
                    if y is not None:
                        v = np.array(shape(x))
                        out[y] += np.concatenate([[1.0], v, np.outer(v, v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["label", "sums"])

    total = np.zeros((2, 1 + size + size * size))
    each = kept.mapInArrow(sums, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    for r in each.collect():  # a fixed number of sums
        total[r.label, r.at] = r.x
    return fit(total[:, 0], total[:, 1 : 1 + size], total[:, 1 + size :].reshape(2, size, size))


def content_odds(block: Block, model: Shape, beside: bool) -> float:
    """Log-odds that a block is content.  beside: whether the page has an article or main that the block is not in."""
    around = INSIDE if block.node.inside else BESIDE if beside else 0.0
    return max(-MOST_ODDS, min(MOST_ODDS, model.odds(block) + block.node.odds + around))


def _common(a: Node, b: Node) -> int:
    """Edges of the DOM path between two nodes."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def min_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side.  A node with odds z is tied to the source by z, or to the sink by -z; ties
    join nodes both ways.  Augmenting paths by breadth, then depth (Dinic)."""
    n = len(odds)
    source, sink = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(forth)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, z in enumerate(odds):
        if z > 0:
            edge(source, i, z, 0.0)
        elif z < 0:
            edge(i, sink, -z, 0.0)
    for a, b, w in ties:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in adj[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[a] < len(adj[a]):
                e = adj[a][place[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(adj[a]):
                path.append(e)
                a = to[e]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1
            else:
                break


def ties_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity)."""
    ties = []
    last: dict[int, int] = {}  # of each parent, its latest block
    for i, b in enumerate(found):
        if i:
            ties.append((i - 1, i, NEXT / max(1, _common(found[i - 1].node, b.node))))
        for node, w in ((b.node.up, SIBLING), (b.node.up.up if b.node.up else None, NESTED)):
            if node is not None and node.up is not None:
                if (j := last.get(id(node))) is not None:
                    ties.append((j, i, w))
                last[id(node)] = i
    return ties


def labelled(html: str, model: Shape = Shape()) -> tuple[list[Block], list[bool], list[bool]]:
    """The blocks of a page, which of them are content, and which the classifier alone would take."""
    found = blocks(html)
    if not found:
        return [], [], []
    has = any(b.node.inside for b in found)
    odds = [content_odds(b, model, has) for b in found]
    return found, min_cut(odds, ties_of(found)), [z > 0 for z in odds]


def extract(html: str | None, model: Shape = Shape()) -> str:
    """The main text of a page: its content blocks, joined by spaces."""
    found, content, _ = labelled(html or "", model)
    return " ".join(b.text for b, c in zip(found, content) if c)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",), sample: int = SAMPLE) -> DataFrame:
    """One row per row of pages: id, the carried columns, text (empty if there is none) and n_chars, its code points.

    Null html counts as empty.  Repeated rows and null ids are kept as they are; pages are independent, so order and ties
    do not matter.  Html of any length is read whole.  The classifier is trained first, on about `sample` of the pages.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    tune(pages.sparkSession)
    model = train(pages, id_col, html_col, sample)
    names = [id_col, *carry]
    schema = ", ".join(f"`{c}` {type_of(pages, c)}" for c in names) + ", text string, n_chars long"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), model) for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, html_col).mapInArrow(make, schema)
