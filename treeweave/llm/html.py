"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks. One logistic classifier reads what a block looks like (length, links, punctuation, element)
and what it stands in (elements, roles, names); its log odds of content against boilerplate are the block's capacity to
source or sink. Blocks that follow each other, the more the closer they are in the tree, and blocks with one parent are
joined by smoothness edges. The minimum cut parts content from boilerplate: it keeps a short line among paragraphs and
drops a talkative one among links, whatever the classifier says of either alone.

The classifier has no labelled pages to learn from. It starts from PRIOR, and on a bounded sample learns by turns with the
cut: the cut labels the blocks, the weights are fitted to the labels, drawn towards PRIOR.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A comment, a tag (quoted attributes may hold ">"), or other markup.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>", re.DOTALL)
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video select datalist head".split())
#: Those of RAW that, unended, run to the end of the page; of the others, unended, what follows is read on.
ENDLESS = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
AROUND = frozenset("nav footer aside menu dialog button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
OUTSIDE = re.compile(
    r"(?:^|[-_])(?:nav|navbar|navigation|menu|menus|topbar|toolbar|breadcrumbs?|pagination|pager|header|masthead|footer|foot|sidebar|side|aside|rail|widgets?|ads?|adverts?|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|teaser|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|searchbox|form|share|sharing|social|related|recommended|recommendations|trending|popular|"
    r"comments?|commentlist|replies|reply|disqus|discussion|responses|skip|copyright|legal|disclaimer)(?:$|[-_])|^(?:comment|advert|sidebar|footer|cookie|navi|related|sponsor)",
    re.IGNORECASE,
)
#: Names of what is never the page's text, however much of it there is.
NEVER = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|"
    r"comments?|commentlist|replies|reply|disqus|discussion|responses|copyright|legal|disclaimer)(?:$|[-_])|^(?:comment|advert|cookie|sponsor)",
    re.IGNORECASE,
)
#: Words that say what something is about as often as what it is: before another thing's name they don't count ("cookie-recipes").
ABOUT = frozenset("legal cookie cookies alert alerts notice notices discussion responses search menu menus form side foot login promotion".split())
#: Words for parts and places, which name no thing.
PLACES = frozenset(
    "left right top bottom primary secondary main global site page inner outer wrap wrapper container box block area section bar list item items row col column content text body holder panel card group zone slot unit region layout link links button buttons info message messages policy".split()
)
INSIDE = re.compile(r"(?:^|[-_])(?:article|articlebody|post|entry|story|content|main|body|text|prose)(?:$|[-_])", re.IGNORECASE)
LAYOUT = re.compile(r"^(?:has|with|no|without|is)[-_]", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Smoothness between neighbours, by their distance in the tree, of which a share holds if one stands in navigation, a form, a
#: comment, an advert or the like and the other doesn't; and between blocks alike in this that have a parent or grandparent in common.
NEIGHBOUR, UNLIKE, SIBLING = 0.8, 0.05, 1.2
#: Pages that the classifier learns from, about (twice as many at most), the blocks that such a page has at most, and the turns.
SAMPLE, MOST_BLOCKS, TURNS = 400, 500, 3
#: How many blocks the prior weighs as much as.
BELIEF = 50.0
#: Costs are multiples of 1 / UNIT and of LARGEST at most, so flows are exact and a step of them isn't too small.
UNIT, LARGEST = 16, 12.0
#: How likely, as log odds, the likeliest block of a page's text is at least.
SOME = 2.0


def thing(name: str) -> str:
    """A class's or id's name without the words that only tell what the thing that it names is about."""
    pieces = [p for p in re.split("[-_]+", name) if p]
    low = [p.lower() for p in pieces]
    if not ABOUT.intersection(low):
        return name
    out, named = [], False
    for p in reversed(low):
        other = p not in PLACES and not p.isdigit() and p not in ABOUT
        if p in ABOUT and named:
            continue
        # only a word that isn't itself one for something beside the text makes the words before it mere topics
        named = named or other and not OUTSIDE.search(p) and not INSIDE.search(p)
        out.append(p)
    return "-".join(reversed(out))


@dataclass
class Element:
    tag: str
    parent: int
    names: list[str]
    role: str
    hidden: bool
    size: int = 0  # characters of text below


@dataclass
class Block:
    element: int  # the nearest block-level element
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements with their parents, and the blocks of text in page order; in time linear in the page."""
    elements = [Element("", -1, [], "", False)]
    blocks: list[Block] = []
    open_: list[int] = [0]
    blocky: list[int] = [0]  # the nearest block-level element of each open one
    tags: Counter[str] = Counter()  # of open elements
    unended: set[str] = set()
    current: Block | None = None
    at = 0

    def add(raw: str) -> None:
        nonlocal current
        text = entities.unescape(raw) if "&" in raw else raw
        if current is None:
            if not text or text.isspace():
                return
            current = Block(blocky[-1])
            blocks.append(current)
        current.parts.append(text)
        if tags["a"]:
            current.linked += len(text.strip())

    def close() -> str:
        blocky.pop()
        tag = elements[open_.pop()].tag
        tags[tag] -= 1
        return tag

    while m := MARKUP.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        named = NAME.match(m[0])
        if not named:
            continue
        tag = named[1].lower()
        if m[0][1] == "/":
            if tag in BLOCKS:
                current = None
            if tags[tag] > 0:
                while close() != tag:
                    pass
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = None if tag in unended else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                if not end:
                    unended.add(tag)
                at = end.end() if end else (len(page) if tag in ENDLESS else at)
            continue
        if tag in BLOCKS:
            current = None
        while len(open_) > 1 and tag in CLOSES.get(elements[open_[-1]].tag, ()):
            close()
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[0])} if " " in m[0] or "\n" in m[0] else {}
        names = [thing(n) for n in f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".split() if not LAYOUT.match(n)]
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
        elements.append(Element(tag, open_[-1], names, found.get("role", "").lower(), hidden))
        open_.append(len(elements) - 1)
        blocky.append(open_[-1] if tag in BLOCKS else blocky[-1])
        tags[tag] += 1
    if at < len(page):
        add(page[at:])
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        elements[b.element].size += len(b.text)
    for e in reversed(elements[1:]):  # children come after parents
        elements[e.parent].size += e.size
    return elements, [b for b in blocks if b.text]


def enclosing(elements: list[Element]) -> list[bool]:
    """Which elements, whatever their names say, are around the page's text and not beside it.

    Those around a main; else those around the largest article (else element by a name of INSIDE), if none stands outside
    of names of OUTSIDE and it is longer than all text that does; on pages with none of these, those around most of the
    text. Nothing by a name of NEVER is looked into, nor lifted but for a main.
    """
    n = len(elements)
    never, beside, main, text = [False] * n, [False] * n, [False] * n, [e.size for e in elements]
    for i, e in enumerate(elements):
        named = e.names if e.tag not in ("html", "body") else []
        never[i] = (e.parent >= 0 and never[e.parent]) or e.hidden or e.tag in AROUND or e.role in ROLES or any(NEVER.search(x) for x in named)
        beside[i] = (e.parent >= 0 and beside[e.parent]) or never[i] or e.tag in ("form", "header") or any(OUTSIDE.search(x) for x in named)
        main[i] = e.tag == "main" or e.role == "main"
        if e.parent >= 0:
            text[e.parent] -= e.size
    free = sum(x for x, b in zip(text, beside, strict=True) if not b)
    around = [x and e.size > 0 for x, e in zip(main, elements, strict=True)]
    found = any(around)
    for tier in () if found else ([e.tag == "article" or e.role == "article" for e in elements], [any(INSIDE.search(x) for x in e.names) for e in elements]):
        some = [i for i in range(1, n) if tier[i] and not never[i] and elements[i].size and elements[i].tag not in ("html", "body")]
        if some:
            largest = max(some, key=lambda i: elements[i].size)
            around[largest] = all(beside[i] for i in some) and elements[largest].size > free
            found = True
            break
    text = [0 if x else k for x, k in zip(never, text, strict=True)]
    for i in reversed(range(1, n)):  # children come after parents
        around[elements[i].parent] |= around[i]
        text[elements[i].parent] += text[i]
    return around if found else [2 * k > text[0] and not x for k, x in zip(text, never, strict=True)]


#: What the classifier reads, and its weights before it has learned anything.
PRIOR_WEIGHTS = {
    "always": -2.05,
    "logarithm of length": 3.0,
    "share of links": -3.0,
    "marks of punctuation": 1.0,
    "paragraph": 0.2,
    "heading": 0.3,
    "item or cell": 0.0,
    "plain container": 0.0,
    "in the article": 0.8,
    "outside of the page's article": -2.0,
    "in something named content": 1.2,
    "in navigation, footer, aside or hidden": -7.0,
    "in a form": -5.0,
    "in a header that isn't the article's": -5.0,
    "in something named as comment, notice or advert": -8.0,
    "in something else named as beside": -6.0,
}
PRIOR = np.array([*PRIOR_WEIGHTS.values()])
#: The features that say that a block stands beside the text.
BESIDE = slice(11, 16)


def surroundings(elements: list[Element]) -> list[tuple[float, ...]]:
    """The last eight of the classifier's features, of text in each element."""
    articles = [e.tag in ("article", "main") or e.role in ("main", "article") for e in elements]
    any_article = any(articles)
    around = enclosing(elements)
    out: list[tuple[float, ...]] = []
    within: list[bool] = []
    for i, e in enumerate(elements):
        inside = e.parent >= 0 and within[e.parent]
        named, away, form, header, never, beside = map(bool, out[e.parent][2:]) if e.parent >= 0 else (False,) * 6
        names = e.names if e.tag not in ("html", "body") and not around[i] else []  # an element around the page's text isn't what its name says
        away |= e.hidden or e.tag in AROUND or e.role in ROLES
        form |= e.tag == "form" and not around[i]
        header |= e.tag == "header" and not inside
        never |= any(NEVER.search(x) for x in names)
        beside |= not never and any(OUTSIDE.search(x) for x in names)
        inside |= articles[i]
        named |= any(INSIDE.search(x) for x in e.names)
        within.append(inside)
        out.append((float(inside), float(any_article and not inside), float(named), float(away), float(form), float(header), float(never), float(beside)))
    return out


def features(block: Block, tag: str, around: tuple[float, ...]) -> tuple[float, ...]:
    """The classifier's features of a block."""
    n = len(block.text)
    return (
        1.0,
        math.log1p(n) / 5,
        min(1.0, block.linked / n),
        min(1.0, sum(map(block.text.count, ".!?;,")) / 10),
        float(tag == "p"),
        float(tag in ("h1", "h2", "h3")),
        float(tag in ("li", "td", "th", "dt", "dd")),
        float(tag in ("div", "section", "body", "")),
        *around,
    )


Edge = tuple[int, int, float]


def graph(page: str) -> tuple[list[str], np.ndarray, list[Edge]]:
    """A page's blocks: their texts, their features, and the smoothness edges between them."""
    elements, blocks = parse(page)
    if len(elements) == 1:  # text without markup is all there is
        around: list[tuple[float, ...]] = [(1.0, 0.0, 1.0) + (0.0,) * 5]
    else:
        around = surroundings(elements)
    depth = [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        depth[i] = depth[e.parent] + 1
    edges: list[Edge] = []
    for i, (one, other) in enumerate(zip(blocks, blocks[1:], strict=False)):
        a, b, apart = one.element, other.element, 0
        while a != b:  # each element is left and entered once, over the whole page
            if depth[a] >= depth[b]:
                a = elements[a].parent
            else:
                b = elements[b].parent
            apart += 1
        unlike = around[one.element][3:] != around[other.element][3:]
        edges.append((i, i + 1, NEIGHBOUR / max(1, apart - 1) * (UNLIKE if unlike else 1)))
    last: dict[tuple, int] = {}  # the last block one or two steps below each element, by what it stands in
    for i, block in enumerate(blocks):
        parent = elements[block.element].parent
        kind = around[block.element][3:]
        here, further = (parent, kind), (elements[parent].parent if parent >= 0 else -1, kind)
        before = last.get(here, last.get(further))
        if before is not None:
            edges.append((before, i, SIBLING))
        last[here] = last[further] = i
    x = np.array([features(b, elements[b.element].tag, around[b.element]) for b in blocks]).reshape(-1, len(PRIOR))
    return [b.text for b in blocks], x, edges


def whole_units(x: float) -> float:
    """To a multiple of 1 / UNIT; what is in balance counts as boilerplate."""
    return (round(max(-LARGEST, min(LARGEST, x)) * UNIT) or -1) / UNIT


def labelled(x: np.ndarray, edges: list[Edge], weights: np.ndarray) -> list[bool]:
    """Which blocks are content.

    A page has a main text where it has any text that stands in nothing beside it: if the cut keeps nothing of a page, that text's costs
    are raised alike, until its likeliest block is likely by SOME, and the page is cut anew.
    """
    score, joined = x @ weights, [(a, b, max(1, round(w * UNIT)) / UNIT) for a, b, w in edges]
    found = minimum_cut([whole_units(v) for v in score.tolist()], joined)
    free = ~x[:, BESIDE].any(axis=1)
    if any(found) or not free.any():
        return found
    raised = np.where(free, score + max(0.0, SOME - score[free].max()), score)
    return minimum_cut([whole_units(v) for v in raised.tolist()], joined)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights for these blocks, drawn towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + BELIEF * (w - PRIOR)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + BELIEF * np.eye(len(w)), g)
    return w


def train(pages: list[tuple[np.ndarray, list[Edge]]]) -> np.ndarray:
    """Weights from pages given as features and edges, by turns with the cut; PRIOR if all blocks are of one kind."""
    weights = PRIOR
    for _ in range(TURNS if pages else 0):
        y = np.concatenate([labelled(x, edges, weights) for x, edges in pages]).astype(float)
        if y.all() or not y.any():
            return PRIOR
        weights = fit(np.concatenate([x for x, _ in pages]), y)
    return weights


def minimum_cut(score: list[float], edges: list[Edge]) -> list[bool]:
    """The source side of the minimum cut: nodes with capacity ``score`` from the source (under 0: to the sink), joined by edges.

    Maximum flow in phases: a breadth-first search from all nodes with something left of the source's capacity tells
    how far each node is from them, then flow goes to the nearest nodes with room left, along edges that lead further only.
    """
    n = len(score)
    left = list(score)
    near: list[list[int]] = [[] for _ in range(n)]  # numbers of the edges that leave a node; an edge's other direction has its last bit flipped
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)
    while True:
        far = [-1] * n
        layer = [i for i, s in enumerate(left) if s > 1e-9]
        for i in layer:
            far[i] = 0
        steps, reached = 0, False
        while layer and not reached:
            steps += 1
            following = []
            for a in layer:
                for e in near[a]:
                    b = to[e]
                    if far[b] < 0 and room[e] > 1e-9:
                        far[b] = steps
                        following.append(b)
                        reached |= left[b] < -1e-9
            layer = following
        if not reached:
            return [f >= 0 for f in far]
        tried = [0] * n
        for start in range(n):
            if far[start] or left[start] <= 1e-9:
                continue
            path: list[int] = []
            at = start
            while True:
                if left[at] < -1e-9:
                    flow = min([left[start], -left[at], *(room[e] for e in path)])
                    left[start] -= flow
                    left[at] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    if left[start] <= 1e-9:
                        break
                    path, at = [], start
                    continue
                while tried[at] < len(near[at]):
                    e = near[at][tried[at]]
                    if room[e] > 1e-9 and far[to[e]] == far[at] + 1 and far[at] < steps:
                        path.append(e)
                        at = to[e]
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    at = to[path.pop() ^ 1]
                    tried[at] += 1


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The text of the blocks on the content side, joined by one space."""
    if not page:
        return ""
    texts, x, edges = graph(page)
    return " ".join(t for t, inside in zip(texts, labelled(x, edges, weights), strict=True) if inside)


PAGE = "x binary, a binary, b binary, w binary"


def sampled(pages: DataFrame, html: str, key: str) -> list[tuple[np.ndarray, list[Edge]]]:
    """Features and edges of some SAMPLE pages, by a hash of ``key``, of at most MOST_BLOCKS blocks each: some MB, whatever the table."""
    n = max(1, pages.count())
    chance = F.pmod(F.xxhash64(F.lit(5), F.col(f"`{key}`"), F.length(f"`{html}`")), F.lit(n))
    chosen = pages.select(F.col(f"`{html}`").alias("html"), chance.alias("chance")).filter((F.col("chance") < SAMPLE) & F.col("html").isNotNull()).select("html").limit(2 * SAMPLE)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["html"]:
                _, x, edges = graph(page)
                if 0 < len(x) <= MOST_BLOCKS:
                    a, b, w = zip(*edges, strict=True) if edges else ((), (), ())
                    rows.append((x.astype("<f4").tobytes(), np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes(), np.array(w, "<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["x", "a", "b", "w"])

    out = []
    for r in chosen.mapInPandas(read, PAGE).collect():
        x = np.frombuffer(r["x"], "<f4").reshape(-1, len(PRIOR)).astype(float)
        out.append((x, [*zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("a", "<i4"), ("b", "<i4"), ("w", "<f4"))), strict=True)]))
    return out


def extract_text(pages: DataFrame, html: str = "html", key: str = "url") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole of ``html``: empty for null, empty and textless pages.

    A bounded sample of pages, by a hash of ``key``, trains the block classifier; all pages are then independent
    of each other, without a shuffle. A column named ``text`` is replaced; others stay.
    """
    kept = [c for c in pages.columns if c != "text"]
    rest = pages.select(*(F.col(f"`{c}`") for c in kept))
    weights = train(sampled(rest, html, key))
    schema = T.StructType([*rest.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = pa.array([main_text(h.as_py(), weights) for h in part.column(html)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)

    return rest.mapInArrow(run, schema)
