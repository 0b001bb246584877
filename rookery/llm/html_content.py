"""Main text of web pages by minimum cut.

A page is read into blocks (runs of text between block-level tags) with the tags and class names around them.
A naive Bayes classifier over what a block looks like (words, links, punctuation, tag) is trained by counting on
blocks whose surroundings leave no doubt, such as `article` and `nav`; at most about `FIT_PAGES` pages, chosen by a
hash of their text, take part. Its log odds, with the surroundings' own weight, are the capacities to the
two terminals; neighbours in page order and in the DOM are tied by smoothness edges, and the minimum cut
separates content from boilerplate. Blocks whose own capacity outweighs all their ties are settled first and blocks with one or two ties are
taken out, which changes no minimum; what remains goes through maximum flow.

Each page is one row of one task and no page is shuffled; the classifier is a table of a fixed number of features.

Defined results: null and empty pages have the empty text; unclosed and stray tags are taken as browsers
take them, roughly; rows that repeat an id have one result each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled

#: Bound on the pages that train the classifier.
FIT_PAGES = 20_000
#: Weight of surroundings that leave no doubt, of class names, and of the ties between blocks. The classifier and the
#: ties together (at most `OWN` and 2 * NEXT + NEAR) outvote a name, but not tags.
SURE, HINT, NEXT, NEAR = 12.0, 5.0, 0.6, 0.8
#: Bound on the classifier's log odds.
OWN = 4.0

#: Tags that end a run of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no text of the page, up to their end tag.
RAW_TAGS = frozenset("script style template textarea title".split())
#: Block tags that end an open paragraph, and those whose sibling ends them.
CLOSES_ITSELF = frozenset("p li dt dd option tr td th".split())
BOILER_TAGS = frozenset("nav aside footer form menu head search dialog button select label input".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar aside rail menu nav navbar navigation topbar breadcrumb breadcrumbs "
    "footer masthead share sharing social related recommended recommendations trending widget "
    "search copyright pagination pager toolbar skip legal disclaimer form".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
STRONG_WORDS = frozenset("article main post entry story".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
HEADER_WORDS = frozenset("header head top".split())
#: What a section in an article has to be named, by these words alone, to be no part of it.
THREAD_WORDS = frozenset("comment comments disqus thread".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Tags whose names inside content are topics, and those whose ids are places that links lead to.
TOPIC_TAGS = HEADINGS | {"section"}
ANCHOR_TAGS = frozenset("p li dt dd dl ol ul table tr td th pre blockquote figure figcaption details".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|\Z)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Element:
    """An open element, and what it inherits, which is worked out in order of opening, so deep pages cost no more than flat ones."""

    tag: str
    #: The attributes that may tell something, as (name, value).
    attributes: list[tuple[str, str]]
    parent: Element | None = None
    number: int = 0
    depth: int = field(init=False, default=1)
    #: Whether the page overrules what the names call boilerplate, because most of its text is in here.
    overruled: bool = False
    #: Code points of text in here, blocks in here that surroundings mark as content and that are no headings, and paragraphs
    #: of which surroundings say nothing.
    chars: int = 0
    marked: int = 0
    plain: int = 0
    #: -1 boilerplate without doubt, 1 content without doubt, else 0; and what its names suggest.
    sure: int = field(init=False, default=0)
    hint: float = field(init=False, default=0.0)
    in_content: bool = field(init=False, default=False)
    in_comments: bool = field(init=False, default=False)
    #: The innermost element without doubt, this one included, that is content.
    article: Element | None = field(init=False, default=None)
    #: The weight of the innermost element, this one included, that tells anything.
    telling: float = field(init=False, default=0.0)
    #: What the surroundings of a block in it say, as a weight.
    place: float = field(init=False, default=0.0)

    def __post_init__(self) -> None:
        self.depth = self.parent.depth + 1 if self.parent else 1

    def work_out(self) -> None:
        up = self.parent
        outer, place = (up.telling, up.place) if up else (0.0, 0.0)
        strong, comments = self._read_names(bool(up and up.in_content), bool(up and up.in_comments))
        self.in_content = self.sure > 0 or self.hint > 0 or bool(up and up.in_content)
        self.in_comments = comments or bool(up and up.in_comments)
        self.article = self if self.sure > 0 else up.article if up else None
        self.telling = SURE * self.sure or self.hint or outer
        if self.sure or self.hint < 0:
            place = self.telling
        elif self.hint > 0:
            # A name such as `text` says little inside something named `sidebar`.
            place = self.hint if strong or not outer else outer
        self.place = place

    def _read_names(self, in_content: bool, in_comments: bool) -> tuple[bool, bool]:
        """Sets `sure` and `hint`; whether the hint is a name that articles have, and whether it is one of comments."""
        tag = self.tag
        sure = -1 if tag in BOILER_TAGS or tag == "header" and not in_content else 1 if tag in CONTENT_TAGS and not in_comments else 0
        hint, strong, comments = 0.0, False, False
        for name, value in self.attributes:
            if name == "role":
                sure = -1 if value in BOILER_ROLES else 1 if value in ("main", "article") else sure
            elif name not in ("class", "id"):
                sure = -1  # hidden
            elif tag not in ("html", "body"):
                words = set(_SPLIT.split(value))
                # Headings and sections of an article are named by their topic, and so are the places its links lead to.
                topic = in_content and (tag in TOPIC_TAGS and not words - {""} <= THREAD_WORDS or name == "id" and tag in ANCHOR_TAGS)
                if words & COMMENT_WORDS and not topic and not self.overruled:
                    hint, comments = -HINT, True
                elif not (topic or self.overruled) and (words & BOILER_WORDS or words & HEADER_WORDS and not in_content and not words & CONTENT_WORDS):
                    hint = -HINT
                elif words & CONTENT_WORDS and hint >= 0:
                    hint, strong = HINT, strong or bool(words & STRONG_WORDS)
        if sure * hint < 0:  # a tag that is boilerplate wins over a name, a name that is boilerplate over `article`
            sure, hint = (sure, 0.0) if sure < 0 else (0, hint)
        self.sure, self.hint = sure, hint
        return strong, comments


@dataclass
class Block:
    text: str
    linked: int
    inside: Element | None

    @property
    def place(self) -> float:
        return self.inside.place if self.inside else 0.0

    @property
    def sure(self) -> int:
        return (self.place >= SURE) - (self.place <= -SURE)


def _attributes(rest: str) -> list[tuple[str, str]]:
    found = []
    for name, *values in _ATTRIBUTE.findall(rest) if rest.strip() else ():
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role", "hidden") or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.append((name, value))
    return found


def _place(found: list[Block], elements: list[Element]) -> None:
    """What surroundings say, but for names of boilerplate on wrappers that hold most of the text there is.

    Inside an article the article's text counts, elsewhere the page's, and there, as for comments anywhere, the name
    stands if content is marked outside the wrapper: comments and notices are often longer than what they belong to.
    Outside of comments an unmarked paragraph counts as content too.
    """
    for e in elements:
        e.work_out()
    if not any(e.hint < 0 for e in elements):
        return
    page = Element("", [])
    for b in found:
        inside = b.inside or page
        if inside.place > -SURE:
            inside.chars += len(b.text)
            inside.marked += inside.place > 0 and inside.tag not in HEADINGS
            inside.plain += not inside.place and inside.tag == "p"
    for e in reversed(elements):
        up = e.parent or page
        up.chars += e.chars
        up.marked += e.marked
        up.plain += e.plain
    for e in elements:
        article = e.parent.article if e.parent else None
        alone = page.marked == e.marked and (not e.in_comments or page.plain == e.plain)
        within = article.chars if article and not e.in_comments else page.chars
        e.overruled = e.hint < 0 and 2 * e.chars > within and (alone or bool(article) and not e.in_comments)
    if any(e.overruled for e in elements):
        for e in elements:
            e.work_out()


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    found: list[Block] = []
    elements: list[Element] = []
    open_tags: list[Element] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            found.append(Block(text, linked, open_tags[-1] if open_tags else None))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    def close(tag: str) -> None:
        while opened[tag]:
            last = open_tags.pop()
            opened[last.tag] -= 1
            if last.tag == tag:
                break

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS or tag in ("button", "select"):
                flush()
                links = 0
                close(tag)
            continue
        if tag in RAW_TAGS:
            if not m["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            add(" ")
        elif tag == "br":
            add(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS or tag in ("button", "select"):
            flush()
            if tag in VOID_TAGS:
                continue
            if open_tags and (open_tags[-1].tag == "p" or open_tags[-1].tag == tag and tag in CLOSES_ITSELF):
                close(open_tags[-1].tag)
            elements.append(Element(tag, _attributes(m["rest"]), open_tags[-1] if open_tags else None, len(elements) + 1))
            open_tags.append(elements[-1])
            opened[tag] += 1
    flush()
    _place(found, elements)
    return found


def features(block: Block) -> list[str]:
    """What a block looks like, apart from its surroundings."""
    words = block.text.count(" ") + 1
    stops = sum(block.text.count(c) for c in ".,;:?!")
    tag = block.inside.tag if block.inside else ""
    return [
        f"words {min(8, int(math.log2(words)))}",
        f"linked {min(4, int(5 * block.linked / max(1, len(block.text))))}",
        f"stops {min(4, int(10 * stops / words))}",
        f"ends {block.text[-1] in '.?!'}",
        f"tag {tag if tag in BLOCK_TAGS else 'other'}",
        f"sign {any(c in block.text for c in '©|»›')}",
    ]


def _capacity(block: Block, odds: dict[str, float]) -> float:
    """Above 0 towards content, below towards boilerplate."""
    own = max(-OWN, min(OWN, sum(odds.get(f, 0.0) for f in features(block))))
    return own + block.place


def _ties(found: list[Block]) -> list[dict[int, float]]:
    """Each block's neighbours in page order and under the same element, with the ties' weights."""
    ties: list[dict[int, float]] = [{} for _ in found]

    def tie(a: int, b: int, weight: float) -> None:
        ties[a][b] = ties[b][a] = ties[a].get(b, 0.0) + weight

    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            a, b = found[i - 1].inside, block.inside
            deepest = max(a.depth if a else 0, b.depth if b else 0)
            while a is not b:
                if a and (not b or a.depth >= b.depth):
                    a = a.parent
                else:
                    b = b.parent
            tie(i - 1, i, NEXT / (1 + deepest - (a.depth if a else 0)))
        parent = block.inside.parent.number if block.inside and block.inside.parent else 0
        if parent in last:
            tie(last[parent], i, NEAR / 2)
        last[parent] = i
    return ties


def minimum_cut(capacity: list[float], ties: list[dict[int, float]]) -> list[bool]:
    """Which nodes are on the side of the positive terminal in a minimum cut.

    Nodes that outweigh their ties are settled first. A node with one or two ties is then taken out: the cost of its better side, given
    its neighbours' sides, is again a capacity of each and a tie between them. Blocks tied in page order and to their siblings vanish
    that way one by one, in time linear in their number; a maximum flow settles what is tied more closely.
    """
    side: list[bool | None] = [None] * len(capacity)
    own = list(capacity)
    left = [dict(t) for t in ties]
    queue = deque(range(len(own)))
    while queue:  # settle nodes that outweigh their ties, and hand those ties on to the neighbours
        i = queue.popleft()
        if side[i] is not None or abs(own[i]) < sum(left[i].values()) or not own[i] and left[i]:
            continue
        side[i] = own[i] > 0
        for j, weight in left[i].items():
            own[j] += weight if side[i] else -weight
            del left[j][i]
            queue.append(j)
    taken = _take_out(own, left, side)
    _settle_by_flow(own, left, side, {i for i, _, _ in taken})
    for i, value, around in reversed(taken):
        yes = -value + sum(w for j, w in around if not side[j])
        side[i] = yes < sum(w for j, w in around if side[j])
    return [bool(s) for s in side]


def _take_out(own: list[float], left: list[dict[int, float]], side: list[bool | None]) -> list[tuple[int, float, list[tuple[int, float]]]]:
    """Takes nodes with at most two ties out of `own` and `left`; returns each with its capacity and ties at that time."""
    taken, gone = [], [s is not None for s in side]
    queue = deque(i for i, s in enumerate(side) if s is None and len(left[i]) <= 2)
    while queue:
        i = queue.popleft()
        if gone[i] or len(left[i]) > 2:
            continue
        gone[i] = True
        around = list(left[i].items())
        taken.append((i, own[i], around))
        for j, _ in around:
            del left[j][i]
        if around:
            c = own[i]
            (u, p), (v, q) = around if len(around) == 2 else (around[0], (-1, 0.0))
            # What the node costs at best for the sides of u and v.
            none, first, second, both = min(0.0, p + q - c), min(p, q - c), min(q, p - c), min(p + q, -c)
            bend = first + second - none - both  # never below 0
            own[u] -= first - none - bend / 2
            if v >= 0:
                own[v] -= second - none - bend / 2
                if bend > 0:
                    left[u][v] = left[v][u] = left[u].get(v, 0.0) + bend / 2
            queue.extend(j for j, _ in around if len(left[j]) <= 2)
    return taken


def _settle_by_flow(own: list[float], left: list[dict[int, float]], side: list[bool | None], taken: set[int]) -> None:
    """Settles the nodes that remain, by blocking flows from the positive terminal to the negative one."""
    rest = [i for i, s in enumerate(side) if s is None and i not in taken]
    if not rest:
        return
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(left[i]) for i in rest}
    flow[source], flow[sink] = {}, {}
    for i in rest:
        a, b = (source, i) if own[i] > 0 else (i, sink)
        flow[a][b] = abs(own[i])
        flow[b].setdefault(a, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, room in flow[a].items():
                if room > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            break
        ahead = {a: [b for b in flow[a] if level.get(b) == level[a] + 1] for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                room = min(flow[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    flow[x][y] -= room
                    flow[y][x] = flow[y].get(x, 0.0) + room
                path = [source]
            elif ahead[a] and flow[a][ahead[a][-1]] > 1e-9:
                path.append(ahead[a][-1])
            elif ahead[a]:
                ahead[a].pop()
            else:  # nothing goes on from here
                path.pop()
                if path:
                    ahead[path[-1]].pop()
    for i in rest:
        side[i] = i in level


def main_text(page: str, odds: dict[str, float]) -> str:
    found = blocks(page)
    if not found:
        return ""
    side = minimum_cut([_capacity(b, odds) for b in found], _ties(found))
    return " ".join(b.text for b, keep in zip(found, side) if keep)


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, int], int] = {}
        for page in batch.column(0):
            for block in blocks(page.as_py() or ""):
                if block.sure:  # its surroundings leave no doubt
                    for f in ["all", *features(block)]:
                        counts[f, block.sure] = counts.get((f, block.sure), 0) + 1
        if counts:
            yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in counts], "side": pa.array([s for _, s in counts], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def train(pages: DataFrame) -> dict[str, float]:
    """Log odds of content for each feature."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.lit("fit"), filled("html")), F.lit(1 << 20)) / float(1 << 20)
    some = pages.where(draw < FIT_PAGES / max(n, 1)).select("html")
    counted = some.mapInArrow(_training_batches, "feature string, side long, n long").groupBy("feature", "side").agg(F.sum("n").alias("n"))
    table = {(r.feature, r.side): r.n for r in counted.collect()}  # a fixed set of features
    yes, no = table.get(("all", 1), 0), table.get(("all", -1), 0)
    if not yes or not no:
        return {}
    names = {f for f, _ in table if f != "all"}
    return {f: math.log((table.get((f, 1), 0) + 1) / (yes + 2)) - math.log((table.get((f, -1), 0) + 1) / (no + 2)) for f in names}


def _extracted(odds: dict[str, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", odds) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    odds = train(pages)
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(odds), ", ".join([*kinds, "text string", "n_chars long"]))
