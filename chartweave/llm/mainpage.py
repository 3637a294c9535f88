"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf path of block elements. For each path, text length
and punctuation outside links are summed per node, smoothed with what a character of its container sees, and
fused with the container's share of the page's text and with a weight for names of class and id; paths whose score reaches a
share of the page's level are content. Elements that no page shows as content
(scripts, forms, navigation and the like, told by tag or role) are left out from the start.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, with_arrow

#: A quote opens a value only behind "="; a tag whose quote never closes ends at the next ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)(?P<shut>>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?P<shut2>>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "head script style textarea title xmp iframe noembed noframes noscript template svg math canvas audio video object embed applet"
    " nav aside button select option menu dialog footer input label".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Parts of class and id names of elements that are seldom the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus reply replies"
    " discussion discussions respond social share sharing related recommended recommendations newsletter subscribe subscription signup login popup modal"
    " overlay widget toolbar pagination pager copyright disclaimer skip".split()
)
#: Parts of names that say where something is or what form it has.
PLACES = frozenset(
    "area bar block body bottom box center col column container content footer group head header holder inner item items left list main middle outer"
    " panel right row section side slot small large text top unit wrap wrapper page post site".split()
)
#: Weights of elements by their names: of NAMES and PLACES alone, or of NAMES and other words.
NAMED, PARTLY_NAMED = 0.02, 0.5
#: A start tag of the first kind ends an open element of the second, unless one of the third is nearer.
P_ENDERS = BLOCK - frozenset("option optgroup body html head caption tbody td tfoot th thead tr".split())
P_BOUNDS = ("td", "th", "table", "button", "object")
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (a.split(), b.split()) for k, (a, b) in SIBLINGS.items()}
#: What the parts of a page are judged with: the nearest article, else the nearest of the others that no list or table lies within.
ARTICLES = frozenset("article main".split())
CONTAINERS = frozenset("section div body".split())
LISTS = frozenset("ul ol dl dir table".split())
#: Elements that may stand in a head; others, and text, end it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: How short notices of copyright begin outside articles.
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)\s*(?:©|\(c\)|\d{4})|all rights reserved", re.I)
NOTICE_WORDS = 25
#: The share of the page's level that a path must reach.
SHARE = 0.15
#: A form around this share of a page's text, with an article or a block of so many words, is no form of its own but holds the page.
FORM_SHARE, FORM_WORDS = 0.5, 25


class Path:
    """A root-to-leaf path of block elements, linked to the path without its leaf."""

    def __init__(self, tag: str, weight: float, parent: Path | None):
        self.parent, self.longer = parent, {}
        self.weight = weight * (parent.weight if parent else 1.0)
        within = parent.article if parent else None
        self.article = self if tag in ARTICLES else within
        if tag in ARTICLES or parent is None:
            self.container, self.listed = self, False
        else:
            self.listed = (parent.listed and tag != "section") or tag in LISTS
            self.container = self if tag in CONTAINERS and not self.listed and not within else parent.container

    def then(self, tag: str, weight: float) -> Path:
        key = (tag, weight)
        if key not in self.longer:
            self.longer[key] = Path(tag, weight, self)
        return self.longer[key]


@dataclass
class Node:
    path: Path
    form: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def name_weight(value: str) -> float:
    """By the words of a class or id attribute, each of its names by itself."""
    weight = 1.0
    for name in value.split():
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if parts & NAMES:
            weight = min(weight, PARTLY_NAMED if any(not p.isdigit() for p in parts - NAMES - PLACES) else NAMED)
    return weight


def judged(tag: str, rest: str, within: bool) -> tuple[bool, float]:
    """Whether an element is no content whatever it holds, and its weight; ``within``: it lies in an article or main element."""
    if tag in NEVER or (tag == "header" and not within):
        return True, 1.0
    weight = 1.0
    if not rest or tag in ("html", "body", "main", "article"):
        return False, weight
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            weight = min(weight, name_weight(value))
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True, weight
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, weight
    return False, weight


class Open:
    """Elements that are open: from the outermost on, and where each tag is among them."""

    def __init__(self, root: Path):
        self.root, self.stack, self.at = root, [], defaultdict(list)

    def push(self, tag: str, never: bool, within: bool, path: Path) -> None:
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, never, within, path))

    def last(self, *tags: str) -> int:
        """Place of the innermost of these; -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def first_after(self, place: int, tags: list[str]) -> int:
        """Place of the outermost of these inside ``place``; -1 if there is none."""
        found = [at[k] for t in tags if (at := self.at[t]) and (k := bisect_right(at, place)) < len(at)]
        return min(found, default=-1)

    def cut(self, place: int) -> list[str]:
        """The tags of the elements from ``place`` on, which end."""
        gone = [e[0] for e in self.stack[place:]]
        for tag in gone:
            self.at[tag].pop()
        del self.stack[place:]
        return gone

    @property
    def path(self) -> Path:
        return self.stack[-1][3] if self.stack else self.root

    @property
    def innermost(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    @property
    def never(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    @property
    def within(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]


def nodes(page: str) -> list[Node]:
    """Text nodes (blocks) outside elements that are never content, in page order, in time linear in the page."""
    out: list[Node] = []
    opened = Open(Path("", 1.0, None))
    now: Node | None = None
    at, links, forms, form = 0, 0, 0, 0

    def say(text: str) -> None:
        nonlocal now
        if text and opened.innermost == "head" and not text.isspace():
            close(len(opened.stack) - 1)
        if not text or opened.never:
            return
        if now is None:
            if text.isspace():
                return
            now = Node(opened.path, form)
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def close(place: int) -> None:
        nonlocal now, links, form
        gone = opened.cut(place)
        if "form" in gone:
            form = 0
        if any(t in BLOCK for t in gone):
            now = None
        links -= gone.count("a")

    while True:
        m = MARKUP.search(page, at)
        say(page[at : m.start()] if m else page[at:])
        if not m:
            return without_forms(out)
        at = m.end()
        tag, end, rest, shut = (m["tag"], m["end"], m["rest"], m["shut"]) if m["tag"] else (m["tag2"], m["end2"], m["rest2"], m["shut2"])
        tag = (tag or "").lower()
        if not tag or not shut:
            continue
        if end:
            place = opened.last(tag)
            if place >= 0:
                close(place)
            elif tag in BLOCK:
                now = None
            continue
        if opened.innermost == "head" and tag not in HEAD or tag == "body" and opened.at["head"]:
            close(opened.last("head"))
        if tag in P_ENDERS and (place := opened.last("p")) > opened.last(*P_BOUNDS):
            close(place)
        if tag in SIBLINGS:
            ends, bounds = SIBLINGS[tag]
            if (place := opened.first_after(opened.last(*bounds), ends)) >= 0:
                close(place)
        if tag in BLOCK:
            now = None
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        never, weight = judged(tag, rest, opened.within)
        path = opened.path.then(tag, weight) if tag in BLOCK or weight < 1 else opened.path
        opened.push(tag, opened.never or never, opened.within or tag in ARTICLES, path)
        if tag == "a":
            links += 1
        if tag == "form" and not form:
            forms += 1
            form = forms
        if tag in RAW:
            raw_end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = raw_end.end() if raw_end else len(page)
            close(len(opened.stack) - 1)


def without_forms(found: list[Node]) -> list[Node]:
    """The text nodes that lie in no form, or in one that holds the page."""
    sizes, holds = defaultdict(int), set()
    for n in found:
        text = "".join(n.parts)
        sizes[n.form] += len(text)
        if n.path.article or len(text.split()) >= FORM_WORDS:
            holds.add(n.form)
    least = FORM_SHARE * sum(sizes.values())
    return [n for n in found if not n.form or (n.form in holds and sizes[n.form] >= least)]


def blocks(page: str | None) -> list[tuple[Path, str, float]]:
    """(path, text, share of it in links) of the text nodes with single spaces."""
    found = []
    for n in nodes(page or ""):
        raw = "".join(n.parts)
        text = SPACE.sub(" ", html.unescape(raw)).strip()
        if text:
            found.append((n.path, text, min(1.0, n.linked / max(1, len(raw)))))
    return found


def scores(found: list[tuple[Path, str, float]]) -> tuple[dict[Path, float], float]:
    """The score of every path, and the page's level.

    Length and punctuation are those outside links. Each is the mean over the path's nodes, averaged with the
    mean over its container's nodes weighted by their lengths, so that many short items do not hide long paragraphs.
    The score is the root of their product, times the root of the container's share (of the container
    with the most text), times the weight of the path's names. The level is the mean of the scores
    without names' weights, each path by its text.
    """
    count, length, marks = defaultdict(int), defaultdict(float), defaultdict(float)
    total, longs, dense = defaultdict(float), defaultdict(float), defaultdict(float)  # by container
    for path, text, linked in found:
        n, m = len(text) * (1 - linked), (len(PUNCTUATION.findall(text)) + 1) * (1 - linked)
        count[path] += 1
        length[path] += n
        marks[path] += m
        total[path.container] += n
        longs[path.container] += n * n
        dense[path.container] += n * m
    most = max(total.values(), default=0.0)
    if not most:
        return {p: 0.0 for p in count}, 0.0
    plain = {}
    for path, k in count.items():
        inside = total[path.container]
        own = (length[path] / k, marks[path] / k)
        around = (longs[path.container] / inside, dense[path.container] / inside) if inside else (0.0, 0.0)
        smooth = [(x + y) / 2 for x, y in zip(own, around, strict=True)]
        plain[path] = (smooth[0] * smooth[1] * inside / most) ** 0.5
    level = sum(plain[p] * length[p] for p in count) / sum(length.values())
    return {p: s * p.weight for p, s in plain.items()}, level


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, joined by empty lines. Blocks that are links only stay in an article or main element."""
    found = blocks(page)
    score, level = scores(found)
    kept = [(path, text) for path, text, linked in found if score[path] >= SHARE * level and level and (linked < 1 or path.article)]
    return "\n\n".join(text for path, text in kept if path.article or not COPYRIGHT.match(text) or len(text.split()) > NOTICE_WORDS)


def main_texts(df: DataFrame, *, page: str = "html") -> DataFrame:
    """All columns but the page, with ``text`` and ``n_chars`` (code points).

    Null or empty pages, and pages without words, give an empty text; equal rows give equal texts; an empty table
    gives an empty one. Pages may have any length and depth: time and memory are linear in a page. Other
    columns keep their names; a new one whose name is taken gets underscores behind it.
    """

    def make():
        def work(pages):
            texts = [main_text(p) for p in pages]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    kept = [c for c in df.columns if c != page]
    out = with_arrow(df, [page], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
    named = zip(out.columns[-2:], fresh(df.select(*kept), "text", "n_chars"), strict=True)
    return out.select(*kept, *(F.col(c).alias(n) for c, n in named))


def op9_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
