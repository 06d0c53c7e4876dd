"""Main text of HTML pages by tag-path ratios.

A page is a sequence of text runs, each under a root-to-leaf tag path. Runs are
gathered by path; every path gets two ratios, characters of text and
punctuation marks per run, both discounted by the share of its text inside
links. The ratios are smoothed over the paths in page order (neighbouring paths
lend each other weight) and fused by multiplication. A path is content when its
score lies no further below the page's mean than ``SPREADS`` deviations, on a
log scale, and most of its text is outside links. Headings next to chosen paths
come along.

Before that, containers that never are the article go: by their tag (menus,
headers, footers, sidebars, scripts), or by a word of their class or id. A name
alone does not decide: a container that holds an article element, or most of a
page's unlinked text where no article is marked elsewhere, stays. A marked
article bounds the rest only if its runs hold most of the page's score.

The parser is a tokeniser of tags with the implied end tags of HTML. It keeps
block elements on its stack and nothing else, so that the work is linear in the
page however tags nest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deviations below the mean, on a log scale, at which a path is no content.
SPREADS = 1.5
#: Share of the unlinked text from which a container is kept in spite of its name; for comments a greater one.
MOST, NEARLY_ALL = 0.5, 0.9

# a quote opens a value only behind "="; an open value runs to the end of the page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(>|\Z)|<[!?][^>]*(?:>|\Z)|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][-\w:.]*)")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_NAME_PARTS = re.compile(r"[A-Za-z][a-z0-9]*|[0-9]+")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

# Fixed values of HTML: void elements, raw-text elements, block-level elements, and families of elements of which a new one closes an open one in the same scope.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg object audio video canvas select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FAMILIES = (("li", "ul ol menu"), ("dt dd", "dl"), ("tr", "table tbody thead tfoot"), ("td th", "tr table"))
_TWINS = {tag: i for i, (twins, _) in enumerate(_FAMILIES) for tag in twins.split()}
_SCOPES = [frozenset(scope.split()) for _, scope in _FAMILIES]
_NOT_CONTENT = frozenset("nav header footer aside menu button dialog head".split())
_NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in class or id names that mark what is not the article.
_COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
_NOT_CONTENT_NAMES = _COMMENT_NAMES | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget widgets cookie cookies consent notice gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendation recommendations toolbar pagination pager "
    "copyright disclaimer skip search".split()
)


@dataclass
class Run:
    """Text of one block. ``path`` numbers its tag path, ``named`` the innermost container around it whose name speaks against it (-1: none)."""

    path: int
    text: str
    linked: int
    heading: bool
    inside: bool
    named: int

    @property
    def free(self) -> int:
        """Characters outside links."""
        return len(self.text) - min(self.linked, len(self.text))


@dataclass
class Container:
    """A block whose name, or form tag, speaks against it."""

    parent: int
    words: frozenset[str]
    form: bool
    free: int = 0
    articles: int = 0


@dataclass
class Open:
    """An open block element. ``near``: for each family the open element that a new twin closes."""

    tag: str
    path: int
    skipped: bool
    inside: bool
    named: int
    near: tuple[int, ...]


@dataclass
class Page:
    """The runs of a page, its tag paths as (path around, step), and the containers in question."""

    runs: list[Run] = field(default_factory=list)
    paths: list[tuple[int, str]] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)
    articles: int = 0


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words: set[str] = set()
    role, hidden = "", False
    for name, a, b, c, alone in _ATTRIBUTE.findall(attributes):
        key, value = (name or alone).lower(), html.unescape(a or b or c)
        if key in ("class", "id"):
            for part in value.split():
                words.update(w.lower() for w in _NAME_PARTS.findall(part))
                words.add(part.lower())
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return words, role, hidden


class _Reader:
    """Reads a page into its runs."""

    def __init__(self) -> None:
        self.page = Page()
        self.numbers: dict[tuple[int, str], int] = {}
        self.stack: list[Open] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.link: int | None = None  # number of blocks around the open link
        self.mute: list[int | str] = []  # an inline element that is skipped: tag, how many of it are open, number of blocks around

    def flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip() if self.parts else ""
        if text:
            top = self.stack[-1] if self.stack else Open("", self.step(-1, ""), False, False, -1, ())
            self.page.runs.append(Run(top.path, text, self.linked, top.tag in _HEADING, top.inside, top.named))
        self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if text and not self.mute and not (self.stack and self.stack[-1].skipped):
            self.parts.append(text)
            if self.link is not None:
                self.linked += len(text.strip())

    def step(self, around: int, name: str) -> int:
        key = (around, name)
        if key not in self.numbers:
            self.numbers[key] = len(self.page.paths)
            self.page.paths.append(key)
        return self.numbers[key]

    def pop(self, n: int) -> None:
        self.flush()
        for e in self.stack[n:]:
            self.open[e.tag] -= 1
        del self.stack[n:]
        if self.link is not None and self.link > n:
            self.link = None
        if self.mute and self.mute[2] > n:
            self.mute = []

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if self.mute and self.mute[0] == tag:
            self.mute[1] -= 1
            if not self.mute[1]:
                self.mute = []
        if tag not in _BLOCK:
            return
        if not self.open[tag]:
            if tag == "p":
                self.flush()
            return
        n = len(self.stack) - 1
        while self.stack[n].tag != tag:
            n -= 1
        self.pop(n)

    def inline(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = len(self.stack)
        if self.mute:
            self.mute[1] += self.mute[0] == tag
        elif attributes.strip():
            words, role, hidden = _names(attributes)
            if hidden or role in _NOT_CONTENT_ROLES or tag in ("span", "ins") and not words.isdisjoint(_NOT_CONTENT_NAMES):
                self.mute = [tag, 1, len(self.stack)]

    def block(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.stack and self.stack[-1].tag == "p":  # a block ends an open paragraph
            self.pop(len(self.stack) - 1)
        family = _TWINS.get(tag)
        if family is not None and self.stack and self.stack[-1].near[family] >= 0:
            self.pop(self.stack[-1].near[family])
        top = self.stack[-1] if self.stack else Open("", -1, False, False, -1, (-1,) * len(_FAMILIES))
        words, role, hidden = _names(attributes)
        mine = words & _NOT_CONTENT_NAMES
        article = (tag in ("article", "main") or role in ("article", "main")) and not (words & _COMMENT_NAMES)
        skipped = top.skipped or bool(self.mute) or hidden or role in _NOT_CONTENT_ROLES
        if tag in _NOT_CONTENT:  # an article's own header holds its title
            skipped = skipped or not (tag == "header" and top.inside)
        named = top.named
        if not skipped and (mine and tag not in ("html", "body") and not article or tag == "form"):
            named = len(self.page.containers)
            self.page.containers.append(Container(top.named, frozenset(mine), tag == "form"))
        if article and not skipped:
            self.page.articles += 1
            if named >= 0:
                self.page.containers[named].articles += 1
        at = len(self.stack)
        near = tuple(at if _TWINS.get(tag) == i else -1 if tag in scope else n for i, (scope, n) in enumerate(zip(_SCOPES, top.near, strict=True)))
        path = self.step(top.path, tag + "".join(f".{w}" for w in sorted(words)))
        self.stack.append(Open(tag, path, skipped, top.inside or article, named, near))
        self.open[tag] += 1


def read(page: str) -> Page:
    """The page's text runs in order, without what its tags alone exclude."""
    reader, at = _Reader(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            reader.say(page[at:])
            break
        reader.say(page[at : m.start()])
        at = m.end()
        if m[0] == "<":
            reader.say("<")
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag == "br":
            reader.say(" ")
        elif tag in _VOID:
            if tag in _BLOCK:
                reader.flush()
        elif tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in _BLOCK:
            reader.block(tag, m[3])
        else:
            reader.inline(tag, m[3])
    reader.flush()
    return reader.page


def _refused(page: Page) -> list[bool]:
    """For each container in question whether it is left out, itself or with one around it."""
    total = 0
    for r in page.runs:
        total += r.free
        if r.named >= 0:
            page.containers[r.named].free += r.free
    for c in reversed(page.containers):  # a container stands behind the one around it
        if c.parent >= 0:
            page.containers[c.parent].free += c.free
            page.containers[c.parent].articles += c.articles
    out: list[bool] = []
    for c in page.containers:
        share = NEARLY_ALL if c.words & _COMMENT_NAMES else MOST
        wraps = c.articles or not c.form and not page.articles and c.free >= share * total
        out.append(not wraps or c.parent >= 0 and out[c.parent])
    return out


def content(page: Page) -> list[str]:
    """The blocks that the tag-path ratios choose, in page order."""
    refused = _refused(page)
    runs = [r for r in page.runs if r.named < 0 or not refused[r.named]]
    if not runs:
        return []
    totals: dict[int, list[float]] = {}  # characters, punctuation, runs, characters outside links
    for r in runs:
        total = totals.setdefault(r.path, [0.0, 0.0, 0.0, 0.0])
        for i, v in enumerate((len(r.text), len(_PUNCTUATION.findall(r.text)), 1, r.free)):
            total[i] += v
    order = list(totals)
    free = {p: t[3] / t[0] for p, t in totals.items()}
    text = _smooth([totals[p][0] / totals[p][2] * free[p] for p in order])
    marks = _smooth([totals[p][1] / totals[p][2] * free[p] for p in order])
    fused = {p: math.log1p(a * math.sqrt(1 + b)) for p, a, b in zip(order, text, marks, strict=True)}
    mean = sum(fused.values()) / len(fused)
    floor = mean - SPREADS * math.sqrt(sum((v - mean) ** 2 for v in fused.values()) / len(fused))
    chosen = {p for p in order if fused[p] >= floor and free[p] > 0.5}

    def weight(rs: list[Run]) -> float:
        return sum(r.free * fused[r.path] for r in rs if r.path in chosen)

    marked = [r for r in runs if r.inside]
    if marked and weight(marked) >= MOST * weight(runs):
        runs = marked
    keep = [r.path in chosen for r in runs]
    above: set[int] = set()  # the paths around what is kept
    for r, k in zip(runs, keep, strict=True):
        p = page.paths[r.path][0] if k else -1
        while p >= 0 and p not in above:
            above.add(p)
            p = page.paths[p][0]
    first = keep.index(True) if True in keep else len(runs)
    return [r.text for i, (r, k) in enumerate(zip(runs, keep, strict=True)) if k or r.heading and i >= first - 2 and page.paths[r.path][0] in above]


def _smooth(values: list[float]) -> list[float]:
    """Neighbours in page order weigh a quarter each."""
    ends = [values[0], *values, values[-1]]
    return [0.25 * a + 0.5 * b + 0.25 * c for a, b, c in zip(ends, ends[1:], ends[2:])]


def main_text(page: str) -> str:
    """The article of a page: blocks joined by an empty line; empty if there is none."""
    return "\n\n".join(content(read(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars``.

    The whole page is read. A null or empty page has the empty text, and so has
    one without any block of text that is content. Ids and urls pass through as they are, null or repeated; other columns are not
    read. An empty table gives an empty result.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(p) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(rows, f"page_id {id_type}, url {url_type}, text string, n_chars long")
