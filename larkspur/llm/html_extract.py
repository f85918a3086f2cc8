"""HTML extraction (operator 1): content regions by text-to-tag ratio.

The standard library's parser is fed in pieces and its events make lines: runs of text between block boundaries, each
with its characters outside links, its tags and its chain of containers. A line's text-to-tag ratio is those characters over
those tags, times the line's weight: elements that are no part of an article by their name (menus, headers, footers, asides,
dialogs, reader comments) weigh nothing, and containers that only a word in a class, an id or a role marks as such weigh MARKED,
since such words are no proof. Ratios are smoothed over the lines' neighbours with a Gaussian, and lines of at least LAMBDA
standard deviations form the clusters of content.

The clusters choose the region on every page. From the page down, a container that holds menus or other lines without weight, or
doubtful lines alone, is left for the child with at least SHARE of the clusters' text (for its articles, if it has such), until the region holds
content only, is an article, or shares its text out among its children; lines before and behind the clusters of a mixed region
are left out. Inside the region every line is content, however short, but for those of elements and containers marked as no part of an
article, and of links alone outside the clusters.

White space inside a line becomes one space; lines are trimmed and joined by a space. Scripts, styles, controls, drawings and inline
adverts are left out without ending their line. Null and empty pages, and pages without text, give an empty text; an empty table
gives an empty table, repeated rows repeated rows, equal pages equal texts. Unclosed and stray tags are tolerated: an end tag closes what
stands open inside its element. Columns besides key, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_rows, prepare

#: Elements whose text no reader sees, or that are controls or drawings; they may stand inside a word.
MUTED = frozenset("head script style noscript template svg iframe object canvas button select textarea datalist title audio video".split())
#: Elements that are no part of an article.
ASIDE = frozenset("dialog nav aside footer menu search".split())
#: Elements that structure a page; others are inline or single blocks.
CONTAINERS = frozenset("html body main article section div header form table tbody thead tfoot tr td th ul ol dl blockquote figure details center fieldset hgroup address".split()) | ASIDE
#: Of these, what is content as a whole and never a region.
WHOLE = frozenset("ul ol dl blockquote figure details address".split())
#: Elements that end a line without being containers.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre figcaption caption summary legend option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class and id attributes of what is no part of an article, and words that may stand beside them in a name.
ADS = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion".split())
REPLIES = frozenset("comment comments disqus respond replies reply".split())
MARKS = ADS | frozenset("sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar widget search".split())
BESIDE = frozenset("site page main top bottom left right list lists box bar links link buttons button area section wrapper wrap container inner outer block blocks item items posts articles stories content contents slot unit form icons message text panel group primary secondary global local sticky fixed the my js v reader readers user users visitor visitors".split())
#: Names of layouts, which tell what else is on the page.
LAYOUT = re.compile(r"(?:has|with|no|without)[-_].*", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PIECE, SIGMA, LAMBDA, MARKED, SHARE = 1 << 16, 1.0, 0.5, 0.02, 0.6
#: How a container stands: as content, out, a header of which headings stay, or doubtful by its class, id or role.
PLAIN, OUT, HEADER, DOUBTFUL = range(4)


def marked(value: str, marks: frozenset[str]) -> bool:
    """Whether a name in a class or id attribute holds one of the marks and else only words that go with them."""
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
        if not LAYOUT.fullmatch(name) and not marks.isdisjoint(parts) and all(p in MARKS or p in REPLIES or p in BESIDE for p in parts):
            return True
    return False


def unseen(attrs: list[tuple[str, str | None]]) -> bool:
    return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I) or k == "class" and v and "hidden" in v.lower().split() for k, v in attrs)


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    chain: tuple[int, ...]
    heading: str

    def weight(self, kinds: list[int], depth: int = 0) -> float:
        """Of the line within its first `depth` containers."""
        own = [kinds[c] for c in self.chain[depth:]]
        if OUT in own or HEADER in own and not self.heading:
            return 0.0
        return MARKED if DOUBTFUL in own else 1.0

    @property
    def own(self) -> int:
        return max(0, len(self.text) - self.linked)

    @property
    def is_menu(self) -> bool:
        return self.linked > 0.6 * len(self.text)


class Lines(HTMLParser):
    """Collects the lines of a page, and the name and kind of each of its containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # open containers: name and number
        self.names, self.kinds = [""], [PLAIN]
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = self.in_link = 0
        self.heading, self.muted, self.depth = "", "", 0

    def end_line(self) -> None:
        words = " ".join("".join(self.text).split()) if self.text else ""
        if words:
            self.lines.append(Line(words, self.tags, self.linked, tuple(s[1] for s in self.stack), self.heading))
            self.tags = self.linked = 0
        self.text = []

    def kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in ASIDE or unseen(attrs):
            return OUT
        article = any(name in ("article", "main") for name, _ in self.stack)
        if tag == "header":
            return HEADER if article else OUT
        names = [v for k, v in attrs if k in ("class", "id") and v] if tag not in ("html", "body", "main") else []
        if any(marked(v, REPLIES) for v in names):
            return OUT
        if tag == "article":
            return PLAIN
        if article and any(v.lower() in ("header", "page-header", "article-header") for v in names):
            return HEADER
        return DOUBTFUL if tag == "form" or any(marked(v, MARKS) for v in names) or any(k == "role" and v and v.lower() in ROLES for k, v in attrs) else PLAIN

    def push(self, tag: str, kind: int) -> None:
        self.stack.append((tag, len(self.names)))
        self.names.append(tag)
        self.kinds.append(kind)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.muted:
            self.depth += tag == self.muted
            return
        block = tag in CONTAINERS or tag in BLOCKS
        # the end tags of these may be left out: another block ends a paragraph, and an item the item before
        if block and tag != "br" and self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == tag and tag in ("li", "dt", "dd")):
            self.end_line()
            self.stack.pop()
        if tag in MUTED or not block and attrs and tag not in VOID and (unseen(attrs) or any(k in ("class", "id") and v and marked(v, ADS) for k, v in attrs)):
            self.muted, self.depth = tag, 1
        elif block:
            self.end_line()
            kind = self.kind(tag, attrs) if attrs or tag in CONTAINERS else PLAIN
            if tag in CONTAINERS or kind != PLAIN and tag not in VOID:
                self.push(tag, kind)
            self.heading = tag if tag in HEADINGS else "" if tag in BLOCKS and tag != "br" else self.heading
        self.in_link += tag == "a"
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.muted:
            self.depth -= tag == self.muted
            if self.depth and not (tag in CONTAINERS and any(name == tag for name, _ in self.stack)):
                return
            done, self.muted, self.depth = self.depth == 0, "", 0
            if done:
                return
        if tag in CONTAINERS or tag in BLOCKS:
            self.end_line()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break
                if self.stack[i][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            self.heading = "" if tag in HEADINGS else self.heading
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(x: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(x, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def clusters(lines: list[Line], weight: np.ndarray) -> np.ndarray:
    """Which lines reach the threshold of smoothed ratios."""
    ratio = smoothed(weight * np.array([x.own / max(1, x.tags) for x in lines]))
    return (ratio >= min(LAMBDA * ratio.std(), ratio.max())) & (ratio > 0)


def region(lines: list[Line], chosen: np.ndarray, weight: np.ndarray, names: list[str], kinds: list[int]) -> tuple[list[int], int]:
    """The lines of the region that the clusters choose, and how many containers lie around it."""
    mass = np.where(chosen, weight * [x.own for x in lines], 0.0)
    inside, depth, at = list(range(len(lines))), 0, 0
    while names[at] != "article":
        doubtful = all(lines[i].weight(kinds, depth) < 1 for i in inside)
        if not doubtful and not any(weight[i] == 0 or lines[i].is_menu for i in inside):
            break
        total = mass[inside].sum()
        children: dict[int, list[int]] = {}
        for i in inside:
            if len(lines[i].chain) > depth:
                children.setdefault(lines[i].chain[depth], []).append(i)
        articles = [c for c in children if names[c] == "article" and kinds[c] == PLAIN]
        best = max(children, key=lambda c: (mass[children[c]].sum(), -c), default=0)
        part = sorted(i for c in articles for i in children[c]) if best in articles else children.get(best, [])
        if not part or mass[part].sum() < SHARE * total or names[best] in WHOLE:
            if names[at] != "main":
                inside = trimmed(lines, inside, depth, mass, weight)
            break
        if names[at] == "main" and not any(names[c] == "article" for i in part for c in lines[i].chain[depth:]):
            break
        before = [i for i in inside if i < part[0]]
        if before and lines[before[-1]].heading == "h1" and weight[before[-1]] and not lines[before[-1]].is_menu:
            break
        inside, depth, at = part, depth + 1, best
    return inside, depth


def trimmed(lines: list[Line], inside: list[int], depth: int, mass: np.ndarray, weight: np.ndarray) -> list[int]:
    """A mixed region without what stands before and behind its clusters: containers with less than a tenth of its text, and menus."""
    held: dict[int, float] = {}
    for i in inside:
        if len(lines[i].chain) > depth:
            held[lines[i].chain[depth]] = held.get(lines[i].chain[depth], 0.0) + mass[i]
    total = mass[inside].sum()
    keeps = [i for i in inside if weight[i] and not lines[i].is_menu and (len(lines[i].chain) == depth or held[lines[i].chain[depth]] >= 0.1 * total)]
    return [i for i in inside if keeps and keeps[0] <= i <= keeps[-1]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    parser.close()
    parser.end_line()
    lines, kinds = parser.lines, parser.kinds
    weight = np.array([x.weight(kinds) for x in lines])
    if not weight.any():
        return ""
    chosen = clusters(lines, weight)
    if not chosen.any():  # links alone
        chosen = weight > 0
    inside, depth = region(lines, chosen, weight, parser.names, kinds)
    found = [lines[i] for i in inside]
    own = np.array([x.weight(kinds, depth) for x in found])
    # outside an article, a line that is mostly links and in no cluster is a menu
    article = bool(found) and any(parser.names[c] == "article" for c in found[0].chain[:depth])
    return " ".join(x.text for i, x, w in zip(inside, found, own, strict=True) if w == 1 and (article or chosen[i] or not x.is_menu))


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text and n_chars (code points) of each page."""
    prepare(pages.sparkSession)

    def make() -> Callable[[pa.RecordBatch], dict]:
        def f(b: pa.RecordBatch) -> dict:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            return {"k": b.column(0), "u": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    return map_rows(rows, f"k {rows.schema['k'].dataType.simpleString()}, u {rows.schema['u'].dataType.simpleString()}, text string, n_chars long", make).select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
