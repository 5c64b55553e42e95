"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block. Lines in menus, headers, footers, sidebars, notices,
adverts, forms and comment sections (told by element, role, class or id) are set apart, and so
is what lies outside the article where a page names one (``article``, ``main`` or an equivalent
role). Each line left weighs its length outside short links. The weights are summed over
sliding windows of lines; the text starts where the sum surges and ends where it dives to
zero, and every line between the two stays, linked ones too. Lists of links at the edges of
an article weigh nothing, so they fall outside. The surge has to pass SURGE characters, or any
at all inside a named article. A line shorter than that stays if its container holds text.

Defined cases: null or empty html gives the empty text and 0; a page without any surge is all
the text it has; markup without an end is closed by the end of the page; repeated rows give
repeated rows. Time is linear in the page, however its elements nest.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import map_pieces

WINDOW = 3
SURGE = 80
#: Links longer than this on average are sentences, not marks.
LINK = 40
# fixed values: element names, as the HTML standard groups them, and common class and id words
SILENT = frozenset("script style noscript template svg math head iframe object canvas audio video select option datalist textarea button".split())
RAW = frozenset("script style textarea title iframe noscript template svg".split())
BESIDE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text belongs together; body is none, as everything is in it.
CONTAINERS = frozenset("article div section main td blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset(["html", "body", "tr", "tbody", "thead", "tfoot", "caption"])
NAMED = re.compile(r"(?<!no-)(?<!no_)(?<!has-)(?<!with-)(?<![^\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|header|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|discussion|replies|disqus|related|recommended|share|sharing|social|toolbar|widget|pagination|pager|skip)(?:$|[\s_-])", re.I)
#: Words that may stand beside those of NAMED in a class that sets something apart inside an article.
NEUTRAL = frozenset("area article articles bar block body bottom box btn button buttons center class col container content global group header icons inline inner item items left link links list main module outer page panel post posts primary right row section site slot small tools top unit user users wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_ARTICLE = re.compile(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody", re.I)
_END_RAW = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    """A block of text: its characters in links, how many links, whether set apart, in the article, and its container."""

    text: str
    linked: int
    links: int
    beside: bool
    inside: bool
    container: int


def _named(value: str, article: bool) -> bool:
    """Whether a class or id names something beside the text; inside an article, only if all its words do."""
    if not NAMED.search(value):
        return False
    return not article or any(NAMED.search(c) and all(w in NEUTRAL or w.isdigit() or NAMED.fullmatch(w) for w in re.split(r"[_-]+", c.lower()) if w) for c in value.split())


def _set_apart(name: str, attributes: str, article: bool) -> bool:
    if name in BESIDE:
        return True
    if not attributes or name in ("body", "html", "article", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _named(value, article) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class _Stack:
    """Open elements, with counts and the places of blocks and lists, so that no step has to scan them."""

    def __init__(self) -> None:
        self.rows: list[Line] = []
        self.buffer: list[str] = []
        self.linked = self.anchors = 0
        self.open: list[tuple[str, bool, bool, bool, int]] = []  # name, set apart, silent, article, number
        self.names: Counter[str] = Counter()
        self.blocks: list[int] = []
        self.lists: list[int] = []
        self.containers: list[int] = []
        self.number = self.apart = self.silent = self.article = self.headings = 0

    def end_line(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", unescape("".join(self.buffer))).strip()
            if text:
                linked = 0 if self.headings else min(self.linked, len(text))
                self.rows.append(Line(text, linked, self.anchors, self.apart > 0, self.article > 0, self.containers[-1] if self.containers else 0))
            self.buffer, self.linked, self.anchors = [], 0, 0

    def push(self, name: str, apart: bool, silent: bool, article: bool) -> None:
        self.number += 1
        at = len(self.open)
        self.open.append((name, apart, silent, article, self.number))
        self.names[name] += 1
        if name in BLOCKS:
            self.blocks.append(at)
        if name in ("li", "ul", "ol", "menu"):
            self.lists.append(at)
        if name in CONTAINERS:
            self.containers.append(self.number)
        self.apart, self.silent, self.article, self.headings = self.apart + apart, self.silent + silent, self.article + article, self.headings + (name in HEADINGS)

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            if self.open[-1][0] in BLOCKS:
                self.end_line()
            name, apart, silent, article, _ = self.open.pop()
            self.names[name] -= 1
            for places in (self.blocks, self.lists):
                if places and places[-1] == len(self.open):
                    places.pop()
            if name in CONTAINERS:
                self.containers.pop()
            self.apart, self.silent, self.article, self.headings = self.apart - apart, self.silent - silent, self.article - article, self.headings - (name in HEADINGS)

    def close(self, name: str) -> bool:
        """Ends the innermost element of that name, if one is open; each step back takes an element off for good."""
        if not self.names[name]:
            return False
        k = len(self.open) - 1
        while self.open[k][0] != name:
            k -= 1
        self.pop_to(k)
        return True


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in order."""
    out = _Stack()
    at = 0
    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at and not out.silent:
            piece = html[at : m.start()]
            out.buffer.append(piece)
            if out.names["a"]:
                out.linked += len(piece)
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in ("br", "td", "th"):
            out.buffer.append(" ")
        if m[1]:
            if not out.close(name) and name in BLOCKS:
                out.end_line()
            continue
        if name in CLOSES_P:  # a block ends an open paragraph, with what is open inside it
            if out.blocks and out.open[out.blocks[-1]][0] == "p":
                out.pop_to(out.blocks[-1])
            if name == "li" and out.lists and out.open[out.lists[-1]][0] == "li":
                out.pop_to(out.lists[-1])
        if name in BLOCKS:
            out.end_line()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            end = _END_RAW[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "body":  # whatever the head left open ends here
            out.close("head")
        # a header inside the article holds its title, and stays
        apart = not (name == "header" and out.article) and _set_apart(name, m[3], out.article > 0)
        out.push(name, apart, name in SILENT, name in ("article", "main") or bool(_ARTICLE.search(m[3])))
        out.anchors += name == "a"
    if at < len(html) and not out.silent:
        out.buffer.append(html[at:])
    out.end_line()
    return out.rows


def weight(line: Line) -> int:
    """Characters of a line outside its links, or all where its links are as long as sentences."""
    return len(line.text) if line.linked > LINK * max(1, line.links) else len(line.text) - line.linked if 2 * line.linked <= len(line.text) else 0


def surges(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """First and last line of each stretch from where the sum over the next lines passes ``surge`` to where it is zero."""
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    out, k = [], 0
    while k < len(weights):
        if sums[k] <= surge:
            k += 1
            continue
        dive = k
        while dive < len(weights) and sums[dive]:
            dive += 1
        weighing = [j for j in range(k, dive) if weights[j]]
        out.append((weighing[0], weighing[-1]))
        k = dive
    return out


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page, one line per block."""
    lines = [x for x in lines_of(html) if not x.beside]
    named = any(x.inside for x in lines)
    if named:
        lines = [x for x in lines if x.inside]
    weights = [weight(x) for x in lines]
    keep = [False] * len(lines)
    for first, last in surges(weights, window, 0 if named else surge):
        keep[first : last + 1] = [True] * (last + 1 - first)
    holders = {x.container for x, kept in zip(lines, keep, strict=True) if kept} - {0}
    if any(keep):
        keep = [kept or w > 0 and x.container in holders for x, w, kept in zip(lines, weights, keep, strict=True)]
    else:  # no surge anywhere: a short page is all the text it has
        keep = [w > 0 for w in weights]
    return "\n".join(x.text for x, kept in zip(lines, keep, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), one row per row of ``pages``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return map_pieces(chosen, run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long", "html")
