"""Operator 5: main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one for each block
element, with the characters of text and the tags seen on the line.  A line's ratio is
text characters per tag, where link text counts against the line and lines inside
elements that are never the article (menus, headers, footers, sidebars, notices,
adverts, forms, comments) have ratio zero.  The ratios are smoothed with a Gaussian and
split in two clusters; a region, that is a stretch of lines which no boilerplate line
interrupts, belongs to the content if its highest smoothed ratio reaches the upper
cluster, and then all of its lines are kept.  The mark of an article or main part is a
prior: outside of it a ratio counts ``1 / OUTSIDE``, and inside a region is also kept if
an own ratio reaches ``INSIDE`` of the border.  Inside, a region is the text that stands
directly in one division or section, whatever notices part it, or a stretch of lines that
are mostly links; a heading belongs to what it heads.

Null and empty pages give an empty text.  Character references are decoded, white space
inside a block becomes one blank, blocks are joined by one blank in page order, and
nothing is capped.  A tag cut off by the page's end is no text.  Repeated rows and
further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchscope.llm.common import arrow_map, text_of

BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as the page's text.
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas select option textarea button datalist audio video".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav footer aside form menu dialog fieldset".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|form|search|share\w*|social|related|recommend\w*|widget|comments?|replies|reply|respond|disqus|pagination|pager|toolbar|skip|copyright|legal)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What a marked part's mark is worth, see above.
OUTSIDE, INSIDE = 4, 0.5
_BOXES = frozenset("article main div section details figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/][^<>]*|!-?|!--(?:(?!-->).)*|!(?:[a-zA-Z][^<>]*)?)\Z", re.S)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WITHIN = frozenset("ul ol dl table select menu".split())


class Lines(HTMLParser):
    """Lines of a page: text, tags, link characters, whether boilerplate, whether in an article, division, heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool, int, str]] = []
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # element, hidden, around, article, division
        self.boxes = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False

    @property
    def state(self) -> tuple[bool, bool, bool]:
        return self.stack[-1][1:4] if self.stack else (False, False, False)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        hidden, around, article = self.state
        if text and not hidden:
            box = self.stack[-1][4] if self.stack else 0
            heading = next((e[0] for e in reversed(self.stack) if e[0] in BLOCKS), "")
            self.lines.append((text, max(1, self.tags), self.linked, around, article, box, heading if heading in _HEADINGS else ""))
        elif around and not hidden and not (self.lines and self.lines[-1][0] == "" and self.lines[-1][3]):
            self.lines.append(("", 1, 0, True, article, 0, ""))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.in_link = True
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1) if tag in _CLOSES else ():
            if self.stack[i][0] in _CLOSES[tag]:
                del self.stack[i:]
                break
            if self.stack[i][0] in _WITHIN:
                break
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        hidden, around, article = self.state
        got = dict(attrs)
        names = f"{got.get('class') or ''} {got.get('id') or ''}"
        hidden = hidden or tag in HIDDEN or "hidden" in got or "display:none" in (got.get("style") or "").replace(" ", "").lower() or (got.get("aria-hidden") or "").lower() == "true"
        if tag not in ("html", "body", "article", "main", "p", "b", "i", "em", "strong", "span"):
            around = around or tag in AROUND or bool(_NAMES.search(names)) or (got.get("role") or "").lower() in _ROLES or (tag == "header" and not article)
        elif tag in ("article", "span", "p") and _NAMES.search(names):
            around = True
        box = self.stack[-1][4] if self.stack else 0
        if tag in _BOXES:
            self.boxes = box = self.boxes + 1
        self.stack.append((tag, hidden, around, article or (tag in ("article", "main") and not around), box))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.in_link = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, weights renewed at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = lambda v: np.convolve(v, kernel)[reach : reach + len(v)]
    return whole(x) / whole(np.ones(len(x)))


def threshold(x: np.ndarray) -> float:
    """The border between the two clusters of values (two-means in one dimension)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        border = (low + high) / 2
        under, over = x[x <= border], x[x > border]
        if not len(under) or not len(over):
            break
        if (low, high) == (new := (float(under.mean()), float(over.mean()))):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.end_line()
    lines = parser.lines
    marked = any(article and not around for _, _, _, around, article, _, _ in lines)
    plain = [not around for _, _, _, around, _, _, _ in lines]
    if not any(plain):
        return ""
    ratio = np.array([max(0, len(t) - 2 * linked) / tags / (1 if article or not marked else OUTSIDE) if ok else 0.0 for (t, tags, linked, _, article, _, _), ok in zip(lines, plain, strict=True)])
    level = smooth(ratio, sigma)
    border = min(threshold(np.concatenate([[0.0], level])), float(level[np.array(plain)].max()))
    keep: set[int] = set()
    for inside, r in regions(lines, plain):
        if level[r].max() >= border or (inside and ratio[r].max() >= INSIDE * border):
            keep.update(r)
    return " ".join(lines[i][0] for i in sorted(keep))


def regions(lines: list[tuple], plain: list[bool]) -> list[tuple[bool, list[int]]]:
    """(whether in a marked part, lines) of every region."""
    keys: dict[int, tuple] = {}
    stretch = links = 0
    for i, (text, _, linked, _, article, box, _) in enumerate(lines):
        if not plain[i]:
            stretch += 1
        elif not article:
            keys[i] = (False, stretch, 0)
        else:
            stretch += 1
            linking = 2 * linked >= len(text)
            links += not linking
            keys[i] = (True, box, links if linking else -1)
    # a heading belongs to the next line of its part, the title to the next text
    after = text_after = None
    for i in sorted(keys, reverse=True):
        inside, heading = keys[i][0], lines[i][6]
        if not inside:
            after = text_after = None
            continue
        if heading:
            keys[i] = (text_after if heading == "h1" else after) or keys[i]
        after = keys[i]
        if keys[i][2] < 0:
            text_after = keys[i]
    found: dict[tuple, list[int]] = {}
    for i, key in keys.items():
        found.setdefault(key, []).append(i)
    return [(key[0], r) for key, r in found.items()]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in b.column("_h").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return f

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(pages.select("page_id", "url", text_of("html").alias("_h")), make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
