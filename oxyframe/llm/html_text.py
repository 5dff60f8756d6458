"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; no tree is built. Text between block
tags makes a line with its characters, its tags and the container it stands in.
The ratio of characters to tags per line is smoothed by a Gaussian; lines at or above
the ratio's standard deviation form the content clusters, which choose the content
region: the innermost container that holds most of the clusters' text, widened by
what stands beside it without being a list of links. Tags are features of this
choice: clusters inside an article or main element weigh more, and a region does not
end inside such an element nor, but for a main element, reach out of it. Where several
articles share the clusters, those with clusters are the regions. A page without a
cluster has no content.

Every line of a region is kept, but for those in elements that are never article
text: navigation, page headers and footers, asides, forms, scripts, notices, adverts,
reader comments and hidden ones. These count as lines without text in the ratios.
Anchors of headings, paragraphs and items, and compound names of these and of an
article's sections, are not taken for such names.

Time is linear in the page, however deep its elements are nested.

Edge cases: null html counts as empty; a page without text gives the empty string.
Unclosed, crossed and cut-off tags are taken as browsers do in the common cases.
Null and repeated ids give a row each. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 2.0
MOST = 0.8  # of the clusters' text, what a region holds
INSIDE = 3  # weight of clusters inside an article or main element
LINKS = 0.2  # share of links from which text beside a region is a list of links
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "head title script style noscript template iframe object canvas svg nav aside footer form button select textarea option fieldset dialog menu audio video map".split()
)
FIGURE = frozenset(("svg", "object"))  # text of an article's figures stays
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p span li".split())
CONTAINER = frozenset(("article", "main", "section", "div", "body", "td"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article main section div body html".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar tooltip".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|sidenav|breadcrumbs?|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|social|share|sharing|widget|alert|related|recommended|recommendations|comments?|commentlist|respond|replies|disqus|login|signup|pagination|pager|toolbar|"
    r"footer|masthead|copyright|disclaimer|skip|hidden|outbrain|taboola)(?:$|[\s_-])|^(?:site|page|main|top|global)?[_-]?header$",
    re.IGNORECASE,
)
WHOLE = re.compile(NAMES.pattern.replace(r"[\s_-]", r"\s"), re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Lines(HTMLParser):
    """Text lines of a page with what is needed to choose among them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, excluded, container
        self.open: dict[str, list[int]] = {}  # places in the stack of each open tag
        self.scopes = [0]  # places of those that others do not close
        self.parents = [-1]
        self.kinds = [""]
        self.inside = [False]  # whether a container is, or lies in, an article or main element
        self.text: list[str] = []
        self.left_out = False  # whether the line had text of excluded elements
        self.box = 0
        self.tags = 0
        self.linked = 0
        self.lines: list[tuple[str, int, bool, int, int]] = []  # text, tags, excluded, container, characters of links

    def flush(self):
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append((line, self.tags, False, self.box, min(self.linked, len(line))))
        elif self.left_out:
            self.lines.append(("", self.tags, True, self.box, 0))
        self.text.clear()
        self.left_out = False
        self.tags = self.linked = 0

    def _pop(self, k: int):
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.open[name].pop()
            if self.scopes[-1] >= len(self.stack):
                self.scopes.pop()

    def _last(self, names) -> int:
        """Place of the innermost of these tags that no scope shields, or 0."""
        k = max((self.open[n][-1] for n in names if self.open.get(n)), default=0)
        return k if k > self.scopes[-1] else 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            # A block ends an open paragraph; an item ends the item before it.
            ends = self._last(CLOSES.get(tag, ()))
            if (p := self._last(("p",))) > ends:
                self._pop(p)
            if ends:
                self._pop(ends)
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, out, box = self.stack[-1]
        if not out:
            out = tag in NEVER and not (tag in FIGURE and self.inside[box]) or tag == "header" and not self.inside[box]
            if attrs and not out:
                for name, value in attrs:
                    if name in ("class", "id"):
                        out = bool(value and tag not in ("body", "html", "article", "main") and NAMES.search(value)) and not self._slug(tag, name, value, box)
                    elif name == "role":
                        out = (value or "").lower() in ROLES
                    elif name == "hidden" or name == "aria-hidden" and value == "true":
                        out = True
                    elif name == "style":
                        out = bool(value and HIDDEN.search(value))
                    if out:
                        break
        if tag in CONTAINER or dict(attrs).get("role") == "main":
            self.parents.append(box)
            self.kinds.append("main" if dict(attrs).get("role") == "main" else tag)
            self.inside.append(self.inside[box] or self.kinds[-1] in ("article", "main"))
            box = len(self.parents) - 1
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, out, box))

    def _whole(self, end: int) -> int:
        """Markup that the page does not end reaches to the end of the page, as in browsers."""
        return len(self.rawdata) if end < 0 else end

    def parse_starttag(self, i):
        return self._whole(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._whole(super().parse_endtag(i))

    def parse_comment(self, i, report=1):
        return self._whole(super().parse_comment(i, report))

    def parse_html_declaration(self, i):
        return self._whole(super().parse_html_declaration(i))

    def parse_pi(self, i):
        return self._whole(super().parse_pi(i))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        places = self.open.get(tag)
        if places and (tag in BLOCK or places[-1] > self.scopes[-1]):
            self._pop(places[-1])

    def handle_data(self, data):
        name, out, self.box = self.stack[-1]
        if out:
            self.left_out = True
            return
        self.text.append(data)
        if name == "a":
            self.linked += len(data.strip())

    def _slug(self, tag: str, name: str, value: str, box: int) -> bool:
        """Whether a name that NAMES finds is an anchor or a compound word of the text's own elements."""
        if tag in PROSE:
            return name == "id" or not WHOLE.search(value)
        return tag == "section" and self.inside[box] and not WHOLE.search(value)


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the weights are renewed."""
    r = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    at = slice(r, r + len(ratio))
    return np.convolve(ratio, k)[at] / np.convolve(np.ones(len(ratio)), k)[at]


def _content(lines: list[tuple[str, int, bool, int, int]], sigma: float) -> np.ndarray:
    """Which lines belong to the clusters of text."""
    size = np.array([0.0 if out else len(t) for t, _, out, _, _ in lines])
    tags = np.array([n for _, n, _, _, _ in lines], float)
    ratio = smooth(size / np.maximum(1.0, tags), sigma)
    return (ratio >= ratio.std()) & (size > 0)


def regions(p: Lines, content: np.ndarray) -> list[int]:
    """Containers that hold the clusters."""
    n = len(p.parents)
    mass, whole, links = [0] * n, [0] * n, [0] * n
    for (text, _, out, box, linked), hit in zip(p.lines, content.tolist(), strict=True):
        if not out:
            mass[box] += len(text) * (INSIDE if p.inside[box] else 1) if hit else 0
            whole[box] += len(text)
            links[box] += linked
    inner: list[list[int]] = [[] for _ in range(n)]
    # Containers are numbered outside in, so each one's sum is whole before it is added to the one around it.
    for k in range(n - 1, 0, -1):
        up = p.parents[k]
        inner[up].append(k)
        mass[up] += mass[k]
        whole[up] += whole[k]
        links[up] += links[k]
    if not mass[0]:
        return []
    best = 0
    while some := [k for k in inner[best] if mass[k] >= MOST * mass[0]]:
        best = max(some, key=mass.__getitem__)
    named = ("article", "main")
    if p.inside[best]:
        while p.kinds[best] not in named:
            best = p.parents[best]
    else:
        # Several articles: the outermost ones with clusters, if these hold most of the text.
        outer = [k for k in range(n) if p.kinds[k] in named and mass[k] and not p.inside[p.parents[k]] and _within(p, k, best)]
        if sum(mass[k] for k in outer) >= MOST * mass[best]:
            return outer
    # A title or note beside the text belongs to it; a container that adds links does not.
    while (up := p.parents[best]) >= 0 and (p.inside[up] or not p.inside[best]) and links[up] - links[best] <= LINKS * (whole[up] - whole[best]):
        best = up
    return [best]


def _within(p: Lines, k: int, outer: int) -> bool:
    while k > outer:
        k = p.parents[k]
    return k == outer


def extract(html: str, sigma: float = SIGMA) -> str:
    """The main text of a page; blocks are joined by an empty line."""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    if not p.lines:
        return ""
    chosen = set(regions(p, _content(p.lines, sigma)))
    inside = [False] * len(p.parents)
    for k, up in enumerate(p.parents):
        inside[k] = k in chosen or up >= 0 and inside[up]
    return "\n\n".join(t for t, _, out, box, _ in p.lines if not out and inside[box])


def _extracted(sigma: float):
    def run(batches):
        for batch in batches:
            texts = [extract(h, sigma) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return src.mapInArrow(_extracted(sigma), "page_id long, url string, text string, n_chars long")
