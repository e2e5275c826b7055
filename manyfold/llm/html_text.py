"""Main text of web pages by text-to-tag ratios over the events of a streaming parser.

The parser turns a page into lines, one for each block. A line has its text, the number of tags in it, how much of it is
link text, and the sectioning elements around it. Parts that are something else by their element, role or class (menus,
page headers, footers, sidebars, adverts, notices, forms, comments, scripts and styles) have no text. The ratio of
characters to tags per line is smoothed by a Gaussian and split in two clusters; lines in the upper one, that are not
mostly links, are the seeds of the content. The content region is the article or main around the smallest element that
holds most of the seeds' text; without one, that element, or the one around it as long as that has text of its own or
seeds beside it. So it is around an article if the element that holds it has seeds of its own; else the articles next to
that one belong to it. The region's lines make up the result, the short ones between long paragraphs too.

A class or an id drops no element that holds the page's only articles or main, or most of the seeds where the page has
neither: such names say what a wrapper has (``has-sidebar``), not what it is.

White space in a line becomes one space; lines are joined by line feeds in page order; nothing is cut. Null and empty
html give an empty text. Broken markup is read as far as it goes: block elements end an open paragraph, and end tags
that match nothing are ignored. Every row gives a row, repeated ones too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("html body main article section div td table center blockquote".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe map menu nav noscript object "
    "option script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|masthead|site-header|page-header|topbar|cookies?|cookie-\w+|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"login|share|sharing|social|related|recommended|recommendations|comments?|comment-\w+|commentlist|disqus\w*|repl(?:y|ies)|respond|widget|toolbar|pagination|"
    r"pager|copyright|disclaimer)(?:$|[\s_-])"
    r"|(?:^|\s)(?:hidden|visually-hidden|sr-only)(?:$|\s)",
    re.IGNORECASE,
)
#: Headings and paragraphs are text of what they stand in, whatever their class says.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
KEPT = frozenset("html body main article".split())
# What may stand in a head; anything else ends it, with or without its end tag.
HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
# An open paragraph ends where one of these begins or ends.
SIGMA, LINKED, MOST = 1.0, 0.6, 0.8


def one_line(parts) -> str:
    return " ".join("".join(parts).split())


class Lines(HTMLParser):
    """Collects lines: [text, tags, link characters, section, hint, parts]. ``sections`` holds the parent of each section.

    Parts are the pieces of a line's text with the hint that each stands in; an inline element that goes leaves its line whole.

    A hint is an element that its class or id tells to drop, and is settled only when the page is known: ``hints`` holds
    of each the hint around it and whether an article or main begins in it. Hint 0 is the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, is dropped, section, hint]
        self.hints: list[list] = [[-1, False]]
        self.dropped = 0
        self.links = 0
        self.sections = [-1]
        self.names = [""]
        self.lines: list[list] = []
        self.parts: list[tuple[int, str]] = []
        self.tags = 0
        self.linked = 0
        self.count: Counter[str] = Counter()  # of open elements by name

    def flush(self) -> None:
        text = one_line(part for _, part in self.parts)
        if text:
            section, hint = self.open[-1][2:] if self.open else (0, 0)
            self.lines.append([text, self.tags, self.linked, section, hint, self.parts])
            self.tags, self.linked = 0, 0
        self.parts = []

    def unwanted(self, tag: str, attrs: list) -> bool:
        if tag in NEVER:
            return True
        if tag == "header":
            return not (self.count["article"] or self.count["main"])
        if tag in KEPT:
            return False
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.strip().lower() in ROLES:
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def hinted(self, tag: str, attrs: list) -> bool:
        return tag not in KEPT and tag != "header" and tag not in HEADINGS and any(name in ("class", "id") and HINT.search(value or "") for name, value in attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.close_head()
        elif tag not in HEAD and self.open and self.open[-1][0] == "head":
            self.pop_to(len(self.open) - 1)
        self.tags += 1
        if tag == "br":
            self.parts.append((self.open[-1][3] if self.open else 0, " "))
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            self.close_until("p", BLOCKS)
            if tag in ("li", "dt", "dd", "td", "th", "tr"):
                self.close_until(tag, {"ul", "ol", "dl", "table"} | SECTIONS)
        drop = self.unwanted(tag, attrs)
        section, hint = self.open[-1][2:] if self.open else (0, 0)
        hints = not drop and not self.dropped and self.hinted(tag, attrs)
        if tag in ("article", "main") and not drop and not self.dropped:
            self.hints[hint][1] = True
        if hints:
            self.hints.append([hint, False])
            hint = len(self.hints) - 1
        if tag in SECTIONS:
            self.sections.append(section)
            self.names.append(tag)
            section = len(self.sections) - 1
        self.dropped += drop
        self.links += tag == "a"
        self.count[tag] += 1
        self.open.append([tag, drop, section, hint])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and tag not in VOID:
            self.handle_endtag(tag)

    def close_head(self) -> None:
        if not self.count["head"]:
            return
        for k, x in enumerate(self.open):
            if x[0] == "head":
                self.pop_to(k)
                return

    def close_until(self, tag: str, walls) -> None:
        """Ends the innermost open ``tag``, if no element of ``walls`` is open within it."""
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                return
            if self.open[k][0] in walls or self.open[k][1]:
                return

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, drop, _, _ = self.open[-1]
            if tag in BLOCKS:
                self.flush()
            self.open.pop()
            self.count[tag] -= 1
            self.dropped -= drop
            self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count[tag]:
            return
        inline = tag not in BLOCKS and tag not in NEVER
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                return
            # The end of an inline element does not reach over a block.
            if inline and self.open[k][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.pop_to(len(self.open) - 1)
        if not self.dropped:
            self.parts.append((self.open[-1][3] if self.open else 0, data))
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def two_clusters(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers, by means. All equal: that number."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all():
            return cut
        new = values[~upper].mean(), values[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def seeds_of(lines: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of every line, whether it is not mostly links, and whether it is a seed."""
    sizes = np.array([len(x[0]) for x in lines], float)
    ratios = smoothed(sizes / np.array([max(1, x[1]) for x in lines]), SIGMA)
    prose = np.array([x[2] for x in lines]) < LINKED * sizes
    seeds = (ratios >= two_clusters(ratios)) & prose
    return sizes, prose, seeds if seeds.any() else prose


def below(parents: list[int], values: np.ndarray) -> np.ndarray:
    """Sums over each element and all that it holds. Parents come before children."""
    for k in range(len(values) - 1, 0, -1):
        values[parents[k]] += values[k]
    return values


def settled_lines(page: Lines) -> list[list]:
    """The lines outside of the elements that a hint drops. Their tags count for the next line that stays."""
    if len(page.hints) == 1 or not page.lines:
        return page.lines
    around = [x[0] for x in page.hints]
    articles = below(around, np.array([x[1] for x in page.hints], float))
    sizes, _, seeds = seeds_of(page.lines)
    mass = np.zeros(len(around))
    for size, x in zip(sizes * seeds, page.lines):
        for hint, part in x[5]:
            mass[hint] += size * len(part) / max(1, sum(len(p) for _, p in x[5]))
    mass = below(around, mass)
    dropped = np.zeros(len(around), bool)
    # An article or main outside of hints is the content, whatever the others hold (comments are articles too).
    outside = page.hints[0][1]
    for k in range(1, len(around)):
        whole = articles[k] > 0 if articles[0] else mass[k] >= MOST * mass[0] > 0
        dropped[k] = dropped[around[k]] or outside or not whole
        if not dropped[k] and page.hints[k][1]:
            # So is one that stands in this element itself, for the hints within it.
            outside = True
    lines, tags = [], 0
    for text, n, *rest in page.lines:
        tags += n
        if any(dropped[hint] for hint, _ in rest[3]):
            text = one_line(part for hint, part in rest[3] if not dropped[hint])
        if text:
            lines.append([text, tags, *rest])
            tags = 0
    return lines


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines = settled_lines(page)
    if not lines:
        return ""
    sizes, prose, seeds = seeds_of(lines)
    own = np.bincount([x[3] for x in lines], sizes * seeds, len(page.sections))
    text = np.bincount([x[3] for x in lines], sizes * prose, len(page.sections))
    mass = below(page.sections, own.copy())
    if not mass[0]:
        return ""
    region = max(k for k in range(len(mass)) if mass[k] >= MOST * mass[0])
    above = [region]
    while above[-1] > 0:
        above.append(page.sections[above[-1]])
    region = next((k for k in above if page.names[k] in ("article", "main")), region)
    # A paragraph's own box is not the region: its neighbours belong to it too, up to the article.
    while region and page.names[region] not in ("html", "body", "main"):
        around = page.sections[region]
        beside = [k for k in range(len(mass)) if page.sections[k] == around and k != region and mass[k]]
        if page.names[region] == "article":
            if not own[around]:
                break
        elif not text[around] and not beside:
            break
        region = around
    inside = np.zeros(len(mass), bool)
    inside[region] = True
    if page.names[region] == "article":
        inside |= [n == "article" and k == page.sections[region] for n, k in zip(page.names, page.sections)]
    for k in range(1, len(mass)):
        inside[k] |= inside[page.sections[k]]
    closed = page.names[region] in ("article", "main")
    return "\n".join(x[0] for x, p in zip(lines, prose) if inside[x[3]] and (p or closed))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    texts = pages.select("page_id", "url", text_of("html").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
