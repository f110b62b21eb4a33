"""Main text of HTML pages: streaming parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clusters.

``html.parser`` events cut a page into lines, one for each block of running text. A line's ratio is its text outside links
against the tags it holds. Smoothed ratios are split by a threshold into content and boilerplate, and the content lines
select regions: the whole of a region (the nearest article, main, section or div around a line) that holds one is
taken, so that a short paragraph between long ones stays. Elements for navigation, header, footer, asides, scripts and styles
and hidden ones are never text. All else is weighed, not gated: smoothed ratios count more inside article and main, and
little inside forms and elements whose class, id or role says notice, advert, sidebar or reader comments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import ship

# Element names of HTML.
SKIPPED = frozenset("script style template noscript head title svg math canvas object iframe select textarea button datalist option audio video map".split())
CHROME = frozenset("nav footer aside dialog menu".split())
# Elements that may stand in a head; any other one ends it.
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
REGIONS = frozenset("article main section div body td table".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that a start tag closes when they are still open (the end tag may be left out).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div footer form header main nav section table ul ol dl td th".split())
#: Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments comments-area consent cookie cookies copyright disqus "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice overlay pagination paywall popup promo promoted promotion "
    "related search share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
ARTICLE_MARKS = frozenset("comment sidebar promo ad advert teaser".split())
NEVER_MARKED = frozenset("html body main".split())
#: What a smoothed ratio counts inside an article or main element, and inside a marked one.
INSIDE, MARKED = 1.5, 0.1
_WORD = re.compile(r"[A-Za-z]+")


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, region, chrome, in article, marked) lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool, bool, bool]] = []  # name, region, skipped, chrome, in article, marked
        self.lines: list[tuple[str, int, int, int, bool, bool, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.regions = self.links = 0

    def _state(self) -> tuple[str, int, bool, bool, bool, bool]:
        return self.open[-1] if self.open else ("", 0, False, False, False, False)

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, region, _, chrome, inside, marked = self._state()
            self.lines.append((text, self.tags, self.linked, region, chrome, inside, marked))
            self.tags = self.linked = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._close({"head"})
        if tag in BLOCKS:
            self._close({"button", "select"})  # they hold no blocks: their end tags are missing
            self._cut()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if ends := CLOSES.get(tag):
            self._close(ends)
        elif tag in BLOCKS and tag not in ("html", "body"):
            self._close({"p"})
        _, region, skipped, chrome, inside, marked = self._state()
        skipped = skipped or tag in SKIPPED
        chrome = chrome or tag in CHROME or tag == "header" and not inside or any(self._hidden(k, v) for k, v in attrs)
        own = tag == "form" or tag not in NEVER_MARKED and any(self._marks(tag, k, v, inside) for k, v in attrs if v)
        if tag in REGIONS or own:
            self.regions += 1
            region = self.regions
        marked = marked or own
        inside = inside or tag in ("article", "main") and not chrome and not marked
        self.links += tag == "a"
        self.open.append((tag, region, skipped, chrome, inside, marked))

    @staticmethod
    def _hidden(name: str, value: str | None) -> bool:
        return name == "hidden" and value != "until-found" or name == "aria-hidden" and value not in (None, "", "false")

    @staticmethod
    def _marks(tag: str, name: str, value: str, inside: bool) -> bool:
        if name not in ("class", "id", "role", "itemtype") or tag in HEADINGS:
            return False
        # A page's own article may well be called like some marks; one inside it is a comment or a teaser.
        marks = ARTICLE_MARKS if tag == "article" and not inside else MARKS
        for token in value.split():
            words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))
            if token.lower() in marks or words and all(w.lower() in marks for w in words):  # has-sidebar isn't a sidebar
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, names: set[str]) -> None:
        """Close an open element of these names, unless an enclosing container is in between."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in names:
                self._drop(i)
                return
            if name in SCOPE:
                return

    def _drop(self, i: int) -> None:
        self.links -= sum(x[0] == "a" for x in self.open[i:])
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._cut()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._drop(i)
                return
            if tag not in SCOPE and self.open[i][0] in SCOPE:
                return

    def handle_data(self, data: str) -> None:
        if self._state()[2]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._cut()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over lines; at the ends the kernel is cut and scaled up."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratios) == 0:
        return ratios
    over = np.convolve(ratios, kernel)[reach:-reach]
    return over / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def main_text(html: str | None, *, sigma: float = 1.0, level: float = 0.5) -> str:
    """The selected lines joined by line ends; empty for a null, empty or textless page."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    usable = [i for i, x in enumerate(lines) if not x[4]]
    if not usable:
        return ""
    ratios = np.array([max(0, len(x[0]) - x[2]) / (x[1] + 1) if not x[4] else 0.0 for x in lines])
    weights = np.array([(INSIDE if x[5] else 1.0) * (MARKED if x[6] else 1.0) for x in lines])
    height = smoothed(ratios, sigma) * weights
    spread = float(height.std())
    threshold = min(level * spread, float(height[usable].max())) if spread else 0.0
    chosen = {lines[i][3] for i in usable if height[i] >= threshold and ratios[i] > 0}
    return "\n".join(lines[i][0] for i in usable if lines[i][3] in chosen and (ratios[i] > 0 or height[i] >= threshold))


def extract(df: DataFrame, *, html: str = "html", out: str = "text", **options: float) -> DataFrame:
    """Add ``out``, the main text, and ``n_chars``, its code points, to all rows of ``df``; columns of these names are replaced.

    The whole of each page is parsed. A null or empty page and one without text give an empty text with 0 characters; repeated
    rows give equal results and an empty table gives an empty table.
    """
    ship(df.sparkSession)
    df = df.drop(*{out, "n_chars"} - {html})

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(x, **options) for x in batch], dtype="object")

    return df.withColumn(out, text(F.col(html).cast("string"))).withColumn("n_chars", F.length(out).cast("long"))
