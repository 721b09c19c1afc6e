"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser delivers tag and text events. Block tags cut the page into lines; a line's ratio is its
number of characters over its number of tags. Elements that never hold main text (menus, forms, scripts, adverts, comments ...)
become lines of ratio zero, so they part the page. The ratios are smoothed with a Gaussian, and a threshold (their standard
deviation, at most half the peak) clusters the lines: a run of lines between such elements is a content region when its
smoothed ratio reaches the threshold somewhere. Regions inside ``article`` or ``main`` win over others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Names of HTML elements and of class or id words that mark what is not main text.
HIDDEN = frozenset("head title script style template noscript svg math iframe object canvas audio video map".split())
ASIDE = frozenset("nav footer aside form button select textarea datalist menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BODY = frozenset("article main".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices "
    "popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer header masthead toolbar "
    "comment comments disqus replies reply respond share sharing social related recommended newsletter subscribe login signup search pagination pager".split()
)
_WORD = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """Lines of a page: text, tags, and whether inside the article; text None parts regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str | None, int, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, starts an excluded part, starts an article
        self.out = self.inside = self.tags = 0
        self.text: list[str] = []

    def cut(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text.clear()
        if words:
            self.lines.append((words, self.tags, self.inside > 0))
            self.tags = 0

    def part(self) -> None:
        self.cut()
        self.lines.append((None, 1, False))
        self.tags = 0

    def excluded(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in HIDDEN or tag in ASIDE or tag == "header" and not self.inside:
            return True
        if tag in ("html", "body") or tag in BODY:
            return False
        return any(k == "hidden" or k in ("class", "id", "role") and v and not MARKS.isdisjoint(_WORD.findall(v.lower())) for k, v in attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BODY and self.out and not any(x[2] for x in self.open):
            while self.out:  # a menu or form that was never closed ends where the article begins
                self.close_one()
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.out:
                self.text.append(" ")
            elif tag == "hr":
                self.cut()
            return
        out, body = self.excluded(tag, attrs), tag in BODY
        if out and not self.out:
            self.part()
        elif tag not in INLINE and not self.out:
            self.cut()
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.close_one()
        self.open.append((tag, out, body))
        self.out += out
        self.inside += body

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_one(self) -> None:
        tag, out, body = self.open.pop()
        if not self.out and tag not in INLINE:
            self.cut()
        self.out -= out
        self.inside -= body
        if body:
            self.part()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is None:
            if tag not in INLINE and not self.out:
                self.cut()
            return
        if tag in INLINE and any(x[0] not in INLINE for x in self.open[depth:]):
            return  # an inline end tag does not close blocks
        while len(self.open) > depth:
            self.close_one()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over three standard deviations each side; the ends are weighted by what is there."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = lambda x: np.convolve(x, kernel, "full")[reach : reach + len(x)]
    return over(ratios) / over(np.ones(len(ratios)))


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of a page: white space in a block is one space, blocks are joined by one space; empty if there is none."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.cut()
    if not page.lines:
        return ""
    ratios = np.array([0.0 if text is None else len(text) / max(1, tags) for text, tags, _ in page.lines])
    level = smoothed(ratios, sigma)
    least = min(float(ratios.std()), float(level.max()) / 2)
    regions: list[tuple[bool, bool, list[str]]] = []
    start = 0
    while start < len(page.lines):
        if page.lines[start][0] is None:
            start += 1
            continue
        end = start
        while end < len(page.lines) and page.lines[end][0] is not None and page.lines[end][2] == page.lines[start][2]:
            end += 1
        regions.append((bool(level[start:end].max() >= least), page.lines[start][2], [x[0] for x in page.lines[start:end]]))
        start = end
    inside = any(body for _, body, _ in regions)
    # within an article an advert or form may part the text: its regions stand together
    chosen = [lines for hot, body, lines in regions if (body if inside else hot)]
    return " ".join(" ".join(x) for x in chosen)


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A page of any length is read whole, by one task. A null or empty html gives an empty text and 0; ids and addresses, null or
    repeated, pass through, one row each; other columns are ignored; an empty table gives an empty table.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(x, sigma) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.select(pages["page_id"].cast("string").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    out = rows.mapInPandas(extract, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", out["page_id"].cast(pages.schema["page_id"].dataType))
