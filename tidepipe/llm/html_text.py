"""Main text of web pages by the text-to-tag ratio of their lines.

The standard library's parser streams events; block elements cut them into
lines, each with its characters and tags. The ratios of characters to tags,
smoothed by a Gaussian, are clustered by a threshold into content and rest, and
the content lines pick the region: the innermost container that holds three
fifths of their text, and what stands around it as long as that is mostly
content too. All lines of the region are the text, short ones and links as well.
A container that is mostly rest is no region: of it only the content lines are
taken. Element names, roles and classes only support: lines inside parts that
are no article by them are left out of the text, and a region may grow to the
article element around it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = set("aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object option script select style svg template textarea title video".split())
DROPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
HOLDERS = set("article main".split())
#: Elements that can hold a region; the others are parts of one.
REGIONS = set("article body center details div fieldset html main section".split())
#: Items that an element of the same name ends.
ITEMS = set("li dt dd tr td th".split())
#: Words of a class or id that mark what is not the article, wherever they stand in the name.
DROPPED_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter pagination paywall popup sidebar sponsored toolbar".split()
)
#: Words that mark it where they end the name, or where only words of LAYOUT_NAMES stand beside them.
DROPPED_ENDS = set("banner comment disclaimer notice notices notification overlay promo promotion recommended related replies reply respond share sharing signup social sponsor subscribe subscription teaser widget widgets".split())
LAYOUT_NAMES = set("area bar block body box buttons card container content group icons inner item items label layer left link links list main outer page panel posts right row section site text title top wrap wrapper".split())
#: Words that make such a name one of the whole layout: "has-sidebar", "no-ads".
LAYOUT_WORDS = set("has no with without".split())
WORD = re.compile(r"[a-z]+", re.ASCII)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA, RADIUS = 1.0, 2
#: Share of the content's text that picks the region, share of a region's text that is content, and share of a line's text that makes it a link.
HELD, MOSTLY, LINKED = 0.6, 0.5, 0.8
#: Share of the content's text that must lie outside the region for it to grow to the whole body.
SPREAD = 0.25


def unwanted_name(name: str) -> bool:
    """Whether a class or an id says that its element is not the article."""
    words = WORD.findall(CAMEL.sub("-", name).lower())
    if not words or not LAYOUT_WORDS.isdisjoint(words):
        return False
    ends = [w for w in words if w in DROPPED_ENDS]
    return not DROPPED_WORDS.isdisjoint(words) or words[-1] in DROPPED_ENDS or bool(ends) and all(w in DROPPED_ENDS or w in LAYOUT_NAMES for w in words)


class Lines(HTMLParser):
    """Collects the lines of a page in ``text``, ``tags``, ``container``, ``dropped``, ``links`` (characters), ``heading``.

    Containers are numbered as they open, so a container's number is above that
    of the one around it (``around``). Every event takes constant time on average,
    however deep the elements are nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []  # text, tags, container, dropped, link characters
        self.around, self.names, self.holder = [0], ["html"], [False]  # of each container; 0 is the page
        self.open: list[tuple[str, bool, int]] = []  # element, dropped, container
        self.at: dict[str, list[int]] = defaultdict(list)  # element -> its places in open
        self.blocks: list[int] = []  # places in open of blocks
        self.fences: list[int] = []  # places in open of articles
        self.parts: list[str] = []
        self.tags, self.links = 1, 0
        self.lang: str | None = None  # that the page declares

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, dropped, container = self.open[-1] if self.open else ("", False, 0)
            self.lines.append((text, self.tags, container, dropped, self.links))
        self.parts, self.tags, self.links = [], 1, 0

    def shut(self, place: int) -> None:
        """Closes the elements from ``place`` on."""
        if any(e in BLOCKS or d for e, d, _ in self.open[place:]):
            self.cut()
        while len(self.open) > place:
            element = self.open.pop()[0]
            self.at[element].pop()
            for places in (self.blocks, self.fences):
                if places and places[-1] == len(self.open):
                    places.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and self.blocks:
            last = self.open[self.blocks[-1]][0]
            if last == "p" or (last == tag and tag in ITEMS):  # a block ends an open paragraph
                self.shut(self.blocks[-1])
        self.tags += 1
        if tag == "html" and self.lang is None:
            self.lang = dict(attrs).get("lang")
        if tag in VOID:
            if tag in BLOCKS:
                self.cut()
            elif tag == "br":
                self.parts.append(" ")
            return
        _, inside, container = self.open[-1] if self.open else ("", False, 0)
        drop = inside or self.dropped(tag, dict(attrs))
        if tag in BLOCKS or drop != inside:
            self.cut()
        place = len(self.open)
        if tag in BLOCKS:
            self.blocks.append(place)
            if tag != "p":
                holder = tag in HOLDERS or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs
                self.around.append(container)
                self.names.append(tag)
                self.holder.append(holder)
                container = len(self.around) - 1
        if tag in HOLDERS:
            self.fences.append(place)
        self.at[tag].append(place)
        self.open.append((tag, drop, container))

    def dropped(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in DROPPED or (attrs.get("role") or "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if tag == "header":  # a page's header; an article's own holds its title
            return not self.fences
        names = [*(attrs.get("class") or "").split(), attrs.get("id") or ""]
        if tag in ("html", "body", *HOLDERS) and not any("comment" in n.lower() for n in names):
            return False
        return any(map(unwanted_name, names))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if not self.at[tag]:
            return
        place = self.at[tag][-1]
        if self.fences and place < self.fences[-1]:
            return  # a stray end tag does not reach out of an article
        if tag not in BLOCKS and self.open[-1][1] and place < len(self.open) - 1:
            return
        self.shut(place)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known name: a bogus comment up to the next ">"
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.at["a"] and self.at["a"][-1] >= len(self.open) - 3:
            self.links += len(data.strip())


def smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(np.pad(values, RADIUS, mode="edge"), kernel / kernel.sum(), mode="valid")


def clusters(ratio: np.ndarray) -> np.ndarray:
    """Whether each line is content: its smoothed ratio reaches the standard deviation of all."""
    even = smooth(ratio)
    content = (even >= even.std()) & (ratio > 0)
    return content if content.any() else ratio >= max(float(ratio.std()), 1e-9)


def gathered(page: Lines, mass: np.ndarray) -> np.ndarray:
    """The sum of the lines' ``mass`` in each container, those inside it included."""
    total = np.bincount([line[2] for line in page.lines], weights=mass, minlength=len(page.around)).tolist()
    for n in range(len(total) - 1, 0, -1):  # what is inside has the higher number
        total[page.around[n]] += total[n]
    return np.array(total)


def read(html: str | None) -> Lines:
    page = Lines()
    page.feed(html or "")
    page.close()
    page.cut()
    return page


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty for null, for empty pages and for pages of boilerplate only."""
    return text_of(read(html))


def text_of(page: Lines) -> str:
    lines = page.lines
    ratio = np.array([0.0 if drop else len(text) / tags for text, tags, _, drop, _ in lines])
    if not ratio.any():
        return ""
    content = clusters(ratio)
    length = np.array([len(line[0]) for line in lines]) * (ratio > 0.0)
    own = np.maximum(length - [line[4] for line in lines], 0)  # text that is no link
    mass = np.where(content, np.maximum(own, 0.01 * length), 0.0)
    if not mass.any():
        return ""
    weight = gathered(page, mass)
    size = np.maximum(gathered(page, length), 1.0)
    share = gathered(page, np.where(content, length, 0.0)) / size
    linked = gathered(page, np.where(own < (1 - LINKED) * length, 1.0, 0.0))

    root = int(np.flatnonzero(weight >= HELD * mass.sum())[-1])  # these are one in the other: the innermost
    outside = [*ancestors(page, root)]
    article = next((n for n in outside if page.holder[n]), None)
    while root not in (0, article):
        around = page.around[root]
        if share[around] < MOSTLY:
            break
        small = page.names[around] in ("html", "body") and weight[root] > (1 - SPREAD) * weight[around]
        if article is None and page.names[root] in REGIONS and (small or linked[around] > linked[root]):
            break
        root = around
    roots = {root}
    if article is not None:  # articles beside it that are mostly content are the page's text as well
        plain = gathered(page, np.where(content, own, 0.0)) / size
        roots |= {n for n in range(len(page.holder)) if page.holder[n] and n not in outside and plain[n] >= MOSTLY}

    taken = [False] * len(page.around)
    for n in range(len(taken)):  # what is around has the lower number
        taken[n] = n in roots or n > 0 and taken[page.around[n]]
    whole = share[root] >= MOSTLY
    return "\n".join(line[0] for line, good in zip(lines, content, strict=True) if taken[line[2]] and not line[3] and (whole or good))


def ancestors(page: Lines, n: int) -> Iterator[int]:
    """``n``, the container around it, and so on up to the page."""
    while n:
        yield n
        n = page.around[n]
    yield 0


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, markup_lang`` for every row, from the whole html.

    ``markup_lang`` is the language that the html element declares, if any. Null and empty html give an empty text. Null ids and urls stay. Repeated rows
    give equal rows. Broken html is read as far as its events go, elements may be
    nested to any depth; an empty table gives an empty result. Extra columns are
    ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(text_of(page), page.lang) for page in (read(h.as_py()) for h in batch["html"])]
            texts = [text for text, _ in found]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([lang for _, lang in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "markup_lang"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(extract, "page_id long, url string, text string, n_chars long, markup_lang string")
