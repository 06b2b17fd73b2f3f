"""Main text of raw web pages by text-to-tag ratio over parser events.

The standard library's streaming parser feeds a small stack of open elements. Scripts,
styles, hidden elements and the like are passed over as they come. Menus, headers,
footers, asides, forms, and elements whose class, id or role names an advert, a notice, a
sidebar, comments and so on are marked. A name counts by the parts of a whole class
token; tokens that speak of an element's layout or state (``has-sidebar``,
``header-fixed``, ``share-page``) name nothing. A marked element goes, unless it is a
wrapper: it holds ``main`` or ``article`` and at least half of the text that no other
marked element takes away. All other text falls into blocks, the lines of the page.

Each block has a text-to-tag ratio: its characters outside links over its tags. Ratios
are smoothed with a Gaussian over neighbouring blocks, so that a short paragraph among
long ones counts with them. Blocks above a threshold between the smallest and the median
logarithm of smoothed ratios cluster as content, so no single long block moves it. The
content region is an ``article`` or ``main`` element that holds most of the content, or
else the innermost element that holds all of it, widened to the headings and paragraphs
beside it below ``body``; every block of the region is text. Nothing is cut or dropped
for its length.

Elements are numbered as they open and a subtree is a range of blocks, so the work is
linear in the page, however deep its markup. Null and empty pages give an empty text.
Malformed markup is read as far as the parser can: unclosed elements end with their
parents. Rows that repeat an id stay separate. An empty table gives an empty result;
columns other than the three read are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import chunks

#: Never text, and no break in the line around them.
SKIPPED = set(
    "script style noscript template button select option textarea iframe object svg canvas audio video"
    " map datalist".split()
)
#: Never text, and a block of their own.
SKIPPED_BLOCKS = {"head", "title"}
#: Marked by their tag.
MARKED = set("nav footer aside form dialog menu header".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label"
    " mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
REGIONS = {"article", "main"}
#: An open element that the start of one of the given elements ends.
CLOSES = {
    "p": set(
        "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header"
        " hr main nav ol p pre section table ul".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
#: Parts of class, id or role tokens that mark a subtree as no article text.
COMMENTS = set("comment comments discussion disqus replies reply respond".split())
BOILERPLATE = COMMENTS | set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha"
    " complementary consent contentinfo cookie cookies copyright footer gdpr header login masthead menu"
    " modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup"
    " promo promotion recommended related search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription toolbar widget widgets alert alertdialog dialog".split()
)
#: Of these, parts that mark an ``article`` or ``main`` element.
REGION_BOILERPLATE = COMMENTS | {"related", "promo", "sponsored", "ad"}
#: Parts that make a token speak of the element's layout or state.
MODIFIERS = set("has have no not with without is are hide show js".split())
STATES = set(
    "page layout template theme fixed sticky open opened closed enabled disabled visible active on off".split()
)
#: Parts that make a header the article's own.
OWN_HEADER = set("article post entry story content section title".split())
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[-_]+")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SIGMA = 1.0


@lru_cache(maxsize=65_536)
def named(token: str) -> frozenset[str]:
    """The parts of a class, id or role token that name boilerplate."""
    parts = [p for p in PARTS.split(token.lower()) if p]
    if not parts or parts[-1] in STATES or not MODIFIERS.isdisjoint(parts):
        return frozenset()
    found = BOILERPLATE.intersection(parts)
    return frozenset(found if OWN_HEADER.isdisjoint(parts) else found - {"header"})


class Blocks(HTMLParser):
    """Blocks of text and the tree of elements around them, from parser events.

    Element ``e`` holds the blocks from ``first[e]`` to before ``last[e]``; element 0 is
    the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kinds, self.parents = [""], [-1]
        self.first, self.last = [0], [0]
        self.marks: dict[int, bool] = {}  # marked elements; true if they may be wrappers
        self.stack: list[tuple[str, int, bool]] = []  # tag, element, passed over
        self.solid: list[int] = []  # places on the stack of elements that break lines
        self.places: dict[str, list[int]] = defaultdict(list)  # of open tags on the stack
        self.skipping = 0
        self.regions = 0
        self.links = 0
        self.texts: list[str] = []
        self.ratios: list[float] = []
        self.holders: list[int] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def flush(self) -> None:
        if self.skipping:
            return
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.texts.append(text)
            self.ratios.append(max(len(text) - self.linked, 0) / (self.tags + 1))
            self.holders.append(self.stack[self.solid[-1]][1] if self.solid else 0)
        self.parts, self.tags, self.linked = [], 0, 0

    def verdict(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        """Whether an element is passed over, is marked, and may be a wrapper if marked."""
        if tag in SKIPPED or tag in SKIPPED_BLOCKS:
            return True, False, False
        if tag in ("html", "body"):
            return False, False, False
        found: set[str] = set()
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, False, False
            if not value:
                continue
            if name == "style" and CONCEALED.search(value):
                return True, False, False
            if name == "class" or (name in ("id", "role") and tag not in REGIONS):
                for token in value.split():
                    found |= named(token)
        if tag in REGIONS:
            found &= REGION_BOILERPLATE
        if self.regions:
            found.discard("header")
        marked = bool(found) or (tag in MARKED and not (tag == "header" and self.regions))
        if marked and tag in INLINE:
            return True, False, False
        return False, marked, COMMENTS.isdisjoint(found)

    def pop(self) -> None:
        tag, element, skip = self.stack[-1]
        if tag not in INLINE and tag not in SKIPPED:
            self.flush()
        self.stack.pop()
        self.places[tag].pop()
        self.skipping -= skip
        if tag not in INLINE:
            self.solid.pop()
        self.last[element] = len(self.texts)
        self.links -= tag == "a"
        self.regions -= tag in REGIONS

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            pass
        elif tag not in INLINE:
            # formatting elements that were left open end with the block around them
            while self.solid and tag in CLOSES.get(self.stack[self.solid[-1]][0], ()):
                depth = self.solid[-1]
                while len(self.stack) > depth:
                    self.pop()
            self.flush()
        elif not self.skipping:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
        if tag in VOID:
            return
        skip, marked, wrapper = self.verdict(tag, attrs)
        element = len(self.kinds)
        if marked:
            self.marks[element] = wrapper
        self.kinds.append(tag)
        self.parents.append(self.stack[self.solid[-1]][1] if self.solid else 0)
        self.first.append(len(self.texts))
        self.last.append(0)
        self.places[tag].append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append((tag, element, skip))
        self.skipping += skip
        self.links += tag == "a"
        self.regions += tag in REGIONS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag in ("svg", "iframe", "object"):
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if not self.places[tag]:
            return
        depth = self.places[tag][-1]
        if tag in INLINE and self.solid and depth < self.solid[-1]:
            return  # a formatting element does not end the block it is in
        while len(self.stack) > depth:
            self.pop()

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def end(self) -> None:
        self.close()
        while self.stack:
            self.pop()
        self.flush()
        self.last[0] = len(self.texts)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the last values go on."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def kept_blocks(blocks: Blocks) -> np.ndarray:
    """Which blocks lie in no marked element, wrappers apart."""
    held = np.zeros(len(blocks.kinds), dtype=bool)  # by subtrees: children come after parents
    for e in range(len(blocks.kinds) - 1, 0, -1):
        inside = held[e] or (blocks.kinds[e] in REGIONS and e not in blocks.marks)
        held[blocks.parents[e]] |= inside
    gone = np.zeros(len(blocks.texts) + 1, dtype=np.int64)
    maybe = []
    for e, wrapper in blocks.marks.items():
        if wrapper and held[e]:
            maybe.append((blocks.first[e], blocks.last[e]))
        else:
            gone[blocks.first[e]] += 1
            gone[blocks.last[e]] -= 1
    left = np.where(np.cumsum(gone)[:-1] == 0, [len(t) for t in blocks.texts], 0)
    sums = np.concatenate([[0], np.cumsum(left)])
    for first, last in maybe:
        if 2 * (sums[last] - sums[first]) < sums[-1]:
            gone[first] += 1
            gone[last] -= 1
    return np.cumsum(gone)[:-1] == 0


def region(blocks: Blocks) -> list[str]:
    """Texts of the content region."""
    kept = kept_blocks(blocks) if blocks.texts else np.zeros(0, dtype=bool)
    if not kept.any():
        return []
    sizes = np.where(kept, [len(t) for t in blocks.texts], 0)
    logs = np.log1p(smooth(np.array(blocks.ratios)[kept]))
    threshold = logs.min() + 0.3 * (np.median(logs) - logs.min())
    content = np.zeros(len(kept), dtype=bool)
    content[kept] = logs >= threshold

    first, last = np.array(blocks.first), np.array(blocks.last)

    def held(values: np.ndarray) -> np.ndarray:
        """Sums of block values by element."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last] - sums[first]

    weights = held(np.where(content, sizes, 0))
    total = weights[0]
    regions = [e for e, kind in enumerate(blocks.kinds) if kind in REGIONS and 2 * weights[e] >= total]
    if regions:
        # the innermost of those that hold the most
        best = max(regions, key=lambda e: (weights[e], e))
    else:
        best = int(np.flatnonzero(weights == total).max())
        prose = [blocks.kinds[h] in TEXT_TAGS for h in blocks.holders]
        texts, proses = held(sizes), held(np.where(prose, sizes, 0))
        around = best
        while blocks.kinds[around] not in ("", "body", "html"):
            around = blocks.parents[around]
            if blocks.kinds[around] not in ("", "body", "html") and 2 * (proses[around] - proses[best]) >= (
                texts[around] - texts[best]
            ):
                best = around
    span = range(first[best], last[best])
    return [blocks.texts[i] for i in span if kept[i]]


def main_text(html: str) -> str:
    blocks = Blocks()
    blocks.feed(html)
    blocks.end()
    return "\n".join(region(blocks))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of every page."""
    src = pages.select(
        pages[id_col].alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    )
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return src.mapInArrow(run, f"page_id {kind}, url string, text string")
