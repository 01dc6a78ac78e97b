"""Operator 1: the main text of web pages, from the standard library's streaming parser.

Blocks are the lines of the page. Each has a text-to-tag ratio; the ratios' logarithms are smoothed with
a Gaussian and a threshold between their two clusters tells content from the rest, on every page. Lying
in an article or main element only lowers the threshold. Scripts, styles, controls and the like are never
content. An element that is a menu, footer, form, notice ... by its tag or class is left out before, unless
the page says otherwise: the only article stands in it, or most of the page's text does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title script style noscript template svg math canvas button select option textarea iframe object audio video map".split())
#: Not content by its tag, if the page doesn't say otherwise.
ASIDE = frozenset("nav footer aside form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
#: A new block of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id or role that mark what is not content.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup login sidebar sidebars aside complementary widget widgets related recommended recommendations trending popular share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation masthead header topbar toolbar footer contentinfo copyright comment comments commentlist disqus respond reply replies discussion search pagination pager skip hidden".split()
)
#: What readers write is left out however long it is.
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: A word after one of these says what an element has or lacks, not what it is.
ABOUT = frozenset("no not non without has with have is".split())
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> str | None:
    """The word of class, id or role that says that an element is not content; inside: within an article, whose own header is."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if value and name in ("class", "id", "role"):
            for part in value.split():
                before = ""
                for word in map(str.lower, _WORDS.findall(part)):
                    if word in MARKED and before not in ABOUT and not (inside and word == "header"):
                        return word
                    before = word
    return None


class Lines(HTMLParser):
    """The page's blocks outside of what is never content: (text, tags, region, aside).

    region: number of the article or main it lies in, 0 outside; aside: number of the outermost element
    around it that isn't content by tag or class, 0 without one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int]] = []
        self.asides: list[str] = [""]  # the word that says so
        self.holds: dict[int, int] = {0: 0}  # articles of each aside, and outside
        self.parts: list[str] = []
        self.tags = 0
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, dropped, region, aside
        self.dropped, self.region, self.regions, self.aside = False, 0, 0, 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, self.region, self.aside))
            self.parts = []
        self.tags = 0

    def pop(self, to: int) -> None:
        del self.stack[to:]
        self.dropped, self.region, self.aside = self.stack[-1][1:] if self.stack else (False, 0, 0)

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            if not self.dropped:
                self.flush()
            if tag in CLOSES_P:
                for i in range(len(self.stack) - 1, -1, -1):
                    open_ = self.stack[i][0]
                    if open_ == "p":
                        self.pop(i)
                        break
                    if open_ not in INLINE:
                        break
            elif tag == "li" and self.stack and self.stack[-1][0] == "li":
                self.pop(len(self.stack) - 1)
        elif tag == "br" and not self.dropped:
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if not self.dropped:
            if tag in NEVER:
                self.dropped = True
            else:
                if not self.aside and tag not in ("html", "body"):
                    # Outside of an article a header is the page's.
                    by_tag = tag in ASIDE or tag == "header" and not self.region
                    word = tag if by_tag else marked(tag, attrs, bool(self.region)) if attrs else None
                    # An article that is called so is a reader's only among others of that name.
                    if word and not (tag in MAIN and word not in READERS | {"hidden"}):
                        self.asides.append(word)
                        self.aside = len(self.asides) - 1
                        self.holds[self.aside] = 0
                if tag in MAIN and not self.region:
                    self.regions += 1
                    self.region = self.regions
                    self.holds[self.aside] += 1
        self.stack.append((tag, self.dropped, self.region, self.aside))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag not in INLINE and not self.dropped:
                    self.flush()
                self.pop(i)
                return

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing, normalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        w = t = 0.0
        for j, k in enumerate(kernel, i - reach):
            if 0 <= j < len(values):
                w += k
                t += k * values[j]
        out.append(t / w)
    return out


def threshold(values: list[float]) -> float:
    """Between the two clusters of the values: 2-means in one dimension, from the least and the largest."""
    lo, hi = min(values), max(values)
    for _ in range(20):
        cut = (lo + hi) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not a or not b:
            return cut
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def content_blocks(p: Lines) -> list[tuple[str, int, int]]:
    """The blocks outside of asides, and those of asides that are content after all.

    These are what holds the page's only articles, and what holds three quarters of the text or all of it where
    that is a hundred characters or more; not what readers wrote, but for a page's only article.
    """
    mass: dict[int, int] = {}
    for t, _, _, k in p.blocks:
        mass[k] = mass.get(k, 0) + len(t)
    total, kept = sum(mass.values()), {0}
    for k in mass:
        only = p.holds[k] == 1 and sum(p.holds.values()) == 1
        most = 4 * mass[k] >= 3 * total and mass[k] >= 100 and p.asides[k] not in READERS | {"hidden", "dialog"} and not p.holds[0]
        if k and (only or most):
            kept.add(k)
    return [b[:3] for b in p.blocks if b[3] in kept]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Text of a page's content lines, joined by a line feed. Null, empty or all dropped: empty.

    A line is content where its smoothed log ratio reaches the threshold less log 2; in an article or main
    element with a fair share of the page's mass (a teaser's hasn't), less log 4, and two characters a tag
    are enough there. Gaps no longer than the smoothing reaches are filled.
    """
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    blocks = content_blocks(p)
    if not blocks:
        return ""
    mass: dict[int, int] = {}
    for t, _, r in blocks:
        mass[r] = mass.get(r, 0) + len(t)
    fair = max(mass.values()) / 4
    smooth = smoothed([math.log1p(len(t) / max(1, n)) for t, n, _ in blocks], sigma)
    cut = threshold(smooth)
    inside, outside = min(cut - math.log(4), math.log(3)), cut - math.log(2)
    over = [i for i, (s, b) in enumerate(zip(smooth, blocks, strict=True)) if s >= (inside if b[2] and mass[b[2]] >= fair else outside)]
    reach = max(1, math.ceil(2 * sigma))
    kept = over[:1]
    for i in over[1:]:
        kept += range(kept[-1] + 1, i + 1) if i - kept[-1] <= reach + 1 else [i]
    return "\n".join(blocks[i][0] for i in kept)


def extract(pages: DataFrame, html: str = "html", sigma: float = 1.0) -> DataFrame:
    """The rows of pages without the html column, plus text and n_chars (code points) of its main text.

    Rows with a null or empty page have the empty text; repeated rows are extracted each on its own;
    an empty table gives an empty one; other columns pass unchanged, and columns named text or n_chars are replaced.
    """
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    own = [f"c{i}" for i in range(len(names))]
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, own, strict=True)), F.col(f"`{html}`").alias("html_"))
    out = pages.select(*(F.col(f"`{c}`") for c in names), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [main_text(h.as_py(), sigma) for h in part.column("html_")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, out)
