"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, a threshold.

The page is fed to the standard library's parser in chunks. Its events are gathered into lines, one for
each block of the page (paragraph, heading, list item, cell, ...). A line's ratio is its characters
outside links for each tag in it. Lines within elements that markup calls something else than the article (navigation,
page headers, footers, asides, forms; a class, id or role that names an advert, notice, sidebar, menu, comment area and so on)
are marked: their ratios weigh `MARKED` times as much. The ratios of unmarked lines, and those of each marked element, are each smoothed
with a Gaussian over their lines. Lines whose smoothed ratio reaches the threshold (the ratios' standard deviation, but
between a tenth and a third of their largest) are the seeds; runs of seeds are the clusters.

Each cluster selects a region: the innermost element that holds it (never a part such as a list, quote, cell
or section, but what stands around), or the article (else main) around that. If that is the page's body, the region goes from the
clusters' first line to their last one, and on over lines that stand in the body itself. Headings that lead up to a
region belong to it. Within regions every line is kept, short ones and headings too, but for marked elements without any
seed. So marks lower an element's weight, and the clusters decide: an element whose name misleads but which holds the
page's main text is kept. An article or main element that opens first in the page below a marked name isn't marked, and words after
has, with or no in a name mark nothing.

Scripts, styles, heads, templates and other elements without readable text never count. White space inside a line becomes one space;
lines are joined by one line feed; nothing is cut. Null and empty html give an empty text, as do pages without text outside
links. Bytes that aren't UTF-8 become U+FFFD. Rows are independent; repeated rows repeat; extra columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings, table

CHUNK = 1 << 16
# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("audio button canvas datalist head iframe map noscript object script select style svg template textarea title video".split())
ASIDE = frozenset("aside dialog footer form menu nav search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be a region, and parts of one, which stand for what is around them.
CONTAINERS = frozenset("article aside body div footer form header main nav".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "title", "legend"}
# Words in class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted "
    "promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets complementary contentinfo alert".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")
#: What a marked line's ratio weighs.
MARKED = 0.001


def marks(value: str) -> bool:
    """Whether a class, id or role names something else than the article."""
    for name in value.split():
        found = [w.lower() for w in WORDS.findall(name)]
        if any(w in NOISE and (k == 0 or found[k - 1] not in ("has", "with", "no")) for k, w in enumerate(found)):
            return True
    return False


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    linked: int
    #: The outermost marked element around the line (0: none), the innermost region, whether it is a heading.
    mark: int
    region: int
    heading: bool


@dataclass(slots=True)
class Open:
    """An open element: its name; whether its text is never read (in `skip`, nor that of marked elements inside a line); the mark
    and region that hold for what is in it."""

    tag: str
    unread: bool
    mark: int
    named: bool
    region: int
    heading: bool = False
    skip: bool = False


OUTSIDE = Open("", False, 0, False, 0)


class Lines(HTMLParser):
    """Parser events to lines and regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.lines: list[Line] = []
        self.regions: list[tuple[str, int]] = [("", -1)]  # element, region above
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.marked = 0
        self.articles = False

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            at = self.stack[-1] if self.stack else OUTSIDE
            if not at.unread:
                self.lines.append(Line(text, self.tags, self.linked, at.mark, at.region, at.heading))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in CLOSES_P and any(e.tag == "p" for e in self.stack[-8:]):
            self.end("p")
        elif tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for t in [e.tag for e in reversed(self.stack)]:
                if t in same:
                    self.end(t)
                    break
                if t in ("ul", "ol", "dl", "table", "select", "tr") and t != tag:
                    break
        if tag in BLOCKS:
            self.flush()
            self.tags = 1
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else OUTSIDE
        unread, mark, named, region = above.unread or tag in UNREAD, above.mark, above.named, above.region
        if tag in ("article", "main"):
            if mark and named and not self.articles:
                mark = 0
            self.articles = True
        if not mark and not unread:
            plain = tag in ("html", "body", "main") or tag == "article" and not any(e.tag == "article" for e in self.stack)
            named = not plain and bool(attrs) and any(v and k in ("class", "id", "role") and marks(v) for k, v in attrs)
            hidden = bool(attrs) and any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            outer = tag == "header" and not any(e.tag in ("article", "main") for e in self.stack)
            if named or hidden or outer or tag in ASIDE:
                self.marked += 1
                mark = self.marked
        skip = unread or tag not in BLOCKS and (above.skip or mark != above.mark)
        if tag in CONTAINERS:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.links += tag == "a"
        self.stack.append(Open(tag, unread, mark, named, region, above.heading or tag in HEADINGS, skip))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.end(tag)

    def end(self, tag: str) -> None:
        """End the nearest open element of this name. Only a block ends blocks that stand open inside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k].tag
            if t == tag:
                if tag in BLOCKS:
                    self.flush()
                self.links -= sum(e.tag == "a" for e in self.stack[k:])
                del self.stack[k:]
                return
            if t in BLOCKS and tag not in BLOCKS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash closes only void elements; elsewhere HTML ignores it.
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].skip:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


@lru_cache
def kernel(sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Each value's Gaussian mean; beyond the ends the end values go on."""
    k = kernel(sigma)
    reach = len(k) // 2
    return np.convolve(np.concatenate([[ratios[0]] * reach, ratios, [ratios[-1]] * reach]), k, mode="valid")


def seeds_of(lines: list[Line], sigma: float) -> np.ndarray:
    """Which lines' smoothed and weighed ratios reach the threshold."""
    ratios = np.zeros(len(lines))
    own = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    members: dict[int, list[int]] = {}
    for k, x in enumerate(lines):
        members.setdefault(x.mark, []).append(k)
    for mark, at in members.items():
        ratios[at] = smoothed(own[at], sigma) * (MARKED if mark else 1.0)
    if not ratios.max() > 0:
        return np.zeros(len(lines), bool)
    return ratios >= np.clip(ratios.std(), ratios.max() / 10, ratios.max() / 3)


def clusters_of(seeds: np.ndarray, marks_: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each run of seeds; lines with another mark between them neither end nor join a run."""
    out: list[tuple[int, int]] = []
    last: dict[int, int] = {}  # by mark: the cluster that its last line is in, -1 for none
    for k, (seed, mark) in enumerate(zip(seeds, marks_)):
        if not seed:
            last[mark] = -1
        elif last.get(mark, -1) >= 0:
            out[last[mark]] = out[last[mark]][0], k
        else:
            last[mark] = len(out)
            out.append((k, k))
    return out


def main_text(html: str, sigma: float = 1.0) -> str:
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    parser.flush()
    lines, regions = parser.lines, parser.regions
    if not lines:
        return ""
    seeds = seeds_of(lines, sigma)

    def above(region: int) -> list[int]:
        """A region and those around it, innermost first."""
        out = []
        while region >= 0:
            out.append(region)
            region = regions[region][1]
        return out

    def selected(first: int, last: int) -> int:
        own = [above(r) for r in {x.region: 0 for x, seed in zip(lines[first : last + 1], seeds[first : last + 1]) if seed and x.mark == lines[first].mark}]
        common = set(own[0]).intersection(*own[1:])
        path = [r for r in own[0] if r in common]
        for tag in ("article", "main"):
            if marked := [r for r in path if regions[r][0] == tag]:
                return marked[-1]
        return path[0]

    spans: dict[int, tuple[int, int]] = {}
    for first, last in clusters_of(seeds, [x.mark for x in lines]):
        r = selected(first, last)
        spans[r] = min(first, spans.get(r, (first, last))[0]), max(last, spans.get(r, (first, last))[1])
    keep = np.zeros(len(lines), bool)
    kept_marks = {lines[k].mark for k in np.flatnonzero(seeds)} | {0}
    for r, (first, last) in spans.items():
        if regions[r][0] in ("", "body", "html"):
            # The body holds everything, so what the clusters span counts, and what stands beside them in the body itself.
            while first > 0 and lines[first - 1].region == r and not lines[first - 1].mark:
                first -= 1
            while last + 1 < len(lines) and lines[last + 1].region == r and not lines[last + 1].mark:
                last += 1
            keep[first : last + 1] = True
        else:
            within = [q == r for q in range(len(regions))]
            for q in range(r + 1, len(regions)):
                within[q] = within[regions[q][1]]
            inside = [k for k, x in enumerate(lines) if within[x.region]]
            keep[inside] = True
            first = inside[0]
        outer = set(above(r))
        while first > 0 and lines[first - 1].heading and not lines[first - 1].mark and lines[first - 1].region in outer:
            first -= 1
            keep[first] = True
    return "\n".join(x.text for k, x in enumerate(lines) if keep[k] and x.mark in kept_marks)


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(html, sigma) for html in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
