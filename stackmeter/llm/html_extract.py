"""Main-text extraction by line-block distribution (operator 2).

Markup is stripped to lines, one for each block of text in page order.  A line weighs by
its length (up to ``FULL`` characters) and its share of link text; where it stands only
moves that weight: up inside an ``article`` or, less, a ``main`` element, down outside of
one where the page has one, and down inside elements whose name, class, id or role says
menu, header, footer, sidebar, notice, advert, form or comments.  Over the weights a window
is slid that sums each line (``CENTRE`` times) with its neighbours.  Where the sums rise above
nothing is a surge point, where they fall to nothing a dive point; the text between a
surge and the next dive is kept, all else goes.

So neighbours decide what a line alone leaves open: a line of link text among prose
stays and a row of them goes, a heading in ``main`` stays beside its article and goes among
menus, and a doubtful class (``notice-period``) costs a line nothing among others that weigh.

What is marked as furniture always goes, as the contract asks, and what is marked as article goes only among
links; on pages whose marks are complete the sums therefore agree with the marks.  They decide what no mark
speaks of: link rows in plain elements, doubtful classes, and lines outside the marked article.

Decoded character references; white space inside a block is one space, a line break
tag and a table cell's edge are white space too; blocks are joined by ``\\n``.

Defined results: null or empty html has the empty text; a page without any markup is
one block; unclosed tags and a cut-off last tag are tolerated; a page of any length is read
once from end to end; equal rows have equal results; an empty table gives no rows; other
columns pass, but those named like an output are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage


#: Characters from which a line has its full weight; how often a window counts the line in its centre.
FULL = 80
CENTRE = 3
#: Weight of a line of marked furniture.  Between two lines of full weight its sum is below nothing (3 x -0.7 + 2), so it
#: always goes; and it is not so heavy that two of them take a short line of text along (3 x 0.5 - 2 x 0.7).
MARKED = -0.7

# HTML element names, and words of class, id and role that name page furniture.
RAW = "script style noscript template iframe textarea select svg math object audio video canvas title"
SKIP = "head nav footer aside form button dialog menu fieldset"
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead caption tr ul"
)
SPACE = "br td th wbr img input"
FURNITURE = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar sidenav menu menubar nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe signup login "
    "search searchbox widget widgets pagination pager toolbar toc hidden contentinfo complementary skip"
)
#: What stands beside such a word in a compound name and leaves it its meaning.
PLACE = (
    "site page main top bottom left right upper lower primary secondary global local mini sticky fixed floating inner outer header footer box bar slot "
    "list item items links link area block section wrap wrapper container content panel unit group row col column button buttons icon icons form text title id js "
    "reader readers user users visitor post posts article thread policy tool tools google taboola slot zone"
)
VOID = "area base br col embed hr img input link meta param source track wbr"

_RAW, _SKIP, _BLOCK, _SPACE, _FURNITURE, _PLACE, _VOID = (frozenset(x.split()) for x in (RAW, SKIP, BLOCK, SPACE, FURNITURE, PLACE, VOID))
_NEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[/!?A-Za-z][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)", re.I)


@dataclass
class Line:
    """A block's text, how much of it is link text, how deep in an article it is (2 article, 1 main), and
    what the elements around it hint at (2 page furniture, 1 maybe)."""

    text: str
    linked: int
    region: int
    hint: int


def furniture(name: str, attributes: str) -> int:
    """Whether an element's class, id, role or hidden mark says that it is not article text: 2 yes, 1 maybe, 0 no."""
    if name in _NEVER or not attributes.strip():
        return 0
    if _HIDDEN.search(attributes):
        return 2
    level = 0
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORD.findall(token)
            if not _FURNITURE.isdisjoint(words):
                level = max(level, 2 if all(w in _FURNITURE or w in _PLACE for w in words) else 1)
    return level


def lines_of(page: str) -> list[Line]:
    """The blocks of a page, in page order."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    region = {"article": 0, "main": 0}
    skip, depth, anchor = "", 0, 0
    doubt, doubts = "", 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, linked, 2 if region["article"] else 1 if region["main"] else 0, 2 if skip else 1 if doubt else 0))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if anchor:
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        close, name = m[1], m[2].lower()
        if name in _RAW and not close:
            end = re.compile(rf"</{re.escape(name)}(?![A-Za-z0-9])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not m[3].endswith("/") or name in ("script", "style"):
                at = end.end() if end else (size if name != "title" else at)
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        elif name in _SPACE:
            parts.append(" ")
        if name == "a":
            anchor = 0 if close else 1
        if skip == "form" and name in region and not close:
            skip, depth = "", 0  # a form around the whole page: what it has before the article went, the article stays
        if skip:
            if skip in ("p", "li", "dt", "dd") and name in _BLOCK and depth == 1:
                if not close or name != skip:
                    skip, depth = "", 0
            if skip and name == skip and name not in _VOID:
                depth += -1 if close else 1
                if depth <= 0:
                    skip = ""
            if skip:
                continue
        if doubt and name == doubt and name not in _VOID:
            doubts += -1 if close else 1
            if doubts <= 0:
                doubt = ""
        if name in region:
            region[name] = max(0, region[name] + (-1 if close else 1))
        if not close and name not in _VOID and not m[3].rstrip().endswith("/"):
            level = furniture(name, m[3])
            if name in _SKIP or name == "header" and not any(region.values()) or level == 2:
                flush()
                skip, depth = name, 1
            elif level == 1 and not doubt:
                doubt, doubts = name, 1
    flush()
    return out


def weight(line: Line, region: int, full: int = FULL) -> float:
    """What a line weighs on a page whose deepest region with text is ``region``."""
    linked = min(1.0, line.linked / len(line.text))
    prose = min(len(line.text), full) / full * (1 - linked)
    if line.hint == 2:
        return MARKED
    if not region:
        found = 0.5 + 0.5 * prose - linked
    elif line.region == region:
        found = 0.8 + 0.2 * prose
    else:
        found = (0.2 if line.region else -0.8) + 0.2 * prose - 0.2 * linked
    return found - 0.4 * (line.hint == 1)


def sums(weights: list[float], centre: float = CENTRE) -> list[float]:
    """For each line the sum over the window around it."""
    padded = [0.0, *weights, 0.0]
    return [padded[i] + centre * padded[i + 1] + padded[i + 2] for i in range(len(weights))]


def stretches(values: list[float]) -> list[tuple[int, int]]:
    """``[surge, dive)``: from where the sums rise above nothing to where they fall to nothing again."""
    found, start = [], None
    for i, v in enumerate([*values, 0.0]):
        if v > 1e-9 and start is None:
            start = i
        elif v <= 1e-9 and start is not None:
            found.append((start, i))
            start = None
    return found


def main_text(page: str | None, centre: float = CENTRE, full: int = FULL) -> str:
    """The article text of a page."""
    if not page:
        return ""
    lines = lines_of(page)
    region = max((x.region for x in lines if x.hint < 2), default=0)
    found = stretches(sums([weight(x, region, full) for x in lines], centre))
    return "\n".join(x.text for a, b in found for x in lines[a:b])


def extract(pages: DataFrame, column: str = "html", centre: float = CENTRE, full: int = FULL) -> DataFrame:
    """``pages`` without its html, plus text and n_chars; row by row, no shuffle."""
    keep = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    source = pages.select(pages[column].alias("__page"), *[pages[f.name] for f in keep])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py(), centre, full) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays(
                    list(part.columns[1:]) + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [f.name for f in keep] + ["text", "n_chars"],
                )

    return storage.text_batches(source).mapInArrow(run, schema)
