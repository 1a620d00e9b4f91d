"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text, and each line has a length: that of its
text outside links, and none inside an element that tags, classes, ids or roles name as no main text
(menus, headers, footers, asides, forms, notices, adverts, comments). Lengths are summed over WINDOW
lines from each line on, and up to it. A page's threshold is a share of its largest sum. The text
surges at a line with a length whose sum onward is over the threshold, and dives where the sums on
both sides are not; what stands between is kept. A window reaches over the edge of the text by up to
WINDOW - 1 lines, so as many short ones are cut off at both ends, save sentences, and headings at the
beginning.

Lists of names only weigh. An element that holds most of the page's text is main text whatever its
class, and of a compound name all parts must be known (``ad-free`` is no advert). Marks (article,
main) shift the threshold: inside them it is zero and text in links counts; outside it is the largest
sum inside, and what surges there must have more text than the marked parts.

Scale: a page is a row; there is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of

WINDOW = 3
#: The threshold of a page without marks is its largest sum by this.
SHARE = 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Tags whose content is no markup.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
#: Tags that end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that never hold main text.
NEVER = frozenset("nav footer button select datalist svg canvas object audio video dialog menu search head".split())
#: Tags that hold none unless most of the page's text is in them; header only outside an article.
SELDOM = frozenset("aside form header".split())
#: Names in a class, id or role that mark an element as no main text, alone or with others of these lists.
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
MARKS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe signup login popup modal overlay "
    "pagination pager toolbar widget contentinfo complementary search skip".split()
)
#: As MARKS, but only outside an article.
OUTER = frozenset("header topbar".split())
#: What may stand beside such a name in a compound.
BESIDE = frozenset("area bar block bottom box button buttons container footer form group header inner item items left link links list main outer page panel posts right section side site slot small top unit wrap wrapper".split())
_SPACE = frozenset("br td th img wbr".split())
_ENDS = tuple(".!?…:;\"'”’»)。！？")
_SPLIT = re.compile(r"[-_]+")


class Line(NamedTuple):
    """A block of text: how much of it is outside links, the elements named as no main text that it is in, whether it is a heading, and the number of its mark (0: none)."""

    text: str
    plain: int
    boxes: tuple[int, ...]
    heading: bool
    mark: int


class Box(NamedTuple):
    """An element named as no main text: whether that holds however much text it has, and whether it is named as comments."""

    never: bool
    comments: bool


def _box(tag: str, attributes: str, inside: bool) -> Box | None:
    if tag in NEVER:
        return Box(True, False)
    seldom = tag in SELDOM and not (tag == "header" and inside)
    if not attributes or tag in ("html", "body"):
        return Box(False, False) if seldom else None
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return Box(True, False)
    names = MARKS if inside else MARKS | OUTER
    known: set[str] = set()
    for name in " ".join(found.get(x, "") for x in ("class", "id", "role")).lower().split():
        parts = set(_SPLIT.split(name)) - {""}
        if parts & names and parts <= names | BESIDE:
            known |= parts
    return Box(False, bool(known & COMMENTS)) if known or seldom else None


def lines_of(page: str) -> tuple[list[Line], list[Box]]:
    """The lines of a page, and what their boxes are."""
    lines: list[Line] = []
    boxes: list[Box] = []
    parts: list[str] = []
    plain = 0  # code points outside links
    open_tags: list[tuple[str, int]] = []  # from the first box on: tag, number of its box or -1
    marks: list[str] = []  # open article and main tags
    heading = False
    mark = n_marks = links = at = 0

    def end_line() -> None:
        nonlocal plain
        if text := " ".join("".join(parts).split()):
            lines.append(Line(text, min(plain, len(text)), tuple(n for _, n in open_tags if n >= 0), heading, mark if marks else 0))
        parts.clear()
        plain = 0

    def add(raw: str) -> None:
        nonlocal plain
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not links:
                plain += len("".join(text.split()))

    def close(tag: str) -> bool:
        """Closes an open tag from the first box on; whether there was one."""
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] == tag:
                end_line()
                del open_tags[k:]
                return True
        return False

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (bool(m[1] or m[5]), (m[2] or m[6] or "").lower(), m[3] or "")
        if not tag:
            continue
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            end_line()
        elif tag in _SPACE:
            parts.append(" ")
        if closing:
            if open_tags and not close(tag) and (tag in marks or tag in ("body", "html")):
                end_line()
                open_tags.clear()  # what was left open ends with what is around it
            if tag == "a":
                links = max(0, links - 1)
            if tag in HEADINGS:
                heading = False
            if tag in marks and not any(t == tag for t, _ in open_tags):
                del marks[len(marks) - 1 - marks[::-1].index(tag) :]
            continue
        if tag in HEADINGS:
            heading = True
        if open_tags and tag in BLOCK and open_tags[-1][0] == "p" and open_tags[-1][1] >= 0:
            open_tags.pop()  # a paragraph ends with the next block
        whole = tag in VOID or attributes.rstrip().endswith("/")
        box = None if whole else _box(tag, attributes, bool(marks))
        if tag in ("article", "main") and not box and not (open_tags and marks):
            open_tags.clear()  # a menu or header that was never closed
            if not marks:
                n_marks += 1
                mark = n_marks
            marks.append(tag)
        elif box:
            end_line()
            boxes.append(box)
            open_tags.append((tag, len(boxes) - 1))
        elif open_tags and not whole and (tag in BLOCK or tag == open_tags[0][0]) and tag not in ("p", "li"):
            open_tags.append((tag, -1))
        if tag == "a" and not whole:
            links += 1
    add(page[at:])
    end_line()
    return lines, boxes


def lengths_of(lines: list[Line], boxes: list[Box]) -> list[int | None]:
    """The length of each line; None inside a box that is no main text."""
    total = sum(x.plain for x in lines if not any(boxes[b].never for b in x.boxes))
    held, count = [0] * len(boxes), [0] * len(boxes)
    for x in lines:
        if not any(boxes[b].never for b in x.boxes):
            for b in x.boxes:
                held[b] += x.plain
                count[b] += 1
    # Most of the page's text, in several lines, is no boilerplate; comments are, if there is anything else.
    out = [box.never or not (2 * n > total and k > 1) or box.comments and n < total for box, n, k in zip(boxes, held, count, strict=True)]
    return [None if any(out[b] for b in x.boxes) else len(x.text) if x.mark else x.plain for x in lines]


def points(lengths: list[int], thresholds: list[float]) -> list[tuple[int, int]]:
    """(surge, dive) of each region of text: see the module's text."""
    n, found, surge = len(lengths), [], None
    onward = backward = 0  # sums from a line on, and up to it
    onward = sum(lengths[: WINDOW - 1])
    for i in range(n):
        onward += (lengths[i + WINDOW - 1] if i + WINDOW - 1 < n else 0) - (lengths[i - 1] if i else 0)
        backward += lengths[i] - (lengths[i - WINDOW] if i >= WINDOW else 0)
        if surge is None:
            if lengths[i] and onward > thresholds[i]:
                surge = i
        elif onward <= thresholds[i] and backward <= thresholds[i]:
            found.append((surge, i))
            surge = None
    return found if surge is None else [*found, (surge, n)]


def _largest(lengths: list[int]) -> int:
    return max((sum(lengths[i : i + WINDOW]) for i in range(len(lengths))), default=0)


def _beside_text(weighed: list[int | None], k: int) -> bool:
    """Whether a line of links stands beside one with a length, or beside others of links that do; else boxes are on both sides."""
    for step in (-1, 1):
        i = k
        while 0 <= i < len(weighed) and weighed[i] == 0:
            i += step
        if 0 <= i < len(weighed) and weighed[i]:
            return True
    return False


def main_text(page: str) -> str:
    """The main text: blocks joined by a line feed; empty if there is none."""
    lines, boxes = lines_of(page)
    weighed = lengths_of(lines, boxes)
    lengths = [x or 0 for x in weighed]
    inside = [n if x.mark else 0 for n, x in zip(lengths, lines, strict=True)]
    marked = sum(inside)
    threshold = max(_largest(lengths) / SHARE, _largest(inside) if marked else 0)
    # A region ends where marks begin and end, as the threshold is another there.
    edges = [0, *(k for k in range(1, len(lines)) if bool(lines[k].mark) != bool(lines[k - 1].mark)), len(lines)]
    regions: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        for i, j in points(lengths[a:b], [0 if x.mark else threshold for x in lines[a:b]]):
            i, j = a + i, a + j
            if not lines[i].mark:
                short = [n < threshold and not x.text.endswith(_ENDS) for n, x in zip(lengths[i:j], lines[i:j], strict=True)]
                first, last = i, j
                while i < j and (not lengths[i] or i - first < WINDOW - 1 and short[i - first] and not lines[i].heading):
                    i += 1
                while j > i and (not lengths[j - 1] or last - j < WINDOW - 1 and short[j - 1 - first]):
                    j -= 1
                if marked and sum(lengths[i:j]) <= marked:
                    continue
            regions.append((i, j))
    kept = {k for i, j in regions for k in range(i, j) if weighed[k] is not None and (lengths[k] or _beside_text(weighed, k))}
    if not marked:  # short lines between two regions are of the text; links alone are not
        kept |= {k for (_, i), (j, _) in zip(regions, regions[1:], strict=False) for k in range(i, j) if lengths[k]}
    return "\n".join(lines[k].text for k in sorted(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text (empty if none), n_chars (its code points).

    A null html is empty. A null id or url stays null. Equal rows each give a row. Pages of any
    length are read whole. Other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), text_of(html_col).alias("_html"))
    return rows.mapInArrow(run, "_id long, _url string, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})
