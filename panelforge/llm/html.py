"""Main text of web pages by the line-block distribution.

A page is stripped of markup into lines: a block element begins a new line, white space in a line becomes one
space, character references are decoded. Elements that never hold the article (scripts, styles, forms,
navigation, footers and asides, headers outside an article) are stripped with what they hold. Elements whose class, id or role
says advert, sidebar, notice, comments and the like are suspects: their lines stay out, unless they hold an ``article`` or
``main`` element, or the rest of the page has no surge and they hold most of the page's text.
A line's weight is the length of its text outside links.

Then, over the lines, the weights of ``block`` lines in a row are summed. The article surges where a sum passes the
threshold and dives where sums come to nothing; all lines from the last dive before a surge to the next one after it are
kept, however short, and each surge of a page counts. The sums run over all lines of every page. The edge of an ``article`` or ``main``
element is a dive: what touches the article there does not join its run. A line inside weighs a share of the threshold more, so that
``block`` short lines there make a surge; lines outside keep their weight, and text beside such an element is found as on any page if it has
a surge of its own, of two lines at least where the page has one inside. On a page without a surge the lines around the highest sum are kept.

Text that the browser would not show as the article's is dropped; nothing else is dropped or cut. A page is read once, from
its beginning to its end, whatever is wrong with its tags.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

BLOCK = 3
THRESHOLD = 80
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math select object audio video canvas".split())
#: Elements that never belong to an article.
NEVER = RAW | frozenset("nav footer aside form head menu dialog button input option label fieldset".split())
#: Words of a class, id or role that say the same.
SAYS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs footer header masthead comment comments disqus reply replies respond notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager complementary contentinfo search toc".split()
)
#: Those of readers' comments, of which a page may have more than of its article.
TALK = frozenset("comment comments disqus reply replies respond".split())
#: Words that may stand beside them in one name; a name with any other word, such as side-by-side, says nothing.
BESIDE = frozenset(
    "site page main global top bottom left right box area list bar block section wrap wrapper container inner outer item items link links post posts content panel col column row group "
    "text title label icon button btn form module unit slot zone region inline sticky fixed mini small large desktop mobile first last primary secondary article story blog news body user reader readers thread wp js".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
#: Open elements that an opening tag ends.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""\shidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[a-z]+")
# The white space of HTML, and what else Python and Unicode count as white space.
BLANK = re.compile(r"\s+")
ENDINGS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}


def says(attributes: str) -> set[str]:
    """The words of the names that mark an element as no part of an article."""
    found: set[str] = set()
    for match in NAMED.finditer(attributes):
        for name in (match.group(1) or match.group(2) or match.group(3) or "").split():
            words = set(WORDS.findall(HUMP.sub("-", name).lower()))
            if words & SAYS and not words - SAYS - BESIDE:
                found |= words & SAYS
    return found


class Tags:
    """The tags of a page in order. A tag that quotes never let end makes quotes count as plain characters from there on."""

    def __init__(self, html: str):
        self.html, self.last, self.quoting = html, html.rfind(">"), True

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 if none does."""
        html, place = self.html, at
        while self.quoting and place <= self.last:
            stop = STOP.search(html, place)
            if stop.group() == ">":
                return stop.start()
            place = html.find(stop.group(), stop.end()) + 1
            if not place:
                break
        self.quoting = False
        return html.find(">", at) if at <= self.last else -1

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """Start and end of the next piece of markup from ``at`` on, its tag (or ''), whether it closes, and its attributes."""
        html = self.html
        n = len(html)
        while True:
            start = html.find("<", at)
            if start < 0:
                return n, n, "", False, ""
            first = html[start + 1 : start + 2]
            if first in ("!", "?"):
                comment = html.startswith("<!--", start)
                end = html.find("-->" if comment else ">", start + 2)
                return start, n if end < 0 else end + (3 if comment else 1), "", False, ""
            closes = first == "/"
            name = NAME.match(html, start + 1 + closes)
            if name:
                end = self.end(name.end())
                if end < 0:  # an unfinished tag, to the page's end
                    return start, n, "", False, ""
                return start, end + 1, name.group().lower(), closes, html[name.end() : end]
            at = start + 1


def page_lines(html: str) -> tuple[list[tuple[str, int, bool, int]], list[tuple[int, bool, set[str]]]]:
    """Lines: (text, characters outside links, inside an article or main element, suspect); suspects: (the one around, holds such an element, words).

    A line's suspect is the number of the innermost one around it; number 0 is the page itself.
    """
    lines: list[tuple[str, int, bool, int]] = []
    suspects: list[tuple[int, bool, set[str]]] = [(0, True, set())]
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: whether each is stripped, and its number if it is a suspect
    opened: Counter[str] = Counter()
    stripped = links = mains = inside = 0

    def flush() -> None:
        if parts:
            text = BLANK.sub(" ", unescape("".join(p for p, _ in parts))).strip()
            if text:
                free = BLANK.sub(" ", unescape("".join(p for p, linked in parts if not linked))).strip()
                lines.append((text, len(free), mains > 0, inside))
            parts.clear()

    def close() -> None:
        nonlocal stripped, links, mains, inside
        tag, gone, suspect = stack.pop()
        opened[tag] -= 1
        stripped -= gone
        links -= tag == "a"
        mains -= tag in MAIN
        if suspect:
            inside = suspects[suspect][0]

    tags = Tags(html)
    at = 0
    while at < len(html):
        start, end, tag, closes, attributes = tags.next(at)
        if not stripped and start > at:
            parts.append((html[at:start], links > 0))
        at = end
        if not tag:
            continue
        block = tag in BLOCKS
        if block and not stripped:
            flush()
        if closes:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if block and stack:
            ends = ENDS.get(tag)
            if stack[-1][0] == "p" or ends and stack[-1][0] in ends:
                close()
        if tag in VOID or attributes.endswith("/") and not block and tag not in RAW:
            continue
        if tag in RAW:
            ending = ENDINGS[tag].search(html, at)
            at = ending.end() if ending else len(html)
            continue
        gone = tag in NEVER or tag == "header" and not mains or bool(attributes) and bool(HIDDEN.search(attributes))
        suspect = 0
        if attributes and not gone and not stripped and tag not in ("body", "html") and tag not in MAIN:
            words = says(attributes) - ({"header"} if mains else set())
            # An inline element hardly is a place of its own; only an advert stands in one.
            if words:
                if not block:
                    flush()
                suspects.append((inside, False, words))
                suspect = inside = len(suspects) - 1
        stack.append((tag, gone, suspect))
        opened[tag] += 1
        stripped += gone
        links += tag == "a"
        if tag in MAIN:
            mains += 1
            holder = inside if not stripped else 0
            while holder and not suspects[holder][1]:
                suspects[holder] = (suspects[holder][0], True, suspects[holder][2])
                holder = suspects[holder][0]
    if not stripped:
        flush()
    return lines, suspects


def kept_lines(weights: np.ndarray, block: int, threshold: int) -> tuple[np.ndarray, bool]:
    """Which lines lie between the dives around a surge, and whether there is a surge; without one, those around the highest sum."""
    kept = np.zeros(len(weights), dtype=bool)
    if not weights.any():
        return kept, False
    sums = np.convolve(weights, np.ones(block, dtype=np.int64))[block - 1 :]  # of each line and those after it
    surges = sums > threshold
    surging = bool(surges.any())
    if not surging:
        surges = sums == sums.max()
    # Runs of lines whose sums don't dive; a run begins and ends with a line that has weight.
    alive = np.concatenate(([False], sums > 0, [False]))
    turns = np.flatnonzero(alive[1:] != alive[:-1])
    for start, end in zip(turns[::2], turns[1::2], strict=True):
        if surges[start:end].any():
            start += int(np.argmax(weights[start:end] > 0))
            kept[start:end] = True
    return kept, surging


def between_edges(weights: np.ndarray, inside: np.ndarray, block: int, threshold: int) -> np.ndarray | None:
    """The lines that surges keep, where no run passes from the inside of an article to the outside; None if nothing surges."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    found = []
    for start, end in zip([0, *edges], [*edges, len(weights)], strict=True):
        kept, surging = kept_lines(weights[start:end], block, threshold)
        if surging:
            found.append((bool(inside[start]), start + np.flatnonzero(kept)))
    if not found:
        return None
    # Beside an article a single line is a teaser or a notice.
    article = any(main for main, _ in found)
    kept = [rows for main, rows in found if main or not article or np.count_nonzero(weights[rows]) > 1]
    return np.concatenate(kept)


def main_text(html: str, block: int = BLOCK, threshold: int = THRESHOLD) -> str:
    """The kept lines of a page, joined by line feeds."""
    lines, suspects = page_lines(html)
    if not lines:
        return ""
    free = np.array([n for _, n, _, _ in lines], dtype=np.int64)
    own = np.array([suspect for *_, suspect in lines], dtype=np.int64)
    weights = free + threshold // block * np.array([main for _, _, main, _ in lines], dtype=np.int64)
    out = np.zeros(len(suspects), dtype=bool)
    for number, (around, holds, _) in enumerate(suspects):
        out[number] = bool(number) and (out[around] or not holds)

    inside = np.array([main for _, _, main, _ in lines], dtype=bool)

    def run() -> tuple[np.ndarray, bool]:
        good = np.flatnonzero(~out[own])
        runs = between_edges(weights[good], inside[good], block, threshold)
        if runs is not None:
            return good[runs], True
        kept, _ = kept_lines(weights[good], block, threshold)
        return good[kept], False

    chosen, surging = run()
    if not surging and out.any() and not any(lines[i][2] for i in chosen):
        # The article may stand in a suspect: one that has most of the page's text, and enough of it, is none.
        totals = np.bincount(own, weights=free, minlength=len(suspects))
        for number in range(len(suspects) - 1, 0, -1):
            totals[suspects[number][0]] += totals[number]
        for number, (around, _, words) in enumerate(suspects):
            if number and out[number]:
                out[number] = out[around] or bool(words & TALK) or totals[number] <= max(threshold, totals[0] // 2)
        chosen, _ = run()
    return "\n".join(lines[i][0] for i in chosen)


OUTPUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(df: DataFrame, html: str = "html", carry: Iterable[str] = ("page_id", "url"), block: int = BLOCK, threshold: int = THRESHOLD) -> DataFrame:
    """Add ``text``, the main text of the whole page, and ``n_chars``, its code points.

    Null and empty pages, and pages without text, get the empty text. Unclosed tags, comments and elements run to
    where a browser would end them or to the page's end. One row for each input row, repeated rows included; columns
    of ``carry`` called ``text`` or ``n_chars`` are replaced.
    """

    def compute():
        def function(columns):
            texts = [main_text(value, block, threshold) if value else "" for value in columns[0].to_pylist()]
            return [texts, [len(t) for t in texts]]

        return function

    return add_columns(df, carry, [html], OUTPUT, compute)
