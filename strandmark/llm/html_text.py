"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page. A line weighs as many characters as its text has outside
links; it weighs nothing if there is evidence enough that it is boilerplate: elements, names in class, id and role, links and
shortness each count for something, and none of the names decides alone on a paragraph. Where a page marks articles or a main part, text
outside them weighs a fiftieth. Sliding windows of WINDOW lines sum the weights. A surge is where a window's sum rises above
RATIO of the page's typical sum (the mean of sums, each weighted by itself), a dive where it falls back.

Text between the first surge and the last dive of what isn't marked is kept, and light text further out is not; a marked part is
kept whole, however light its lines, if one of its own windows surges. Only boilerplate is left out of what is kept.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

WINDOW, RATIO, OUTSIDE = 3, 0.05, 0.02
#: Evidence from which a line is boilerplate, and characters below which a line is short.
ENOUGH, SHORT = 2.0, 120

#: Elements whose text isn't the page's own, elements that don't break a line, text blocks, and names of boilerplate.
SILENT = frozenset("script style noscript template iframe svg object title textarea select option canvas button".split())
RAW = frozenset("script style noscript iframe title textarea".split())
BOILERPLATE = frozenset("nav footer aside form dialog".split())
INLINE = frozenset("a abbr b bdi bdo big br button canvas cite code data del dfn em font i iframe img input ins kbd label mark math mi mn mo mrow noscript object q s samp script select small span strike strong style sub sup svg template textarea time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address summary".split())
MARKED = frozenset(("article", "main"))
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation footer cookie cookies consent notice notices gdpr"
    " comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs pagination pager widget masthead search contentinfo complementary".split()
)
HEADS = frozenset("header banner masthead".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Words in names that say where something stands rather than what it is.
NEUTRAL = frozenset("area bar block bottom box container group inner item items left list main page primary right row section secondary site slot top unit user widget wrap wrapper".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?|<[!?][^>]*>?", re.S)
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
CAMEL = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: An element that ends one of its own kind that is still open, and where the search for that stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


def evidence(tag: str, attributes: str, inside: bool) -> float:
    """How much an element says that its text is boilerplate: 2 is enough. inside: in an article or main part."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return 2.0
    found = 1.0 if tag == "menu" and not inside else 0.0
    if not attributes or tag in ("html", "head", "body"):
        return found
    for value in NAMED.findall(attributes):
        words = [w.lower() for w in CAMEL.split(value) if w]
        names = [w for w in words if w in NAMES and (w not in HEADS or not inside) or w in HEADS and not inside]
        if not names:
            continue
        if tag in MARKED:
            found = max(found, 2.0 if COMMENTS & set(names) else 0.0)
            continue
        whole = all(w in names or w in NEUTRAL for w in words)
        found = max(found, (2.0 if whole else 1.0) / (2 if tag in TEXT_BLOCKS else 1))
    return found


def lines_of(page: str) -> list[tuple[str, float, int]]:
    """(text, weight, part) of each line: part 0 is what no article or main part marks, the others are numbered."""
    lines: list[tuple[str, float, int]] = []
    parts: list[str] = []
    # of each open element: its name, the evidence in it, its part, and whether its text is silent
    stack: list[tuple[str, float, int, bool]] = [("", 0.0, 0, False)]
    at, end, marks, links, linked = 0, len(page), 0, 0, 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not stack[-1][3]:
            parts.append(html.unescape(s))
            if links:
                linked += len(s.strip())

    def close() -> None:
        nonlocal linked
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                _, sure, part, _ = stack[-1]
                share = min(1.0, linked / len(t))
                sure += (1.0 if len(t) < SHORT else 0.0) * (sure > 0) + (0.5 if share > 0.5 and not part else 0.0)
                lines.append((t, 0.0 if sure >= ENOUGH else max(0.1, len(t) * (1.0 - 0.8 * share)), part))
            parts.clear()
        linked = 0

    def pop(upto: int) -> None:
        """Closes the elements from that place of the stack on."""
        nonlocal links
        if any(x[0] not in INLINE and not x[3] for x in stack[upto:]):
            close()
        links -= sum(x[0] == "a" for x in stack[upto:])
        del stack[upto:]

    def opened(names: tuple, stop: tuple) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stop:
                return 0
        return 0

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if k := opened((tag,), ()):
                pop(k)
            elif tag not in INLINE:
                close()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                close()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        _, sure, part, silent = stack[-1]
        if silent and attributes.rstrip().endswith("/"):
            continue
        if tag not in INLINE and not silent:
            # a block ends an open paragraph, and an item the one before it
            if k := opened(("p",), ("article", "main", "section", "div", "td", "li", "blockquote")):
                pop(k)
            if tag in ENDS and (k := opened(*ENDS[tag])):
                pop(k)
            close()
            _, sure, part, silent = stack[-1]
            sure = max(sure, evidence(tag, attributes, part > 0))
            if tag in MARKED and sure < ENOUGH:
                marks += 1
                part = marks
        links += tag == "a"
        stack.append((tag, sure, part, silent or tag in SILENT))
    close()
    return lines


def _windows(weights: list[float]) -> list[float]:
    """Sums of windows that start WINDOW-1 lines before the first one, so that every line has WINDOW of them."""
    return [sum(weights[max(0, k) : k + WINDOW]) for k in range(1 - WINDOW, len(weights))]


def main_text(page: str) -> str:
    lines = lines_of(page)
    marked = any(w and part for _, w, part in lines)
    weights = [w * (OUTSIDE if marked and not part else 1.0) for _, w, part in lines]
    sums = _windows(weights)
    level = RATIO * sum(s * s for s in sums) / (sum(sums) or 1.0)
    kept = set()
    for part in {p for _, _, p in lines}:
        own = [w if p == part else 0.0 for w, (_, _, p) in zip(weights, lines, strict=True)]
        high = [k + 1 - WINDOW for k, s in enumerate(_windows(own)) if s > level]
        if not high:
            continue
        if part:
            kept |= {k for k, (_, _, p) in enumerate(lines) if p == part}
        else:
            kept |= set(range(max(0, high[0]), min(len(lines), high[-1] + WINDOW)))
    return "\n".join(lines[k][0] for k in sorted(kept) if weights[k])


def _rows(batches):
    for batch in portions(batches):
        texts = [main_text(h) for h in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points for every row of pages(page_id, url, html).

    A null or empty page has an empty text. Repeated rows are extracted each; null ids and addresses stay; other
    columns are not read; an empty table gives no rows. No shuffle.
    """
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
