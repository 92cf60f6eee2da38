"""Main text of HTML pages by line-block distribution.

Markup is stripped to one line per block-level element, with a blank line for each further boundary of a
block between two lines. A line's length is that of its text; lines of mere links and of page furniture
count nothing. The lengths are summed over sliding windows of WINDOW lines: text surges where a window
rises from zero and dives where it falls back to zero. What lies between is kept

* in a page with an article or main element: of that element's lines (blank ones left out). A dive is a run
  of WINDOW or more lines of mere links, so an unmarked list of links goes, and a link between paragraphs
  stays. A stretch of which half or more is link text also needs a window of THRESHOLD;
* in other pages: where a window of the stretch reaches THRESHOLD, or where it shares a container element
  with such a stretch (an introduction that an advert parts from the body, say).

THRESHOLD is SHARE of the page's usual window sum, which is the mean over windows weighted by the sums.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) is told by element
names, and by whole class, id and role tokens of container elements: a token counts where each of its words
is a word of furniture or a neutral one, so "ad-box" does and "content-sidebar-wrap" does not. Words of the
weaker kind count inside an article only where the element is short or mostly links. Nothing that holds the
page's article is furniture, nor a form that holds most of the page's text. Scripts, styles and hidden
elements are never text.

Defined cases: null or empty html, and a page without text, give an empty text; broken and unclosed
markup is read as far as it goes; repeated rows are extracted alike; extra columns pass through; a page
of any length is one linear scan.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.runtime import prepare

#: Lines of a sliding window; the share of the usual window sum that a stretch must reach.
WINDOW, SHARE = 3, 0.2
#: The share of link text that makes a line one of mere links; the length below which a doubtful element of an article is furniture.
LINKED, SHORT = 0.8, 300

# Element names of HTML.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp", "noembed", "noframes"}
_FURNITURE = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "head", "canvas", "object", "audio", "video", "map", "datalist"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that an opening tag of the second kind ends, up to an element of the third kind.
_ENDED = [({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}), ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), ({"td", "th"}, {"td", "th", "tr"}, {"table"}), ({"tr"}, {"tr"}, {"table"})]
#: Container elements, whose class, id and role tell what they are for.
_CONTAINERS = {"article", "div", "section", "ul", "ol", "dl", "table", "header", "figure", "fieldset", "details", "span", "ins", "center"}
#: Words of furniture, those that say little of an element inside an article, those of headers, and neutral words beside them in a token.
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar cookie cookies consent gdpr popup modal newsletter comment comments commentlist disqus respond replies contentinfo pagination pager".split()
)
_WEAK = set(
    "promo banner aside footer notice notices notification alert overlay subscribe subscription signup login reply share sharing social related "
    "recommended toolbar skip search complementary dialog alertdialog".split()
)
_HEADS = {"header", "masthead"}
_NEUTRAL = set(
    "area bar block bottom box btn button buttons container fixed form global icons inner item items left link links list main media outer page panel posts "
    "primary right secondary section site slot sticky stories the top unit widget widgets wrap wrapper".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Line(NamedTuple):
    """A block's text, its characters outside links, whether it is in an article or main element, the furniture and the container that it is in,
    whether it is a main heading, and blank lines before it."""

    text: str
    plain: int
    inside: bool
    furniture: int
    container: int
    heading: bool
    blank: int


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """Whether an element is no text at all ("hidden"), furniture ("sure"), maybe furniture ("weak"), a form, or none of these ("")."""
    if tag in _FURNITURE or (tag == "header" and not inside):
        return "sure"
    found = "form" if tag == "form" else ""
    for name, value in _ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body", "main") else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "hidden"
        if name in ("class", "id", "role") and tag in _CONTAINERS:
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if not words or words - _WORDS - _WEAK - _HEADS - _NEUTRAL or (inside and words & _HEADS):
                    continue
                if words & _WORDS or words & _HEADS or (words & _WEAK and not inside):
                    return "sure"
                found = "weak" if words & _WEAK else found
    return found


def lines(page: str) -> tuple[list[Line], list[tuple[int, str]]]:
    """The lines of a page, and its furniture as (the furniture around it, kind); number 0 stands for none."""
    out: list[Line] = []
    furniture: list[tuple[int, str]] = [(0, "")]
    open_: list[tuple[str, int, int, int, bool]] = []  # tag, number, furniture, articles around and with it, whether it is inline and left out
    count: Counter[str] = Counter()
    parts: list[str] = []
    held = linked = boundaries = made = inline = muted = 0
    in_link = False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked, held, boundaries
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                # the block that holds the text is the innermost one, its container the next
                tags = [x for x in open_[-2:] if x[0] in _BLOCK]
                box = tags[0][1] if tags else 0
                around = open_[-1] if open_ else ("", 0, 0, 0, False)
                plain = 0 if linked >= LINKED * held else held - linked
                out.append(Line(text, plain, around[3] > 0, around[2], box, around[0] in ("h1", "h2"), min(WINDOW, max(0, boundaries - 2))))
                boundaries = 0
        parts, linked, held = [], 0, 0

    def close(i: int) -> None:
        nonlocal inline, muted
        for tag, *_, mute in open_[i:]:
            count[tag] -= 1
            inline -= tag not in _BLOCK
            muted -= mute
        del open_[i:]

    def ended(kinds, stops) -> None:
        if any(count[k] for k in kinds):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in kinds:
                    return close(i)
                if open_[i][0] in stops:
                    return

    while at < end:
        found = _TAG.search(page, at)
        stop = found.start() if found else end
        if stop > at and not muted:
            text = page[at:stop]
            parts.append(text)
            if not text.isspace():
                held += len(text)
                linked += len(text) if in_link else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW:
            if not found[1] and not found[3].endswith("/"):
                at = _raw_end(page, at, tag)
            continue
        if tag == "a":
            in_link = not found[1]
        elif tag in ("br", "img", "wbr", "input") and not muted:
            parts.append("" if tag == "wbr" else " ")
        block = tag in _BLOCK
        if block:
            flush()
            boundaries += 1
        if found[1]:
            if count[tag]:
                i = len(open_) - 1
                while open_[i][0] != tag:
                    i -= 1
                close(i)
            continue
        if tag in _VOID:
            continue
        if block or tag == "body":
            ended({"head"}, ())
            ended({"p"}, {"button", "table", "td"})
            for kinds, starts, stops in _ENDED:
                if tag in starts:
                    ended(kinds, stops)
        around = open_[-1] if open_ else ("", 0, 0, 0, False)
        kind = _kind(tag, found[3], around[3] > 0)
        mute = not block and kind in ("hidden", "sure")  # within a line, so left out at once
        if kind and block:
            furniture.append((around[2], kind))
        if (block or mute or inline) and not found[3].endswith("/"):
            made += 1
            open_.append((tag, made, len(furniture) - 1 if kind and block else around[2], around[3] + (tag in ("article", "main")), mute))
            count[tag] += 1
            inline += not block
            muted += mute
    flush()
    return out, furniture


def _raw_end(page: str, at: int, tag: str) -> int:
    found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return found.end() if found else len(page)


def furniture_of(found: list[Line], furniture: list[tuple[int, str]]) -> list[bool]:
    """Which pieces of furniture are left out."""
    chars, plain, article = Counter(), Counter(), Counter()
    for line in found:
        chars[line.furniture] += len(line.text)
        plain[line.furniture] += line.plain
        article[line.furniture] += len(line.text) if line.inside else 0
    for i in range(len(furniture) - 1, 0, -1):  # what is in furniture is in the furniture around it
        for sums in (chars, plain, article):
            sums[furniture[i][0]] += sums[i]
    article[0] = 0
    total = sum(len(line.text) for line in found)
    out = [False] * len(furniture)

    def decide(held: frozenset) -> None:
        for i, (around, kind) in enumerate(furniture[1:], 1):
            own = kind in ("hidden", "sure")
            if kind == "form":
                own = 2 * chars[i] < total
            elif kind == "weak":
                own = chars[i] < SHORT or 2 * plain[i] < chars[i]
            out[i] = out[around] or (own and i not in held)

    decide(frozenset())
    if any(article.values()) and not any(line.inside and not out[line.furniture] for line in found):
        # an article stands in furniture only: where it is longer than all else, that is none
        best = max(article, key=lambda i: (article[i], i))
        if article[best] > sum(len(line.text) for line in found if not out[line.furniture]):
            held, at = set(), best
            while at:
                if furniture[at][1] != "hidden":
                    held.add(at)
                at = furniture[at][0]
            decide(frozenset(held))
    return out


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Lines between each surge and the dive after it: where sums over ``window`` lines rise from zero and fall to it."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    out, start = [], None
    for i, s in enumerate(sums):
        if s > 0 and start is None:
            start = i
        elif s == 0 and start is not None:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(lengths)))
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, a line per block."""
    found, furniture = lines(page or "")
    gone = furniture_of(found, furniture)
    inside = any(line.inside and not gone[line.furniture] for line in found)
    laid: list[Line | None] = []
    for line in found:
        if inside and not (line.inside and not gone[line.furniture]):
            continue
        laid += [*[None] * (0 if inside else line.blank), line]
    lengths = [0 if x is None or gone[x.furniture] else len(x.text) if x.heading or x.plain else 0 for x in laid]
    # inside an article only a whole window of links is a dive, at its end as elsewhere
    regions = [(a, min(b, len(laid))) for a, b in stretches(lengths + [1] * (WINDOW - 1) * inside)]
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    threshold = SHARE * sum(s * s for s in sums) / max(1, sum(sums))
    kept, boxes = [], set()
    for a, b in regions:
        while a < b and not lengths[a] and (a or not inside):
            a += 1
        while a < b and not lengths[b - 1] and not inside:
            b -= 1
        own = [x for x in laid[a:b] if x is not None and not gone[x.furniture]]
        high = max(sums[a:b], default=0) >= threshold
        if inside:
            high = high or 2 * sum(x.plain for x in own) > sum(len(x.text) for x in own)
        elif high:
            boxes.update(x.container for x in own)
        kept.append((own, high))
    return "\n".join(x.text for own, high in kept if high or any(x.container in boxes for x in own) for x in own)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out``; a map without a shuffle."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in column], dtype=object)

    return pages.withColumn(out, run(F.col(html_col)))
