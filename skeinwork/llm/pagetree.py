"""The main body of a web page, by scores that paragraphs pass to the elements around them."""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass
from functools import lru_cache

import xxhash

from skeinwork.llm.words import closed

# HTML element names by their role in a page.
BLOCKS = frozenset(
    "html body div section article main aside header footer nav table thead tbody tfoot tr td th caption ul ol dl li dt dd p h1 h2 h3 h4 h5 h6 "
    "blockquote pre form fieldset figure figcaption center address details summary menu".split()
)
PARAGRAPHS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption caption summary address".split())
CONTAINERS = frozenset("body div section article main aside header footer nav td th form fieldset center figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("aside footer nav menu header form".split())
VOID = frozenset("img input meta link hr wbr area base col embed source track param".split())
SKIPPED = ("script", "style", "noscript", "template", "head", "svg", "iframe", "select", "textarea")
# What an open element of the first kind ends at the start of one of the second.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "p": BLOCKS}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "p": frozenset(["td", "th", "table"])}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<skip>" + "|".join(SKIPPED) + r")\b[^>]*>.*?(?:</(?P=skip)\s*>|\Z)|<!(?:doctype)[^>]*>|<\?[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>[^>]*)>",
    re.S | re.I,
)
HREF = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|\bhidden\b|aria-hidden\s*=\s*.true", re.I)
PALE = re.compile(r"""color\s*[=:]\s*["']?\s*(?:#f[a-f0-9]f[a-f0-9]f[a-f0-9]\b|#fff\b|white\b)""", re.I)
MIN_TEXT, HEADLINE = 25, 20.0


def _hides(attrs: str) -> bool:
    """Whether attributes keep an element from being seen."""
    low = attrs.lower()
    return ("style" in low or "hidden" in low or "color" in low) and bool(HIDING.search(attrs) or PALE.search(attrs))


def _link_kind(attrs: str) -> str:
    """``inner`` or ``outer`` for the target of a link, empty without one."""
    at = attrs.find('href="')
    if at >= 0:
        to = attrs[at + 6 : at + 16].lstrip()
    elif h := HREF.search(attrs):
        to = (h.group(1) or h.group(2) or h.group(3) or "").strip()
    else:
        return ""
    return "outer" if to.startswith(("http://", "https://", "//")) else "inner"


@dataclass(slots=True)
class Segment:
    """Text of one paragraph, heading, list item or line. ``inner`` / ``outer``: characters in links to the page's own site /
    elsewhere."""

    node: int
    line: int
    text: str
    inner: int
    outer: int
    hidden: bool


class Page:
    """Block elements (``tags``, ``parents``, ``holders``: has block children) and segments of a page."""

    def __init__(self, source: str, by_line: bool) -> None:
        tags, parents, holders, hidden = ["#"], [0], [False], [False]
        self.tags, self.parents, self.holders, self.hidden = tags, parents, holders, hidden
        self.segments: list[Segment] = []
        self.marks: list[bool] = []
        stack, line, at = [0], 0, 0
        text: list[str] = []
        inner = outer = 0
        seen_hidden = True
        link = ""
        veils: list[str] = []
        first_line = 0

        def flush() -> None:
            nonlocal inner, outer, seen_hidden
            if text:
                t = "".join(text)
                if "&" in t:
                    t = html.unescape(t)
                t = " ".join(t.split())
                if t:
                    self.segments.append(Segment(stack[-1], first_line, t, inner, outer, seen_hidden))
                text.clear()
            inner = outer = 0
            seen_hidden = True

        def add(piece: str) -> None:
            nonlocal inner, outer, seen_hidden, first_line
            size = len(piece.strip())
            if not size:
                if text:
                    text.append(" ")
                return
            if not text:
                first_line = line
            text.append(piece)
            if link == "inner":
                inner += size
            elif link == "outer":
                outer += size
            if not veils and not hidden[stack[-1]]:
                seen_hidden = False

        def feed(piece: str) -> None:
            nonlocal line
            if by_line and "\n" in piece:
                parts = piece.split("\n")
                add(parts[0])
                for p in parts[1:]:
                    flush()
                    line += 1
                    add(p)
            else:
                add(piece)

        source = closed(source)
        for m in TOKEN.finditer(source):
            begin, end = m.span()
            if begin > at:
                feed(source[at:begin])
            at = end
            tag, slash, attrs = m.group("tag", "end", "attrs")
            if by_line and "\n" in m.group():
                flush()
                line += m.group().count("\n")
            if tag is None:
                add(" ")
                continue
            tag = tag.lower()
            if tag in VOID:
                continue
            if tag == "br":
                flush()
                continue
            closing = slash == "/"
            if tag not in BLOCKS:
                if tag == "a":
                    link = ""
                    if not closing:
                        link = _link_kind(attrs)
                if closing:
                    if veils and veils[-1] == tag:
                        veils.pop()
                elif attrs and _hides(attrs):
                    veils.append(tag)
                if tag in ("td", "span", "option"):
                    add(" ")
                continue
            flush()
            link = ""
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            for k in range(len(stack) - 1, 0, -1):
                open_tag = tags[stack[k]]
                if open_tag in ENDS and tag in ENDS[open_tag]:
                    del stack[k:]
                    break
                if tag in SCOPE and open_tag in SCOPE[tag] or (tag not in SCOPE and open_tag not in PARAGRAPHS):
                    break
            up = stack[-1]
            holders[up] = True
            tags.append(tag)
            parents.append(up)
            holders.append(False)
            hidden.append(hidden[up] or bool(attrs and _hides(attrs)))
            stack.append(len(tags) - 1)
        if at < len(source):
            feed(source[at:])
        flush()

    def mark(self, recurring: Container[int]) -> None:
        """Marks the segments that are furniture: bylines, and lines whose shape is one of ``recurring``."""
        self.marks = [self.tags[s.node] not in SHORT_FORMS and (dated(s.text) or line_shape(s.text) in recurring) for s in self.segments]

    def containers(self) -> list[int]:
        """For each segment the element that its points go to."""
        alone: dict[int, int] = {}
        for s in self.segments:
            alone[s.node] = alone.get(s.node, 0) + 1
        out = []
        for s in self.segments:
            n = s.node
            tag = self.tags[n]
            if tag in CONTAINERS and tag != "body" and alone[n] == 1 and not self.holders[n]:
                n = self.parents[n]
            while n and self.tags[n] not in CONTAINERS:
                n = self.parents[n]
            out.append(n)
        return out

    def within(self, roots: set[int]) -> list[bool]:
        """For each element whether it is one of ``roots`` or inside one; parents come before children."""
        inside = [False] * len(self.tags)
        for n in range(1, len(self.tags)):
            inside[n] = n in roots or inside[self.parents[n]]
        return inside


def main_body(page: Page, heard: bool = False) -> list[int]:
    """Indices of the segments of the page's main body.

    A paragraph of at least ``MIN_TEXT`` characters is worth 1 + its commas + up to 3 for its length, less its share of
    text in links to the own site. The element around it gets that, the next one half of it (not
    the page as a whole, which would win by default); a page's headline adds ``HEADLINE``; furniture adds nothing. Scores are discounted by the element's own link density. The best element is kept, and siblings that score
    at least half of it with paragraphs of like length; navigation, asides, headers and footers never count. ``heard``: also
    count text that is hidden from readers, and all text by its length.
    """
    segments, homes, marks = page.segments, page.containers(), page.marks
    n = len(page.tags)
    aside = page.within({i for i in range(1, n) if page.tags[i] in ASIDE})
    score, chars, linked, count = [0.0] * n, [0] * n, [0] * n, [0] * n
    for s, home, mark in zip(segments, homes, marks, strict=True):
        if aside[s.node] or (s.hidden and not heard):
            continue
        size = len(s.text)
        k = home
        while k:
            chars[k] += size
            linked[k] += min(s.inner, size)
            k = page.parents[k]
        if page.tags[s.node] == "h1":
            score[home] += HEADLINE
        elif size >= MIN_TEXT and page.tags[s.node] not in HEADINGS and not mark:
            points = (1 + s.text.count(",") + (size / 100 if heard else min(size / 100, 3.0))) * (1 - min(s.inner, size) / size)
            score[home] += points
            count[home] += 1
            up = page.parents[home]
            while up and page.tags[up] not in CONTAINERS:
                up = page.parents[up]
            if page.tags[up] != "body":
                score[up] += points / 2
        elif heard and size < MIN_TEXT and not mark:
            score[home] += size / 100 * (1 - min(s.inner, size) / size)
    for k in range(1, n):
        if chars[k]:
            score[k] *= 1 - linked[k] / chars[k]
    best = max(range(1, n), key=lambda k: score[k], default=0)
    if not best or score[best] <= 0:
        return [i for i, s in enumerate(segments) if not aside[s.node] and (heard or not s.hidden)]
    own = [0] * n
    for s, home in zip(segments, homes, strict=True):
        if len(s.text) >= MIN_TEXT:
            own[home] += len(s.text)
    mean = own[best] / max(count[best], 1)
    roots = {best}
    for k in range(1, n):
        if k != best and page.parents[k] == page.parents[best] and score[k] >= 0.5 * score[best] and count[k] and own[k] / count[k] >= 0.75 * mean and linked[k] * 10 <= chars[k]:
            roots.add(k)
    inside = page.within(roots)
    return [i for i, s in enumerate(segments) if inside[s.node] and not aside[s.node] and (heard or not s.hidden)]


# How dates are written.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec"
DATE = re.compile(rf"\b\d{{1,2}}\.? (?:{MONTHS})\.?,? \d{{4}}\b|\b(?:{MONTHS})\.? \d{{1,2}},? \d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}\b", re.I)
FIGURES = frozenset("0123456789")
#: Words of a line with a date that is no sentence, at most, and of a recurring line without names or figures, at least.
BYLINE_WORDS, LEAST_WORDS = 12, 5
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
#: Headings, items and cells repeat themselves ("Sources", "0") without being furniture.
SHORT_FORMS = HEADINGS | frozenset("li td th dt dd blockquote pre caption figcaption summary".split())


@lru_cache(maxsize=1 << 15)
def line_shape(text: str) -> int | None:
    """A hash of a line's wording: lower-cased, every number one sign, every run of names (capitals within the line) another.

    None for lines that say too little to be told from one another: of less than ``LEAST_WORDS`` words, none of them a name or number.
    """
    out: list[str] = []
    words = slots = 0
    for w in PIECE.findall(text):
        if w[0].isdigit():
            w = "0"
            slots += 1
        elif w[0].isalpha():
            words += 1
            if w[0].isupper() and out:
                w = "X"
                slots += 1
                if out[-1] == "X":
                    continue
            else:
                w = w.lower()
        out.append(w)
    if not slots and words < LEAST_WORDS:
        return None
    return xxhash.xxh3_64_intdigest(" ".join(out)) - 2**63


@lru_cache(maxsize=1 << 15)
def dated(text: str) -> bool:
    """Whether a line is a byline by its form: short, with a date, and no sentence."""
    return not FIGURES.isdisjoint(text) and not text.endswith((".", "!", "?")) and bool(DATE.search(text)) and len(text.split()) <= BYLINE_WORDS


def line_contexts(page: Page) -> set[tuple[int, int]]:
    """The shape of every line of a page, with a hash of the line before it."""
    out, before = set(), 0
    for s in page.segments:
        if page.tags[s.node] not in SHORT_FORMS and (shape := line_shape(s.text)) is not None:
            out.add((shape, before))
        before = xxhash.xxh3_64_intdigest(s.text) - 2**63
    return out


def article_segments(page: Page, recurring: Container[int] = (), heard: bool = False) -> list[int]:
    """Segments of the main body without furniture: bylines, and lines whose shape is one of ``recurring``."""
    page.mark(recurring)
    return [i for i in main_body(page, heard) if not page.marks[i]]
