"""Main text of web pages from streaming parser events.

``html.parser`` events cut a page into lines (blocks); each line gets its text to
tag ratio; ratios are smoothed along the page with a Gaussian kernel and split by
a two-means threshold. A region - the lines of one article or main element, or
of one run between page furniture - is content if lines above the threshold hold
most of its text, or if no region does better; the whole region is then kept, so
its short lines stay. Furniture (menus, headers, footers, asides, forms, scripts,
adverts, notices, comments, by element or role) never belongs to a region. A class
or id made of furniture words alone (``comment-list``) counts as furniture; one
that only holds such a word (``share-price``) makes a region of its own, which
stays if the region around it does and the ratio finds it dense. Headings are
never judged by their class. A line outside an article that begins with a copyright
mark and a year is a notice. Only blocks end a line: a script, a picture's code or a
hidden span inside a paragraph leaves it whole.

Defined results. Null or empty html, or no content: empty text. A null
``page_id`` or ``url`` stays null, repeated rows repeat, equal pages get equal
texts, an empty table gives no rows, other columns are ignored. Unclosed and stray
tags and malformed declarations are tolerated (the latter end at the next ``>``);
no text is cut or capped, and the work is linear in the page's length. Regions of
equal density: the longer, then the earlier.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
LENIENT = 3  #: how far below the threshold a block with a doubtful class may lie inside content
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NO_TEXT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "textarea", "button", "canvas", "math"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: a part of a class or id that names furniture
WORD = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|side-?bar|widget|cookies?|consent|gdpr|notice|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|copyright|toolbar|pagination|pager|skip|skip-?link",
    re.I,
)
#: parts that say where or how, not what
PLACE = re.compile(
    r"\d+|site|page|main|top|bottom|left|right|inner|outer|wrap\w*|container|area|box|bar|block|panel|list|items?|links?|buttons?|icons?|slot|unit|module|group|"
    r"form|posts?|articles?|content|fixed|sticky|primary|secondary|global|js|id|thread|reader|user|media|text|title|body|row|col",
    re.I,
)
SAYS_NO = re.compile(r"(?:has|with|without|no|is)[-_].*", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: a mark and a year, as notices have it; prose that begins with the word is no notice
NOTICE = re.compile(r"(?:(?:©|\(c\)|copyright)\W*)+(?:19|20)\d\d\b", re.I)
READER = re.compile(r"comment|repl(?:y|ies)|review", re.I)
#: end tags that a start tag implies
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: an implied end reaches no further than these
BARRIER = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th", "blockquote", "aside", "nav", "form", "header", "footer"}


REACHED = BARRIER.union(*CLOSES.values())


def hint(names: str) -> str:
    """``furniture``, ``perhaps`` or nothing, by the tokens of class and id."""
    found = ""
    for token in names.split():
        if SAYS_NO.fullmatch(token):
            continue
        parts = [x for x in re.split(r"[-_]+", token) if x]
        named = [WORD.fullmatch(x) is not None for x in parts]
        if WORD.fullmatch(token) or (any(named) and all(n or PLACE.fullmatch(x) for n, x in zip(named, parts))):
            return "furniture"
        if any(named):
            found = "perhaps"
    return found


class _Lines(HTMLParser):
    """Turns events into lines (text, tags, links, region)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, hides all below, opens a region of its own, to be judged by its ratio
        self.count: Counter = Counter()
        self.marks: list[int] = []  # places in the stack of tags that an implied end may reach or stop at
        self.hidden = self.regions = self.inside = 0
        self.region = [0]
        self.opened: set[int] = set()
        self.around: dict[int, int] = {}  # region to be judged -> the one around it
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)  # as browsers do, to the next >

    def end_line(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            if self.inside or not NOTICE.match(text):
                self.lines.append((text, self.tags, self.linked, self.region[-1]))
            self.tags = self.linked = 0
        self.parts = []

    def new_region(self) -> None:
        self.regions += 1
        self.region.append(self.regions)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += not self.hidden
        if tag in BLOCK:
            self.end_line()
            if tag in CLOSES:
                if any(self.count[x] for x in CLOSES[tag]):
                    for i in reversed(self.marks):
                        if self.stack[i][0] in CLOSES[tag]:
                            self.close_to(i)
                            break
                        if self.stack[i][0] in BARRIER:
                            break
            else:  # a block ends an open paragraph close above
                for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 5), -1):
                    if self.stack[i][0] == "p":
                        self.close_to(i)
                        break
                    if self.stack[i][0] in BARRIER:
                        break
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        held = dict(attrs)
        names = f"{held.get('class') or ''} {held.get('id') or ''}"
        if tag in ("article", "main", "body", "html") or tag in HEADINGS:
            hinted = "furniture" if tag == "article" and READER.search(names) else ""
        else:
            hinted = hint(names)
        # A heading's own header element inside an article is part of it.
        furniture = tag in FURNITURE and not (tag == "header" and self.inside)
        hides = tag in NO_TEXT or furniture or (held.get("role") or "").lower() in ROLES or "hidden" in held or held.get("aria-hidden") == "true"
        hides = hides or re.search(r"display\s*:\s*none", held.get("style") or "") is not None or hinted == "furniture"
        opens = tag in ("article", "main") and not hides
        judged = hinted == "perhaps" and not hides and tag in BLOCK
        if hides:  # what is hidden inside a line doesn't end it
            self.hidden += 1
            if tag in BLOCK:
                self.new_region()
        elif opens or judged:
            around = self.region[-1]
            self.new_region()
            if opens:
                self.opened.add(self.regions)
                self.inside += 1
            else:
                self.around[self.regions] = around
        self.in_link += tag == "a"
        if tag in REACHED:
            self.marks.append(len(self.stack))
        self.count[tag] += 1
        self.stack.append((tag, hides, opens, judged))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def close_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag, hides, opens, judged = self.stack.pop()
            self.count[tag] -= 1
            if tag in REACHED:
                self.marks.pop()
            if tag in BLOCK:
                self.end_line()
            if hides:
                self.hidden -= 1
            if hides and tag in BLOCK:
                self.region.pop()
                if not self.inside and self.region[-1] not in self.around:
                    self.regions += 1
                    self.region[-1] = self.regions
            elif opens or judged:
                self.region.pop()
                self.inside -= opens
            self.in_link -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.hidden
        if self.count[tag]:
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            self.close_to(i)
        elif tag in BLOCK:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, int(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        ks = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(k * v for k, v in zip(ks, values[lo:hi])) / sum(ks))
    return out


def threshold(values: list[float]) -> float:
    """The border between the two clusters of ``values`` (two means on logarithms)."""
    logs = [math.log1p(v) for v in values]
    low, high = min(logs), max(logs)
    for _ in range(30):
        cut = (low + high) / 2
        under, over = [v for v in logs if v <= cut], [v for v in logs if v > cut]
        if not under or not over:
            break
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            break
        low, high = new
    return math.expm1((low + high) / 2) if high - low > 0.7 else 0.0


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratio = [max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _ in lines]
    smooth = smoothed(ratio)
    cut = threshold(smooth)
    total: dict[int, int] = {}
    dense: dict[int, int] = {}
    for (text, _, _, region), r, s in zip(lines, ratio, smooth):
        # A region to be judged is one or few lines: its own ratio counts, and it need not be as long as the article's others.
        s = LENIENT * max(r, s) if region in parser.around else s
        total[region] = total.get(region, 0) + len(text)
        dense[region] = dense.get(region, 0) + (len(text) if s >= cut else 0)
    judged = parser.around
    whole = [r for r in total if r not in judged]
    best = max(whole or total, key=lambda r: (dense[r], total[r], -r))
    opened = parser.opened & set(total)
    close = lambda r: dense[r] >= 0.5 * total[r]
    kept = {r for r in whole if r == best or (close(r) and (r in opened or not opened))}
    # Regions are numbered as they open, so the one around is settled first.
    for r in sorted(judged):
        around = judged[r]
        if r in total and close(r) and (around in kept or (around not in total and (around in parser.opened or not opened))):
            kept.add(r)
    return "\n".join(t for t, _, _, region in lines if region in kept or (not whole and region == best))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(extract, na_action=None)

    out = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
