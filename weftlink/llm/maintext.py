"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block of text. A line counts its characters, or none if it stands in a menu, a
notice or the like, or mostly in links outside an article. Sums over a window of WINDOW lines surge where text begins and
dive where WINDOW lines in a row count nothing; the counted lines between a surge and its dive are kept. Where article
elements hold most of the counted text, their lines weigh twice and others half, and their borders are dives too.
Headings right before a kept region are kept with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; characters of a window from which text surges (a page's best window always does).
WINDOW, SURGE = 3, 86

# Elements by what they are to a reader.
RAW = frozenset("script style noscript template svg math textarea select iframe object canvas audio video head title option datalist".split())
CODE = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav footer aside form button menu dialog label fieldset".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist reply replies disqus respond discussion footer masthead topbar toolbar share sharing social related recommended recommendations login search pagination pager skip copyright legal disclaimer tracking".split()
)
#: What may stand beside such a word in a class or id, as in `site-footer` or `comment-list-2`; any other word, as in
#: `side-effects`, makes it a name of its own.
BESIDE = frozenset(
    "a area article articles bar bars blog body bottom box boxes btn button buttons column container content desktop entry floating form global group head holder icon icons inner item items js left link links list lists main message messages mobile module news outer page pages panel post posts primary region right row secondary section site slot sticky stories story tag tags text thread title top unit user w wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements whose start ends an open one of the second kind, unless one of the third stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"[>\"']")
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
GAP = re.compile(r"\s+")


def _names(value: str) -> Iterator[set[str]]:
    """The words of each class or id in an attribute's value."""
    for name in value.split():
        yield {w.lower() for w in PIECE.findall(name)}


def _chrome(tag: str, attrs: str, inside: bool) -> bool:
    """Whether the element isn't main text; inside: it stands in the article, whose own header is."""
    if tag in CHROME or tag == "header" and not inside:
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES and not (value.lower() == "banner" and inside):
            return True
        if name not in ("class", "id") or tag in ("body", "html", "main"):
            continue
        for words in _names(value):
            if tag == "article":
                if words & {"comment", "comments", "reply", "ad", "ads", "related", "teaser"}:
                    return True
            elif "header" in words and not inside and tag not in HEADINGS or words & WORDS and not {w for w in words - WORDS - BESIDE if not w.isdigit()}:
                return True
    return False


def _behind(html: str, tag: str, at: int, unclosed: set[str]) -> int:
    """Where the page goes on behind an element whose content isn't read. One that is never closed is only its tag, so
    that nothing after it is lost; but code runs to the page's end. A head ends at the body, an option at its list's end."""
    if tag in unclosed:
        return at
    more = {"option": "|</select|<option\\b", "head": "|<body\\b"}.get(tag, "")
    end = re.compile(rf"</{tag}\s*>{more}", re.I).search(html, at)
    if not end:
        unclosed.add(tag)
        return len(html) if tag in CODE else at
    return end.end() if end[0].lower().startswith(f"</{tag}") else end.start()


class Scanner:
    """Markup of a page, in turn. Each character is looked at a bounded number of times, however broken the markup is:
    what was sought once and isn't there is not sought again."""

    def __init__(self, html: str):
        self.html, self.gone = html, {}

    def find(self, what: str, at: int) -> int:
        """The next place of `what`, or -1."""
        if at >= self.gone.get(what, len(self.html) + 1):
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.gone[what] = at
        return k

    def end(self, at: int) -> int:
        """Behind the > that ends the tag whose attributes begin at `at`, or -1. A quote that is never closed is an
        ordinary character."""
        while m := QUOTE.search(self.html, at) if self.find(">", at) >= 0 else None:
            if m[0] == ">":
                return m.end()
            at = self.find(m[0], m.end()) + 1 or m.end()
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name, whether it closes, attributes of the next tag from `at` on; with an empty name a comment,
        a declaration or a tag cut off by the page's end."""
        while (k := self.find("<", at)) >= 0:
            html = self.html
            if html.startswith("<!--", k):
                stop = self.find("-->", k + 4)
                return k, stop + 3 if stop >= 0 else self.find(">", k) + 1 or len(html), "", False, ""
            if html.startswith("<![CDATA[", k):
                return k, self.find("]]>", k) + 3 if self.find("]]>", k) >= 0 else self.find(">", k) + 1 or len(html), "", False, ""
            m = NAME.match(html, k + 1)
            if m:
                stop = self.end(m.end())
                if stop >= 0:
                    return k, stop, m[1].lower(), html[k + 1] == "/", html[m.end() : stop - 1]
                if self.find("<", k + 1) < 0:
                    return k, len(html), "", False, ""
            elif html[k + 1 : k + 2] in ("!", "?", "/"):
                return k, self.find(">", k) + 1 or len(html), "", False, ""
            at = k + 1
        return None


def lines(html: str) -> list[tuple[str, bool, bool, int, bool]]:
    """The blocks of text in page order: text, whether it stands in the page's surroundings, whether in an article, how
    many of its characters are in links, and whether it is a heading."""
    out: list[tuple[str, bool, bool, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, surroundings, article
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = GAP.sub(" ", unescape("".join(parts))).strip()
            if text:
                tag, off, inside = stack[-1] if stack else ("", False, False)
                out.append((text, off, inside, len(GAP.sub(" ", unescape("".join(linked))).strip()), tag in HEADINGS))
        parts, linked = [], []

    def close(names: set[str] | frozenset[str], within: set[str] | frozenset[str] = frozenset()) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return True
            if stack[k][0] in within:
                return False
        return False

    scan, at, begin = Scanner(html), 0, 0
    while True:
        found = scan.next(at)
        text = html[begin : found[0] if found else len(html)]
        if text:
            parts.append(text)
            if links:
                linked.append(text)
        if not found:
            break
        _, at, tag, closes, attrs = found
        begin = at
        if not tag:
            continue
        if closes:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                close({tag})
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                at = begin = _behind(html, tag, at, unclosed)
            continue
        if tag == "a":
            links = 1
        if tag not in BLOCK:
            continue
        flush()
        if tag in VOID:
            continue
        close({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            close(*ENDS[tag])
        _, off, inside = stack[-1] if stack else ("", False, False)
        off = off or _chrome(tag, attrs, inside)
        stack.append((tag, off, inside or (tag in CONTENT and not off)))
        links = 0
    flush()
    return out


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page: kept blocks joined by line feeds."""
    found = lines(html)
    size = [0 if off or (2 * k > len(t) and not inside) else len(t) for t, off, inside, k, _ in found]
    article = sum(n for n, line in zip(size, found, strict=True) if line[2])
    prefer = 2 * article > sum(size)  # else the article elements are teasers, or a part of the text
    weight = [n * (2 if not prefer else 4 if line[2] else 1) for n, line in zip(size, found, strict=True)]
    cuts = [k for k in range(1, len(found)) if prefer and found[k][2] != found[k - 1][2]]
    stop = [b for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True) for _ in range(a, b)]
    sums = [sum(weight[i : min(i + window, stop[i])]) for i in range(len(size))]
    need = min(2 * surge, max(sums, default=0))
    kept: list[int] = []
    i = 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        j = i  # the region's dive: a window that counts nothing, or the article's border
        while j < stop[i] and sums[j]:
            j += 1
        if max(sums[i:j]) >= need:
            last, k, heads = kept[-1] if kept else -1, i - 1, []
            while k > last and i - k <= window + len(heads) and (not size[k] or found[k][4]):
                if size[k]:
                    heads.append(k)
                k -= 1
            kept += [*reversed(heads), *(k for k in range(i, j) if size[k])]
        i = j
    return "\n".join(found[k][0] for k in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (its code points) of each row of pages(page_id, url, html, ...).

    A null html is empty. Markup may be broken anywhere, and may end in the middle of a tag. Repeated rows each get a
    row; other columns are ignored; no rows give none.
    """
    one = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return one.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
