"""Main text of web pages by composite text density.

A page becomes a tree of elements (numbered in page order, so that a parent comes before its children).  For every element
the density is its characters per tag, adjusted by how many of both are links'.  An element's density sum adds up its
children's densities, each run of its own text counting as a child.  The subtree of the greatest sum is the main text; the
least density on its way up to the body is the threshold for further subtrees.  Parts that say what they are (menus, page
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles) leave the tree before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relief.llm.common import bounded_slices

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: their content isn't markup
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " template tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre blockquote".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: elements that an end tag inside them doesn't reach out of
SCOPE = frozenset("table td th caption button object".split())
#: what an element's start ends, up to which container: an open element of the first kinds above the nearest of the second
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    **{part: (("thead", "tbody", "tfoot"), ("table",)) for part in ("thead", "tbody", "tfoot")},
}
#: never main text, wherever they stand
DROPPED_TAGS = frozenset(
    "head script style title noscript template iframe object embed svg canvas audio video map"
    " nav footer aside dialog search form button select input textarea".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar tablist toolbar status".split())
#: classes and ids by which a part says that it isn't main text; before them anything joined by - or _, behind them only
#: words of layout
DROPPED_NAMES = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination"  # menus
    " footer copyright"  # footers
    " sidebar aside related recommended"  # sidebars
    " notice notices cookie cookies consent gdpr newsletter popup modal overlay toast"  # notices
    " ad ads advert adverts advertisement advertising adsense sponsor sponsored promo"  # adverts
    " searchbox login signup search-form"  # forms
    " share sharing social"
).split()
COMMENTS = "comment comments commentlist disqus".split()
HEADERS = "header masthead topbar".split()
LAYOUT = (
    "area bar block body bottom box col column container content count desktop feed form group inner item items large left link links list main"
    " message mobile notice outer panel primary right row secondary section sidebar slot small sticky text thread top unit widget wrap wrapper"
).split()


def _named(names: list[str]) -> re.Pattern:
    name, layout = ("|".join(map(re.escape, words)) for words in (names, LAYOUT))
    return re.compile(rf"(?!(?:has|no|non|not|with|without|show|hide)[-_])(?:[a-z0-9]+[-_])*(?:{name})(?:[-_](?:{layout}|[0-9x]+))*\Z")


_DROPPED, _COMMENTS, _HEADERS = _named(DROPPED_NAMES), _named(COMMENTS), _named(HEADERS)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes), ("end", tag, ""); comments and declarations are left out.

    A tag, comment or raw element that the page's end cuts off takes the rest with it.  Every character is read a bounded
    number of times.
    """
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:]), ""
            return
        after = html[lt + 1 : lt + 2]
        if after == "/":
            after = html[lt + 2 : lt + 3]
            if not (after.isascii() and after.isalpha()):
                after = "?"  # not an end tag: a comment up to >
        is_tag, is_comment = after.isascii() and after.isalpha(), after in ("!", "?")
        if not is_tag and not is_comment:
            yield "text", unescape(html[at:lt]) + "<", ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", unescape(html[at:lt]), ""
        if is_comment:
            if html.startswith("<!--", lt):
                short = re.compile(r"-?>").match(html, lt + 4)
                end = short.end() if short else min((k + n for k, n in ((html.find("-->", lt + 4), 3), (html.find("--!>", lt + 4), 4)) if k >= 0), default=size)
            else:
                end = html.find(">", lt) + 1 or size
            at = end
            continue
        m = TAG.match(html, lt)
        if m is None:
            return
        name, at = m[1].lower(), m.end()
        if html[lt + 1] == "/":
            yield "end", name, ""
            continue
        yield "start", name, m[2]
        if name in RAW:
            close = _RAW_END[name].search(html, at)
            if close is None:
                return
            at = close.start()


class Page:
    """Elements in page order: tag, parent, whether they leave (anywhere, or as headers outside an article); ``runs``: (element, text), text None where a block starts or ends."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names_itself, self.dropped, self.header = ["body"], [0], [False], [False], [False]
        self.runs: list[tuple[int, str | None]] = []
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of open elements in ``open``, by tag
        self.blocks, self.scopes = [0], [0]
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self._text(value)
            elif kind == "start":
                self._start(value, attributes)
            else:
                self._end(value)
        self._settle()

    def _text(self, text: str) -> None:
        if self.tag[self.open[-1]] == "head" and not text.isspace():
            self._close_to(len(self.open) - 1)
        self.runs.append((self.open[-1], text))

    def _place(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else -1

    def _close_to(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        while len(self.open) > place:
            node = self.open.pop()
            tag = self.tag[node]
            self.places[tag].pop()
            for kind, held in ((BLOCK, self.blocks), (SCOPE, self.scopes)):
                if tag in kind:
                    held.pop()
            if tag in BLOCK:
                self.runs.append((node, None))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if tag == "body" and self._place("head") >= 0:
                self._close_to(self._place("head"))
            return
        if self.tag[self.open[-1]] == "head" and tag not in HEAD:
            self._close_to(len(self.open) - 1)
        if tag in BLOCK and self._place("p") > self.scopes[-1]:
            self._close_to(self._place("p"))
        if tag in ENDS:
            ended, within = ENDS[tag]
            place, limit = max(map(self._place, ended)), max(map(self._place, within))
            if place > limit and (tag in TABLE or place > self.scopes[-1]):
                self._close_to(place)
        if tag in HEADING and self.tag[self.open[-1]] in HEADING:
            self._close_to(len(self.open) - 1)
        if tag == "br":
            self.runs.append((self.open[-1], " "))
            return
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        named, dropped, header = self._says(tag, attributes)
        self.names_itself.append(named)
        self.dropped.append(dropped)
        self.header.append(header)
        if tag in BLOCK:
            self.runs.append((node, None))
        if tag in VOID:
            return
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.open.append(node)

    def _end(self, tag: str) -> None:
        place = self._place(tag)
        # an inline element's end doesn't end blocks opened in it, a cell's content doesn't end what is around its table
        limit = self.scopes[-1] if tag in BLOCK else self.blocks[-1]
        if place > limit or (place > 0 and (tag in TABLE or tag in SCOPE)):
            self._close_to(place)

    def _says(self, tag: str, attributes: str) -> tuple[bool, bool, bool]:
        """(does a name mark the element as something else than main text, does it leave for any reason, is it a header).

        An article or main element is only taken at its name when that says comments."""
        named = hidden = False
        header, role = tag == "header", ""
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    for name in value.lower().split():
                        named |= bool(_COMMENTS.match(name)) or (tag not in ("article", "main") and bool(_DROPPED.match(name)))
                        header |= tag not in ("article", "main") and bool(_HEADERS.match(name))
                elif key == "role":
                    role = value.strip().lower()
                elif key == "hidden" or (key == "style" and HIDDEN.search(value)):
                    hidden = True
        return named, named or hidden or tag in DROPPED_TAGS or role in DROPPED_ROLES, header

    def _settle(self) -> None:
        """What leaves although, or stays because, of what it holds."""
        n = len(self.tag)
        own = [0] * n
        for node, text in self.runs:
            if text is not None:
                own[node] += _chars(text)
        # an element that holds an article or main element isn't a menu or form, whatever it is called
        holds, paragraph, chars = [False] * n, [False] * n, own[:]
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            holds[up] |= holds[k] or (self.tag[k] in ("article", "main") and not self.names_itself[k])
            paragraph[up] |= paragraph[k] or self.tag[k] in PARAGRAPH
            chars[up] += chars[k]
        inside = [False] * n  # an article or main element
        for k in range(1, n):
            inside[k] = inside[self.parent[k]] or self.tag[k] in ("article", "main")
            # a whole page can be one form; a header outside the article is the page's
            whole = self.tag[k] == "form" and paragraph[k] and 2 * chars[k] > chars[0]
            self.dropped[k] = (self.dropped[k] or (self.header[k] and not inside[k])) and not holds[k] and not whole
            self.dropped[k] |= self.dropped[self.parent[k]]
        self.own, self.inside = own, inside


def _chars(text: str) -> int:
    return len("".join(text.split()))


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Composite text density: characters per tag times a logarithm of how few of both are links'.

    ``page_share``: share of link characters in the body.  Zero counts as one in denominators.  The published base of
    the logarithm is 1 on a page without links; e squared in the place of e keeps it at 2 or more.
    """
    if not chars:
        return 0.0
    tags, links, others = max(tags, 1), max(link_chars, 1), max(chars - link_chars, 1)
    base = log(chars / others * link_chars + page_share * chars + e * e)
    return chars / tags * max(0.0, log(chars / links * tags / max(link_tags, 1))) / log(base)


def select(page: Page) -> list[int]:
    """Elements whose subtrees are the main text."""
    n = len(page.tag)
    live = [not d for d in page.dropped]
    chars = [c if keep else 0 for c, keep in zip(page.own, live, strict=True)]
    link = [False] * n
    for k in range(1, n):
        link[k] = link[page.parent[k]] or page.tag[k] == "a"
    link_chars = [c if is_link else 0 for c, is_link in zip(chars, link, strict=True)]
    tags, link_tags, paragraph = [0] * n, [0] * n, [False] * n
    for k in range(n - 1, 0, -1):
        if live[k]:
            up = page.parent[k]
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (page.tag[k] == "a")
            paragraph[k] |= page.tag[k] in PARAGRAPH
            paragraph[up] |= paragraph[k]
    if not chars[0]:
        return []
    share = link_chars[0] / chars[0]
    dense = [density(*counts, share) for counts in zip(chars, tags, link_chars, link_tags, strict=True)]
    total = [0.0] * n
    for node, text in page.runs:
        if text is not None and live[node] and not link[node]:
            c = _chars(text)
            total[node] += density(c, 1, 0, 0, share)
    for k in range(1, n):
        if live[k]:
            total[page.parent[k]] += dense[k]
    best = max(range(n), key=lambda k: (total[k] if live[k] else -1.0, -k))
    if not total[best]:
        return [0]
    way = [best]
    while way[-1]:
        way.append(page.parent[way[-1]])
    # an article or main element around the subtree says how far the text goes
    for kind in ("article", "main"):
        around = [k for k in way if page.tag[k] == kind]
        if around:
            return [around[-1]]
    threshold = min(dense[k] for k in way)
    chosen, on_way = [best], set(way)
    # in page order: subtrees that are dense enough, each by its own element of the greatest sum
    peak = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if live[k] and total[peak[k]] >= total[peak[up]]:
            peak[up] = peak[k]
    skip = [False] * n
    for k in range(1, n):
        skip[k] = skip[page.parent[k]] or k == best
        if skip[k] or not live[k] or k in on_way:
            continue
        if page.tag[k] in HEADING and page.parent[k] in on_way and k < best:
            chosen.append(k)
        elif dense[k] >= threshold and paragraph[k]:
            chosen.append(peak[k])
    return chosen


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by line feeds; white space in a block is one space."""
    page = Page(html or "")
    chosen = select(page)
    keep = [False] * len(page.tag)
    for k in chosen:
        keep[k] = True
    for k in range(1, len(keep)):
        keep[k] = (keep[k] or keep[page.parent[k]]) and not page.dropped[k]
    blocks, held = [], []
    for node, text in [*page.runs, (0, None)]:
        if text is None:
            if held:
                blocks.append(" ".join("".join(held).split()))
                held = []
        elif keep[node]:
            held.append(text)
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col, url_col, text, n_chars`` (code points).

    Null, empty and textless pages give an empty text.  Ids and urls (null or repeated too) are passed through; only the
    html decides; other columns are ignored, whatever their names.  Each page is parsed by itself, in time in proportion
    to its length; the tree takes some 200 bytes per tag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_slices(batch, "_html"):
                texts = [main_text(h) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
