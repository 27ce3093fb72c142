"""Main text of web pages by differencing each page with its nearest neighbour in URL order.

A page becomes a list of lines, one per text block, each with the kind of container it stands in (markup
says whether that is an article, page furniture, or neither). Pages of a host are put in URL path order,
and neighbours are paired: their lines are aligned by longest common subsequence, and what they share is
the host's template. Shared lines are deleted, unless one page is a copy of the other or they stand in an
article element with lines of its own: two neighbouring articles may quote the same passage, and the extraction
has to return both whole. An article element (a teaser, say) of which the neighbour has every line is template
like any other, if another one on the page has lines of its own; else they all are copies and stay. Lines inside furniture (menus, footers, sidebars, notices, adverts, forms, reader
comments) are never main text, shared or not; on pages that mark an article, neither is what stands
outside it.

Scale: one exchange, by ranges of (host, path, page_id), of lines instead of raw pages; a hot host spans
many ranges. A page is paired with the one before it in its range, the first of a range with the one after
it; pages without a line are passed over. Memory holds two pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names with a meaning of their own.
SILENT = frozenset(
    "script style noscript template head title textarea select option button iframe object svg math canvas "
    "audio video map datalist".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul dialog".split()
)
#: A start tag closes an open element of these names first.
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
ENDS_P = BLOCKS - {"html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Whole class and id names that mark furniture anywhere: adverts, reader comments, links to elsewhere.
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion ad-slot ad-unit ad-banner "
    "ad-container ad-wrapper google-ad comment comments commentlist comment-list comments-area comment-section "
    "user-comments post-comments disqus disqus_thread reply replies respond share sharing share-buttons "
    "social-share social social-links related related-posts related-articles recommended newsletter "
    "newsletter-signup subscribe subscribe-box signup cookie cookies cookie-banner cookie-notice cookie-consent "
    "consent gdpr pagination pager breadcrumb breadcrumbs".split()
)
#: Those that mark it outside an article only; inside, a header or a notice is part of the text.
LAYOUT = frozenset(
    "banner notice notification alert popup modal overlay login nav navbar navigation main-nav site-nav menu "
    "main-menu nav-menu sidebar side-bar side left-sidebar right-sidebar widget widgets widget-area footer site-footer "
    "page-footer header site-header masthead toolbar skip skip-link copyright".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.IGNORECASE)
SPACE = re.compile(r"\s+")

#: Inside LAID_OUT furniture, which only its class name tells, an article element is still an article.
#: Article elements after a page's first have the numbers from LAID_OUT + 1 up.
BODY, ARTICLE, FURNISHED, LAID_OUT = 0, 1, 2, 3
#: A page that shares so much of its lines with its neighbour is a copy of it, of which nothing is template.
COPY = 0.9
_LINES = "page_id long, url string, host string, path string, lines array<string>, kinds array<int>"
_RESULT = "page_id long, url string, text string, n_chars long"


@dataclass
class Page:
    page_id: int | None
    url: str | None
    host: str
    lines: list[str]
    kinds: list[int]


def in_article(kind: int) -> bool:
    return kind == ARTICLE or kind > LAID_OUT


def _kind(name: str, attributes: str, inside: int) -> int:
    """The kind of what an element holds, from its own markup and what it stands in."""
    if inside == FURNISHED or name in FURNITURE or (name == "header" and not in_article(inside)):
        return FURNISHED
    laid_out = False
    if attributes.strip() and name not in ("html", "body"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names = set(value.split())
                if names & FOREIGN:
                    return FURNISHED
                laid_out |= not in_article(inside) and name not in ARTICLE_TAGS and bool(names & LAYOUT)
            elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
                return FURNISHED
            elif key == "style" and "display:none" in value.replace(" ", ""):
                return FURNISHED
        if HIDDEN.search(ATTRIBUTE.sub(lambda m: f" {m[1]} ", attributes)):
            return FURNISHED
    if name in ARTICLE_TAGS:
        return inside if in_article(inside) else ARTICLE
    return LAID_OUT if laid_out else inside


def page_lines(markup: str) -> tuple[list[str], list[int]]:
    """Text blocks of a page in order, white space folded, with the kind of their container.

    Each article element that stands in no other has a kind of its own, also inside ``main``.
    """
    lines: list[str] = []
    kinds: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with the kind inside them
    kind, at, size = BODY, 0, len(markup)
    marked, articles = 0, set()  # elements that mark an article; the kinds of those named so

    def close_block() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                lines.append(text)
                kinds.append(kind)

    def close(names: frozenset | set, barrier: frozenset) -> None:
        nonlocal kind
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                close_block()
                del stack[depth:]
                kind = stack[-1][1] if stack else BODY
                return
            if stack[depth][0] in barrier:
                return

    while at < size:
        open_at = markup.find("<", at)
        if open_at < 0:
            parts.append(markup[at:])
            break
        if open_at > at:
            parts.append(markup[at:open_at])
        tag = TAG.match(markup, open_at)
        if tag is None:  # a lone "<" is text
            parts.append("&lt;")
            at = open_at + 1
            continue
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if tag.group(1):
            if name in BLOCKS:
                close_block()
                close({name}, frozenset())
            continue
        attributes = tag.group(3)
        if name in SILENT and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(markup, at)
            if end or name in RAW:
                at = end.end() if end else size
            continue
        if name in VOID:
            if name in ("br", "wbr", "hr"):
                parts.append(" " if name != "wbr" else "")
            if name == "hr":
                close_block()
            continue
        inside = _kind(name, attributes, kind)
        if name not in BLOCKS and inside == kind:
            continue
        if name in BLOCKS:
            close_block()
            if name in ENDS_P:
                close({"p"}, BLOCKS - {"p"})
            if name in CLOSES:
                close(CLOSES[name], frozenset(["ul", "ol", "dl", "table", "select"]))
            close_block()
        inside = _kind(name, attributes, kind)  # what was closed may have changed what it stands in
        if in_article(inside) and name in ARTICLE_TAGS and kind not in articles and (name == "article" or inside != kind):
            marked += 1
            inside = ARTICLE if marked == 1 else LAID_OUT + marked - 1
            if name == "article":
                articles.add(inside)
        if name in BLOCKS:
            stack.append((name, inside))
            kind = inside
        elif inside in (FURNISHED, LAID_OUT):  # furniture made of an inline element: up to its end tag
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(markup, at)
            at = end.end() if end else at
    close_block()
    return lines, kinds


def url_place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, lower-cased host; an unreadable URL is all path."""
    found = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (found.group(1).lower(), found.group(2)) if found else ("", url or "")


def shared(lines: list[str], other: list[str]) -> set[int]:
    """Places in ``lines`` that align with ``other`` in a longest common subsequence.

    Equal heads and tails align at once; the middles are aligned over the lines both have.
    """
    low = 0
    while low < min(len(lines), len(other)) and lines[low] == other[low]:
        low += 1
    top = 0
    while top < min(len(lines), len(other)) - low and lines[-1 - top] == other[-1 - top]:
        top += 1
    found = {*range(low), *range(len(lines) - top, len(lines))}
    mine, theirs = lines[low : len(lines) - top], other[low : len(other) - top]
    both = set(mine) & set(theirs)
    if both:
        a = [(i, x) for i, x in enumerate(mine) if x in both]
        b = [x for x in theirs if x in both]
        for pick in _subsequence([x for _, x in a], b):
            found.add(low + a[pick][0])
    return found


def _subsequence(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    A row of the table of lengths is one number: bit j is 0 where the length grows at column j. A row follows
    from the one before in a few operations on it, whatever the number of lines.
    """
    at: dict[str, int] = {}
    for j, line in enumerate(b):
        at[line] = at.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for line in a:
        row = rows[-1]
        met = row & at.get(line, 0)
        rows.append((row + met | row - met) & full)
    found = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i] >> (j - 1) & 1:
            continue
        found.append(i)
        j -= 1
    return found[::-1]


def main_text(page: Page, neighbour: Page | None) -> str:
    """Lines of the page that are neither template nor furniture, joined by line breaks."""
    same: set[int] = set()
    if neighbour and neighbour.host == page.host:
        same = shared(page.lines, neighbour.lines)
        if len(same) >= COPY * len(page.lines):
            same = set()
    marked = {kind for kind in page.kinds if in_article(kind)}
    own = {kind for i, kind in enumerate(page.kinds) if kind in marked and i not in same} or marked
    kept = [
        line for i, (line, kind) in enumerate(zip(page.lines, page.kinds, strict=True))
        if kind in own or (kind == BODY and not marked and i not in same)
    ]
    return "\n".join(kept)


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [url_place(u) for u in batch["url"].to_pylist()]
        pages = [page_lines(h.as_py() or "") for h in batch["html"]]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array([h for h, _ in places], pa.string()),
             pa.array([p for _, p in places], pa.string()), pa.array([lines for lines, _ in pages], pa.list_(pa.string())),
             pa.array([kinds for _, kinds in pages], pa.list_(pa.int32()))],
            ["page_id", "url", "host", "path", "lines", "kinds"],
        )


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before: Page | None = None  # the page before, kept for its lines
    waiting: Page | None = None  # the first page of a host in this range, until its next is seen
    for batch in batches:
        done: list[tuple] = []

        def put(page: Page, neighbour: Page | None, done=done) -> None:
            text = main_text(page, neighbour)
            done.append((page.page_id, page.url, text, len(text)))

        for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "host", "lines", "kinds")), strict=True):
            page = Page(*row)
            if not page.lines:  # nothing to extract, and nothing to compare with
                put(page, None)
                continue
            if waiting is not None:
                put(waiting, page if page.host == waiting.host else None)
                waiting = None
            if before is None or before.host != page.host:
                waiting = page
            else:
                put(page, before)
            before = page
        yield _results(done)
    if waiting is not None:
        text = main_text(waiting, None)
        yield _results([(waiting.page_id, waiting.url, text, len(text))])


def _results(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "text", "n_chars"]
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    A null html is empty; its text is empty. A null or unreadable URL belongs to the host of empty name.
    Repeated rows each give a row. Empty table: no rows. Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    lines = rows.mapInArrow(_line_batches, _LINES)
    return (
        lines.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
        .mapInArrow(_text_batches, _RESULT)
    )
