"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of the page (block tags and `br` end a
line).  Tags and class words only mark page furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, hidden parts, and what lies outside an article or main region where a page declares one); furniture is taken
out, and the lines around it move together.  A line's weight is its text length without white space; lines
that are mostly links weigh nothing where they stand in a run of MENU_LINKS links or more.  Weights are summed over sliding
windows of WINDOW lines.  A surge point is a line whose window reaches the threshold, SURGE characters or half the page's fullest
window, whichever is less; a dive point is the start of a window without weight.  Text between the dive before a
surge and the dive after it is kept, so that a headline and a short closing paragraph stay beside their text; other
stretches, which never surge, go.  Declared articles are judged by the same windows.

Work is per page, whole html, in Arrow batches and without a shuffle.
Defined cases: null and empty html, and pages without article text, give an empty text; unclosed
elements end with the page, an unclosed link with its block; a broken character reference stays as written.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import field, read, with_columns

WINDOW = 3
SURGE = 60
MENU_LINKS = 2

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")

#: Elements whose content is no text of the page.
_RAW = frozenset("script style template noscript iframe noframes textarea title xmp svg math object audio video canvas noembed".split())
_FURNITURE = frozenset("head nav aside form menu dialog button select footer fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr p li dt dd tr td th option".split())
#: Words of class, id or role that mark page furniture; the name's other words must be among _PLACES.
_MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside menu navbar nav navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "recommendations comment comments commentlist respond reply replies disqus footer toolbar widget widgets copyright complementary contentinfo search searchbox skip".split()
)
_OUTER_MARKS = frozenset("header masthead topbar banner".split())
_PLACES = frozenset(
    "bar box block area section wrap wrapper container content inner outer main site page global top bottom left right center middle upper lower primary secondary first last "
    "list links link buttons button icons icon item items group grid row col column unit slot zone panel pane holder module modal overlay sticky fixed floating mobile desktop "
    "header masthead topbar form field input post posts article articles story stories blog user users media text title heading body thread section sections count the by us js".split()
)
#: Elements whose id is an anchor and marks nothing.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p a span li dt dd td th tr b i em strong sup sub code pre blockquote figure img br hr".split())


def lines_of(page: str) -> list[tuple[str, bool, bool, int, int]]:
    """(text, furniture, in a declared article, length of its link text, number of its links) of each line with text."""
    out: list[tuple[str, bool, bool, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, article
    parts: list[str] = []
    link_chars, links, link_at = 0, 0, -1  # link_at: the stack's depth where the open link began, or -1

    def end_line() -> None:
        nonlocal link_chars, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((text, skip, inside, link_chars, links))
            parts.clear()
        link_chars, links = 0, int(link_at >= 0)

    at, size = 0, len(page)
    for token in iter(lambda: _TOKEN.search(page, at), None):
        if token.start() > at:
            text = page[at : token.start()]
            parts.append(text)
            link_chars += len(text) if link_at >= 0 else 0
        at = token.end()
        name = token[2] or token[5]
        if not name:
            if token[0].startswith("<![CDATA["):
                parts.append(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        name, closing = name.lower(), bool(token[1] or token[4])
        if name == "a":
            link_at, links = (-1, links) if closing else (len(stack), links + 1)
            continue
        if name in _RAW and not closing:
            if not (token[3] or token[6] or "").rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and depth < link_at or name in _VOID and depth is None:
                link_at = -1
            if name in _BLOCK or depth is not None:
                end_line()
            if depth is not None:
                del stack[depth:]
            continue
        furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        made, into = _marks(name, token[3] or token[6] or "", article)
        if name in _BLOCK or made:
            if name in _VOID and name != "br":
                link_at = -1
            end_line()
            if name == "body":
                stack.clear()
                furniture = article = False
            if name not in _VOID or (made and name not in ("br", "hr", "input", "img")):
                stack.append((name, furniture or made, article or into))
    if at < size:
        parts.append(page[at:])
    end_line()
    return out


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Does this start tag begin furniture, or a declared article."""
    furniture, article = name in _FURNITURE or name == "header" and not in_article, name in ("article", "main")
    if attributes and not furniture:
        for kind, value in _NAME.findall(attributes):
            kind, value = kind.lower(), value.strip("\"'").lower()
            if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                furniture = True
            elif kind in ("class", "id", "role") and name not in ("html", "body"):
                marks = _MARKS if in_article else _MARKS | _OUTER_MARKS
                if not (kind == "id" and name in _ANCHORED):
                    furniture |= any(_is_mark(word, marks) for word in value.split())
                article |= kind == "role" and value == "main"
    return furniture, article and not furniture


def _is_mark(name: str, marks: frozenset[str]) -> bool:
    """Is a class or id made of a furniture word and words of place only: `ad-box` is, `ad-hoc` isn't."""
    words = [w for w in (w.rstrip("0123456789") for w in _WORDS.split(name)) if w]
    return any(w in marks for w in words) and all(w in marks or w in _PLACES for w in words)


def weights_of(lines: list[tuple[str, int, int]]) -> list[int]:
    """The weight of each line (text, length of its link text, number of its links)."""
    out = [len(text) - text.count(" ") for text, _, _ in lines]
    mostly = [2 * link_chars > len(text) for text, link_chars, _ in lines]
    i = 0
    while i < len(lines):
        end = i + 1
        if mostly[i]:
            while end < len(lines) and mostly[end]:
                end += 1
            if sum(lines[k][2] for k in range(i, end)) >= MENU_LINKS:
                out[i:end] = [0] * (end - i)
        i = end
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points of a page."""
    lines = lines_of(page or "")
    declared = any(inside and not skip for _, skip, inside, _, _ in lines)
    lines = [(text, link_chars, links) for text, skip, inside, link_chars, links in lines if not skip and (inside or not declared)]
    weights = weights_of(lines)
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    least = min(surge, max(sums, default=0) / 2)
    kept, at = [], 0
    while at < len(lines):
        if not sums[at]:
            at += 1
            continue
        dive = next((i for i in range(at, len(lines)) if not sums[i]), len(lines))
        if max(sums[at:dive]) >= least:
            while not weights[at]:  # the menu before the surge
                at += 1
            kept += [text for text, _, _ in lines[at:dive]]
        at = dive
    return " ".join(kept)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with text and n_chars (code points) of each page's main text; columns of those names are replaced."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(html_col))]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return with_columns(df, [field("text", "string"), field("n_chars", "long")], run)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLES: dict[str, str] = {}
