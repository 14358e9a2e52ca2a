"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements and, in page order, the runs of text between block
boundaries. Runs inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out. Every other run of some length earns points (one, one for each
comma, and more for its length) that are passed to its block's container and, in part, to the
ancestors; a container's points are discounted by its link density. The best container is widened to
the article element around it, if there is one, siblings with a good share of its points join it, and
its runs are the text. What stands between the first and the last of them is kept too.

A class or id marks a part by its first or last word (`ad-box`, `site-sidebar`), not if it tells of layout
or state (`has-sidebar`, `social-enabled`), and not if the part holds the page's article or most of its points;
so does a form (some servers put one around the whole page). A name that opens with an article's topic
(`related-work`) marks nothing, nor does a topic inside the article on a part with a heading and a paragraph.
A menu, aside or header that is never closed ends where the article's elements begin.

Defined results: null and empty html give an empty text, and so do pages without text outside the
parts that are left out; repeated rows are extracted one by one. Broken markup (missing end tags,
cut-off tags or comments) is read as browsers do: what a new block closes, it closes. Equal scores go to the
container that comes first; a very long page is read in one pass; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element kinds of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("aside button dialog dir fieldset footer head iframe menu nav noscript object select svg template".split())
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that mark parts which are no article.
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice paywall pagination pager popup promo promoted promotion recommended related respond replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
HEADER_WORDS = frozenset(["header", "topbar"])
#: Marks that hold whatever the size of the part: long comments, lists of other articles and consent texts are no article.
FIRM_WORDS = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus gdpr login promoted promotion recommended related reply replies respond signup".split())
#: Firm words that are topics of articles too: as the first word of a name they need one of a list or box behind them,
#: and a part inside the article with a heading and a paragraph of its own is no list.
TOPIC_WORDS = frozenset("consent cookie cookies gdpr login promoted promotion recommended related signup".split())
BOX_WORDS = frozenset("area articles bar block box column container content entries feed form grid inner items links list module news panel posts reading row section stories topics unit widget wrap wrapper".split())
#: What closes an element of a page that never closes it.
UNCLOSED = {"nav": frozenset("article main section h1 h2 p".split()), "aside": frozenset("article main".split()), "header": frozenset("article main section".split())}
#: Words of layout and state: with one of these a class tells what else the page has.
STATE_WORDS = frozenset("active allowed closed disabled enabled has hidden layout no non not off on open ready visible with without".split())
#: An opening li, td and so on closes an open one of these before the stop element.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Least characters of a run that earns points, and the most points for length.
RUN_CHARS = 25
LENGTH_POINTS = 3
#: Least characters of a paragraph that makes a headed part inside an article a part of it.
PARAGRAPH_CHARS = 80
ANCESTORS = 5
SIBLING_SHARE = 0.2
MENU_DENSITY = 0.6

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<svg(?=[\s/])[^<>]*/>"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|svg|template)(?=[\s/>]|$)(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>(?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*)>|[^>]*(?:>|$))"
    r"|<[!?/][^>]*(?:>|$)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NOT_P = BLOCKS - {"p"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Page:
    def __init__(self) -> None:
        self.tag, self.parent, self.out, self.article = ["#"], [-1], [False], [False]
        self.mark, self.main = [""], [False]  # left out by its class: "soft", "topic" or "firm"; main or article body
        self.score, self.text, self.links = [0.0], [0], [0]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters inside links

    def open(self, tag: str, parent: int, rest: str) -> int:
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(rest)} if "=" in rest or "hidden" in rest else {}
        words = _marks(f"{named.get('class', '')} {named.get('id', '')}")
        role = named.get("role", "").lower()
        article = tag in ("article", "main") or role in ("main", "article") or "articlebody" in named.get("itemprop", "").lower()
        inside = self.article[parent]
        out = self.out[parent] or tag in LEFT_OUT or role in LEFT_OUT_ROLES or "hidden" in named and named["hidden"] != "false" or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        mark = ""
        if not article and tag not in ("html", "body"):
            # an article's own header may hold its heading; a page's header is left out
            out = out or tag == "header" and not inside
            if words & FIRM_WORDS & LEFT_OUT_WORDS:
                mark = "topic" if inside and words & FIRM_WORDS & LEFT_OUT_WORDS <= TOPIC_WORDS else "firm"
            elif tag == "form" or words & LEFT_OUT_WORDS or words & HEADER_WORDS and not inside and tag not in HEADINGS:
                mark = "soft"
        elif article and {"comment", "comments", "reply"} & words:
            mark = "firm"
        main = tag == "main" or role == "main" or "articlebody" in named.get("itemprop", "").lower()
        for column, value in ((self.tag, tag), (self.parent, parent), (self.out, out), (self.article, article or inside), (self.mark, mark), (self.main, main), (self.score, 0.0), (self.text, 0), (self.links, 0)):
            column.append(value)
        return len(self.tag) - 1


def _marks(names: str) -> set[str]:
    """First and last words of class and id names, without those of layout and state and topics that only open a name."""
    out: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and STATE_WORDS.isdisjoint(words):
            out.add(words[-1])
            if words[0] not in TOPIC_WORDS or BOX_WORDS.issuperset(words[1:]):
                out.add(words[0])
    return out


def _points(text: str, links: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, LENGTH_POINTS)) * (1 - links / len(text)) if len(text) >= RUN_CHARS else 0.0


def _leave_out(page: _Page) -> None:
    """Leave out the marked parts, but none that holds the page's article or (soft marks) most of the points."""
    n = len(page.tag)
    if not any(page.mark):
        return
    own = [0.0] * n
    filled, headed, told = [False] * n, [False] * n, [False] * n
    for node, text, links in page.runs:
        own[node] += _points(text, links)
        filled[node] = True
        headed[node] |= page.tag[node] in HEADINGS
        told[node] |= len(text) >= PARAGRAPH_CHARS and 4 * links < len(text)
    for node in range(n - 1, 0, -1):
        headed[page.parent[node]] |= headed[node]
        told[page.parent[node]] |= told[node]
    for node in range(1, n):
        if page.mark[node] == "topic":
            page.mark[node] = "" if headed[node] and told[node] else "firm"
    holds_main, firm, free = [False] * n, [False] * n, [True] * n
    for node in range(n - 1, 0, -1):
        filled[page.parent[node]] |= filled[node]
        holds_main[node] |= page.main[node] and filled[node]
        holds_main[page.parent[node]] |= holds_main[node]
    for node in range(1, n):
        if holds_main[node]:
            page.mark[node] = ""
        firm[node] = firm[page.parent[node]] or page.mark[node] == "firm"
        free[node] = free[page.parent[node]] and not page.mark[node]
    articles = [page.tag[i] == "article" and filled[i] and not firm[i] for i in range(n)]
    elsewhere = any(a and f for a, f in zip(articles, free, strict=True))
    points = [0.0 if f else p for p, f in zip(own, firm, strict=True)]
    total = sum(points)
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        points[up] += points[node]
        articles[up] |= articles[node]
    for node in range(1, n):
        if page.mark[node] == "soft" and (2 * points[node] > total or articles[node] and not elsewhere):
            page.mark[node] = ""
        page.out[node] = page.out[node] or bool(page.mark[node]) or page.out[page.parent[node]]
    page.runs = [r for r in page.runs if not page.out[r[0]]]


def _read(source: str) -> _Page:
    """The tree and the runs of a page."""
    page = _Page()
    stack = [0]
    held: list[str] = []
    links = anchors = at = 0
    low = source.lower()
    endless = {t: by for t, by in UNCLOSED.items() if low.count(f"<{t}") > low.count(f"</{t}")}

    def flush() -> None:
        nonlocal held, links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and not page.out[stack[-1]]:
                page.runs.append((stack[-1], text, min(links, len(text))))
        held, links = [], 0

    def close(names: set[str], stops: frozenset[str] | set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[depth]]
            if tag in names:
                del stack[depth:]
                return
            if tag in stops:
                return

    def add(text: str) -> None:
        nonlocal links
        if text:
            held.append(text)
            if anchors:
                links += len(text)

    for token in _TOKEN.finditer(source):
        add(source[at : token.start()])
        at = token.end()
        tag = (token["name"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            anchors = 0 if token["end"] else 1
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCKS or tag in LEFT_OUT:
            flush()
            anchors = 0
            if token["end"]:
                close({tag}, frozenset())
                continue
            for open_, by in endless.items():
                if tag in by:
                    close({open_}, frozenset())
            close({"p"}, _NOT_P)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag not in VOID and not (tag == "body" and len(stack) > 1 and page.tag[stack[-1]] == "body"):
                stack.append(page.open(tag, stack[-1], token["rest"]))
    add(source[at:])
    flush()
    return page


def main_text(source: str | None) -> str:
    """The blocks of the article, joined by an empty line."""
    if not source:
        return ""
    page = _read(source)
    _leave_out(page)
    if not page.runs:
        return ""
    n = len(page.tag)
    for node, text, links in page.runs:
        page.text[node] += len(text)
        page.links[node] += links
    for node in range(n - 1, 0, -1):
        page.text[page.parent[node]] += page.text[node]
        page.links[page.parent[node]] += page.links[node]
    density = [page.links[i] / page.text[i] if page.text[i] else 0.0 for i in range(n)]

    # lists and tables that are mostly links earn nothing; those of short labels are menus
    parts = [0] * n
    for node, _, _ in page.runs:
        parts[node] += 1
    for node in range(n - 1, 0, -1):
        parts[page.parent[node]] += parts[node]
    linked, menu = [False] * n, [False] * n
    for node in range(1, n):
        own = page.tag[node] in ("ul", "ol", "table", "dl") and density[node] > MENU_DENSITY
        linked[node] = linked[page.parent[node]] or own
        menu[node] = menu[page.parent[node]] or own and page.text[node] < RUN_CHARS * parts[node]

    for node, text, links in page.runs:
        if len(text) < RUN_CHARS or linked[node]:
            continue
        points = _points(text, links)
        up = page.parent[node] if page.tag[node] in ("p", "pre", "blockquote", "li", "dd", "td") or page.tag[node] in HEADINGS else node
        for level in range(ANCESTORS):
            if up < 0:
                break
            page.score[up] += points / (1 if level == 0 else 2 * level)
            up = page.parent[up]
    final = [page.score[i] * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (final[i], -i))
    chosen = _widen(page, best, final)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in chosen or node > 0 and inside[page.parent[node]]
    # what the siblings' parent says itself between the first and the last of them
    at = [k for k, (node, _, _) in enumerate(page.runs) if inside[node]]
    around = page.parent[min(chosen)]
    between = lambda k, node: node == around and at and at[0] < k < at[-1]
    return "\n\n".join(text for k, (node, text, _) in enumerate(page.runs) if (inside[node] or between(k, node)) and not menu[node])


def _widen(page: _Page, best: int, final: list[float]) -> set[int]:
    """The containers whose runs are the article."""
    if final[best] <= 0:  # nothing long enough: an article element, or else the page
        return {next((i for i, t in enumerate(page.tag) if t in ("article", "main") and page.text[i]), 0)}
    top = around = best
    while around > 0:  # the outermost article element around the best container
        if page.tag[around] in ("article", "main") or page.article[around] and not page.article[page.parent[around]]:
            top = around
        around = page.parent[around]
    if page.article[top]:
        return {top}
    while page.parent[top] > 0 and final[page.parent[top]] >= 0.75 * final[top] and page.tag[page.parent[top]] not in ("body", "html"):
        top = page.parent[top]
    limit = max(4.0, SIBLING_SHARE * final[top])
    chosen = {top}
    for node in range(1, len(page.tag)):
        if page.parent[node] == page.parent[top] and node != top:
            long = page.tag[node] in ("p", "pre", "blockquote") and page.text[node] >= RUN_CHARS and page.links[node] * 4 < page.text[node]
            if final[node] >= limit or long or page.tag[node] in HEADINGS and node < top:
                chosen.add(node)
    first, last = min(chosen), max(chosen)
    return chosen | {i for i in range(first, last) if page.parent[i] == page.parent[top]}


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
