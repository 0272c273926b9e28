"""Main text of HTML pages by the distribution of text over line blocks.

1. Strip markup. A page becomes lines, one per block-level element's run of text; character
   references are decoded and white space inside a line becomes one space. A line's weight is
   its length in code points. Lines inside menus, page headers, footers, sidebars, notices,
   adverts, forms and reader comments weigh 0, as do lines outside of the article element (or
   the main element) where a page marks one, and short lines made of links where it doesn't,
   but for first-rank headings. Inside an article or main element a word that may as well name
   a part of the text (WEAK, or the id of a section) marks a notice only if the element holds
   mostly links, or form fields; ids of headings mark nothing. A class or id that names a notice
   marks nothing on an element that holds more than half of the page's text and all its articles
   (main elements, first-rank headings): it wraps the page. Words for comments and the elements
   of DROPPED always count.
2. Sum the weights over a sliding window of WINDOW lines. A surge point is where the sums rise
   from nothing to the threshold, a dive point where they fall to nothing again.
3. The text lies between the first surge and the last dive point: every line with weight there
   is kept. Where a page marks its article, any weight is a surge, and a headline, or lines of the
   main element, that touch it come in; elsewhere the sums must reach THRESHOLD characters, and
   lines at both ends go that stand in no element for running text: all of them where most of the
   text stands in such elements, else those under THRESHOLD. Articles that weigh less
   than the rest of their main element are cards in it; an article is a teaser, and the page one
   without marks, if a stretch outside of it has over TEASER times its weight.

Defined results: null, empty and text-free pages give the empty text; broken or unclosed
markup never fails (an open script, style or comment reaches to the end of the page, an open
button, video or the like to the end of its parent or the next block; an
article or main element ends an unclosed menu, header or form around it). Rows are
independent; extra columns are ignored. Memory: one page at a time within a batch.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from runlens.llm.common import in_arrow, text_of

WINDOW = 3
THRESHOLD = 80
TEASER = 2

# HTML element names and words of class, id and role attributes.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg object select button canvas audio video annotation annotation-xml".split())
DROPPED = frozenset("nav header footer aside form menu dialog search".split())
NOTICE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail widget widgets footer masthead header topbar toolbar"
    " comment comments commentlist disqus thread threads reviews respond discussion replies share sharing social related recommended newsletter subscribe subscription signup login pagination pager skip"
    " complementary contentinfo search".split()
)
#: Words that name parts of a text as well as notices.
WEAK = frozenset(
    "header footer notice notification alert banner promotion discussion replies respond related recommended search menu navigation nav aside share sharing social cookie cookies consent gdpr"
    " subscription subscribe newsletter login signup complementary rail skip overlay modal popup widget widgets pagination".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus thread threads reviews".split())
#: Elements that hold running text, the parts of a page that may hold anything, and what a pulled quotation begins with.
PROSE = tuple("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
PARTS = tuple("body div section main header footer nav aside form fieldset center table".split())
_QUOTE = re.compile(r"\s*<(?:blockquote|q)(?=[\s>])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OF_TEXT = frozenset("entry post article story content section chapter".split())
_STATES = frozenset("has with no without".split())
_FIELDS = frozenset("form input textarea select".split())
_RAW_START = {name: re.compile(rf"<{name}(?=[\s/>])", re.I) for name in RAW}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _notice(name: str, attributes: str, inside: bool = False) -> str:
    """Whether an element's own attributes mark it as beside the text: "sure", "named" unless it wraps the page, "doubt" if what it holds decides, "" if not."""
    if not attributes or name in ("html", "body", "main") or (name == "article" and "comment" not in attributes.lower()):
        return ""
    found = ""
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            return "sure"
        if key in ("class", "id", "role"):
            if key == "id" and name in _HEADINGS:
                continue
            words = []
            for part in value.split():
                own = [w for w in _SPLIT.split(_CAMEL.sub("-", part).lower()) if w]
                if own and own[0] not in _STATES:
                    words += [w for w in own if w != "header" or _OF_TEXT.isdisjoint(own)]
            if key != "role" and name == "article":
                words = [w for w in words if w.startswith("comment")]
            marks = [w for w in words if w in NOTICE]
            if marks:
                if key == "role" or not _COMMENTS.isdisjoint(marks):
                    return "sure"
                weak = inside and all(w in WEAK or (key == "id" and name == "section") for w in marks)
                found = "doubt" if weak and found != "named" else "named"
    return found


#: An open element that a new one ends, up to the element it may not leave (HTML's optional end tags).
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",))),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
}
#: Items and cells hold whatever their list or table holds; a paragraph ends at any other block.
_CLOSES_P = BLOCK - {"caption", "dd", "dt", "head", "html", "body", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "li"} | {"li", "dd", "dt"}
_HOLDS = ("table", "td", "th", "caption", "article", "main", "aside", "section", "div", "blockquote", "li", "dd", "dt")


class _Open:
    """The open elements, the innermost last: name, whether it drops its text, its kind. Every step is O(1) an element."""

    def __init__(self, lines: _Lines) -> None:
        self.lines = lines
        self.doubt: tuple[int, int, int] | None = None  # place of the outermost doubtful element, lines and fields before it
        self.named: list[tuple[int, int]] = []  # places of the elements named as notices, lines before them
        self.stack: list[tuple[str, bool, str]] = []
        self.at: dict[str, list[int]] = {}  # positions in the stack by name
        self.counts = {True: 0, "article": 0, "main": 0, "a": 0, "gone": 0}

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def push(self, name: str, drop: bool, kind: str) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, drop, kind))
        self._count(drop, kind, 1)

    def _count(self, drop: bool, kind: str, n: int) -> None:
        self.counts[True] += n * drop
        if kind:
            self.counts[kind] += n

    def cut(self, i: int) -> None:
        """Ends the element at i and all inside."""
        while len(self.stack) > i:
            name, drop, kind = self.stack.pop()
            self.at[name].pop()
            self._count(drop, kind, -1)
        while self.named and self.named[-1][0] >= i:
            self.lines.named.append((self.named.pop()[1], len(self.lines.rows)))
        if self.doubt and self.doubt[0] >= i:
            self.lines.judge(*self.doubt[1:])
            self.doubt = None

    def end(self, name: str) -> None:
        """An end tag."""
        i = self.last((name,))
        if i >= 0 and (name != "p" or i > self.last(_HOLDS)) and (name not in _ENDS or i > self.last(_ENDS[name][1])):
            self.cut(i)

    def begin(self, name: str) -> None:
        """What the start tag ends without an end tag."""
        if name in _CLOSES_P:
            i = self.last(("p",))
            if i > self.last(_HOLDS):
                self.cut(i)
        if name in _ENDS:
            ended, limits = _ENDS[name]
            edge = self.last(limits)
            found = [self.at[x][bisect_right(self.at[x], edge)] for x in ended if self.at.get(x) and self.at[x][-1] > edge]
            if found and (name not in ("li", "dt", "dd") or min(found) > self.last(("table", "article", "main"))):
                self.cut(min(found))

    def forgive(self) -> None:
        """None of the open elements drops its text any more."""
        self.stack = [(name, False, kind) for name, _, kind in self.stack]
        self.counts[True] = 0


class _Lines:
    """Lines of a page with what is known of each."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool, bool, float]] = []  # text, beside the article, in article, in main, share of links
        self.heads: list[bool] = []  # whether a line is of a first-rank heading
        self.prose: list[bool] = []  # whether a line's innermost part of the page is one for running text
        self.named: list[tuple[int, int]] = []  # lines [first, end) of elements named as notices
        self.parts: list[str] = []
        self.linked = 0
        self.fields = 0  # form fields so far

    def end(self, beside: bool, article: bool, main: bool, open_: _Open) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                headline = bool(open_.at.get("h1"))
                self.rows.append((text, beside, article, main, 0.0 if headline else self.linked / len(text)))
                self.heads.append(headline)
                self.prose.append(open_.last(PROSE) > open_.last(PARTS))
            self.parts, self.linked = [], 0

    def judge(self, first: int, fields: int) -> None:
        """The lines from `first` on lie beside the text if they are mostly links or come with form fields."""
        size = sum(len(row[0]) for row in self.rows[first:])
        if self.fields > fields or 2 * sum(len(row[0]) * row[4] for row in self.rows[first:]) > size:
            self.rows[first:] = [(text, True, *rest) for text, _, *rest in self.rows[first:]]

    def judge_named(self) -> None:
        """The lines of elements named as notices lie beside the text, unless the element wraps the page."""
        own = [not row[1] for row in self.rows]
        size = [0, *accumulate(o * len(row[0]) for o, row in zip(own, self.rows, strict=True))]
        linked = [0, *accumulate(o * len(row[0]) * row[4] for o, row in zip(own, self.rows, strict=True))]
        big = [(a, b) for a, b in self.named if 2 * (size[b] - size[a]) > max(size[-1], 4 * (linked[b] - linked[a]))]
        small = self._covered(set(self.named) - set(big))
        free = [o and not n for o, n in zip(own, small, strict=True)]
        heads = [f and (row[2] or row[3]) for f, row in zip(free, self.rows, strict=True)]
        if not any(heads):
            heads = [f and h for f, h in zip(free, self.heads, strict=True)]
        head = [0, *accumulate(heads)]
        notices = self._covered([(a, b) for a, b in big if not head[-1] or head[b] - head[a] < head[-1]])
        self.rows = [(row[0], row[1] or n + m > 0, *row[2:]) for row, n, m in zip(self.rows, small, notices, strict=True)]

    def _covered(self, spans) -> list[int]:
        """How many of the spans cover each line."""
        steps = [0] * (len(self.rows) + 1)
        for a, b in spans:
            steps[a] += 1
            steps[b] -= 1
        return list(accumulate(steps))[:-1]


def page_lines(page: str) -> _Lines:
    """The lines of a page in order; rows: (text, beside, in article, in main, share of linked text)."""
    lines, at, n = _Lines(), 0, len(page)
    open_, ends = _Open(lines), {}
    counts = open_.counts
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at and not counts["gone"]:
            text = _html.unescape(page[at:cut])
            lines.parts.append(text)
            if counts["a"]:
                lines.linked += len(text)
        if cut == n:
            break
        found = _TOKEN.match(page, cut)
        if not found:  # a lone sign
            lines.parts.append("<")
            at = cut + 1
            continue
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            if page.startswith("<![CDATA[", cut):
                lines.parts.append(found.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        lines.fields += not closing and name in _FIELDS and "hidden" not in attributes
        if name in RAW:
            if closing:
                open_.end(name)
            elif not attributes.endswith("/"):
                if ends.get(name, -1) < at:  # the next end tag
                    end = _RAW_END[name].search(page, at)
                    ends[name] = n + 1 if end is None else end.start()
                if ends[name] > n and name in ("script", "style"):
                    at = n
                elif ends[name] > n or (name not in ("script", "style") and _RAW_START[name].search(page, at, ends[name])):
                    open_.push(name, False, "gone")  # not closed, or others of its name in it or after it
                else:
                    at = page.find(">", ends[name]) + 1 or n
            continue
        if not closing and name in BLOCK and counts["gone"]:
            while open_.stack and open_.stack[-1][2] == "gone" and ends.get(open_.stack[-1][0], 0) > n:  # never closed: ends here
                open_.cut(len(open_.stack) - 1)
        if name in BLOCK:
            lines.end(counts[True] > 0, counts["article"] > 0, counts["main"] > 0, open_)
        elif name == "br":
            lines.parts.append(" ")
        if name in VOID:
            continue
        if not closing:
            if attributes.endswith("/") and name not in BLOCK:
                continue
            open_.begin(name)
            beside, article = counts[True], counts["article"]
            if name in ("article", "main") and beside and not any(b and e not in ("nav", "header", "form", "menu") for e, b, _ in open_.stack):
                # an unclosed menu, header or form, or a form around the whole page
                open_.forgive()
                beside = 0
            notice = _notice(name, attributes, (article > 0 or counts["main"] > 0) and not beside)
            if notice == "doubt" and not open_.doubt:
                open_.doubt = (len(open_.stack), len(lines.rows), lines.fields)
            if notice == "named":
                open_.named.append((len(open_.stack), len(lines.rows)))
            own = article and not beside and (name == "header" or (name in ("aside", "footer") and ("quote" in attributes.lower() or _QUOTE.match(page, at))))
            drop = (name in DROPPED and not own) or notice == "sure"
            kind = "article" if name == "article" and not drop and not beside else "main" if (name == "main" or "role=\"main\"" in attributes) and not drop else "a" if name == "a" else ""
            open_.push(name, drop, kind)
        else:
            open_.end(name)
    lines.end(counts[True] > 0, counts["article"] > 0, counts["main"] > 0, open_)
    open_.cut(0)
    lines.judge_named()
    return lines


def surges_and_dives(weights: list[int], window: int = WINDOW, least: int = 1) -> list[tuple[int, int]]:
    """Stretches [surge, dive) of lines: runs of windows with some weight that reach `least` in one window."""
    n, found, start, top = len(weights), [], -1, 0
    total = sum(weights[:window])
    for i in range(n):
        if total > 0:
            if start < 0:
                start, top = i, 0
            top = max(top, total)
        elif start >= 0:
            found.append((start, i, top))
            start = -1
        total += (weights[i + window] if i + window < n else 0) - weights[i]
    if start >= 0:
        found.append((start, n, top))
    return [(a, b) for a, b, most in found if most >= least]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines = page_lines(page)
    rows = lines.rows
    loose = [0 if beside or (linked > 0.6 and len(text) < THRESHOLD) else len(text) for text, beside, _, _, linked in rows]
    marked = 2 if any(a and not b for _, b, a, _, _ in rows) else 3 if any(m and not b for _, b, _, m, _ in rows) else 0
    if marked == 2 and sum(n for n, row in zip(loose, rows, strict=True) if row[3] and not row[2]) > sum(n for n, row in zip(loose, rows, strict=True) if row[2]):
        marked = 3  # the articles are cards within the main text
    if marked:
        weights = [0 if row[1] or not row[marked] else len(row[0]) for row in rows]
        outside = [0 if row[marked] else n for row, n in zip(rows, loose, strict=True)]
        if max((sum(outside[a:b]) for a, b in surges_and_dives(outside, least=THRESHOLD)), default=0) > TEASER * sum(weights):
            marked = 0
    if marked:
        first = next((i for i, w in enumerate(weights) if w), 0)
        while first and loose[first - 1] and (lines.heads[first - 1] or rows[first - 1][3]):  # the headline and lede that touch the article
            first -= 1
            weights[first] = loose[first]
        stretches = surges_and_dives(weights)
    else:
        weights = loose
        stretches = surges_and_dives(weights, least=THRESHOLD) or surges_and_dives(weights)
        stretches = [_trimmed(lines, weights, stretches[0][0], stretches[-1][1])] if stretches else []
    return "\n".join(rows[i][0] for a, b in stretches for i in range(a, b) if weights[i])


def _trimmed(lines: _Lines, weights: list[int], first: int, end: int) -> tuple[int, int]:
    """The stretch without the lines at its ends that stand in no element for running text: all where most of its text stands in such, else the short ones."""
    running = [i for i in range(first, end) if weights[i] and lines.prose[i]]
    if 2 * sum(weights[i] for i in running) < sum(weights[first:end]):
        running += [i for i in range(first, end) if weights[i] >= THRESHOLD]
    return (min(running), max(running) + 1) if running else (first, end)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    source = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), text_of(html_col).alias("_html"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["_id", "_url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    out = in_arrow(source, run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars bigint")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
