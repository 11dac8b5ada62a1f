"""Layout-aware HTML extraction.

A tree builder with implied tags (an open p ends where a block begins, li, dt, dd, option, tr, td and th end
where the next one begins, a cell without row or a row without table gets one) turns markup into a tree; rendering
emits all text that a reader would see. Hidden are the head, scripts, styles, templates, comments, what is not drawn of
svg and math (descriptions, definitions, annotations), elements with the hidden attribute, and those whose inline style
says display:none or visibility:hidden. A hidden element ends where a visible one would, by implied end tags too; a head
ends at the first text or tag that it cannot hold, an svg or math at the first tag of HTML that it cannot hold. A slash
at the end of a tag closes it within svg and math only, as in browsers.

Paragraphs, headings, lists and tables are set apart by a blank line, other blocks by a line break; list items
carry bullets or numbers and their depth; pre keeps its spaces. Cells of a table start at common columns, spans of columns
and rows included. A cell of more than WRAP characters goes on in further lines, but in the last column; a word that is
wider than its column ends the line, and the next cell starts on a new one, at its column.

A null page has a null text; a page without visible text has an empty one. Rows that repeat are treated alike; an
empty table gives an empty result. Only page_id and html are read, pages whole. Nesting beyond MAX_DEPTH is
read as if flat, so that no page can exhaust the stack.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm.common import set_batches

MAX_DEPTH = 200
#: Cells of a table are broken into lines of this many characters, at spaces.
WRAP = 60
#: What a cell may span, as browsers have it.
MAX_COLSPAN, MAX_ROWSPAN = 1_000, 65_534

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_APART = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", "hr"}
_BLOCK = _APART | {"html", "body", "div", "section", "article", "header", "footer", "nav", "main", "aside", "form", "fieldset", "address", "li", "dt", "dd", "tr", "caption", "figcaption", "details", "summary", "option", "legend", "center", "thead", "tbody", "tfoot", "head"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "caption", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "caption", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "caption", "thead", "tbody"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_FOREIGN = {"svg", "math"}
#: Of svg and math, what is not drawn, what may hold HTML, and the tags of HTML that end them.
_UNDRAWN = {"desc", "metadata", "defs", "symbol", "clippath", "mask", "marker", "pattern", "annotation", "annotation-xml"}
_HOSTS = {"foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
_BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: What a head may hold; anything else ends it.
_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "noframes", "basefont", "bgsound"}
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPAN_ATTR = re.compile(r"(?:^|\s)(colspan|rowspan)\s*=\s*[\"']?\s*(\d{1,9})", re.I)
_START_ATTR = re.compile(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "kids", "attrs", "hidden")

    def __init__(self, tag: str, attrs: str = "", hidden: bool = False):
        self.tag, self.attrs, self.hidden, self.kids = tag, attrs, hidden, []


def is_hidden(attrs: str) -> bool:
    """Whether attributes of a tag hide it: hidden itself, or an inline style. The first attribute of a name counts."""
    low = attrs.lower()
    if "hidden" not in low and "style" not in low:
        return False
    named: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in named:
        return True
    said: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", html.unescape(named.get("style", ""))).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        # the last of a name counts, an important one before others
        if bool(mark) >= said.get(name.strip(), (False, ""))[0]:
            said[name.strip()] = (bool(mark), value.strip())
    return said.get("display", (0, ""))[1] == "none" or said.get("visibility", (0, ""))[1] == "hidden"


def build(source: str) -> Node:
    """The tree of a page; what is hidden is on the stack while it is open, but no kid of its parent."""
    root = Node("#root")
    stack = [root]

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip():
            stack.pop()
        if s and not stack[-1].hidden:
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def close(tags: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                return
            if stack[i].tag in tags:
                del stack[i:]
                # a cell ends before its row does
                close(tags, until)
                return

    def push(tag: str, attrs: str = "", hidden: bool = False) -> None:
        node = Node(tag, attrs, hidden or stack[-1].hidden)
        if not node.hidden:
            stack[-1].kids.append(node)
        # what is hidden is not rendered, so its depth does no harm
        if node.hidden or len(stack) < MAX_DEPTH:
            stack.append(node)

    at, n, drawn = 0, len(source), False
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if stack[-1].tag == "head" and tag not in _HEAD:
            stack.pop()
        foreign = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in _FOREIGN), 0) if drawn else 0
        if foreign and any(x.tag in _HOSTS for x in stack[foreign + 1 :]):
            foreign = 0
        if foreign and tag in _BREAKOUT:
            del stack[foreign:]
            foreign = 0
        shut = bool(foreign or tag in _FOREIGN) and m[3].endswith("/")
        drawn = drawn or tag in _FOREIGN
        if tag in _RAW:
            if not shut:
                end = _RAW_END[tag].search(source, at)
                body = source[at : end.start() if end else n]
                at = end.end() if end else n
                if tag == "textarea" and not is_hidden(m[3]):
                    text(body)
            continue
        hidden = tag == "head" or bool(foreign and tag in _UNDRAWN) or bool(m[3]) and is_hidden(m[3])
        if tag in _BLOCK and not foreign:
            close({"p"}, {"td", "th", "li", "dd", "blockquote", "div", "section", "article", "table", "button", "figure"} - ({"div", "section", "article"} if tag == "body" else set()))
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if tag in ("td", "th") and not any(x.tag in ("tr", "table") for x in reversed(stack)):
            push("table")
        if tag == "tr" and not any(x.tag == "table" for x in stack):
            push("table")
        if tag in ("td", "th"):
            for x in reversed(stack):
                if x.tag == "tr":
                    break
                if x.tag == "table":
                    push("tr")
                    break
        if shut:
            continue
        if tag in _VOID:
            if not hidden and not stack[-1].hidden:
                stack[-1].kids.append(Node(tag, m[3]))
        else:
            push(tag, m[3], hidden)
    return root


class _Out:
    """Lines of text; a gap is a wish for line breaks (1) or a blank line (2) before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = False

    def end(self, gap: int) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def _open(self) -> None:
        if not self.now and self.gap:
            if self.lines and self.gap == 2 and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def words(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.space = self.space or bool(self.now)
            return
        if not s:
            return
        self._open()
        if self.now and (self.space or s[0] == " "):
            self.now.append(" ")
        self.now.append(s.strip(" "))
        self.space = s[-1] == " "

    def line(self, s: str) -> None:
        self._open()
        self.lines.append(s)

    def result(self) -> list[str]:
        self.end(0)
        return self.lines


class _Cell:
    __slots__ = ("lines", "column", "span", "rows")

    def __init__(self, lines: list[str], attrs: str = ""):
        spans = {m[1].lower(): int(m[2]) for m in _SPAN_ATTR.finditer(attrs)}
        self.lines = lines
        self.span = min(MAX_COLSPAN, max(1, spans.get("colspan", 1)))
        self.rows = min(MAX_ROWSPAN, max(1, spans.get("rowspan", 1)))
        self.column = 0


def _cells(node: Node, rows: list[list[_Cell]], notes: list[list[str]]) -> None:
    for k in node.kids:
        if isinstance(k, str):
            if k.strip():
                notes.append([_SPACE.sub(" ", k).strip()])
        elif k.tag == "tr":
            row = []
            for c in k.kids:
                if isinstance(c, str):
                    if c.strip():
                        row.append(_Cell([_SPACE.sub(" ", c).strip()]))
                else:
                    row.append(_Cell([x for x in render_node(c) if x.strip()], c.attrs))
            rows.append(row)
        elif k.tag in ("thead", "tbody", "tfoot"):
            _cells(k, rows, notes)
        elif k.tag not in ("col", "colgroup"):
            notes.append(render_node(k))


def _place(rows: list[list[_Cell]]) -> None:
    """Give every cell its column, past those that cells of earlier rows still fill."""
    filled: list[tuple[int, int, int]] = []  # first column, the one after the last, rows to go
    for row in rows:
        at, i, new = 0, 0, []
        for cell in row:
            while i < len(filled) and filled[i][0] <= at:
                at = max(at, filled[i][1])
                i += 1
            cell.column = at
            at += cell.span
            if cell.rows > 1:
                new.append((cell.column, at, cell.rows))
        filled = sorted([*filled, *new])
        merged: list[tuple[int, int, int]] = []
        for a, b, n in filled:
            if n > 1 and merged and merged[-1][1:] == (a, n - 1):
                merged[-1] = (merged[-1][0], b, n - 1)
            elif n > 1:
                merged.append((a, b, n - 1))
        filled = merged


def _wrap(line: str, width: int) -> list[str]:
    """A line in pieces of at most `width` characters, cut at spaces; a longer word is a piece of its own."""
    out, at = [], 0
    while len(line) - at > width:
        cut = line.rfind(" ", at + 1, at + width + 1)
        if cut < 0:
            cut = line.find(" ", at + width)
        if cut < 0:
            break
        out.append(line[at:cut].rstrip(" "))
        at = cut
        while at < len(line) and line[at] == " ":
            at += 1
    return [*out, line[at:]] if at < len(line) else out


def table_lines(rows: list[list[_Cell]]) -> list[str]:
    """The lines of a table; every cell starts at its column, two spaces after the widest cell before it at least."""
    _place(rows)
    starts = sorted({c.column for row in rows for c in row if c.lines})
    width = [0] * len(starts)
    laid: list[list[tuple[int, int, list[str]]]] = []
    for row in rows:
        laid.append([])
        for c in row:
            if c.lines:
                a, b = bisect_left(starts, c.column), bisect_left(starts, c.column + c.span)
                last = b == len(starts)
                laid[-1].append((a, b, c.lines if last else [p for x in c.lines for p in _wrap(x, WRAP)]))
    for wide in (False, True):
        for row in laid:
            for a, b, lines in row:
                if wide == (b - a > 1) and b < len(starts):
                    have = sum(width[a:b]) + 2 * (b - a - 1)
                    width[b - 1] += max(0, min(WRAP, max(map(len, lines))) - have)
    left = [0] * len(starts)
    for i in range(1, len(starts)):
        left[i] = left[i - 1] + width[i - 1] + 2
    out = []
    for row in laid:
        for i in range(max((len(lines) for *_, lines in row), default=0)):
            now: list[str] = []
            end = 0
            for a, _, lines in row:
                if i < len(lines):
                    if now and end + 2 > left[a]:
                        out.append("".join(now))
                        now, end = [], 0
                    now += [" " * (left[a] - end), lines[i]]
                    end = left[a] + len(lines[i])
            out.append("".join(now).rstrip())
    return out


def _walk(node: Node, out: _Out, depth: int, pre: bool) -> None:
    n = 0
    if node.tag == "ol" and (m := _START_ATTR.search(node.attrs)):
        n = int(m[1]) - 1
    for k in node.kids:
        if isinstance(k, str):
            if pre:
                first, *rest = k.split("\n")
                out._open()
                out.now.append(first)
                for x in rest:
                    out.lines.append("".join(out.now).rstrip())
                    out.now = [x]
            else:
                out.words(k)
            continue
        tag = k.tag
        if tag == "br":
            out._open()
            out.lines.append("".join(out.now).rstrip(" "))
            out.now, out.space = [], False
        elif tag == "table":
            out.end(2)
            rows: list[list[_Cell]] = []
            notes: list[list[str]] = []
            _cells(k, rows, notes)
            for note in notes:
                for x in note:
                    out.line(x)
            for x in table_lines(rows):
                out.line(x)
            out.end(2)
        elif tag == "li":
            out.end(1)
            lines = render_node(k)
            n += 1
            mark = f"{n}. " if node.tag == "ol" else "- "
            if lines:
                out.line(mark + lines[0])
                for x in lines[1:]:
                    if x:
                        out.line(" " * len(mark) + x)
            out.end(1)
        elif tag in ("ul", "ol", "menu"):
            out.end(1 if depth else 2)
            _walk(k, out, depth + 1, pre)
            out.end(1 if depth else 2)
        elif tag == "img":
            continue
        elif tag in _BLOCK or tag == "text" and node.tag in ("svg", "g", "a"):
            gap = 2 if tag in _APART else 1
            out.end(gap)
            _walk(k, out, depth, pre or tag == "pre")
            out.end(gap)
        else:
            _walk(k, out, depth, pre)


def render_node(node: Node) -> list[str]:
    out = _Out()
    _walk(node, out, 1 if node.tag == "li" else 0, node.tag == "pre")
    return out.result()


def extract(source: str | None) -> str | None:
    if source is None:
        return None
    return "\n".join(render_node(build(source))).strip("\n")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x) for x in b.column(1).to_pylist()]
        chars = [0 if t is None else len(t) for t in texts]
        lines = [0 if not t else t.count("\n") + 1 for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(chars, pa.int64()), pa.array(lines, pa.int64())], ["page_id", "text", "n_chars", "n_lines"])


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every row of pages."""
    set_batches(pages.sparkSession)
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))
