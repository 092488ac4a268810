"""Visible text of web pages by layout-aware rendering.

A tolerant scanner finds tags, comments and raw-text elements; a tree builder keeps the
stack of open elements, closes those whose end is implied (a paragraph by a block, a
list item by the next, rows and cells by rows and cells) and drops end tags without a
start. Elements that a browser does not show give no text: scripts, styles, the head,
templates, and those with a hidden attribute or an inline style of display:none or
visibility:hidden. What is left is laid out: inline white space collapses, blocks start
lines and keep their spacing, list items carry a bullet or number and are indented,
preformatted text stays as it is, and the cells of a table are padded so that columns
line up, with cells of several lines side by side.

Nothing recurses and the scanner moves on with each step, so neither deep nesting nor
unclosed quotes cost more than time in proportion to the page. A null or empty page
gives an empty text. The work is map-only; rows that repeat are answered alike. Columns
of the input that are named as the one added, in any case, stay, and that one gets an
underscore more.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, ship, tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template datalist object audio video canvas iframe noembed noframes svg math".split())
RAW = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
#: Blank lines around a block: 0 starts a line, 1 leaves one line free.
BLOCKS = dict.fromkeys("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section select summary caption tr tbody thead tfoot td th".split(), 0) | dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 1)
CLOSES_P = frozenset(BLOCKS) - {"option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html"}
#: What a start tag ends, and the elements that its search does not leave.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    **{n: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})) for n in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
_SCOPE = frozenset({"table", "td", "th", "caption", "html", "template", "object"})
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'=/]""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HEAD_ONLY = frozenset("base link meta title style script template noscript basefont bgsound".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('start', name, attributes as written) and ('end', name, '') of a page, in order."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if lt > at:
                yield "text", page[at:lt], ""
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        close = nxt == "/"
        m = _NAME.match(page, lt + 1 + close)
        if m is None:
            if close:
                if lt > at:
                    yield "text", page[at:lt], ""
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", page[at : lt + 1], ""
                at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        end = page.find(">", m.end())
        if end < 0:
            return
        rest = page[m.end() : end]
        if '"' in rest or "'" in rest:
            end = _tag_end(page, m.end(), end)
            rest = page[m.end() : end]
        name, at = m[0].lower(), end + 1
        yield ("end", name, "") if close else ("start", name, rest)
        if not close and name in RAW:
            stop = RAW[name].search(page, at)
            body = page[at : stop.start() if stop else n]
            if body:
                yield "text", body, name
            at = stop.start() if stop else n


def _tag_end(page: str, at: int, first: int) -> int:
    """The '>' that ends a tag with quoted values; the first one if a quote stays open."""
    while True:
        gt = page.find(">", at)
        if gt < 0:
            return first
        quote = min((k for k in (page.find('"', at, gt), page.find("'", at, gt)) if k >= 0), default=-1)
        if quote < 0:
            return gt
        if page[quote - 1 : quote] != "=" and not page[at:quote].rstrip().endswith("="):
            at = quote + 1
            continue
        end = page.find(page[quote], quote + 1)
        if end < 0:
            return first
        at = end + 1


def hidden(attributes: str) -> bool:
    low = attributes.lower()
    if "hidden" not in low and "none" not in low and "collapse" not in low:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or "").lower()
        if name == "hidden" or name == "style" and _HIDDEN.search(html.unescape(m[2] or m[3] or m[4] or "")):
            return True
    return False


def _attribute(attributes: str, name: str) -> str | None:
    return next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if (m[1] or "").lower() == name), None)


class Flow:
    """Lines of a block container: collapsed inline text, blank lines between blocks, indents and markers."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = -1  # blank lines that are due before the next line; -1: none before the first
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if words == " " or not words:
            self.space = self.space or bool(words and self.now)
            return
        if self.now and (self.space or words[0] == " "):
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def verbatim(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").split("\n")
        for k, part in enumerate(parts):
            if k:
                self.line(True)
            if part:
                self.now.append(part)

    def line(self, keep: bool = False) -> None:
        """Ends the line; keep: also if it is empty."""
        if not self.now and not keep:
            return
        line, self.now, self.space = "".join(self.now), [], False
        if self.gap > 0 and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = "".join(self.indent)
        if self.marker is not None and self.indent:
            lead = "".join(self.indent[:-1]) + self.marker
            self.marker = None
        self.lines.append((lead + line).rstrip() if not keep else lead + line)

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.line()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []
        self.caption: list[str] = []

    def lines(self) -> list[str]:
        rows = [r for r in self.rows if any(any(c) for c, _ in r)]
        width: list[int] = []
        for r in rows:
            col = 0
            for cell, span in r:
                width += [0] * (col + 1 - len(width))
                if span == 1:
                    width[col] = max(width[col], max(map(len, cell), default=0))
                col += span
            width += [0] * (col - len(width))
        out = list(self.caption)
        for r in rows:
            for k in range(max(1, *(len(c) for c, _ in r))):
                parts, col = [], 0
                for cell, span in r:
                    room = sum(width[col : col + span]) + 3 * (span - 1)
                    parts.append((cell[k] if k < len(cell) else "").ljust(room))
                    col += span
                out.append(" | ".join(parts).rstrip())
        return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    flows, tables = [Flow()], []
    stack: list[tuple[str, bool]] = []  # open elements and whether they are unseen themselves
    dark = pre = 0
    lists: list[list] = []
    held: Counter[str] = Counter()  # open elements by name, so that no search of the stack is in vain

    def leave() -> None:
        nonlocal dark, pre
        name, unseen = stack.pop()
        held[name] -= 1
        if unseen:
            dark -= 1
        if name in ("pre", "xmp", "textarea"):
            pre -= 1
        if dark or unseen:
            return
        if name in ("td", "th", "caption") and tables and len(flows) > 1:
            lines = flows.pop().done()
            if name == "caption":
                tables[-1].caption += lines
            elif tables[-1].rows:
                tables[-1].rows[-1].append((lines, spans.pop() if spans else 1))
            return
        if name == "table" and tables:
            made = tables.pop().lines()
            flow = flows[-1]
            flow.block(1)
            for x in made:
                flow.now.append(x)
                flow.line()
            flow.block(1)
            return
        if name in ("ul", "ol", "menu") and lists:
            lists.pop()
        if name == "li" and lists and flows[-1].indent:
            flow = flows[-1]
            if flow.marker is not None:
                flow.line(keep=True)
            else:
                flow.line()
            flow.indent.pop()
            return
        if name in BLOCKS and name not in ("tr", "tbody", "thead", "tfoot"):
            flows[-1].block(0 if lists and name in ("ul", "ol", "menu") else BLOCKS[name])
            if name in ("dd", "blockquote") and flows[-1].indent:
                flows[-1].indent.pop()

    def close(names: frozenset[str], within: frozenset[str]) -> None:
        """Closes the outermost of the names that is open inside `within`."""
        k = len(stack) - 1 if any(held[x] for x in names) else -1
        found = -1
        while k >= 0 and stack[k][0] not in within:
            if stack[k][0] in names:
                found = k
            k -= 1
        if found >= 0:
            while len(stack) > found:
                leave()

    spans: list[int] = []
    for kind, value, more in tokens(page):
        if kind == "text":
            if dark:
                if not more and stack and stack[-1][0] == "head" and value.strip():
                    leave()  # text ends the head
                else:
                    continue
            if more != "xmp" and "&" in value:
                value = html.unescape(value)
            if tables and len(flows) <= len(tables) and not value.strip():
                continue
            (flows[-1].verbatim if pre else flows[-1].text)(value)
        elif kind == "start":
            name = value
            if stack and stack[-1][0] == "head" and name not in _HEAD_ONLY:
                leave()
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in CLOSES_P and held["p"]:
                close(frozenset({"p"}), _SCOPE)
            unseen = name in UNSEEN or hidden(more)
            if name in VOID:
                if dark or unseen:
                    continue
                if name == "br":
                    flows[-1].line(keep=True)
                elif name == "hr":
                    flows[-1].block(1)
                continue
            stack.append((name, unseen))
            held[name] += 1
            if unseen:
                dark += 1
            if name in ("pre", "xmp", "textarea"):
                pre += 1
            if dark:
                continue
            flow = flows[-1]
            if name == "table":
                flow.block(1)
                tables.append(Table())
            elif name == "tr" and tables:
                tables[-1].rows.append([])
            elif name in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                span = _attribute(more, "colspan") or "1"
                spans.append(max(1, min(100, int(span))) if span.isdecimal() else 1)
                flows.append(Flow())
            elif name == "caption" and tables:
                flows.append(Flow())
            elif name in ("ul", "ol", "menu"):
                flow.block(0 if lists else 1)
                start = _attribute(more, "start") or "1"
                lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif name == "li" and lists:
                flow.block(0)
                marker = f"{lists[-1][1]}. " if lists[-1][0] else "- "
                lists[-1][1] += 1
                flow.indent.append(" " * len(marker))
                flow.marker = marker
            elif name in BLOCKS and name not in ("tbody", "thead", "tfoot"):
                flow.block(BLOCKS[name])
                if name in ("dd", "blockquote"):
                    flow.indent.append("  ")
        elif value == "p" and not held["p"]:
            if not dark:
                flows[-1].block(1)
        elif value == "br":
            if not dark:
                flows[-1].line(keep=True)
        elif value not in VOID:
            stop = frozenset({"table"}) if value not in ("table", "body", "html") else frozenset()
            k = len(stack) - 1 if held[value] else -1
            while k >= 0 and stack[k][0] != value and stack[k][0] not in stop:
                k -= 1
            if k >= 0 and stack[k][0] == value and value not in ("body", "html"):
                while len(stack) > k:
                    leave()
    while stack:
        leave()
    lines = flows[0].done()
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of each added."""
    ship(pages.sparkSession)
    schema = plus(pages, **{out: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(x) for x in b[source].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[f.name for f in schema])

    return pages.mapInArrow(tidy(run), schema)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, the text, and its length."""
    return extract(pages.select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
