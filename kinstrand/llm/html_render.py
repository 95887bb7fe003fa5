"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (html, head and body; end tags of p, li, dt, dd,
option, rows, cells and row groups) make a tree; visibility rules take out what a browser doesn't show; the rest is laid out as
plain text: white space collapses outside ``pre``, blocks start lines, paragraphs, headings, lists
and tables have a blank line around them, list items get a bullet or their number and a hanging
indent, and table cells are padded to columns. No step recurses, so depth is no limit, and each
character is looked at a bounded number of times.

Cells are padded to the width of the widest one of their column where the column begins within the first 240 code points of a line; two blanks
part the cells of columns beyond, so a line of a table has a bounded number of blanks, whatever else is on the page. Cells that span rows or columns take the places
that they cover, and what a browser shows of formulas and drawings (``math``, the text elements of ``svg``) is text as well.

Null html gives null text; an empty page an empty text. Broken markup is rendered as far as a browser would:
unknown end tags are ignored, an unfinished tag at the end is dropped, a lone ``<`` is text.
Null ids, repeated rows and other columns are kept; a column of the input that is called as the result gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SHOWN_RAW = frozenset("textarea xmp".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object canvas audio video datalist annotation annotation-xml area base col colgroup link meta param source track embed".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure fieldset hr menu".split())
BLOCKS = SPACED | frozenset("html body address article aside details dialog dd div dt figcaption footer form header hgroup legend li main nav section summary tr caption optgroup option center search".split())
CLOSES_P = SPACED | frozenset("address article aside details div footer form header hgroup main nav section dd dt li figcaption center dialog search summary".split())
#: Of a drawing, what is shown as text; and what never is.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_HIDDEN = frozenset("title desc defs metadata symbol".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())

#: Of a start tag: which open elements it closes, and what stops the search for them.
IMPLIED_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset("ul ol menu table td th body".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset("dl table td th body".split())),
    "dd": (frozenset({"dt", "dd"}), frozenset("dl table td th body".split())),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup", "body"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "body"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
}
P_SCOPE = frozenset("table td th caption button object body".split())

_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"'=]*)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _events(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", string, None), ("start", tag, attributes) and ("end", tag, None)."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], None
            return
        if lt > at:
            yield "text", page[at:lt], None
        m = _PLAIN_TAG.match(page, lt)
        attributes: dict[str, str] | None = None
        if m:
            close, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
            at = m.end()
            if not close and rest and not rest.isspace() and rest != "/":
                attributes = {x.lower(): "" for x in rest.replace("/", " ").split()}
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 4 if not page.startswith("<!-->", lt) else lt + 2)
            if end < 0:
                return
            at = end + 3
            continue
        elif page.startswith(("<!", "<?"), lt) or (page.startswith("</", lt) and lt + 2 < n and not page[lt + 2].isalpha()):
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
            continue
        elif name := _NAME.match(page, lt):
            close, tag = page[lt + 1] == "/" and "/", name.group(1).lower()
            attributes, at = {}, name.end()
            while at < n and page[at] != ">":
                a = _ATTRIBUTE.match(page, at)
                if not a:
                    at += 1
                    continue
                at, value = a.end(), ""
                if a.group(2):
                    if at < n and page[at] in "\"'":
                        end = page.find(page[at], at + 1)
                        if end < 0:
                            return
                        value, at = page[at + 1 : end], end + 1
                    else:
                        u = _UNQUOTED.match(page, at)
                        value, at = u.group(), u.end()
                attributes.setdefault(a.group(1).lower(), html_lib.unescape(value) if "&" in value else value)
            if at >= n:
                return
            at += 1
        else:
            yield "text", "<", None
            at = lt + 1
            continue
        if close:
            yield "end", tag, None
            continue
        yield "start", tag, attributes
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            if body and tag in SHOWN_RAW:
                yield "raw" if tag == "xmp" else "text", body, None
            yield "end", tag, None
            if not end:
                return
            gt = page.find(">", end.end())
            at = gt + 1 if gt >= 0 else n
        elif tag == "plaintext":
            yield "text", page[at:], None
            return


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    body = Node("body")
    root.children.append(body)
    stack = [root, body]
    head: Node | None = None
    open_: dict[str, int] = {}  # how many elements of each name are open: most searches end here

    def push(tag: str, attributes: dict[str, str] | None) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1

    def pop_to(names: frozenset[str], stops: frozenset[str]) -> None:
        if not any(open_.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in names:
                for x in stack[i:]:
                    open_[x.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    nowhere: frozenset[str] = frozenset()
    cells = frozenset({"td", "th", "caption", "table"})
    for kind, value, attributes in _events(page):
        if kind in ("text", "raw"):
            if kind == "raw" and "&" in value:
                value = value.replace("&", "&amp;")
            if head is not None and not value.isspace() and stack[-1] is head:
                stack.pop()
                head = None
            stack[-1].children.append(value)
        elif kind == "start":
            if value in ("html", "body"):
                target = root if value == "html" else body
                for k, v in (attributes or {}).items():
                    target.attributes.setdefault(k, v)
                if head is not None and stack[-1] is head:
                    stack.pop()
                    head = None
                continue
            if value == "head":
                if head is None and len(stack) == 2 and not any(isinstance(c, Node) for c in body.children):
                    head = Node("head", attributes)
                    root.children.insert(0, head)
                    stack.append(head)
                continue
            if head is not None and stack[-1] is head and value not in HEAD_ONLY:
                stack.pop()
                head = None
            if value in CLOSES_P:
                pop_to(frozenset({"p"}), P_SCOPE)
            if value in IMPLIED_ENDS:
                pop_to(*IMPLIED_ENDS[value])
            if value in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1].tag):
                open_[stack.pop().tag] -= 1
            # rows and cells that lack their parents get them
            if value in ("tr", "td", "th") and open_.get("table"):
                if value != "tr" and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                    push("tr", None)
            push(value, attributes)
        else:
            if value == "head":
                if head is not None and stack[-1] is head:
                    stack.pop()
                head = None
            elif value == "p" and not open_.get("p"):
                pop_to(frozenset({"p"}), P_SCOPE)
                push("p", None)
                pop_to(frozenset({"p"}), P_SCOPE)
            elif value == "br":
                push("br", None)
            elif value in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop_to(frozenset(f"h{i}" for i in range(1, 7)), cells)
            elif value not in VOID and value not in ("html", "body"):
                pop_to(frozenset({value}), nowhere if value in TABLE_PARTS and value == "table" else frozenset({"table"}) if value in TABLE_PARTS else cells)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if not a:
        return True
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _INVISIBLE.search(a["style"]))


class _Flow:
    """Lines of a block container: text runs, collapsed white space and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.blank = self.broken = 0  # margins that are due before the next text
        self.space = False
        self.prefix: list[str] = []  # indents of open lists
        self.marker = ""

    def indent(self) -> str:
        if self.marker:
            out = "".join(self.prefix[:-1]) + self.marker
            self.marker = ""
            return out
        return "".join(self.prefix)

    def text(self, value: str) -> None:
        value = _SPACE.sub(" ", value)
        if value == " " or not value:
            self.space = self.space or bool(value)
            return
        core = value.strip(" ")
        if self.run:
            if self.space or value[0] == " ":
                self.run.append(" ")
        else:
            self._start()
        self.run.append(core)
        self.space = value[-1] == " "

    def _start(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = 0
        self.run.append(self.indent())

    def end_line(self) -> None:
        if self.run:
            self.lines.append("".join(self.run).rstrip(" "))
            self.run = []
        self.space = False

    def line_break(self) -> None:
        if self.run:
            self.end_line()
        elif self.lines and not self.blank:
            self.lines.append("")

    def margin(self) -> None:
        self.end_line()
        self.blank = 1

    def whole_lines(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            if not self.run and self.blank and self.lines:
                self.lines.append("")
            self.blank = 0
            self.lines.append((self.indent() + line).rstrip(" "))

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Cell:
    """A table cell: its lines, and how many columns and rows it spans."""

    __slots__ = ("columns", "lines", "rows")

    def __init__(self, lines: list[str], columns: int = 1, rows: int = 1) -> None:
        self.lines, self.columns, self.rows = lines, columns, rows


#: Code points of a line within which columns begin that cells are padded to.
ALIGNED = 240

#: A browser's greatest spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _places(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Of each row, its cells with their first columns; columns that a cell of a row above reaches into are taken."""
    taken: dict[int, int] = {}  # column -> rows for which it is taken yet
    out = []
    for row in rows:
        at, placed = 0, []
        fresh: dict[int, int] = {}
        for cell in row:
            while taken.get(at, 0):
                at += 1
            placed.append((at, cell))
            for c in range(at, at + cell.columns):
                if cell.rows > 1:
                    fresh[c] = cell.rows - 1
            at += cell.columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
        out.append(placed)
    return out


def _laid_out(rows: list[list[Cell]]) -> list[str]:
    """A table's lines, cells padded to the columns that begin within ``ALIGNED``. A cell that needs more than the columns it spans widens the last of them."""
    placed = _places(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for at, cell in row:
            if cell.columns == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, cell.lines), default=0))
    used = sorted({c for c, w in widths.items() if w} | {at for row in placed for at, cell in row if cell.lines})
    for _, at, cell in sorted(((cell.columns, at, cell) for row in placed for at, cell in row if cell.columns > 1 and cell.lines), key=lambda x: x[:2]):
        inside = used[bisect_left(used, at) : bisect_left(used, at + cell.columns)]
        lack = max(map(len, cell.lines)) - sum(widths.get(c, 0) + 2 for c in inside) + 2
        if lack > 0:
            widths[inside[-1]] = widths.get(inside[-1], 0) + lack
    starts, x = {}, 0
    for c in used:
        starts[c] = x if x <= ALIGNED else 0
        x += widths.get(c, 0) + 2
    out = []
    for row in placed:
        shown = [(starts[at], cell.lines) for at, cell in row if cell.lines]
        for k in range(max((len(lines) for _, lines in shown), default=0)):
            parts, x = [], 0
            for start, lines in shown:
                if k < len(lines):
                    pad = max(start - x, 2 if parts else 0)
                    parts.append(" " * pad + lines[k])
                    x += pad + len(lines[k])
            out.append("".join(parts).rstrip(" "))
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(most, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def render(page: str) -> str:
    """The visible text of a page."""
    flows = [_Flow()]
    lists: list[list] = []  # [ordered, next number]
    tables: list[list[list[Cell]]] = []
    pre = 0
    shown: list[bool] = []  # of open drawings and texts in them: whether characters there are shown
    todo: list[tuple[bool, Node | str]] = [(False, build(page))]
    while todo:
        leave, node = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if shown and not shown[-1]:
                continue
            value = html_lib.unescape(node) if "&" in node else node
            if tables and len(flows) == len(tables) and not value.strip():
                continue
            if not pre:
                flow.text(value)
                continue
            first, *rest = value.replace("\r\n", "\n").split("\n")
            for i, line in enumerate([first, *rest]):
                if i:
                    if flow.run:
                        flow.end_line()
                    else:
                        flow.whole_lines([""])
                if line:
                    if not flow.run:
                        flow._start()
                    flow.run.append(line)
            continue
        tag = node.tag
        if not leave:
            if not visible(node) or shown and tag in SVG_HIDDEN:
                continue
            if tag == "svg" or shown and tag in SVG_TEXT:
                flow.space = True  # parts of a drawing stand apart
                shown.append(tag != "svg")
            if tag == "br":
                flow.line_break()
                continue
            if tag == "hr":
                flow.margin()
                continue
            if tag in VOID:
                continue
            if tag in ("td", "th") and tables:
                flows.append(_Flow())
            elif tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                flow.margin()
            elif tag in BLOCKS:
                flow.end_line()
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else [False, 1]
                given = node.attributes.get("value", "")
                if kind[0] and re.fullmatch(r"-?\d{1,9}", given):
                    kind[1] = int(given)
                marker = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
                if flow.marker:
                    flow.whole_lines([""])
                flow.prefix.append(" " * len(marker))
                flow.marker = marker
            elif tag in ("dd", "blockquote"):
                flow.prefix.append("  ")
            elif tag in ("pre", "xmp"):
                pre += 1
                if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                    node.children[0] = node.children[0][1:]
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            todo.append((True, node))
            todo += [(False, c) for c in reversed(node.children)]
            continue
        if tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(Cell(flows.pop().done(), _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", MOST_ROWS)))
            continue
        if shown and (tag == "svg" or tag in SVG_TEXT):
            shown.pop()
            flow.space = True
        if tag == "table":
            lines = _laid_out(tables.pop())
            flow.whole_lines(lines)
            flow.margin()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            flow.end_line()
            if not lists:
                flow.margin()
        elif tag == "li":
            flow.end_line()
            flow.marker = ""
            flow.prefix.pop()
        elif tag in ("dd", "blockquote"):
            flow.end_line()
            flow.prefix.pop()
            if tag == "blockquote":
                flow.margin()
        elif tag in ("pre", "xmp"):
            pre -= 1
            flow.margin()
        elif tag in SPACED:
            flow.margin()
        elif tag in BLOCKS:
            flow.end_line()
    return "\n".join(flows[0].done())


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (all columns; html is rendered and left out) with ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, name in enumerate(batch.schema.names) if name != "html"]
            text = [None if x is None else render(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(text, pa.string())], names=[*(batch.schema.names[i] for i in kept), "text"])

    plain = pages.drop("text")
    kinds = [(f.name, f.dataType.simpleString()) for f in plain.schema if f.name != "html"] + [("text", "string")]
    return plain.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds))
