"""HTML extraction: a tree with implied tags, visibility rules, and all visible text laid out in lines.

The tree builder closes what HTML closes by itself (paragraphs before blocks, list items, options,
table rows and cells, the head before content) and ignores end tags that match nothing open.
Hidden are the head, scripts, styles, templates and other elements that browsers don't paint, closed
``details`` but for the summary, elements with ``hidden``, and what style sheets and inline styles
hide (see ``styles``): ``display: none`` with all that is inside, ``visibility: hidden`` but for what
is made visible again.

Blocks start lines; paragraphs, headings, lists, tables and quotes have one blank line around them.
List items get ``- `` or their number, and what they hold is indented to it. Quotes get ``> ``. The
lines of a table have the cells of a row side by side, two spaces apart, and columns start at
the same place, also beside and below cells that span several; a cell wider than ``WIDEST`` pushes
what follows in its row. White space collapses but in ``pre`` and ``textarea``. Images and controls
have no text.

Null and empty pages give an empty text. Pages of any size and nesting are read whole: tree and layout
don't recurse, and in more than ``INDENTS`` lists, quotes and tables around each other, text is no
further indented and cells stand below each other. Rows, also repeated ones and those with a null
id, are read one by one. An empty table gives an empty result. Further columns are kept, but for one
named like the new column, which is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches
from larder.llm.styles import Sheet, shown

INDENTS, WIDEST = 40, 60
#: The most columns and rows that HTML lets a cell span.
COLUMNS, ROWS = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNPAINTED = frozenset(
    "head script style template noscript noembed noframes iframe title datalist area audio video canvas object param "
    "svg math rp meta link base source track".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu dir listing hr fieldset xmp".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer main nav address center details summary dd dt li form figcaption "
    "legend hgroup search dialog option optgroup caption tr thead tbody tfoot td th".split()
)
#: Starting one of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
#: Start tag: (open elements that it ends, elements beyond which they aren't sought).
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_IN_HEAD = frozenset("head title meta link base style script template noscript".split())
_TABLE_SCOPE = frozenset(["table", "td", "th", "caption"])

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children", "displayed", "visible")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Element | str] = []
        self.displayed = self.visible = True


def parse(source: str) -> Element:
    """The tree below a root, each element with whether it is displayed and visible."""
    root, sheet = Element("html", {}), Sheet()
    stack, opened = [root], Counter()

    def close(upto: int) -> None:
        for element in stack[upto:]:
            opened[element.tag] -= 1
        del stack[upto:]

    def find(tags: frozenset[str], barrier: frozenset[str]) -> int:
        if not any(opened[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in barrier:
                return 0
        return 0

    def open_(tag: str, attrs: dict[str, str]) -> None:
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if tag in ENDS_P and (at := find(frozenset(["p"]), _TABLE_SCOPE | {"button"})):
            close(at)
        if tag in IMPLIED:
            while at := find(*IMPLIED[tag]):
                close(at)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_("tr", {})
        element = Element(tag, attrs)
        stack[-1].children.append(element)
        if tag not in VOID:
            stack.append(element)
            opened[tag] += 1

    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            if stack[-1].tag == "head" and text.strip():
                close(len(stack) - 1)
            stack[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        if not found["name"]:
            continue
        tag = found["name"].lower()
        if found["end"]:
            if tag == "p" and not find(frozenset(["p"]), _TABLE_SCOPE):
                stack[-1].children.append(Element("p", {}))
            elif tag == "br":
                stack[-1].children.append(Element("br", {}))
            elif tag not in ("html", "body"):
                barrier = frozenset() if tag in ("table", "body") else frozenset(["table"])
                if tag in ("li",):
                    barrier |= {"ul", "ol"}
                if tag not in BLOCKS:
                    barrier |= {"td", "th"}
                close(find(frozenset([tag]), barrier) or len(stack))
            continue
        attrs = {}
        for name, a, b, c in _ATTR.findall(found["attrs"]):
            attrs.setdefault(name.lower(), html.unescape(a or b or c))
        if tag in ("html", "body"):
            if tag == "body" and (at_head := find(frozenset(["head"]), frozenset())):
                close(at_head)
            root.attrs = attrs | root.attrs
            continue
        if tag in RAW:
            ended = _RAW_END[tag].search(source, at)
            end = ended.start() if ended else len(source)
            body = source[at:end]
            if tag == "style":
                sheet.add(body)
            element = Element(tag, attrs)
            if tag == "textarea":
                element.children.append(html.unescape(body))
            stack[-1].children.append(element)
            close_tag = source.find(">", end)
            at = len(source) if close_tag < 0 else close_tag + 1
            continue
        open_(tag, attrs)
    judge(root, sheet)
    return root


def judge(root: Element, sheet: Sheet) -> None:
    """Mark every element that is not displayed, or not visible."""
    stack: list[tuple[Element, int, int, bool]] = [(root, 0, 0, True)]
    while stack:
        element, parent, above, visible = stack.pop()
        attrs = element.attrs
        here, won = sheet.match(element.tag, attrs, parent, above)
        element.displayed, own = shown(won, attrs)
        if element.tag in UNPAINTED or (element.tag == "dialog" and "open" not in attrs):
            element.displayed = False
        element.visible = visible if own is None else own
        if element.displayed:
            stack.extend((c, here, above | here, element.visible) for c in element.children if not isinstance(c, str))


class _Flow:
    """Lines of a block; a blank line is kept back until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.space = False

    def text(self, text: str, kept: bool) -> None:
        if kept:
            rows = text.replace("\r\n", "\n").split("\n")
            for i, row in enumerate(rows):
                if i:
                    self.end(True)
                self.parts.append(row)
            self.space = False
            return
        text = _SPACE.sub(" ", text)
        if not text:
            return
        if text[0] == " " and (not self.parts or self.space):
            text = text[1:]
        if text:
            self.parts.append(text)
            self.space = text[-1] == " "

    def end(self, forced: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.space = [], False
        if line or forced:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if lines and self.gap and self.lines:
            self.lines.append("")
        if lines:
            self.gap = False
            self.lines.extend(lines)

    def block(self, lines: list[str], spaced: bool) -> None:
        self.end()
        self.gap |= spaced
        self.add(lines)
        self.gap |= spaced


#: A step of the layout that asks for others by yielding them, and gets their results.
Step = Generator["Step", list[str], list[str]]


def _run(step: Step) -> list[str]:
    """The result of a step. Steps under way are on a list, so nesting is not bounded by the interpreter's."""
    under, result = [step], None
    while under:
        try:
            asked = under[-1].send(result)
        except StopIteration as done:
            under.pop()
            result = done.value
        else:
            under.append(asked)
            result = None
    return result


def _lines(element: Element, kept: bool, depth: int) -> Step:
    flow = _Flow()
    yield _fill(element, flow, kept, depth)
    flow.end()
    return flow.lines


def _fill(element: Element, flow: _Flow, kept: bool, depth: int) -> Step:
    """Lay out the children of an element."""
    number = _number(element.attrs.get("start"), 1) if element.tag == "ol" else 0
    summary_only = element.tag == "details" and "open" not in element.attrs
    for child in element.children:
        if isinstance(child, str):
            if element.visible and not summary_only:
                flow.text(child, kept)
            continue
        if not child.displayed or (summary_only and child.tag != "summary"):
            continue
        tag = child.tag
        mark = "- " if tag == "li" else ""
        if tag == "li" and element.tag == "ol":
            number = _number(child.attrs.get("value"), number)
            mark, number = f"{number}. ", number + 1
        if tag == "br":
            flow.end(True)
        elif tag == "hr":
            flow.block([], True)
        elif tag in ("pre", "textarea", "listing"):
            lines = yield _lines(child, True, depth)
            flow.block(lines[1:] if len(lines) > 1 and not lines[0] else lines, tag in SPACED)
        elif tag in ("li", "blockquote", "dd", "table") and depth < INDENTS:
            if tag == "table":
                flow.block((yield _table(child, depth + 1)), True)
                continue
            lines = yield _lines(child, kept, depth + 1)
            if tag == "li":
                lines, pad = (lines or [""]) if child.visible else lines, " " * len(mark)
                lines = [((pad if i or not child.visible else mark) + x).rstrip(" ") for i, x in enumerate(lines)]
            else:
                lines = [("> " if tag == "blockquote" else "    ") + x for x in lines]
                lines = [x.rstrip(" ") for x in lines]
            flow.block(lines, tag == "blockquote")
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol") and element.tag == "li"
            flow.block([], tag in SPACED and not nested)
            if mark and child.visible:
                flow.text(mark, True)
            yield _fill(child, flow, kept, depth)
            flow.block([], tag in SPACED and not nested)
        else:
            yield _fill(child, flow, kept, depth)
    return []


def _number(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,9}", value) else other


def _span(cell: Element, name: str, most: int) -> int:
    return max(1, min(most, _number(cell.attrs.get(name), 1)))


def _rows(table: Element) -> tuple[list[tuple[Element, int]], list[Element]]:
    """The rows of a table with the number of those that follow in their part, and its children that stand in no row."""
    rows, left, around = [], [], []

    def part(element: Element) -> None:
        for child in element.children:
            if isinstance(child, str):
                if child.strip() and element.visible:
                    around.append(_wrapped(child, element.visible))
            elif child.displayed:
                if child.tag == "tr":
                    rows.append(child)
                elif child.tag in ("thead", "tbody", "tfoot") and element is table:
                    ended()
                    part(child)
                elif child.tag not in ("colgroup", "col"):
                    around.append(_wrapped(child, element.visible))
        ended()

    def ended() -> None:
        left.extend(len(rows) - 1 - k for k in range(len(left), len(rows)))

    part(table)
    return list(zip(rows, left, strict=True)), around


def _wrapped(child: Element | str, visible: bool) -> Element:
    out = Element("div", {})
    out.visible = visible
    out.children.append(child)
    return out


def _table(table: Element, depth: int) -> Step:
    rows, around = _rows(table)
    lines: list[str] = []
    for x in around:
        lines += yield _lines(x, False, depth)
    grid: list[list[tuple[int, list[str]]]] = []
    widths: list[int] = []
    spans: list[tuple[int, int, int]] = []
    taken: dict[int, int] = {}  # columns in which a cell of an earlier row goes on, and for how many rows
    for row, below in rows:
        column, cells = 0, []
        now, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
        for child in row.children:
            if isinstance(child, str):
                if not child.strip():
                    continue
                child = _wrapped(child, row.visible)
            if not child.displayed:
                continue
            while column in now:
                column += 1
            span, down = _span(child, "colspan", COLUMNS), _span(child, "rowspan", ROWS)
            if child.attrs.get("rowspan") == "0":
                down = ROWS
            down = min(down - 1, below)
            cell = yield _lines(child, False, depth)
            cells.append((column, cell))
            widths.extend([0] * (column + span - len(widths)))
            spans.append((span, column, min(WIDEST, max(map(len, cell), default=0))))
            if down:
                taken.update((c, max(down, taken.get(c, 0))) for c in range(column, column + span))
            column += span
        grid.append(cells)
    # What a cell over several columns needs beyond the others is added to its last one.
    for span, column, width in sorted(spans):
        inner = sum(w + 2 * (w > 0) for w in widths[column : column + span - 1])
        widths[column + span - 1] = max(widths[column + span - 1], width - inner)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2 * (width > 0))
    for cells in grid:
        for k in range(max((len(cell) for _, cell in cells), default=0)):
            line = ""
            for column, cell in cells:
                if k < len(cell) and cell[k]:
                    gap = max(starts[column] - len(line), 2 if line else 0)
                    line += " " * gap + cell[k]
            lines.append(line.rstrip(" "))
    return lines


def render(source: str | None) -> str:
    """All visible text of a page."""
    if not source:
        return ""
    root = parse(source)
    lines = _run(_lines(root, False, 0)) if root.displayed else []
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, html_col: str = "html", out: str = "rendered") -> DataFrame:
    """Adds ``out`` string, the text of each page, in place of ``html_col``."""
    keep = [c for c in pages.columns if c not in (html_col, out)]
    return map_batches(pages, [html_col], lambda rows: [[render(r) for r in rows]], f"`{out}` string", keep)


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, rendered, n_lines, text_sha256."""
    found = extract(pages.select("page_id", "html"))
    lines = F.when(F.col("rendered") == "", 0).otherwise(F.size(F.split("rendered", "\n"))).cast("long")
    return found.select("page_id", "rendered", lines.alias("n_lines"), F.sha2("rendered", 256).alias("text_sha256"))
