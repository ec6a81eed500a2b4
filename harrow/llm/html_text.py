"""HTML to text by layout: a tree with implied tags and visibility, rendered with blocks, lists and tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import batched, rows

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object datalist audio video canvas".split())
#: Parts of an svg or math element that are not drawn themselves.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask annotation annotation-xml".split())
#: What may stand in a head; any other tag, and any text, ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Table parts that are not shown or have a place of their own.
TABLE_PARTS = frozenset("tr td th thead tbody tfoot caption col colgroup".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table caption tr ul".split()
)
#: Blocks with an empty line above and below.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section".split())
CLOSES_P = BLOCK - frozenset("body html tr caption".split())
#: A start tag closes these open elements, up to the scope that holds them.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: End tags don't reach out of a cell, a caption or a table.
WALLS = frozenset(["td", "th", "caption", "table"])
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
TAG_STOP = re.compile("[>\"']")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Spans beyond these count as so many (fixed by the HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Items nested deeper are not indented further.
DEEPEST_INDENT = 80
#: Table cells that would begin further right follow the cell before them.
WIDEST_TABLE = 2000


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def visible(self) -> bool:
        a = self.attributes
        if self.tag in HIDDEN or self.tag == "dialog" and "open" not in a:
            return False
        return not (a and ("hidden" in a or "style" in a and UNSEEN_STYLE.search(a["style"])))


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def tokens(source: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, tag or text, attributes, end) with kind ``text``, ``start`` or ``end``; the caller sends back where to go on.

    The page is walked once: what ends a tag or a quote is looked for forwards from where the walk is, and a quote or
    bracket that is found to be missing in the rest is not looked for again. A tag that never ends is text to the end.
    """
    at = begin = 0
    size = len(source)
    missing: set[str] = set()
    while at < size:
        at = source.find("<", at)
        if at < 0 or ">" in missing:
            break
        comment = source.startswith("<!--", at)
        if comment or source[at + 1 : at + 2] in ("!", "?"):
            end = source.find("-->" if comment else ">", at + (4 if comment else 2))
            end = size if end < 0 else end + (3 if comment else 1)
            if begin < at:
                yield "text", source[begin:at], "", at
            at = begin = end
            continue
        closing = source.startswith("/", at + 1)
        name = TAG_NAME.match(source, at + 1 + closing)
        if not name:
            at += 1
            continue
        stop = name.end()
        while True:
            found = TAG_STOP.search(source, stop)
            if not found:
                missing.add(">")
                break
            if found[0] == ">":
                break
            close = -1 if found[0] in missing else source.find(found[0], found.end())
            if close < 0:  # a quote without a partner is a character like any other
                missing.add(found[0])
                stop = found.end()
            else:
                stop = close + 1
        if ">" in missing:
            break
        if begin < at:
            yield "text", source[begin:at], "", at
        moved = yield ("end" if closing else "start"), name[0].lower(), source[name.end() : found.start()], found.end()
        at = begin = moved or found.end()
        if moved:
            yield "moved", "", "", moved
    if begin < size:
        yield "text", source[begin:], "", size


class Tree:
    """Open elements and, by tag, how deep they are, so that closing needs no walk down the stack."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = {}

    def top(self) -> Node:
        return self.stack[-1]

    def add(self, node: Node | str) -> None:
        self.stack[-1].children.append(node)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.depths[self.stack.pop().tag].pop()

    def deepest(self, tags: set | frozenset) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def within(self, *tags: str) -> bool:
        return any(self.depths.get(t) for t in tags)

    def close(self, tags: set | frozenset, walls: set | frozenset) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``walls`` is open inside it."""
        depth = self.deepest(tags)
        if not depth or self.deepest(walls - tags) > depth:
            return False
        while len(self.stack) > depth:
            self.pop()
        return True


def parse(source: str) -> Node:
    """The tree of a page. Unclosed elements end where the standard implies it, unmatched end tags are passed over."""
    tree = Tree()
    walk = tokens(source)
    token = next(walk, None)
    while token:
        kind, tag, rest, end = token
        back = None
        if kind == "text":
            if tree.top().tag == "head" and tag.strip():
                tree.pop()
            tree.add(html.unescape(tag))
        elif kind == "end":
            if tag == "p" and not tree.within("p"):
                tree.add(Node("p", {}))
            elif tag == "br":
                tree.add(Node("br", {}))
            elif tag not in ("html", "body"):
                tree.close({tag}, WALLS - {tag} if tag not in ("tr", "thead", "tbody", "tfoot", "table") else {"table"} - {tag})
        elif kind == "start" and tag != "html":
            if tag in CLOSES_P:
                tree.close({"p"}, WALLS | {"button"})
            if tag in IMPLIED_END:
                tags, walls = IMPLIED_END[tag]
                while tree.close(tags, walls):
                    pass
            if tree.top().tag == "head" and tag not in HEAD_CONTENT and tag != "head":
                tree.pop()
            elif tag in BLOCK and tree.within("head") and not tree.within("template"):
                tree.close({"head"}, frozenset())
            node = Node(tag, attributes_of(rest) if "=" in rest or "hidden" in rest.lower() or tag in ("dialog", "input", "details", "ol") else {})
            foreign = tree.within("svg", "math")
            if tag in UNDRAWN and foreign:
                node.attributes["hidden"] = ""
            tree.add(node)
            if tag in VOID or rest.endswith("/") and (tag in ("svg", "math") or foreign):
                pass
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, end)
                inside = source[end : close.start() if close else len(source)]
                node.children.append(html.unescape(inside).removeprefix("\n") if tag == "textarea" else inside)
                back = close.end() if close else len(source)
            else:
                tree.push(node)
        try:
            token = walk.send(back)
        except StopIteration:
            token = None
    if VISIBILITY.search(source):
        blank_unseen(tree.root)
    return tree.root


def blank_unseen(root: Node) -> None:
    """Take the text out of elements that are not seen: an element is as its parent, unless its own style says otherwise."""
    waiting = [(root, False)]
    while waiting:
        node, unseen = waiting.pop()
        said = VISIBILITY.findall(node.attributes.get("style", ""))
        unseen = said[-1].lower() != "visible" if said else unseen
        if unseen:
            node.children = [c for c in node.children if not isinstance(c, str)]
            if node.tag in ("img", "input"):
                node.attributes["hidden"] = ""
        waiting += [(c, unseen) for c in node.children if not isinstance(c, str)]


class Page:
    """Lines of text under way: inline text gathers in a line, a block starts a new one, with an empty line if spaced.

    ``indent`` stands before each line; ``lead``, if set, before the next one instead (an item's mark).
    """

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.last = ""
        self.gap = False
        self.indent = ""
        self.lead: str | None = None

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.last = text[-1]

    def text(self, text: str, preserve: bool) -> None:
        if preserve:
            first, *more = text.split("\n")
            self.put(first)
            for line in more:
                self.end_line(keep=True)
                self.put(line)
            return
        text = SPACE.sub(" ", text)
        if text[:1] == " " and self.last in ("", " "):
            text = text[1:]
        self.put(text)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.parts).rstrip(" \t")
        self.parts.clear()
        self.last = ""
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            before = self.indent if self.lead is None else self.lead
            self.lines.append((before + line).rstrip(" \t") if line or self.lead is not None else "")
            self.lead = None

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced and bool(self.lines) and self.lead is None


#: A step of rendering: a generator that yields the steps it waits for, so that pages may be nested to any depth.
Step = Iterator["Step"]


def run(step: Step) -> None:
    waiting = [step]
    while waiting:
        below = next(waiting[-1], None)
        if below is None:
            waiting.pop()
        else:
            waiting.append(below)


def number_of(text: str, most: int) -> int:
    return min(int(text), most) if text.isascii() and text.isdigit() and len(text) < 10 else 1


def whole_number(text: str, otherwise: int) -> int:
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else otherwise


def is_cell(child: Node | str) -> bool:
    return not isinstance(child, str) and child.tag in ("td", "th")


Cell = tuple[list[str], int, int]  # lines, columns, rows


def row_cells(row: Node, into: list[tuple[int, list[Cell]]], group: int, loose: list[Node | str]) -> Step:
    cells: list[Cell] = []
    for cell in row.children:
        if is_cell(cell):
            if cell.visible():
                page = Page()
                yield render(cell, page, False)
                page.end_line()
                rows_ = number_of(cell.attributes.get("rowspan", "1"), MOST_ROWS) or MOST_ROWS
                cells.append(([line for line in page.lines if line], number_of(cell.attributes.get("colspan", "1"), MOST_COLUMNS) or 1, rows_))
        elif not isinstance(cell, str) or cell.strip():
            loose.append(cell)
    if cells:
        into.append((group, cells))


def table_rows(node: Node, into: list[tuple[int, list[Cell]]], groups: list[int], loose: list[Node | str]) -> Step:
    """Visible rows in order with the number of their row group, also inside groups.

    Cells outside rows make a row of their own, as the standard implies. What is in no cell is added to ``loose``.
    """
    groups[0] += 1
    stray = Node("tr", {})
    for child in [*node.children, None]:
        if child is not None and is_cell(child):
            stray.children.append(child)
            continue
        if stray.children and (child is None or not isinstance(child, str)):
            yield row_cells(stray, into, groups[0], loose)
            stray = Node("tr", {})
        if child is None or isinstance(child, str):
            loose += [child] if child and child.strip() else []
        elif child.visible():
            if child.tag == "tr":
                yield row_cells(child, into, groups[0], loose)
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):  # an unclosed colgroup holds the rows
                yield table_rows(child, into, groups, loose)
                groups[0] += 1
            elif child.tag not in TABLE_PARTS or child.tag == "caption" and node.tag != "table":
                loose.append(child)


def placed(rows_: list[tuple[int, list[Cell]]]) -> list[dict[int, list[str]]]:
    """Each row's lines by column. A cell takes the first columns that no cell from a row above reaches into; only the
    first column of a span has text."""
    out: list[dict[int, list[str]]] = []
    group = None
    for number, (at, cells) in enumerate(rows_):
        if at != group:
            group, until, jumps = at, {}, {}
        line: dict[int, list[str]] = {}
        column = 0
        for lines, width, height in cells:
            column = free_column(column, number, until, jumps)
            line[column] = lines
            if height > 1:
                until.update(dict.fromkeys(range(column, column + width), number + height))
            column += width
        out.append(line)
    return out


def free_column(column: int, row: int, until: dict[int, int], jumps: dict[int, tuple[int, int]]) -> int:
    """The first column from ``column`` on that no cell from above reaches into; ``until`` has the row at which each is free again.

    ``jumps`` remembers, for columns that a search began at, how far all are taken and until which row, so that a long run of
    taken columns is not walked again for each row.
    """
    start, first_free = column, None
    while until.get(column, 0) > row:
        ahead, row_free = jumps.get(column, (column, 0))
        if row_free <= row:
            ahead, row_free = column + 1, until[column]
        column, first_free = ahead, row_free if first_free is None else min(first_free, row_free)
    if first_free is not None:
        jumps[start] = column, first_free
    return column


def render_table(node: Node, page: Page) -> Step:
    for child in node.children:
        if not isinstance(child, str) and child.tag == "caption" and child.visible():
            yield render(child, page, False)
            page.end_line()
    loose: list[Node | str] = []
    found: list[tuple[int, list[Cell]]] = []
    yield table_rows(node, found, [0], loose)
    for child in loose:  # what is in no cell is shown before the table, as the standard puts it there
        yield render_child(child, page, False, None)
    page.block(bool(loose))
    grid = placed(found)
    widths: dict[int, int] = {}
    for row in grid:
        for column, lines in row.items():
            widths[column] = max(widths.get(column, 0), *map(len, lines), 0)
    place, end = {}, 0
    for column in sorted(c for c, width in widths.items() if width):  # a column without text takes no room
        place[column] = min(end, WIDEST_TABLE)
        end += widths[column] + 2
    for row in grid:
        cells = [(place[c], lines) for c, lines in sorted(row.items()) if lines]
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for left, lines in cells:
                if i < len(lines):
                    line = (line.ljust(left) if len(line) <= left else line + "  ") + lines[i]
            page.put(line)
            page.end_line()


def render_child(child: Node | str, page: Page, preserve: bool, marker: str | None) -> Step:
    if isinstance(child, str):
        page.text(child, preserve)
    elif child.visible():
        if child.tag == "br":
            page.end_line(keep=True)
        elif child.tag == "img":
            page.text(child.attributes.get("alt", ""), False)
        elif child.tag == "input":
            kind = child.attributes.get("type", "").lower()
            if kind in ("submit", "button", "reset"):
                page.text(f" {child.attributes.get('value', '')} ", False)
        else:
            yield render(child, page, preserve, marker)


def render(node: Node, page: Page, preserve: bool, marker: str | None = None) -> Step:
    tag = node.tag
    spaced = tag in SPACED
    if tag == "table":
        page.block(True)
        yield render_table(node, page)
        page.block(True)
        return
    if tag == "li":
        page.block(False)
        mark = marker or "- "
        indent = page.indent
        page.lead = (indent if page.lead is None else page.lead) + mark
        page.indent = indent + " " * len(mark) if len(indent) < DEEPEST_INDENT else indent
        for child in node.children:
            yield render_child(child, page, preserve, None)
        page.end_line(keep=page.lead is not None)
        page.indent, page.gap = indent, False
        return
    if tag in BLOCK:
        page.block(spaced)
    if tag in ("ul", "menu", "ol"):
        step = -1 if "reversed" in node.attributes else 1
        first = str(sum(isinstance(c, Node) and c.tag == "li" and c.visible() for c in node.children)) if step < 0 else "1"
        number = whole_number(node.attributes.get("start", first), int(first))
        for child in node.children:
            item = isinstance(child, Node) and child.tag == "li"
            if item and tag == "ol" and child.visible():
                number = whole_number(child.attributes.get("value", ""), number)
            if not isinstance(child, str) or child.strip():
                yield render_child(child, page, preserve, (f"{number}. " if tag == "ol" else "- ") if item else None)
            number += step * (item and child.visible())
    else:
        if tag == "dd":
            page.put("    ")
        elif tag in ("select", "option"):
            page.text(" ", False)
        shown = node.children
        if tag == "details" and "open" not in node.attributes:  # closed: its summary alone
            shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"][:1]
        for child in shown:
            yield render_child(child, page, preserve or tag in ("pre", "textarea"), None)
        if tag in ("td", "th", "select", "option"):
            page.text(" ", False)
    if tag in BLOCK:
        page.block(spaced)


def html_to_text(source: str | None) -> str:
    """All visible text of a page, laid out: blocks on lines of their own, spaced ones with an empty line between,
    list items with marks and hanging indents, table cells in aligned columns (spans over columns and rows keep their
    places). All options of a select, the labels of buttons and a textarea's text are shown; what stands in other fields is not.
    A closed details shows its summary; what a style attribute makes unseen may hold what another one shows again. Classes of a
    page's own style sheet are not looked at. Pages may be nested to any depth."""
    if not source:
        return ""
    page = Page()
    run(render(parse(source.replace("\r\n", "\n").replace("\0", "")), page, False))
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def title_of(source: str | None) -> str | None:
    source = source or ""
    start = re.search(r"<title(?=[\s/>])", source, re.I)
    opened = source.find(">", start.end()) if start else -1
    end = re.compile("</title", re.I).search(source, opened) if opened >= 0 else None
    return SPACE.sub(" ", html.unescape(source[opened + 1 : end.start()])).strip() if end else None


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, text and n_lines, one row per page; a narrow map without a shuffle.

    Null and empty pages have empty text and no title. Broken markup never fails: what can't be a tag is text. The time
    for a page grows with its length, whatever it holds.
    Repeated rows give a row each; a null page_id is kept; an empty table gives no rows; other columns are left
    out; pages of any length are read whole.
    """
    schema = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("n_lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for page_id, source in rows(batches, "page_id", "html"):
                text = html_to_text(source)
                yield page_id, title_of(source), text, text.count("\n") + 1 if text else 0

        return batched(out(), schema)

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, title string, text string, n_lines int")
