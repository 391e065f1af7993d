"""HTML extraction by layout-aware rendering.

A page is tokenised (with the standard library's tokenizer), built into a tree
with implied tags, and rendered: text of visible elements, blank space as a
browser would show it.  Blocks start new lines, paragraphs and headings stand
between empty lines, list items carry marks and indents, table rows are lines of
cells padded to common column widths.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object canvas audio video select datalist "
    "title meta link base".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = SPACED | frozenset(
    "html body article section nav aside header footer main div address form fieldset li dt dd tr "
    "caption thead tbody tfoot figcaption details summary center dialog legend option search hgroup menu".split()
)
LISTS = frozenset(("ul", "ol", "menu"))
ROWS = frozenset(("tr",))
CELLS = frozenset(("td", "th"))
#: An opening tag closes open elements of these names, up to a boundary.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "body": (frozenset(("head",)), frozenset()),
}
#: A table and what holds its rows and cells.
TABLE_PARTS = frozenset(("table", "thead", "tbody", "tfoot", "tr"))
#: Elements that end back to the nearest of these when they open in a table.
CLEARS = {
    "td": TABLE_PARTS, "th": TABLE_PARTS, "tr": TABLE_PARTS - ROWS,
    **dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), frozenset(("table",))),
    "col": frozenset(("table", "colgroup")),
}
#: What may stand in a table part itself; anything else moves before the table.
IN_TABLE = frozenset(CLEARS) | frozenset(("script", "style", "template"))
#: Parts of SVG and MathML that are never shown (definitions are, where they stand).
UNSEEN = frozenset(("desc", "metadata", "annotation", "annotation-xml"))
#: Elements inside which a tag belongs to SVG or MathML, and ones inside which it is HTML again.
FOREIGN, INTEGRATION = frozenset(("svg", "math")), frozenset(("foreignobject", "annotation-xml"))
#: Elements that an unmatched closing tag never reaches through.
FENCES = frozenset(("table", "td", "th", "caption", "button", "object", "template"))
#: Formatting elements: one that a block was opened in ends without ending the block.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MAX_DEPTH = 400

#: Marked sections, which HTML reads as comments up to the next ">".
BOGUS = re.compile(r"<!\[[^>]*>?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """A tree from tags as they come: implied ends, misnested ends, open ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def close_to(self, depth: int) -> None:
        del self.open[max(depth, 1) :]

    def nearest(self, names: frozenset[str], fences: frozenset[str] = frozenset()) -> int:
        """Place of the innermost open element with one of the names; 0 if a fence or no such is met."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in fences:
                return 0
            if self.open[at].tag in names:
                return at
        return 0

    def foreign(self) -> bool:
        return self.nearest(FOREIGN, INTEGRATION) > 0

    def insert(self, child: Node | str) -> None:
        """Into the innermost open element; what a table part may not hold goes before the table."""
        blank = isinstance(child, str) and not child.strip(" \t\n\r\f")
        if not blank and not (isinstance(child, Node) and child.tag in IN_TABLE):
            if self.open[-1].tag == "colgroup":
                self.close_to(len(self.open) - 1)
            if self.open[-1].tag in TABLE_PARTS:
                at = self.nearest(frozenset(("table",)))
                if at:  # the open table is the last child of its parent
                    self.open[at - 1].children.insert(-1, child)
                    return
        self.open[-1].children.append(child)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "form" and self.open[-1].tag in TABLE_PARTS:  # stays empty in a table part
            return
        if tag == "table":  # a table opens in no table but in its cells and captions
            at = self.nearest(frozenset(("table",)), CELLS | {"caption", "template"})
            if at:
                self.close_to(at)
        if tag in BLOCK and tag != "option":  # a block ends an open paragraph
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at].tag
                if name == "p":
                    self.close_to(at)
                    break
                if name in FENCES:
                    break
        if tag in CLOSES:
            names, boundary = CLOSES[tag]
            cut = None
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in boundary:
                    break
                if self.open[at].tag in names:
                    cut = at
            if cut is not None:
                self.close_to(cut)
        if tag in CLEARS:
            at = self.nearest(CLEARS[tag])
            if at:
                self.close_to(at + 1)
                if tag in CELLS and self.open[at].tag not in ROWS:
                    self.handle_starttag("tr", [])
        if self.open[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
            self.close_to(len(self.open) - 1)
        node = Node(tag, dict(attrs))
        if tag in UNSEEN and self.foreign():
            node.attrs["hidden"] = None
        elif tag == "text" and self.foreign():  # SVG texts stand apart
            self.insert(" ")
        self.insert(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and (tag in FOREIGN or self.foreign()):
            self.close_to(len(self.open) - 1)  # only HTML's own elements stay open

    def handle_endtag(self, tag):
        if tag == "br":
            self.insert(Node("br", {}))
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].tag
            if name == tag:
                inside = (node.tag for node in self.open[at + 1 :])
                if tag not in FORMATTING or not any(name in BLOCK for name in inside):
                    self.close_to(at)
                return
            if name == "table" or name in FENCES and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self.close_to(len(self.open) - 1)
        self.insert(data)


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not _INVISIBLE.search(node.attrs.get("style") or "")


def width(text: str) -> int:
    """Columns a text takes: wide characters two, combining marks none."""
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class Page:
    """Lines of rendered text; ``gap`` is the number of line ends that are due."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the open line, none empty: joined once, however many words
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""
        self.lists = 0

    def put(self, *texts: str) -> None:
        self.parts += [t for t in texts if t]

    def close_line(self) -> bool:
        """Ends the open line, if there is one."""
        if not self.parts:
            return False
        self.lines.append("".join(self.parts))
        self.parts = []
        return True

    def block(self, empty_lines: int = 0) -> None:
        self.gap = empty_lines if self.close_line() else max(self.gap, empty_lines)
        self.space = False

    def start(self) -> None:
        if not self.parts:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.put(self.indent, self.mark)
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""
            self.space = False

    def text(self, data: str) -> None:
        for k, part in enumerate(_SPACE.split(data)):
            if k:
                self.space = True
            if part:
                fresh = not self.parts
                self.start()
                self.put(" " if self.space and not fresh else "", part)
                self.space = False

    def preformatted(self, data: str) -> None:
        for k, part in enumerate(data.replace("\r\n", "\n").split("\n")):
            if k:
                self.newline()
            if part:
                self.start()
                self.put(part)

    def newline(self) -> None:
        if not self.close_line():
            self.gap = min(self.gap + 1, 2) if self.lines else 0
        self.space = False

    def finish(self) -> str:
        self.block()
        return "\n".join(line.rstrip() for line in self.lines)


def rows_of(table: Node) -> Iterator[Node]:
    """Visible rows of a table, without those of tables inside it."""
    for child in table.children:
        if isinstance(child, Node) and visible(child):
            if child.tag in ROWS:
                yield child
            elif child.tag in ("thead", "tbody", "tfoot", "form"):
                yield from rows_of(child)


def span(cell: Node, name: str = "colspan", most: int = 50) -> int:
    """A cell's number of columns or rows; 0 rows reach to the table's end."""
    value = cell.attrs.get(name) or "1"
    if not (value.isascii() and value.isdecimal()):
        return 1
    value = value.lstrip("0")
    if not value:
        return most if name == "rowspan" else 1
    return most if len(value) > 9 else min(int(value), most)


MOST_ROWS = 65534


def render_table(table: Node, page: Page, depth: int) -> None:
    """Rows as lines; cells of one column start at the same place."""
    page.block(1)
    for child in table.children:
        if isinstance(child, Node) and child.tag == "caption" and visible(child):
            render(child, page, depth + 1)
            page.block()
    grid = []
    held: dict[int, int] = {}  # rows that a cell above still takes of a column
    for row in rows_of(table):
        cells, at, longer = [], 0, {}
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in CELLS and visible(cell):
                while at in held:
                    cells.append(([""], 1))
                    at += 1
                inner = Page()
                render(cell, inner, depth + 1)
                columns, rows = span(cell), span(cell, "rowspan", MOST_ROWS)
                cells.append((inner.finish().split("\n"), columns))
                if rows > 1:
                    longer.update(dict.fromkeys(range(at, at + columns), rows))
                at += columns
        held = {c: n - 1 for c, n in {**held, **longer}.items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        at = 0
        for lines, columns in cells:
            if columns == 1:
                widths[at] = max(widths.get(at, 0), *(width(line) for line in lines))
            at += columns
    for cells in grid:
        height = max((len(lines) for lines, _ in cells), default=0)
        for k in range(height):
            out, at = "", 0
            for lines, columns in cells:
                text = lines[k] if k < len(lines) else ""
                room = sum(widths.get(c, 0) + 2 for c in range(at, at + columns))
                out += text + " " * max(room - width(text), 2)
                at += columns
            if out.strip():
                page.start()
                page.put(out.rstrip())
                page.block()
    page.block(1)


def render(node: Node, page: Page, depth: int = 0, preserved: bool = False) -> None:
    tag = node.tag
    empty = 1 if tag in SPACED and not (tag in LISTS and page.lists) else 0
    if tag in BLOCK:
        page.block(empty)
    page.lists += tag in LISTS
    kept_indent, kept_mark = page.indent, page.mark
    number = 0
    if tag == "ol":
        start = node.attrs.get("start") or "1"
        number = int(start) - 1 if re.fullmatch(r"-?[0-9]{1,9}", start) else 0
    if tag == "blockquote":
        page.indent += "  "
    preserved = preserved or tag in ("pre", "textarea")
    for child in node.children:
        if isinstance(child, str):
            (page.preformatted if preserved else page.text)(child)
            continue
        if not visible(child):
            continue
        if child.tag == "br":
            page.newline()
        elif child.tag == "hr":
            page.block(1)
        elif child.tag == "img":
            if child.attrs.get("alt"):
                page.text(child.attrs["alt"])
        elif child.tag == "table":
            render_table(child, page, depth + 1)
        elif child.tag == "li" or child.tag == "dd":
            page.block()
            before = page.indent
            if child.tag == "li":
                number += 1
                page.mark = f"{number}. " if tag == "ol" else "- "
            else:
                page.indent += "  "
            render(child, page, depth + 1, preserved)
            page.block()
            page.indent, page.mark = before, ""
        else:
            render(child, page, depth + 1, preserved)
    page.indent, page.mark = kept_indent, kept_mark if kept_mark and not page.parts and page.mark else ""
    page.lists -= tag in LISTS
    if tag in BLOCK:
        page.block(empty)


def rendered(html: str) -> str:
    """All visible text of one page; broken markup never raises."""
    builder = TreeBuilder()
    builder.feed(BOGUS.sub("", html))
    builder.close()
    page = Page()
    render(builder.root, page)
    return page.finish()


def html_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html"
) -> DataFrame:
    """(id, text, n_chars, n_lines) for every page.

    Null and empty pages give an empty text; markup without visible text too;
    repeated rows are rendered each; a null id stays null; other columns are not
    carried.  Elements deeper than ``MAX_DEPTH`` are kept as siblings, so a hostile
    page costs no more than its length.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([rendered(html.as_py() or "") for html in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "text"])

    narrow = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = narrow.schema["id"].dataType.simpleString()
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return narrow.mapInArrow(extract, f"id {kind}, text string").select(
        F.col("id").alias(id_col), "text",
        F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"),
    )
