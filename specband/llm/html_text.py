"""Visible text of HTML pages, laid out as a browser would.

A page becomes a tree (void elements, start and end tags that HTML implies, unknown tags kept), hidden subtrees are left
out, and the tree is rendered: blocks start lines and keep their spacing, list items get bullets or numbers, table cells
are aligned on a grid with row and column spans, preformatted text keeps its white space, controls show what they hold (a closed selection its
chosen option).  Trees may be of any depth: walks keep their own stack.  Only layout has limits (indentation, aligned tables within tables).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.llm.common import buffers, slices

# The element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient".split())  # no text of its own in a drawing
NOTES = frozenset(("annotation", "annotation-xml"))  # not shown in a formula
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # text up to their end tag
UNSEEN = frozenset("head script style title meta link base template datalist noembed noframes iframe object audio video canvas param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure fieldset".split())  # blank line around
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main form address li dt dd figcaption details summary hr caption center dir legend hgroup search".split())
CLOSES_P = (SPACED | BLOCKS) - frozenset("html body li dt dd caption legend figcaption summary".split())
ENDED_BY = {  # an open element of the key ends when one of these starts
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}), "optgroup": frozenset({"optgroup"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}), "tfoot": frozenset({"tbody"}), "caption": frozenset({"tr", "td", "th", "tbody", "thead", "tfoot", "colgroup"}),
    "colgroup": frozenset({"tr", "tbody", "thead", "tfoot"}), "head": frozenset({"body"}), "rt": frozenset({"rt", "rp"}), "rp": frozenset({"rt", "rp"}),
}
WALLS = {"li": frozenset({"ul", "ol", "menu", "dir"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "p": frozenset({"td", "th", "li", "button", "caption", "object"})}
TABLE_WALL = frozenset({"table"})
GROUPS = frozenset("thead tbody tfoot".split())
STAYS_OPEN = {"td": GROUPS | {"tr", "table"}, "th": GROUPS | {"tr", "table"}, "tr": GROUPS | {"table"}} | {t: TABLE_WALL for t in (*GROUPS, "caption", "colgroup")}
HEAD = frozenset("base basefont bgsound link meta title script style template noscript noframes".split())  # what does not end the head
PLACED = BLOCKS | frozenset(ENDED_BY)
WIDEST = 400  # indentation that deeper blocks share
ALIGNED = 50  # tables within tables that are aligned; deeper ones have a line per cell line
# As HTML reads a tag: a quoted value starts directly after "=", any other quote is an ordinary character; an open quote ends like an unquoted value.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)"
                   r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)>?", re.S)
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
TELLING = re.compile(r"hidden|display|visibility|start|value|span|selected|multiple|size|type", re.I)  # attributes that matter here
SILENT = frozenset("hidden password checkbox radio file image range color".split())  # inputs that show no text
LABELS = {"submit": "Submit", "reset": "Reset"}  # what such a button shows without a value
BLANK = re.compile(r"[ \t\r\n\f]+")


class Element:
    __slots__ = ("tag", "hidden", "attrs", "kids", "veiled")

    def __init__(self, tag: str, hidden: bool = False, attrs: dict | None = None, veiled: bool = False) -> None:
        self.tag, self.hidden, self.attrs, self.kids = tag, hidden, attrs or {}, []
        self.veiled = veiled  # invisible, but a descendant may be visible again


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source and TELLING.search(source) else {}


def is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    return tag in UNSEEN or "hidden" in attrs or bool(HIDING.search(attrs.get("style", "")))


class Tree:
    """The open elements of a page, and where those of each tag stand."""

    def __init__(self) -> None:
        self.root = Element("#root")
        self.stack, self.where, self.placed = [self.root], {}, []

    def last(self, tags: frozenset | set) -> int:
        """Place of the innermost open element among ``tags``; 0 for none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def push(self, element: Element) -> None:
        self.where.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in PLACED:
            self.placed.append(len(self.stack))
        self.stack.append(element)

    def cut(self, k: int) -> None:
        for e in self.stack[k:]:
            self.where[e.tag].pop()
        del self.stack[k:]
        while self.placed and self.placed[-1] >= k:
            self.placed.pop()

    def close(self, tags: frozenset | set, wall: frozenset) -> None:
        """End the innermost open element among ``tags`` unless a wall comes first."""
        k = self.last(tags)
        if k and k >= self.last(wall) and k >= self.last({"template"}):
            self.cut(k)

    def add(self, kid: Element | str) -> None:
        self.stack[-1].kids.append(kid)


def parse(source: str) -> Element:
    tree, at, n = Tree(), 0, len(source)
    stack, where = tree.stack, tree.where

    def add_text(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            if stack[-1].tag == "head" and not text.isspace():
                tree.cut(len(stack) - 1)
            if not stack[-1].veiled:
                tree.add(text)

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                if where.get("svg") or where.get("math"):
                    if not stack[-1].veiled:
                        tree.add(m[0][9:].removesuffix("]]>"))
                else:  # elsewhere a comment, up to the first ">"
                    at = source.find(">", m.start()) + 1 or n
            continue
        tag = tag.lower()
        if tag == "text" and where.get("svg"):
            tag = "svg:text"
        if m[1]:
            if tag == "p" and not where.get("p"):
                tree.add(Element("p"))
            elif tag == "br":
                tree.add(Element("br"))
            else:
                tree.close({tag}, TABLE_WALL if tag not in ("table", "body", "html") and tag not in ENDED_BY else WALLS.get(tag, frozenset()) | (TABLE_WALL if tag in ENDED_BY and tag not in ("li", "dt", "dd") else frozenset()))
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            tree.cut(len(stack) - 1)
        if tag in CLOSES_P:
            tree.close({"p"}, TABLE_WALL | WALLS["p"])
        floor = tree.last({"template"})
        if tag in STAYS_OPEN and tree.last(TABLE_WALL) > floor:
            tree.cut(tree.last(STAYS_OPEN[tag]) + 1)
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Element("tr", veiled=stack[-1].veiled)
                tree.add(row)
                tree.push(row)
        for _ in range(3):  # td, tr and tbody may all end
            top = tree.placed[-1] if tree.placed else 0
            if top <= floor or tag not in ENDED_BY.get(stack[top].tag, ()):
                break
            tree.cut(top)
        if tag in ("li", "dt", "dd"):
            tree.close({"li"} if tag == "li" else {"dt", "dd"}, WALLS[tag] | TABLE_WALL)
        if tag in ("html", "body") and where.get(tag):
            continue
        attrs = attributes(m[3])
        hidden = is_hidden(tag, attrs) or tag in DRAWN and bool(where.get("svg")) or tag in NOTES and bool(where.get("math"))
        seen = VISIBILITY.findall(attrs.get("style", ""))
        element = Element(tag, hidden, attrs, seen[-1].lower() != "visible" if seen else stack[-1].veiled)
        tree.add(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if not element.veiled:
                element.kids.append(html.unescape(source[at : end.start() if end else n]) if tag == "textarea" else source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[0].endswith("/>") or tag in BLOCKS and tag not in VOID:
            tree.push(element)
    return tree.root


class Lines:
    """Output lines with collapsed white space and block spacing."""

    def __init__(self, nested: int = 0) -> None:
        self.nested = nested  # tables around
        self.done: list[str] = []
        self.line = ""
        self.gap = 0  # blank lines owed before the next text
        self.pre = 0
        self.first: str | None = None  # bullet of the next line
        self.indent = ""

    def text(self, s: str) -> None:
        if self.pre:
            head, *rest = s.replace("\r\n", "\n").split("\n")
            self.write(head)
            for line in rest:
                self.end(keep=True)
                self.write(line)
            return
        s = BLANK.sub(" ", s)
        if s.startswith(" ") and (not self.line.strip() or self.line.endswith(" ")):
            s = s[1:]
        self.write(s)

    def write(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.gap and self.done:
                self.done += [""] * (self.gap - (not self.done[-1]))
            self.gap = 0
            if self.first is not None:
                self.line, self.first = self.first, None
            else:
                self.line = self.indent
        self.line += s

    def end(self, keep: bool = False) -> None:
        if self.line.strip() or keep:
            self.done.append(self.line.rstrip())
        self.line = ""

    def space(self, blank: int) -> None:
        self.end()
        self.gap = max(self.gap, blank)


Steps = Iterator["Steps"]  # a walk over part of a tree: what it yields is walked before it goes on


def walk(steps: Steps) -> None:
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def deeper(indent: str, more: int) -> str:
    return indent + " " * more if len(indent) < WIDEST else indent


def render(kids: list, out: Lines, depth: int = 0) -> Steps:
    for kid in kids:
        if isinstance(kid, str):
            out.text(kid)
            continue
        tag = kid.tag
        if kid.hidden:
            continue
        if tag == "br":
            out.end(keep=True) if out.line else out.end(keep=bool(out.done) and not out.gap)
        elif tag == "hr":
            out.space(1)
        elif tag == "table":
            out.space(1)
            if out.nested < ALIGNED:
                lines: list[str] = []
                yield table_lines(kid, depth, out.nested + 1, lines)
                for line in lines:
                    out.write(line)
                    out.end()
            else:
                yield plain_table(kid, out, depth)
            out.space(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.space(0 if out.first is not None or depth else 1)
            yield list_items(kid, out, depth)
            out.space(0 if depth else 1)
        elif tag == "pre":
            out.space(1)
            out.pre += 1
            first = kid.kids[0] if kid.kids else None
            if isinstance(first, str) and first.startswith("\n"):
                kid.kids[0] = first[1:]
            yield render(kid.kids, out, depth)
            out.pre -= 1
            out.space(1)
        elif tag == "textarea":
            out.pre += 1
            out.text("".join(kid.kids).removeprefix("\n"))
            out.pre -= 1
        elif tag == "input":
            kind = kid.attrs.get("type", "").lower()
            if kind not in SILENT and not kid.veiled:
                out.text(kid.attrs.get("value", LABELS.get(kind, "")))
        elif tag == "select":
            out.text(" ".join(chosen(kid)))
        elif tag in BLOCKS or tag == "svg:text":
            blank = 1 if tag in SPACED else 0
            keep = out.indent
            out.space(blank)
            if tag in ("blockquote", "dd"):
                out.indent = deeper(keep, 4)
            yield render(kid.kids, out, depth)
            out.space(blank)
            out.indent = keep
        elif kid.kids:
            yield render(kid.kids, out, depth)


def chosen(node: Element) -> list[str]:
    """Options that a selection shows: all of an open list, else the last one marked as selected, or the first."""
    options, stack = [], [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, Element) and not kid.hidden:
            if kid.tag == "option":
                options.append(kid)
            stack.append(iter(kid.kids))
    size = node.attrs.get("size", "1")
    if "multiple" not in node.attrs and not (size.isdecimal() and int(size[:4]) > 1):
        options = ([o for o in options if "selected" in o.attrs] or options[:1])[-1:]
    return [BLANK.sub(" ", "".join(k for k in o.kids if isinstance(k, str))).strip() for o in options]


def list_items(node: Element, out: Lines, depth: int) -> Steps:
    number = node.attrs.get("start", "1")
    number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    keep = out.indent
    for kid in node.kids:
        if isinstance(kid, str):
            out.text(kid)
        elif kid.hidden:
            continue
        elif kid.tag == "li":
            if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", kid.attrs.get("value", "")):
                number = int(kid.attrs["value"])
            mark = f"{number}. " if node.tag == "ol" else "* "
            number += 1
            out.end()
            out.first, out.indent = keep + mark, deeper(keep, len(mark))
            yield render(kid.kids, out, depth + 1)
            out.end()
            out.first, out.indent = None, keep
        else:
            yield render([kid], out, depth + 1)
    out.indent = keep


def table_parts(node: Element) -> tuple[list, list[Element]]:
    """What stands outside the rows of a table, and its rows, both in their order."""
    stray, rows, stack = [], [], [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, str):
            if kid.strip():
                stray.append(kid)
        elif kid.hidden:
            continue
        elif kid.tag == "tr":
            rows.append(kid)
        elif kid.tag in GROUPS or kid.tag in ("form", "center", "colgroup"):
            stack.append(iter(kid.kids))
        else:
            stray.append(kid)
    return stray, rows


def cell_lines(kids: list, depth: int, nested: int, into: list[str]) -> Steps:
    out = Lines(nested)
    yield render(kids, out, depth)
    out.end()
    into += out.done or [""]


def plain_table(node: Element, out: Lines, depth: int) -> Steps:
    """A table whose cells begin on lines of their own."""
    stray, rows = table_parts(node)
    yield render(stray, out, depth + 1)
    for row in rows:
        for cell in row.kids:
            if isinstance(cell, str) or not cell.hidden:
                out.end()
                yield render(cell.kids if not isinstance(cell, str) and cell.tag in ("td", "th") else [cell], out, depth + 1)
        out.end()


def columns(s: str) -> int:
    """Columns of a fixed-width screen: wide characters take two, combining and invisible ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def span_of(cell: Element, name: str) -> int:
    value = cell.attrs.get(name, "1")
    return int(value[:5]) if value.isdecimal() else 1


def table_lines(node: Element, depth: int, nested: int, out: list[str]) -> Steps:
    """Rows of a table with cells padded to their columns; text outside cells stands before the rows.

    Cells take the first free columns of the grid: those that a cell of an earlier row reaches down into are not free.
    """
    stray, parts = table_parts(node)
    if stray:
        yield cell_lines(stray, depth + 1, nested, out)
    rows, taken = [], {}  # column -> row up to which it is taken
    for r, row in enumerate(parts):
        cells, col = [], 0
        for cell in row.kids:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                lines, wide, high = [BLANK.sub(" ", cell).strip()], 1, 1
            elif cell.hidden:
                continue
            else:
                own = cell.tag in ("td", "th")
                lines: list[str] = []
                yield cell_lines(cell.kids if own else [cell], depth + 1, nested, lines)
                wide, high = (min(max(span_of(cell, "colspan"), 1), 100), span_of(cell, "rowspan")) if own else (1, 1)
            while taken.get(col, -1) >= r:
                col += 1
            if high != 1:
                for c in range(col, col + wide):
                    taken[c] = r + high - 1 if high else len(parts)
            cells.append((col, wide, lines))
            col += wide
        rows.append(cells)
    widths = [0] * max((col + wide for cells in rows for col, wide, _ in cells), default=0)
    for cells in rows:
        for col, wide, lines in cells:
            if wide == 1:
                widths[col] = max(widths[col], *map(columns, lines))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    for cells in rows:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, end = "", 0
            for i, (col, _, lines) in enumerate(cells):
                gap = max(starts[col] - end, 2 if i else 0)
                text = lines[k] if k < len(lines) else ""
                line, end = line + " " * gap + text, end + gap + columns(text)
            out.append(line.rstrip())


def visible_text(source: str | None) -> str | None:
    """Text of one page; None for None."""
    if source is None:
        return None
    out = Lines()
    walk(render(parse(source).kids, out))
    out.end()
    lines = out.done
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines).replace("\xa0", " ")


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``page_id, text`` and the columns of ``keep`` for every row, in the place it was read: nothing is shuffled.

    Null pages give null, empty pages and pages without visible text the empty string; repeated rows give equal rows;
    broken markup is read as far as it goes (an open comment or script hides the rest).
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    src = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"), rest.alias("in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                text = [visible_text(h) for h in batch.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(text, pa.string()), batch.column(2).slice(i, j - i)], names=["page_id", "text", "in"])

    out = src.mapInArrow(run, f"page_id bigint, text string, in {src.schema['in'].dataType.simpleString()}")
    return out.select("page_id", "text", *([F.col(f"in.`{c}`").alias(c) for c in keep] if keep else []))
