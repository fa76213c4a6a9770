"""Layout-aware text of HTML pages.

A tree builder reads tags with the implied ones (an open p ends before a block, li before li, cells and rows before their
like, and so on), and a renderer emits all visible text of the tree: blocks on lines of their own with the spacing that their kind
asks for, list items with bullets or numbers by depth, table cells in aligned columns, preformatted text as it stands.

Hidden are: script, style, template, head (its title is not page text), noscript, comments, datalist, elements with the hidden attribute, aria-hidden="true", or display:none, and input. display:none and
visibility:hidden count where an inline style or a rule of a style element says so (selectors of a tag, a class, an id or a tag with one of these; rules inside at-rules are passed over); an inline
style wins. Descendants of an element with visibility:hidden are shown where they are visibility:visible. A select shows its selected option (the first one if none is), one of several lines all of them; a textarea its text.

Cases: null and empty pages give empty text; broken or unclosed tags are closed where HTML implies it, stray end tags are skipped; trees deeper
than ``MOST_DEPTH`` are flattened at that depth, with all their text; entities are decoded. Repeated rows get equal texts, a null page_id passes through, other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Depth of the tree beyond which elements are read as siblings.
MOST_DEPTH = 200
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object svg math audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
#: An opening tag that ends an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Opening tag: the open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "caption": (("caption",), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
#: Elements whose end no stray tag inside a cell or object may reach beyond.
BARRIER = frozenset("table td th caption template html".split())
_DISPLAY, _VISIBILITY = (re.compile(rf"(?:^|;)\s*{x}\s*:\s*([a-z-]+)", re.I) for x in ("display", "visibility"))
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
_SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]
        self.muted: list[str] = []  # open elements at the greatest depth of which the first is not visible

    def _close_to(self, depth: int) -> None:
        del self.stack[depth:]

    def _end_open(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Ends the outermost open element of tags above the nearest limit."""
        found = 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in limits:
                break
            if tag in tags:
                found = depth
        if found:
            self._close_to(found)

    def handle_starttag(self, tag, attrs):
        if self.muted:
            if tag not in VOID:
                self.muted.append(tag)
            return
        if tag == "body":
            self._end_open(("head",), ())
        if tag in ("html", "body"):
            return  # implied; their attributes do not change the text
        if self.stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            self._close_to(len(self.stack) - 1)
        if tag in ENDS_P:
            self._end_open(("p",), ("td", "th", "caption", "li", "button", "table", "template"))
        if tag in IMPLIED:
            self._end_open(*IMPLIED[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._open("tr", {})
        node = self._open(tag, {k: v or "" for k, v in attrs})
        if tag in VOID or len(self.stack) > MOST_DEPTH:
            self._close_to(len(self.stack) - 1)
            if tag not in VOID and (not visible(node) or _says(node, _DISPLAY) == "none"):
                self.muted = [tag]
        return node

    def _open(self, tag, attrs):
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        self.stack.append(node)
        return node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but void elements

    def handle_endtag(self, tag):
        if self.muted:
            if tag in self.muted:
                del self.muted[len(self.muted) - 1 - self.muted[::-1].index(tag) :]
            return
        if tag in ("html", "body"):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self._close_to(depth)
                return
            if self.stack[depth].tag in BARRIER and tag not in ("table", "tr", "tbody", "thead", "tfoot", "template"):
                break
        if tag == "p":
            self.stack[-1].children.append(Node("p", {}))

    def handle_data(self, data):
        if self.muted:
            return
        if self.stack[-1].tag == "head" and data.strip():
            self._close_to(len(self.stack) - 1)
        self.stack[-1].children.append(data)


def visible(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return False
    return node.tag != "input"


def _says(node: Node, what: re.Pattern) -> str | None:
    """The last value of a property in an element's inline style."""
    found = what.findall(node.attrs["style"]) if "style" in node.attrs else None
    return found[-1].lower() if found else None


def style_rules(css: str) -> dict[tuple[str, str, str], dict[str, str]]:
    """display and visibility by (tag, mark, name) of simple selectors; blocks of at-rules are passed over."""
    css, at, rules = re.sub(r"/\*.*?(?:\*/|$)", "", css, flags=re.S), 0, {}
    while (opens := css.find("{", at)) >= 0:
        head = css[at:opens].rpartition(";")[2].strip()
        depth, end = 1, opens + 1
        while depth and end < len(css):
            depth += {"{": 1, "}": -1}.get(css[end], 0)
            end += 1
        body, at = css[opens + 1 : end - 1], end
        found = {name: m[-1].lower() for name, x in (("display", _DISPLAY), ("visibility", _VISIBILITY)) if (m := x.findall(body))}
        for selector in head.split(",") if found and not head.startswith("@") else ():
            m = _SELECTOR.fullmatch(selector.strip())
            if m and m[0]:
                rules.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {}).update(found)
    return rules


def _styles(node: Node) -> str:
    own = "".join(c for c in node.children if isinstance(c, str)) if node.tag == "style" else ""
    return own + "".join(_styles(c) for c in node.children if isinstance(c, Node))


def _by_rules(node: Node, rules: dict) -> dict[str, str]:
    """What the rules say of an element: tags first, then classes, then its id."""
    out: dict[str, str] = {}
    for mark, names in (("", [""]), (".", node.attrs.get("class", "").split()), ("#", [node.attrs.get("id", "")])):
        for name in names:
            if name or not mark:
                for tag in ("", node.tag) if mark else (node.tag,):
                    out.update(rules.get((tag, mark, name), {}))
    return out


def prune(node: Node, rules: dict, on: bool = True) -> bool:
    """Takes away what styles hide; whether anything of the element is left. ``on``: visibility, which descendants inherit."""
    ruled = _by_rules(node, rules) if rules else {}
    if (_says(node, _DISPLAY) or ruled.get("display")) == "none":
        return False
    state = _says(node, _VISIBILITY) or ruled.get("visibility")
    on = on if state in (None, "inherit") else state == "visible"
    kept = [c for c in node.children if (on if isinstance(c, str) else prune(c, rules, on))]
    node.children = kept
    return on or bool(kept)


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of a block; ``gap`` empty lines are owed before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, data: str) -> None:
        parts = _SPACES.sub(" ", data)
        if parts == " " or not parts:
            self.space |= bool(parts)
            return
        if parts[0] == " ":
            self.space = True
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(parts.strip(" "))
        self.space = parts[-1] == " "

    def line_break(self) -> None:
        self._put("".join(self.now))
        self.now, self.space = [], False

    def end_line(self) -> None:
        if self.now:
            self.line_break()
        self.space = False

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(line)

    def block(self, lines: list[str], gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)
        if lines:
            for line in lines:
                self._put(line)
            self.gap = gap


def rows_of(node: Node) -> list[Node]:
    out = []
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                out.append(child)
            elif child.tag in ("thead", "tbody", "tfoot"):
                out += rows_of(child)
    return out


def span_of(cell: Node, name: str) -> int:
    span = cell.attrs.get(name, "1")
    return min(int(span), 1000) if span.isdigit() and span.isascii() and len(span) < 5 and int(span) > 1 else 1


def table_lines(node: Node, depth: int) -> list[str]:
    """Caption, then rows with cells in columns two spaces apart; text that stands outside cells comes first, as browsers place it."""
    out = Lines()
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif visible(child) and child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
            render(child, out, depth)
    for part in [node, *[c for c in node.children if isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot")]]:
        for child in part.children if part is not node else ():
            if isinstance(child, str):
                out.text(child)
            elif visible(child) and child.tag not in ("tr", "thead", "tbody", "tfoot"):
                render(child, out, depth)
    grid: list[list[list[str]]] = []
    taken: dict[int, int] = {}  # columns that a cell of an earlier row still fills, and for how many rows
    for row in rows_of(node):
        cells: list[list[str]] = []
        below = {i: n - 1 for i, n in taken.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, Node) and visible(cell) and cell.tag in ("td", "th"):
                while len(cells) in taken:
                    cells.append([])
                wide, high = span_of(cell, "colspan"), span_of(cell, "rowspan")
                if high > 1:
                    below.update(dict.fromkeys(range(len(cells), len(cells) + wide), high - 1))
                cells.append(lines_of(cell, depth + 1))
                cells += [[]] * (wide - 1)
            elif isinstance(cell, Node) and visible(cell):
                render(cell, out, depth)
            elif isinstance(cell, str):
                out.text(cell)
        grid.append(cells)
        taken = below
    out.end_line()
    n = max(map(len, grid), default=0)
    wide = [max((width(line) for row in grid if i < len(row) for line in row[i]), default=0) for i in range(n)]
    lines = out.lines
    for row in grid:
        for k in range(max(map(len, row), default=0)):
            line = ""
            for i, cell in enumerate(row):
                piece = cell[k] if k < len(cell) else ""
                line += piece + " " * (wide[i] - width(piece) + 2)
            lines.append(line.rstrip(" "))
    return lines


def lines_of(node: Node, depth: int) -> list[str]:
    out = Lines()
    for child in node.children:
        render(child, out, depth)
    out.end_line()
    lines = out.lines
    while lines and not lines[-1]:
        lines.pop()
    return lines


def list_lines(node: Node, depth: int) -> list[str]:
    out: list[str] = []
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    loose = Lines()
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if not visible(child):
                continue
            loose.end_line()
            out += loose.lines
            loose = Lines()
            value = child.attrs.get("value", "")
            if re.fullmatch(r"-?[0-9]{1,9}", value):
                number = int(value)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = lines_of(child, depth + 1)
            out += [(mark if i == 0 else " " * len(mark)) + line if line or i == 0 else "" for i, line in enumerate(lines or [""])]
        else:
            render(child, loose, depth)
    loose.end_line()
    return [line.rstrip(" ") for line in out + loose.lines]


def options_of(node: Node) -> list[Node]:
    return [o for c in node.children if isinstance(c, Node) and visible(c) for o in ([c] if c.tag == "option" else options_of(c))]


def pre_text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else pre_text(c) if visible(c) else "" for c in node.children)


def render(node: Node | str, out: Lines, depth: int) -> None:
    if isinstance(node, str):
        out.text(node)
        return
    if not visible(node):
        return
    tag = node.tag
    if tag == "br":
        out.line_break()
    elif tag == "img":
        out.text(node.attrs.get("alt", ""))
    elif tag == "select":
        options = options_of(node)
        chosen = [o for o in options if "selected" in o.attrs]
        for o in options if "multiple" in node.attrs else chosen[-1:] or options[:1]:
            out.text(" " + pre_text(o) + " ")
    elif tag == "hr":
        out.block(["---"], 1)
    elif tag == "pre":
        lines = pre_text(node).replace("\r\n", "\n").split("\n")
        if lines and not lines[0]:
            lines = lines[1:]
        while lines and not lines[-1].strip():
            lines.pop()
        out.block(lines, 1)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.block(list_lines(node, depth + 1), 0 if depth else 1)
    elif tag == "table":
        out.block(table_lines(node, depth + 1), 1)
    elif tag in BLOCK:
        indent = "    " if tag == "dd" else "> " if tag == "blockquote" else ""
        lines = lines_of(node, depth)
        out.block([(indent + line).rstrip(" ") if indent else line for line in lines], 1 if tag in SPACED else 0)
    else:
        for child in node.children:
            render(child, out, depth)


def extract(page: str | None) -> str:
    if not page:
        return ""
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    prune(builder.root, style_rules(_styles(builder.root)) if "<style" in page.lower() else {})
    return "\n".join(lines_of(builder.root, 0)).strip("\n")


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MOST_DEPTH))
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = [extract(x) for x in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "text", "n_chars"])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars of each page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_extract, "page_id long, text string, n_chars long")
