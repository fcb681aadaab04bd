"""Layout-aware text of HTML pages.

A tokenizer and a tree builder (void elements, raw text, implied end tags inside their
scopes) give a tree; a renderer walks it and writes all visible text. Not visible: the
head, scripts, styles, templates and the like, elements with ``hidden`` or with an own
style of ``display:none``, text under ``visibility:hidden`` (down to elements that are
``visibility:visible`` again), what a closed ``details`` holds beside its summary, and
comments. Blocks start on lines of their own; paragraphs, headings, lists and tables have
a blank line around them; list items carry a dash or their number and their depth; cells
of a table are aligned in columns, those with ``colspan`` and ``rowspan`` too; ``pre``
keeps its white space; ``br`` ends a line.

Null and empty pages give an empty text; an empty table gives an empty result. Markup may
be broken in any way: what isn't a tag is text. Elements may be nested to any depth, and
pages may be of any length: both the tree builder and the renderer keep stacks of their
own. Pages are independent: repeated rows give equal texts; further columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import map_rows, narrow, small_batches

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript title meta link datalist iframe object audio video canvas svg math noembed noframes".split())
BLOCK = set("address article aside blockquote body details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul td th caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
P_CLOSERS = BLOCK - set("body html td th tr tbody thead tfoot option legend caption".split())
#: A start tag ends open elements of these names, within the nearest of these scopes.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that hold no text themselves: what isn't part of a table goes before the table.
FRAME = set("table tbody thead tfoot tr".split())
#: Where a part of a table may be put, once what is open inside has ended.
PARTS = {"td": FRAME, "th": FRAME, "tr": FRAME - {"tr"}} | dict.fromkeys("tbody thead tfoot caption colgroup col".split(), {"table"})
INSIDE = set("caption colgroup col tbody thead tfoot tr td th script style template".split())
P_SCOPE = set("table td th caption button object template".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CONCEALED = re.compile(r"display\s*:\s*none", re.I).search
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I).findall


class Node:
    __slots__ = ("tag", "attributes", "children", "lit")

    def __init__(self, tag: str, attributes: str = "", lit: bool = True):
        self.tag, self.attributes, self.children, self.lit = tag, attributes, [], lit
        if "visibility" in attributes.lower() and (own := VISIBILITY(self.attribute("style") or "")):
            self.lit = own[-1].lower() == "visible"  # else as in the element around it

    def attribute(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def seen(self) -> bool:
        if self.tag in UNSEEN:
            return False
        raw = self.attributes
        if raw and ("hidden" in raw.lower() or "style" in raw.lower()):
            return self.attribute("hidden") is None and not CONCEALED(self.attribute("style") or "") and not (self.tag == "input" and (self.attribute("type") or "").lower() == "hidden")
        return True


def build(source: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)

    def close(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                return
            if stack[i].tag in names:
                deepest = i
                while deepest > 1 and stack[deepest - 1].tag in names:
                    deepest -= 1
                del stack[deepest:]
                return

    def add(child: Node | str) -> None:
        if isinstance(child, str) and not stack[-1].lit:
            return
        if stack[-1].tag in FRAME and (child.strip() if isinstance(child, str) else child.tag not in INSIDE):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":  # an open table is the last child of what holds it
                    stack[i - 1].children.insert(len(stack[i - 1].children) - 1, child)
                    return
        stack[-1].children.append(child)

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            add(html.unescape(source[at:]) if "&" in source[at:] else source[at:])
            break
        if m.start() > at:
            text = source[at : m.start()]
            add(html.unescape(text) if "&" in text else text)
        at = m.end()
        ending, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in VOID:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in P_CLOSERS:
            close({"p"}, P_SCOPE)
        if tag == "body":
            close({"head"}, set())
        if tag in PARTS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in PARTS[tag]:
                    del stack[i + 1 :]
                    if tag in ("td", "th") and stack[-1].tag != "tr" and any(e.tag == "table" for e in stack):
                        stack[-1].children.append(Node("tr", lit=stack[-1].lit))
                        stack.append(stack[-1].children[-1])
                    break
                if stack[i].tag in ("td", "th", "caption", "template", "table"):
                    break
        elif tag == "table" and stack[-1].tag in FRAME:  # ends the table that it is in, but not in a cell
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":
                    del stack[i:]
                    break
        node = Node(tag, attributes, stack[-1].lit)
        framed = stack[-1].tag in FRAME
        add(node)
        if tag == "colgroup" or tag == "form" and framed:  # holds nothing
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I).search(source, at)
            body = source[at : end.start()] if end else source[at:]
            if node.lit:
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            at = source.find(">", end.start()) + 1 or n if end else n
        elif tag not in VOID and not attributes.endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
    return root


class _Page:
    """Lines of output: the open line, and whether a blank one is due before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.blank_due = False

    def text(self, data: str) -> None:
        words = data.split()
        if not words:
            if data and self.open:
                self.open.append(" ")
            return
        if data[0].isspace():
            self.open.append(" ")
        self.open.append(" ".join(words))
        if data[-1].isspace():
            self.open.append(" ")

    def end_line(self, keep_empty: bool = False) -> None:
        line = re.sub(" {2,}", " ", "".join(self.open)).strip()
        self.open = []
        if line or keep_empty:
            self.put(line)

    def put(self, line: str) -> None:
        if self.blank_due and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank_due = False
        self.lines.append(line)

    def space(self) -> None:
        self.end_line()
        self.blank_due = True


def _rows(table: Node) -> list[list[Node]]:
    out, stack = [], list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str) or not node.seen():
            continue
        if node.tag == "tr":
            out.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and c.seen()])
        elif node.tag in ("tbody", "thead", "tfoot"):
            stack += reversed(node.children)
    return [r for r in out if r]


def _span(cell: Node, name: str, most: int) -> int:
    found = re.match(r"\s*(\d{1,6})", cell.attribute(name) or "") if name in cell.attributes.lower() else None
    return max(1, min(most, int(found[1]))) if found else 1


def _grid(rows: list[list[tuple[Node, str]]]) -> list[list[tuple[int, int, str]]]:
    """Cells of each row as (column, columns wide, text), with the places that cells of the rows above take left out."""
    out, taken = [], {}
    for row in rows:
        line, at, below = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell, text in row:
            while taken.get(at):
                at += 1
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            line.append((at, wide, text))
            if high > 1:
                below |= dict.fromkeys(range(at, at + wide), high - 1)
            at += wide
        out.append(line)
        taken = below
    return out


def _aligned(rows: list[list[tuple[Node, str]]], widest: int) -> list[str]:
    grid = _grid(rows)
    widths: dict[int, int] = {}
    for line in grid:
        for at, wide, text in line:
            if wide == 1:
                widths[at] = min(widest, max(widths.get(at, 0), len(text)))
    last = max((at for line in grid for at, _, _ in line), default=0)
    begin = [0]
    for c in range(last + 1):
        begin.append(begin[-1] + (widths[c] + 2 if c in widths else 0))
    out = []
    for line in grid:
        shown = ""
        for at, _, text in line:
            shown = shown.ljust(max(begin[at], len(shown) + 2 * bool(shown))) + text
        out.append(shown.rstrip())
    return out


# The functions of the renderer are generators: they yield the call that they wait for, and _run() keeps the stack.


def _run(call):
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            value = end.value
            stack.pop()
    return value


def _lines(node: Node, widest: int):
    page = _Page()
    yield _walk(node, page, widest)
    page.end_line()
    return page.lines


def _walk(node: Node, page: _Page, widest: int):
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
        elif child.seen():
            if child.tag in BLOCK or child.tag in ("br", "img"):
                yield _element(child, page, widest)
            else:
                yield _walk(child, page, widest)


def _element(node: Node, page: _Page, widest: int):
    tag = node.tag
    if tag == "br":
        page.end_line(keep_empty=True)
    elif tag == "hr":
        page.space()
    elif tag == "img":
        page.text(node.attribute("alt") or "" if node.lit else "")
    elif tag == "pre":
        page.space()
        parts, stack = [], list(reversed(node.children))
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                parts.append(part)
            elif part.tag == "br":
                parts.append("\n")
            elif part.seen():
                stack += reversed(part.children)
        for line in "".join(parts).strip("\n").split("\n"):
            page.put(line.rstrip())
        page.blank_due = True
    elif tag in ("ul", "ol", "menu"):
        page.space()
        number = 1
        for child in node.children:
            if isinstance(child, str):
                page.text(child)
            elif child.seen() and child.tag == "li":
                page.end_line()
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                for i, line in enumerate((yield _lines(child, widest))):
                    page.put((mark if not i else " " * len(mark)) + line if line else "")
            elif child.seen():
                yield _element(child, page, widest)
        page.space()
    elif tag == "table":
        page.space()
        for child in node.children:
            if isinstance(child, Node) and child.tag == "caption" and child.seen():
                for line in (yield _lines(child, widest)):
                    page.put(line)
        rows = []
        for row in _rows(node):
            rows.append([])
            for cell in row:
                rows[-1].append((cell, " ".join(filter(None, (yield _lines(cell, widest))))))
        for line in _aligned(rows, widest):
            page.put(line)
        inner = {"tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"}
        for child in node.children:  # what broken markup has put between rows
            if isinstance(child, str):
                page.text(child)
            elif child.tag not in inner and child.seen():
                yield _element(child, page, widest)
        page.space()
    elif tag in SPACED:
        page.space()
        yield _walk(node, page, widest)
        page.space()
    elif tag == "details" and node.attribute("open") is None:
        page.end_line()
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary" and child.seen():
                yield _element(child, page, widest)
                break
    elif tag in BLOCK:
        page.end_line()
        yield _walk(node, page, widest)
        page.end_line()
    else:
        yield _walk(node, page, widest)


def render(source: str | None, widest: int = 60) -> str:
    """All visible text of a page. Columns of tables are as wide as their widest cell, but widest at most: a longer text shifts its row."""
    return "\n".join(_run(_lines(build(source or ""), widest))).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", widest: int = 60) -> DataFrame:
    """``(id, text, n_chars, n_lines)`` of each page; widest as in :func:`render`."""
    small_batches(pages.sparkSession)
    rows = narrow(pages, id=id_col, html=html_col)
    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, lambda: lambda row: ((row[0], text := render(row[1], widest), len(text), text.count("\n") + 1 if text else 0),), f"`{id_col}` {kind}, text string, n_chars bigint, n_lines bigint")
