"""Visible text of web pages, laid out: a tree builder with implied tags, then a renderer.

The builder reads a page once from left to right. It knows void elements, raw text
elements (script, style, …), which tags end others by their mere start (a block ends a
paragraph, a list item the item before, a cell the cell before, …) and how far an end tag
may reach, so broken markup still gives a tree. Beyond ``DEEPEST`` levels elements are no longer
nested, but counted: their text stays, what they hide is hidden, and their end tags end only them.

Hidden are: head and its content, scripts, styles, templates and the like, comments,
elements with ``hidden`` or with ``display:none`` in their style,
hidden inputs and closed dialogs, and text whose nearest ``visibility`` is hidden or collapse (``visible``
inside it shows again). All other text is emitted, once and in order:

- white space runs become one space, except in pre and textarea; br is a line end;
- paragraphs, headings, lists, tables, quotes and pre stand off by an empty line, other
  blocks by a line end; margins collapse;
- list items get "- ", or their number in ordered lists (``start`` and ``value`` count), with
  inner lines set in;
- the cells of a table are padded to columns (``colspan`` and ``rowspan`` count) with two spaces between; a cell
  of several lines stays in its column.

Defined cases: a null or empty page, or one without visible text, gives the empty string;
a null id stays null; equal rows are treated alike, each on its own; a page without any
tag is text; other columns are ignored; an empty table gives no rows. Work is linear in the page.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import batch, columns

DEEPEST = 200

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template title noembed noframes iframe object audio video canvas svg math datalist noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr caption ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure hr".split())
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option optgroup legend body html".split())
#: What the start of a tag ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"body"}),
}
#: Elements that an end tag of another name inside them does not leave.
FENCES = frozenset("table td th caption button object template".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|(?<=[=\s])\"[^\"]*+\"|(?<=[=\s])'[^']*+'|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_INTERESTING = re.compile(r"hidden|display|visibility|start|value|colspan|rowspan|type|open", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden", "seen")

    def __init__(self, tag: str, attributes: dict[str, str], seen: bool = True):
        self.tag, self.attributes, self.children = tag, attributes, []
        style = attributes.get("style", "")
        said = _VISIBILITY.findall(style) if style else None
        #: Whether text right inside is visible; inherited, and the last word of the style counts.
        self.seen = said[-1].lower() == "visible" if said else seen
        self.hidden = (tag in UNSEEN or "hidden" in attributes or bool(style and _HIDING.search(style))
                       or tag == "dialog" and "open" not in attributes)


def _attributes(text: str) -> dict[str, str]:
    if not _INTERESTING.search(text):
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return found


class Builder:
    """Takes tags and text in order; ``root`` is the tree."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        #: Elements too deep to be nested: their tags, and whether they hide what is inside.
        self.deeper: list[tuple[str, bool]] = []

    def text(self, text: str) -> None:
        if self.deeper and self.deeper[-1][1]:
            return
        top = self.stack[-1]
        if top.tag == "head" and not text.isspace():
            self.close_to(len(self.stack) - 1)  # text can't be in the head: the body has begun
        if self.stack[-1].seen:
            self.stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def close_to(self, depth: int) -> None:
        del self.stack[max(1, depth):]
        self.deeper.clear()

    def _find(self, names, fences) -> int | None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in names:
                return i
            if tag in fences:
                return None
        return None

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack[:3]):
            return
        if self.stack[-1].tag == "head" and tag not in UNSEEN and tag not in ("meta", "link", "base"):
            self.close_to(len(self.stack) - 1)
        if tag in ENDS_P and (at := self._find({"p"}, FENCES)):
            self.close_to(at)
        if tag in IMPLIED:
            while at := self._find(*IMPLIED[tag]):
                self.close_to(at)
        if tag[0] == "h" and tag[1:].isdigit() and self.stack[-1].tag[0] == "h" and self.stack[-1].tag[1:].isdigit():
            self.close_to(len(self.stack) - 1)
        inside = bool(self.deeper and self.deeper[-1][1])
        node = Node(tag, attributes, self.stack[-1].seen)
        if not inside:
            self.stack[-1].children.append(node)
        if tag in VOID:
            return
        if len(self.stack) < DEEPEST:
            self.stack.append(node)
        else:
            self.deeper.append((tag, inside or node.hidden or not node.seen))

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", {})
            return
        for i in range(len(self.deeper) - 1, -1, -1):
            if self.deeper[i][0] == tag:
                del self.deeper[i:]
                return
        if tag not in BLOCKS:
            fences = BLOCKS | FENCES  # the end of an inline element never ends a block
        else:
            fences = {"table"} if tag in ("tr", "tbody", "thead", "tfoot", "table") else FENCES
        at = self._find({tag}, fences - {tag})
        if at:
            self.close_to(at)
        elif tag == "p":
            self.start("p", {})
            self.close_to(len(self.stack) - 1)


def build(page: str) -> Node:
    built, at, n = Builder(), 0, len(page)
    while at < n:
        tag_at = page.find("<", at)
        if tag_at < 0:
            built.text(page[at:])
            break
        if tag_at > at:
            built.text(page[at:tag_at])
        nxt = page[tag_at + 1:tag_at + 2]
        if page.startswith("<!--", tag_at):
            end = page.find("-->", tag_at + 2)
            at = n if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", tag_at)
            at = n if end < 0 else end + 1
        elif nxt.isascii() and (nxt.isalpha() or nxt == "/" and page[tag_at + 2:tag_at + 3].isalpha()):
            m = _TAG.match(page, tag_at + 1)
            if m is None:
                break  # the page ends inside a tag
            at, tag = m.end(), m.group(2).lower()
            if m.group(1):
                built.end(tag)
                continue
            built.start(tag, _attributes(m.group(3)))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                inner = page[at:close.start() if close else n]
                node = built.stack[-1]
                if built.deeper and built.deeper[-1][0] == tag:
                    if not built.deeper.pop()[1]:
                        node.children.append(html.unescape(inner) if tag == "textarea" else inner)
                elif node.tag == tag:
                    if not node.hidden and node.seen:
                        node.children.append(html.unescape(inner) if tag == "textarea" else inner)
                    built.close_to(len(built.stack) - 1)
                at = close.end() if close else n
        else:
            built.text("<")
            at = tag_at + 1
    return built.root


class _Line:
    """Inline text of one block: pieces, each kept as it is or with its white space run together."""

    def __init__(self):
        self.pieces: list[tuple[str, bool]] = []

    def lines(self) -> list[str]:
        out, open_space = [""], True  # white space at a line's start goes
        for text, as_is in self.pieces:
            if as_is:
                first, *rest = text.split("\n")
                out[-1] += first
                out += rest
                open_space = not out[-1]
                continue
            text = _SPACE.sub(" ", text)
            if open_space and text[:1] == " ":
                text = text[1:]
            if text:
                out[-1] += text
                open_space = text[-1] == " "
        self.pieces = []
        out = [line.rstrip(" ") for line in out]
        return out if any(out) else []


def _blocks(node: Node, as_is: bool) -> list[tuple[int, list[str]]]:
    """The blocks inside a node: (empty lines wanted around, lines)."""
    out: list[tuple[int, list[str]]] = []
    line = _Line()

    def flush(margin: int = 0) -> None:
        if line.pieces and (lines := line.lines()):
            out.append((margin, lines))

    def inline(parent: Node, as_is: bool) -> None:
        number = _number(parent.attributes.get("start"), 1) if parent.tag == "ol" else None
        for child in parent.children:
            if isinstance(child, str):
                line.pieces.append((child, as_is))
            elif child.hidden or child.tag == "input" and child.attributes.get("type", "").lower() == "hidden":
                continue
            elif child.tag == "br":
                line.pieces.append(("\n", True))
            elif child.tag == "table":
                flush()
                if lines := _table(child):
                    out.append((1, lines))
            elif child.tag == "li":
                flush()
                if number is not None:
                    number = _number(child.attributes.get("value"), number)
                mark = "- " if number is None else f"{number}. "
                number = None if number is None else number + 1
                lines = _joined(_blocks(child, as_is)) or [""]
                if any(lines):
                    out.append((0, [mark + lines[0]] + [" " * len(mark) + x if x else "" for x in lines[1:]]))
            elif child.tag in BLOCKS:
                flush()
                inner = _blocks(child, as_is or child.tag == "pre")
                if child.tag == "blockquote" or child.tag == "dd":
                    inner = [(m, ["  " + x if x else x for x in lines]) for m, lines in inner]
                if inner and child.tag in SPACED:
                    nested = child.tag in ("ul", "ol", "menu", "dir") and parent.tag in ("li", "ul", "ol")
                    lines = _joined(inner)
                    inner = [(0 if nested else 1, lines)]
                out.extend(inner)
            else:
                if child.tag in ("td", "th"):
                    line.pieces.append((" ", False))
                inline(child, as_is or child.tag == "textarea")

    inline(node, as_is)
    flush()
    return out


def _number(text: str | None, other: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else other


def _joined(blocks: list[tuple[int, list[str]]]) -> list[str]:
    lines: list[str] = []
    before = 0
    for margin, own in blocks:
        if lines and max(before, margin):
            lines.append("")
        lines += own
        before = margin
    return lines


def _with_carried(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, list[str]]]]:
    """Rows of (columns, lines), with an empty cell wherever one of a row above reaches down."""
    left: list[int] = []  # of each column, how many more rows a cell from above takes
    out = []
    for cells in rows:
        own: list[tuple[int, list[str]]] = []
        at, given = 0, iter(cells)
        cell = next(given, None)
        while cell is not None or at < len(left):
            if at < len(left) and left[at] > 0:
                left[at] -= 1
                own.append((1, []))
                at += 1
            elif cell is not None:
                across, down, lines = cell
                left += [0] * (at + across - len(left))
                left[at:at + across] = [down - 1] * across
                own.append((across, lines))
                at += across
                cell = next(given, None)
            else:
                own.append((1, []))
                at += 1
        out.append(own)
    return out


def _table(table: Node) -> list[str]:
    above, rows, loose = [], [], []

    def walk(parent: Node) -> None:
        for child in parent.children:
            if isinstance(child, str):
                if not child.isspace():
                    loose.append(child)
            elif child.hidden:
                continue
            elif child.tag == "caption":
                above.extend(_joined(_blocks(child, False)))
            elif child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, str):
                        if not cell.isspace():
                            loose.append(cell)
                    elif not cell.hidden:
                        if cell.tag in ("td", "th"):
                            across, down = (_number(cell.attributes.get(x), 1) for x in ("colspan", "rowspan"))
                            cells.append((max(1, min(1000, across)), down, _joined(_blocks(cell, False))))
                        else:
                            loose.append(cell)
                rows.append(cells)
            elif child.tag in ("tbody", "thead", "tfoot"):
                walk(child)
            else:
                loose.append(child)

    walk(table)
    outside = Node("div", {})
    outside.children = loose
    rows = _with_carried(rows)
    widths: list[int] = []
    for cells in rows:
        at = 0
        for span, lines in cells:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], max(map(len, lines), default=0))
            at += span
    for cells in rows:  # a wide cell stretches the last column it covers
        at = 0
        for span, lines in cells:
            missing = max(map(len, lines), default=0) - sum(widths[at:at + span]) - 2 * (span - 1)
            if missing > 0:
                widths[at + span - 1] += missing
            at += span
    out = _joined(_blocks(outside, False)) + above  # what is misplaced in a table stands before it
    for cells in rows:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            text, at, column = "", 0, 0
            for span, lines in cells:
                text = text.ljust(column) + (lines[k] if k < len(lines) else "")
                column += sum(widths[at:at + span]) + 2 * span
                at += span
            out.append(text.rstrip(" "))
    return out


def visible_text(page: str | None) -> str:
    return "\n".join(_joined(_blocks(build(page), False))) if page else ""


TEXTS = columns("page_id bigint, text string")


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, text) for every row of ``pages``. No shuffle."""

    def run(batches):
        for b in batches:
            yield batch(TEXTS, [b.column(0).cast("int64"), [visible_text(p) for p in b.column(1).to_pylist()]])

    return pages.select(id_column, html_column).mapInArrow(run, TEXTS)
