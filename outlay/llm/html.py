"""Layout-aware text of HTML pages.

A small tree builder (implied end tags, void elements, raw text elements, misnested and
stray end tags) and a renderer that follows what a browser shows: invisible elements give
nothing, white space collapses outside preformatted text, blocks start on lines of their own, with blank
lines around paragraphs, list items carry marks and indents, and table cells stand in aligned
columns. Pages are rendered one by one inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Generator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas datalist title "
    "meta link annotation annotation-xml mphantom".split()
)
#: What may stand in a head; anything else ends it.
HEADS = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset(
    "title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter "
    "style script".split()
)
#: HTML inside these parts of drawings and formulas does not end them; elsewhere these elements do.
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
    "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header "
    "hgroup html legend li main menu nav optgroup option search section summary caption thead tbody "
    "tfoot tr".split()
)
#: An open element of the value is closed by the start of the key's elements.
CLOSES_PARAGRAPH = PARAGRAPHS | frozenset(
    "address article aside center details dialog dir div fieldset figcaption footer form header hgroup main "
    "menu nav search section summary".split()
)
IMPLIED = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th caption colgroup", {"table"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "thead": ("caption colgroup", {"table"}),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", {"table"}),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", {"table"}),
    "option": ("option", {"select", "datalist"}),
    "optgroup": ("option optgroup", {"select"}),
}
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: End tags of other elements do not reach over these.
SCOPES = frozenset("table td th caption html template object".split())

#: An attribute as the standard reads it: a quote opens a string right after "=" only.
NAME = r"=?[^\s/>=]++|="
VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+"
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|"
    rf"</?([A-Za-z][^\s/>]*)((?:[\s/]++|(?:{NAME})(?:\s*+=\s*+(?:{VALUE}))?+)*+)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(rf"({NAME})(?:\s*+=\s*+({VALUE}))?+")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def attributes_of(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value))
    return out


def parsed(html: str) -> Node:
    """The tree of a page, however deep. Text in raw elements is kept as it is."""
    root = Node("html")
    stack = [root]
    opened: Counter[str] = Counter()
    at, n = 0, len(html)

    def is_open(names) -> bool:
        return any(opened[t] for t in names)

    def cut(i: int) -> None:
        """Close the element at place i of the stack and all inside it."""
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def close(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> bool:
        """Close the nearest open element of `names` that is not beyond one of `stop`."""
        if is_open(names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    cut(i)
                    return True
                if stack[i].tag in stop:
                    break
        return False

    def say(text: str) -> None:
        if stack[-1].tag == "head" and not text.isspace():
            cut(len(stack) - 1)
        stack[-1].children.append(unescape(text))

    while at < n:
        found = TAG.search(html, at)
        if not found:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        if not found[1]:
            continue
        if not found[3]:  # a tag that the page ends in
            break
        name = found[1].lower()
        if html[found.start() + 1] == "/":
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            else:
                close({name}, {"table"} - {name} if name in TABLE_PARTS else SCOPES)
            continue
        raw = found[2]
        if is_open(("svg", "math")) and (
            name in BREAKOUT or (name == "font" and {"color", "face", "size"} & attributes_of(raw).keys())
        ):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in INTEGRATION:
                    break
                if stack[i].tag in ("svg", "math"):
                    cut(i)
                    break
        if name in ("html", "body"):
            stack[-1].attributes.update(attributes_of(raw))
            close({"head"}, frozenset())
            continue
        if name in CLOSES_PARAGRAPH:
            close({"p"}, SCOPES)
        if name[:1] == "h" and name[1:] in "123456" and len(name) == 2 and stack[-1].tag[:1] == "h":
            close({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCKS - {"h1", "h2", "h3", "h4", "h5", "h6"})
        if name in IMPLIED:
            closed, stop = IMPLIED[name]
            while close(frozenset(closed.split()), stop):
                pass
        if name in ("input", "textarea", "select"):
            close({"select"}, SCOPES)
        if stack[-1].tag == "head" and name not in HEADS:
            cut(len(stack) - 1)
        node = Node(name, attributes_of(raw) if raw.strip() else {})
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW and not (raw.endswith("/") and is_open(("svg", "math"))):
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            text = html[at : end.start() if end else n]
            if name == "textarea":
                text = re.sub(r"\A\r?\n", "", text)
            node.children.append(unescape(text) if name in ("textarea", "title") else text)
            at = end.end() if end else n
        elif name == "plaintext":
            node.children.append(html[at:])
            break
        elif not raw.rstrip().endswith("/") or name in BLOCKS:
            stack.append(node)
            opened[name] += 1
    return root


def hidden(node: Node) -> bool:
    """Whether a browser shows nothing of the element."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a:
        return True
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    if node.tag == "dialog" and "open" not in a:
        return True
    return "style" in a and DISPLAY.findall(a["style"].lower())[-1:] == ["none"]


def without_unseen(root: Node) -> Node:
    """The tree without the text of invisible elements; visible ones inside them keep theirs."""
    top = Node(root.tag, root.attributes)
    open_: list[tuple[Node, Node, bool]] = [(root, top, True)]
    while open_:
        node, copy, seen = open_.pop()
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    copy.children.append(child)
                continue
            said = VISIBILITY.findall(child.attributes.get("style", "").lower())[-1:]
            own = seen if not said or said[0] in ("inherit", "unset") else said[0] not in ("hidden", "collapse")
            if own or child.tag not in ("img", "input", "br"):
                below = Node(child.tag, child.attributes)
                copy.children.append(below)
                open_.append((child, below, own))
    return top


def width_of(text: str) -> int:
    """Columns of a monospaced screen: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1
        for c in text
    )


class Lines:
    """Lines under construction: pending white space and blank lines are decided by what follows."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False

    def text(self, text: str) -> None:
        collapsed = BLANKS.sub(" ", text)
        if not collapsed:
            return
        if collapsed[0] == " ":
            self.space = True
            collapsed = collapsed[1:]
        if not collapsed:
            return
        tail = collapsed[-1] == " "
        self.word(collapsed[:-1] if tail else collapsed)
        self.space = tail

    def word(self, text: str) -> None:
        if self.blank and not self.line and self.done:
            self.done.append("")
        self.blank = False
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            self.done.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def gap(self) -> None:
        """End the line; a blank line follows if anything does."""
        self.end_line()
        self.blank = True

    def add(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Rendered lines as they are, indented."""
        self.end_line()
        if lines and self.blank and self.done:
            self.done.append("")
        if lines:
            self.blank = False
        for i, line in enumerate(lines):
            self.done.append(((first if i == 0 else rest) + line).rstrip())

    def finish(self) -> list[str]:
        self.end_line()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


# A step renders an element and yields the steps of what is inside it; `done` runs them on a stack of its
# own, so pages may nest as deep as they like.
Step = Generator["Step", object, object]


def done(step: Step):
    """The value of a step."""
    stack, value = [step], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(inner)
            value = None
    return value


def render(node: Node, into: Lines, pre: bool = False) -> Step:
    """Render an element's children."""
    for child in node.children:
        if isinstance(child, str):
            if pre:
                first, *more = child.replace("\r\n", "\n").split("\n")
                if first:
                    into.word(first)
                for line in more:
                    into.end_line(force=True)
                    if line:
                        into.word(line)
            else:
                into.text(child)
        else:
            yield element(child, into, pre)


def element(node: Node, into: Lines, pre: bool) -> Step:
    tag = node.tag
    if hidden(node):
        return
    if tag == "br":
        into.end_line(force=True)
    elif tag == "img":
        if alt := node.attributes.get("alt", "").strip():
            into.text(alt)
    elif tag == "input":
        if value := node.attributes.get("value", "").strip():
            into.text(value)
    elif tag == "textarea":
        yield apart(node, into, True)
    elif tag == "select":
        for option in chosen(node):
            yield apart(option, into)
    elif tag == "svg":
        yield drawing(node, into)
    elif tag in ("mfrac", "mroot", "mtd"):
        for child in [node] if tag == "mtd" else node.children:
            if isinstance(child, Node):
                yield apart(child if tag == "mtd" else Node("mrow", {}, [child]), into)
    elif tag == "hr":
        into.gap()
    elif tag == "table":
        into.gap()
        into.add((yield table_lines(node)))
        into.gap()
    elif tag in ("ul", "ol", "menu", "dir"):
        into.gap()
        into.add((yield list_lines(node)))
        into.gap()
    elif tag in ("dd", "blockquote"):
        (into.gap if tag == "blockquote" else into.end_line)()
        into.add((yield block_lines(node, pre)), "    ", "    ")
        (into.gap if tag == "blockquote" else into.end_line)()
    elif tag == "details" and "open" not in node.attributes:
        into.end_line()
        yield render(Node(tag, {}, summary_of(node)), into, pre)
        into.end_line()
    elif tag in PARAGRAPHS:
        into.gap()
        yield render(node, into, pre or tag == "pre")
        into.gap()
    elif tag in BLOCKS:
        into.end_line()
        yield render(node, into, pre)
        into.end_line()
    else:
        yield render(node, into, pre)


def summary_of(details: Node) -> list[Node]:
    """What closed details show: their first summary."""
    return [c for c in details.children if isinstance(c, Node) and c.tag == "summary"][:1]


def apart(node: Node, into: Lines, pre: bool = False) -> Step:
    """Render an element's children as words of their own."""
    into.text(" ")
    yield render(node, into, pre)
    into.text(" ")


def chosen(select: Node) -> list[Node]:
    """Options that are shown: all of a list box; of a menu the one marked as selected, else the first
    that is not disabled."""
    options: list[Node] = []
    open_: list[Node] = [select]
    while open_:
        node = open_.pop()
        if node.tag == "option" and node is not select:
            options.append(node)
        else:
            open_ += [c for c in reversed(node.children) if isinstance(c, Node) and not hidden(c)]
    a = select.attributes
    if "multiple" in a or re.fullmatch(r"0*(?:[2-9]|[1-9][0-9]+)", a.get("size", "").strip()):
        return options
    marked = [o for o in options if "selected" in o.attributes][-1:]
    return marked or [o for o in options if "disabled" not in o.attributes][:1]


def drawing(node: Node, into: Lines) -> Step:
    """The texts of a drawing, each as words of its own, and pages embedded in it."""
    for child in node.children:
        if isinstance(child, str) or child.tag in UNDRAWN or hidden(child):
            continue
        if child.tag in ("text", "foreignobject"):
            yield apart(child, into)
        else:
            yield drawing(child, into)


def block_lines(node: Node, pre: bool = False) -> Step:
    own = Lines()
    yield render(node, own, pre)
    return own.finish()


def whole_number(text: str, default: int) -> int:
    """The number an attribute begins with, as browsers read it; at most nine digits count."""
    found = re.match(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})", text)
    return int(found[1]) if found else default


def list_lines(node: Node) -> Step:
    """Items with a dash or their number; what stands outside items keeps its place."""
    own = Lines()
    number = whole_number(node.attributes.get("start", ""), 1)
    for child in node.children:
        if isinstance(child, str):
            own.text(child)
        elif child.tag == "li" and not hidden(child):
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            own.add((yield block_lines(child)), mark, " " * len(mark))
        elif child.tag in ("ul", "ol") and not hidden(child):
            own.add((yield list_lines(child)), "  ", "  ")
        else:
            yield element(child, own, False)
    return own.finish()


def rows_of(node: Node) -> Step:
    """Caption lines with what stands outside cells, and rows of cells of a table and its row groups."""
    caption, rows = [], []
    loose: list[Node] = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                caption += yield block_lines(Node("div", {}, [child]))
        elif hidden(child):
            continue
        elif child.tag == "tr":
            for stray in child.children:
                if isinstance(stray, str) and stray.strip():
                    caption += yield block_lines(Node("div", {}, [stray]))
            rows.append([c for c in child.children if isinstance(c, Node) and not hidden(c)])
        elif child.tag in ("thead", "tbody", "tfoot"):
            more, inner = yield rows_of(child)
            caption += more
            rows += inner
        elif child.tag in ("td", "th"):
            loose.append(child)
        elif child.tag not in ("colgroup", "col"):
            caption += yield block_lines(Node("div", {}, [child]))
    if loose:
        rows.append(loose)
    return caption, rows


def table_lines(node: Node) -> Step:
    """Rows with cells in columns two blanks apart; a cell of several lines makes a row as high."""
    caption, rows = yield rows_of(node)
    cells = []
    for row in rows:
        out: list[list[str]] = []
        for cell in row:
            out.append((yield block_lines(cell if cell.tag in ("td", "th") else Node("td", {}, [cell]))))
            span = whole_number(cell.attributes.get("colspan", ""), 1)
            out += [[]] * (min(span, 100) - 1)
        cells.append(out)
    widths: list[int] = []
    for row in cells:
        for i, lines in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max([widths[i], *map(width_of, lines)])
    lines = list(caption)
    for row in cells:
        for k in range(max([0, *map(len, row)])):
            line = []
            for i, cell in enumerate(row):
                text = cell[k] if k < len(cell) else ""
                line.append(text + " " * (widths[i] - width_of(text)))
            lines.append("  ".join(line).rstrip())
    return lines


def visible_text(html: str | None) -> str:
    """The text a page shows, laid out in lines; empty for null."""
    if not html:
        return ""
    page = parsed(html.replace("\x00", ""))
    if "visibility" in html.lower():
        page = without_unseen(page)
    return "\n".join(done(block_lines(page)))


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages without `html`, with its visible `text`.

    Every page is rendered by itself: null and empty pages have an empty text, repeated rows stay, and
    columns other than `html` pass as they are, except one named like `text`, which is replaced.
    """
    names = [c for c in pages.columns if c not in (html, text)]

    def rows(batches):
        for batch in batches:
            shown = [visible_text(h) for h in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(shown, pa.string())],
                names=[*names, text],
            )

    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names]
    return pages.select(*names, F.col(html)).mapInArrow(rows, ", ".join([*fields, f"`{text}` string"]))
