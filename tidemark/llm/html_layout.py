"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer of text blocks.

Parsing never fails: what isn't a tag is text. Neither step recurses, so depth is bounded by memory only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import ship, tidy

# Element names of the HTML standard, by what they do.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes textarea title".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
NEVER_SHOWN = frozenset("area audio base canvas datalist embed frame frameset head iframe link meta noembed noframes object param rp script source style svg template title track video".split())
#: Line breaks that a block needs before and after it: 2 leave a blank line.
BREAKS = {t: 1 for t in "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section select summary table caption".split()}
BREAKS |= {t: 2 for t in "blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing ol p plaintext pre ul xmp".split()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
SECTIONS = frozenset("tbody thead tfoot".split())
SCOPE_ENDS = frozenset("table td th caption template button object marquee applet html".split())
KEEPS_SPACE = frozenset("listing plaintext pre textarea xmp".split())

#: A cell line wider than this doesn't widen its column, so that padding stays in proportion to the text; cells after it go on
#: in the next line, where their column begins, so they are aligned all the same.
ALIGNED_WIDTH = 40

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'])))*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_USED_ATTRIBUTE = re.compile(r"(?i)(?:^|[\s/\"'])(hidden|style|open|start|value|colspan|rowspan)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_DISPLAY_NONE = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none\b")
_VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b")
_WHITE_SPACE = re.compile(r"(?i)(?:^|;)\s*white-space\s*:\s*(pre|normal|nowrap)")
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(raw: str) -> dict[str, str]:
    """The attributes that layout depends on; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _USED_ATTRIBUTE.findall(raw):
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, raw attributes); kind is one of text, start, end."""
    at, n, tag = 0, len(text), _TAG
    while at < n:
        start = text.find("<", at)
        if start < 0:
            yield "text", text[at:], ""
            return
        if start > at:
            yield "text", text[at:start], ""
        if text.startswith("<!--", start):
            if text.startswith(("<!-->", "<!--->"), start):
                at = text.index(">", start) + 1
                continue
            end = text.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if text[start + 1 : start + 2] in ("!", "?") or text.startswith("</", start) and not text[start + 2 : start + 3].isalpha():
            if start + 2 >= n:
                yield "text", text[start:], ""
                return
            end = text.find(">", start)
            at = n if end < 0 else end + 1
            continue
        found = tag.match(text, start)
        if not found and tag is _TAG and text[start + 1 : start + 2].isalpha():
            tag = _LOOSE_TAG  # a quote is never closed: from here on quotes mean nothing
            found = tag.match(text, start)
        if not found:
            yield "text", "<", ""
            at = start + 1
            continue
        name, at = found[2].lower(), found.end()
        if found[1]:
            yield "end", name, ""
            continue
        yield "start", name, found[3]
        if name == "plaintext":
            yield "text", text[at:].replace("&", "&amp;"), ""
            return
        if name in RAW_TEXT:
            close = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>").search(text, at)
            inside = text[at : close.start() if close else n]
            if inside:
                yield "text", inside if name in ("textarea", "title") else inside.replace("&", "&amp;"), ""
            yield "end", name, ""
            at = close.end() if close else n


class TreeBuilder:
    """Open elements and the rules by which tags imply others."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter(["html"])

    def push(self, node: Node) -> None:
        self.place(node)
        self.open.append(node)
        self.count[node.tag] += 1

    def pop(self) -> Node:
        node = self.open.pop()
        self.count[node.tag] -= 1
        return node

    def place(self, child: Node | str) -> None:
        """Append to the innermost element; what a table can't hold goes before the table."""
        top = self.open[-1]
        if top.tag in ("table", "tr", "tbody", "thead", "tfoot") and not (child.tag in TABLE_PARTS or child.tag in NEVER_SHOWN if isinstance(child, Node) else not child.strip(" \t\n\f\r")):
            k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == "table"), 0)
            if k:
                outer, table = self.open[k - 1].children, self.open[k]
                outer.insert(next(i for i in range(len(outer) - 1, -1, -1) if outer[i] is table), child)
                return
        top.children.append(child)

    def close(self, tags: frozenset[str] | set[str], stops: frozenset[str] | set[str]) -> bool:
        """Close the innermost element of ``tags``, unless one of ``stops`` comes first."""
        if not any(self.count[t] for t in tags):
            return False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                while len(self.open) > k:
                    self.pop()
                return True
            if self.open[k].tag in stops:
                return False
        return False

    def start(self, name: str, raw: str) -> None:
        if name in ("html", "body"):
            self.root.attrs = attributes(raw) | self.root.attrs if raw else self.root.attrs
            self.close({"head"}, set())
            return
        if name in ENDS_PARAGRAPH and self.count["p"]:
            self.close({"p"}, SCOPE_ENDS)
        if self.count["head"] and name not in NEVER_SHOWN and name != "noscript":
            self.close({"head"}, set())
        if name == "li":
            self.close({"li"}, SCOPE_ENDS | {"ul", "ol", "menu", "dir"})
        elif name in ("dd", "dt"):
            self.close({"dd", "dt"}, SCOPE_ENDS | {"dl"})
        elif name in ("option", "optgroup"):
            self.close({"option"} if name == "option" else {"option", "optgroup"}, {"select", "datalist"} | SCOPE_ENDS)
        elif name in ("rt", "rp", "rb", "rtc"):
            self.close({"rt", "rp", "rb"}, {"ruby"} | SCOPE_ENDS)
        elif name in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        elif name in ("a", "button") and self.count[name]:
            self.close({name}, SCOPE_ENDS - {"button"})
        elif name in TABLE_PARTS:
            if not self.count["table"]:
                return  # a table part outside a table is no element; its content stays
            if name in ("td", "th"):
                self.close({"td", "th", "caption"}, {"table"})
                if self.open[-1].tag == "table":
                    self.push(Node("tbody"))
                if self.open[-1].tag in SECTIONS:
                    self.push(Node("tr"))
            elif name == "tr":
                self.close({"tr", "caption"}, {"table"})
                if self.open[-1].tag == "table":
                    self.push(Node("tbody"))
            elif name != "col":
                self.close(SECTIONS | {"caption", "colgroup"}, {"table"})
        elif name == "table" and self.open[-1].tag in SECTIONS | {"table", "tr"}:
            self.close({"table"}, set())
        node = Node(name, attributes(raw) if raw and _USED_ATTRIBUTE.search(raw) else None)
        if name in VOID:
            self.place(node)
        else:
            self.push(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.place(Node("br"))
        elif name == "p" and not self.close({"p"}, SCOPE_ENDS):
            self.place(Node("p"))
        elif name in HEADINGS:
            self.close(HEADINGS, SCOPE_ENDS)
        elif name in TABLE_PARTS or name == "table":
            self.close({name}, {"table"})
        elif name not in ("p", "html", "body"):
            self.close({name}, {"table", "td", "th", "caption", "template"})

    def text(self, value: str) -> None:
        if self.open[-1].tag == "head" and value.strip():
            self.pop()
        self.place(html.unescape(value) if "&" in value else value)


def build(text: str) -> Node:
    builder = TreeBuilder()
    for kind, value, raw in tokens(text):
        if kind == "text":
            builder.text(value)
        elif kind == "start":
            builder.start(value, raw)
        else:
            builder.end(value)
    return builder.root


class Flow:
    """Lines of text with pending breaks, indents and list markers."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a collapsed space is due before the next word
        self.breaks = 0
        self.indents: list[list[str | None]] = []  # spaces, and a marker not yet written

    def _begin(self) -> None:
        if self.breaks and self.lines:
            self.lines += [""] * (self.breaks - 1)
        self.breaks = 0
        self.line.append("".join((marker if marker is not None else spaces) for spaces, marker in self.indents))
        for indent in self.indents:
            indent[1] = None

    def words(self, text: str) -> None:
        inside = _SPACES.sub(" ", text)
        bare = inside.strip(" ")
        if not bare:
            self.gap = self.gap or bool(inside)
            return
        if not self.line:
            self._begin()
        elif self.gap or inside[0] == " ":
            self.line.append(" ")
        self.line.append(bare)
        self.gap = inside[-1] == " "

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        for k, piece in enumerate((first, *rest)):
            if k:
                self.newline()
            if piece:
                if not self.line:
                    self._begin()
                self.line.append(piece)

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif self.lines:
            self.lines += [""] * (max(self.breaks - 1, 0) + 1)
            self.breaks = 0
        self.gap = False

    def block(self, breaks: int) -> None:
        if self.line:
            self.newline()
        self.gap = False
        self.breaks = max(self.breaks, breaks)

    def add_lines(self, lines: list[str]) -> None:
        for line in lines:
            if line:
                self._begin()
                self.lines.append(self.line.pop() + line)
            elif self.lines:
                self.lines.append("")

    def finish(self) -> list[str]:
        if self.line:
            self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Grid:
    """A table's cells by row, with spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column, columns, lines
        self.taken: dict[int, int] = {}  # column: rows that a cell from above still covers
        self.column = 0

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.rows.append([])
        self.column = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        while self.column in self.taken:
            self.column += 1
        if rows > 1:
            for c in range(self.column, self.column + columns):
                self.taken[c] = rows
        self.rows[-1].append((self.column, columns, lines))
        self.column += columns

    def render(self) -> list[str]:
        widths: Counter[int] = Counter()
        for row in self.rows:
            for column, columns, lines in row:
                if columns == 1:
                    widths[column] = max([widths[column], *(len(x) for x in lines if len(x) <= ALIGNED_WIDTH)])
        used = sorted({c for row in self.rows for c, _, lines in row if lines})
        left, at = {}, 0  # where each column begins; columns without text have no width
        for c in used:
            left[c] = at
            at += widths[c] + 2
        out: list[str] = []
        for row in self.rows:
            cells = [(left[c], lines) for c, _, lines in row if lines]
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                line, length = [], 0
                for begin, lines in cells:
                    if k < len(lines) and lines[k]:
                        if length and begin < length + 2:
                            out.append("".join(line).rstrip(" "))
                            line, length = [], 0
                        line += [" " * (begin - length), lines[k]]
                        length = begin + len(lines[k])
                out.append("".join(line).rstrip(" "))
        return out


def _number(value: str | None, least: int, most: int, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(max(int(found[1]), least), most) if found else default


def render(root: Node) -> str:
    """All visible text of a tree. The walk keeps a stack of what to enter and what to leave."""
    flow, flows = Flow(), []
    lists: list[list] = []  # kind and next number
    grids: list[Grid] = []
    todo: list[tuple] = [(root, True, False, False)]  # node, shown, keeps space, leaving
    while todo:
        node, shown, keeps, leaving = todo.pop()
        if isinstance(node, str):
            if shown:
                (flow.verbatim if keeps else flow.words)(node)
            continue
        tag, attrs = node.tag, node.attrs
        if not leaving:
            if tag in NEVER_SHOWN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs):
                continue
            if style := attrs.get("style"):
                if _DISPLAY_NONE.search(style):
                    continue
                if found := _VISIBILITY.findall(style):
                    shown = found[-1].lower() == "visible"
                if found := _WHITE_SPACE.findall(style):
                    keeps = found[-1].lower() == "pre"
            if tag == "br":
                if shown:
                    flow.newline()
                continue
            keeps = keeps or tag in KEEPS_SPACE
            if tag == "table":
                flow.block(2)
                grids.append(Grid())
                for part in [c for c in node.children if isinstance(c, Node) and c.tag == "caption"]:
                    node.children.remove(part)
                    node.children.insert(0, part)
            elif tag == "tr" and grids:
                grids[-1].row()
            elif tag in ("td", "th") and grids:
                if not grids[-1].rows:
                    grids[-1].row()
                flows.append((flow, lists))
                flow, lists = Flow(), []
            elif tag in BREAKS:
                flow.block(1 if tag in ("ul", "ol") and lists else BREAKS[tag])
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, _number(attrs.get("start"), -(10**9), 10**9, 1)])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    number = _number(attrs.get("value"), -(10**9), 10**9, lists[-1][1])
                    lists[-1][1], marker = number + 1, f"{number}. "
                flow.indents.append([" " * len(marker), marker])
            elif tag in ("dd", "blockquote"):
                flow.indents.append(["  ", None])
            children = node.children
            if tag == "details" and "open" not in attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
            if tag in ("table", "tr", *SECTIONS):
                children = [c for c in children if not isinstance(c, str)]  # white space between cells
            todo.append((node, shown, keeps, True))
            todo.extend((c, shown, keeps, False) for c in reversed(children))
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        if tag in ("td", "th") and grids:
            lines = flow.finish()
            flow, lists = flows.pop()
            grids[-1].cell(lines, _number(attrs.get("colspan"), 1, 1000, 1), _number(attrs.get("rowspan"), 1, 65534, 1))
        elif tag == "table":
            flow.block(1)
            flow.add_lines(grids.pop().render())
            flow.block(2)
        elif tag in BREAKS:
            flow.block(1 if tag in ("ul", "ol") and lists else BREAKS[tag])
        if tag in ("li", "dd", "blockquote"):
            flow.indents.pop()
    return "\n".join(flow.finish())


def extract_text(source: str | None) -> str:
    """The visible text of an HTML source; empty for null."""
    return render(build(source)) if source else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text and n_chars of every row of ``pages``.

    Text is what a reader sees without scripts: no head, scripts, styles, templates, embedded media, closed dialogs
    or details, and nothing hidden by the hidden attribute or an inline display or visibility. Paragraphs, headings and
    lists stand between blank lines, other blocks begin lines, list items have markers and indents, cells of a table
    row share lines and begin where their column does, and preformatted text keeps its spaces. Null and empty
    sources give an empty text. Each row is rendered by itself, so rows that repeat give equal rows; an empty table
    gives an empty result; other columns are not read.
    """

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(x.as_py()) for x in b[html_col]]
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(texts, pa.string())], [id_col, "text"])

    ship(pages.sparkSession)
    out = pages.select(id_col, html_col).mapInArrow(tidy(rendered), f"{id_col} {dict(pages.dtypes)[id_col]}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
