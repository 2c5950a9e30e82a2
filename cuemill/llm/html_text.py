"""HTML extraction by layout-aware rendering.

A scanner that never looks back feeds a tree builder that knows void elements, implied ends (a new <p>, <li>, <tr>, <td>, <option> ... closes
what it must) and raw-text elements; a renderer then walks the tree, skips what is not visible, and writes text with block spacing, list
marks with nesting and numbers, and tables whose cells are aligned in columns, spans included.

Not visible: head, script, style, noscript, template, datalist and the contents of embedded media; `hidden` attributes, display:none,
visibility:hidden (until a descendant is visible again), closed dialogs, all but the summary of closed details. What only hides from
screen readers (aria-hidden) is visible, as are options, text areas, formulas and the text of drawings; an image shows its alt text.

Defined results: null or empty html gives empty text; broken markup is read as browsers do (a tag that never ends is dropped), stray ends
are ignored; nesting of any depth works (no recursion), but lists indent 16 levels at most, tables nested deeper than 8 are not laid
out, columns beyond 256 are not aligned, nor tables whose padding would exceed four times their text; an extra column passes through,
an own `text` column is replaced. Time and memory are linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import bounded_batches, read_table, released, slices

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
KEY = re.compile(r"=?[^\s/>=]*")
BLANKS = re.compile(r"\s*")
UNQUOTED = re.compile(r"[^\s>]*")
LONG_REFERENCE = re.compile(r"&#(?:0*([0-9]{8,})|[xX]0*([0-9a-fA-F]{7,}));?")
ZEROS = re.compile(r"(&#[xX]?)0{8,}")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
UNSEEN = frozenset("head script style title noscript template iframe object datalist audio video canvas meta link noembed noframes desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table textarea ul caption tr thead tbody tfoot td th xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section header footer xmp".split())
CELLS, GROUPS = frozenset(["td", "th"]), frozenset(["thead", "tbody", "tfoot", "colgroup", "form"])
#: A start tag closes open elements of these names, up to the nearest boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set())} | {t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
BARRIER = ("table", "td", "th", "caption", "button", "object")
#: A block closes an open paragraph unless one of these stands between.
SHELTER = (*BARRIER, "li", "div", "article", "section")
FREE = frozenset([*BARRIER, "tr", "tbody", "thead", "tfoot", "html", "body"])
SPACE = re.compile(r"[ \t\n\r\f]+")
INDENT, TABLES, COLUMNS, PADDING, SPARE = 16, 8, 256, 4, 1 << 12


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes = name, attributes
        self.children: list[Node | str] = []


def unescaped(text: str) -> str:
    """Character references as characters; numbers that name none, however long, are replacement characters."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_REFERENCE.sub("\ufffd", ZEROS.sub(r"\g<1>0", text))
    return entities.unescape(text)


def scan_tag(source: str, at: int) -> tuple[int, dict[str, str] | None, bool]:
    """From behind a tag's name: the place behind the tag (-1 if it never ends), its attributes, whether it closes itself."""
    found: dict[str, str] | None = None
    end = len(source)
    while True:
        start = at
        at = BETWEEN.match(source, at).end()
        if at >= end:
            return -1, None, False
        if source[at] == ">":
            return at + 1, found, at > start and source[at - 1] == "/"
        m = KEY.match(source, at)
        key, at = m[0].lower(), m.end()
        value, behind = "", BLANKS.match(source, at).end()
        if behind < end and source[behind] == "=":
            at = BLANKS.match(source, behind + 1).end()
            if at < end and source[at] in "\"'":
                stop = source.find(source[at], at + 1)
                if stop < 0:
                    return -1, None, False
                value, at = source[at + 1 : stop], stop + 1
            else:
                m = UNQUOTED.match(source, at)
                value, at = m[0], m.end()
        if found is None:
            found = {}
        found.setdefault(key, value)


class Builder:
    """The stack of open elements, with the places of each name in it."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}

    def last(self, names: Iterable[str]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().name].pop()

    def text(self, text: str) -> None:
        if text:
            self.stack[-1].children.append(unescaped(text))

    def end(self, name: str) -> None:
        place = self.last((name,))
        if place and (name in FREE or place > self.last(BARRIER)):
            self.cut(place)

    def start(self, node: Node, closed: bool) -> None:
        name = node.name
        rule = CLOSES.get(name)
        if rule:
            place = self.last(rule[0])
            if place > self.last(rule[1]):
                while place > 1 and self.stack[place - 1].name in rule[0]:
                    place -= 1
                self.cut(place)
        if name in BLOCK and name not in ("html", "body"):
            place = self.last(("p",))
            if place > self.last(SHELTER):
                self.cut(place)
        self.stack[-1].children.append(node)
        if name not in VOID and name not in RAW and not (closed and (self.places.get("svg") or self.places.get("math") or name in ("svg", "math"))):
            self.push(node)


def parse(source: str) -> Node:
    tree = Builder()
    at, end, begin = 0, len(source), 0
    ends: dict[str, re.Pattern] = {}
    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= end:
            tree.text(source[begin:])
            return tree.root
        sign = source[at + 1]
        if sign == "!" or sign == "?" or sign == "/" and not NAME.match(source, at + 2):
            tree.text(source[begin:at])
            mark, skip = ("-->", 4) if source.startswith("<!--", at) else (">", 2)
            stop = source.find(mark, at + skip)
            if stop < 0:
                return tree.root
            begin = at = stop + len(mark)
            continue
        m = NAME.match(source, at + 1 + (sign == "/"))
        if not m:
            at += 1
            continue
        tree.text(source[begin:at])
        begin, attributes, closed = scan_tag(source, m.end())
        if begin < 0:
            return tree.root
        at, name = begin, m[0].lower()
        if sign == "/":
            if name in ("br", "p") and not tree.places.get(name):
                name == "br" and tree.start(Node("br"), False)
            else:
                tree.end(name)
            continue
        node = Node(name, attributes)
        tree.start(node, closed)
        if name in RAW:
            if name not in ends:
                ends[name] = re.compile("</" + name + r"(?=[\s/>])", re.I)
            close = ends[name].search(source, at)
            stop = close.start() if close else end
            if name == "textarea":
                node.children.append(unescaped(source[at:stop]))
            elif name == "xmp":
                node.children.append(source[at:stop])
            begin = at = stop
            if close:
                begin = at = scan_tag(source, close.end())[0]
                if at < 0:
                    return tree.root


def style(node: Node) -> dict[str, str]:
    found = {}
    for part in re.sub(r"/\*.*?(?:\*/|\Z)", " ", node.attributes.get("style", ""), flags=re.S).lower().split(";"):
        key, _, value = part.partition(":")
        found[key.strip()] = value.replace("!important", "").strip()
    return found


def shown(node: Node, visible: bool) -> bool | None:
    """Whether text in a node is visible, from its parent's; None where nothing below can be."""
    if node.name in UNSEEN:
        return None
    a = node.attributes
    if node.name == "dialog" and not (a and "open" in a):
        return None
    if a:
        if "hidden" in a:
            return None
        if "style" in a:
            rules = style(node)
            if rules.get("display") == "none":
                return None
            if rules.get("visibility") in ("hidden", "collapse"):
                return False
            if rules.get("visibility") == "visible":
                return True
    return visible


class Lines:
    """Collects text with collapsed spaces and at most one blank line between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = True  # nothing, or a space, stands before
        self.marks = 0  # list marks that wait for their text

    def mark(self, indent: str, mark: str) -> None:
        self.now += [mark] if self.marks else [indent + mark]
        self.marks += 1
        self.blank = True

    def item_end(self) -> None:
        if self.marks:  # an item without text
            self.now.pop()
            self.marks -= 1
        self.end()

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if self.blank:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)
            self.blank, self.marks = s[-1] == " ", 0

    def fixed(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                self.end(force=True)
            if line:
                self.now.append(line)
                self.blank, self.marks = False, 0

    def end(self, force: bool = False) -> None:
        if self.marks:
            return
        line = "".join(self.now).rstrip(" ")
        if line or force:
            self.done.append(line)
        self.now, self.blank = [], True

    def gap(self) -> None:
        self.end()
        if self.done and not self.marks and self.done[-1]:
            self.done.append("")

    def result(self) -> list[str]:
        self.marks = 0
        self.end()
        first, last = 0, len(self.done)
        while first < last and not self.done[first]:
            first += 1
        while last > first and not self.done[last - 1]:
            last -= 1
        return self.done[first:last]


def span(node: Node, name: str, most: int) -> int:
    value = (node.attributes or {}).get(name, "").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


class Table:
    """Cells by row, each with its first column; columns that a cell of an earlier row reaches down to are passed over."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, Lines]]] = []
        self.taken: dict[int, int] = {}  # the last row that a cell from above takes, by column
        self.at = 0

    def row(self) -> None:
        self.rows.append([])
        self.at = 0

    def cell(self, node: Node) -> Lines:
        if not self.rows:
            self.row()
        here = len(self.rows) - 1
        while self.at < COLUMNS and self.taken.get(self.at, -1) >= here:
            self.at += 1
        wide, high = span(node, "colspan", 1000), span(node, "rowspan", 65534)
        lines = Lines()
        self.rows[-1].append((self.at, wide, lines))
        if high > 1:
            for c in range(self.at, min(self.at + wide, COLUMNS)):
                self.taken[c] = here + high - 1
        self.at += wide
        return lines

    def lines(self) -> list[str]:
        rows = [[(a, w, c.result()) for a, w, c in row] for row in self.rows]
        columns = sorted({a for row in rows for a, _, _ in row if a < COLUMNS})
        index = {a: i for i, a in enumerate(columns)}
        width = [0] * len(columns)
        size, spans = 0, []
        for row in rows:
            for a, w, cell in row:
                size += sum(map(len, cell))
                if a in index:
                    inside = 1
                    while inside < w and index[a] + inside < len(columns) and columns[index[a] + inside] < a + w:
                        inside += 1
                    most = max(map(len, cell), default=0)
                    if inside == 1:
                        width[index[a]] = max(width[index[a]], most)
                    else:
                        spans.append((index[a], inside, most))
        for i, n, most in spans:  # what does not fit widens the last column
            width[i + n - 1] += max(0, most - sum(width[i : i + n]) - 2 * (n - 1))
        starts = [0]
        for w in width:
            starts.append(starts[-1] + w + 2)
        tall = [max((len(c) for _, _, c in row), default=0) for row in rows]
        reach = [max((starts[index[a]] for a, _, c in row if a in index), default=0) for row in rows]
        aligned = sum(t * r for t, r in zip(tall, reach)) <= PADDING * size + SPARE
        out = []
        for row, height in zip(rows, tall):
            for i in range(height):
                line, long = [], 0
                for k, (a, _, cell) in enumerate(row):
                    pad = max(2 * (k > 0 and long > 0), starts[index[a]] - long if a in index and aligned else 0)
                    text = cell[i] if i < len(cell) else ""
                    if text:
                        line += [" " * pad, text]
                        long += pad + len(text)
                out.append("".join(line))
        return out


def render(root: Node) -> str:
    """Visible text. A stack of steps stands for recursion; cells of tables render into their own lines."""
    out = Lines()
    # what to do, with what, where to write, the list around it, preformatted, visible, tables around it
    steps: list[tuple] = [("node", root, out, None, False, True, 0)]
    while steps:
        kind, item, into, around, pre, visible, deep = steps.pop()
        if kind == "call":
            item()
            continue
        if isinstance(item, str):
            if visible:
                (into.fixed if pre else into.text)(item)
            continue
        node, name = item, item.name
        visible = shown(node, visible)
        if visible is None:
            continue
        if name == "br":
            into.end(force=True)
            continue
        if name == "hr":
            into.gap()
            continue
        if name == "wbr":
            continue
        if name == "img":
            if visible and node.attributes and node.attributes.get("alt"):
                into.text(unescaped(node.attributes["alt"]))
            continue
        if name == "table" and deep < TABLES:
            into.gap()
            table = Table()
            inner: list[tuple] = []
            outer: list[tuple] = []
            todo: list[tuple[Node | str, bool]] = [(x, visible) for x in reversed(node.children)]
            while todo:
                x, seen = todo.pop()
                if isinstance(x, str):
                    if x.strip():
                        outer.append(("node", x, into, around, False, seen, deep))
                    continue
                own = shown(x, seen)
                if own is None:
                    continue
                if x.name in GROUPS or x.name == "tr":
                    if x.name == "tr":
                        table.row()
                    todo.extend((c, own) for c in reversed(x.children))
                elif x.name in CELLS:
                    cell = table.cell(x)
                    inner += [("node", c, cell, None, False, own, deep + 1) for c in x.children]
                else:
                    outer.append(("node", x, into, around, False, seen, deep))

            def write(table: Table = table, into: Lines = into) -> None:
                into.end()
                into.done += table.lines()
                into.gap()

            steps.append(("call", write, into, around, pre, visible, deep))
            steps.extend(reversed(outer + inner))
            continue
        spaced = name in SPACED and not (name in ("ul", "ol") and around)
        if spaced:
            into.gap()
        elif name in BLOCK:
            into.end()
        inside = around
        if name in ("ul", "ol", "menu"):
            first = span(node, "start", 99999) if name == "ol" else 1
            inside = [name, first - 1, 1 + (around[2] if around else 0)]
        elif name == "li":
            mark = "- "
            if around:
                around[1] += 1
                mark = f"{around[1]}. " if around[0] == "ol" else "- "
            if visible:
                into.mark("  " * min(INDENT, around[2] - 1 if around else 0), mark)
        if name in BLOCK or spaced:
            steps.append(("call", into.gap if spaced else into.item_end if name == "li" and visible else into.end, into, around, pre, visible, deep))
        children = node.children
        if name == "details" and not (node.attributes and "open" in node.attributes):
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if name in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        steps.extend(("node", c, into, inside, pre or name in ("pre", "textarea", "xmp"), visible, deep) for c in reversed(children))
    return "\n".join(out.result())


def extract(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the visible text in `into` in place of the html column. Narrow."""
    bounded_batches(pages.sparkSession)
    kept = pages.drop(into)
    fields = [f for f in kept.schema.fields if f.name != html]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html):
            texts = pa.array([extract(s) for s in part.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), texts], names=[*(f.name for f in fields), into])

    return kept.mapInArrow(released(run), T.StructType([*fields, T.StructField(into, T.StringType(), False)]))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
