"""Visible text of HTML pages, laid out: a small tree builder, visibility rules and a block renderer."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template iframe object audio video canvas svg math datalist noembed noframes title".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset menu".split())
BLOCKS = PARAGRAPHS | set(
    "html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup hr legend li main nav optgroup option search section summary".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CELLS, PARTS = {"td", "th"}, {"thead", "tbody", "tfoot"}
#: an open element of the first set ends where the tag starts, unless one of the second set is met first
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "caption": ({"caption"}, {"table"}),
} | {t: (PARTS | {"caption", "colgroup"}, {"table"}) for t in PARTS} | {h: (HEADINGS, BLOCKS - HEADINGS) for h in HEADINGS}
WALLS = CELLS | {"table", "caption", "button", "object", "template", "html"}
SPACES = re.compile(r"[ \t\n\r\f\v]+")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b|(?:^|;)\s*content-visibility\s*:\s*hidden\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
#: columns and rows that a cell may span, as HTML has it
WIDEST_SPAN, TALLEST_SPAN = 1000, 65534
#: cells are padded to the widest of their column, but no further than this; a longer cell runs on
ALIGNED = 80


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Elements with the tags that authors leave out put in: ends of paragraphs, items and cells, and rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: where the open elements of each tag stand, so that no start or end has to look through all of them
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def _last(self, tags: set[str]) -> int:
        """Place of the innermost open element with one of the tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _end(self, tags: set[str], walls: set[str]) -> bool:
        at = self._last(tags)
        if at <= self._last(walls - tags):
            return False
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]
        return True

    def _start(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.places[tag].append(len(self.open))
        self.open.append(node)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("html", "body"):
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            if tag == "body":
                self._end({"head"}, set())
            return
        if tag in BLOCKS:
            self._end({"head"}, set())
            self._end({"p"}, WALLS)
        if tag in ENDS:
            self._end(*ENDS[tag])
        top = self.open[-1].tag
        if tag in CELLS and top in PARTS | {"table"}:
            self._start("tr", {})
        self._start(tag, attrs)
        if tag in VOID:
            self.places[tag].pop()
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in ("html", "body") and tag not in VOID:
            walls = {"table"} if tag in CELLS | PARTS | {"tr"} else WALLS - {tag}
            if not self._end({tag}, walls) and tag == "p":
                self.open[-1].children.append(Node("p", {}))

    def handle_data(self, data):
        self.open[-1].children.append(data)


class Flow:
    """Lines of one block: the page, a list item or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = False

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *rest = data.split("\n")
            self.now.append(first)
            for line in rest:
                self.end_line(True)
                self.now.append(line)
            return
        for i, word in enumerate(SPACES.split(data)):
            if i:
                self.space = True
            if word:
                if self.space and self.now and not self.now[-1].endswith(" "):
                    self.now.append(" ")
                self.now.append(word)
                self.space = False

    def end_line(self, even_empty: bool = False) -> None:
        line = "".join(self.now).rstrip()
        if line.strip() or even_empty:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.append(line)
        self.now, self.space = [], False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.extend(lines)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return self.lines


def _number(x, otherwise: int, least: int, most: int) -> int:
    try:
        return min(max(int(x), least), most)
    except (TypeError, ValueError):
        return otherwise


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows spanned) as text: every column as wide as its widest cell, up to ALIGNED.

    A line ends with the last cell that has something on it.
    """
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows it is still covered from above
    for cells in rows:
        row, at = {}, 0
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, across, down in cells:
            while at in taken:
                at += 1
            row[at] = lines
            if down > 1:
                below.update({c: down - 1 for c in range(at, at + across)})
            at += across
        grid.append(row)
        taken = below
    width: dict[int, int] = {}
    for row in grid:
        for c, lines in row.items():
            width[c] = max([width.get(c, 0), *map(len, lines)])
    columns = sorted(c for c, w in width.items() if w)
    out = []
    for row in grid:
        for i in range(max([0, *(len(x) for x in row.values())])):
            last = max((c for c, lines in row.items() if len(lines) > i and lines[i]), default=-1)
            cells = [(row.get(c, [])[i : i + 1] or [""])[0].ljust(min(width[c], ALIGNED)) for c in columns[: bisect_right(columns, last)]]
            out.append(" | ".join(cells).rstrip())
    return out


def _hidden(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in UNSEEN
        or "hidden" in a
        or node.tag == "dialog" and "open" not in a
        or bool(HIDDEN_STYLE.search(a.get("style") or ""))
    )


def render(root: Node) -> str:
    """Walks the tree without recursion; lists, cells and rows collect on stacks of their own."""
    flows, tables, lists = [Flow()], [], []
    work: list[tuple] = [(root, True, False, False)]
    while work:
        item = work.pop()
        if callable(item[0]):
            item[0]()
            continue
        node, seen, kept, listed = item
        flow = flows[-1]
        if isinstance(node, str):
            if seen:
                flow.text(node, kept)
            continue
        if _hidden(node):
            continue
        tag = node.tag
        shown = VISIBILITY.search(node.attrs.get("style") or "")
        seen = shown[1].lower() == "visible" if shown else seen
        kept = kept or tag in ("pre", "textarea")
        if tag == "br":
            flow.end_line(True)
            continue
        gap = 1 if tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and listed) else 0
        if tag in BLOCKS:
            flow.block(gap)
            work.append(((lambda g=gap: flows[-1].block(g)),))
        inner, children = listed, node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("ul", "ol", "menu"):
            start = _number(node.attrs.get("start"), 1, -(10**9), 10**9)
            lists.append([tag == "ol", start])
            work.append((lists.pop,))
            inner = True
        elif tag in ("li", "dd"):
            mark = "  "
            if tag == "li":
                kind = lists[-1] if lists else [False, 1]
                kind[1] = _number(node.attrs.get("value"), kind[1], -(10**9), 10**9)
                mark = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
            flows.append(Flow())

            def close(mark=mark):
                lines = flows.pop().done()
                pad = " " * len(mark)
                flows[-1].add([(mark if not i else pad) + x if x else x for i, x in enumerate(lines)])

            work.append((close,))
        elif tag == "table":
            tables.append([])

            def close_table():
                flows[-1].add(table_lines(tables.pop()))

            work.append((close_table,))
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in CELLS and tables:
            spans = [_number(node.attrs.get(k), 1, 1, most) for k, most in (("colspan", WIDEST_SPAN), ("rowspan", TALLEST_SPAN))]
            flows.append(Flow())

            def close_cell(spans=spans):
                lines = flows.pop().done()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, *spans))

            work.append((close_cell,))
            inner = False
        elif tag == "q":
            flow.text('"', kept)
            work.append(((lambda k=kept: flows[-1].text('"', k)),))
        work.extend((c, seen, kept, inner) for c in reversed(children))
    return "\n".join(flows[0].done())


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return render(tree.root)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_lines`` for every row.

    Null and empty pages, and pages without visible text, give an empty text and no lines. Repeated rows
    and null ids are kept as they are; broken markup is read as a browser would, as far as the tree builder
    knows it; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [visible_text(x.as_py()) for x in batch.column("html")]
            lines = [x.count("\n") + 1 if x else 0 for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"])

    narrow = pages.select(pages["page_id"].cast("bigint").alias("page_id"), F.col("html").cast("string"))
    return narrow.mapInArrow(rows, "page_id bigint, text string, n_lines bigint")
