"""HTML pages to blocks.

A page is parsed to a light tree by the standard library's tokenizer, in one
Arrow function per batch; the blocks come out as an array that is exploded.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocks as b
from ..schemas import BLOCK

REMOVED = frozenset("script style noscript template svg canvas form".split())
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p table ul ol blockquote pre div section".split())
_VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
_SPACE = re.compile(r"\s+")


def squeeze(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str | None], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """The elements below, in document order; deep trees don't recurse."""
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, Node):
                    yield child
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def strings(self):
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, str):
                    yield child
                else:
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def text(self) -> str:
        return squeeze(" ".join(s for s in map(str.strip, self.strings()) if s))

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def within(self, *names: str) -> bool:
        here = self.parent
        while here is not None:
            if here.name in names:
                return True
            here = here.parent
        return False


class _Builder(HTMLParser):
    """Elements close at their end tag only, and with their parents: an open
    paragraph holds the next one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.held: list[str] = []
        self.open: dict[str, int] = {}

    def _settle(self) -> None:
        if self.held:
            self.here.children.append("".join(self.held))
            self.held = []

    def handle_starttag(self, tag, attrs):
        self._settle()
        node = Node(tag, dict(reversed(attrs)), self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._settle()
        if self.open.get(tag):
            while True:
                name, self.here = self.here.name, self.here.parent
                self.open[name] -= 1
                if name == tag:
                    break

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self._settle()


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._settle()
    todo = [builder.root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in REMOVED]
        todo += [c for c in node.children if isinstance(c, Node)]
    return builder.root


def _span(cell: Node, name: str) -> int:
    try:
        return max(1, int(cell.attrs.get(name) or 1))
    except ValueError:
        return 1


def table_grid(table: Node) -> tuple[list[str], list[list[str]]]:
    """Headers and data rows; a spanning cell's text is in every place it covers."""
    grid: dict[tuple[int, int], str] = {}
    heads: list[bool] = []
    for y, row in enumerate(n for n in table.walk() if n.name == "tr"):
        cells = [c for c in row.children if isinstance(c, Node) and c.name in ("th", "td")]
        if not cells:
            continue
        heads.append(row.within("thead") or all(c.name == "th" for c in cells))
        x = 0
        for cell in cells:
            while (y, x) in grid:
                x += 1
            value, high, wide = cell.text(), _span(cell, "rowspan"), _span(cell, "colspan")
            grid.update({(y + dy, x + dx): value for dy in range(high) for dx in range(wide)})
            x += wide
    if not grid:
        return [], []
    height, width = (1 + max(k[i] for k in grid) for i in (0, 1))
    rows = [[grid.get((y, x), "") for x in range(width)] for y in range(height)]
    n = next((i for i, head in enumerate(heads) if not head), len(heads))
    if not n:
        return [f"Column {x}" for x in range(1, width + 1)], rows
    headers = []
    for x in range(width):
        levels: list[str] = []
        for value in (row[x] for row in rows[:n]):
            if value and levels[-1:] != [value]:
                levels.append(value)
        headers.append(" > ".join(levels))
    return headers, rows[n:]


def page_blocks(html: str | None, name: str, dedupe_nested: bool = False) -> tuple[str, str, list[dict]]:
    """Title, document name and blocks of a page.

    Paragraphs inside of paragraphs, quotes and list items appear on their own
    and within the outer one; with ``dedupe_nested`` the outer one only.
    """
    tree = parse(html or "")
    title_node = tree.first("title")
    title = title_node.text() if title_node else ""
    root = tree.first("main") or tree.first("article") or tree.first("body") or tree
    out: list[dict] = []
    trail: list[str] = []

    def add(kind: str, text: str, path: list[str]) -> None:
        if text:
            out.append({"type": kind, "text": text, "heading_path": list(path)})

    add("heading", title, [])
    tables = 0
    for node in root.walk():
        tag = node.name
        if tag not in CONTENT or (tag != "table" and node.within("table")):
            continue
        if tag in ("ul", "ol"):
            if node.within("ul", "ol"):
                continue
            items = [c.text() for c in node.children if isinstance(c, Node) and c.name == "li"]
            marked = (f"{i}. {x}" if tag == "ol" else f"- {x}" for i, x in enumerate(items, 1) if x)
            add("list", " ".join(marked), trail)
        elif tag == "table":
            headers, rows = table_grid(node)
            if rows:
                tables += 1
                caption = node.first("caption")
                out.append({"type": "table", "heading_path": list(trail), "table_id": f"html-table-{tables}", "caption": caption.text() if caption else "", "headers": headers, "rows": rows})
        elif len(tag) == 2 and tag[0] == "h":
            text = node.text()
            if text:
                level = int(tag[1])
                trail = trail[: level - 1]
                add("heading", text, trail)
                trail = [*trail, text]
        elif tag in ("div", "section"):
            if not any(n.name in CONTENT for n in node.walk()):
                add("paragraph", node.text(), trail)
        elif not (dedupe_nested and node.within("p", "blockquote", "li", "pre")):
            add("paragraph", node.text(), trail)
    if not out:
        add("paragraph", root.text(), [])
    return title, title or name, out


_BLOCK = "struct<type: string, text: string, heading_path: array<string>, table_id: string, caption: string, headers: array<string>, rows: array<array<string>>>"
_ARROW = pa.list_(
    pa.struct([("type", pa.string()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("table_id", pa.string()), ("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
)


def parse_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", dedupe_nested: bool = False) -> DataFrame:
    """page_id, url, title, name and the array ``found`` of blocks, a row per page."""

    def run(batches):
        # few pages at a time: their trees and blocks are many times their bytes
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            parsed = [page_blocks(h, u or "HTML page", dedupe_nested) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            titles, names, found = zip(*parsed, strict=True) if parsed else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(names, pa.string()), pa.array(found, _ARROW)], names=["page_id", "url", "title", "name", "found"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, title string, name string, found array<{_BLOCK}>")


def html_blocks(pages: DataFrame, corpus: str | None = None, **options) -> DataFrame:
    """Block rows of pages.  Each page is a corpus of its own, or all are in
    the corpus ``corpus``, in the order of page ids, which is then numbered in
    one task, as a corpus is for chunking."""
    parsed = parse_pages(pages, **options)
    rows = parsed.select("page_id", "url", "name", F.posexplode("found").alias("_at", "_b"))
    place = F.col("_at").cast("long") if corpus is None else (F.row_number().over(Window.orderBy("page_id", "_at")) - 1).cast("long")
    rows = rows.select(
        (F.col("page_id").cast("string") if corpus is None else F.lit(corpus)).alias("corpus_id"), place.alias("block_pos"), "_b.type", "_b.text", F.col("name").alias("source_name"), F.coalesce("url", F.lit("")).alias("source_url"),
        F.lit(None).cast("int").alias("page"), "_b.heading_path", "_b.table_id", "_b.caption", "_b.headers", "_b.rows", F.lit(None).cast("array<double>").alias("bbox"),
    )
    return b.normalise(rows).select(*BLOCK.names)


def html_text(pages: DataFrame, **options) -> DataFrame:
    """(page_id, title, text): the rendered blocks of each page, a line apart."""
    parsed = parse_pages(pages, **options)
    shown = F.transform("found", lambda x: t.render_block(x["type"], x["text"], x["heading_path"], x["caption"], b.unique_headers(x["headers"]), x["rows"]))
    return parsed.select("page_id", "title", F.array_join(shown, "\n").alias("text"))
