"""HTML pages to ordered content elements (X-01 .. X-08)."""
from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .ordered import SEGMENT, heading_stack, scan, segment_of

# Tags that carry content, tags that are dropped, class names of the main part.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTENT = frozenset((*HEADINGS, "p", "li", "table", "button"))
DROPPED = frozenset(("script", "style", "noscript", "header", "footer", "nav", "aside", "form"))
MAIN_CLASSES = ("c-main", "main-content", "page-content", "content")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ACCORDION_LEVEL = 3


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator["Node | str | Comment"]:
        todo = list(reversed(self.children))
        while todo:
            item = todo.pop()
            yield item
            if isinstance(item, Node):
                todo.extend(reversed(item.children))


class Comment(str):
    """Comment text: part of inline text, not of heading text."""


class Tree(HTMLParser):
    """A tolerant tree: an end tag closes up to its start tag, a stray one is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Comment(data))


PIECE = "struct<row: int, cell: int, text: string, address: string, inside: int, comment: boolean>"
ELEMENT = f"page_id long, seq int, block_type string, heading_level int, pieces array<{PIECE}>"


def pieces(node: Node, base: str, row: int = -1, cell: int = -1) -> list[dict]:
    """The text events of a subtree, in document order; a link comes before its text and says how many events it holds."""
    out: list[dict] = []
    todo: list = [*reversed(node.children)]
    while todo:
        item = todo.pop()
        if isinstance(item, dict):  # a link whose subtree is over
            item["inside"] = len(out) - item.pop("at")
        elif isinstance(item, str):
            out.append({"row": row, "cell": cell, "text": str(item), "address": None, "inside": 0, "comment": isinstance(item, Comment)})
        else:
            if item.tag == "a" and item.attrs.get("href"):
                link = {"row": row, "cell": cell, "text": None, "address": resolved(base, item.attrs["href"]), "inside": 0, "comment": False}
                out.append(link)
                link["at"] = len(out)
                todo.append(link)
            todo += reversed(item.children)
    return out


def resolved(base: str, address: str) -> str:
    try:
        return urljoin(base, address)
    except ValueError:
        return address


def table_pieces(node: Node, base: str) -> list[dict]:
    """Events of a table by row and cell; of a table without cells, its plain text."""
    rows = [[c for c in item.children if isinstance(c, Node) and c.tag in ("th", "td")]
            for item in node.walk() if isinstance(item, Node) and item.tag == "tr"]
    out: list[dict] = []
    for r, cells in enumerate(filter(None, rows)):
        for c, cell in enumerate(cells):
            # A cell without any text is a cell, too.
            out += pieces(cell, base, r, c) or [{"row": r, "cell": c, "text": "", "address": None, "inside": 0, "comment": False}]
    return out or [p for p in pieces(node, base) if p["address"] is None and not p["comment"]]


def plain_text(found: Column) -> Column:
    """Text events without comments and links."""
    kept = F.filter(found, lambda p: p["address"].isNull() & ~p["comment"])
    return X.collapse(F.array_join(F.transform(kept, lambda p: p["text"]), " "))


def inline_text(found: Column) -> Column:
    """X-04: all text events, each link as ``[label](address)`` before its own text; links without a label are left out."""
    def shown(p: Column, i: Column) -> Column:
        label = plain_text(F.slice(found, i + 2, p["inside"]))
        return F.when(p["address"].isNull(), p["text"]).when(label != "", F.concat(F.lit("["), label, F.lit("]("), p["address"], F.lit(")")))

    return X.collapse(F.array_join(F.transform(found, shown), " "))


def table_text(found: Column) -> Column:
    """X-05: a table as Markdown, short rows padded."""
    last = F.array_max(F.transform(found, lambda p: p["row"]))
    width = F.array_max(F.transform(found, lambda p: p["cell"])) + 1

    def line(r: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), width - 1), lambda c: inline_text(F.filter(found, lambda p: (p["row"] == r) & (p["cell"] == c))))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), line)).otherwise(F.array().cast("array<string>"))
    return F.when(last < 0, plain_text(found)).otherwise(F.array_join(F.concat(F.array(line(F.lit(0)), rule), body), "\n"))


def main_part(root: Node) -> Node:
    """X-01."""
    nodes = [n for n in root.walk() if isinstance(n, Node)]
    tests = [lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main"]
    tests += [lambda n, c=c: c in n.attrs.get("class", "") for c in MAIN_CLASSES]
    tests.append(lambda n: n.tag == "body")
    for test in tests:
        for n in nodes:
            if test(n):
                return n
    return root


def elements(html: str, base: str) -> Iterator[tuple[str, int | None, list[dict]]]:
    """X-02, X-03, X-06: (block type, heading level, text events) in document order."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    top = main_part(tree.root)
    prune(top)
    todo: list[tuple[Node, bool]] = [(c, False) for c in reversed(top.children) if isinstance(c, Node)]
    if top.tag in CONTENT:
        todo = [(c, True) for c, _ in todo]
    while todo:
        node, nested = todo.pop()
        content = node.tag in CONTENT
        if content and (node.tag == "li" or not nested):
            if node.tag in HEADINGS:
                yield "heading", int(node.tag[1]), pieces(node, base)
            elif node.tag == "button" and "accordion" in node.attrs.get("class", "").lower():
                yield "heading", ACCORDION_LEVEL, pieces(node, base)
            elif node.tag == "table":
                yield "table", None, table_pieces(node, base)
            elif node.tag in ("li", "p"):
                yield "list_item" if node.tag == "li" else "paragraph", None, pieces(node, base)
        todo.extend((c, nested or content) for c in reversed(node.children) if isinstance(c, Node))


def prune(node: Node) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in DROPPED)]
        todo.extend(c for c in n.children if isinstance(c, Node))


EVENTS = pa.schema([
    ("page_id", pa.int64()), ("seq", pa.int32()), ("block_type", pa.string()), ("heading_level", pa.int32()),
    ("pieces", pa.list_(pa.struct([("row", pa.int32()), ("cell", pa.int32()), ("text", pa.string()), ("address", pa.string()), ("inside", pa.int32()),
                                   ("comment", pa.bool_())])))])
EVENT_CHARACTERS = 1 << 22  # of pages whose elements make one batch, the last page's not counted


def page_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of all pages; many pages make a batch, as a batch costs more than a page."""
    rows: list[dict] = []
    size = 0
    for pages in batches:
        for page_id, url, html in zip(*(pages.column(c) for c in ("page_id", "url", "html"))):
            page_id, url, html = page_id.as_py(), url.as_py() or "", html.as_py() or ""
            rows += [{"page_id": page_id, "seq": n, "block_type": kind, "heading_level": level, "pieces": events}
                     for n, (kind, level, events) in enumerate(elements(html, url), 1)]
            size += len(html)
            if size >= EVENT_CHARACTERS:
                yield pa.RecordBatch.from_pylist(rows, EVENTS)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, EVENTS)


def html_elements(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) to elements; the event parser is the only Python step, texts are built from its events.

    Elements without text are left out; the others are numbered from 1 in document order.
    """
    found = pages.select("page_id", "url", "html").mapInArrow(page_events, ELEMENT)
    events, kind = F.col("pieces"), F.col("block_type")
    text = F.when(kind == "heading", plain_text(events)).when(kind == "table", table_text(events)) \
        .when(kind == "list_item", F.concat(F.lit("- "), inline_text(events))).otherwise(inline_text(events))
    rows = found.select("page_id", "seq", "block_type", "heading_level", text.alias("text")).where("text <> ''")
    numbered = scan(rows.withColumn(SEGMENT, F.lit(0).cast("long")), ["page_id"], SEGMENT, ["seq"], sums={"__n": F.lit(1)}, one_segment=True)
    return numbered.select("page_id", F.col("__n").cast("int").alias("seq"), "block_type", "heading_level", "text")


def html_blocks(pages: DataFrame) -> DataFrame:
    """X-07: elements with their heading path. A group is one page, which is one input row."""
    rows = html_elements(pages).withColumn(SEGMENT, F.lit(0).cast("long"))
    heading = F.when(F.col("block_type") == "heading", F.col("text"))
    stacked = heading_stack(
        rows, ["page_id"], SEGMENT, ["seq"], "heading_level", heading, max_level=6, one_segment=True)
    return stacked.select(
        "page_id", "seq", "block_type", "heading_level", heading.alias("heading"),
        X.join_path(F.col("heading_path")).alias("heading_path"), "text")


def structured_html(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """X-08: one text per page, headings shown as marker lines."""
    marker = F.concat(F.lit("--- H"), F.col("heading_level"), F.lit(": "), F.col("heading"), F.lit(" ---"))
    piece = F.when(F.col("block_type") == "heading", marker).otherwise(F.col("text"))
    return blocks.groupBy(key).agg(X.ordered_text(piece, F.col("seq"), "\n\n").alias("structured_text"))


def structured_pages(pages: DataFrame) -> DataFrame:
    """X-08 for numbered pages: one text per document, its pages under their markers."""
    piece = F.concat(F.lit("--- PAGE "), F.col("page_number"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy("document_id").agg(X.ordered_text(piece, F.col("page_number"), "\n\n").alias("structured_text"))


def structured_parts(pages: DataFrame, size: int = 1 << 20, segment: int = 1024) -> DataFrame:
    """X-08 for documents of any length: document_id, part, start, n_pages and text of the parts of `structured_pages`.

    A page belongs to the part in which its text would begin if parts were `size` characters, so a part ends with a page and has
    less than `size` characters more than its last page. Parts joined in order are the document; ``start`` is where a part begins in it.
    Places come from running sums over segments of ``segment`` pages, and a group is one part, so no document is held in one place.
    """
    piece = F.concat(F.when(F.col("__n") > 1, "\n\n").otherwise(""), F.lit("--- PAGE "), F.col("page_number"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    rows = pages.select("document_id", "page_number", "text", segment_of(F.col("page_number"), segment).alias(SEGMENT))
    rows = scan(rows, ["document_id"], SEGMENT, ["page_number"], sums={"__n": F.lit(1).cast("long")}).withColumn("__piece", piece).drop("text")
    rows = scan(rows, ["document_id"], SEGMENT, ["page_number"], sums={"__end": F.length("__piece").cast("long")})
    start = F.col("__end") - F.length("__piece")
    return rows.withColumn("__start", start).groupBy("document_id", F.floor(F.col("__start") / size).cast("int").alias("part")).agg(
        F.min("__start").alias("start"), F.count("*").alias("n_pages"), X.ordered_text(F.col("__piece"), F.col("page_number"), "").alias("text"))
