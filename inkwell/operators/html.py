"""Blocks of web pages: what stands in main or article, by elements, with the table of cells and caption of tables."""

from __future__ import annotations

import html.parser
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

# Tags by what they do to a page's text.
CHROME = {"script", "style", "noscript", "svg", "nav", "header", "footer", "aside", "template", "iframe", "form"}
ELEMENTS = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
CELLS, LISTS, ARTICLES = {"td", "th"}, {"ul", "ol"}, {"main", "article"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
LEAD_ENDS = ("：", ":")
BATCH_ROWS = 4096


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a pipe table; the first is its header, with a separator below."""
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])]) if rows else ""


def code_text(text: str) -> str:
    """Code without blank lines at its ends and without white space at the end of a line."""
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    full = [i for i, x in enumerate(lines) if x]
    return "\n".join(lines[full[0] : full[-1] + 1]) if full else ""


class _Page(html.parser.HTMLParser):
    """Blocks (content_type, text, heading path, cells, caption) in order.

    `gathered` holds the pieces of the element that is `open`. A paragraph waits in `lead` for what follows it: a list
    takes it as its beginning, before anything else it is a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.path, self.gathered, self.items, self.row = [], [], [], [], []
        self.open = self.lead = self.caption = ""
        self.inside = self.skipped = 0
        self.table: list[list[str]] | None = None

    def taken(self) -> str:
        """The open element's text, which ends it."""
        pieces, kind = self.gathered, self.open
        self.gathered, self.open = [], ""
        return code_text("".join(pieces)) if kind == "pre" else " ".join(" ".join(pieces).split())

    def put(self, kind: str, text: str, cells=None, caption=None):
        if self.lead:
            self.blocks.append(("text", self.lead, list(self.path), None, None))
            self.lead = ""
        if text:
            self.blocks.append((kind, text, list(self.path), cells, caption))

    def end_unclosed(self):
        self.put("text", " ".join(self.taken().split()) if self.open else "")
        self.gathered = []

    def end_table(self):
        if self.table:
            self.put("table", pipe_table(self.table), self.table, self.caption or None)
        self.table, self.caption = None, ""

    def end_list(self):
        lead, self.lead = (self.lead, "") if self.items else ("", self.lead)
        colon = "：" if lead and not lead.endswith(LEAD_ENDS) else ""
        self.put("text", lead + colon + "；".join(self.items))
        self.items, self.gathered, self.open = [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" and self.open == "pre":
                self.gathered.append("\n")
            return
        self.skipped += tag in CHROME
        self.inside += tag in ARTICLES and not self.skipped
        if self.skipped or not self.inside:
            return
        if tag == "table":
            self.end_unclosed()
            self.table, self.caption = [], ""
        elif tag in ELEMENTS:
            self.end_unclosed()
            self.open = tag
        elif tag in CELLS or tag == "tr" or (tag == "caption" and self.table is not None):
            self.put("text", "")
            self.open = self.open if tag == "tr" else tag
        elif tag == "li":
            self.gathered, self.open = [], tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in CHROME and self.skipped:
            self.skipped -= 1
            return
        if self.skipped or not self.inside:
            return
        if tag in ARTICLES:
            self.inside -= 1
        elif tag in ELEMENTS:
            self.end_element(tag)
        elif tag in CELLS:
            self.row += filter(None, [self.taken()])
        elif tag == "caption" and self.table is not None:
            self.caption = self.taken() or self.caption
        elif tag == "tr":
            self.end_row()
        elif tag == "table":
            self.end_table()
        elif tag == "li":
            self.items += filter(None, [self.taken()])
        elif tag in LISTS:
            self.end_list()

    def end_row(self):
        row, self.row, self.gathered, self.open = self.row, [], [], ""
        if row and self.table is not None:
            self.table.append(row)
        else:
            self.put("text", " | ".join(row))

    def end_element(self, tag):
        self.open = tag if tag == "pre" else self.open
        text = self.taken()
        if not text:
            return
        self.put("", "")
        if tag == "p":
            self.lead = text
        elif tag[0] == "h":
            self.path = [*self.path[: int(tag[1]) - 1], text]
            self.put("heading", text)
        else:
            self.put("code" if tag == "pre" else "text", text)

    def handle_data(self, data):
        if self.open and self.inside and not self.skipped:
            self.gathered.append(data)

    def close(self):
        super().close()
        self.end_unclosed()
        self.end_table()
        self.put("text", " | ".join(self.row))
        self.put("text", "；".join(self.items))
        return self.blocks


def ended_references(text: str) -> str:
    """text whose ampersands stand for themselves, but where a reference begins that ends in a semicolon."""
    return re.sub(r"&(#?\w+;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", text)


def page_blocks(text: str | None, ended: bool = False) -> list[tuple]:
    page = _Page()
    page.feed(ended_references(text or "") if ended else text or "")
    return page.close()


def article_blocks(pages: DataFrame, key="page_id", html_col="html", ended: bool = False) -> DataFrame:
    """key, block_pos, content_type (heading, text, code, table), text, heading_path, cells and caption of each block of a
    page's main or article. No shuffle; a task holds one page's blocks and at most BATCH_ROWS more.

    Chrome such as navigation and scripts is passed over. Items of a list are one block, begun by the paragraph right before;
    a table is one pipe table; white space collapses but in code. A heading of level l cuts the path to l - 1 entries. An element
    that is not closed ends where the next begins. Pages that are null or have neither element have no blocks. As in browsers,
    `&amp` is an ampersand without its semicolon too; with `ended` it is not."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        names = [key, "block_pos", "content_type", "text", "heading_path", "cells", "caption"]
        types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string()]

        def batch(rows, key_type):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [key_type, *types])], names)

        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(k, i, *x) for i, x in enumerate(page_blocks(t, ended))]
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows, b.column(0).type)
                    rows = []
            if rows:
                yield batch(rows, b.column(0).type)

    return pages.select(key, html_col).mapInArrow(run, f"{key} {kind}, block_pos int, content_type string, text string, heading_path array<string>, cells array<array<string>>, caption string")
