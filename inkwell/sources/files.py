"""Readers of tabular, word and slide files, and routing of PDF pages: bytes in, block rows out.

`files` is what spark.read.format("binaryFile") gives: path and content. A file is one row and is read by one task, and
leaves it in batches of bounded rows; all readers give the columns of BLOCKS. A file that cannot be read gives one row
of content_type "error" that says why, so that a broken file does not end a job; null content gives no row. Pictures
are not read: each is a row of content_type "image" with its member's name in `asset`; formulas are left out.
"""

from __future__ import annotations

import csv
import datetime
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as D

BLOCKS = "path string, block_pos int, page int, content_type string, text string, heading_path array<string>, asset string"
_NAMES = pa.list_(pa.string())
_BLOCKS = pa.schema([("path", pa.string()), ("block_pos", pa.int32()), ("page", pa.int32()), ("content_type", pa.string()), ("text", pa.string()), ("heading_path", _NAMES), ("asset", pa.string())])
_GROUPS = pa.schema([("path", pa.string()), ("block_pos", pa.int32()), ("sheet", pa.string()), ("row_start", pa.int32()), ("header", _NAMES), ("rows", pa.list_(_NAMES)), ("error", pa.string())])
#: Rows of an Arrow batch.
BATCH = 256

# Labels before tables, and numbers of the built-in formats that are dates.
WORD_TABLE, SLIDE_TABLE = "Word 表格：\n", "PPT 表格：\n"
DATE_FORMATS = (14, 15, 16, 17, 22)
# Names of the formats' XML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _read(files: DataFrame, read: Callable[[str, bytes], Iterable[tuple]], schema: pa.Schema, ddl: str, failed: Callable[[str], tuple]) -> DataFrame:
    """What read(path, content) gives of each file, numbered: rows of schema, less their path and block_pos."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches):
        out: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                if not content.is_valid:
                    continue
                path, n = path.as_py(), 0
                try:
                    for n, row in enumerate(read(path or "", content.as_py()), 1):
                        out.append((path, n - 1, *row))
                        if len(out) >= BATCH:
                            yield batch(out)
                            out = []
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is a row of its own
                    out.append((path, n, *failed(f"{type(e).__name__}: {e}")))
        if out:
            yield batch(out)

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, ddl)


def _blocks(files: DataFrame, read) -> DataFrame:
    return _read(files, read, _BLOCKS, BLOCKS, lambda why: (None, "error", why, [], None))


# --- tables -----------------------------------------------------------------------------------------------------------


def _row_groups(sheet: str, rows: Iterable[list[str]], size: int) -> Iterator[tuple]:
    """(sheet, first row from 1, header, rows, no error) of every `size` rows after the first one that isn't blank."""
    header, at, held = None, 0, []
    for at, row in enumerate(rows):
        if header is None:
            if any(c.strip() for c in row):
                header = row
            continue
        held.append(row)
        if len(held) == size:
            yield sheet, at - len(held) + 1, header, held, None
            held = []
    if held:
        yield sheet, at - len(held) + 1, header, held, None


def _table_blocks(files: DataFrame, read) -> DataFrame:
    """Row groups as blocks: name：value；... a line, rows padded or cut to the header's width, values without a name alone."""
    g = _read(files, read, _GROUPS, "path string, block_pos int, sheet string, row_start int, header array<string>, rows array<array<string>>, error string", lambda why: (None, None, None, None, why))
    width = F.size("header")
    cells = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width)
    line = lambda r: F.array_join(F.zip_with("header", cells(r), lambda h, v: F.when(F.trim(h) != "", F.concat(h, F.lit("："), v)).otherwise(v)), "；")
    broken = F.col("error").isNotNull()
    rows = F.concat(F.lit("行 "), F.col("row_start").cast("string"), F.lit("-"), (F.col("row_start") + F.size("rows") - 1).cast("string"))
    none = F.array().cast("array<string>")
    return g.select(
        "path", "block_pos", F.lit(None).cast("int").alias("page"), F.when(broken, "error").otherwise("table").alias("content_type"),
        F.when(broken, F.col("error")).otherwise(F.array_join(F.transform("rows", line), "\n")).alias("text"),
        F.when(broken, none).otherwise(F.array("sheet", rows)).alias("heading_path"), F.lit(None).cast("string").alias("asset"))


def csv_blocks(files: DataFrame, size: int = D.ROWS_A_GROUP) -> DataFrame:
    """Blocks of `size` rows of CSV files in UTF-8, with or without a byte order mark, streamed.

    Cells are trimmed. The header is the first row with anything in it; blank rows after it count. The sheet is the
    file's name without its extension. A file without rows after a header gives none."""

    def read(path, content):
        text = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", errors="replace", newline="")
        csv.field_size_limit(2**31 - 1)
        name = posixpath.splitext(posixpath.basename(path))[0]
        yield from _row_groups(name, ([c.strip() for c in row] for row in csv.reader(text)), size)

    return _table_blocks(files, read)


def _targets(z: zipfile.ZipFile, member: str) -> dict[str, str]:
    """Members that a member refers to, by id."""
    folder, name = posixpath.split(member)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(rels)):
        to = r.get("Target", "")
        out[r.get("Id")] = to.lstrip("/") if to.startswith("/") else posixpath.normpath(posixpath.join(folder, to))
    return out


def _place(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B7."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits) - 1, col - 1


def _number(v: str, date: bool) -> str:
    if date:
        return str(datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(float(v) * 86400)))
    return v if re.fullmatch(r"-?\d+", v) else str(float(v))


def _sheet_rows(z: zipfile.ZipFile, member: str, shared: list[str], dates: set[int]) -> Iterator[list[str]]:
    """Rows of a sheet from its first column on, without blank ones; cells of a merged range have its first cell's value."""
    cells: dict[int, dict[int, str]] = {}
    sheet = ElementTree.fromstring(z.read(member))
    for c in sheet.iter(f"{S}c"):
        row, col = _place(c.get("r"))
        kind, v = c.get("t", "n"), c.findtext(f"{S}v")
        if kind == "inlineStr":
            v = "".join(t.text or "" for t in c.iter(f"{S}t"))
        elif v is not None and kind == "s":
            v = shared[int(v)]
        elif v is not None and kind == "b":
            v = "True" if v == "1" else "False"
        elif v is not None and kind == "n":
            v = _number(v, int(c.get("s", 0)) in dates)
        if v is not None:
            cells.setdefault(row, {})[col] = v
    width = max((max(r) + 1 for r in cells.values()), default=0)
    for m in sheet.iter(f"{S}mergeCell"):
        first, _, last = m.get("ref").partition(":")
        (top, left), (bottom, right) = _place(first), _place(last or first)
        v = cells.get(top, {}).get(left)
        width = max(width, right + 1)
        for row in range(top, bottom + 1) if v is not None else ():
            for col in range(left, right + 1):
                cells.setdefault(row, {}).setdefault(col, v)
    for row in sorted(cells):
        out = [cells[row].get(col, "") for col in range(width)]
        if any(v.strip() for v in out):
            yield out


def xlsx_blocks(files: DataFrame, size: int = D.ROWS_A_GROUP) -> DataFrame:
    """Blocks of `size` rows of every sheet of XLSX files, by the rules of csv_blocks, but blank rows are dropped.

    Stored values of formulas are read; numbers in a date's format become its date and time. One sheet is held in memory
    at a time."""

    def read(path, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                # phonetic hints (rPh) are no part of a string
                for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si"):
                    shared.append("".join(t.text or "" for t in (*si.findall(f"{S}t"), *si.findall(f"{S}r/{S}t"))))
            dates = set()
            if "xl/styles.xml" in names:
                styles = ElementTree.fromstring(z.read("xl/styles.xml"))
                own = {int(f.get("numFmtId")) for f in styles.iter(f"{S}numFmt") if re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)}
                dates = {i for i, x in enumerate(styles.findall(f"{S}cellXfs/{S}xf")) if int(x.get("numFmtId", 0)) in own.union(DATE_FORMATS)}
            to = _targets(z, "xl/workbook.xml")
            for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
                yield from _row_groups(s.get("name"), _sheet_rows(z, to[s.get(f"{R}id")], shared, dates), size)

    return _table_blocks(files, read)


# --- word and slide files ---------------------------------------------------------------------------------------------


def _word_text(paragraph) -> str:
    """Texts of a paragraph's runs in order, with their tabs and breaks."""
    breaks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{W}t" else breaks.get(x.tag, "") for r in paragraph.iter(f"{W}r") for x in r)


def _word_table(table) -> list[list[str]]:
    """Cells' texts; a cell over several columns or rows stands in each."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(f"{W}val") != "restart" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            else:
                text = "\n".join(map(_word_text, tc.findall(f"{W}p"))).strip()
            row += [text] * int(span.get(f"{W}val", 1) if span is not None else 1)
        rows.append(row)
    return rows


def docx_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs of DOCX files, then tables as JSON, then pictures.

    A style named "Heading n" makes a heading, which ends those of its level and below; blocks carry the headings over
    them, tables those that stand at the end. Blank paragraphs are dropped."""

    def read(path, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            styles = {}
            if "word/styles.xml" in z.namelist():
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                    name = s.find(f"{W}name")
                    styles[s.get(f"{W}styleId")] = name.get(f"{W}val", "") if name is not None else ""
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
            over: list[str] = []
            for p in body.findall(f"{W}p"):
                text, style = _word_text(p).strip(), p.find(f"{W}pPr/{W}pStyle")
                name = styles.get(style.get(f"{W}val"), "") if style is not None else ""
                if name.lower().startswith("heading"):
                    last = name.rsplit(" ", 1)[-1]
                    over = over[: max(int(last) - 1, 0) if last.isdigit() else 0]
                    if text:
                        over = [*over, text]
                        yield None, "heading", text, over, None
                elif text:
                    yield None, "text", text, over, None
            for t in body.findall(f"{W}tbl"):
                if rows := _word_table(t):
                    yield None, "table", WORD_TABLE + json.dumps(rows, ensure_ascii=False), over, None
            for member in z.namelist():
                if member.startswith("word/media/"):
                    yield None, "image", None, [], member

    return _blocks(files, read)


def _shapes(tree) -> Iterator:
    """Shapes of a slide in order, those of groups in place of the group."""
    for s in tree:
        if s.tag == f"{P}grpSp":
            yield from _shapes(s)
        else:
            yield s


def _slide_text(body) -> str:
    # a vertical tab is a line break within a paragraph
    one = lambda p: "".join((x.text or "") if x.tag == f"{A}t" else "\x0b" for x in p.iter() if x.tag in (f"{A}t", f"{A}br"))
    return "\n".join(map(one, body.findall(f"{A}p")))


def pptx_blocks(files: DataFrame) -> DataFrame:
    """Tables and pictures of every slide of PPTX files, then its texts as one block; page is the slide, from 1.

    The slide's title is the heading of all of its blocks."""

    def read(path, content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            to = _targets(z, "ppt/presentation.xml")
            ids = ElementTree.fromstring(z.read("ppt/presentation.xml")).findall(f"{P}sldIdLst/{P}sldId")
            for page, member in enumerate((to[i.get(f"{R}id")] for i in ids), 1):
                tree, links = ElementTree.fromstring(z.read(member)).find(f"{P}cSld/{P}spTree"), _targets(z, member)
                title = ""
                for s in tree.findall(f"{P}sp"):
                    mark = s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    if mark is not None and mark.get("type") in ("title", "ctrTitle"):
                        title = _slide_text(s.find(f"{P}txBody")).strip() if s.find(f"{P}txBody") is not None else ""
                        break
                over, texts = [title] if title else [], []
                for s in _shapes(tree):
                    if s.tag == f"{P}sp" and s.find(f"{P}txBody") is not None:
                        texts.append(_slide_text(s.find(f"{P}txBody")).strip())
                    for t in s.iter(f"{A}tbl") if s.tag == f"{P}graphicFrame" else ():
                        rows = [[_slide_text(c.find(f"{A}txBody")).strip() if c.find(f"{A}txBody") is not None else "" for c in tr.findall(f"{A}tc")] for tr in t.findall(f"{A}tr")]
                        if rows:
                            yield page, "table", SLIDE_TABLE + json.dumps(rows, ensure_ascii=False), over, None
                    if s.tag == f"{P}pic":
                        blip = s.find(f"{P}blipFill/{A}blip")
                        yield page, "image", None, over, links.get(blip.get(f"{R}embed")) if blip is not None else None
                if any(texts):
                    yield page, "text", "\n".join(t for t in texts if t), over, None

    return _blocks(files, read)


# --- PDF --------------------------------------------------------------------------------------------------------------


def pdf_blocks(files: DataFrame, pages: Callable[[bytes], Iterable[tuple[str, int]]], engine: Callable[[bytes], Iterable[tuple[str, str]]] | None = None) -> DataFrame:
    """Blocks of PDF files by extractors that the caller brings, and pdf_kind: native, scanned or mixed.

    pages gives (text, pictures) of each page, from which the kind is told; engine, if there is one, gives (content_type,
    text) of whole files, and what it can't read falls back to pages. Pages with neither text nor engine give no block."""
    per_page = _blocks(files, lambda path, content: ((n, str(images), text, [], None) for n, (text, images) in enumerate(pages(content), 1)))
    faults = F.col("content_type") == "error"
    sampled = D.sample_pages(per_page.filter(~faults).select(F.col("path").alias("document_id"), "page", F.length(F.coalesce("text", F.lit(""))).alias("text_len"), F.col("content_type").try_cast("int").alias("image_count")))
    kinds = D.classify_pages(sampled).select(F.col("document_id").alias("path"), F.col("kind").alias("pdf_kind"))
    out = per_page.withColumn("content_type", F.when(faults, "error").otherwise("text")).filter("trim(text) != ''")
    if engine is not None:
        whole = _blocks(files, lambda path, content: ((None, kind, text, [], None) for kind, text in engine(content)))
        read = whole.groupBy("path").agg(F.max((F.col("content_type") == "error").cast("int")).alias("bad")).filter("bad = 0").select("path")
        out = whole.join(read, "path", "left_semi").unionByName(out.join(read, "path", "left_anti"))
    return out.join(kinds, "path", "left")


READERS = {"csv": csv_blocks, "xlsx": xlsx_blocks, "docx": docx_blocks, "pptx": pptx_blocks}


def file_blocks(files: DataFrame) -> DataFrame:
    """Blocks of all files, each by the reader of its extension; a file of none of these is a row of content_type "error"."""
    kind = D.parser_of(F.col("path"))
    out = None
    for name, reader in READERS.items():
        part = reader(files.filter(kind == name))
        out = part if out is None else out.unionByName(part)
    other = files.filter(kind.isNull() | ~kind.isin(*READERS)).select(
        "path", F.lit(0).alias("block_pos"), F.lit(None).cast("int").alias("page"), F.lit("error").alias("content_type"), F.concat(F.lit("no reader for "), F.coalesce(kind, F.lit("this extension"))).alias("text"), F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("string").alias("asset"))
    return out.unionByName(other)
