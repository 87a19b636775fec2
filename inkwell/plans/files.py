"""Queries of file readers: files are composed by rule from the tables, then read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import chunking as C
from ..operators import documents as D
from ..registry import query
from ..sources import files as R
from ..sources.tables import load
from .documents import LINES_SQL

#: Rows of a composed table file, so that no file grows with the table.
FILE_ROWS = 120
_MAIN = "http://schemas.openxmlformats.org/"
_LINK = f'xmlns:r="{_MAIN}officeDocument/2006/relationships"'
_WORD, _SHEET = f'xmlns:w="{_MAIN}wordprocessingml/2006/main"', f'xmlns="{_MAIN}spreadsheetml/2006/main"'
_SLIDE = f'xmlns:p="{_MAIN}presentationml/2006/main" xmlns:a="{_MAIN}drawingml/2006/main" {_LINK}'


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _rels(targets) -> str:
    return f'<Relationships xmlns="{_MAIN}package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def _files(df, ext: str, compose):
    """path and content of a file composed from each row's columns."""

    def run(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{r[0]}.{ext}" for r in rows], pa.string()), pa.array([compose(*r) for r in rows], pa.binary())], ["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


def _grouped(rows, key: str, order: str):
    """Rows of FILE_ROWS keys as one file: its number and its rows' cells in order."""
    k = F.floor(F.col(key) / FILE_ROWS).cast("long")
    g = rows.groupBy(k.alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("cells").alias("cells")))).alias("r"))
    return g.select("file", F.col("r.cells").alias("rows"))


def _text_groups_sql(rows: str, line: str, blank: int = 0) -> str:
    """SQL of the blocks of rows(file, k, ..); `blank` rows stand before the header."""
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) AS i FROM ({rows})) SELECT file || '.{{0}}' AS path, (i - 1) // 50 AS block_pos,
'{{1}}' || ' > 行 ' || (min(i) + {blank}) || '-' || (max(i) + {blank}) AS heading, string_agg({line}, chr(10) ORDER BY i) AS text FROM r GROUP BY file, (i - 1) // 50"""


_CUSTOMERS = f"SELECT c_custkey // {FILE_ROWS} AS file, c_custkey AS k, c_name, c_mktsegment FROM customer"


@query("csv_blocks", _text_groups_sql(_CUSTOMERS, "'key：' || k || '；name, \"full\"：' || c_name || '；' || CASE WHEN k % 5 = 0 THEN '' ELSE c_mktsegment END || '；more：'", 1).replace("'{1}'", "file").format("csv"))
def csv_blocks(spark, d):
    """Files with a byte order mark, a blank line before the header (it counts in row numbers), quoted cells, a nameless column and short rows."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    key = F.col("c_custkey")
    line = F.concat(key.cast("string"), F.lit(", "), F.col("c_name"), F.lit(","), q(F.when(key % 5 == 0, "").otherwise(F.col("c_mktsegment"))))
    g = _grouped(load(spark, d, "customer").select(key, F.array(line).alias("cells")), "c_custkey", "c_custkey")
    text = F.concat(F.lit('﻿\r\nkey,"name, ""full""",,more\r\n'), F.array_join(F.flatten("rows"), "\r\n"))
    blocks = R.csv_blocks(g.select(F.concat(F.col("file").cast("string"), F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content")))
    return blocks.select("path", "block_pos", F.array_join("heading_path", " > ").alias("heading"), "text")


def _xlsx(file, rows) -> bytes:
    """Names stand in the shared strings, the nation is merged over two rows, and every seventh row is followed by a blank one."""
    shared, out, merges, at = [], [], [], 2
    for i, (key, name, nation, balance) in enumerate(rows):
        shared.append(name)
        pair = i % 2 == 0
        cells = f'<c r="A{at}"><v>{key}</v></c><c r="B{at}" t="s"><v>{i}</v></c><c r="D{at}"><v>{balance}</v></c>'
        out.append(f'<row r="{at}">{cells}' + (f'<c r="C{at}" t="inlineStr"><is><t>{escape(nation)}</t></is></c>' if pair else "") + "</row>")
        if pair and i + 1 < len(rows) and i % 7 != 6:
            merges.append(f'<mergeCell ref="C{at}:C{at + 1}"/>')
        at += 2 if i % 7 == 6 else 1
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABCD", ("key", "name", "nation", "balance")))
    sheet = f'<worksheet {_SHEET}><sheetData><row r="1">{head}</row>{"".join(out)}</sheetData>' + (f"<mergeCells>{''.join(merges)}</mergeCells>" if merges else "") + "</worksheet>"
    return _zip({
        "xl/workbook.xml": f'<workbook {_SHEET} {_LINK}><sheets><sheet name="suppliers" sheetId="1" r:id="r0"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels(["worksheets/sheet1.xml"]),
        "xl/sharedStrings.xml": f"<sst {_SHEET}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>",
        "xl/worksheets/sheet1.xml": sheet,
    })


_SUPPLIERS = f"SELECT s_suppkey // {FILE_ROWS} AS file, s_suppkey AS k, s_name, s_nationkey, row_number() OVER (PARTITION BY s_suppkey // {FILE_ROWS} ORDER BY s_suppkey) - 1 AS j FROM supplier"
_NATIONS = f"SELECT *, CASE WHEN j % 2 = 0 THEN 'n' || s_nationkey WHEN j % 7 = 0 THEN '' ELSE lag('n' || s_nationkey) OVER (PARTITION BY file ORDER BY k) END AS nation FROM ({_SUPPLIERS})"


@query("xlsx_blocks", _text_groups_sql(_NATIONS, "'key：' || k || '；name：' || s_name || '；nation：' || nation || '；balance：' || (j * 3)").format("xlsx", "suppliers"))
def xlsx_blocks(spark, d):
    """Sheets with shared and inline texts, merged cells and blank rows."""
    cells = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    g = _grouped(load(spark, d, "supplier").select("s_suppkey", cells.alias("cells")), "s_suppkey", "s_suppkey")
    rows = F.transform("rows", lambda r, i: F.concat(r, F.array((i * 3).cast("string"))))
    return R.xlsx_blocks(_files(g.select("file", rows.alias("rows")), "xlsx", _xlsx)).select("path", "block_pos", F.array_join("heading_path", " > ").alias("heading"), "text")


def _docx(doc, text, source) -> bytes:
    """A document's first line is its title, every fifth line after the third a heading below it; a table at the end."""
    style = lambda i: "h1" if i == 0 else "h2" if i % 5 == 3 else ""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    paras = [f"<w:p>{f'<w:pPr><w:pStyle w:val="{style(i)}"/></w:pPr>' if style(i) else ''}{run(line)}</w:p>" for i, line in enumerate(text.split("\n"))]
    cell = lambda t, span=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr><w:p>{run(t)}</w:p></w:tc>'
    table = f"<w:tbl><w:tr>{cell('source')}{cell('id')}</w:tr><w:tr>{cell(source)}{cell(str(doc))}</w:tr><w:tr>{cell('end', 2)}</w:tr></w:tbl>"
    names = "".join(f'<w:style w:styleId="h{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2))
    return _zip({"word/document.xml": f"<w:document {_WORD}><w:body>{''.join(paras)}{table}</w:body></w:document>", "word/styles.xml": f"<w:styles {_WORD}>{names}</w:styles>", "word/media/image1.png": ""})


_BARE = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_H2 = f"last_value(CASE WHEN pos % 5 = 3 AND {_BARE} <> '' THEN {_BARE} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos)"
_DOCX_SQL = f"""WITH l AS (SELECT doc_id, source, pos, {_BARE} AS t, max(CASE WHEN pos = 0 THEN nullif({_BARE}, '') END) OVER (PARTITION BY doc_id) AS h1, {_H2} AS h2 FROM ({LINES_SQL})),
b AS (SELECT doc_id, pos, CASE WHEN pos = 0 OR pos % 5 = 3 THEN 'heading' ELSE 'text' END AS content_type, t AS text, concat_ws(' > ', h1, h2) AS heading, NULL::VARCHAR AS asset FROM l WHERE t <> ''
UNION ALL SELECT doc_id, 1000000000, 'table', 'Word 表格：' || chr(10) || '[["source", "id"], ["' || any_value(source) || '", "' || doc_id || '"], ["end", "end"]]', concat_ws(' > ', any_value(h1), max_by(h2, pos)), NULL FROM l GROUP BY doc_id
UNION ALL SELECT doc_id, 1000000001, 'image', NULL, '', 'word/media/image1.png' FROM documents)
SELECT doc_id || '.docx' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_pos, content_type, text, heading, asset FROM b"""


@query("docx_blocks", _DOCX_SQL)
def docx_blocks(spark, d):
    """Headings, paragraphs, a table with a cell over two columns, and a picture."""
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    return R.docx_blocks(_files(docs, "docx", _docx)).select("path", "block_pos", "content_type", "text", F.array_join("heading_path", " > ").alias("heading"), "asset")


def _pptx(doc, text, source) -> bytes:
    """A slide for every four lines: the first is the title, the others a shape, in a group on every second slide; a table on the first."""
    lines = text.split("\n")
    para = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    members, n = {}, 0
    for n in range(-(-len(lines) // 4)):
        title, *rest = lines[4 * n : 4 * n + 4]
        shape = f"<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:txBody>{''.join(map(para, rest))}</p:txBody></p:sp>"
        table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>{para(source)}</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>" if n == 0 else ""
        tree = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{para(title)}</p:txBody></p:sp>' + (f"<p:grpSp>{shape}</p:grpSp>" if n % 2 else shape) + table
        members[f"ppt/slides/slide{n}.xml"] = f"<p:sld {_SLIDE}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(n + 1))
    deck = {"ppt/presentation.xml": f"<p:presentation {_SLIDE}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _rels(f"slides/slide{i}.xml" for i in range(n + 1))}
    return _zip(deck | members)


_PPTX_SQL = f"""WITH l AS (SELECT doc_id, source, pos // 4 AS s, pos, line FROM ({LINES_SQL})),
p AS (SELECT doc_id, s, any_value(source) AS source, coalesce(min({_BARE}) FILTER (pos % 4 = 0), '') AS title, coalesce(trim(string_agg(line, chr(10) ORDER BY pos) FILTER (pos % 4 > 0), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS rest FROM l GROUP BY doc_id, s),
b AS (SELECT doc_id, s, 0 AS o, 'table' AS content_type, 'PPT 表格：' || chr(10) || '[["' || source || '"]]' AS text, title AS heading FROM p WHERE s = 0
UNION ALL SELECT doc_id, s, 1, 'text', concat_ws(chr(10), nullif(title, ''), nullif(rest, '')), title FROM p WHERE title <> '' OR rest <> '')
SELECT doc_id || '.pptx' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY s, o) - 1 AS block_pos, s + 1 AS page, content_type, text, heading FROM b"""


@query("pptx_blocks", _PPTX_SQL)
def pptx_blocks(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    return R.pptx_blocks(_files(docs, "pptx", _pptx)).select("path", "block_pos", "page", "content_type", "text", F.array_join("heading_path", " > ").alias("heading"))


_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"


@query("url_ingest", f"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'http://' || CASE page_id % 3 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.168.1.' ELSE '127.0.0.' END || page_id % 250 || '/a.b.html' WHEN 2 THEN 'ftp://x.org/f' ELSE url END AS url FROM pages),
p AS (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1), '/+$', '') AS path, regexp_extract(url, '^[a-z]+://([^/?#.]*)', 1) AS host FROM u)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'local' WHEN 2 THEN 'scheme' END AS fault, left(regexp_replace(coalesce(nullif({_STEM}, ''), host), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 100) || '.html' AS filename FROM p""")
def url_ingest(spark, d):
    """Pages that may be fetched and their names; local hosts and other schemes take the place of some."""
    k = F.col("page_id")
    host = F.when(k % 3 == 0, "10.0.0.").when(k % 3 == 1, "192.168.1.").otherwise("127.0.0.")
    url = F.when(k % 5 == 1, F.concat(F.lit("http://"), host, (k % 250).cast("string"), F.lit("/a.b.html"))).when(k % 5 == 2, "ftp://x.org/f").otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", T.url_fault(url).alias("fault"), T.url_file(url).alias("filename"))


_TOPIC = "substr(trim(regexp_replace(regexp_replace({0}, '^#+\\s*', ''), '[\\[\\]【】]', '', 'g')), 1, 80)"


@query("topic_inference", f"""WITH l AS (SELECT doc_id, pos, {_BARE} AS t FROM ({LINES_SQL}) WHERE doc_id % 4 < 3), f AS (SELECT doc_id, min_by(t, pos) AS t FROM l WHERE length(t) >= 2 GROUP BY doc_id), h AS (SELECT doc_id, min_by(t, pos) AS t FROM l WHERE length(t) >= 2 AND pos > 0 GROUP BY doc_id)
SELECT d.doc_id, trim(CASE WHEN d.doc_id % 4 = 0 AND h.t IS NOT NULL THEN {_TOPIC.format('h.t')} WHEN d.doc_id % 4 = 1 THEN 'A path' WHEN d.doc_id % 4 < 3 AND f.t IS NOT NULL THEN {_TOPIC.format('f.t')} ELSE 'file.' || d.doc_id END) AS topic_label
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id""")
def topic_inference(spark, d):
    """Lines as blocks: headings after the first line, entries of a heading path, plain lines, and documents without blocks."""
    k = F.col("doc_id") % 4
    docs = load(spark, d, "documents")
    lines = docs.filter(k < 3).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = (k == 0) & (F.col("pos") > 0)
    blocks = lines.select(F.col("doc_id").alias("document_id"), F.col("pos").alias("block_pos"), F.when(heading, "heading").otherwise("text").alias("content_type"), F.when(k == 1, F.array(F.lit("x"), F.lit("## [A] path"))).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.when(heading, F.concat(F.lit(" "), F.col("line"))).otherwise(F.col("line")).alias("text"))
    files = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("dir/file."), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"))
    return D.topics(blocks, files).select(F.col("document_id").alias("doc_id"), "topic_label")


@query("metadata_stamp", """SELECT doc_id, 'f' || doc_id || '.md' AS filename, source AS topic_label, CASE WHEN doc_id % 3 = 0 THEN 'http://x/' || doc_id WHEN doc_id % 3 = 1 THEN 'old' END AS source_url, 'k' AS kept, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id ELSE text END AS search_text FROM documents""")
def metadata_stamp(spark, d):
    """The file's name, topic and address in each block's metadata; an empty address leaves what was there. Then what is indexed."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    held = {"kept": F.lit("k"), "filename": F.lit("old"), "source_url": F.when(k % 3 != 2, "old"), "search_text": F.when(k % 2 == 0, F.concat(F.lit("s"), s)).otherwise("")}
    meta = F.map_filter(F.create_map(*[x for n, v in held.items() for x in (F.lit(n), v)]), lambda n, v: v.isNotNull())
    docs = load(spark, d, "documents")
    blocks = docs.select(k.alias("document_id"), F.col("text").alias("content"), meta.alias("metadata"))
    files = docs.select(k.alias("document_id"), F.concat(F.lit("f"), s, F.lit(".md")).alias("filename"), F.col("source").alias("topic_label"), F.when(k % 3 == 0, F.concat(F.lit("http://x/"), s)).otherwise("").alias("source_url"))
    m = F.col("metadata")
    return D.stamped(blocks, files).select(F.col("document_id").alias("doc_id"), *[m[n].alias(n) for n in ("filename", "topic_label", "source_url", "kept")], D.search_text().alias("search_text"))


@query("registry_update", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE source END AS source, lang, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def registry_update(spark, d):
    """Changes of an allowed column, of one that isn't allowed, and of one that records lack."""
    changes = load(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"), F.lit("xx").alias("lang"), F.lit(1).alias("unknown"))
    return D.updated(load(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), changes, "doc_id", ("source", "unknown"))


_STATES = "SELECT event_id, user_id AS document_id, CASE event_id % 5 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SUCCEEDED' WHEN 3 THEN 'PENDING' ELSE 'PARSING' END AS status FROM events"


@query("terminal_cleanup", f"SELECT event_id, document_id, status FROM ({_STATES}) WHERE NOT (event_id % 5 < 3 AND document_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
def terminal_cleanup(spark, d):
    """Tasks that ended go once their document is approved anew."""
    states = F.array(*map(F.lit, ("REJECTED", "FAILED", "SUCCEEDED", "PENDING", "PARSING")))
    tasks = load(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), F.get(states, (F.col("event_id") % 5).cast("int")).alias("status"))
    return D.without_terminal(tasks, load(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))).select("event_id", "document_id", "status")


@query("catalog_files", """SELECT doc_id, document_id, filename, source_type, legacy FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id ELSE 'r' || doc_id END AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.md' END ELSE 'Name ' || doc_id END AS filename, CASE WHEN doc_id % 3 = 1 THEN 'html' WHEN doc_id % 2 = 0 THEN 'PDF' ELSE 'md' END AS source_type, doc_id % 3 = 0 AS legacy FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0)""")
def catalog_files(spark, d):
    """PDF files, registered or not; registered ones without a file are left out."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    path = F.concat(F.lit("up/f"), s, F.when(k % 2 == 0, ".PDF").otherwise(".md"))
    docs = load(spark, d, "documents")
    files = docs.filter(k % 7 != 0).select(path.alias("path"), F.col("n_chars").alias("size"))
    known = docs.filter(k % 3 != 0).select(F.concat(F.lit("r"), s).alias("document_id"), F.concat(F.lit("Name "), s).alias("filename"), path.alias("source_path"), F.when(k % 3 == 1, "html").alias("source_type"))
    return D.catalog(known, files, (".pdf",)).select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("doc_id"), "document_id", "filename", "source_type", "legacy")


@query("rebuild_html", """SELECT doc_id AS document_id, CASE WHEN doc_id % 9 = 4 THEN 'new' ELSE 'old' END AS version, n_chars FROM documents""")
def rebuild_html(spark, d):
    """Stored blocks of HTML documents are replaced by new ones; the others stay."""
    docs = load(spark, d, "documents").withColumn("filename", F.when(F.col("doc_id") % 9 == 4, F.when(F.col("doc_id") % 2 == 0, "a.HTML").otherwise("b.htm")).otherwise("c.html.md"))
    row = lambda version, df: df.select(F.col("doc_id").alias("document_id"), F.lit(version).alias("version"), "n_chars")
    return D.reindex(row("old", docs), row("new", docs.filter(F.lower("filename").rlike(r"\.html?$"))))


@query("document_furniture", """WITH b AS (SELECT doc_id % 40 AS document_id, source AS source_type, unnest(string_split(text, chr(10))) AS line, doc_id FROM documents), n AS (SELECT doc_id % 40 AS document_id, source AS source_type, count(*) AS n_blocks FROM documents GROUP BY ALL HAVING count(*) >= 3)
SELECT document_id, source_type, line, count(*) AS n FROM (SELECT document_id, source_type, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM b UNION ALL SELECT doc_id % 40, source, 'Page head ' || doc_id % 40 FROM documents) x JOIN n USING (document_id, source_type) WHERE line <> '' AND length(line) <= 60 GROUP BY document_id, source_type, line, n_blocks HAVING count(*) >= greatest(2, floor(0.6 * n_blocks))""")
def document_furniture(spark, d):
    """Lines that stand on most pages of a document: every fortieth row is a page of one."""
    k = F.col("doc_id") % 40
    pages = load(spark, d, "documents").select(k.alias("document_id"), F.col("source").alias("source_type"), F.concat(F.lit("Page head "), k.cast("string"), F.lit(" \n"), F.col("text")).alias("text"))
    return D.frequent_lines(pages, by=("document_id", "source_type")).select("document_id", "source_type", "line", "n")


_HEAD = f"(pos % 6 = 3 AND {_BARE} <> '')"
_MD_SQL = f"""WITH l AS (SELECT doc_id, pos, line, {_BARE} AS t, {_HEAD} AS h, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM ({LINES_SQL})),
s AS (SELECT doc_id, sec, max(t) FILTER (h) AS h2, trim(string_agg(CASE WHEN NOT h THEN line END, chr(10) || chr(10) ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM l GROUP BY doc_id, sec),
p AS (SELECT *, concat_ws(' > ', 'Title ' || doc_id, h2) AS heading FROM s), z AS (SELECT doc_id, max_by(heading, sec) AS heading FROM p GROUP BY doc_id),
b AS (SELECT doc_id, -1 AS sec, 0 AS o, 'heading' AS content_type, 'Title ' || doc_id AS text, 'Title ' || doc_id AS heading FROM z UNION ALL SELECT doc_id, sec, 0, 'heading', h2, heading FROM p WHERE h2 IS NOT NULL UNION ALL SELECT doc_id, sec, 1, 'text', body, heading FROM p WHERE body <> ''
UNION ALL SELECT doc_id, 1000000000, 0, 'code', 'x = ' || doc_id || chr(10) || chr(10) || '# no heading', heading FROM z UNION ALL SELECT doc_id, 1000000000, 1, 'table', '| a | b |' || chr(10) || '|---|:---:|' || chr(10) || '| 1 | ' || doc_id || ' |', heading FROM z UNION ALL SELECT doc_id, 1000000000, 2, 'text', '| a | b |' || chr(10) || '| - | - |', heading FROM z)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, o) - 1 AS block_pos, content_type, text, heading FROM b"""


@query("markdown_parse", _MD_SQL)
def markdown_parse(spark, d):
    """Documents as Markdown: a title, every sixth line after the fourth a heading below it, blank lines within texts, code
    with what looks like a heading, a table, and lines that only look like one."""
    parts = F.transform(F.split("text", "\n"), lambda line, i: F.when((i % 6 == 3) & (T.strip(line) != ""), F.concat(F.lit("## "), line)).otherwise(F.concat(line, F.lit("\n"))))
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Title "), n, F.lit("\n"), F.array_join(parts, "\n"), F.lit("\n```py\nx = "), n, F.lit("\n\n# no heading\n```\n | a | b |\n|---|:---:|\n| 1 | "), n, F.lit(" |\n\n| a | b |\n| - | - |"))
    return C.md_blocks(load(spark, d, "documents").select("doc_id", text.alias("text")))


_LINE = "trim(replace(text, chr(10), ' '))"


@query("table_functions", f"""WITH w AS (SELECT doc_id, {_LINE} AS t, unnest(range(0, CASE WHEN length({_LINE}) <= 500 THEN 1 ELSE CAST(ceil((length({_LINE}) - 80) / 420.0) AS BIGINT) END)) AS k FROM documents), c AS (SELECT doc_id, k, trim(substr(t, 1 + 420 * k, 500)) AS chunk FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, chunk FROM c WHERE length(chunk) >= 50""")
def table_functions(spark, d):
    """Chunks by a table function of SQL; texts are put on one line, so that the chunks are plain windows."""
    tables.register(spark)
    docs = load(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return spark.sql("SELECT d.doc_id, c.pos, c.chunk FROM {docs} d, LATERAL chunk_text(d.text, 'fixed') c", docs=docs)
