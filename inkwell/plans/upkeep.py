"""Queries of order within tables and of tables that are kept up: sections, page attribution, publishing, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import ordered as O
from ..registry import query
from ..sources import jsonl
from ..sources.published import Published
from ..sources.store import fingerprint, shared_dir
from ..sources.tables import load
from .documents import _TRIM, LINES_SQL, _lines

# Lines whose length is divisible by three are headings, of a level by their length.
_LEVEL = "CASE WHEN length(line) > 0 AND length(line) % 3 = 0 THEN 1 + (length(line) % 5) END"


@query("section_paths", f"""WITH l AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, line, {_LEVEL} AS lv FROM ({LINES_SQL})),
h AS (SELECT doc_id, pos, lv, line FROM l WHERE lv IS NOT NULL),
e AS (SELECT h.doc_id, h.pos, any_value(h.lv) AS lv, any_value(h.line) AS line, min(r.pos) FILTER (r.lv <= h.lv) AS until FROM h LEFT JOIN h r ON r.doc_id = h.doc_id AND r.pos > h.pos GROUP BY h.doc_id, h.pos),
p AS (SELECT h.doc_id, h.pos, any_value(h.lv) AS lv, string_agg(e.line, ' > ' ORDER BY e.pos) AS path FROM h JOIN e ON e.doc_id = h.doc_id AND e.pos <= h.pos AND (e.until IS NULL OR h.pos < e.until) GROUP BY h.doc_id, h.pos),
s AS (SELECT l.*, count(lv) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l),
g AS (SELECT doc_id, section, min(pos) FILTER (lv IS NOT NULL) AS pos, count(*) FILTER (lv IS NULL) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (lv IS NULL), '') AS text FROM s GROUP BY doc_id, section)
SELECT g.doc_id AS document_id, g.section, CAST(p.lv AS BIGINT) AS heading_level, coalesce(p.path, '') AS heading_path, g.n_lines, g.text FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.pos = g.pos""")
def section_paths(spark, d):
    """Sections of all documents with the headings they stand under."""
    rows = _lines(spark, d).select(F.col("doc_id").alias("document_id"), "pos", "line", F.expr(_LEVEL).alias("level"))
    return O.sections(rows, order="pos", title="line").withColumn("heading_path", F.array_join("heading_path", " > "))


# Sentences with all that lies between them; chunks of five; pages of 700 to 1100 characters, some texts longer than their
# pages, some pages without a number.
_PIECES = r"[^。！？.!?\n]*[。！？.!?\n]+|[^。！？.!?\n]+"
_WIDTH, _PAGES = "(700 + (doc_id % 5) * 100)", "CAST(length(text) / (700 + (doc_id % 5) * 100) AS INT) + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END"


@query("chunk_pages", f"""WITH s AS (SELECT doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS t FROM (SELECT doc_id, regexp_extract_all(text, '{_PIECES}') AS x FROM documents)),
o AS (SELECT doc_id, k, (k - 1) // 5 AS chunk_pos, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
p AS (SELECT doc_id, i, (i + 1) * {_WIDTH} AS e, CASE WHEN doc_id % 6 = 0 AND i = 0 THEN NULL ELSE 2 * i + 1 END AS page FROM (SELECT doc_id, unnest(range(CAST(floor(length(text) / {_WIDTH}) AS BIGINT) + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END)) AS i FROM documents)),
f AS (SELECT o.doc_id, o.k, any_value(o.chunk_pos) AS chunk_pos, coalesce(min(p.i) FILTER (p.e > o.a), max(p.i)) AS i FROM o LEFT JOIN p ON p.doc_id = o.doc_id GROUP BY o.doc_id, o.k)
SELECT f.doc_id AS document_id, CAST(f.chunk_pos AS BIGINT) AS chunk_pos, coalesce(min(p.page), f.doc_id % 3) AS page_start, coalesce(max(p.page), f.doc_id % 3) AS page_end FROM f LEFT JOIN p ON p.doc_id = f.doc_id AND p.i = f.i GROUP BY f.doc_id, f.chunk_pos""")
def chunk_pages(spark, d):
    docs = load(spark, d, "documents")
    pieces = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.regexp_extract_all("text", F.lit(f"({_PIECES})"), F.lit(0))).alias("sent_pos", "t"))
    w = O.Window.partitionBy("document_id").orderBy("sent_pos").rowsBetween(O.Window.unboundedPreceding, -1)
    s = pieces.select("document_id", "sent_pos", F.length("t").alias("n_chars")).withColumn("start", F.coalesce(F.sum("n_chars").over(w), F.lit(0)))
    chunks = s.groupBy("document_id", F.expr("sent_pos div 5").alias("chunk_pos")).agg(F.sum("n_chars").alias("n_chars")).withColumn("fallback_page", F.col("document_id") % 3)
    n = docs.select(F.col("doc_id").alias("document_id"), F.expr(_WIDTH).alias("width"), F.expr(_PAGES).alias("n")).filter("n > 0")
    p = n.select("document_id", "width", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_pos"))
    page = F.when((F.col("document_id") % 6 == 0) & (F.col("page_pos") == 0), None).otherwise(2 * F.col("page_pos") + 1)
    return O.chunk_pages(chunks, s, p.select("document_id", "page_pos", ((F.col("page_pos") + 1) * F.col("width")).alias("end"), page.alias("page")))


# Blocks of layout objects made from lines, by position: one of each type, furniture that is dropped, tables with inner blocks.
_KINDS = ("title", "text", "list", "table", "image", "interline_equation", "header", "code")


@query("layout_json_tree", f"""WITH b AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(CASE pos % 8 WHEN 3 THEN '<td>' || line || '</td>' ELSE line END, {_TRIM}) AS text,
CASE pos % 8 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'table' WHEN 4 THEN 'image' WHEN 5 THEN 'formula' WHEN 7 THEN 'code' END AS content_type FROM ({LINES_SQL}))
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_pos, pos // 20 + 1 AS page_number, content_type, text FROM b WHERE content_type IS NOT NULL AND (text <> '' OR content_type = 'image')""")
def layout_json_tree(spark, d):
    """Layout JSON of all documents, written from their lines, read by the operator: types, inner blocks, spans, pages."""
    m, half = F.col("pos") % 8, F.floor(F.length("line") / 2).cast("int")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (m + 1).cast("int"))
    span = lambda c, name: F.struct(F.lit("text").alias("type"), c.alias(name))
    halves = F.struct(F.array(span(F.substring("line", 1, half), "content"), span(F.substring("line", half + 1, F.length("line")), "content")).alias("spans"))
    body = F.struct(F.lit("table_body").alias("type"), F.array(F.struct(F.array(span(F.concat(F.lit("<td>"), "line", F.lit("</td>")), "html")).alias("spans"))).alias("lines"))
    block = F.struct(kind.alias("type"), F.when(m != 3, F.array(halves)).alias("lines"), F.when(m == 3, F.array(body)).alias("blocks"))
    pages = _lines(spark, d).withColumn("page", F.expr("pos div 20")).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("x"))
    page = F.struct("page", F.struct(F.col("page").alias("page_idx"), F.transform("x", lambda e: e["b"]).alias("para_blocks")).alias("p"))
    docs = pages.groupBy(F.col("doc_id").alias("document_id")).agg(F.array_sort(F.collect_list(page)).alias("y"))
    return L.layout_blocks(docs.select("document_id", F.to_json(F.struct(F.transform("y", lambda e: e["p"]).alias("pdf_info"))).alias("json"))).drop("bbox")


@query("neighbour_gaps", "SELECT o_orderkey * 3 + o_orderkey % 2 AS place, round(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS change, o_custkey IS NOT DISTINCT FROM lag(o_custkey) OVER (ORDER BY o_orderkey) AND o_orderkey > (SELECT min(o_orderkey) FROM orders) AS same_customer FROM orders")
def neighbour_gaps(spark, d):
    """Each order against the one before, by a number that has gaps."""
    o = load(spark, d, "orders").select((F.col("o_orderkey") * 3 + F.col("o_orderkey") % 2).alias("place"), "o_totalprice", "o_custkey")
    p = O.previous(o, "place", ["o_totalprice", "o_custkey"], span=512)
    return p.select("place", F.round(F.col("o_totalprice") - F.col("prev_o_totalprice"), 2).alias("change"), F.coalesce(F.col("o_custkey") == F.col("prev_o_custkey"), F.lit(False)).alias("same_customer"))


def _blocks_of(spark, d):
    return _lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("pos").cast("long").alias("block_pos"), F.col("line").alias("text"))


def _table(spark, d, name):
    """A table under the shared folder that belongs to the documents as they are now."""
    return Published(spark, f"{shared_dir(spark)}/published/{name}-v1/{fingerprint(spark, f'{d}/documents.parquet')}")


@query("verified_migration", f"SELECT doc_id AS document_id, source AS collection, count(*) AS n_blocks, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({LINES_SQL}) GROUP BY ALL")
def verified_migration(spark, d):
    """Collections by source become one table, which counts that are not taken from the copied rows must bear out."""
    out = _table(spark, d, "migration")
    if not out.manifest()[0]:
        rows = _lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("collection"), F.col("pos").cast("long").alias("block_pos"), F.col("line").alias("text"))
        expected = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.size(F.split("text", "\n")).cast("long").alias("n"))
        out.publish(rows, expected)
    return out.read().groupBy("document_id", "collection").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query("stale_rebuild", f"SELECT doc_id AS document_id, count(*) AS n_blocks, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({LINES_SQL}) GROUP BY doc_id")
def stale_rebuild(spark, d):
    """A table in which every fifth document lacks its last block and every eleventh stands not at all is brought up to its
    documents; only buckets with such a document are written."""
    out, fresh = _table(spark, d, "rebuild"), _blocks_of(spark, d)
    if not out.manifest()[0]:
        last = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.size(F.split("text", "\n")) - 1).alias("last"))
        torn = fresh.join(last, "document_id").filter("document_id % 11 != 0 and not (document_id % 5 = 0 and block_pos = last)").drop("last")
        out.publish(torn, out.counts(torn))
    out.sync(fresh)
    return out.read().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query("jsonl_quarantine", """SELECT item_id, array_to_string(CASE WHEN item_id % 7 = 0 THEN ['not_json'] ELSE list_filter([CASE WHEN item_id % 9 = 0 THEN 'no_id' END, CASE WHEN item_id % 4 = 0 THEN 'blank_question' END, CASE WHEN item_id % 5 = 0 THEN 'few_documents' END, CASE WHEN item_id % 5 = 1 THEN 'repeated_documents' END,
CASE WHEN item_id % 9 <> 0 AND count(*) FILTER (item_id % 7 <> 0 AND item_id % 9 <> 0) OVER (PARTITION BY item_id // 2 + CASE WHEN item_id % 10 < 4 THEN 0 ELSE 1000000000 * (1 + item_id % 2) END) > 1 THEN 'duplicate_id' END], lambda x: x IS NOT NULL) END, ',') AS faults FROM benchmark""")
def jsonl_quarantine(spark, d):
    """Question lines with faults put in by rule: torn objects, missing and repeated ids, blank questions, too few documents."""
    i = F.col("item_id")
    key = F.expr("CASE WHEN item_id % 9 <> 0 THEN concat('q', item_id div 2 + CASE WHEN item_id % 10 < 4 THEN 0 ELSE 1000000000 * (1 + item_id % 2) END) END")
    documents = F.when(i % 5 == 0, F.array(F.lit("a"))).when(i % 5 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    whole = F.to_json(F.struct(key.alias("id"), F.when(i % 4 == 0, " ").otherwise(F.col("text")).alias("question"), documents.alias("documents")))
    lines = load(spark, d, "benchmark").select("item_id", F.when(i % 7 == 0, F.substring(whole, 1, F.length(whole) - 2)).otherwise(whole).alias("value"))
    found = jsonl.examined(lines, "id string, question string, documents array<string>", filled=("question",), at_least={"documents": 2})
    return found.select("item_id", F.array_join("faults", ",").alias("faults"))


_CHANGES = ("CASE WHEN event_id % 3 <> 0 THEN event_type END", "CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) END", "event_type <> 'view'")


@query("profile_versions", f"""WITH c AS (SELECT user_id, event_id, {_CHANGES[0]} AS style, {_CHANGES[1]} AS score, {_CHANGES[2]} AS bump FROM events)
SELECT user_id, 1 + coalesce(sum(CAST(bump AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT - CAST(first_value(bump) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version,
last_value(style IGNORE NULLS) OVER w AS style, last_value(score IGNORE NULLS) OVER w AS score, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM c
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def profile_versions(spark, d):
    """Versions of users' records from two batches, the second of which brings the first one's changes again."""
    c = load(spark, d, "events").select("user_id", "event_id", F.expr(_CHANGES[0]).alias("style"), F.expr(_CHANGES[1]).alias("score"), F.expr(_CHANGES[2]).alias("bump"))
    middle = c.agg(F.avg("event_id")).first()[0] or 0
    first = O.merged_versions(None, c.filter(F.col("event_id") < middle), ["style", "score"], order="event_id")
    return O.merged_versions(first, c, ["style", "score"], order="event_id")
