"""Queries of sources, parsing, cleaning and cataloguing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import documents as D
from ..registry import query
from ..sources.tables import load

LINES_SQL = "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lines(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_EXT = "CASE doc_id % 9 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.html' WHEN 5 THEN '.csv' WHEN 6 THEN '.xlsx' WHEN 7 THEN '.png' ELSE '.zip' END"


def _ext():
    e = F.lit(".zip")
    for k, x in enumerate((".md", ".TXT", ".pdf", ".docx", ".html", ".csv", ".xlsx", ".png")):
        e = F.when(F.col("doc_id") % 9 == k, x).otherwise(e)
    return e


@query("parser_dispatch", f"SELECT doc_id, source || '/' || doc_id || {_EXT} AS path, CASE doc_id % 9 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'html' WHEN 5 THEN 'csv' WHEN 6 THEN 'xlsx' WHEN 7 THEN 'image' END AS parser FROM documents")
def parser_dispatch(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), _ext())
    return load(spark, d, "documents").select("doc_id", path.alias("path"), D.parser_of(path).alias("parser"))


@query("text_blocks", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_pos, trim(line, {_TRIM}) AS text FROM ({LINES_SQL}) WHERE trim(line, {_TRIM}) <> ''")
def text_blocks(spark, d):
    """At single line feeds, since these documents have no blank lines."""
    return D.text_blocks(load(spark, d, "documents"), "\n")


@query("md_blocks")
def md_blocks(spark, d):
    return C.md_blocks(load(spark, d, "documents"))


@query("html_blocks")
def html_blocks(spark, d):
    return C.html_blocks(load(spark, d, "pages"))


@query("md_sections", f"WITH l AS (SELECT doc_id, pos, line, line SIMILAR TO '[A-Z][a-z]+ .*' AND length(line) % 3 = 0 AS h FROM ({LINES_SQL})), s AS (SELECT *, sum(CAST(h AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, first(line ORDER BY pos) FILTER (h) AS title, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, section")
def md_sections(spark, d):
    """The heading of a section runs on to the next. Lines of a length divisible by three serve as headings here."""
    head = F.col("line").rlike("^[A-Z][a-z]+ .*$") & (F.length("line") % 3 == 0)
    marked = _lines(spark, d).withColumn("line", F.when(head, F.concat(F.lit("# "), "line")).otherwise(F.col("line")))
    s = C.sections(marked, heading=r"^# ")
    return s.select("doc_id", "section", F.regexp_replace("title", "^# ", "").alias("title"), "n_lines", F.regexp_replace("text", r"(?m)^# ", "").alias("text"))


@query("table_to_markdown", "SELECT n_nationkey::BIGINT AS n_nationkey, '| ' || concat_ws(' | ', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)) || ' |' AS row_md FROM nation")
def table_to_markdown(spark, d):
    cells = F.array(*[F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")])
    return load(spark, d, "nation").select("n_nationkey", D.markdown_table(["n_nationkey", "n_name", "n_regionkey"], cells).alias("row_md"))


@query("tabular_row_groups", """WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, * FROM part) SELECT (rn - 1) // 50 AS "group", count(*) AS n_rows, string_agg(concat_ws('；', 'partkey：' || p_partkey, 'name：' || nullif(p_name, ''), 'brand：' || nullif(p_brand, ''), 'size：' || p_size), chr(10) ORDER BY rn) AS text FROM r GROUP BY ALL""")
def tabular_row_groups(spark, d):
    """Row numbers from the key: a count per range of keys, and its running sum, in place of one task's numbering."""
    p = load(spark, d, "part").select("p_partkey", F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string")).alias("cells"))
    span = F.floor(F.col("p_partkey") / 4096)
    per = p.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rn = F.col("before") + F.row_number().over(Window.partitionBy("span").orderBy("p_partkey"))
    return D.row_groups(p.withColumn("span", span).join(before, "span").withColumn("rn", rn), "rn", ["partkey", "name", "brand", "size"])


@query("normalize_rows", f"WITH w AS (SELECT doc_id, pos, string_split(line, ' ') AS c FROM ({LINES_SQL})) SELECT doc_id, pos, array_to_string(list_resize(c, 4, ''), '|') AS cells FROM w")
def normalize_rows(spark, d):
    return _lines(spark, d).select("doc_id", "pos", F.array_join(D.normalized_row(F.split("line", " "), 4), "|").alias("cells"))


# A document's lines stand for pages, its words for characters of a page, marks for pictures.
_PAGES = f"pg AS (SELECT doc_id AS document_id, pos + 1 AS page, CASE WHEN pos % 4 = 3 THEN length(line) % 25 ELSE length(line) END AS text_len, (length(line) * (doc_id % 3)) % 2 AS image_count FROM ({LINES_SQL}))"
_SAMPLED = f"{_PAGES}, n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY ALL), i AS (SELECT document_id, n, unnest(range(least(n, 10))) AS i FROM n), w AS (SELECT DISTINCT document_id, CASE WHEN n <= 10 THEN i + 1 ELSE CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT) + 1 END AS page FROM i), sp AS (SELECT pg.* FROM pg JOIN w USING (document_id, page))"


def _pages(spark, d):
    n = F.length("line")
    return _lines(spark, d).select(F.col("doc_id").alias("document_id"), (F.col("pos") + 1).alias("page"), F.when(F.col("pos") % 4 == 3, n % 25).otherwise(n).alias("text_len"), ((n * (F.col("doc_id") % 3)) % 2).alias("image_count"))


@query("pdf_sample_pages", f"WITH {_SAMPLED} SELECT document_id, page, text_len, image_count FROM sp")
def pdf_sample_pages(spark, d):
    return D.sample_pages(_pages(spark, d)).select("document_id", "page", "text_len", "image_count")


@query("pdf_classify", f"WITH {_SAMPLED}, a AS (SELECT document_id, count(*) AS n, CAST(sum(text_len) AS BIGINT) AS chars, avg(CAST(text_len >= 20 AS DOUBLE)) AS r, avg(image_count) AS im FROM sp GROUP BY ALL) SELECT document_id, n, chars, CASE WHEN chars < 5 * n OR r <= 0.25 THEN 'scanned' WHEN r = 1 AND im < 0.5 THEN 'native' ELSE 'mixed' END AS kind FROM a")
def pdf_classify(spark, d):
    return D.classify_pages(D.sample_pages(_pages(spark, d))).select("document_id", "n", "chars", "kind")


# Lines with a geometry by rule.
_GEO = f"geo AS (SELECT doc_id AS document_id, pos AS line_pos, line AS text, CASE WHEN (doc_id + pos * 5) % 7 = 0 THEN 16.0 WHEN (doc_id + pos * 5) % 7 = 1 THEN 13.0 ELSE 10.0 END::DOUBLE AS size, (doc_id + pos) % 9 = 0 AS bold, pos * 14.0::DOUBLE + (pos // 3) * 8.0::DOUBLE AS top, pos * 14.0::DOUBLE + (pos // 3) * 8.0::DOUBLE + 10.0::DOUBLE AS bottom, (pos % 2) * 50.0::DOUBLE AS x0, (pos % 2) * 50.0::DOUBLE + length(line) % 90 AS x1, pos // 20 AS page FROM ({LINES_SQL}))"


def _geometry(spark, d):
    m = (F.col("doc_id") + F.col("pos") * 5) % 7
    top = F.col("pos") * 14.0 + F.floor(F.col("pos") / 3) * 8.0
    x0 = (F.col("pos") % 2) * 50.0
    return _lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("pos").alias("line_pos"), F.col("line").alias("text"), F.when(m == 0, 16.0).when(m == 1, 13.0).otherwise(10.0).alias("size"), ((F.col("doc_id") + F.col("pos")) % 9 == 0).alias("bold"), top.alias("top"), (top + 10.0).alias("bottom"), x0.alias("x0"), (x0 + F.length("line") % 90).alias("x1"), F.floor(F.col("pos") / 20).alias("page"))


@query("pdf_headings", f"WITH {_GEO}, m AS (SELECT document_id, median(size) AS m FROM geo GROUP BY ALL), b AS (SELECT document_id, median(size) AS body FROM geo JOIN m USING (document_id) WHERE size <= 1.3 * m GROUP BY ALL) SELECT document_id, line_pos, size, dense_rank() OVER (PARTITION BY document_id ORDER BY size DESC) AS level FROM geo JOIN b USING (document_id) WHERE (size >= 1.15 * body AND size >= body + 1) OR (bold AND size >= body)")
def pdf_headings(spark, d):
    return D.headings(_geometry(spark, d)).select("document_id", "line_pos", "size", "level")


@query("bbox_anti_join", f"WITH {_GEO}, t AS (SELECT document_id, page, min(x0) AS x0, min(top) AS top, max(x1) AS x1, min(bottom) + 30 AS bottom FROM geo GROUP BY ALL) SELECT document_id, line_pos, page FROM geo a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.document_id = b.document_id AND a.page = b.page AND a.x0 >= b.x0 - 2 AND a.x1 <= b.x1 + 2 AND a.top >= b.top - 2 AND a.bottom <= b.bottom + 2)")
def bbox_anti_join(spark, d):
    """Lines outside the table region of their page; a page's first lines serve as one."""
    g = _geometry(spark, d)
    t = g.groupBy("document_id", "page").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), (F.min("bottom") + 30).alias("bottom"))
    return D.outside(g, t, ("document_id", "page")).select("document_id", "line_pos", "page")


@query("paragraph_gaps", f"WITH {_GEO}, h AS (SELECT document_id, median(bottom - top) AS h FROM geo GROUP BY ALL), n AS (SELECT geo.*, CASE WHEN top - lag(bottom) OVER (PARTITION BY document_id ORDER BY line_pos) > greatest(0.5 * h, 2.0) THEN 1 ELSE 0 END AS nw FROM geo JOIN h USING (document_id)), p AS (SELECT *, sum(nw) OVER (PARTITION BY document_id ORDER BY line_pos) AS paragraph FROM n) SELECT document_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS n_lines, string_agg(text, ' ' ORDER BY line_pos) AS text FROM p GROUP BY document_id, paragraph")
def paragraph_gaps(spark, d):
    return D.paragraphs(_geometry(spark, d))


@query("layout_json_blocks", "SELECT event_id, event_type AS kind, CASE event_type WHEN 'purchase' THEN 'table' WHEN 'click' THEN 'paragraph' ELSE 'text' END AS content_type, json_extract_string(props, '$.page') AS page FROM events")
def layout_json_blocks(spark, d):
    """Blocks of parsed layout objects: the type by rule, members from the JSON."""
    kind = F.when(F.col("event_type") == "purchase", "table").when(F.col("event_type") == "click", "paragraph").otherwise("text")
    return load(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), kind.alias("content_type"), F.get_json_object("props", "$.page").alias("page"))


@query("media_canonical", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image_description' WHEN doc_id % 5 = 0 AND regexp_matches(substr(text, 1, 200), '\\\\[a-zA-Z]+|[_^{}=+*/]|[0-9]') THEN 'formula' WHEN substr(text, 1, 80) <> '' THEN 'image_ocr' ELSE 'image_description' END AS content_type, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 40) WHEN doc_id % 5 = 0 AND regexp_matches(substr(text, 1, 200), '\\\\[a-zA-Z]+|[_^{}=+*/]|[0-9]') THEN substr(text, 1, 200) ELSE substr(text, 1, 80) END AS text FROM documents")
def media_canonical(spark, d):
    """One representation of a picture: what vision saw, else a plausible formula, else text that was read."""
    vision = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40))
    formula = F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 200))
    formula = F.when(T.plausible_formula(formula), formula)
    read = F.substring("text", 1, 80)
    kind = F.when(vision.isNotNull(), "image_description").when(formula.isNotNull(), "formula").when(read != "", "image_ocr").otherwise("image_description")
    return load(spark, d, "documents").select("doc_id", kind.alias("content_type"), F.coalesce(vision, formula, read).alias("text"))


@query("formula_filter", f"WITH l AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS f FROM ({LINES_SQL})) SELECT doc_id, pos, f <> '' AND length(f) <= 1600 AND regexp_matches(f, '\\\\[a-zA-Z]+|[_^{{}}=+*/]|[0-9]') AS plausible FROM l")
def formula_filter(spark, d):
    return _lines(spark, d).select("doc_id", "pos", T.plausible_formula(F.col("line")).alias("plausible"))


@query("url_filename", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, coalesce(nullif(trim(regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'index') || '.html' AS filename FROM pages")
def url_filename(spark, d):
    path = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1))
    slug = F.regexp_replace(F.regexp_replace(path, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return load(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)).alias("host"), F.concat(F.when(slug == "", "index").otherwise(slug), F.lit(".html")).alias("filename"))


@query("reindex_idempotent", "SELECT doc_id AS document_id, 'new' AS version, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'old', n_chars FROM documents WHERE lang <> 'en'")
def reindex_idempotent(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars", "lang")
    old = docs.select("document_id", F.lit("old").alias("version"), "n_chars")
    new = docs.filter("lang = 'en'").select("document_id", F.lit("new").alias("version"), "n_chars")
    return D.reindex(D.reindex(old, new), new)


@query("chunk_counts", f"SELECT d.source, count(DISTINCT d.doc_id) AS n_docs, count(l.line) AS n_stored, count(DISTINCT d.doc_id) * 3 AS n_expected FROM documents d LEFT JOIN ({LINES_SQL}) l ON l.doc_id = d.doc_id AND l.line <> '' GROUP BY d.source")
def chunk_counts(spark, d):
    """Documents, stored blocks and those expected, before anything is dropped."""
    stored = _lines(spark, d).filter("line != ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    docs = load(spark, d, "documents").select("doc_id", "source").join(stored, "doc_id", "left")
    return docs.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_stored"), (F.countDistinct("doc_id") * 3).alias("n_expected"))


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    e = load(spark, d, "events")
    return D.latest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("qset_validation", "SELECT conv_id, count(*) AS n_turns, count(*) - count(DISTINCT turn) AS n_duplicate, count(*) FILTER (trim(text) = '') AS n_blank, count(DISTINCT role) >= 2 AS enough FROM conversations GROUP BY conv_id")
def qset_validation(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), (F.count(F.lit(1)) - F.countDistinct("turn")).alias("n_duplicate"), F.count_if(F.trim("text") == "").alias("n_blank"), (F.countDistinct("role") >= 2).alias("enough"))


@query("catalog_union", "SELECT d.doc_id, d.source AS origin, true AS registered FROM documents d JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT d.doc_id, 'legacy', false FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def catalog_union(spark, d):
    """Registered documents, and files that no one registered."""
    docs, reg = load(spark, d, "documents"), load(spark, d, "labels").select("doc_id")
    known = docs.join(reg, "doc_id").select("doc_id", F.col("source").alias("origin"), F.lit(True).alias("registered"))
    return known.unionByName(docs.join(reg, "doc_id", "left_anti").select("doc_id", F.lit("legacy").alias("origin"), F.lit(False).alias("registered")))


@query("clean_text", r"SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '([A-Za-z])-([ \t]*)\n([A-Za-z])', '\1\3', 'g'), '　', ' '), '[ \t]+', ' ', 'g') AS text FROM documents")
def clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


_BOILER = r"(length(trim(line)) <= 60 AND trim(line) <> '' AND (regexp_matches(line, '^\s*第?\s*(\d{1,4})\s*页\s*(?:[/of共]\s*\d*\s*页?)?\s*[，,。.．]?\s*$') OR regexp_matches(line, '(?i)^\s*page\s+\d{1,4}\s+of\s+\d{1,4}\s*$') OR regexp_matches(line, '(?i)^\s*(机密|保密|内部资料|内部文件|草稿|草案|版权所有|版权声明|Copyright|Confidential|Draft|All rights reserved|未经.*许可.*不得|仅供.*使用|请勿.*外传)\s*[。.]?\s*$') OR regexp_matches(line, '^\s*[-*_=~]{3,}\s*$') OR regexp_matches(line, '^\s*\d{1,4}\s*$')))"


@query("boilerplate_lines", f"SELECT doc_id, pos, {_BOILER} AS boilerplate FROM ({LINES_SQL})")
def boilerplate_lines(spark, d):
    return _lines(spark, d).select("doc_id", "pos", T.is_boilerplate(F.col("line")).alias("boilerplate"))


_FREQ = f"nb AS (SELECT source, count(*) AS n_blocks FROM documents GROUP BY ALL HAVING count(*) >= 3), fq AS (SELECT source, trim(line, {_TRIM}) AS line, count(*) AS n FROM ({LINES_SQL}) WHERE trim(line, {_TRIM}) <> '' AND length(trim(line, {_TRIM})) <= 60 GROUP BY ALL), fr AS (SELECT fq.* FROM fq JOIN nb USING (source) WHERE n >= greatest(2, floor(0.04 * n_blocks)))"


@query("freq_boilerplate", f"WITH {_FREQ} SELECT source, line, n FROM fr")
def freq_boilerplate(spark, d):
    """Lines in a twenty-fifth of a source's documents: these share few short lines."""
    blocks = load(spark, d, "documents").select(F.col("source").alias("source_type"), "text")
    return D.frequent_lines(blocks, 0.04).select(F.col("source_type").alias("source"), "line", "n")


@query("clean_blocks", f"WITH {_FREQ}, k AS (SELECT doc_id, pos, line FROM ({LINES_SQL}) WHERE NOT {_BOILER} AND trim(line, {_TRIM}) NOT IN (SELECT line FROM fr)), j AS (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY pos), chr(10)) AS rest FROM k GROUP BY doc_id) SELECT doc_id AS block_id, source AS source_type, CASE WHEN NOT contains(text, chr(10)) OR trim(coalesce(rest, ''), {_TRIM}) = '' THEN text ELSE rest END AS text FROM documents LEFT JOIN j USING (doc_id)")
def clean_blocks(spark, d):
    return D.clean_blocks(load(spark, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("source").alias("source_type"), "text"), 0.04)


@query("topic_label", f"WITH l AS ({LINES_SQL}) SELECT doc_id, substr(coalesce(min_by(trim(line), pos) FILTER (pos % 4 = 2 AND length(trim(line)) >= 2), min_by(trim(line), pos) FILTER (length(trim(line)) >= 2), 'file' || doc_id), 1, 80) AS topic FROM l GROUP BY doc_id")
def topic_label(spark, d):
    """The first heading, else the first line of two characters, else the file's name; 80 characters of it."""
    t = F.trim("line")
    long_enough = F.length(t) >= 2
    l = _lines(spark, d)
    return l.groupBy("doc_id").agg(F.min_by(t, F.when((F.col("pos") % 4 == 2) & long_enough, F.col("pos"))).alias("h"), F.max((F.col("pos") % 4 == 2) & long_enough).alias("has_h"), F.min_by(t, F.when(long_enough, F.col("pos"))).alias("f"), F.max(long_enough).alias("has_f")).select("doc_id", F.substring(F.when(F.col("has_h"), F.col("h")).when(F.col("has_f"), F.col("f")).otherwise(F.concat(F.lit("file"), F.col("doc_id").cast("string"))), 1, 80).alias("topic"))


@query("search_text", "SELECT doc_id, concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), CASE WHEN doc_id % 2 = 0 THEN 'context ' || doc_id END, nullif(text, '')) AS search_text FROM documents")
def search_text(spark, d):
    context = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("context "), F.col("doc_id").cast("string")))
    return load(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.nullif("source", F.lit("")), F.nullif("lang", F.lit("")), context, F.nullif("text", F.lit(""))).alias("search_text"))


@query("serialize_source", "SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, CAST(nullif(d.doc_id % 5, 0) AS VARCHAR) AS page, d.source AS topic, length(d.text) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def serialize_source(spark, d):
    j = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif(F.col("doc_id") % 5, F.lit(0)).cast("string").alias("page"), F.col("source").alias("topic"), F.length("text").alias("n"))


@query("chunk_page", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 20")
def chunk_page(spark, d):
    return load(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").offset(20).limit(50)


@query("collection_name", "SELECT doc_id, 'rag_' || trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha1(text), 1, 8) || '_' || substr(sha1('{\"size\": ' || n_chars || '}'), 1, 8) AS name FROM documents")
def collection_name(spark, d):
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", "source", "lang")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    params = F.concat(F.lit('{"size": '), F.col("n_chars").cast("string"), F.lit("}"))
    return load(spark, d, "documents").select("doc_id", F.concat(F.lit("rag_"), slug, F.lit("_"), F.substring(F.sha1("text"), 1, 8), F.lit("_"), F.substring(F.sha1(params), 1, 8)).alias("name"))


@query("legacy_scan", "SELECT source, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS n_legacy FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def legacy_scan(spark, d):
    j = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_legacy"))


@query("chunk_chars", f"SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) AS n FROM ({LINES_SQL}) GROUP BY doc_id")
def chunk_chars(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.sum(F.length("line")).alias("n_chars"), F.count(F.lit(1)).alias("n"))
