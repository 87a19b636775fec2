"""Queries of chunkers, grouping and context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import documents as D
from ..registry import query
from ..sources.tables import load
from .documents import _TRIM, LINES_SQL, _lines

_DOCS = ("doc_id", "text")


@query("chunk_hard_window", "SELECT doc_id, i AS pos, substr(text, i * 420 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 420.0) AS BIGINT) + 1 END)) AS i FROM documents) WHERE length(substr(text, i * 420 + 1, 500)) >= 50")
def chunk_hard_window(spark, d):
    return C.hard_windows(load(spark, d, "documents"))


def _packed_sql(size: int, overlap: int, windows: str) -> str:
    """Chunks of packed lines by a fold, a line a step: what a step closes, and what stays open."""
    over, full = f"length(line) > {size}", f"now <> '' AND length(now) + 1 + length(line) > {size}"
    return f"""WITH RECURSIVE n AS (SELECT doc_id, trim(line, {_TRIM}) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ({LINES_SQL}) WHERE trim(line, {_TRIM}) <> ''),
r AS (SELECT doc_id, 0::BIGINT AS k, '' AS now, []::VARCHAR[] AS done FROM n WHERE k = 1 UNION ALL
SELECT r.doc_id, r.k + 1, CASE WHEN {over} THEN '' WHEN {full} THEN trim(right(now, {overlap}) || chr(10) || line, {_TRIM}) WHEN now <> '' THEN now || chr(10) || line ELSE line END,
CASE WHEN {over} THEN list_concat(CASE WHEN now <> '' THEN [now] ELSE []::VARCHAR[] END, {windows}) WHEN {full} THEN [now] ELSE []::VARCHAR[] END FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1),
e AS (SELECT doc_id, k, unnest(done) AS c, generate_subscripts(done, 1) AS i FROM r UNION ALL SELECT doc_id, max(k) + 1, max_by(now, k), 1 FROM r GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS pos, c AS chunk FROM e WHERE length(c) >= 50"""


_CUT = "list_transform(range(0, {end}, {step}), lambda s: {cut})"
_FIXED_SQL = _packed_sql(500, 80, _CUT.format(end="length(line) - 80", step=420, cut=f"trim(substr(line, s + 1, 500), {_TRIM})"))
_TOKEN_SQL = _packed_sql(1500, 150, _CUT.format(end="length(line)", step=1350, cut="substr(line, s + 1, 1500)"))


def _chunked(name: str):
    return lambda spark, d: C.chunk(load(spark, d, "documents"), name)


def _split_sql(name: str, parts: str, keys: str, sep: str, over: str) -> str:
    """CTE `name`(keys, i, piece): parts(keys, k, part) packed up to 500 with the separator, what is longer by `over`; pieces
    of under 50 characters go to the one before."""
    fits, on = f"now <> '' AND length(now) + 1 + length(part) <= 500", " AND ".join(f"r.{c} = p.{c}" for c in keys.split(", "))
    return f"""{name}_r AS (SELECT {keys}, 0::BIGINT AS k, '' AS now, []::VARCHAR[] AS done FROM {parts} WHERE k = 1 UNION ALL
SELECT {", ".join("r." + c for c in keys.split(", "))}, r.k + 1, CASE WHEN {fits} THEN now || {sep} || part WHEN length(part) <= 500 THEN part ELSE '' END,
CASE WHEN {fits} THEN []::VARCHAR[] ELSE list_concat(CASE WHEN now <> '' THEN [now] ELSE []::VARCHAR[] END, CASE WHEN length(part) > 500 THEN {over} ELSE []::VARCHAR[] END) END FROM {name}_r r JOIN {parts} p ON {on} AND p.k = r.k + 1),
{name}_e AS (SELECT {keys}, k, unnest(done) AS c, generate_subscripts(done, 1) AS i FROM {name}_r UNION ALL SELECT * FROM (SELECT {keys}, max(k) + 1, max_by(now, k) AS c, 1 FROM {name}_r GROUP BY {keys}) WHERE c <> ''),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY k, i) AS n FROM {name}_e),
{name}_g AS (SELECT *, CAST(sum(CASE WHEN n = 1 OR length(c) >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY n) AS BIGINT) AS g FROM {name}_n),
{name} AS (SELECT {keys}, g AS i, string_agg(c, '' ORDER BY n) AS piece FROM {name}_g GROUP BY {keys}, g)"""


# The texts hold none of the separators between line feed and space: lines, then words, then windows.
_RECURSIVE_SQL = f"""WITH RECURSIVE ln AS (SELECT doc_id, pos + 1 AS k, line AS part FROM ({LINES_SQL}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 500)),
wd AS (SELECT doc_id, k AS lk, unnest(string_split(part, ' ')) AS part, generate_subscripts(string_split(part, ' '), 1) AS k FROM ln WHERE length(part) > 500),
{_split_sql("wp", "wd", "doc_id, lk", "' '", "list_transform(range(0, length(part), 500), lambda s: substr(part, s + 1, 500))")},
wl AS (SELECT doc_id, lk, list(piece ORDER BY i) AS pieces FROM wp GROUP BY doc_id, lk), lw AS (SELECT ln.doc_id, k, part, pieces FROM ln LEFT JOIN wl ON wl.doc_id = ln.doc_id AND lk = k),
{_split_sql("lp", "lw", "doc_id", "chr(10)", "pieces")}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, piece AS chunk FROM lp WHERE length(piece) >= 50 AND doc_id IN (SELECT doc_id FROM documents WHERE trim(text, {_TRIM}) <> '') UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) BETWEEN 50 AND 500 AND trim(text, {_TRIM}) <> ''"""


query("chunk_fixed", _FIXED_SQL)(_chunked("fixed"))
query("chunk_recursive", _RECURSIVE_SQL)(_chunked("recursive"))
for _name in ("semantic", "markdown"):
    query(f"chunk_{_name}")(_chunked(_name))
query("chunk_token_est", _TOKEN_SQL)(_chunked("token"))


# Documents as Markdown: blank lines between lines, and every fifth line by its length is a heading of 40 characters.
_TITLES = "CASE WHEN length(line) % 5 = 0 THEN '## ' || left(line, 40) ELSE line END"


@query("markdown_chunks", f"""WITH RECURSIVE l AS (SELECT doc_id, pos, {_TITLES} AS line FROM ({LINES_SQL})), h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]') AS head FROM l),
s AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS sec FROM h),
t AS (SELECT doc_id, sec, coalesce(max(line) FILTER (head), '') AS title, coalesce(trim(string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (NOT head), {_TRIM}), '') AS body FROM s GROUP BY doc_id, sec),
w AS (SELECT *, trim(CASE WHEN title <> '' THEN title || chr(10) || body ELSE body END, {_TRIM}) AS whole FROM t),
p AS (SELECT s.doc_id, s.sec, w.title, trim(line, {_TRIM}) AS para, row_number() OVER (PARTITION BY s.doc_id, s.sec ORDER BY pos) AS k FROM s JOIN w ON w.doc_id = s.doc_id AND w.sec = s.sec WHERE length(whole) > 2000 AND NOT head AND trim(line, {_TRIM}) <> ''),
r AS (SELECT doc_id, sec, title, 1::BIGINT AS k, para AS pack, '' AS done FROM p WHERE k = 1 UNION ALL
SELECT r.doc_id, r.sec, r.title, r.k + 1, CASE WHEN length(r.title) + length(pack) + length(para) + 3 > 2000 THEN para ELSE pack || chr(10) || chr(10) || para END, CASE WHEN length(r.title) + length(pack) + length(para) + 3 > 2000 THEN trim(r.title || chr(10) || pack, {_TRIM}) ELSE '' END FROM r JOIN p ON p.doc_id = r.doc_id AND p.sec = r.sec AND p.k = r.k + 1),
e AS (SELECT doc_id, sec, 0 AS k, whole AS c FROM w WHERE length(whole) <= 2000 UNION ALL SELECT doc_id, sec, k, done FROM r UNION ALL SELECT doc_id, sec, max(k) + 1, trim(any_value(title) || chr(10) || max_by(pack, k), {_TRIM}) FROM r GROUP BY doc_id, sec)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1 AS pos, c AS chunk FROM e WHERE length(c) >= 100""")
def markdown_chunks(spark, d):
    """Chunks of documents with headings and blank lines: sections, those too long packed by paragraphs under their title."""
    line = lambda x: F.when(F.length(x) % 5 == 0, F.concat(F.lit("## "), F.left(x, F.lit(40)))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return C.chunk(load(spark, d, "documents").select("doc_id", text.alias("text")), "markdown")


def _sentences_sql(ends: str, marks, anywhere: bool) -> str:
    cases = " ".join(f"WHEN contains(text, '{m}') AND NOT contains(right(p, 2), '{m}') THEN p || '{m}'" if anywhere else f"WHEN contains(text, p || '{m}') THEN p || '{m}'" for m in marks)
    return f"SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, CASE {cases} ELSE p END AS s FROM (SELECT doc_id, text, trim(unnest(regexp_split_to_array(text, '{ends}')), {_TRIM}) AS p, generate_subscripts(regexp_split_to_array(text, '{ends}'), 1) AS k FROM documents) WHERE p <> ''"


_ENDS, _MARKS = r"[。！？.!?\n]+", ("。", "！", "？", ".", "!", "?")


@query("sentence_split", f"SELECT doc_id, pos - 1 AS pos, s AS sentence FROM ({_sentences_sql(_ENDS, _MARKS, False)})")
def sentence_split(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("chunk_sliding", f"WITH s AS ({_sentences_sql(*C.SENTENCE_ENDS, True)}), n AS (SELECT doc_id, any_value(text) AS text, list(s ORDER BY pos) AS l FROM s GROUP BY doc_id), w AS (SELECT doc_id, text, l, unnest(range(CASE WHEN len(l) <= 5 THEN 1 ELSE CAST(ceil((len(l) - 5) / 2.0) AS BIGINT) + 1 END)) AS pos FROM n), c AS (SELECT doc_id, pos, CASE WHEN len(l) <= 5 THEN text ELSE array_to_string(l[pos * 2 + 1 : pos * 2 + 5], chr(10)) END AS chunk FROM w) SELECT * FROM c WHERE length(chunk) >= 50")
def chunk_sliding(spark, d):
    return C.sliding(load(spark, d, "documents"))


@query("chunk_preserve", f"SELECT doc_id, pos, trim(line, {_TRIM}) AS chunk FROM ({LINES_SQL})")
def chunk_preserve(spark, d):
    return _lines(spark, d).select("doc_id", "pos", T.strip(F.col("line")).alias("chunk"))


# Lines as blocks, with a type, heading and depth by rule.
BLOCKS_SQL = f"bl AS (SELECT doc_id AS document_id, pos AS block_pos, CASE (pos * 7 + doc_id) % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'image_description' WHEN 3 THEN 'formula' ELSE 'paragraph' END AS content_type, 'h' || (pos // 3) AS heading, lang AS source_type, 1 + pos % 3 AS depth, line AS text FROM ({LINES_SQL}))"


def _blocks(spark, d):
    r = (F.col("pos") * 7 + F.col("doc_id")) % 6
    kind = F.when(r == 0, "heading").when(r == 1, "table").when(r == 2, "image_description").when(r == 3, "formula").otherwise("paragraph")
    return _lines(spark, d).select(F.col("doc_id").alias("document_id"), F.col("pos").alias("block_pos"), kind.alias("content_type"), F.concat(F.lit("h"), F.floor(F.col("pos") / 3).cast("string")).alias("heading"), F.col("lang").alias("source_type"), (1 + F.col("pos") % 3).alias("depth"), F.col("line").alias("text"))


_IS_TEXT = "content_type IN ('text', 'paragraph', 'heading', 'code')"


@query("group_long_form", f"""WITH {BLOCKS_SQL}, f AS (SELECT *, CASE WHEN {_IS_TEXT} AND lag({_IS_TEXT}) OVER w AND heading = lag(heading) OVER w AND source_type = lag(source_type) OVER w THEN 0 ELSE 1 END AS nw FROM bl WINDOW w AS (PARTITION BY document_id ORDER BY block_pos)),
g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY document_id ORDER BY block_pos) AS BIGINT) AS grp FROM f) SELECT document_id, grp, min(block_pos) AS first_pos, count(*) AS n_blocks, min_by(content_type, block_pos) AS content_type, string_agg(text, chr(10) || chr(10) ORDER BY block_pos) AS text FROM g GROUP BY document_id, grp""")
def group_long_form(spark, d):
    return C.group_long_form(_blocks(spark, d))


_PAGED = f"{BLOCKS_SQL}, pb AS (SELECT *, CASE WHEN document_id % 3 <> 2 THEN 1 + block_pos // 2 END AS page_number, CASE WHEN document_id % 3 = 1 THEN block_pos // 2 END AS slide_number FROM bl)"


@query("long_form_segments", f"""WITH {_PAGED}, f AS (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\r\\v\\f]+', ' ', 'g')) AS piece, CASE WHEN {_IS_TEXT} AND lag({_IS_TEXT}) OVER w AND heading = lag(heading) OVER w AND source_type = lag(source_type) OVER w AND slide_number IS NOT DISTINCT FROM lag(slide_number) OVER w THEN 0 ELSE 1 END AS nw FROM pb WINDOW w AS (PARTITION BY document_id ORDER BY block_pos)),
g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY document_id ORDER BY block_pos) AS BIGINT) AS grp FROM f),
o AS (SELECT *, CAST(coalesce(sum(CASE WHEN piece <> '' THEN length(piece) + 1 ELSE 0 END) OVER (PARTITION BY document_id, grp ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM g)
SELECT document_id, grp, min(block_pos) AS first_pos, count(*) AS n_blocks, min_by(content_type, block_pos) AS content_type, first(page_number ORDER BY block_pos) AS page_number,
CASE WHEN count(*) = 1 THEN any_value(text) WHEN count(page_number) > 0 THEN coalesce(string_agg(piece, ' ' ORDER BY block_pos) FILTER (piece <> ''), '') ELSE coalesce(string_agg(trim(text, {_TRIM}), chr(10) || chr(10) ORDER BY block_pos) FILTER (piece <> ''), '') END AS text,
CASE WHEN count(*) > 1 AND count(page_number) > 0 THEN coalesce(string_agg(s || '-' || (s + length(piece)) || '@' || page_number, ',' ORDER BY block_pos) FILTER (piece <> ''), '') END AS segments FROM o GROUP BY document_id, grp""")
def long_form_segments(spark, d):
    """Long-form groups of blocks with pages, slides, or neither, by document; of joined pages, which characters are whose."""
    pos, kind = F.col("block_pos"), F.col("document_id") % 3
    half = F.floor(pos / 2).cast("int")
    b = _blocks(spark, d).withColumns({"page_number": F.when(kind != 2, half + 1), "slide_number": F.when(kind == 1, half)})
    one = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit("@"), x["page"].cast("string"))
    return C.long_form_groups(b).withColumn("segments", F.array_join(F.transform("segments", one), ","))


@query("group_structured", f"""WITH {BLOCKS_SQL}, f AS (SELECT *, content_type = 'heading' OR NOT ({_IS_TEXT}) OR NOT coalesce(lag({_IS_TEXT}) OVER (PARTITION BY document_id ORDER BY block_pos), false) AS nw,
 CASE WHEN content_type = 'heading' THEN repeat('#', depth) || ' ' || trim(ltrim(trim(text, {_TRIM}), '#'), {_TRIM}) WHEN {_IS_TEXT} THEN trim(text, {_TRIM}) ELSE text END AS part FROM bl),
g AS (SELECT *, CAST(sum(CAST(nw AS INT)) OVER (PARTITION BY document_id ORDER BY block_pos) AS BIGINT) AS grp FROM f) SELECT document_id, grp, min(block_pos) AS first_pos, count(*) AS n_blocks, string_agg(part, chr(10) || chr(10) ORDER BY block_pos) AS text FROM g WHERE trim(part) <> '' GROUP BY document_id, grp""")
def group_structured(spark, d):
    return C.group_structured(_blocks(spark, d))


@query("bind_context", f"""WITH {BLOCKS_SQL}, t AS (SELECT *, CASE WHEN {_IS_TEXT} THEN text END AS tx FROM bl), b AS (SELECT *, last_value(tx IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, first_value(tx IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM t)
SELECT document_id, block_pos, CASE WHEN content_type IN ('image_description', 'formula', 'image_ocr') THEN concat_ws(chr(10), right(bf, 150), substr(af, 1, 150)) END AS context FROM b""")
def bind_context(spark, d):
    return C.bind_context(_blocks(spark, d)).select("document_id", "block_pos", "context")


@query("attribute_pages", f"""WITH l AS (SELECT doc_id, pos, length(line) AS n FROM ({LINES_SQL})), o AS (SELECT doc_id, pos, n, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
p AS (SELECT doc_id, i AS page, i * 1000 AS a, (i + 1) * 1000 AS b FROM (SELECT doc_id, unnest(range(CAST(ceil(greatest(length(text), 1) / 1000.0) AS BIGINT))) AS i FROM documents))
SELECT o.doc_id, o.pos, CAST(o.s AS BIGINT) AS start_offset, min(p.page) AS page_start, max(p.page) AS page_end FROM o JOIN p ON p.doc_id = o.doc_id AND p.a < o.s + greatest(o.n, 1) AND o.s < p.b GROUP BY o.doc_id, o.pos, o.s""")
def attribute_pages(spark, d):
    """Pages of a thousand characters that a line lies on, by an interval join within the document."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("line")
    o = _lines(spark, d).select("doc_id", "pos", n.alias("n"), F.coalesce(F.sum(n + 1).over(w), F.lit(0)).alias("s"))
    last = F.ceil(F.greatest(F.length("text"), F.lit(1)) / 1000.0).cast("int") - 1
    p = load(spark, d, "documents").select(F.col("doc_id").alias("k"), F.explode(F.sequence(F.lit(0), last)).alias("page"))
    on = (F.col("k") == F.col("doc_id")) & (F.col("page") * 1000 < F.col("s") + F.greatest("n", F.lit(1))) & (F.col("s") < (F.col("page") + 1) * 1000)
    return o.join(p, on).groupBy("doc_id", "pos", F.col("s").alias("start_offset")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


@query("chunk_assembly", f"WITH {BLOCKS_SQL}, w AS (SELECT document_id, block_pos, text, unnest(range(greatest(1, CAST(ceil(length(text) / 300.0) AS BIGINT)))) AS i FROM bl), c AS (SELECT document_id, block_pos, i, CASE WHEN length(text) = 0 THEN text ELSE substr(text, i * 300 + 1, 300) END AS content FROM w) SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_pos, i) - 1 AS chunk_index, document_id || ':parent:' || block_pos AS parent_chunk_id, content FROM c")
def chunk_assembly(spark, d):
    """Chunks of a document in order, each with its block as parent; a block without chunks is one itself."""
    parts = F.greatest(F.lit(1), F.ceil(F.length("text") / 300.0).cast("int"))
    c = _blocks(spark, d).select("document_id", "block_pos", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i")).withColumn("content", F.substring("text", F.col("i") * 300 + 1, F.lit(300)))
    w = Window.partitionBy("document_id").orderBy("block_pos", "i")
    return c.select("document_id", (F.row_number().over(w) - 1).alias("chunk_index"), F.concat(F.col("document_id").cast("string"), F.lit(":parent:"), F.col("block_pos").cast("string")).alias("parent_chunk_id"), "content")


_PROFILE = f"""{BLOCKS_SQL}, pr AS (SELECT document_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) FILTER (content_type IN ('table', 'formula', 'image_ocr', 'image')) AS n_layout, count(*) FILTER ({_IS_TEXT}) AS n_text FROM bl GROUP BY document_id)"""
_EXT = "CASE document_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.csv' WHEN 2 THEN '.html' ELSE '.pdf' END"


def _sampled(spark, d, b=None):
    """What the rules of profiles read of documents. The sample is that of the first 30 blocks."""
    b = _blocks(spark, d) if b is None else b
    b = b.withColumn("_k", F.row_number().over(Window.partitionBy("document_id").orderBy("block_pos")))
    b = b.withColumn("_first", F.when(F.col("_k") <= 30, F.col("text")).otherwise(""))
    a = b.groupBy("document_id").agg(D.joined("block_pos", "_first", "\n").alias("sample"), F.sum(F.length("text")).alias("total_chars"), F.count_if(F.col("content_type").isin(*D.LAYOUT_TYPES)).alias("n_layout"), F.count_if(F.col("content_type").isin(*D.TEXT_TYPES)).alias("n_text"))
    m = F.col("document_id") % 7
    return a.withColumn("filename", F.concat(F.lit("f"), F.when(m == 0, ".md").when(m == 1, ".csv").when(m == 2, ".html").otherwise(".pdf")))


def _profiled(spark, d, b=None):
    return D.resolve_profile(_sampled(spark, d, b))


@query("resolve_profile", f"WITH {_PROFILE} SELECT document_id, total_chars, n_layout, n_text, CASE WHEN {_EXT} = '.csv' THEN 'spreadsheet' WHEN {_EXT} IN ('.md', '.html') THEN 'technical' WHEN n_layout > 0 AND ((n_layout >= 2 AND 2 * n_layout > n_text) OR total_chars <= 600) THEN 'layout' WHEN total_chars <= 2400 THEN 'short_qa' ELSE 'long_form' END AS profile FROM pr")
def resolve_profile(spark, d):
    return _profiled(spark, d).select("document_id", "total_chars", "n_layout", "n_text", "profile")


_RULES = f"CASE WHEN {_EXT} = '.csv' THEN 'spreadsheet' WHEN {_EXT} IN ('.md', '.html') THEN 'technical' WHEN n_layout > 0 AND ((n_layout >= 2 AND 2 * n_layout > n_text) OR total_chars <= 600) THEN 'layout' WHEN total_chars <= 2400 THEN 'short_qa' ELSE 'long_form' END"


@query("chosen_profile", f"""WITH {_PROFILE}, c AS (SELECT document_id, document_id % 10 IN (1, 4) AS asked, {_EXT} = '.html' AS html, CASE document_id % 10 WHEN 1 THEN 'high_value' WHEN 4 THEN 'technical' ELSE {_RULES} END AS profile FROM pr)
SELECT document_id, profile, profile IN ('technical', 'long_form', 'high_value') AND NOT (html AND NOT asked) AS parent_child, profile = 'technical' AND NOT (html AND NOT asked) AS reconstructed, profile = 'high_value' AS contextual FROM c""")
def chosen_profile(spark, d):
    """Profiles of documents; some are asked for, some as auto or blank."""
    m = F.col("document_id") % 10
    asked = F.when(m == 1, " High_Value").when(m == 4, "technical").when(m == 5, "AUTO").when(m == 6, " ")
    return D.chosen_profile(_sampled(spark, d).withColumn("requested", asked)).select("document_id", "profile", "parent_child", "reconstructed", "contextual")


@query("chunk_by_profile")
def chunk_by_profile(spark, d):
    """Each document by the chunker of the profile that the rules give it."""
    p = _profiled(spark, d).select(F.col("document_id").alias("doc_id"), "profile")
    return C.chunk_by_profile(load(spark, d, "documents").select("doc_id", "text").join(p, "doc_id"))


# Marks of questions and answers before some lines, by rule, past the first 30 blocks as well.
_MARKED = "CASE WHEN document_id % 5 = 0 AND block_pos % 3 = 0 THEN '问：答案：' WHEN document_id % 5 = 1 AND block_pos = 0 THEN 'Q：' WHEN document_id % 5 = 2 AND block_pos > 30 THEN 'A：' ELSE '' END"


@query("qa_sniff", f"""WITH {BLOCKS_SQL}, k AS (SELECT document_id, {_MARKED} AS mark, row_number() OVER (PARTITION BY document_id ORDER BY block_pos) AS n FROM bl),
m AS (SELECT document_id, sum(CASE WHEN n > 30 OR mark = '' THEN 0 WHEN length(mark) > 2 THEN 2 ELSE 1 END) AS qa_marks FROM k GROUP BY document_id) SELECT document_id, CAST(qa_marks AS BIGINT) AS qa_marks, qa_marks >= 2 AS is_qa FROM m""")
def qa_sniff(spark, d):
    marked = _blocks(spark, d).withColumn("text", F.concat(F.expr(_MARKED), "text"))
    return _profiled(spark, d, marked).select("document_id", F.col("qa_marks").cast("long").alias("qa_marks"), (F.col("qa_marks") >= 2).alias("is_qa"))


@query("subsections", f"WITH {BLOCKS_SQL}, f AS (SELECT document_id, heading, min(block_pos) AS k FROM bl GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY k) AS n FROM f) SELECT document_id, string_agg(heading, '；' ORDER BY n) AS subsections FROM r WHERE n <= 8 GROUP BY document_id")
def subsections(spark, d):
    """The first eight distinct headings of a document, in order."""
    f = _blocks(spark, d).groupBy("document_id", "heading").agg(F.min("block_pos").alias("k"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("k"))
    return f.withColumn("n", n).filter("n <= 8").groupBy("document_id").agg(D.joined("n", "heading", "；").alias("subsections"))


@query("semantic_boundaries", """SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(lag(embedding) OVER (ORDER BY vec_id) AS DOUBLE[])), 6) AS alike FROM embeddings QUALIFY label IS NOT DISTINCT FROM lag(label) OVER (ORDER BY vec_id)""")
def semantic_boundaries(spark, d):
    """Similarity of a vector with the one before, by id."""
    from ..operators import retrieval as R
    from ..operators.ordered import previous

    e = previous(load(spark, d, "embeddings").select("vec_id", "embedding", "label"), "vec_id", ["embedding", "label"])
    return e.filter("label <=> prev_label").select("vec_id", F.round(R.dot("embedding", "prev_embedding"), 6).alias("alike"))


@query("hash_embedding")
def hash_embedding(spark, d):
    """The stand-in model's vectors of documents."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([C.hash_vector(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "embedding"])

    return load(spark, d, "documents").select(*_DOCS).mapInArrow(run, "doc_id long, embedding array<double>")


# Chunks as they are stored, of documents whose profiles leave blocks as they are; a block is a line.
_ASIS = "CASE document_id % 3 WHEN 0 THEN 'layout' WHEN 1 THEN 'short_qa' ELSE 'spreadsheet' END"
_PART = f"CASE WHEN {_ASIS} <> 'short_qa' OR length(t) < 20 THEN [t] WHEN length(t) <= 500 THEN [t] ELSE list_filter(list_transform(range(0, length(t) - 60, 440), lambda s: trim(substr(t, s + 1, 500), {_TRIM})), lambda c: length(c) >= 20) END"


@query("assembled_chunks", f"""WITH {BLOCKS_SQL}, t0 AS (SELECT *, trim(text, {_TRIM}) AS t, CASE WHEN {_IS_TEXT} THEN text END AS tx FROM bl),
b AS (SELECT *, last_value(tx IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, first_value(tx IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM t0),
x AS (SELECT *, CASE WHEN content_type IN ('image_description', 'formula') THEN trim(concat_ws(chr(10), right(bf, 150), substr(af, 1, 150)), {_TRIM}) ELSE '' END AS context, {_PART} AS parts FROM b WHERE t <> ''),
u AS (SELECT *, unnest(parts) AS content, generate_subscripts(parts, 1) AS i FROM x)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_pos, i) - 1 AS chunk_index, document_id || ':parent:' || block_pos AS parent_chunk_id, {_ASIS} AS profile, content_type, CASE WHEN document_id % 2 = 0 THEN 'f.pdf' || chr(10) ELSE '' END || heading || chr(10) || CASE WHEN context <> '' THEN context || chr(10) ELSE '' END || content AS search_text, content FROM u""")
def assembled_chunks(spark, d):
    """Stored chunks of all documents by their profiles, with parent, context and what is searched."""
    k = F.col("document_id")
    b = _blocks(spark, d).withColumns({"page_number": F.lit(None).cast("int"), "slide_number": F.lit(None).cast("int")})
    profile = F.when(k % 3 == 0, "layout").when(k % 3 == 1, "short_qa").otherwise("spreadsheet")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), profile.alias("profile"), F.lit(False).alias("parent_child"), F.lit(False).alias("reconstructed"), F.when(F.col("doc_id") % 2 == 0, " f.pdf ").alias("filename"))
    return C.assembled_chunks(b, docs).select("document_id", "chunk_index", "parent_chunk_id", "profile", "content_type", "search_text", "content")
