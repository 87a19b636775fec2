"""Document operators: blocks, tables, page geometry, cleaning, profiles, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Formats by extension, and kinds of content.
PARSERS = {".md": "markdown", ".txt": "text", ".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".pptx": "pptx", ".ppt": "pptx", ".html": "html", ".htm": "html", ".csv": "csv", ".xlsx": "xlsx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".bmp": "image"}
TEXT_TYPES, LAYOUT_TYPES = ("text", "paragraph", "heading", "code"), ("table", "formula", "image_ocr", "image")
ROWS_A_GROUP = 50


def parser_of(path: Column) -> Column:
    """The parser of a path's extension; null if none is known."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name in sorted(set(PARSERS.values())):
        out = F.when(ext.isin([e for e, p in PARSERS.items() if p == name]), name).otherwise(out)
    return out


def lines(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """key, pos (from 0), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def text_blocks(docs: DataFrame, sep="\n\n", key="doc_id", text="text") -> DataFrame:
    """key, block_pos, text: what stands between blank lines, trimmed, without empty blocks."""
    parts = F.filter(F.transform(F.split(text, sep), T.strip), lambda x: x != "")
    return docs.select(key, F.posexplode(parts).alias("block_pos", "text"))


def joined(pos: str, value: str, sep: str) -> Column:
    """Values of a group in order of their places, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]), sep)


def normalized_row(cells: Column, width: int) -> Column:
    """Exactly width cells: short rows padded with empty ones, long ones cut."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)


def row_text(header: list[str], cells: Column) -> Column:
    """name：value；... of a row, without empty values."""
    pairs = F.zip_with(F.array(*map(F.lit, header)), cells, lambda h, c: F.when(c != "", F.concat(h, F.lit("："), c)))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "；")


def row_groups(rows: DataFrame, order: str, header: list[str], size: int = ROWS_A_GROUP) -> DataFrame:
    """group, n_rows and text of each `size` rows in order.

    order must number the rows from 1 without gaps, so that groups need no global sort."""
    g = F.floor((F.col(order) - 1) / size).cast("long")
    return rows.select(g.alias("group"), F.col(order).alias("_o"), row_text(header, normalized_row(F.col("cells"), len(header))).alias("_t")).groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"), joined("_o", "_t", "\n").alias("text"))


def markdown_table(header: list[str], cells: Column) -> Column:
    """A row of a pipe table."""
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def sample_pages(pages: DataFrame, most: int = 10) -> DataFrame:
    """pages(document_id, page from 1, ...) thinned to at most `most` evenly spread ones, first and last included."""
    n = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    i = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most)).cast("int") - 1))
    wanted = n.select("document_id", "n", i.alias("i")).select("document_id", F.when(F.col("n") <= most, F.col("i") + 1).otherwise(F.bround(F.col("i") * (F.col("n") - 1) / (most - 1)).cast("int") + 1).alias("page")).distinct()
    return pages.join(wanted, ["document_id", "page"])


def classify_pages(pages: DataFrame) -> DataFrame:
    """document_id, kind: native, scanned or mixed by its sampled pages(document_id, text_len, image_count)."""
    has_text = F.col("text_len") >= 20
    a = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("text_len").alias("chars"), F.avg(has_text.cast("double")).alias("text_ratio"), F.avg("image_count").alias("images"))
    kind = F.when((F.col("chars") < 5 * F.col("n")) | (F.col("text_ratio") <= 0.25), "scanned").when((F.col("text_ratio") >= 0.75) & (F.col("text_ratio") == 1) & (F.col("images") < 0.5), "native").otherwise("mixed")
    return a.withColumn("kind", kind)


def headings(page_lines: DataFrame) -> DataFrame:
    """Lines(document_id, line_pos, text, size, bold) that are headings, with their level: the dense rank of size.

    The body size is the median, taken again over lines within 1.3 of the first; a heading is 1.15 times as large and
    a point over, or bold and as large."""
    first = page_lines.groupBy("document_id").agg(F.percentile("size", 0.5).alias("m"))
    near = page_lines.join(first, "document_id").filter(F.col("size") <= 1.3 * F.col("m"))
    body = near.groupBy("document_id").agg(F.percentile("size", 0.5).alias("body"))
    j = page_lines.join(body, "document_id")
    is_head = ((F.col("size") >= 1.15 * F.col("body")) & (F.col("size") >= F.col("body") + 1)) | (F.col("bold") & (F.col("size") >= F.col("body")))
    return j.filter(is_head).withColumn("level", F.dense_rank().over(Window.partitionBy("document_id").orderBy(F.col("size").desc())))


def outside(lines_: DataFrame, boxes: DataFrame, by, tolerance: float = 2.0) -> DataFrame:
    """Boxes x0, top, x1, bottom of lines_ that overlap none of boxes, within a tolerance, on the same page."""
    a, b = lines_.alias("a"), boxes.alias("b")
    hit = (F.col("a.x0") >= F.col("b.x0") - tolerance) & (F.col("a.x1") <= F.col("b.x1") + tolerance) & (F.col("a.top") >= F.col("b.top") - tolerance) & (F.col("a.bottom") <= F.col("b.bottom") + tolerance)
    for k in by:
        hit = hit & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, hit, "left_anti")


def paragraphs(page_lines: DataFrame) -> DataFrame:
    """Lines joined to paragraphs: a new one where the gap above exceeds half the median height, and 2."""
    h = page_lines.groupBy("document_id").agg(F.percentile(F.col("bottom") - F.col("top"), 0.5).alias("h"))
    w = Window.partitionBy("document_id").orderBy("line_pos")
    gap = F.col("top") - F.lag("bottom").over(w)
    j = page_lines.join(h, "document_id").withColumn("_new", F.when(gap > F.greatest(0.5 * F.col("h"), F.lit(2.0)), 1).otherwise(0))
    j = j.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return j.groupBy("document_id", "paragraph").agg(F.count(F.lit(1)).alias("n_lines"), joined("line_pos", "text", " ").alias("text"))


def frequent_lines(blocks: DataFrame, ratio: float = 0.6, by=("source_type",)) -> DataFrame:
    """Lines (trimmed, 60 characters at most) that occur in blocks(.., text) of one `by` at least max(2, int(ratio *
    blocks)) times, where there are three blocks or more. By document and source it finds furniture of a document."""
    n = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks")).filter("n_blocks >= 3")
    each = blocks.select(*by, F.explode(F.split("text", "\n")).alias("line")).select(*by, T.strip(F.col("line")).alias("line")).filter("line != '' and length(line) <= 60")
    counts = each.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(n, list(by)).filter(F.col("n") >= F.greatest(F.lit(2), F.floor(ratio * F.col("n_blocks"))))


def clean_blocks(blocks: DataFrame, ratio: float = 0.6) -> DataFrame:
    """blocks(block_id, source_type, text) cleaned: characters, then page furniture and frequent lines of blocks of
    several lines; what would leave nothing is left as it was. Where there is a content_type, code keeps its spaces."""
    clean = T.clean_text(F.col("text"))
    if "content_type" in blocks.columns:
        clean = F.when(F.col("content_type") == "code", T.clean_text(F.col("text"), keep_spaces=True)).otherwise(clean)
    base = blocks.withColumn("clean", clean)
    frequent = frequent_lines(blocks, ratio).select("line").distinct()
    each = base.filter(F.instr("clean", "\n") > 0).select("block_id", F.posexplode(F.split("clean", "\n")).alias("pos", "line"))
    kept = each.filter(~T.is_boilerplate(F.col("line"))).withColumn("_t", T.strip(F.col("line"))).join(frequent.withColumnRenamed("line", "_t"), "_t", "left_anti")
    again = kept.groupBy("block_id").agg(F.regexp_replace(joined("pos", "line", "\n"), r"^\n+|\n+\z", "").alias("rest"))
    out = base.join(again, "block_id", "left")
    text = F.when(F.instr("clean", "\n") > 0, F.coalesce("rest", F.lit(""))).otherwise(F.col("clean"))
    return out.select("block_id", "source_type", F.when(T.strip(text) == "", F.col("text")).otherwise(text).alias("text"))


def resolve_profile(docs: DataFrame) -> DataFrame:
    """Profile by docs(document_id, filename, sample, total_chars, n_layout, n_text), the first rule that holds."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    marks = sum((F.size(F.split(F.col("sample"), m)) - 1 for m in T.QA_MARKERS), F.lit(0))
    layout = (F.col("n_layout") > 0) & (((F.col("n_layout") >= 2) & (2 * F.col("n_layout") > F.col("n_text"))) | (F.col("total_chars") <= 600))
    p = F.when(marks >= 2, "short_qa").when(ext.isin(".xlsx", ".csv"), "spreadsheet").when(ext.isin(".md", ".html", ".htm"), "technical").when(layout, "layout").when(F.col("total_chars") <= 2400, "short_qa").otherwise("long_form")
    return docs.withColumn("qa_marks", marks).withColumn("profile", p)


# How blocks are put together before they are chunked, by profile.
PARENT_CHILD, RECONSTRUCTED, CONTEXTUAL, PROFILE_IDS = ("technical", "long_form", "high_value"), ("technical",), ("high_value",), ("technical", "long_form", "layout", "short_qa", "high_value", "spreadsheet")


def chosen_profile(docs: DataFrame, requested="requested") -> DataFrame:
    """docs as for resolve_profile, with the profile that was asked for, else the one that the rules give, and with what it
    means: parent_child, reconstructed and contextual.

    What is asked for is read without case and white space at its ends; null, blank and auto leave it to the rules, and a
    profile that does not exist is an error. Blocks of HTML that the rules find technical stay apart, without parents."""
    asked = F.lower(T.strip(F.coalesce(F.col(requested).cast("string"), F.lit(""))))
    auto = asked.isin("", "auto")
    by_rule = resolve_profile(docs).withColumn("_asked", asked).withColumn("_auto", auto)
    known = F.when(F.col("_asked").isin(*PROFILE_IDS), F.col("_asked")).otherwise(F.raise_error(F.concat(F.lit("unknown profile: "), F.col("_asked"))).cast("string"))
    apart = F.col("_auto") & (F.col("profile") == "technical") & F.lower("filename").rlike(r"\.html?$")
    out = by_rule.withColumn("profile", F.when(F.col("_auto"), F.col("profile")).otherwise(known)).withColumn("_apart", apart)
    of = lambda ids: F.col("profile").isin(*ids) & ~F.coalesce("_apart", F.lit(False))
    return out.withColumns({"parent_child": of(PARENT_CHILD), "reconstructed": of(RECONSTRUCTED), "contextual": of(CONTEXTUAL)}).drop("_asked", "_auto", "_apart")


def latest(rows: DataFrame, key, order) -> DataFrame:
    """The row of each key that comes first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def reindex(stored: DataFrame, fresh: DataFrame, key="document_id") -> DataFrame:
    """stored with the rows of all documents in fresh replaced by those in fresh: doing it twice changes nothing."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def topics(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """document_id, topic_label of files(document_id, filename): the first heading block of two characters or more in
    blocks(document_id, block_pos, content_type, heading_path, text), else the first such entry of a heading path, else
    the first such line that begins a block, else the file's stem. A document without blocks has its stem."""
    text, long_enough = T.strip(F.col("text")), lambda c: F.length(T.strip(c)) >= 2
    entry = F.get(F.filter("heading_path", long_enough), 0)
    line = T.strip(F.get(F.split(text, r"\r\n|[\n\r\x0b\x0c]"), 0))
    first = lambda value, holds: F.min_by(F.when(holds, value), F.when(holds, F.col("block_pos")))
    found = blocks.groupBy("document_id").agg(first(text, (F.col("content_type") == "heading") & long_enough(F.col("text"))).alias("_a"), first(entry, entry.isNotNull()).alias("_b"), first(line, F.length(line) >= 2).alias("_c"))
    stem = F.coalesce(F.nullif(T.file_stem(F.col("filename")), F.lit("")), F.lit(T.NO_TOPIC))
    return files.join(found, "document_id", "left").select("document_id", F.coalesce(T.topic(F.coalesce("_a", "_b", "_c")), stem).alias("topic_label"))


def stamped(blocks: DataFrame, files: DataFrame, names=("filename", "topic_label", "source_url")) -> DataFrame:
    """blocks(document_id, metadata map) with the file's columns of these names put into metadata, over what it held;
    a name whose value is null or empty is not put."""
    more = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"_{n}").alias("v")) for n in names]), lambda e: F.coalesce(e["v"] != "", F.lit(False))))
    j = blocks.join(files.select("document_id", *[F.col(n).cast("string").alias(f"_{n}") for n in names]), "document_id", "left")
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(more, k))
    return j.withColumn("metadata", F.map_concat(own, more)).select(*blocks.columns)


def search_text(content="content", metadata="metadata") -> Column:
    """What is indexed of a chunk: metadata's search_text, else its content, else nothing."""
    return F.coalesce(F.nullif(F.col(metadata)["search_text"], F.lit("")), F.col(content), F.lit(""))


def updated(records: DataFrame, changes: DataFrame, key="document_id", allowed: tuple[str, ...] = ()) -> DataFrame:
    """records with the allowed columns that changes, one row a key, bring: where its value is null, and where it has no
    row, the record stays as it is; columns that aren't allowed or that records lack are passed over."""
    names = [c for c in changes.columns if c in allowed and c in records.columns and c != key]
    j = records.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else c for c in records.columns])


def without_terminal(tasks: DataFrame, again: DataFrame, states=("REJECTED", "FAILED", "SUCCEEDED")) -> DataFrame:
    """tasks(document_id, status) without those that ended, of documents in again(document_id)."""
    gone = again.select("document_id").distinct().withColumn("_again", F.lit(True))
    return tasks.join(gone, "document_id", "left").filter(~(F.coalesce("_again", F.lit(False)) & F.coalesce(F.col("status").isin(*states), F.lit(False)))).drop("_again")


def catalog(registry: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Registered documents whose file exists, and files that no one registered, by name in lower case.

    registry(document_id, filename, source_path, source_type), files(path, size). Unregistered files have their stem as
    id and are legacy. With extensions, such as ".pdf", only files of these, in any case, are listed."""
    wanted = files if not extensions else files.filter(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(*map(str.lower, extensions)))
    ext = F.regexp_extract("path", r"\.([^./\\]+)$", 1)
    known = wanted.join(registry.withColumnRenamed("source_path", "path"), "path").select("document_id", "filename", "path", F.coalesce(F.nullif("source_type", F.lit("")), ext).alias("source_type"), "size", F.lit(False).alias("legacy"))
    other = wanted.join(registry.select(F.col("source_path").alias("path")), "path", "left_anti").select(T.file_stem(F.col("path")).alias("document_id"), F.regexp_extract("path", r"([^/\\]*)$", 1).alias("filename"), "path", ext.alias("source_type"), "size", F.lit(True).alias("legacy"))
    return known.unionByName(other).orderBy(F.lower("filename"), "path")


def narrowed(scope: str, document_ids: list[str] | None) -> list[str] | None:
    """The documents that a search is narrowed to, None for all; the scope "selected" needs some."""
    if scope == "selected" and not document_ids:
        raise ValueError("scope selected needs document ids")
    return list(document_ids) if document_ids else None
