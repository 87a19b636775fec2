"""Order within tables: the row before, the headings above a row, the page of an offset, versions of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Heading levels in one table, at most: those of font sizes or markup, an error beyond.
MOST_LEVELS = 64


def previous(rows: DataFrame, order: str, columns, by=(), ties=(), span: int = 4096, depth: int = 2) -> DataFrame:
    """rows with prev_<c> for each of columns: its value in the row before, by order (a whole number, gaps allowed) and
    ties, among rows that agree in `by`; null in the first row. Rows without order have no place and are left out.

    Rows are compared within ranges of `span` numbers; the first of a range gets the last row of the nearest
    range before that holds any, found the same way among ranges. Only ranges of span ** depth numbers meet in one task."""
    value = F.struct(*columns)
    named = lambda d, prev: d.select(*rows.columns, *[prev[c].alias(f"prev_{c}") for c in columns])
    rows = rows.filter(F.col(order).isNotNull())
    if not depth:
        return named(rows.withColumn("_prev", F.lag(value).over(Window.partitionBy(*by).orderBy(order, *ties))), F.col("_prev"))
    own, last = f"_range{depth}", f"_last{depth}"
    x = rows.withColumn(own, F.expr(f"`{order}` div {span}"))
    w = Window.partitionBy(*by, own).orderBy(order, *ties)
    ends = x.groupBy(*by, own).agg(F.max_by(value, F.struct(order, *ties)).alias(last))
    before = previous(ends, own, [last], by, (), span, depth - 1).select(F.col(f"prev_{last}").alias("_before"), *[F.col(c).alias(f"_{i}_key") for i, c in enumerate((*by, own))])
    x = x.withColumn("_lag", F.lag(value).over(w))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}_key")) for i, c in enumerate((*by, own))]
    return named(x.join(before, same, "left").withColumn("_prev", F.coalesce("_lag", "_before")), F.col("_prev"))


def under_headings(rows: DataFrame, by="document_id", order="line_pos", level="level", title="text") -> DataFrame:
    """rows with section (headings up to the row; 0 before the first), heading_level and heading_path: the titles of the
    headings that the row stands under, its own included. A heading ends those of its level and deeper ones.

    level: 1 and more of headings, null or 0 of other rows. A heading of level l is in the path if the last heading of
    level l or less has level l, which is one window over sorted rows, without a stack."""
    is_head = F.coalesce(F.col(level) > 0, F.lit(False))
    levels = [r[0] for r in rows.filter(is_head).select(level).distinct().orderBy(level).limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} heading levels")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.struct(F.col(level).alias("level"), F.coalesce(title, F.lit("")).alias("title"))
    last = {n: F.last(F.when(is_head & (F.col(level) <= n), head), ignorenulls=True).over(w) for n in levels}
    path = F.array_compact(F.array(*[F.when(last[n]["level"] == n, last[n]["title"]) for n in levels])) if levels else F.array().cast("array<string>")
    return rows.select("*", F.count_if(is_head).over(w).alias("section"), (F.last(F.when(is_head, F.col(level)), ignorenulls=True).over(w) if levels else F.lit(None).cast("int")).alias("heading_level"), path.alias("heading_path"))


def sections(rows: DataFrame, by="document_id", order="line_pos", level="level", title="text") -> DataFrame:
    """by, section, heading_level, heading_path, n_lines and text of each section: its heading, if it has one, and the
    rows up to the next, whose texts are joined by line feeds (empty where none follows)."""
    body = F.when(~F.coalesce(F.col(level) > 0, F.lit(False)), F.struct(F.col(order), F.coalesce(title, F.lit("")).alias("t")))
    out = under_headings(rows, by, order, level, title).groupBy(by, "section").agg(F.min("heading_level").alias("heading_level"), F.min("heading_path").alias("heading_path"), F.array_sort(F.collect_list(body)).alias("_b"))
    return out.select(by, "section", "heading_level", "heading_path", F.size("_b").alias("n_lines"), F.array_join(F.transform("_b", lambda x: x["t"]), "\n").alias("text"))


def chunk_pages(chunks: DataFrame, sentences: DataFrame, pages: DataFrame, by="document_id") -> DataFrame:
    """by, chunk_pos, page_start, page_end: the least and greatest page that sentences of a chunk start on.

    chunks(by, chunk_pos, n_chars, fallback_page): sentences joined, in order; sentences(by, sent_pos, start, n_chars);
    pages(by, page_pos, end, page): extents in order of the text that sentences start in, end exclusive. An
    offset past the last page is on it; a chunk of no sentence, or of pages that are all null, has its fallback page.

    Sentences meet pages, and chunks, by their place in one sorted pass a document, not by comparing all with all."""
    within = Window.partitionBy(by)
    down = within.orderBy(F.col("at").desc(), "is_page", F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    page = F.when(F.col("is_page"), F.struct("page"))
    marks = sentences.select(by, F.col("start").cast("long").alias("at"), F.lit(False).alias("is_page"), F.col("sent_pos").cast("long").alias("pos"), F.lit(None).cast("long").alias("page"), F.col("n_chars").cast("long").alias("n"))
    marks = marks.unionByName(pages.select(by, F.col("end").cast("long").alias("at"), F.lit(True).alias("is_page"), F.col("page_pos").cast("long").alias("pos"), F.col("page").cast("long").alias("page"), F.lit(0).cast("long").alias("n")))
    final = F.max_by(page, F.when(F.col("is_page"), F.struct("at", "pos"))).over(within)
    placed = marks.withColumn("_page", F.coalesce(F.last(page, ignorenulls=True).over(down), final)["page"]).filter(~F.col("is_page"))

    so_far = lambda n, pos: F.coalesce(F.sum(n).over(within.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = placed.select(by, so_far("n", "pos").alias("at"), F.lit(True).alias("is_sentence"), "pos", F.lit(None).cast("long").alias("to"), "_page")
    c = chunks.select(by, F.col("chunk_pos").cast("long").alias("pos"), F.col("n_chars").cast("long").alias("n"))
    c = c.withColumn("at", so_far("n", "pos")).filter("n > 0").select(by, "at", F.lit(False).alias("is_sentence"), "pos", (F.col("at") + F.col("n")).alias("to"), F.lit(None).cast("long").alias("_page"))
    up = within.orderBy("at", "is_sentence", "pos").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(~F.col("is_sentence"), F.struct(F.col("pos").alias("chunk"), "to")), ignorenulls=True).over(up)
    got = s.unionByName(c).withColumn("_in", held).filter("is_sentence and at < _in.to")
    spans = got.groupBy(F.col(by).alias("_by"), F.col("_in.chunk").alias("_chunk")).agg(F.min("_page").alias("_a"), F.max("_page").alias("_b"))
    j = chunks.join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("chunk_pos") == F.col("_chunk")), "left")
    return j.select(by, "chunk_pos", F.coalesce("_a", F.col("fallback_page").cast("long")).alias("page_start"), F.coalesce("_b", F.col("fallback_page").cast("long")).alias("page_end"))


def merged_versions(stored: DataFrame | None, changes: DataFrame, columns, by="user_id", order="seq", bump="bump") -> DataFrame:
    """History of records: by, version, columns, valid_from, valid_to (null of the row that holds now).

    changes(by, order, bump, columns): null leaves a column as it is; a record starts at version 1, and a change
    raises it where bump is true. A change that is not after the open row of its record is merged already and passed over, so
    that merging a batch again changes nothing. Only records with new changes are computed anew."""
    value = list(columns)
    fresh = changes.select(by, F.col(order).alias("valid_from"), F.coalesce(bump, F.lit(True)).alias("_bump"), *value, F.lit(None).cast("long").alias("_base"))
    if stored is not None:
        now = stored.filter("valid_to is null")
        fresh = fresh.join(now.select(F.col(by).alias("_by"), F.col("valid_from").alias("_since")), F.col(by).eqNullSafe(F.col("_by")), "left").filter("_since is null or valid_from > _since").drop("_by", "_since")
        again = fresh.select(F.col(by).alias("_by")).distinct()
        of_again = lambda d, how: d.join(again, F.col(by).eqNullSafe(F.col("_by")), how)
        kept = of_again(now, "left_anti").unionByName(stored.filter("valid_to is not null"))
        fresh = fresh.unionByName(of_again(now, "left_semi").select(by, "valid_from", F.lit(False).alias("_bump"), *value, F.col("version").alias("_base")))
    w = Window.partitionBy(by).orderBy("valid_from")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when((F.row_number().over(w) == 1) & F.col("_base").isNull(), 1).otherwise(F.col("_bump").cast("long"))
    out = fresh.withColumn("_step", step).select(
        by,
        (F.coalesce(F.max("_base").over(to_here), F.lit(0)) + F.sum("_step").over(to_here)).alias("version"),
        *[F.last(c, ignorenulls=True).over(to_here).alias(c) for c in value],
        "valid_from",
        F.lead("valid_from").over(w).alias("valid_to"),
    )
    return out if stored is None else kept.select(*out.columns).unionByName(out)
