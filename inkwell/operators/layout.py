"""Blocks of layout JSON, and one representation of a picture from what was read and seen in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_SPAN = "struct<type:string,content:string,html:string>"
_LINE = f"struct<spans:array<{_SPAN}>>"
_INNER = f"struct<type:string,lines:array<{_LINE}>>"
_BLOCK = f"struct<type:string,bbox:array<double>,lines:array<{_LINE}>,blocks:array<{_INNER}>>"
SCHEMA = f"struct<pdf_info:array<struct<page_idx:int,para_blocks:array<{_BLOCK}>>>>"
# Content types by block type; other blocks are dropped.
KINDS = {"title": "heading", "text": "paragraph", "list": "paragraph", "index": "paragraph", "table": "table", "image": "image", "chart": "image", "equation": "formula", "interline_equation": "formula", "code": "code"}


def _line_texts(lines: Column) -> Column:
    """The spans' contents of each line, joined."""
    of = lambda line: F.array_join(F.transform(F.coalesce(line["spans"], F.array().cast(f"array<{_SPAN}>")), lambda s: F.coalesce(s["content"], s["html"], F.lit(""))), "")
    return F.transform(F.coalesce(lines, F.array().cast(f"array<{_LINE}>")), of)


def layout_blocks(docs: DataFrame, key="document_id", json="json") -> DataFrame:
    """key, block_pos, page_number (from 1), content_type, text and bbox of each block of docs(key, json), in order.

    A block's text is that of its lines, and of those of the blocks within it. JSON that cannot be read gives no blocks; blocks
    without text stay only if they are pictures."""
    pages = docs.select(key, F.posexplode(F.from_json(json, SCHEMA)["pdf_info"]).alias("_page", "_p"))
    b = pages.select(key, "_page", F.col("_p.page_idx").alias("_idx"), F.posexplode("_p.para_blocks").alias("_pos", "_b"))
    inner = F.flatten(F.transform(F.coalesce(F.col("_b.blocks"), F.array().cast(f"array<{_INNER}>")), lambda x: _line_texts(x["lines"])))
    text = T.strip(F.array_join(F.concat(_line_texts(F.col("_b.lines")), inner), "\n"))
    kind = F.lit(None).cast("string")
    for t, k in KINDS.items():
        kind = F.when(F.col("_b.type") == t, k).otherwise(kind)
    out = b.select(key, "_page", "_pos", (F.col("_idx") + 1).alias("page_number"), kind.alias("content_type"), text.alias("text"), F.col("_b.bbox").alias("bbox"))
    out = out.filter("content_type is not null and (text != '' or content_type = 'image')")
    n = F.row_number().over(Window.partitionBy(key).orderBy("_page", "_pos")) - 1
    return out.select(key, n.alias("block_pos"), "page_number", "content_type", "text", "bbox")


def canonical_media(assets: DataFrame) -> DataFrame:
    """assets(asset, ocr_text, ocr_confidence, vision_text, formulas) with content_type and text: what vision saw,
    else plausible formulas with the text that was read, else that text, else a stand-in by the file's name."""
    good = F.filter(F.coalesce("formulas", F.array().cast("array<string>")), T.plausible_formula)
    blocks = F.array_join(F.transform(good, lambda f: F.concat(F.lit("$$\n"), f, F.lit("\n$$"))), "\n")
    read = T.strip(F.coalesce("ocr_text", F.lit("")))
    seen = T.strip(F.coalesce("vision_text", F.lit("")))
    formula = F.concat(F.when(read != "", F.concat(read, F.lit("\n\n"))).otherwise(""), F.lit("[公式 LaTeX]\n"), blocks)
    name = F.regexp_extract("asset", r"([^/\\]+)$", 1)
    kind = F.when(seen != "", "image_description").when(F.size(good) > 0, "formula").when(read != "", "image_ocr").otherwise("image_description")
    text = F.when(seen != "", seen).when(F.size(good) > 0, formula).when(read != "", read).otherwise(F.concat(F.lit("图片资源："), name, F.lit("（原始图片已保存，请查看来源）")))
    return assets.withColumn("content_type", kind).withColumn("text", text)


def ocr_summary(lines: DataFrame, key="asset") -> DataFrame:
    """Text of the lines(key, pos, text, confidence) of a picture in order, and their mean confidence."""
    from .documents import joined

    return lines.groupBy(key).agg(joined("pos", "text", "\n").alias("ocr_text"), F.avg("confidence").alias("ocr_confidence"))
