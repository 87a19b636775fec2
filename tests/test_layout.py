"""Layout JSON and pictures on small tables."""

import json

from inkwell.operators import layout as L


def test_layout_blocks(spark):
    span = lambda t: {"lines": [{"spans": [{"type": "text", "content": x} for x in t]}]}
    doc = {"pdf_info": [{"page_idx": 0, "para_blocks": [{"type": "title", "bbox": [0, 0, 9, 9], **span(["A", "B"])}, {"type": "header", **span(["drop"])}, {"type": "text", "lines": [{"spans": [{"content": "x"}]}, {"spans": [{"content": "y"}]}]}, {"type": "text", "lines": []}]}, {"page_idx": 1, "para_blocks": [{"type": "image"}, {"type": "table", "blocks": [{"type": "table_body", "lines": [{"spans": [{"html": "<table/>"}]}]}]}, {"type": "interline_equation", **span(["x^2"])}]}]}
    d = spark.createDataFrame([("a", json.dumps(doc)), ("b", "{"), ("c", None)], "document_id string, json string")
    got = [(x["document_id"], x["block_pos"], x["page_number"], x["content_type"], x["text"]) for x in L.layout_blocks(d).orderBy("block_pos").collect()]
    assert got == [("a", 0, 1, "heading", "AB"), ("a", 1, 1, "paragraph", "x\ny"), ("a", 2, 2, "image", ""), ("a", 3, 2, "table", "<table/>"), ("a", 4, 2, "formula", "x^2")]


def test_media(spark):
    rows = [("p/1.png", "read", 0.9, "seen", ["x=1"]), ("2.png", "read", 0.9, None, ["x=1", "只是文字"]), ("3.png", " read ", 0.9, "", []), ("p/4.png", None, None, None, None)]
    got = {x["asset"]: (x["content_type"], x["text"]) for x in L.canonical_media(spark.createDataFrame(rows, "asset string, ocr_text string, ocr_confidence double, vision_text string, formulas array<string>")).collect()}
    assert got["p/1.png"] == ("image_description", "seen")
    assert got["2.png"] == ("formula", "read\n\n[公式 LaTeX]\n$$\nx=1\n$$")
    assert got["3.png"] == ("image_ocr", "read")
    assert got["p/4.png"][1].startswith("图片资源：4.png")
