"""Readers on broken, empty and odd files; the routing of PDF pages with extractors that a test brings."""

import json

from inkwell.plans.files import _docx, _xlsx
from inkwell.sources import files as R

SCHEMA = "path string, content binary"


def blocks(df):
    return [(r.path, r.page, r.content_type, r.text, r.heading_path) for r in df.orderBy("path", "block_pos").collect()]


def test_csv_of_odd_files(spark):
    files = [("a/x.csv", b""), ("b.csv", b"\n \nh1,,h3\n1,2\n\n4,5,6,7\n"), ("c.csv", None), ("d.csv", b"only,header\n"), ("e.csv", b'k\n"open\n')]
    got = blocks(R.csv_blocks(spark.createDataFrame(files, SCHEMA)))
    assert got == [
        ("b.csv", None, "table", "h1：1；2；h3：\nh1：；；h3：\nh1：4；5；h3：6", ["b", "行 3-5"]),
        ("e.csv", None, "table", "k：open", ["e", "行 1-1"]),
    ]


def test_csv_in_groups(spark):
    rows = "\n".join(map(str, range(7)))
    got = blocks(R.csv_blocks(spark.createDataFrame([("n.csv", f"n\n{rows}".encode())], SCHEMA), 3))
    assert [b[4][1] for b in got] == ["行 1-3", "行 4-6", "行 7-7"]
    assert got[2][3] == "n：6"


def test_broken_and_unknown_files_are_rows(spark):
    files = [("a.docx", b"no zip"), ("b.xlsx", _docx(1, "x", "s")), ("c.pptx", b""), ("d.odt", b"x"), ("e.docx", _docx(7, "Title\nbody", "src")), ("f.csv", b"a\n1\n")]
    got = blocks(R.file_blocks(spark.createDataFrame(files, SCHEMA)))
    assert [(b[0], b[2]) for b in got] == [("a.docx", "error"), ("b.xlsx", "error"), ("c.pptx", "error"), ("d.odt", "error"), ("e.docx", "heading"), ("e.docx", "text"), ("e.docx", "table"), ("e.docx", "image"), ("f.csv", "table")]
    assert got[5][4] == ["Title"]
    assert json.loads(got[6][3].removeprefix(R.WORD_TABLE)) == [["source", "id"], ["src", "7"], ["end", "end"]]


def test_xlsx_merges_and_blank_rows(spark):
    content = _xlsx(0, [["1", "one", "n1", "0"], ["2", "two", "n2", "3"], ["3", "three", "n3", "6"]])
    got = blocks(R.xlsx_blocks(spark.createDataFrame([("s.xlsx", content)], SCHEMA)))
    assert got[0][3] == "key：1；name：one；nation：n1；balance：0\nkey：2；name：two；nation：n1；balance：3\nkey：3；name：three；nation：n3；balance：6"
    assert got[0][4] == ["suppliers", "行 1-3"]


def test_numbers_of_sheets():
    assert [R._number("3", False), R._number("3.50", False), R._number("45292.5", True)] == ["3", "3.5", "2024-01-01 12:00:00"]


def test_pdf_routing(spark):
    files = spark.createDataFrame([("n.pdf", b"native"), ("s.pdf", b"scan"), ("x.pdf", b"broken")], SCHEMA)

    def pages(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [("a page of text that is long enough", 0)] * 2 if content == b"native" else [("", 1), ("", 1)]

    def engine(content):
        if content != b"scan":
            raise ValueError("not for me")
        return [("heading", "read by the engine")]

    rows = {(r.path, r.content_type, r.pdf_kind): r.text for r in R.pdf_blocks(files, pages, engine).collect()}
    assert rows == {("n.pdf", "text", "native"): "a page of text that is long enough", ("s.pdf", "heading", "scanned"): "read by the engine", ("x.pdf", "error", None): "ValueError: no pages"}
