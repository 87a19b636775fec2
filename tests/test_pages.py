"""Web pages as blocks, and groups of blocks with pages and slides."""

import pytest

from inkwell.operators import chunking as C
from inkwell.operators.html import article_blocks, code_text, page_blocks, pipe_table


def kinds(page):
    return [(k, t, " > ".join(p)) for k, t, p, *_ in page_blocks(page)]


def test_lists_take_the_paragraph_before():
    assert kinds("<main><p>Kinds:</p><ul><li>a</li><li><b>b</b> c</li></ul><p>Of</p><ol><li>d</li></ol><ul><li>e</li></ul></main>") == [("text", "Kinds:a；b c", ""), ("text", "Of：d", ""), ("text", "e", "")]
    assert kinds("<main><p>Of</p><pre>x</pre><ul><li>a</li></ul></main>") == [("text", "Of", ""), ("code", "x", ""), ("text", "a", "")]
    assert kinds("<main><p>Of</p><ul></ul><p>z</p></main>") == [("text", "Of", ""), ("text", "z", "")]


def test_chrome_is_passed_over_and_articles_end():
    page = "<p>before</p><article><nav><p>menu</p></nav><p>a<br>b</p><form><ul><li>x</li></ul></form><img src=x></article><p>after</p><script>var t='<p>s</p>'</script>"
    assert kinds(page) == [("text", "a b", "")]
    assert kinds("<div><p>no article</p></div>") == [] and kinds("") == [] and page_blocks(None) == []
    assert kinds("<main><nav><p>never closed") == []
    assert kinds("<main><svg/><p>seen</p></main>") == [("text", "seen", "")]


def test_heading_paths_and_unclosed_elements():
    page = "<article><h1> A  &amp; B </h1><h3>C</h3><p>one<p>two</p><h2>D</h2><blockquote>q</blockquote>stray<h1></h1><p>end"
    assert kinds(page) == [("heading", "A & B", "A & B"), ("heading", "C", "A & B > C"), ("text", "one", "A & B > C"), ("text", "two", "A & B > C"), ("heading", "D", "A & B > D"), ("text", "q", "A & B > D"), ("text", "end", "A & B > D")]


def test_references_without_their_semicolon():
    page = "<main><h1>a &amp; b &amp</h1><p>&lt;c &amp d &x; &amplify; &#38; e &</p></main>"
    assert [b[1] for b in page_blocks(page)] == ["a & b &", "<c & d &x; &lify; & e &"]
    assert [b[1] for b in page_blocks(page, True)] == ["a & b &amp", "<c &amp d &x; &amplify; & e &"]


def test_tables_and_code():
    page = "<main><p>lead</p><table><caption>Cap</caption><tr><th>k</th><th>v</th></tr><tr><td>1</td><td></td><td>x<br>y</td></tr><tr></tr></table><tr><td>m</td><td>n</td></tr><pre>\n\n  a = 1  \n<span>b</span><br>c\n</pre></main>"
    blocks = page_blocks(page)
    assert [b[:2] for b in blocks] == [("text", "lead"), ("table", "| k | v |\n|---|---|\n| 1 | x y |"), ("text", "m | n"), ("code", "  a = 1\nb\nc")]
    assert blocks[1][3:] == ([["k", "v"], ["1", "x y"]], "Cap") and blocks[0][3:] == (None, None)
    assert pipe_table([]) == "" and code_text(" \r\n") == ""
    assert page_blocks("<main><table><tr><td>1</td></tr>")[0][:2] == ("table", "| 1 |\n|---|")


def test_pages_in_spark(spark):
    long = "<main>" + "".join(f"<p>{i}</p>" for i in range(9000)) + "</main>"
    d = spark.createDataFrame([(1, "<main><p>a</p></main>", 1), (2, None, 2), (3, "", 3), (4, long, 4), (None, "<main><p>b</p></main>", 5)], "page_id long, html string, text int")
    got = article_blocks(d)
    assert got.columns == ["page_id", "block_pos", "content_type", "text", "heading_path", "cells", "caption"]
    n = {r[0]: r[1] for r in got.groupBy("page_id").count().collect()}
    assert n == {1: 1, 4: 9000, None: 1}
    assert got.filter("page_id = 4 and text = cast(block_pos as string)").count() == 9000
    assert article_blocks(d.limit(0)).count() == 0


BLOCKS = "document_id long, block_pos int, content_type string, heading string, source_type string, slide_number int, page_number int, text string"


def groups(spark, rows):
    got = C.long_form_groups(spark.createDataFrame(rows, BLOCKS)).orderBy("document_id", "grp").collect()
    return [(g["first_pos"], g["n_blocks"], g["content_type"], g["text"], g["segments"] and [tuple(s) for s in g["segments"]]) for g in got]


def test_groups_over_pages_record_segments(spark):
    rows = [(1, 0, "text", None, "pdf", None, 3, "first\n page"), (1, 1, "paragraph", None, "pdf", None, 4, " "), (1, 2, "text", None, "pdf", None, 5, None), (1, 3, "text", None, "pdf", None, None, "third")]
    assert groups(spark, rows) == [(0, 4, "text", "first page third", [(0, 10, 3), (11, 16, None)])]


def test_slides_headings_and_layout_part_groups(spark):
    slides = [(1, i, "text", None, "pptx", i // 2, i // 2, f" s{i} ") for i in range(4)]
    assert groups(spark, slides) == [(0, 2, "text", "s0 s1", [(0, 2, 0), (3, 5, 0)]), (2, 2, "text", "s2 s3", [(0, 2, 1), (3, 5, 1)])]
    one_each = [(1, i, "text", None, "pptx", i, i, f" s{i} ") for i in range(2)]
    assert groups(spark, one_each) == [(0, 1, "text", " s0 ", None), (1, 1, "text", " s1 ", None)]
    no_pages = [(1, 0, "heading", "A", "md", None, None, " a "), (1, 1, "text", "A", "md", None, None, ""), (1, 2, "text", "A", "md", None, None, "b\n"), (1, 3, "table", "A", "md", None, None, " t "), (1, 4, "text", "A", "md", None, None, "c"), (1, 5, "text", "B", "md", None, None, "d"), (1, 6, None, "B", "md", None, None, "e")]
    assert groups(spark, no_pages) == [(0, 3, "heading", "a\n\nb", None), (3, 1, "table", " t ", None), (4, 1, "text", "c", None), (5, 1, "text", "d", None), (6, 1, None, "e", None)]
    assert groups(spark, [(1, 0, "text", None, "pdf", None, 1, " "), (1, 1, "text", None, "pdf", None, 2, "")]) == [(0, 2, "text", "", [])]
    assert groups(spark, []) == []


@pytest.mark.parametrize("pages", [True, False])
def test_segments_give_back_the_texts(spark, pages):
    rows = [(i % 3, i, "text", "h" if i % 5 else "g", "pdf", None, i if pages else None, "w " * (i % 4)) for i in range(60)]
    for _, n, _, text, segments in groups(spark, rows):
        assert (segments is not None) == (pages and n > 1)
        for a, b, page in segments or []:
            assert text[a:b] == ("w " * (page % 4)).strip()


def test_profiles_that_are_asked_for(spark):
    from inkwell.operators import documents as D

    schema = "document_id int, filename string, sample string, total_chars int, n_layout int, n_text int, requested string"
    rows = [(1, "a.html", "", 9000, 0, 9, None), (2, "a.HTM", "", 9000, 0, 9, " Technical "), (3, "a.md", "", 9000, 0, 9, "auto"), (4, "a.pdf", "", 9000, 0, 9, "high_value"), (5, "a.pdf", "", 9000, 0, 9, ""), (6, "a.pdf", "", 10, 1, 9, "AUTO"), (7, None, None, 10, 0, 1, "layout")]
    got = {r["document_id"]: (r["profile"], r["parent_child"], r["reconstructed"], r["contextual"]) for r in D.chosen_profile(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("technical", False, False, False), 2: ("technical", True, True, False), 3: ("technical", True, True, False), 4: ("high_value", True, False, True), 5: ("long_form", True, False, False), 6: ("layout", False, False, False), 7: ("layout", False, False, False)}
    with pytest.raises(Exception, match="unknown profile: none such"):
        D.chosen_profile(spark.createDataFrame([(*rows[0][:6], "None such")], schema)).collect()


def test_chunks_are_assembled_by_profile(spark):
    b = [(1, 0, "heading", "A", "md", None, None, 1, "Title"), (1, 1, "text", "A", "md", None, None, 1, "x" * 60), (1, 2, "table", "A", "md", None, None, 1, "| t |")]
    b += [(2, 0, "text", None, "pdf", None, 1, 1, "one sentence."), (2, 1, "text", None, "pdf", None, 2, 1, "two"), (2, 2, "image_description", "H", "pdf", None, 2, 1, "pic"), (2, 3, "text", None, "pdf", None, 3, 1, None)]
    b += [(3, 0, "text", None, "html", None, None, 1, " short "), (3, 1, "text", None, "html", None, None, 1, " "), (3, 2, "text", None, "html", None, None, 1, "y" * 30), (9, 0, "text", None, "md", None, None, 1, "no document")]
    blocks = spark.createDataFrame(b, "document_id long, block_pos int, content_type string, heading string, source_type string, slide_number int, page_number int, depth int, text string")
    docs = spark.createDataFrame([(1, "technical", True, True, "a.md"), (2, "long_form", True, False, None), (3, "technical", False, False, " c.html ")], "document_id long, profile string, parent_child boolean, reconstructed boolean, filename string")
    got = C.assembled_chunks(blocks, docs).orderBy("document_id", "chunk_index").collect()
    whole = "# Title\n\n" + "x" * 60
    assert [(r["document_id"], r["chunk_index"], r["parent_chunk_id"], r["content"], r["parent_content"], r["chunk_level"]) for r in got] == [
        (1, 0, "1:parent:0", "# Title\n" + "x" * 60, whole, 1), (1, 1, "1:parent:1", "| t |", "| t |", 1),
        (2, 0, "2:parent:0", "one sentence. two", "one sentence. two", 1), (2, 1, "2:parent:1", "pic", "pic", 1),
        (3, 0, "3:parent:0", "short", "", 0), (3, 1, "3:parent:2", "y" * 30, "", 0),
    ]
    assert [r["search_text"] for r in got] == ["a.md\nA\n# Title\n" + "x" * 60, "a.md\nA\n| t |", "one sentence. two", "H\none sentence. two\npic", "c.html\nshort", "c.html\n" + "y" * 30]
    assert C.assembled_chunks(blocks.limit(0), docs).count() == 0
