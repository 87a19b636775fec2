"""Parsing, chunking, grouping and cataloguing on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunking as C
from inkwell.operators import documents as D


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_parser_of(spark):
    d = spark.createDataFrame([("a.MD",), ("b.tar.xlsx",), ("c",), ("d.exe",), ("e.htm",)], "p string")
    assert [x["v"] for x in d.select(D.parser_of(F.col("p")).alias("v")).collect()] == ["markdown", "xlsx", None, None, "html"]


def test_hard_windows(spark):
    t = "x" * 1200
    assert [len(x["chunk"]) for x in C.hard_windows(one(spark, t)).orderBy("pos").collect()] == [500, 500, 360]
    assert C.hard_windows(one(spark, "short")).count() == 0


def test_sliding_equals_the_loop(spark):
    for n in (1, 5, 6, 8, 11):
        t = " ".join(f"Sentence number {i} is here." for i in range(n))
        got = [x["chunk"] for x in C.sliding(one(spark, t), least=1).orderBy("pos").collect()]
        s = [f"Sentence number {i} is here." for i in range(n)]
        want = [t] if n <= 5 else []
        i = 0
        while n > 5:
            want.append("\n".join(s[i : i + 5]))
            if i + 5 >= n:
                break
            i += 2
        assert got == want


def test_sequential_chunkers():
    r = random.Random(1)
    text = "\n".join(" ".join("word%d" % r.randrange(99) for _ in range(r.randint(1, 200))) for _ in range(20))
    assert all(50 <= len(c) <= 600 for c in C.fixed(text))
    assert all(50 <= len(c) < 550 for c in C.recursive(text))  # a piece of under 50 joins the one before, whatever its size
    assert "".join(C.recursive("a" * 1200)) == "a" * 1200
    assert all(len(c) >= 100 for c in C.semantic(text.replace(" word1", ". word1")))
    assert C.token_estimate("x" * 3000)[0] == "x" * 1500 and len(C.token_estimate("x" * 3000)) == 3
    md = "intro " * 30 + "\n# A\n" + "text " * 40 + "\n## B\n" + "\n\n".join("para " * 100 for _ in range(6))
    parts = C.markdown(md)
    assert parts[1].startswith("# A\n") and all(p.startswith("## B") for p in parts[2:]) and len(parts) > 3
    for bad in ({"overlap": 500, "size": 500}, {"least": 9, "most": 9}, {"step": 6, "size": 5}):
        with pytest.raises(ValueError):
            C.check_parameters("fixed", **bad)


def test_chunkers_by_their_rules(spark):
    a, b = "a" * 900, "b" * 60
    assert C.fixed(a) == ["a" * 500, "a" * 480]  # no window within the one before
    assert C.fixed(f"{b}\n{b}", size=100, overlap=10) == [b, "b" * 10 + "\n" + b]
    assert C.fixed(f"{a}\n{b}\r{b}") == ["a" * 500, "a" * 480, f"{b}\n{b}"]
    assert C.recursive("x" * 30 + "\n\n" + "y" * 490) == ["y" * 490]
    assert C.recursive("y" * 490 + "\n\n" + "x" * 30) == ["y" * 490 + "x" * 30]
    assert C.recursive(" ".join(["w" * 99] * 6)) == [" ".join(["w" * 99] * 5), "w" * 99]
    assert C.recursive(" \n ") == [] and C.semantic(" ") == []
    assert C.semantic("one short sentence.") == ["one short sentence."]
    assert C.token_estimate("c" * 40) == [] and C.token_estimate("\n".join(["d" * 700] * 3)) == ["d" * 700 + "\n" + "d" * 700, "d" * 150 + "\n" + "d" * 700]
    rows = spark.createDataFrame([(1, "short_qa", b), (2, "layout", " t "), (3, None, a), (4, "technical", " ")], "doc_id long, profile string, text string")
    assert sorted(map(tuple, C.chunk_by_profile(rows).collect())) == [(1, "short_qa", 0, b), (2, "layout", 0, "t"), (3, "short_qa", 0, "a" * 500), (3, "short_qa", 1, "a" * 460)]
    h = C.hard_windows(rows.filter("doc_id = 3")).collect()
    assert sorted((x["pos"], len(x["chunk"])) for x in h) == [(0, 500), (1, 480)]


def test_passages_are_found_wherever_they_stand(spark):
    from inkwell.operators.retrieval import holding

    texts = ["alpha beta gamma delta epsilon", "xalpha beta gamma deltay", "beta gamma", "", None, "alpha  beta gamma delta"]
    passages = ["alpha beta gamma delta", "beta gamma", "gamma", "nothing of this here"]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "query_id int, passage string")
    got = sorted((x["doc_id"], x["query_id"]) for x in holding(t, p).select("doc_id", "query_id").collect())
    assert got == sorted((i, k) for i, x in enumerate(texts) for k, q in enumerate(passages) if x and q in x)


def test_passages_meet_texts_of_repeated_and_null_keys(spark):
    from inkwell.operators.retrieval import holding

    texts = [(1, "a bb cc d"), (1, "no such words here"), (1, "a bb cc d"), (None, "x bb cc y z"), (2, None)]
    t = spark.createDataFrame(texts, "doc_id int, text string")
    p = spark.createDataFrame([(0, "a bb cc d"), (1, "x bb cc y"), (1, "x bb cc y"), (2, "bb cc")], "query_id int, passage string")
    got = sorted(((x["doc_id"], x["query_id"]) for x in holding(t, p).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (1, 2), (1, 2), (None, 1), (None, 1), (None, 2)], key=str)
    assert holding(t.withColumnRenamed("doc_id", "k"), p, "k").count() == 7


def test_markdown_blocks():
    t = "# T\n\ntext a\ntext b\n\n| h | i |\n| - | - |\n| 1 | 2 |\n## U\n```py\nx = 1\n```\n# V\nend"
    assert C.markdown_blocks(t) == [("heading", "T", "T"), ("paragraph", "text a\ntext b", "T"), ("table", "| h | i |\n| - | - |\n| 1 | 2 |", "T"), ("heading", "U", "T > U"), ("code", "x = 1", "T > U"), ("heading", "V", "V"), ("paragraph", "end", "V")]


def test_html_blocks(spark):
    h = "<nav>menu</nav><article><h1>T</h1><p>a <b>b</b><br>c</p><script>x</script><ul><li>one</li><li>two</li></ul><table><tr><th>h</th><td>1</td></tr></table><pre>  x = 1\n</pre><img alt='cat'></article><p>out</p>"
    d = spark.createDataFrame([(1, h), (2, None)], "page_id long, html string")
    got = [(x["content_type"], x["text"], x["heading"]) for x in C.html_blocks(d).orderBy("block_pos").collect()]
    assert got == [("heading", "T", "T"), ("paragraph", "a b c", "T"), ("paragraph", "one；two", "T"), ("table", "h | 1", "T"), ("code", "  x = 1", "T"), ("image_description", "图片：cat", "T")]


BLOCKS = "document_id long, block_pos int, content_type string, heading string, source_type string, depth int, text string"


def blocks(spark):
    return spark.createDataFrame([(1, 0, "heading", "A", "md", 1, "# A"), (1, 1, "paragraph", "A", "md", 1, "x"), (1, 2, "table", "A", "md", 1, "t"), (1, 3, "paragraph", "A", "md", 1, "y"), (1, 4, "image_description", "B", "md", 1, "pic"), (1, 5, "paragraph", "B", "md", 1, "z")], BLOCKS)


def test_grouping(spark):
    got = [(x["n_blocks"], x["text"]) for x in C.group_long_form(blocks(spark)).orderBy("grp").collect()]
    assert got == [(2, "# A\n\nx"), (1, "t"), (1, "y"), (1, "pic"), (1, "z")]
    got = [x["text"] for x in C.group_structured(blocks(spark)).orderBy("grp").collect()]
    assert got == ["# A\n\nx", "t", "y", "pic", "z"]
    ctx = {x["block_pos"]: x["context"] for x in C.bind_context(blocks(spark)).collect()}
    assert ctx[4] == "y\nz" and ctx[2] is None


def test_rows_and_groups(spark):
    d = spark.createDataFrame([(i, [str(i), ""] if i % 2 else [str(i), "b", "c"]) for i in range(1, 104)], "rn long, cells array<string>")
    g = D.row_groups(d, "rn", ["k", "v"]).orderBy("group").collect()
    assert [x["n_rows"] for x in g] == [50, 50, 3] and g[2]["text"] == "k：101\nk：102；v：b\nk：103"


def test_page_rules(spark):
    rows = [("a", p, 500, 0) for p in range(1, 31)] + [("b", p, 0, 1) for p in range(1, 4)] + [("c", 1, 500, 1), ("c", 2, 500, 0)]
    s = D.sample_pages(spark.createDataFrame(rows, "document_id string, page int, text_len int, image_count int"))
    pages = sorted(x["page"] for x in s.filter("document_id = 'a'").collect())
    assert len(pages) == 10 and pages[0] == 1 and pages[-1] == 30
    assert {x["document_id"]: x["kind"] for x in D.classify_pages(s).collect()} == {"a": "native", "b": "scanned", "c": "mixed"}


def test_headings_and_paragraphs(spark):
    rows = [(1, 0, "T", 20.0, False, 0.0, 10.0), (1, 1, "a", 10.0, False, 12.0, 22.0), (1, 2, "b", 10.0, False, 24.0, 34.0), (1, 3, "B", 10.0, True, 60.0, 70.0), (1, 4, "c", 10.0, False, 72.0, 82.0)]
    d = spark.createDataFrame(rows, "document_id long, line_pos int, text string, size double, bold boolean, top double, bottom double")
    assert {x["text"]: x["level"] for x in D.headings(d).collect()} == {"T": 1, "B": 2}
    assert [x["text"] for x in D.paragraphs(d).orderBy("paragraph").collect()] == ["T a b", "B c"]


def test_clean_blocks(spark):
    d = spark.createDataFrame([(i, "pdf", f"Head line\nbody {i}\n{i}") for i in range(4)] + [(9, "txt", "12"), (10, "txt", "12\n13")], "block_id long, source_type string, text string")
    got = {x["block_id"]: x["text"] for x in D.clean_blocks(d).collect()}
    assert got[2] == "body 2" and got[9] == "12" and got[10] == "12\n13"


def test_profiles(spark):
    rows = [("a", "x.csv", "", 10, 0, 1), ("b", "x.md", "", 10, 0, 1), ("c", "x.pdf", "", 5000, 3, 2), ("d", "x.pdf", "", 900, 0, 2), ("e", "x.pdf", "", 9000, 1, 9), ("f", "x.csv", "问题：a\n答案：b", 90, 0, 1)]
    d = spark.createDataFrame(rows, "document_id string, filename string, sample string, total_chars long, n_layout long, n_text long")
    assert {x["document_id"]: x["profile"] for x in D.resolve_profile(d).collect()} == {"a": "spreadsheet", "b": "technical", "c": "layout", "d": "short_qa", "e": "long_form", "f": "short_qa"}


def test_reindex_twice(spark):
    old = spark.createDataFrame([(1, "o"), (2, "o")], "document_id long, v string")
    new = spark.createDataFrame([(2, "n"), (2, "m")], "document_id long, v string")
    once = sorted(map(tuple, D.reindex(old, new).collect()))
    assert once == sorted(map(tuple, D.reindex(D.reindex(old, new), new).collect())) == [(1, "o"), (2, "m"), (2, "n")]


def test_parsed_markdown_rules():
    """Blank lines stay in a text, a deep first heading stays over its siblings, fences and tables end texts, an open fence runs on."""
    t = "intro\n\nmore\n### deep\n## next\n## last\n  | a |\n| --- |\n| 1 |\nafter\n```\n\n```\n#no heading\n```py\n# x"
    assert C.parsed_markdown(t) == [
        ("text", "intro\n\nmore", ""), ("heading", "deep", "deep"), ("heading", "next", "deep > next"), ("heading", "last", "deep > last"),
        ("table", "| a |\n| --- |\n| 1 |", "deep > last"), ("text", "after", "deep > last"), ("text", "#no heading", "deep > last"), ("code", "# x", "deep > last")]
    assert C.parsed_markdown("") == []


def test_update_topics_and_catalog_of_odd_rows(spark):
    from inkwell.operators import documents as D

    files = spark.createDataFrame([(1, "a/.env"), (2, "b.tar.gz"), (3, None)], "document_id int, filename string")
    none = spark.createDataFrame([(2, 0, "heading", ["x"], "[ ]"), (2, 1, "text", None, "\n ## a]b \nc")], "document_id int, block_pos int, content_type string, heading_path array<string>, text string")
    assert {r.document_id: r.topic_label for r in D.topics(none, files).collect()} == {1: ".env", 2: "未命名资料", 3: "未命名资料"}
    assert {r.document_id: r.topic_label for r in D.topics(none.filter("block_pos = 1"), files).collect()}[2] == "ab"
    stored = spark.createDataFrame([(1, {"filename": "old"}), (4, None)], "document_id int, metadata map<string,string>")
    got = D.stamped(stored, files.selectExpr("*", "'t' topic_label", "'' source_url")).collect()
    assert {r.document_id: r.metadata for r in got} == {1: {"filename": "a/.env", "topic_label": "t"}, 4: {}}
    tasks = spark.createDataFrame([(1, "FAILED"), (1, None), (2, "FAILED"), (None, "FAILED")], "document_id int, status string")
    assert sorted(map(str, D.without_terminal(tasks, spark.createDataFrame([(1,), (1,), (None,)], "document_id int")).collect())) == sorted(["Row(document_id=1, status=None)", "Row(document_id=2, status='FAILED')", "Row(document_id=None, status='FAILED')"])


def test_selected_scope_needs_documents():
    from inkwell.operators import documents as D

    assert D.narrowed("all", None) is None and D.narrowed("auto", ["d"]) == ["d"]
    with pytest.raises(ValueError):
        D.narrowed("selected", [])
