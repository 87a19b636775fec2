"""Order within tables, published tables, JSON lines and versions on small tables."""

import json
import tempfile

import pytest

from inkwell.operators import ordered as O
from inkwell.sources import jsonl
from inkwell.sources import store
from inkwell.sources.published import Published, VerificationError


def test_previous_over_gaps_and_groups(spark):
    places = [-9000, -3, -1, 0, 2, 511, 512, 4000, 4_000_000, 2**60, 2**60 + 1]
    rows = [(g, p, f"{g}{p}") for g in ("a", None) for p in places] + [("a", None, "nowhere")]
    d = spark.createDataFrame(rows, "g string, p long, v string")
    got = {(r["g"], r["p"]): r["prev_v"] for r in O.previous(d, "p", ["v"], by=["g"], span=4).collect()}
    assert got == {(g, p): (f"{g}{places[i - 1]}" if i else None) for g in ("a", None) for i, p in enumerate(places)}
    assert O.previous(d.limit(0), "p", ["v"]).count() == 0


def test_sections_by_a_stack(spark):
    def by_stack(rows):
        stack, out, path = [], [], []
        for pos, level, title in rows:
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, title))
                path = [t for _, t in stack]
            out.append((pos, list(path)))
        return out

    levels = [0, 2, 0, 3, 3, 1, 0, 4, 2, 0, 4, 4, 3, 1, 1, 0]
    rows = [(i, l or None, f"t{i}") for i, l in enumerate(levels)]
    d = spark.createDataFrame([("d", *r) for r in rows], "document_id string, line_pos int, level int, text string")
    got = [(r["line_pos"], r["heading_path"]) for r in O.under_headings(d).orderBy("line_pos").collect()]
    assert got == by_stack(rows)
    s = {r["section"]: (r["heading_path"], r["n_lines"], r["text"]) for r in O.sections(d).collect()}
    assert s[0] == ([], 1, "t0") and s[1] == (["t1"], 1, "t2") and s[3] == (["t1", "t4"], 0, "")
    assert O.sections(d.filter("level is null")).collect()[0]["n_lines"] == 5
    with pytest.raises(ValueError):
        O.sections(spark.range(70).selectExpr("'d' document_id", "id line_pos", "id + 1 level", "'x' text"))


def test_chunk_pages_by_the_loop(spark):
    sentences, chunks, pages = [3, 5, 2, 9, 4, 1], [8, 11, 0, 5], [(4, 1), (10, None), (18, 5)]
    starts = [sum(sentences[:i]) for i in range(6)]
    s = spark.createDataFrame([("d", i, starts[i], n) for i, n in enumerate(sentences)], "document_id string, sent_pos int, start int, n_chars int")
    c = spark.createDataFrame([("d", i, n, 77) for i, n in enumerate(chunks)] + [("e", 0, 5, None)], "document_id string, chunk_pos int, n_chars int, fallback_page int")
    p = spark.createDataFrame([("d", i, e, n) for i, (e, n) in enumerate(pages)], "document_id string, page_pos int, end int, page int")

    def page_at(offset):
        return next((n for e, n in pages if offset < e), pages[-1][1])

    want, k = {("e", 0): (None, None)}, 0
    for i, n in enumerate(chunks):
        held, seen = 0, []
        while k < 6 and held < n:
            seen.append(page_at(starts[k]))
            held += sentences[k]
            k += 1
        seen = [x for x in seen if x is not None]
        want["d", i] = (min(seen), max(seen)) if seen else (77, 77)
    assert {(r["document_id"], r["chunk_pos"]): (r["page_start"], r["page_end"]) for r in O.chunk_pages(c, s, p).collect()} == want


def test_publish_verifies_before_it_switches(spark):
    t = Published(spark, "file://" + tempfile.mkdtemp() + "/t", buckets=4)
    rows = lambda n: spark.createDataFrame([(f"d{i}", j, [1.0, 2.0]) for i in range(n) for j in range(3)], "document_id string, block_pos int, v array<double>")
    with pytest.raises(FileNotFoundError):
        t.read()
    t.publish(rows(6), t.counts(rows(6)), "v", 2)
    before = t.manifest()
    for bad in (lambda: t.publish(rows(5), t.counts(rows(6))), lambda: t.publish(rows(6), t.counts(rows(6)), "v", 3)):
        with pytest.raises(VerificationError):
            bad()
        assert t.manifest() == before and t.read().count() == 18
    assert set(store.names(spark, f"{t.path}/data")) == set(before[1]["buckets"].values())
    t._switch(1, before[1])
    with pytest.raises(Exception):
        t._switch(1, before[1])


def test_sync_writes_stale_buckets_alone(spark):
    t = Published(spark, "file://" + tempfile.mkdtemp() + "/t", buckets=8)
    rows = [(f"d{i}", j, "x") for i in range(40) for j in range(3)]
    make = lambda r: spark.createDataFrame(r, "document_id string, block_pos int, text string")
    t.publish(make([r for r in rows if r[0] != "d7" and r != ("d9", 2, "x")]), t.counts(make([r for r in rows if r[0] != "d7" and r != ("d9", 2, "x")])))
    old = t.manifest()[1]["buckets"]
    assert {r["document_id"] for r in t.stale(make(rows)).collect()} == {"d7", "d9"}
    assert t.sync(make(rows), batch=1) == 2
    assert sorted(map(tuple, t.read().collect())) == sorted(rows)
    assert 1 <= sum(old.get(b) != f for b, f in t.manifest()[1]["buckets"].items()) <= 2
    number = t.manifest()[0]
    assert t.sync(make(rows)) == 0 and t.manifest()[0] == number
    t.vacuum()
    assert sorted(map(tuple, t.read().collect())) == sorted(rows)


def test_sync_goes_on_after_a_failure(spark, monkeypatch):
    t = Published(spark, "file://" + tempfile.mkdtemp() + "/t", buckets=8)
    make = lambda r: spark.createDataFrame(r, "document_id string, block_pos int")
    rows = [(f"d{i}", j) for i in range(40) for j in range(2)]
    t.publish(make([(f"d{i}", 0) for i in range(40)]), make(rows).selectExpr("document_id", "1L as n").distinct())
    verify, calls = Published._verify, []

    def once(self, *a):
        calls.append(1)
        if len(calls) == 3:
            raise VerificationError("lost")
        verify(self, *a)

    monkeypatch.setattr(Published, "_verify", once)
    with pytest.raises(VerificationError):
        t.sync(make(rows), batch=2)
    left = t.stale(make(rows)).count()
    assert 0 < left < 40
    assert t.sync(make(rows), batch=2) == left
    assert sorted(map(tuple, t.read().collect())) == sorted(rows)


def test_json_lines(spark):
    folder = tempfile.mkdtemp()
    lines = [{"id": "a", "question": "q"}, {"id": "b", "question": " "}, {"id": "c", "question": "q"}, {"id": "c", "question": "r"}, {"question": "q"}]
    with open(f"{folder}/q.jsonl", "w") as f:
        f.write("\n".join(map(json.dumps, lines)) + '\n\n{"id": "z", "ques\n')
    good, bad = jsonl.read(spark, folder, "id string, question string", filled=("question",))
    assert [tuple(r) for r in good.collect()] == [("a", "q")]
    assert sorted(r["faults"] for r in bad.collect()) == [["blank_question"], ["duplicate_id"], ["duplicate_id"], ["no_id"], ["not_json"]]
    out, rows = "file://" + tempfile.mkdtemp() + "/o", spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert jsonl.append_missing(spark, out, rows.filter("id = 'a'")).count() == 1
    for _ in range(2):
        assert sorted(map(tuple, jsonl.append_missing(spark, out, rows).collect())) == [("a", 1), ("b", 2)]


def test_versions(spark):
    c = spark.createDataFrame([("u", 1, True, "x", None), ("u", 2, False, None, 5), ("u", 4, True, "y", None), ("w", 3, None, None, None)], "user_id string, seq int, bump boolean, style string, score int")
    want = sorted([("u", 1, "x", None, 1, 2), ("u", 1, "x", 5, 2, 4), ("u", 2, "y", 5, 4, None), ("w", 1, None, None, 3, None)], key=str)
    once = O.merged_versions(None, c, ["style", "score"])
    assert sorted(map(tuple, once.collect()), key=str) == want
    for cut in range(5):
        part = O.merged_versions(O.merged_versions(None, c.filter(f"seq < {cut}"), ["style", "score"]), c, ["style", "score"])
        assert sorted(map(tuple, part.collect()), key=str) == want, cut
        assert sorted(map(tuple, O.merged_versions(part, c, ["style", "score"]).collect()), key=str) == want
