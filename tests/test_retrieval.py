"""Ranking operators on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import metrics as M
from inkwell.operators import retrieval as R


def test_bm25_is_the_direct_sum(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(1, 20)))) for i in range(40)] + [(40, "")]
    got = {x["chunk_id"]: x["score"] for x in R.bm25(spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame([(0, "aa bb bb zz")], "query_id long, text string")).collect()}
    toks = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for w in ("aa", "bb", "zz")}

    def score(t):
        return sum(math.log((n + 1) / df[w]) * (1 + t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))) for w in ("aa", "bb", "bb") if df[w])

    assert set(got) == {i for i, t in toks.items() if {"aa", "bb"} & set(t)}
    for i, s in got.items():
        assert s == pytest.approx(score(toks[i]), abs=2e-6)


def test_question_words_find_nothing(spark):
    d = spark.createDataFrame([(1, "什么是切片"), (2, "如何使用")], "chunk_id long, text string")
    assert R.bm25(d, spark.createDataFrame([(0, "如何")], "query_id long, text string")).count() == 0


def test_fusion_ties_keep_the_lexical_order(spark):
    hits = lambda *ids: spark.createDataFrame([(0, c, 1.0, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id long, score double, rank int")
    got = [(x["chunk_id"], x["origins"]) for x in R.rrf(hits(5, 6), hits(7, 6)).orderBy("rank").collect()]
    assert got == [(6, "bm25+vector"), (5, "bm25"), (7, "vector")]


def test_relevance_branches(spark):
    h = spark.createDataFrame([(0, "张三的学号是什么", "张三 学号 1", 1.0, 1), (1, "slice cap", "slice text", 0.5, 1), (2, "zz", "none", None, 1)], "query_id long, question string, content string, v_score double, rank int")
    got = {x["query_id"]: x["relevance"] for x in R.relevance(h).collect()}
    assert got[0] > 0.82 and got[1] == pytest.approx(0.65 * 0.75 + 0.25 * 0.5 + 0.1, abs=1e-4) and got[2] == pytest.approx(0.1)


def test_diversity_equals_the_walk(spark):
    r = random.Random(2)
    for _ in range(3):
        rows = [(0, i, f"d{r.randrange(5)}", r.random()) for i in range(20)]
        got = {x["chunk_id"] for x in R.diversify(spark.createDataFrame(rows, "query_id long, chunk_id long, document_id string, score double"), 6).collect()}
        kept, seen = [], {}
        for _, c, d, _ in sorted(rows, key=lambda x: -x[3]):
            if seen.get(d, 0) < 2 and len(kept) < 6:
                seen[d] = seen.get(d, 0) + 1
                kept.append(c)
        assert got == set(kept)


def test_budget_is_a_prefix(spark):
    d = spark.createDataFrame([(0, 1, 900), (0, 2, 10), (1, 1, 10), (1, 2, 95), (1, 3, 1)], "query_id long, rank int, tokens long")
    assert sorted((x["query_id"], x["rank"]) for x in R.within_budget(d, 100).collect()) == [(0, 1), (1, 1)]


def test_vector_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)], "chunk_id long, v array<double>")
    q = rows.filter("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    one = sorted(map(tuple, R.vector_topk(rows, q, 5).collect()))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, R.vector_topk(rows, q, 5).collect())) == one and len(one) == 45


def test_cells_equal_the_expression(spark, monkeypatch):
    r = random.Random(5)
    vectors = [[r.choice((-1.0, 0.5, 2.0)) for _ in range(3)] for _ in range(60)] + [[0.0] * 3, [float("nan"), 1.0, 1.0], None, [1.0, None, 2.0], [1.0, 2.0], []]
    rows = spark.createDataFrame([(i, v, i % 4 or None) for i, v in enumerate(vectors)], "chunk_id long, v array<double>, group int")
    pick = lambda *ids: rows.filter(F.col("chunk_id").isin(*ids)).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    q = pick(0, 1, 2, 30, 31, 60, 61, 62, 64)
    pairs = R.against(rows, q).select("query_id", "chunk_id", "group", F.round(R.cosine("v", "q"), 6).alias("score"))
    lines = lambda df: sorted(map(str, df.select("query_id", "chunk_id", "score").collect()))
    assert [c for c in R.scored(rows, q, 6).columns] == ["query_id", "chunk_id", "group", "score"]
    for most, size in ((None, 1 << 15), (2, 7)):
        monkeypatch.setattr(R.nearest, "CELL_ROWS", size)
        assert lines(R.vector_topk(rows, q, 6, most)) == lines(R.top(pairs, 6))
        for k, cap in ((6, 2), (3, 1)):
            want = lines(R.diversify(pairs, k, cap, ("query_id",), "group"))
            assert lines(R.diversify(R.scored(rows, q, k, most, cap), k, cap, ("query_id",), "group")) == want
    assert R.vector_topk(rows.filter("false"), q, 3).count() == R.vector_topk(rows, q.filter("false"), 3).count() == 0


def test_cells_send_on_few_of_their_pairs(spark):
    r = random.Random(6)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)], "chunk_id long, v array<double>")
    q = rows.filter("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    assert R.scored(rows, q, 5).count() == 50


def test_half_millionths_round_up():
    import numpy as np

    assert list(R.nearest._micro(np.array([0.0000005, -0.0000005, 0.1234565, 0.1234564999, 1.0, -0.2000014999999]))) == [1, -1, 123457, 123456, 1000000, -200001]


def test_metrics(spark):
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "question_id string, rank int, document_id string")
    rel = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "x")], "question_id string, document_id string")
    got = {x["question_id"]: x for x in M.single_relevant(runs, rel).collect()}
    assert (got["a"]["first_rank"], got["a"]["rr"], got["a"]["recall_1"], got["a"]["recall_3"], got["a"]["precision_3"]) == (2, 0.5, 0.0, 1.0, 0.3333)
    assert got["b"]["first_rank"] == got["c"]["first_rank"] == 0
    multi = {x["question_id"]: x for x in M.multi_relevant(runs, spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "q")], "question_id string, document_id string")).collect()}
    assert multi["a"]["coverage_3"] == 1.0 and multi["a"]["all_docs_3"] == 1.0 and multi["b"]["coverage_5"] == 0.0


def test_percentile_rule(spark):
    d = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v long")
    assert d.agg(M.indexed_percentile("v", 0.5).alias("p")).first()["p"] == 30


def test_distinct_evidence_is_the_greedy_walk(spark):
    r = random.Random(3)
    base = "abcdefghijklmnopqrst" * 2
    rows = [(q, c, float(r.randrange(4)), " ".join(base[: r.choice((0, 30, 33, 36, 38, 40))]) or None) for q in range(8) for c in range(9)]
    got = R.evidence(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, text string"), 7, 60).collect()
    for q in range(8):
        best = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))[:7]
        kept, used, shown = [], 0, []
        for _, c, _, text in best:
            s = "".join((text or "").split())
            if not any(s and o and min(len(s), len(o)) / max(len(s), len(o)) >= 0.9 and (s in o or o in s) for _, o, _ in kept):
                kept.append((c, s, text or ""))
        for c, _, text in kept:
            n = max(1, len(text) // 4) if text else 0
            if shown and used + n > 60:
                break
            used += n
            shown.append(c)
        assert [x["chunk_id"] for x in sorted(got, key=lambda x: x["place"]) if x["query_id"] == q] == shown


def test_federated_within_documents_and_by_intent(spark):
    chunks = [(1, "a", "可见性 规则", "可见性", [1.0, 0.0]), (2, "b", "可见性 规则", "other", [1.0, 0.0]), (3, "c", "slice", None, None), (4, "a", "可见性 规则", "x", [1.0, 0.0]), (5, "a", "可见性 规则", "y", [0.0, 1.0])]
    c = spark.createDataFrame(chunks, "chunk_id long, document_id string, text string, heading string, v array<double>")
    q = spark.createDataFrame([(0, "变量 可见性", [1.0, 0.0]), (1, "slice", None)], "query_id long, text string, q array<double>")
    got = [(x["query_id"], x["chunk_id"], x["rrf"]) for x in R.federated(c, q, cap=2).orderBy("query_id", "place").collect()]
    assert [g[:2] for g in got] == [(0, 1), (0, 2), (0, 4), (1, 3)]
    assert got[0][2] == pytest.approx(2 / 61 + R.HEADING_BOOST, abs=1e-9) and got[1][2] == pytest.approx(2 / 62, abs=1e-9)
    only = spark.createDataFrame([("b",)], "document_id string")
    assert [(x["query_id"], x["chunk_id"]) for x in R.federated(c, q, documents=only).collect()] == [(0, 2)]
