"""Comparisons of runs on small tables."""

from inkwell.operators import comparisons as K


def test_sweep(spark):
    grid = spark.createDataFrame([("k", 1, 0, False), ("k", 2, 1, True), ("k", 3, 2, False), ("j", 9, 0, True)], "dimension string, value int, position int, is_current boolean")
    qrels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "question_id int, document_id string")
    runs = spark.createDataFrame([("k", 1, 1, "a", 1), ("k", 2, 1, "a", 1), ("k", 2, 2, "b", 2), ("k", 2, 9, "z", 1), ("k", 3, 1, "a", 1), ("k", 3, 2, "b", 2)], "dimension string, value int, question_id int, document_id string, rank int")
    got = {(r["dimension"], r["value"]): (r["recall_1"], r["recall_3"], r["mrr"], r["delta"], r["is_best"], r["best_is_current"]) for r in K.sweep(runs, qrels, grid).collect()}
    assert got == {("k", 1): (0.25, 0.25, 0.25, 0.0, False, True), ("k", 2): (0.25, 0.5, 0.375, 0.0, True, True), ("k", 3): (0.25, 0.5, 0.375, 0.0, False, True), ("j", 9): (0.0, 0.0, 0.0, 0.0, True, True)}


def test_clarification(spark):
    d = spark.createDataFrame([("on", 1, 1.0, None, True, True, "vague"), ("on", 2, None, 0.5, False, False, None), ("on", 3, 0.0, 1.0, True, True, "vague")], "path string, question_id int, accuracy double, faithfulness double, answerable boolean, gate_triggered boolean, gate_reason string")
    assert K.clarification(d).collect()[0].asDict() == {"path": "on", "questions": 3, "accuracy_mean": 0.5, "accuracy_judged": 2, "faithfulness_mean": 0.75, "faithfulness_judged": 2, "answerable": 2, "answerable_rate": 0.6667, "clarification_rate": 0.6667, "reasons": {"none": 1, "vague": 2}}


def test_attribution(spark):
    make = lambda rows: spark.createDataFrame(rows, "question_id int, document_id string")
    per = K.attribution(make([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "d")]), make([(1, "a"), (3, "x")]), make([(1, "b"), (1, "y"), (2, "d")]))
    got = {r["question_id"]: (r["n_single"], r["n_agent"], r["recovered"], r["residual"], r["n_extra"], r["evidence_all"]) for r in per.collect()}
    assert got == {1: (1, 1, ["b"], ["c"], 1, False), 2: (0, 1, ["d"], [], 0, True)}
    calls = spark.createDataFrame([(1, 3)], "question_id int, tool_calls int")
    assert K.attribution_totals(per, calls).collect()[0].asDict() == {"n": 2, "closure": 0.5, "n_closed": 1, "recovered": 2, "residual": 1, "mean_tool_calls": 1.5}
    assert K.attribution_totals(per.limit(0), calls).collect()[0]["closure"] == 0.0


def test_summaries_and_report(spark):
    schema = "variant string, question_id int, document_id string, rank int"
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "d")], "question_id int, document_id string")
    runs = spark.createDataFrame([("x", 1, "b", 2), ("x", 1, "a", 3), ("x", 2, "c", 1), ("x", 3, "z", 1), ("y", 1, "z", 1), ("x", 9, "c", 1)], schema)
    got = {r["variant"]: tuple(r[m] for m in K.MEASURES) for r in K.summaries(runs, qrels).collect()}
    assert got == {"x": (0.3333, 0.6667, 0.5, 0.3333, 0.3333), "y": (0.0, 0.0, 0.0, 0.0, 0.0)}
    later = spark.createDataFrame([("x", 2, "c", 2), ("w", 2, "c", 1)], schema)
    r = K.report(K.summaries(runs, qrels), K.summaries(later, qrels)).collect()
    assert [x["variant"] for x in r] == ["x"] and (r[0]["recall_1_before"], r[0]["recall_1_after"], r[0]["recall_1_delta"], r[0]["mrr_delta"]) == (0.3333, 0.0, -0.3333, -0.3333)
    assert K.summaries(runs, qrels.limit(0)).filter("mrr <> 0").count() == 0 and K.summaries(runs.limit(0), qrels).count() == 0
