"""Queries that compare runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import comparisons as K
from ..operators import retrieval as R
from ..registry import query
from ..sources.tables import load
from .common import BM25_SQL, questions, stored_bm25

_HOLDS = "ex AS (SELECT item_id AS question_id, doc_id AS document_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
_GRID = "(VALUES ('top_k', 1, 0, false), ('top_k', 3, 1, false), ('top_k', 5, 2, true), ('top_k', 8, 3, false), ('skipped', 0, 0, true), ('skipped', 1, 1, false), ('skipped', 2, 2, false)) g(dimension, value, position, is_current)"


def _holds(spark, d):
    return R.holding(load(spark, d, "documents").select("doc_id", "text"), questions(spark, d).withColumnRenamed("text", "passage")).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("document_id"))


def _runs(spark, d, k):
    return stored_bm25(spark, d, questions(spark, d), k).select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("document_id"), "rank")


@query("sensitivity_grid", f"""WITH {BM25_SQL}, {_HOLDS}, qr AS (SELECT question_id, max(document_id) AS document_id FROM ex GROUP BY ALL),
ru AS (SELECT dimension, value, query_id AS question_id, chunk_id AS document_id, CASE dimension WHEN 'skipped' THEN rank - value ELSE rank END AS r FROM lx, {_GRID} WHERE rank <= 8 AND CASE dimension WHEN 'skipped' THEN rank > value ELSE rank <= value END),
h AS (SELECT dimension, value, question_id, min(r) AS r FROM ru JOIN qr USING (question_id, document_id) GROUP BY ALL),
m AS (SELECT dimension, value, position, is_current, round(count(*) FILTER (r <= 1) / (SELECT count(*) FROM qr), 4) AS recall_1, round(count(*) FILTER (r <= 3) / (SELECT count(*) FROM qr), 4) AS recall_3, round(coalesce(sum(1.0::DOUBLE / r), 0) / (SELECT count(*) FROM qr), 4) AS mrr FROM {_GRID} LEFT JOIN h USING (dimension, value) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY recall_1 DESC, mrr DESC, position) = 1 AS is_best, round(recall_1 - max(recall_1) FILTER (is_current) OVER (PARTITION BY dimension), 4) AS delta FROM m)
SELECT dimension, value::BIGINT AS value, recall_1, recall_3, mrr, is_best, delta, bool_or(is_best AND is_current) OVER (PARTITION BY dimension) AS best_is_current FROM b""")
def sensitivity_grid(spark, d):
    """Recall and reciprocal rank of every setting, one dimension at a time; the last document that holds a question is relevant."""
    grid = spark.sql(f"SELECT * FROM {_GRID}")
    of_skip = F.col("dimension") == "skipped"
    runs = _runs(spark, d, 8).join(F.broadcast(grid.select("dimension", "value")), F.when(of_skip, F.col("rank") > F.col("value")).otherwise(F.col("rank") <= F.col("value")))
    runs = runs.withColumn("rank", F.when(of_skip, F.col("rank") - F.col("value")).otherwise(F.col("rank")))
    return K.sweep(runs, _holds(spark, d).groupBy("question_id").agg(F.max("document_id").alias("document_id")), grid)


_REASONS = "CASE WHEN event_id % 5 = 0 THEN 'vague' WHEN event_id % 7 = 0 THEN 'several' END"


@query("clarification_ab", f"""WITH r AS (SELECT p.path, event_id, CASE WHEN event_type <> 'error' THEN CAST(value > CASE p.path WHEN 'on' THEN 40 ELSE 50 END AS DOUBLE) END AS acc, CASE WHEN event_id % 3 <> 0 THEN least(value, 100) / 100 END AS faith, value > CASE p.path WHEN 'on' THEN 5 ELSE 10 END AS ok, {_REASONS} AS reason FROM events, (VALUES ('off'), ('on')) p(path)),
c AS (SELECT path, coalesce(reason, 'none') AS reason, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT path, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM c GROUP BY path)
SELECT path, count(*) AS questions, round(avg(acc), 4) AS accuracy_mean, count(acc) AS accuracy_judged, round(avg(faith), 4) AS faithfulness_mean, count(faith) AS faithfulness_judged, count(*) FILTER (ok) AS answerable, round(count(*) FILTER (ok) / count(*), 4) AS answerable_rate, round(count(reason) / count(*), 4) AS clarification_rate, any_value(reasons) AS reasons FROM r JOIN m USING (path) GROUP BY path""")
def clarification_ab(spark, d):
    """Questions with and without the gate; answers and reasons by rule from events."""
    on = F.col("path") == "on"
    e = load(spark, d, "events").select("*", F.explode(F.array(F.lit("off"), F.lit("on"))).alias("path"))
    accuracy = F.when(F.col("event_type") != "error", (F.col("value") > F.when(on, 40).otherwise(50)).cast("double"))
    faith = F.when(F.col("event_id") % 3 != 0, F.least("value", F.lit(100)) / 100)
    reason = F.expr(_REASONS)
    r = e.select("path", F.col("event_id").alias("question_id"), accuracy.alias("accuracy"), faith.alias("faithfulness"), (F.col("value") > F.when(on, 5).otherwise(10)).alias("answerable"), reason.isNotNull().alias("gate_triggered"), reason.alias("gate_reason"))
    return K.clarification(r).withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


_ATTRIBUTION = f"""{BM25_SQL}, {_HOLDS}, si AS (SELECT query_id AS question_id, chunk_id AS document_id FROM lx WHERE rank <= 1), ag AS (SELECT query_id AS question_id, chunk_id AS document_id FROM lx WHERE rank <= 5 AND (rank + query_id) % 4 <> 0),
f AS (SELECT ex.question_id, ex.document_id, si.document_id IS NOT NULL AS s, ag.document_id IS NOT NULL AS a FROM ex LEFT JOIN si USING (question_id, document_id) LEFT JOIN ag USING (question_id, document_id)),
x AS (SELECT ag.question_id, count(*) AS n FROM ag ANTI JOIN ex USING (question_id, document_id) GROUP BY ALL),
pq AS (SELECT f.question_id, count(*) AS n_expected, count(*) FILTER (s) AS n_single, count(*) FILTER (a) AS n_agent, coalesce(string_agg(f.document_id, ',' ORDER BY f.document_id) FILTER (a AND NOT s), '') AS recovered, coalesce(string_agg(f.document_id, ',' ORDER BY f.document_id) FILTER (NOT a AND NOT s), '') AS residual, coalesce(any_value(x.n), 0) AS n_extra, bool_and(a) AS evidence_all, count(*) FILTER (a AND NOT s) AS n_rec, count(*) FILTER (NOT a AND NOT s) AS n_res FROM f LEFT JOIN x USING (question_id) GROUP BY f.question_id)"""


def _attributed(spark, d):
    found = _runs(spark, d, 5)
    agent = found.filter((F.col("rank") + F.col("question_id")) % 4 != 0)
    return K.attribution(_holds(spark, d), found.filter("rank <= 1"), agent)


@query("react_attribution", f"WITH {_ATTRIBUTION} SELECT question_id, n_expected, n_single, n_agent, recovered, residual, n_extra, evidence_all FROM pq")
def react_attribution(spark, d):
    """What a second run, which lacks some of the first one's hits, recovers and leaves of the documents that hold a question."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _attributed(spark, d).select("question_id", "n_expected", "n_single", "n_agent", text("recovered"), text("residual"), "n_extra", "evidence_all")


@query("react_totals", f"WITH {_ATTRIBUTION} SELECT count(*) AS n, coalesce(round(avg(CAST(evidence_all AS DOUBLE)), 4), 0) AS closure, count(*) FILTER (evidence_all) AS n_closed, CAST(coalesce(sum(n_rec), 0) AS BIGINT) AS recovered, CAST(coalesce(sum(n_res), 0) AS BIGINT) AS residual, coalesce(round(avg(CASE WHEN question_id % 5 = 0 THEN 0 ELSE question_id % 4 + 1 END), 2), 0) AS mean_tool_calls FROM pq")
def react_totals(spark, d):
    calls = questions(spark, d).filter("query_id % 5 != 0").select(F.col("query_id").alias("question_id"), (F.col("query_id") % 4 + 1).alias("tool_calls"))
    return K.attribution_totals(_attributed(spark, d), calls)


_MEASURED = "round(coalesce(count(*) FILTER (r <= 1), 0) / nq, 4) AS recall_1, round(count(*) FILTER (r <= 3) / nq, 4) AS recall_3, round(coalesce(sum(1.0::DOUBLE / r), 0) / nq, 4) AS mrr, round(coalesce(sum(p1), 0) / nq, 4) AS precision_1, round(coalesce(sum(p3), 0) / 3.0::DOUBLE / nq, 4) AS precision_3"
_SIDES = ", ".join(f"b.{m} AS {m}_before, a.{m} AS {m}_after, round(a.{m} - b.{m}, 4) AS {m}_delta" for m in K.MEASURES)


def _variants(runs, names: dict):
    """The runs under several names, each cut to so many places."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("most")) for n, k in names.items()]))
    return runs.select("*", each.alias("_v")).filter("rank <= _v.most").withColumn("variant", F.col("_v.variant")).drop("_v")


@query("variant_report", f"""WITH {BM25_SQL}, {_HOLDS}, nq AS (SELECT count(DISTINCT question_id) AS nq FROM ex),
ru AS (SELECT query_id AS question_id, chunk_id AS document_id, rank, v.side, v.variant FROM lx, (VALUES ('b', 'one', 1), ('b', 'eight', 8), ('b', 'gone', 8)) v(side, variant, most) WHERE rank <= most
UNION ALL SELECT query_id, chunk_id, n, 'a', v.variant FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM lx JOIN documents ON doc_id = chunk_id WHERE rank <= 8 AND lang <> 'en'), (VALUES ('one', 1), ('eight', 8), ('new', 8)) v(variant, most) WHERE n <= most),
h AS (SELECT side, variant, question_id, min(rank) AS r, count(*) FILTER (rank <= 1) AS p1, count(*) FILTER (rank <= 3) AS p3 FROM ru JOIN ex USING (question_id, document_id) GROUP BY ALL),
m AS (SELECT w.side, w.variant, {_MEASURED} FROM (SELECT DISTINCT side, variant FROM ru) w LEFT JOIN h ON h.side = w.side AND h.variant = w.variant, nq GROUP BY w.side, w.variant, nq)
SELECT b.variant, {_SIDES} FROM m b JOIN m a ON a.variant = b.variant WHERE b.side = 'b' AND a.side = 'a'""")
def variant_report(spark, d):
    """Variants of a search over all documents beside the same over those that are not English."""
    runs, holds = _runs(spark, d, 8), _holds(spark, d)
    other = load(spark, d, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("document_id"))
    w = Window.partitionBy("question_id").orderBy("rank")
    after = runs.join(other, "document_id", "left_semi").withColumn("rank", F.row_number().over(w))
    return K.report(K.summaries(_variants(runs, {"one": 1, "eight": 8, "gone": 8}), holds), K.summaries(_variants(after, {"one": 1, "eight": 8, "new": 8}), holds))
